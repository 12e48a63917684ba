"""Atomic commits for partitioned Parquet tables.

A table is a folder of immutable commits and a log:

    {path}/commit=<id>/<key>=<value>/.../part-*.parquet    rows of one commit
    {path}/_log/<version>-<id>/part-*.parquet              what the commit did

A job first writes its rows below a new commit id, which no reader looks at, then
its log entry under a temporary name; renaming that entry is the commit.  A log
row says for one key (store or run) ``add``, ``replace`` or ``drop``; all rows of
an entry take effect together.  A key's live commits are those added since its
last replace or drop.  A job that dies before the rename leaves every table as it
was; what it wrote is never read and goes with ``vacuum``.  Two jobs that commit
at once both stand; of two replaces of one key the later entry name holds.

Nothing is listed or looped over on the driver but the log's entry names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from murmura.session import null_safe, sized_broadcast

ENTRIES = 64                 # log entries after which they are folded into one
LIVE_ROWS = 200_000          # live (key, commit) rows that may be broadcast


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class CommitLog:
    """The log of the table below ``path``, partitioned by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = StructType([StructField(c, StringType()) for c in ("at", "action", *self.keys, "commit")])

    def entries(self) -> list[str]:
        """Entry names, oldest first."""
        fs, p = file_system(self.spark, f"{self.path}/_log")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n[0].isdigit())

    def rows(self) -> DataFrame:
        names = self.entries()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_log/{n}" for n in names])

    def live(self) -> DataFrame:
        """(keys, commit) that readers see."""
        last = F.max(F.when(F.col("action") != "add", F.col("at"))).over(Window.partitionBy(*self.keys))
        return (self.rows().withColumn("_last", last)
                .where((F.col("action") != "drop") & (F.col("_last").isNull() | (F.col("at") >= F.col("_last"))))
                .select(*self.keys, "commit").distinct())

    def read(self, schema: StructType) -> DataFrame:
        """The live rows, with declared types; an empty table without a commit."""
        fs, p = file_system(self.spark, self.path)
        if not self.entries() or not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        full = StructType([*schema.fields, StructField("commit", StringType())])
        d = self.spark.read.schema(full).parquet(self.path)
        live = sized_broadcast(self.live().withColumnRenamed("commit", "_commit"), LIVE_ROWS)
        live = live.select("_commit", *[F.col(k).alias(f"_live_{k}") for k in self.keys])
        cond = F.col("commit") == F.col("_commit")              # a plain equality: prunes commit folders
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_live_{k}"))
        return d.join(live, cond, "left_semi").drop("commit")

    def write(self, df: DataFrame) -> str:
        """Rows written below a new commit id that nobody reads yet.  A rebalance
        on the keys gives each folder few files, AQE splits a hot one."""
        commit = uuid.uuid4().hex
        df.hint("rebalance", *self.keys).write.partitionBy(*self.keys).parquet(f"{self.path}/commit={commit}")
        return commit

    def of_commit(self, commit: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/commit={commit}")

    def written(self, commit: str, action: str) -> DataFrame:
        """Log rows for the keys of a commit (partition columns only are read)."""
        keys = StructType([StructField(k, StringType()) for k in self.keys])
        return self.of_commit(commit, keys).distinct().select(F.lit(action).alias("action"), *self.keys, F.lit(commit).alias("commit"))

    def drops(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.lit("drop").alias("action"), *[F.col(k).cast("string").alias(k) for k in self.keys],
                           F.lit(None).cast("string").alias("commit")).distinct()

    def publish(self, *changes: DataFrame) -> None:
        """The commit: all changes in one log entry, which one rename shows."""
        names = self.entries()
        at = f"{int(names[-1].split('-')[0]) + 1 if names else 1:012d}-{uuid.uuid4().hex}"
        every = changes[0]
        for c in changes[1:]:
            every = every.unionByName(c)
        self._entry(at, every)
        if len(names) >= ENTRIES:
            self.fold()

    def _entry(self, at: str, rows: DataFrame) -> None:
        tmp, name = f"{self.path}/_log/_{at}", f"{self.path}/_log/{at}"
        rows.select(F.lit(at).alias("at"), "action", *self.keys, "commit").coalesce(1).write.parquet(tmp)
        fs, p = file_system(self.spark, tmp)
        if not fs.rename(p, self.spark._jvm.org.apache.hadoop.fs.Path(name)):
            raise OSError(f"could not commit {name}")

    def fold(self) -> None:
        """One entry with the live keys in place of the entries so far.  It bears
        the name after the last of them; they are deleted only when it stands."""
        names = self.entries()
        if len(names) < 2:
            return
        at = f"{names[-1]}-fold"
        self._entry(at, self.live().select(F.lit("replace").alias("action"), *self.keys, "commit"))
        for n in names:
            fs, p = file_system(self.spark, f"{self.path}/_log/{n}")
            fs.delete(p, True)

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> int:
        """Delete commits without a live key that are older than the given age
        (readers and jobs under way must be younger).  Returns commits deleted."""
        import time
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return 0
        before = (time.time() - older_than_seconds) * 1000
        old = [s.getPath().getName().removeprefix("commit=") for s in fs.listStatus(p)
               if s.getPath().getName().startswith("commit=") and s.getModificationTime() <= before]
        if not old:
            return 0
        asked = self.spark.createDataFrame([(c,) for c in old], "commit string")
        dead = [r["commit"] for r in asked.join(self.live().select("commit").distinct(), "commit", "left_anti").collect()]
        for c in dead:
            fs, p = file_system(self.spark, f"{self.path}/commit={c}")
            fs.delete(p, True)
        return len(dead)

    def keys_like(self, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
        """Live keys whose columns ``on`` stand in ``wanted`` (null equals null)."""
        return null_safe(self.live().select(*self.keys).distinct(), wanted.select(*[F.col(c).cast("string").alias(c) for c in on]).distinct(),
                         list(on), "left_semi")
