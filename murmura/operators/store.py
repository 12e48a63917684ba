"""Runs, merges and the per-(user, keyword) document + vector store.

Layout below one root folder (a shared file system on a cluster):

    {root}/posts_merged     merged post records, by user_id, keyword, run_id
    {root}/posts_filtered   relevant post records, by user_id, keyword, run_id
    {root}/store            documents + vectors, by user_id, keyword
    {root}/history/user_id=/keyword=                 chat messages

Runs and stores are tables with a commit log (``operators.commits``): replace,
append, retention and delete each are one atomic commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmura.operators.commits import CommitLog, file_system
from murmura.schema import POST_COLUMNS, POST_SCHEMA, RUN_KEYS, RUN_SCHEMA, STORE_KEYS

NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"   # Spark's folder name for a null partition value

# ------------------------------------------------------- partitioned folders


def partition_folders(spark: SparkSession, base: str, **keys) -> list[tuple[dict, object]]:
    """(values, folder) of the partitions below ``base`` whose leading columns
    have the given values, in the order of ``keys``.  Folder names are compared
    unescaped, so a key may hold any character.  Listings only: one call per
    level, no data is read.  A value of ``...`` matches every folder."""
    found = [({}, base)]
    for col, want in keys.items():
        nxt = []
        for values, folder in found:
            fs, p = file_system(spark, str(folder))
            if not fs.exists(p):
                continue
            for st in fs.listStatus(p):
                name = st.getPath().getName()
                if not st.isDirectory() or not name.startswith(f"{col}="):
                    continue
                value = unquote(name.split("=", 1)[1])
                value = None if value == NULL_FOLDER else value
                if want is ... or value == want:
                    nxt.append((values | {col: value}, st.getPath().toString()))
        found = nxt
    return found


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, p = file_system(spark, folder)
    fs.delete(p, True)


def read_partitioned(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A partitioned folder with declared types (no inference: the key ``007``
    stays text); an empty table if the folder does not exist."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# ------------------------------------------------------------------ runs


def merge_sites(frames: Sequence[DataFrame], dedup: bool = False) -> DataFrame:
    """Union all of the per-site tables of a run, columns aligned by name
    (a column missing from one site becomes null); no dedup by default."""
    frames = list(frames)
    if not frames:                       # a run without any site: no posts
        return SparkSession.active().createDataFrame([], POST_SCHEMA)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if dedup:
        out = out.dropDuplicates(["site", "url"])
    return out


def run_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, RUN_KEYS)


def write_runs(df: DataFrame, path: str) -> None:
    """Replace the (user, keyword, run) partitions present in ``df``."""
    log = run_log(df.sparkSession, path)
    log.publish(log.written(log.write(df), "replace"))


def replace_runs(df: DataFrame, path: str, runs: DataFrame) -> DataFrame:
    """Replace all of the given runs by the rows of ``df`` in one commit; a run
    that has no rows any more is dropped by it.  ``df`` is evaluated once; the
    written rows are returned."""
    log = run_log(df.sparkSession, path)
    commit = log.write(df)
    log.publish(log.drops(runs.select(*RUN_KEYS)), log.written(commit, "add"))
    return log.of_commit(commit, df.schema)


def land_run_csvs(spark: SparkSession, csv_glob: str, path: str, user_id: str, keyword: str,
                  run_id: str, remove_sources: bool = False) -> int:
    """Merge the per-site CSVs of one run into the run table (replacing an
    earlier merge of that run) and optionally delete the CSVs afterwards.
    The CSV read is not splittable (multiLine), so it is landed once here
    and every later step reads Parquet.  Returns the rows written."""
    from murmura.sources.posts import read_posts_csv
    jvm = spark._jvm
    pat = jvm.org.apache.hadoop.fs.Path(csv_glob)
    fs = pat.getFileSystem(spark._jsc.hadoopConfiguration())
    sources = list(fs.globStatus(pat) or [])
    if not sources:                      # an empty run: nothing to merge
        return 0
    obs = Observation("land_run")
    df = (read_posts_csv(spark, csv_glob)
          .withColumn("user_id", F.lit(user_id)).withColumn("keyword", F.lit(keyword.replace(" ", "_")))
          .withColumn("run_id", F.lit(run_id)).observe(obs, F.count(F.lit(1)).alias("rows")))
    write_runs(df, path)
    n = observed_rows(obs)
    if remove_sources:
        for st in sources:
            fs.delete(st.getPath(), True)
    return n


def read_runs(spark: SparkSession, path: str, user_id: str | None = None,
              keyword: str | None = None, schema: StructType = RUN_SCHEMA) -> DataFrame:
    """Scan runs; the user / keyword predicates prune partitions.  A missing
    folder is a table without runs."""
    df = run_log(spark, path).read(schema)
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    if keyword is not None:
        df = df.where(F.col("keyword") == keyword)
    return df


def run_row_counts(df: DataFrame) -> DataFrame:
    """Rows per run, in run-name (= chronological) order."""
    return (df.groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(*RUN_KEYS))


def latest_run(df: DataFrame) -> DataFrame:
    """Greatest run name per (user, keyword)."""
    return df.groupBy(*STORE_KEYS).agg(F.max("run_id").alias("run_id"))


def retain_latest_run(df: DataFrame) -> DataFrame:
    """Keep only rows of the latest run of each (user, keyword).

    The latest-run table (one row per store) is an aggregate of ``df``
    itself, so checking its size up front would compute it twice.  AQE
    measures it when its stage completes and broadcasts it if it is small,
    else the semi join stays a shuffle join; no size is assumed."""
    return df.join(latest_run(df), RUN_KEYS, "left_semi")


def drop_stale_runs(spark: SparkSession, path: str, stores: DataFrame) -> int:
    """Drop every run but the latest of each given (user, keyword) in one commit.

    Retention is a log entry: live keys are joined with the stores that a job
    touched, however many, and no data is rewritten or listed.  Returns the
    number of runs dropped."""
    log = run_log(spark, path)
    mine = log.keys_like(stores, STORE_KEYS)
    newest = F.max(F.coalesce("run_id", F.lit(""))).over(Window.partitionBy(*STORE_KEYS))
    stale = mine.withColumn("_newest", newest).where(F.coalesce("run_id", F.lit("")) < F.col("_newest")).select(*RUN_KEYS).persist()
    try:
        n = stale.count()
        if n:
            log.publish(log.drops(stale))
    finally:
        stale.unpersist()
    return n


# ----------------------------------------------------------------- store


def observed_rows(obs: Observation) -> int:
    """Rows counted by an observation of a finished write.

    When AQE proves the written relation empty it drops the whole subtree,
    the observation node included, and no metrics row is produced: that
    case is zero rows."""
    try:
        return int(obs.get.get("rows", 0))
    except Exception as e:  # noqa: BLE001 - py4j wraps the JVM assertion
        if "toPyRow" in str(e):
            return 0
        raise


def known_urls(store: DataFrame, group_cols: Sequence[str] = STORE_KEYS) -> DataFrame:
    """Distinct stored urls per store.  Empty strings are not urls, but a
    null url is kept, so a new null url counts as already stored."""
    return (store.select(*group_cols, "url")
            .where(F.col("url").isNull() | (F.col("url") != ""))
            .distinct())


def anti_by_url(new: DataFrame, store: DataFrame, group_cols: Sequence[str] = STORE_KEYS) -> DataFrame:
    """Rows of ``new`` whose url is not yet in the store of their group.

    Null-safe on url; duplicates inside ``new`` are all kept.  The stored
    side is de-duplicated before the shuffle (partial aggregate), so a hot
    url costs one row per task there; on the new side AQE splits a skewed
    partition of the left-anti join."""
    k = known_urls(store, group_cols).withColumnRenamed("url", "_known_url")
    for g in group_cols:
        k = k.withColumnRenamed(g, f"_k_{g}")
    cond = [new[g] == k[f"_k_{g}"] for g in group_cols] + [new["url"].eqNullSafe(k["_known_url"])]
    return new.join(k, cond, "left_anti")


class VectorStore:
    """Parquet document + vector store partitioned by (user_id, keyword), with a
    commit log: every change below is one atomic commit."""

    def __init__(self, spark: SparkSession, root: str, embedder=None):
        from murmura.operators.scoring import HashEmbedder
        self.spark = spark
        self.root = root.rstrip("/")
        self.path = f"{self.root}/store"
        self.history_path = f"{self.root}/history"
        self.embedder = embedder or HashEmbedder()
        self.log = CommitLog(spark, self.path, STORE_KEYS)

    def read(self, user_id: str | None = None, keyword: str | None = None) -> DataFrame:
        """The stores (declared schema: no inference, and an emptied store
        folder still reads as an empty table)."""
        from murmura.schema import STORE_SCHEMA
        df = self.log.read(STORE_SCHEMA)
        if user_id is not None:
            df = df.where(F.col("user_id") == user_id)
        if keyword is not None:
            df = df.where(F.col("keyword") == keyword)
        return df

    def _prepare(self, df: DataFrame, text_col: str) -> DataFrame:
        """Rows to store, each with a vector and an id.  A row without ``doc_id``
        gets one from its store, url and text, so the same batch gets the same
        ids again.  Equal rows (counted first) are told apart by their place in
        the batch; a url of '' is no url and does not keep a row from being added
        again, so its id holds the commit too."""
        cols = [c for c in POST_COLUMNS if c in df.columns]
        x = df.where(F.col(text_col).isNotNull())
        if "doc_id" not in x.columns:
            x = x.withColumn("doc_id", F.lit(None).cast("bigint"))
        parts = [*STORE_KEYS, *[c for c in ("url", text_col) if c in x.columns]]
        if "url" in x.columns:
            parts.append(F.when(F.col("url") == "", F.lit(uuid.uuid4().hex)))
        given, bare = x.where(F.col("doc_id").isNotNull()), x.where(F.col("doc_id").isNull())
        bare = bare.withColumn("_same", F.xxhash64(*parts)).withColumn("_part", F.spark_partition_id())
        often = bare.groupBy("_same").count().where("count > 1").select(F.col("_same").alias("_often"))
        bare = bare.join(often, F.col("_same") == F.col("_often"), "left")
        single = bare.where(F.col("_often").isNull()).withColumn("doc_id", F.xxhash64("_same", F.lit(1)))
        # equal rows are numbered within their scan partition, after those of the
        # partitions before it, so no task gathers them all
        mine = Window.partitionBy("_same", "_part").orderBy("_same")
        several = bare.where(F.col("_often").isNotNull()).withColumn("_nth", F.row_number().over(mine))
        before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        first = (several.groupBy(F.col("_same").alias("_s"), F.col("_part").alias("_p")).count()
                 .withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
        several = (several.join(first, (F.col("_same") == F.col("_s")) & (F.col("_part") == F.col("_p")))
                   .withColumn("doc_id", F.xxhash64("_same", (F.col("_first") + F.col("_nth")).cast("int"))).drop("_s", "_p", "_first", "_nth"))
        x = given
        for part in (single, several):
            x = x.unionByName(part.drop("_same", "_part", "_often"))
        x = x.withColumn("embedding", self.embedder.column(F.col(text_col)))
        return x.select("doc_id", *cols, "embedding", *STORE_KEYS)

    def _commit(self, x: DataFrame, action: str) -> int:
        obs = Observation("store_commit")
        commit = self.log.write(x.observe(obs, F.count(F.lit(1)).alias("rows")))
        n = observed_rows(obs)
        if n:
            self.log.publish(self.log.written(commit, action))
        return n

    def overwrite(self, df: DataFrame, text_col: str = "document") -> int:
        """Replace the stores of the (user, keyword) pairs present in ``df``:
        drop null text, embed everything, one commit."""
        return self._commit(self._prepare(df, text_col), "replace")

    def append_new(self, df: DataFrame, text_col: str = "document") -> int:
        """Add the valid rows whose url is not yet stored; returns the count.

        A store that does not exist yet receives every valid row (the
        anti join against nothing keeps all).  Nothing new -> nothing is
        committed.  The count comes from an observation of the write itself,
        so the embedding runs once.  ``df`` is read more than once (its store
        keys, its equal rows, its rows): pass a written batch (the scored
        table), not a plan that calls a model."""
        from murmura.operators.filters import valid_posts
        batch = valid_posts(df, text_col)
        # only the stores this batch touches are read: a semi join on the
        # partition columns lets dynamic partition pruning skip the others
        touched = self.read().join(batch.select(*STORE_KEYS).distinct(), STORE_KEYS, "left_semi")
        return self._commit(self._prepare(anti_by_url(batch, touched), text_col), "add")

    def keywords(self) -> DataFrame:
        """(user_id, keyword) pairs that have a store: the log's live keys."""
        return self.log.live().select(*STORE_KEYS).distinct()

    def delete(self, user_id: str, keyword: str) -> str:
        """Remove store and history of one pair; both must exist.  The store goes
        in one commit, then the history's folder."""
        pair = dict(user_id=user_id, keyword=keyword)
        asked = self.spark.createDataFrame([(user_id, keyword)], "user_id string, keyword string")
        history = partition_folders(self.spark, self.history_path, **pair)
        if not history or self.log.keys_like(asked, STORE_KEYS).isEmpty():
            return "abnormal delete request"
        self.log.publish(self.log.drops(asked))
        for _, folder in history:
            remove_folder(self.spark, folder)
        return "delete success"


def delete_status(requests: DataFrame, stores: DataFrame, histories: DataFrame,
                  keys: Sequence[str] = STORE_KEYS) -> DataFrame:
    """Status of delete requests: success only when both a store and a history
    exist for the pair.  Three distinct key sets joined on the keys."""
    k = list(keys)
    s = stores.select(*k).distinct().withColumn("_s", F.lit(True))
    h = histories.select(*k).distinct().withColumn("_h", F.lit(True))
    r = requests.select(*k).distinct().join(s, k, "left").join(h, k, "left")
    ok = F.coalesce(F.col("_s"), F.lit(False)) & F.coalesce(F.col("_h"), F.lit(False))
    return r.select(*k, F.when(ok, F.lit("delete success"))
                    .otherwise(F.lit("abnormal delete request")).alias("status"))
