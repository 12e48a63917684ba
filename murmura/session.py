"""Session construction and the few execution helpers every operator shares."""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _given() -> set[str]:
    """Settings that the deployment has made: those of a JVM that spark-submit
    started, or of PYSPARK_SUBMIT_ARGS."""
    if "PYSPARK_GATEWAY_PORT" in os.environ or SparkContext._gateway is not None:
        return {k for k, _ in SparkConf().getAll()}
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    named = {"--master": "spark.master", "--driver-memory": "spark.driver.memory"}
    out = {named[a] for a in args if a in named}
    return out | {args[i + 1].split("=")[0] for i, a in enumerate(args[:-1]) if a == "--conf"}


def get_spark(master: str | None = None, app: str = "murmura",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session for this library.

    Only settings that nobody has made are set: a running session, the
    arguments of spark-submit and PYSPARK_SUBMIT_ARGS come first.  Master,
    driver memory and the number of shuffle partitions are chosen here only for
    a local run without them; ``master``, ``shuffle_partitions`` and ``extra``
    are the caller's own wish.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        for k, v in (extra or {}).items():
            running.conf.set(k, v)
        return running
    given = _given()
    conf = {k: v for k, v in DEFAULTS.items() if k not in given}
    if master or "spark.master" not in given:
        conf["spark.master"] = master or f"local[{os.environ.get('BENCH_CPUS', '*')}]"
        if "spark.driver.memory" not in given:
            conf["spark.driver.memory"] = os.environ.get("MURMURA_DRIVER_MEMORY", "16g")
        if "spark.sql.shuffle.partitions" not in given and conf["spark.master"].startswith("local"):
            conf["spark.sql.shuffle.partitions"] = "8"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    for k, v in (conf | (extra or {})).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it, to a shared file system; without
    it this raises.  Only a local run (tests, a laptop) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="murmura-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A folder for written intermediate tables below the checkpoint root."""
    sub = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return f"{checkpoint_root(spark)}/murmura/{sub}"


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it provably holds at most ``max_rows`` rows.

    The check runs ``limit(max_rows + 1).count()`` so its cost is bounded by
    the threshold, not by the table.  Beyond the bound the frame is returned
    unchanged and Catalyst/AQE choose a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def null_safe(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null, the keys standing once."""
    r = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = None
    for k in keys:
        one = a[k].eqNullSafe(r[f"_r_{k}"])
        cond = one if cond is None else cond & one
    return a.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
