"""Chat history per (user, keyword)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators.store import read_partitioned
from murmura.schema import HISTORY_SCHEMA, STORE_KEYS


def read_history(spark: SparkSession, path: str, user_id: str | None = None,
                 keyword: str | None = None) -> DataFrame:
    """Messages of a (user, keyword); an empty frame when none exist yet."""
    df = read_partitioned(spark, path, HISTORY_SCHEMA)
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    if keyword is not None:
        df = df.where(F.col("keyword") == keyword)
    return df


def write_turns(turns: DataFrame, path: str) -> None:
    """Append messages (conv_id, turn, role, text) to the histories of their
    (user, keyword)."""
    cols = [F.col(f.name).cast(f.dataType) for f in HISTORY_SCHEMA.fields]
    (turns.select(*cols).hint("rebalance", *STORE_KEYS).write.mode("append").partitionBy(*STORE_KEYS).parquet(path))
