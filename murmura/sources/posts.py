"""Post records in CSV (as crawled) and Parquet (after landing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmura.schema import POST_SCHEMA

# Records may hold newlines, commas and doubled quotes: multiLine + '"'
# escaping are both required, and the schema is never inferred.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "encoding": "UTF-8", "mode": "PERMISSIVE"}


def read_posts_csv(spark: SparkSession, path: str, schema=POST_SCHEMA) -> DataFrame:
    """Every per-site CSV below ``path`` (a glob is fine).  Empty and
    header-only files contribute no rows.  multiLine CSV is not splittable:
    land it to Parquet once (``write_runs``) before heavy work."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, UTF-8, quotes doubled; nulls as empty fields."""
    (df.write.mode(mode).option("header", "true").option("escape", '"')
     .option("quote", '"').option("encoding", "UTF-8").csv(path))
