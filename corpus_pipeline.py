"""Training-corpus pipeline: quality rules, near-duplicate join, benchmark
decontamination, mixing to source weights, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame, which ``run`` writes as Parquet below the session's
``spark.checkpoint.dir`` and reads back for the next stage.  All but the last
return the columns of their input.  Nulls, empty texts, repeated rows, extra
columns and empty tables have the results that each operator's docstring gives;
a row without doc_id is told apart by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.decontam import contamination
from murmura.llm.mixing import mix, word_count
from murmura.llm.ngram_join import keep_one
from murmura.llm.quality import quality
from murmura.llm.queries import table, vocabulary
from murmura.llm.sharding import shuffle_to_shards
from murmura.llm.tables import written

SHARDS = 24
BLOCK_ROWS = 1 << 11           # whole texts pass through a block: some MB


def keyed(docs: DataFrame, *of: str) -> DataFrame:
    """(row, key): the columns of ``docs`` as one struct, so that no column of
    theirs can meet a name used here, and a hash of the columns ``of``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*of).alias("key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and fertility rules keep.  Only slim measures are
    written; the texts meet their verdict."""
    d = keyed(docs, "doc_id", "text", "lang")
    measured = quality(d.select("key", "row.text", "row.lang"), vocabulary(), keep_text=False)
    kept = measured.where("kept").select("key").distinct()
    return d.join(kept, "key", "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    d = keyed(docs, "doc_id", "text")
    found = contamination(d.select("key", "row.text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return d.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it (0 to 2 times).
    Slim rows are mixed; texts only meet their number of copies.  Rows that
    repeat id and text share their copies evenly, by the order of their hash."""
    d = keyed(docs, "doc_id", "text")
    slim = d.select("key", "row.source", word_count(F.col("row.text")).alias("words"))
    taken = mix(slim, size=F.col("words")).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    full = d.join(taken.where("copies > 0"), "key").withColumn("nth", nth)
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return (full.withColumn("own", own.cast("int")).where("own > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in uniformly random order over equal shards."""
    return shuffle_to_shards(docs, SHARDS, block_rows=BLOCK_ROWS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None              # tokenisers, dependent rounding and random shards have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
