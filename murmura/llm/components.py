"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.tables import written


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp is the smallest node of its
    component.  Each round is two aggregates and two joins on written tables;
    the number of rounds grows with the logarithm of the longest path."""
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    e = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "cc")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "cc")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())
