"""Columns of the caller that are named like internal ones pass through."""

import random

import pytest
from helpers import prose
from pyspark.sql import functions as F

from murmura.llm.line_dedup import dedup_lines
from murmura.llm.mixing import mix
from murmura.llm.ngram_join import keep_one
from murmura.llm.quality import quality
from murmura.llm.queries import vocabulary
from murmura.llm.sharding import shuffle_to_shards
from murmura.llm.suffix_dedup import dedup_substrings
from murmura.llm.tables import own_names

NAMES = ("_key _id _h _block _chunk _size _copies _tk _doc _cdoc _gone _kd _kt _one _b _g _probe _src _row _order _place _x "
         "key row nth own copy words rows copies c0 c1 C2").split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) + "\n" + "a line that many documents hold here", "en", f"s{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in NAMES if n not in ("copies",)])


@pytest.mark.parametrize("name,run", [
    ("op3", keep_one), ("op4", lambda d: shuffle_to_shards(d, 3)), ("op4 keys", lambda d: shuffle_to_shards(d, 3, key_cols=["doc_id"])),
    ("op5", dedup_substrings), ("op6", dedup_lines), ("op7", lambda d: quality(d, vocabulary())), ("op9", mix)])
def test_operators(docs, name, run):
    out = run(docs)
    own = [n for n in NAMES if n in docs.columns]
    assert [c for c in docs.columns if c not in out.columns] == []
    got = out.select("doc_id", *own).collect()
    assert len(got) == 12 and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in own)


def test_pipeline_stages(docs, spark):
    import corpus_pipeline as P
    for name, stage in P.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = out.select("doc_id", *[n for n in NAMES if n in docs.columns]).collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in r.asDict() if n != "doc_id"), name


def test_added_column_replaces_the_callers(spark):
    @own_names("col")
    def twice(df, col="a"):
        return df.withColumn("b", F.col(col) * 2)
    df = spark.createDataFrame([(1, "x", "y")], "a int, B string, c0 string")
    assert [tuple(r.asDict().items()) for r in twice(df).collect()] == [(("a", 1), ("c0", "y"), ("b", 2))]
