"""Sentiment counts, top opinions and topic table decisions."""

from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.operators.sentiment import sentiment_summary, top_opinions
from murmura.operators.topics import cluster_samples, cluster_sizes, topic_table


def test_unknown_label_counts_in_total_only(spark):
    df = spark.createDataFrame([(K.POSITIVE,), (K.NEGATIVE,), ("긍정.",), (K.NEUTRAL,)], "sentiment string")
    r = sentiment_summary(df, group_cols=()).first()
    assert (r.total, r.pos, r.neg, r.neu) == (4, 1, 1, 1)
    assert r.pos_pct == 25.0


def test_zero_documents_null_percentages(spark):
    df = spark.createDataFrame([], "sentiment string")
    r = sentiment_summary(df, group_cols=()).first()
    assert r.total == 0 and r.pos_pct is None


def test_top_opinions_ties_profanity_and_prefix(spark):
    long_clean = "a" * 250 + "시발"          # profanity after char 200: kept
    rows = [(1, K.POSITIVE, "10", "first"), (2, K.POSITIVE, "10", "second"), (3, K.POSITIVE, "99", "시발 top"),
            (4, K.POSITIVE, "5", long_clean), (5, K.POSITIVE, "1,000", "commas are 0"),
            (6, K.NEGATIVE, None, "neg")]
    df = spark.createDataFrame(rows, "doc_id long, sentiment string, views string, document string")
    t = top_opinions(df, group_cols=()).orderBy("sentiment", "rank").collect()
    pos = [r.doc_id for r in t if r.sentiment == K.POSITIVE]
    assert pos == [1, 2, 4]                  # 3 is profane, ties by doc_id, 5 parses to 0
    assert len([r for r in t if r.doc_id == 4][0].opinion) == 200


def test_topic_table_drops_and_denominator(spark):
    rows = [(i, c, "   " if i == 0 else f"text {i}") for i, c in enumerate([0, 0, 0, 1, 1, 2])]
    df = spark.createDataFrame(rows, "doc_id long, cluster int, document string").withColumn("g", F.lit("s"))
    names = spark.createDataFrame([("s", 0, "fine"), ("s", 1, "x" * 31), ("s", 2, "완전 무관")],
                                  "g string, cluster int, topic string")
    t = topic_table(cluster_sizes(df, group_cols=["g"]), cluster_samples(df, group_cols=["g"]), names,
                    group_cols=["g"]).collect()
    assert [(r.cluster, r["count"], r.pct, r.rank) for r in t] == [(0, 3, 50.0, 1)]
    assert t[0].samples == ["text 1", "text 2"]   # blank content skipped, count keeps it


def test_model_topic_names_hook(spark):
    import pandas as pd
    from murmura.operators.scoring import ArrowScorer
    from murmura.operators.topics import model_topic_names
    rows = [(i, i % 2, "k", "u", ("x" * 200) if i == 0 else f"text {i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, cluster int, keyword string, user_id string, document string")
    namer = ArrowScorer(lambda prompts, _k: pd.Series([" name-%d " % p.count("- ") for p in prompts]))
    got = {r.cluster: r.topic for r in model_topic_names(df, namer).collect()}
    assert got == {0: "name-4", 1: "name-4"}
