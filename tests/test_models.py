"""Fitted scorers, query variants, the topic namer and the embedding kernel."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from data_dirs import SF_CHECK, SF_SMALL
from murmura.functions import constants as K
from murmura.operators.expansion import expand_queries
from murmura.operators.scoring import HashEmbedder, score
from murmura.operators.trained import TrainedScorer


def test_embedding_equals_a_count_by_hand(spark):
    texts = ["a b a", "", None, "  ", "Zwölf Boxer, zwölf BOXER!", "x" * 50_000 + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    e = HashEmbedder(16)
    got = {r["id"]: (r["n"], r["v"]) for r in df.select("id", e.counts_column(F.col("text")).alias("n"),
                                                        e.column(F.col("text")).alias("v")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] == (None, None)
            continue
        want = np.zeros(16)
        for w in re.findall(r"[^\W_]+", t.lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 16] += 1
        assert got[i][0] == want.tolist()
        assert np.allclose(got[i][1], want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_variants_against_numpy(spark):
    rng = np.random.default_rng(5)
    docs, qs = rng.normal(size=(300, 6)), rng.normal(size=(7, 6))
    store = spark.createDataFrame([("g%d" % (i % 2), i, v.tolist()) for i, v in enumerate(docs)],
                                  "g string, vec_id int, embedding array<double>")
    asked = spark.createDataFrame([("g%d" % (i % 2), i, v.tolist()) for i, v in enumerate(qs)],
                                  "g string, qid int, embedding array<double>")
    got = expand_queries(asked, store, 5, 3, 0.7, doc_id="vec_id", group_cols=["g"]).collect()
    assert len(got) == 28
    got = {(r["parent_qid"], r["variant"]): r["embedding"] for r in got}
    for i, v in enumerate(qs):
        mine = docs[i % 2::2]
        for r in range(4):
            if r:
                near = np.argsort(((mine - v) ** 2).sum(1), kind="stable")[:5]
                v = 0.7 * v + 0.3 * mine[near].mean(0)
            assert np.allclose(got[i, r], v)


def test_variants_of_empty_stores_and_null_vectors(spark):
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "qid int, embedding array<double>")
    store = spark.createDataFrame([], "doc_id int, embedding array<double>")
    got = {(r["parent_qid"], r["variant"]): r["embedding"] for r in expand_queries(asked, store, 3, 1).collect()}
    assert got == {(1, 0): [1.0, 2.0], (1, 1): [1.0, 2.0], (2, 0): None, (2, 1): None}


@pytest.mark.parametrize("name", ["trained_sentiment", "trained_relevance"])
def test_fitted_scorers_beat_the_list_and_the_commonest_label(spark, name):
    import __spark_entry__ as E
    rows = [r for r in E.queries()[name](spark, SF_CHECK).collect() if r["held_out"]]
    n, right = sum(r["n"] for r in rows), sum(r["n_right"] for r in rows)
    assert right > sum(r["n_list_right"] for r in rows)
    assert right > max(r["n"] for r in rows)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id")
    assert n == docs.where("doc_id % 5 = 0 AND text IS NOT NULL").count()


def test_trained_scorer_cases(spark):
    rows = [("good fine great %d" % i, "yes") for i in range(20)] + [("bad awful poor %d" % i, "no") for i in range(20)]
    df = spark.createDataFrame(rows + [(None, "yes"), ("good", None)], "text string, label string")
    m = TrainedScorer.fit(df, "text", "label", pairs=True)
    probe = spark.createDataFrame([(1, "a good great day", "u", 1.0), (2, "awful, poor", "v", 2.0), (3, None, "w", 3.0)],
                                  "id int, text string, grams string, pred double")
    got = score(probe, m, "text", "told")
    assert got.columns == ["id", "text", "grams", "pred", "told"]
    assert {r["id"]: (r["grams"], r["pred"], r["told"]) for r in got.collect()} == {
        1: ("u", 1.0, "yes"), 2: ("v", 2.0, "no"), 3: ("w", 3.0, K.NEUTRAL)}
    one = TrainedScorer.fit(df.where("label = 'yes'"), "text", "label")
    assert {r["t"] for r in one.transform(probe, "text", "t").collect()} == {"yes", K.NEUTRAL}
    none = TrainedScorer.fit(df.limit(0), "text", "label")
    assert {r["t"] for r in none.transform(probe, "text", "t").collect()} == {K.NEUTRAL}


def test_variant_queries_return_rows(spark):
    import __spark_entry__ as E
    assert E.queries()["expanded_topk"](spark, SF_SMALL).count() > 0


def test_trained_scorer_goes_to_tasks_while_an_observation_is_open(spark):
    from pyspark.sql import Observation
    d = spark.createDataFrame([(f"good w{i % 7}" if i % 2 else f"bad w{i % 5}", "yes" if i % 2 else "no") for i in range(60)],
                              "text string, label string")
    watched = d.observe(Observation("open"), F.count("*").alias("n"))      # never run
    m = TrainedScorer.fit(d, "text", "label")
    assert not m.model[1].hasSummary
    got = m.transform(d, "text", "told")
    assert got.where("told <> label").count() == 0 and watched.columns == d.columns
