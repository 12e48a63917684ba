"""Nearest-neighbour join over pivot cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import pivots as P
from murmura.operators.vectors import centroid_assign, knn_topk


def vectors(spark, m, start=0, group=None):
    rows = [(start + i, None if group is None else group(i), [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "doc_id long, store string, embedding array<double>")


def brute(m, q, k):
    d = np.sqrt(((m[None, :, :] - q[:, None, :]) ** 2).sum(axis=2)) if len(q) * len(m) < 4e6 else P.distances(q, m)
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(d[i] <= np.partition(d[i], k - 1)[k - 1] + 1e-9)
        far = np.sqrt(((m[near] - q[i]) ** 2).sum(axis=1))
        first = np.lexsort((near, far))[:k]
        out.append([(int(near[j]), round(float(far[j]), 9)) for j in first])
    return out


def answer(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["doc_id"], round(r["dist"], 9)))
    return got


def clustered(rng, n, dim=8, centres=12):
    c = rng.normal(0, 5, (centres, dim))
    return np.round(c[rng.integers(0, centres, n)] + rng.normal(0, 0.4, (n, dim)), 2)


def ask(docs, queries, k, **kw):
    q = queries.select(F.col("doc_id").alias("qid"), "store", F.col("embedding").alias("q"))
    return P.pivot_knn(docs, q, k, doc_id="doc_id", doc_vec="embedding", qid="qid", query_vec="q", **kw)


def test_fifty_thousand_queries_in_one_pass(spark):
    rng = np.random.default_rng(1)
    m = clustered(rng, 3000)
    q = np.concatenate([m[:500], clustered(rng, 49500)])
    got = answer(ask(vectors(spark, m), vectors(spark, q), 4, cell=100))
    want = brute(m, q, 4)
    assert len(got) == 50000 and all(got[i] == want[i] for i in range(len(q)))


@pytest.mark.parametrize("split,part", [(1 << 15, 1 << 14), (7, 5)])
def test_groups_ties_and_awkward_vectors(spark, split, part, monkeypatch):
    monkeypatch.setattr(P, "SPLIT", split)
    monkeypatch.setattr(P, "QUERIES", part)
    rng = np.random.default_rng(2)
    m, q = rng.integers(0, 3, (400, 3)).astype(float), rng.integers(0, 3, (60, 3)).astype(float)       # most distances tie
    store = lambda i: (None, "a", "b", "b", "b")[i % 5]
    bad = spark.createDataFrame([(9001, "a", None), (9002, "a", [1.0, None, 0.0]), (9003, "b", [float("nan")] * 3), (9004, "a", [1.0])],
                                "doc_id long, store string, embedding array<double>")
    docs, asked = vectors(spark, m, group=store).unionByName(bad), vectors(spark, q, group=store).unionByName(bad)
    got = answer(ask(docs, asked, 6, group_cols=["store"], cell=20))
    for i in range(60):
        own = np.array([j for j in range(400) if store(j) == store(i)])
        assert got[i] == [(int(own[j]), d) for j, d in brute(m[own], q[i:i + 1], 6)[0]]
    assert set(got) == set(range(60))


def test_fewer_documents_than_k_and_empty_sides(spark):
    m = np.eye(3)
    few = vectors(spark, m)
    assert [len(x) for x in answer(ask(few, few, 9)).values()] == [3, 3, 3]
    assert ask(few.limit(0), few, 2).collect() == [] and ask(few, few.limit(0), 2).collect() == []


def test_cells_exclude_most_of_clustered_vectors(spark):
    """The bound sends a query to few of the cells."""
    rng = np.random.default_rng(3)
    m = clustered(rng, 4000)
    p = m[:40]
    to, between = P.distances(m[:200], p), P.distances(p, p)
    cell = P.distances(m, p).argmin(axis=1)
    used = np.unique(cell)
    far = P.distances(m, p)[np.arange(len(m)), cell]
    low, high = (np.array([f(far[cell == c]) for c in used]) for f in (np.min, np.max))
    sent = 0
    for i in range(200):
        least = P.least_distance(to[i], between[np.ix_(used, used)], used, low, high)
        true = np.array([P.distances(m[i:i + 1], m[cell == c]).min() for c in used])
        assert (least <= true + 1e-6).all()
        kth = np.partition(P.distances(m[i:i + 1], m)[0], 4)[4]
        sent += (least <= kth).sum()
    assert sent < 0.5 * 200 * len(used)


def test_large_sides_take_the_pivot_way(spark):
    rng = np.random.default_rng(4)
    m, c = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    docs, cents = vectors(spark, m), vectors(spark, c).select(F.col("doc_id").alias("label"), F.col("embedding").alias("centroid"))
    qs = vectors(spark, c).select(F.col("doc_id").alias("qid"), "embedding")
    rounded = lambda df: sorted((*r[:-1], round(r[-1], 9)) for r in df.collect())
    assert rounded(knn_topk(docs, qs, 5)) == rounded(knn_topk(docs, qs, 5, max_queries=10))
    a = centroid_assign(docs, cents, id_col="doc_id")
    b = centroid_assign(docs, cents, id_col="doc_id", max_centroids=10)
    assert a.columns == b.columns and rounded(a) == rounded(b)


def test_plan_sends_vectors_once_a_bucket_in_small_batches():
    """10,000 queries that no bound keeps from 200 cells: 4 rows each, not 200."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(200, 4)), rng.normal(size=(10_000, 4))
    cells = [[float(i), 64.0, 0.0, 9.0, float(i // 50), 1.0] for i in range(200)]
    flat = pa.array([[x for c in cells for x in c]], pa.list_(pa.float64())).take(pa.array(np.zeros(10_000, np.int64)))
    asked = pa.RecordBatch.from_pydict({"_g": pa.array([""] * 10_000), "_v": pa.array(list(q), pa.list_(pa.float64())),
                                        "_q": pa.array(np.arange(10_000)), "_theta": pa.nulls(10_000, pa.float64()), "_cells": flat})

    class Shared:
        value = p

    batches = list(P._planner(Shared, 4, 5, False)([asked]))
    assert max(b.num_rows for b in batches) <= 4 * P.PLANNED and sum(b.num_rows for b in batches) == 40_000
    want = pa.concat_arrays([b["_want"] for b in batches])
    assert len(want.flatten()) == 10_000 * 199                  # all cells but the nearest, which the first visit saw
