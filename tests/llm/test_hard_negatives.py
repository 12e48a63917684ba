"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from murmura.llm import hard_negatives as H

KIND = StructType([StructField("vec_id", LongType()), StructField("label", LongType()), StructField("embedding", ArrayType(DoubleType())),
                   StructField("g", StringType()), StructField("s", StringType()), StructField("q", StringType()),
                   StructField("slot", StringType()), StructField("score", StringType()), StructField("rank", StringType())])


def brute(rows, every, k=5, n_pos=5, low=80, high=100):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v, *_ in rows if i is not None and lab is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    first = {}
    for i, lab, q in sorted(ok):
        if i % every == 0:
            first.setdefault(i, (lab, q))
    for a, (lab, q) in first.items():
        near = sorted((-sum(x * y for x, y in zip(q, r)), i, other) for i, other, r in ok if i != a)
        pos = [(-s, i) for s, i, other in near if other == lab][:n_pos]
        for p, i in pos:
            neg = [(-s, j) for s, j, other in near if other != lab and low * p <= -high * s <= high * p][:k]
            out += [(a, i, r + 1, j, p, s) for r, (s, j) in enumerate(neg)]
    return sorted(out)


def answer(df, every, **kw):
    got = H.hard_negatives(H.scaled(df), F.col("vec_id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def made(seed, n, dim=6, labels=3, grid=True):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) if grid else rng.gauss(0, 1) for _ in range(dim)],
             "a", "b", "c", "d", "e", "f") for i in range(n)]


@pytest.mark.parametrize("grid", [True, False])
def test_equals_brute_force_with_ties_and_awkward_rows(spark, grid, monkeypatch):
    for name, v in (("ROWS", 16), ("ANCHORS", 8), ("GROUP", 2)):         # many blocks and groups on both sides
        monkeypatch.setattr(H, name, v)
    rows = made(3, 260, grid=grid)
    extra = ("a",) * 6
    rows += [(1000, None, [1.0] * 6, *extra), (1010, 1, None, *extra), (1020, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], *extra),
             (1030, 1, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], *extra), (1040, 2, [float("-inf")] * 6, *extra), (None, 1, [1.0] * 6, *extra),
             (1050, 0, [], *extra), (1060, 1, [1.0, 1.0], *extra)]
    rows += [rows[7], rows[7], rows[20], (40, 2, rows[40][2], *extra)]       # repeated rows, one id with two labels
    df = spark.createDataFrame(rows, KIND)
    want = brute(rows, 10)
    assert want and answer(df.repartition(3), 10) == want


def test_hot_label_and_few_positives(spark):
    rows = [(i, 0 if i % 3 else i, v, *x) for i, _, v, *x in made(5, 150)]   # a hot label, and labels of one row
    assert answer(spark.createDataFrame(rows, KIND), 4, k=3, n_pos=2) == brute(rows, 4, 3, 2)
    same = [(i, i % 2, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], *["x"] * 6) for i in range(90)]          # all scores tie
    assert answer(spark.createDataFrame(same, KIND), 9) == brute(same, 9)


def test_empty_and_one_label(spark):
    none = spark.createDataFrame([], KIND)
    assert answer(none, 10) == []
    rows = [(i, 1, [1.0], *["x"] * 6) for i in range(30)]
    assert answer(spark.createDataFrame(rows, KIND), 10) == []


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-2 ** 29, 2 ** 29, (5, 8)) for _ in range(2))
    assert (H.products(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a])).all()
    with pytest.raises(OverflowError):
        H.products(a << 20, b << 20)
