"""Mixing, sharding and the pipeline."""

import random
import re

import numpy as np
import pytest
from helpers import DOCS, awkward, documents, prose, row, words
from pyspark.sql import functions as F

from murmura.llm import mixing as M
from murmura.llm import sharding as S


def water_fill(sizes, share, cap):
    """Targets by the rule, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        open_ = [s for s in order if s not in full]
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in open_)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_mix_meets_targets(spark, chunk):
    rng = random.Random(1)
    rows = awkward() + [row(1000 + i, prose(rng, rng.randint(1, 60)), rng.choice(["é", "Z", "a", "hot", "hot", "hot", None])) for i in range(300)]
    df = documents(spark, rows)
    got = M.mix(df, chunk=chunk).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    target = water_fill(sizes, 1.5, 2.0)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    again = M.mix(df.repartition(3), chunk=chunk).collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("kind", ["one size", "identical"])
def test_mix_of_equal_rows(spark, kind):
    """Pairs of equal mass and fraction settle both sides at once."""
    n = 10000
    df = spark.range(n).select((F.col("id") if kind == "one size" else F.lit(7).cast("long")).alias("doc_id"),
                               F.lit("src0").alias("source"), F.lit("a b c").alias("text"), F.lit("x").alias("_size"),
                               F.lit("y").alias("_order"), F.lit(1).alias("_row"), F.lit(2).alias("_place"))
    got = M.mix(df).agg(F.count("*"), F.sum("taken"), F.max("copies"), F.min("copies"), F.max("_size"), F.max("_row")).first()
    assert tuple(got) == (n, 3 * n * 3 // 2, 2, 1, "x", 1)


def test_settle_keeps_mass_and_expectation():
    rng = np.random.default_rng(2)
    x, a = rng.random(40), rng.integers(1, 50, 40).astype(float)
    total = np.zeros(40)
    for k in range(4000):
        y = M.settle(x, a, np.random.default_rng([3, k]))
        assert ((y > 0) & (y < 1)).sum() <= 1 and abs((y * a).sum() - (x * a).sum()) < 1e-6 and y.min() >= 0 and y.max() <= 1
        total += y
    assert np.abs(total / 4000 - x).max() < 0.05


def test_mix_of_nothing(spark):
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = M.mix(documents(spark, [row(1, None), row(2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_matrix_has_the_hypergeometric_law():
    sizes, chunks = np.array([5, 0, 7, 4]), np.array([6, 6, 4])
    total = np.zeros((4, 3))
    for seed in range(3000):
        m = np.array([S.matrix_row(i, sizes, chunks, seed) for i in range(4)])
        assert (m.sum(0) == chunks).all() and (m.sum(1) == sizes).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 3000 - np.outer(sizes, chunks) / 16).max() < 0.1


def test_wide_draws_match_numpy(monkeypatch):
    monkeypatch.setattr(S, "LIMIT", 10)
    r = np.random.default_rng(1)
    got = np.bincount([S.wide_hypergeometric(r, 5, 7, 4) for _ in range(6000)], minlength=5) / 6000
    want = np.bincount(r.hypergeometric(5, 7, 4, 60000), minlength=5) / 60000
    assert np.abs(got - want).max() < 0.03
    assert S.split(r, np.array([5, 0, 7]), 12).tolist() == [5, 0, 7]


@pytest.mark.parametrize("block_rows", [1 << 16, 8])
def test_shards_are_exact_and_whole(spark, block_rows):
    rows = awkward() * 3
    df = documents(spark, rows)
    got = S.shuffle_to_shards(df, 7, block_rows=block_rows)
    out = got.collect()
    assert got.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    assert sorted(str(r[:2]) for r in out) == sorted(str(r[:2]) for r in rows)
    counts = [sorted(r.slot for r in out if r.shard == s) for s in range(7)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    again = S.shuffle_to_shards(df.repartition(5), 7, block_rows=block_rows).collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:50], r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert S.shuffle_to_shards(spark.createDataFrame([], DOCS), 7).count() == 0


def test_shuffle_is_uniform(spark):
    df = spark.range(600).withColumn("x", F.lit("t"))
    hits = np.zeros((2, 3))
    for seed in range(12):
        for r in S.shuffle_to_shards(df, 3, seed=seed, block_rows=64).select((F.col("id") < 300).alias("h"), "shard").collect():
            hits[int(r.h), r.shard] += 1
    assert np.abs(hits / 1200 - 1).max() < 0.12


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C
    from test_dedup_operators import brute_components, edit
    rng = random.Random(8)
    rows = [r for r in awkward(8) if r[0] not in (70,)] + [row(300 + i, prose(rng, rng.randint(60, 140)), rng.choice(["p", "q"])) for i in range(150)]
    item = prose(rng, 30)
    rows += [row(800, prose(rng, 40) + " " + item + " " + prose(rng, 30)), row(801, "!! ".join(prose(rng, 90).upper().split()) + "!!")]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = lambda rs: sorted(str((r.doc_id, r.text)) for r in rs)
    before, after = seen["quality rules"]
    short = [r for r in before if len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) < 10]
    assert not {str((r.doc_id, r.text)) for r in short} & set(ids(after))
    assert sum(r.doc_id is not None and 300 <= r.doc_id < 450 for r in after) >= 147
    before, after = seen["n-gram Jaccard join"]
    assert len(after) == brute_components([(r.doc_id, r.text) for r in before], roots=True)
    before, after = seen["benchmark decontamination"]
    clean = [r for r in before if edit(words(item), words(r.text)) > 6]
    assert ids(after) == ids(clean) and len(clean) < len(before)
    before, after = seen["mixing to target weights"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).count(x) for x in set(ids(after))) <= 2
    before, after = seen["sharding"]
    assert ids(before) == ids(after) and len({(r.shard, r.slot) for r in after}) == len(after)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as C
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_no_pairing_join_in_any_plan(spark):
    from murmura.llm.queries import QUERIES
    for name, fn in QUERIES.items():
        if name.split("_")[0] in ("op4", "op5", "op6", "op8", "op9"):
            plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
