"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, awkward, documents, prose, row

from murmura.llm import collocations as C


def brute(rows, least=10, longest=3, cover=50, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= cover * a for q, b in cand.items() if len(q) > len(p)
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            cuts = [(1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def answer(df, **kw):
    got = C.collocations(df, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def sample(seed, n=120):
    rng = random.Random(seed)
    pool = [prose(rng, 3) for _ in range(12)]
    rows = awkward(seed)
    for i in range(n):
        text = " ".join(rng.choice(pool + ["Hot pair", "hot pair", "tab\tbed", "é, à", "x.y", "a\x0bb", "NB\xa0SP"]) for _ in range(rng.randint(1, 25)))
        rows.append(row(500 + i, text + rng.choice(["", "\n", "?!", " "]), lang=rng.choice(["en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("kw", [{}, {"least": 3, "longest": 5, "cover": 80, "top": 40}, {"longest": 2, "top": 7}])
def test_equals_brute_force(spark, kw):
    rows = sample(4)
    want = brute(rows, **kw)
    assert len(want) > 20 and answer(documents(spark, rows).repartition(5), **kw) == want


def test_ties_at_the_cut_go_by_spelling(spark):
    rows = [row(i, f"p{i % 40:02d} q{i % 40:02d}") for i in range(800)]
    assert answer(documents(spark, rows), top=9) == brute(rows, top=9)


def test_empty_tables_and_texts(spark):
    assert answer(spark.createDataFrame([], DOCS)) == []
    assert answer(documents(spark, [row(1, None), row(2, ""), row(3, " .\n"), row(4, "alone " * 3)])) == []


@pytest.mark.parametrize("seed", range(6))
def test_multikey_sort_counts(seed):
    rng = np.random.default_rng(seed)
    n, depth = int(rng.integers(0, 400)), 3
    keys = [rng.integers(0 if d > 1 else 1, 6, n).astype(np.uint64) for d in range(depth)]
    keys.append(np.where(keys[2] == 0, 0, rng.integers(0, 4, n)).astype(np.uint64))
    weight = rng.integers(1, 4, n)
    got = C.multikey_sort(keys, weight, 6)
    for d in range(4):
        want = Counter()
        for i in range(n):
            p = tuple(int(k[i]) for k in keys[:d + 1])
            if 0 not in p:
                want[p] += int(weight[i])
        assert {tuple(int(k[i]) for k in keys[:d + 1]): int(t) for i, t in zip(*got[d])} == {p: c for p, c in want.items() if c >= 6}


def test_bit_table_holds_every_hash(spark):
    rng = np.random.default_rng(8)
    h = rng.integers(-2 ** 63, 2 ** 63, 3000)
    bits = C.bit_table(spark.createDataFrame([(int(x),) for x in h], "w bigint"), "w")
    assert len(bits) == 1 << (C.BITS - 3) and C.in_table(np.frombuffer(bits, np.uint8), h.view(np.uint64)).all()
    other = rng.integers(0, 2 ** 63, 20000).astype(np.uint64)
    assert C.in_table(np.frombuffer(bits, np.uint8), other).mean() < 0.001


def test_routes_grow_with_the_corpus(spark, monkeypatch):
    """What a task sorts at once follows ROUTE, not the size of the corpus."""
    assert C.routes(None, 8) == 8 and C.routes(100 * C.ROUTE + 1, 8) == 101
    rows = [row(i, " ".join(f"w{(i * j) % 7}" for j in range(30))) for i in range(40)]
    few = sorted(map(tuple, C.collocations(documents(spark, rows)).collect()))
    monkeypatch.setattr(C, "ROUTE", 20)                      # 60 routes
    assert sorted(map(tuple, C.collocations(documents(spark, rows)).collect())) == few and few
