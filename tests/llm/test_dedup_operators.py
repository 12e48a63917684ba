"""Jaccard join, substring and line de-duplication, decontamination: brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, awkward, documents, prose, row, words

from murmura.llm import decontam as D
from murmura.llm import ngram_join as J
from murmura.llm.components import components
from murmura.llm.line_dedup import LineIndex, dedup_lines
from murmura.llm.suffix_dedup import dedup_substrings, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NULL = -(2 ** 63)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, roots=False):
    """Component (smallest id) of every row, or the number of components, by
    comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    ids = [NULL if r[0] is None else r[0] for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i in range(len(rows)):
        first[find(i)] = min(first.get(find(i), ids[i]), ids[i])
    if roots:
        return len({find(i) for i in range(len(rows)) if sets[i]})
    return sorted((ids[i], len(sets[i]), first[find(i)]) for i in range(len(rows)))


def chain(rng, n=60, length=120):
    """Copies of copies: neighbours link, the ends do not; and two families that
    nearly link."""
    w = prose(rng, length).split(" ")
    out = []
    for k in range(n):
        w = list(w)
        w[rng.randrange(len(w))] = f"w{k}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = awkward(seed) + [row(200 + k, t) for k, t in enumerate(chain(rng))]
    rows = [r for r in rows if r[0] != 70]                            # all pairs of the long text take too long here
    got = sorted((NULL if r.doc_id is None else r.doc_id, r.n_shingles, NULL if r.component_id is None else r.component_id)
                 for r in J.jaccard_components(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_jaccard_small_blocks_and_leaves(spark, monkeypatch):
    """The residual trees with many blocks give the same components."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "FIRST", 1)
    rows = [row(k, t) for k, t in enumerate(chain(random.Random(9), 80, 60))]
    got = sorted(tuple(r) for r in J.jaccard_components(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (12, 64))
    pts = np.maximum(0, base[rng.integers(0, 12, 300)] + rng.integers(-1, 2, (300, 64))).astype(np.uint32)
    n, comp = pts.sum(1).astype(np.int64), rng.integers(0, 40, 300)
    want = {(i, j) for i in range(300) for j in range(i) if comp[i] != comp[j]
            and np.minimum(pts[i], pts[j]).sum() >= J.least_overlap(n[i], n[j])}
    a = np.arange(300)
    for got in ([x for x in J.tree_pairs(pts, n, comp, a, None, 75)],
                [x for s, t in ((a[:100], None), (a[100:], None), (a[:100], a[100:])) for x in J.tree_pairs(pts, n, comp, s, t, 75)]):
        pairs = [(max(i, j), min(i, j)) for x, y, _ in got for i, j in zip(x.tolist(), y.tolist())]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_keep_one_of_each_group(spark):
    rows = [r for r in awkward() if r[0] != 70]
    df = documents(spark, rows)
    kept = J.keep_one(df).collect()
    assert J.keep_one(df).columns == df.columns
    # one row of every group; every empty text (told apart by id and text) is a group
    empty = {(r[0], r[1] or "") for r in rows if not shingles(r[1])}
    assert len(kept) == brute_components(rows, roots=True) + len(empty)
    assert {NULL if r.doc_id is None else r.doc_id for r in kept} == {c for _, _, c in brute_components(rows)}
    assert J.keep_one(df.limit(0)).count() == 0 and J.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(60, 60), (61, 62), (62, 61)]
    rng.shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 30)}, 61: 61, 62: 61}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -------------------------------------------------------------- substrings

def brute_substrings(rows, length):
    first = {}
    for i, t in sorted(((NULL if r[0] is None else r[0], r[1] or "") for r in rows)):
        b = t.encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], i)
    out = []
    for r in rows:
        i, b = NULL if r[0] is None else r[0], (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,mer", [(50, 20), (24, 8)])
def test_substrings_against_brute_force(spark, length, mer):
    rows = awkward(8) + [row(500 + k, "ab" * (30 + k) + "xy" * k) for k in range(6)] + [row(3, "another text of the same id " * 4)]
    got = dedup_substrings(documents(spark, rows), length, mer).collect()
    assert sorted((NULL if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
                  for r in got) == brute_substrings(rows, length)
    assert dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(1, 4, rng.integers(0, 60)).astype(np.int64)
        assert suffix_array(s, 10 ** 6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        some = [s[i:i + 7].tolist() for i in suffix_array(s, 7)]
        assert some == sorted(some)


# ------------------------------------------------------------------- lines

def brute_lines(rows, min_chars=20, min_docs=3):
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders.setdefault(key(line), set()).add(NULL if r[0] is None else r[0])
    out = []
    for r in rows:
        i, lines = NULL if r[0] is None else r[0], (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows():
    rng = random.Random(11)
    shared = [prose(rng, 8) for _ in range(6)] + ["é" * 19, "é" * 20, "short line"]
    rows = awkward(11)
    for k in range(40):
        lines = [rng.choice(shared) if rng.random() < 0.6 else prose(rng, 6) for _ in range(rng.randint(1, 9))]
        rows.append(row(600 + k, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice([x, x.upper()]) + rng.choice(["", " ", "\r"]) for x in lines)))
    return rows


@pytest.mark.parametrize("hot", [4096, 0])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    from murmura.llm import line_dedup
    monkeypatch.setattr(line_dedup, "HOT", hot)                       # 0: every line goes through the shards
    rows = line_rows()
    got = dedup_lines(documents(spark, rows), shard_keys=4).collect()
    assert sorted((NULL if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows)
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2 ** 63, 5000, dtype=np.uint64))
    idx = LineIndex.from_bytes(LineIndex.build(keys, np.arange(len(keys)) + 1, np.arange(len(keys)) * 3).to_bytes())
    assert sorted(idx.slots(keys).tolist()) == list(range(len(keys)))
    n, last = idx.probe(keys)
    assert n.tolist() == list(range(1, len(keys) + 1)) and (last == np.arange(len(keys)) * 3).all()
    other = np.setdiff1d(rng.integers(0, 2 ** 63, 5000, dtype=np.uint64), keys)
    assert idx.probe(other)[0].sum() == 0
    z = np.empty(0, np.int64)
    assert LineIndex.from_bytes(LineIndex.build(z.view(np.uint64), z, z).to_bytes()).probe(keys[:3])[0].tolist() == [0, 0, 0]


# --------------------------------------------------------- decontamination

def edit(a, b):
    """Least edit distance of a against any run of b."""
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_best_match_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        assert D.best_match(a, b)[0] == edit(a, b)


def test_cgk_keeps_small_edits_close():
    rng = np.random.default_rng(6)
    w = rng.integers(1, 2 ** 62, (200, 40), dtype=np.uint64)
    near = w.copy()
    near[:, 10:-1] = w[:, 11:]                                        # one deletion
    far = rng.integers(1, 2 ** 62, (200, 40), dtype=np.uint64)
    share = lambda x: (D.cgk(w, 0) == D.cgk(x, 0))[:, :60].mean()
    assert share(w) == 1.0 and share(near) > 0.6 and share(far) < 0.05


def test_contamination_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in WORDS_A for b in ("", "x", "yo")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 45, 12, 8, 60, 5, 2, 1])] + [(20, None), (21, ""), (None, say(25)), (0, items_text(rng, vocab))]
    rows = [r for r in awkward(7) if r[0] != 70]
    for k in range(40):
        i, t = rng.choice(items[:5] + items[10:11])
        w = t.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 6, len(w) // 3])):
            p, kind = rng.randrange(len(w)), rng.randint(0, 2)
            w[p:p + 1] = [["zz"], [], [w[p], "yy"]][kind] or []
            w = w or ["q"]
        rows.append(row(700 + k, say(rng.randint(0, 80)) + " " + " ".join(w).upper() + "\n" + say(rng.randint(0, 80))))
    got = {(r.doc_id, r.item_id): r.edit_distance for r in
           D.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for r in rows:
        for i, t in items:
            a, b = words((t or "").translate(LOWER)), words((r[1] or "").translate(LOWER))
            k = D.allowed(len(a), D.RATE)
            if a and edit(a, b) <= k:
                want[(r[0], i)] = min(want.get((r[0], i), 99), edit(a, b))
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(got[p] == want[p] for p in got if p[1] != 0)
    assert all(p in got for p, d in want.items() if d == 0)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contamination(documents(spark, rows), empty).count() == 0
    assert D.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


WORDS_A = "ka lo mi nu pe ro sa ti vu we zo ba de fi go hu".split()


def items_text(rng, vocab):
    return " ".join(rng.choice(vocab) for _ in range(33))


# ------------------------------------------------------ crowded minimisers

def crowded_rows(n=1400):
    """Unlike documents around one passage: the slices at its edges are all
    different and share their route."""
    rng = random.Random(21)
    passage = prose(rng, 45)[:300]
    own = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(80))
    return [row(k if k % 7 else None, own() + passage + own()) for k in range(n)] + [row(5, own() + passage)]


def test_substrings_of_a_crowded_passage(spark, monkeypatch):
    from murmura.llm import arrays as A
    from murmura.llm import suffix_dedup as S
    rows = crowded_rows()
    seen = []
    marks = S.marks_of
    monkeypatch.setattr(S, "marks_of", lambda some, *a: seen.append((some, a)) or marks(some, *a))
    got = S.dedup_substrings(documents(spark, rows)).collect()
    assert sorted((NULL if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
                  for r in got) == brute_substrings(rows, 50)
    some, args = seen[0]
    found = S.sent(some, *args).collect()
    routes = [A.unplanes(r.routes, 8) for r in found if r.kind == S.SLICES]
    asked = [A.unplanes(r.routes, 8) for r in found if r.kind == S.ASKED]
    most = max((np.unique(np.concatenate(routes), return_counts=True)[1].max() if routes else 0), 0)
    assert most <= S.CROWD * 8                         # no route grows with the documents
    assert np.unique(np.concatenate(asked), return_counts=True)[1].max() <= len(found)


# ------------------------------------------------------------ sets of nodes

def test_sets_hold_a_routed_node_once(spark, monkeypatch):
    """Copies of a routed text that stand in the bit table by chance, and rows
    that repeat id and text, add no rows."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(J, "TABLE_BITS", 16)
    rng = random.Random(31)
    rows = [row(k, prose(rng, 12)) for k in range(400)]
    rows += [row(1000 + k, rows[0][1]) for k in range(3000)] + [row(0, rows[0][1])] * 5
    d = J._cols(documents(spark, rows), "doc_id", "text")
    nodes = (J.scan_nodes(d, 5, 75, 8).where("doc is not null").groupBy("node")
             .agg(F.min(F.struct("doc", "tk")).alias("r")).selectExpr("node", "r.doc as rep", "r.tk as rep_tk"))
    got = [r.node for r in J.node_sets(d, nodes, 5).collect()]
    assert len(got) == len(set(got)) == nodes.count() == 400
