"""Benchmark decontamination: edit distance through the CGK embedding.

A document is contaminated by an item if some run of its words is within
``k = floor(rate * item words)`` word edits of the item (A-Z lower-cased;
``k`` is lowered for items under 8 words so that a shared 3-gram is certain).

1. Seeds: an item within k edits shares at least ``L - 2 - 3k`` of its word
   3-grams.  A bit table of fixed size marks the benchmark's 3-grams; documents
   keep only the regions around marked 3-grams.  This loses nothing.
2. Windows: a shared 3-gram fixes a diagonal, hence an item-sized window.
   Windows of (region, item) pairs with enough shared 3-grams go on.
3. CGK: a random walk embeds the words of a window and of the item in 3L steps,
   so that few edits become few Hamming differences.  Repeated bit sampling
   (``samples`` coordinates, as many repetitions as ``recall`` asks for at
   ``agree``, the share of equal coordinates assumed at k edits) gives keys;
   windows meet their item where any key is equal.
4. Exact: the pairs that met are checked by bit-parallel edit distance against
   the region, free at both ends of the window.

Result of ``contamination``: one row per (doc_id, item_id) with the least edit
distance.  Null, empty or short texts simply hold no match; items without words
are ignored; repeated documents or items give one row per pair of ids; null ids
are kept as ids of their own; extra columns play no part; empty tables give an
empty result.  A passage in a third of all documents costs linear work: no
documents are compared with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import arrays as A
from murmura.llm.tables import written

RATE = 0.2
Q = 3
RECALL, AGREE, SAMPLES, WALKS = 0.99, 0.35, 2, 4
TABLE_BITS = 26
U = np.uint64


def allowed(n_words: int, rate: float) -> int:
    """Word edits allowed for an item: a 3-gram is certain to survive."""
    return max(0, min(int(rate * n_words), (n_words - 3) // 3))


def repetitions(recall: float, agree: float, samples: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree ** samples)))


# ------------------------------------------------------------- CGK and keys

def cgk(words: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of the rows of an (m, L) matrix of word hashes: 3L steps,
    each writes the current word and moves on by a random bit of (step, word)."""
    m, n = words.shape
    padded = np.concatenate([words, np.zeros((m, 1), np.uint64)], axis=1)
    at, rows = np.zeros(m, np.int64), np.arange(m)
    out = np.empty((m, 3 * n), np.uint64)
    steps = np.random.default_rng([977, walk]).integers(1, 2 ** 63, 3 * n, dtype=np.uint64)
    for j in range(3 * n):
        c = padded[rows, at]
        out[:, j] = c
        at = np.minimum(at + (A.mix(c ^ steps[j]) & U(1)).astype(np.int64), n)
    return out


def lsh_keys(words: np.ndarray, reps: int, samples: int = SAMPLES, walks: int = WALKS) -> np.ndarray:
    """(m, reps) bit-sampling keys of the embeddings; the walks take turns."""
    m, n = words.shape
    emb = [cgk(words, w) for w in range(min(walks, reps))]
    keys = np.empty((m, reps), np.uint64)
    for r in range(reps):
        e = emb[r % len(emb)]
        # the walk reaches the item's end after about 2L steps: sample before it
        cols = np.random.default_rng([978, r]).integers(0, max(1, 2 * n - 1), samples)
        h = np.full(m, U(r + 1), np.uint64)
        for c in cols:
            h = A.mix(h * U(0x100000001B3) + e[:, c])
        keys[:, r] = h
    return keys


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance, end) of the item against any run of the text."""
    n = len(item)
    ones, top = (1 << n) - 1, 1 << (n - 1)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score = ones, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | ~(xv | ph) & ones, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


# ---------------------------------------------------------------- the steps

def _words(batch, col="_text"):
    data, offs = A.text_buffer(batch[col])
    s, e, rows = A.word_spans(data, offs)
    return A.span_hashes(data, s, e), rows, len(offs) - 1


def item_table(items: DataFrame, id_col: str, text_col: str, rate: float, reps: int) -> DataFrame:
    """(item, n, k, words, seeds, keys) of every item with words."""
    def run(b):
        words, rows, m = _words(b)
        cut = np.searchsorted(rows, np.arange(m + 1))
        ids = A.id_array(b["_id"])
        out = {c: [] for c in ("item", "n", "k", "words", "seeds", "keys")}
        for r in range(m):
            w = words[cut[r]:cut[r + 1]]
            if len(w):
                q = min(Q, len(w))
                g, _ = A.ngram_hashes(w, np.zeros(len(w), np.int64), q)
                out["item"].append(int(ids[r]))
                out["n"].append(len(w))
                out["k"].append(allowed(len(w), rate))
                out["words"].append(A.pack(w))
                out["seeds"].append(g.view(np.int64).tolist())
                out["keys"].append(lsh_keys(w[None, :], reps)[0].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["item"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["k"], pa.int32()),
             pa.array(out["words"], pa.binary()), pa.array(out["seeds"], pa.list_(pa.int64())),
             pa.array(out["keys"], pa.list_(pa.int64()))], list(out))
    d = items.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)).alias("_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return A.map_arrow(d, run, "item bigint, n int, k int, words binary, seeds array<bigint>, keys array<bigint>")


def seed_bits(items: DataFrame) -> np.ndarray:
    """Fixed-size bit table of the items' seeds (at most 2**TABLE_BITS / 64 rows
    of 64 bits reach the driver, whatever the benchmark's size)."""
    p = F.pmod(F.col("seed"), F.lit(1 << TABLE_BITS))
    rows = (items.select(F.explode("seeds").alias("seed"))
            .groupBy(F.floor(p / 64).cast("int").alias("at"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {1 << TABLE_BITS}L) % 64 as int))")).alias("bits")).collect())
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for r in rows:
        table[r["at"]] = r["bits"]
    return table.view(np.uint64)


def regions(docs: DataFrame, bits, longest: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, rid, words, seeds, at): runs of words around marked 3-grams, with
    room for the longest item on both sides.  Runs with fewer marks than any
    item needs are dropped."""
    def run(b):
        table = np.frombuffer(bits.value, np.uint64)
        ids = A.id_array(b["_id"])
        data, offs = A.text_buffer(b["_text"])
        out = {c: [] for c in ("doc", "rid", "words", "seeds", "at")}
        for i, j in A.slabs(offs, 2 << 20):
            part, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            s, e, rows = A.word_spans(part, o)
            words = A.span_hashes(part, s, e)
            if not len(words):
                continue
            first = np.searchsorted(rows, np.arange(j - i + 1))
            marks, grams = [], []
            for q in range(1, Q + 1):
                n = len(words) - q + 1
                if n <= 0:
                    continue
                at = np.flatnonzero(rows[q - 1:] == rows[:n])
                g, _ = A.ngram_hashes(words, rows, q)
                p = g.view(np.int64) % (1 << TABLE_BITS)
                hit = (table[p >> 6] >> (p & 63).astype(np.uint64)) & U(1) == 1
                marks.append(at[hit])
                grams.append(g[hit])
            at, g = np.concatenate(marks), np.concatenate(grams)
            order = np.argsort(at, kind="stable")
            at, g = at[order], g[order]
            if not len(at):
                continue
            new = np.concatenate([[True], (np.diff(at) > longest) | (rows[at[1:]] != rows[at[:-1]])])
            starts = np.flatnonzero(new)
            for a, z in zip(starts, np.concatenate([starts[1:], [len(at)]])):
                if z - a < least:
                    continue
                row = rows[at[a]]
                lo = max(int(first[row]), int(at[a]) - longest)
                hi = min(int(first[row + 1]), int(at[z - 1]) + Q + longest)
                out["doc"].append(int(ids[i + row]))
                out["rid"].append(f"{i + row}:{lo - int(first[row])}")
                out["words"].append(A.pack(words[lo:hi]))
                out["seeds"].append(g[a:z].view(np.int64).tolist())
                out["at"].append((at[a:z] - lo).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc"], pa.int64()), pa.array(out["rid"], pa.string()), pa.array(out["words"], pa.binary()),
             pa.array(out["seeds"], pa.list_(pa.int64())), pa.array(out["at"], pa.list_(pa.int32()))], list(out))
    d = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)).alias("_id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    r = A.map_arrow(d, run, "doc bigint, rid string, words binary, seeds array<bigint>, at array<int>")
    return r.withColumn("rid", F.xxhash64("doc", "words"))


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edit_distance, item_words) of every contaminated pair."""
    spark = docs.sparkSession
    reps = repetitions(recall, AGREE, SAMPLES)
    items = written(item_table(benchmark, item_col, item_text, rate, reps), "bench-items")
    longest, least = items.agg(F.max(F.col("n") + F.col("k")), F.min(F.greatest(
        F.lit(1), F.col("n") - 2 - 3 * F.col("k")))).first()
    bits = spark.sparkContext.broadcast(seed_bits(items).tobytes())
    found = written(regions(docs, bits, longest or 1, least or 1, id_col, text_col)
                    .dropDuplicates(["doc", "rid"]), "bench-regions")

    marks = found.select("doc", "rid", F.explode(F.arrays_zip("seeds", "at")).alias("m")).select(
        "doc", "rid", F.col("m.seeds").alias("seed"), F.col("m.at").alias("at"))
    seeds = items.select("item", "n", "k", F.posexplode("seeds").alias("q", "seed"))
    need = F.greatest(F.lit(1), F.col("n") - 2 - 3 * F.col("k"))
    pairs = (marks.join(seeds, "seed")
             .groupBy("doc", "rid", "item", "n", "k")
             .agg(F.size(F.collect_set("q")).alias("shared"), F.collect_set(F.col("at") - F.col("q")).alias("starts"))
             .where(F.col("shared") >= need).drop("shared"))

    def sign(b):                                       # keys of every window of a pair
        out = {c: [] for c in ("doc", "rid", "item", "start", "rep", "key")}
        cols = [b[c].to_pylist() for c in ("doc", "rid", "item", "n", "starts", "words")]
        by_len: dict[int, list] = {}
        for doc, rid, item, n, starts, words in zip(*cols):
            w = np.frombuffer(words, np.uint64)
            for s in starts:
                a = max(0, min(s, len(w) - n))
                win = w[a:a + n]
                if len(win) < n:
                    win = np.concatenate([win, np.zeros(n - len(win), np.uint64)])
                by_len.setdefault(n, []).append((doc, rid, item, a, win))
        for n, rows in by_len.items():
            for at in range(0, len(rows), 4096):
                some = rows[at:at + 4096]
                keys = lsh_keys(np.stack([r[4] for r in some]), reps).view(np.int64)
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r[c] for r in some], reps), pa.int64()) for c in range(3)]
                    + [pa.array(np.repeat([r[3] for r in some], reps), pa.int32()),
                       pa.array(np.tile(np.arange(reps, dtype=np.int32), k)), pa.array(keys.reshape(-1))], list(out))

    windows = (pairs.join(found.select("doc", "rid", "words"), ["doc", "rid"])
               .mapInArrow(lambda it: (x for b in it for x in sign(b)),
                           "doc bigint, rid bigint, item bigint, start int, rep int, key bigint"))
    item_keys = items.select("item", F.posexplode("keys").alias("rep", "key"))
    met = windows.join(item_keys, ["item", "rep", "key"]).select("doc", "rid", "item", "start").distinct()

    def check(b):
        out = {c: [] for c in ("doc", "item", "d", "n")}
        cols = [b[c].to_pylist() for c in ("doc", "item", "start", "n", "k", "iw", "words")]
        for doc, item, start, n, k, iw, words in zip(*cols):
            w = np.frombuffer(words, np.uint64)[max(0, start - 2 * k):start + n + 2 * k]
            d, _ = best_match(np.frombuffer(iw, np.uint64).tolist(), w.tolist())
            if d <= k:
                for c, v in zip(out, (doc, item, d, n)):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    to_check = (met.join(found.select("doc", "rid", "words"), ["doc", "rid"])
                .join(items.select("item", "n", "k", F.col("words").alias("iw")), "item"))
    hits = A.map_arrow(to_check, check, "doc bigint, item bigint, d bigint, n bigint")
    null = lambda c: F.when(F.col(c) != A.NULL_ID, F.col(c))
    return (hits.groupBy("doc", "item").agg(F.min("d").alias("edit_distance"), F.max("n").alias("item_words"))
            .select(null("doc").alias("doc_id"), null("item").alias("item_id"), "edit_distance", "item_words"))
