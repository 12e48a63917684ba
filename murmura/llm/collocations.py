"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces and words; every word position is a suffix of its
piece.  Words are 64-bit hashes of (language, word), so phrases of different
languages never meet.

1. Words are counted (combined per text piece, then by Spark).  Words under the
   least count cannot stand in a phrase: a bit table of the others, of fixed
   size, goes to every task (a chance hit only lets a suffix live longer).
2. Suffixes are routed globally by their two leading words, over so many routes
   that one holds some ROUTE positions whatever the corpus.  Equal suffixes of a
   task step go as one pointer with a weight, so a very frequent pair sends its
   distinct continuations, not its occurrences.
3. A task sorts the pointers of its routes by multikey three-way quicksort: each
   open partition splits at a pivot word into less, equal and greater; the equal
   part goes one word deeper.  All partitions of a level are split at once by
   vector operations.  An equal partition at depth d is a phrase of d words and
   its weight is the phrase's count; partitions whose weight is under the least
   count are abandoned.
4. Counts of the parts come from joins on word and phrase hashes; scores are
   exact decimals.  Words of the ranked phrases (ties at the cut included) get
   their spelling by one more pass over the texts.

Scores are ``floor(1000000 * a * a / (l * r))`` over the cut that scores least;
exact for counts up to 10^15.  A candidate goes when a longer one that contains
it has at least ``cover`` percent of its count.

Null texts are empty; a null language is ``und``; an empty table gives an empty
result; repeated rows count as often as they stand there.  Other columns are
ignored.  Two different words of a language share a hash with probability
2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.arrays import U, map_arrow, mix, pack, span_hashes, text_buffer
from murmura.llm.tables import parts_of, written

LEAST, LONGEST, COVER, TOP = 10, 3, 50, 2000
ROUTE = 1 << 20                # word positions of a route, on average: some 200 MB while they are sorted
BITS = 26                      # log2 of the bits of a membership table (8 MB)

_GAP, _HARD = 1, 2             # space and tab; marks that end a piece
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = _GAP
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = _HARD


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, and whether the next word stands in the
    same piece."""
    if len(data) == 0:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, bool)
    kind = _KIND[data]
    w = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(w & (~np.concatenate([[False], w[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(w & (~np.concatenate([w[1:], [False]]) | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    hard = np.concatenate([[0], np.cumsum(kind == _HARD, dtype=np.int32)])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (rows[1:] == rows[:-1]) & (hard[starts[1:]] == hard[ends[:-1]])
    return starts, ends, rows, joined


def _words(batch: pa.RecordBatch) -> tuple:
    """Hash of (language, word) of every word of a batch, with its spans."""
    data, offsets = text_buffer(batch["text"])
    starts, ends, rows, joined = spans(data, offsets)
    lang = batch["lang"].dictionary_encode()
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in lang.dictionary.to_pylist()], np.uint64)
    salt = salt[lang.indices.to_numpy()]
    h = mix(span_hashes(data, starts, ends) ^ mix(salt)[rows])
    return h, data, starts, ends, rows, joined


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) of every hashed word."""
    def count(batch):
        h, _, _, _, rows, _ = _words(batch)
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({"word": u.view(np.int64), "n": n, "lang": batch["lang"].take(pa.array(rows[first]))})

    per_step = map_arrow(docs, count, "word bigint, n bigint, lang string", "text")
    return per_step.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def bit_table(df: DataFrame, column: str) -> bytes:
    """A table of 2^BITS bits with the places of all hashes set, built in 64
    parts of at most 2^(BITS - 6) distinct places, so every size is fixed."""
    size = 1 << (BITS - 9)                                # bytes of a part

    def build(t: pa.Table) -> pa.Table:
        bits = np.zeros(size * 8, bool)
        bits[t["place"].to_numpy() & (size * 8 - 1)] = True
        return pa.table({"k": t["k"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    place = F.shiftrightunsigned(F.col(column), 64 - BITS)
    rows = (df.select(place.alias("place")).distinct().withColumn("k", F.shiftright("place", BITS - 6).cast("int"))
            .groupBy("k").applyInArrow(build, "k int, bits binary").collect())
    table = bytearray(size * 64)
    for r in rows:
        table[r["k"] * size:(r["k"] + 1) * size] = r["bits"]
    return bytes(table)


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> U(64 - BITS)
    return (table[(place >> U(3)).astype(np.int64)] >> (U(7) - (place & U(7))).astype(np.uint8)) & 1 == 1


def suffixes(batch: pa.RecordBatch, table: np.ndarray, depth: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Weighted suffix pointers of a batch, packed by route: leading words, then
    up to ``depth - 2`` further ones (0: the piece ends or a rare word stands there)."""
    h, *_, joined = _words(batch)
    fine = in_table(table, h)
    link = joined.copy()
    link[:-1] &= fine[1:]
    link &= fine
    at = np.flatnonzero(link)
    if not len(at):
        return
    keys, alive = [h[at], h[at + 1]], link[at + 1]
    for d in range(2, depth):
        place = np.minimum(at + d, len(h) - 1)
        keys.append(np.where(alive, h[place], U(0)))
        alive = alive & link[place]
    pair = mix(keys[0] * U(31) + keys[1])
    route = pair % U(parts)
    whole = pair
    for k in keys[2:]:
        whole = mix(whole * U(0x100000001B3) + k)
    order = np.lexsort((whole, pair, route))             # equal suffixes of the step: one pointer
    pair, whole, route = pair[order], whole[order], route[order].astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    weight = np.diff(np.append(lead, len(order))).astype(np.uint32)
    pair, route, order = pair[lead], route[lead], order[lead]
    head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))      # each leading pair stands once
    tails = np.diff(np.append(head, len(pair))).astype(np.uint32)
    cut, hcut = np.searchsorted(route, np.arange(parts + 1)), np.searchsorted(route[head], np.arange(parts + 1))
    keys = [k[order] for k in keys]
    lead_keys = [k[head] for k in keys[:2]]
    full = [r for r in range(parts) if cut[r + 1] > cut[r]]
    part = lambda x, c, r: pack(x[c[r]:c[r + 1]])
    yield pa.RecordBatch.from_pydict({
        "route": pa.array(full, pa.int32()),
        "heads": pa.array([b"".join(part(k, hcut, r) for k in lead_keys) for r in full], pa.binary()),
        "tails": pa.array([part(tails, hcut, r) for r in full], pa.binary()),
        "keys": pa.array([b"".join(part(k, cut, r) for k in keys[2:]) for r in full], pa.binary()),
        "weight": pa.array([part(weight, cut, r) for r in full], pa.binary())})


def multikey_sort(keys: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phrases of each depth: [(a pointer of it, its weight)], by three-way
    partitioning of pointers with all partitions of a level split at once.
    Partitions under ``least`` are abandoned; key 0 ends a phrase."""
    found = [[] for _ in keys]
    ptr, part = np.arange(len(weight)), np.zeros(len(weight), np.int64)
    depth = np.zeros(1, np.int64)                         # of each partition
    wide = np.stack(keys, axis=1) if len(weight) else np.empty((0, len(keys)), np.uint64)
    while len(ptr):
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(first, len(ptr)))
        d = depth[part[first]]
        lo, mid, hi = (wide[ptr[first + x], d] for x in (0, size // 2, size - 1))
        pivot = np.maximum(np.minimum(lo, mid), np.minimum(np.maximum(lo, mid), hi))
        nth = np.repeat(np.arange(len(first)), size)
        k, p = wide[ptr, d[nth]], pivot[nth]
        side = nth * 3 + (k >= p) + (k > p)
        total = np.bincount(side, weights=weight[ptr], minlength=3 * len(first))
        new_depth = np.repeat(d, 3)
        new_depth[1::3] += 1
        ended = np.zeros(3 * len(first), bool)
        ended[1::3] = pivot == 0                          # nothing stands here: no phrase
        good = (total >= least) & ~ended
        equal = side % 3 == 1
        lead = np.zeros(len(first), np.int64)
        lead[nth[equal]] = ptr[equal]
        for x in np.unique(d):
            done = np.flatnonzero(good[1::3] & (d == x))
            found[x].append((lead[done], total[1::3][done]))
        good &= new_depth < len(keys)
        live = good[side]
        order = np.argsort(side[live], kind="stable")
        ptr, side = ptr[live][order], side[live][order]
        part, depth = side, new_depth
    return [tuple(np.concatenate(x) for x in zip(*f)) if f else (np.empty(0, np.int64), np.empty(0)) for f in found]


def _phrases(t: pa.Table, depth: int, least: int) -> pa.Table:
    """Phrases of all packed suffixes of one route."""
    keys, weight = [[] for _ in range(depth)], []
    for x in t.select(["heads", "tails", "keys", "weight"]).to_pylist():
        w, tails = np.frombuffer(x["weight"], np.uint32), np.frombuffer(x["tails"], np.uint32)
        for d, k in enumerate(np.frombuffer(x["heads"], np.uint64).reshape(2, -1)):
            keys[d].append(np.repeat(k, tails))
        for d, k in enumerate(np.frombuffer(x["keys"], np.uint64).reshape(depth - 2, len(w))):
            keys[d + 2].append(k)
        weight.append(w)
    keys, weight = [np.concatenate(k) for k in keys], np.concatenate(weight).astype(np.int64)
    out = []
    for d, (ptr, total) in enumerate(multikey_sort(keys, weight, least)):
        if d:                                             # one word alone is no phrase
            flat = np.stack([k[ptr] for k in keys[:d + 1]], axis=1).view(np.int64).reshape(-1)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d + 1), pa.int32()), pa.array(flat))
            out.append(pa.table({"words": rows, "a": total.astype(np.int64)}))
    return pa.concat_tables(out)


def routes(positions: int | None, least: int) -> int:
    """Routes for a corpus of so many words: what a task sorts at once is bounded."""
    return max(least, -(-int(positions or 0) // ROUTE))


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """(words array, a): all phrases of 2 to ``longest`` words with a >= least."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(words.where(F.col("n") >= least), "word"))
    parts = routes(words.agg(F.sum("n")).first()[0], parts_of(docs.sparkSession))

    def send(batch):
        yield from suffixes(batch, np.frombuffer(table.value, np.uint8), longest, parts)

    sent = map_arrow(docs, send, "route int, heads binary, tails binary, keys binary, weight binary", "text")
    return sent.groupBy("route").applyInArrow(lambda t: _phrases(t, longest, least), "words array<bigint>, a bigint")


def spellings(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(word, spelling) of the hashes in ``needed``: one pass over the texts."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(needed, "word"))

    def look(batch):
        h, data, starts, ends, _, _ = _words(batch)
        hit = np.flatnonzero(in_table(np.frombuffer(table.value, np.uint8), h))
        u, first = np.unique(h[hit], return_index=True)
        at = hit[first]
        text = [data[a:b].tobytes().lower().decode("utf-8", "replace") for a, b in zip(starts[at], ends[at])]
        yield pa.RecordBatch.from_pydict({"word": u.view(np.int64), "spelling": pa.array(text, pa.string())})

    return (map_arrow(docs, look, "word bigint, spelling string", "text").dropDuplicates(["word"])
            .join(needed.select("word").distinct(), "word"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    phrases by score descending, count descending, phrase ascending."""
    docs = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                     F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    words = written(word_counts(docs), "coll-words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = written(phrase_counts(docs, words, least, longest), "coll-phrases")
    key = lambda c: F.xxhash64(c)
    size = F.size("words")
    # the strongest longer phrase around each: its own longer forms, one word less at either end
    around = found.select("words", "a").withColumn("sub", F.explode(_parts("words", longest)))
    most = around.groupBy(key("sub").alias("p")).agg(F.max("a").alias("wider"))
    kept = (found.withColumn("p", key("words")).join(most, "p", "left")
            .where(F.col("wider").isNull() | (F.col("wider") * 100 < F.col("a") * F.lit(cover))).drop("wider"))
    # counts of both parts of every cut
    cuts = (kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
            .select("p", "words", "a", "k", key(F.slice("words", F.lit(1), F.col("k"))).alias("left"),
                    key(F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("right")))
    counts = (words.where(F.col("n") >= least).select(key(F.array("word")).alias("part"), F.col("n").alias("c"))
              .unionByName(found.where(size < longest).select(key("words").alias("part"), F.col("a").alias("c"))))
    cuts = (cuts.join(counts.select(F.col("part").alias("left"), F.col("c").alias("l")), "left")
            .join(counts.select(F.col("part").alias("right"), F.col("c").alias("r")), "right"))
    value = F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(30,0)) "
                   "div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    scored = (cuts.withColumn("score", value.cast("bigint")).groupBy("p")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("words").alias("words"), F.first("a").alias("a")))
    lang = words.where(F.col("n") >= least).select(F.col("word").alias("w"), "lang")
    scored = (scored.withColumn("w", F.col("words")[0]).join(lang, "w")
              .select("lang", "words", "a", "best.score", "best.l", "best.r"))
    tied = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    near = written(scored.withColumn("_r", F.rank().over(tied)).where(F.col("_r") <= top).drop("_r")
                   .withColumn("p", key("words")), "coll-ranked")
    needed = near.select(F.explode("words").alias("word"))
    spelled = written(spellings(docs, needed), "coll-spellings")
    phrase = (near.select("p", F.posexplode("words").alias("i", "word")).join(spelled, "word").groupBy("p")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "spelling"))), lambda x: x["spelling"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (near.join(phrase, "p").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _parts(col: str, longest: int):
    """All proper contiguous parts of two words or more of an array of words."""
    n = F.size(col)

    def runs(size):
        every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice(col, i, F.lit(size)))
        return F.when(n > size, every).otherwise(F.array())

    return F.flatten(F.array(*[runs(size) for size in range(2, longest)])) if longest > 2 else F.array().cast("array<array<bigint>>")
