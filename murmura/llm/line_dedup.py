"""Line de-duplication with a sharded minimal perfect hash.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  A key of at least ``min_chars`` code points found in at least
``min_docs`` documents loses all its lines except in the largest doc_id that
holds it.

1. Keys become 64-bit hashes; (hash, doc_id) pairs are counted with partial
   aggregates into (hash, documents, largest doc_id).
2. Hashes that reach ``min_docs`` are cut into shards; each shard becomes a
   minimal perfect hash (levels of bit arrays, gamma 2) that indexes three flat
   arrays: 32-bit fingerprints, counts and largest ids.
3. Documents probe the arrays: a task sends, per shard, one packed row of
   (hash, doc_id) to the shard's arrays and gets back the pairs to drop.  Lines
   are never joined.
4. Lines so frequent that they would load one shard are few by counting (a line
   with 1/HOT of all pairs: at most HOT lines), so their own small index is
   broadcast and probed in place.

Two keys are taken for one if their 64-bit hashes agree (2**-64 a pair).
Null or empty text is one empty line.  A null doc_id counts as the smallest.
Rows that repeat a doc_id are one document for the counts and are cleaned one
by one.  Extra columns pass through; ``n_lines`` and ``n_dropped`` replace such
columns of the input; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from murmura.llm import arrays as A
from murmura.llm.tables import own_names, parts_of, written

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 18
HOT = 4096
U = np.uint64


# --------------------------------------------------- minimal perfect hash

def _slot(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    salt = U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (A.mix(keys + salt) % U(m)).astype(np.int64)


class LineIndex:
    """Minimal perfect hash over distinct 64-bit keys with its arrays."""

    def __init__(self, levels, ranks, fps, counts, last):
        self.levels, self.ranks, self.fps, self.counts, self.last = levels, ranks, fps, counts, last

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        levels, left, base = [], keys, 0
        while len(left):
            m = max(64, 2 * len(left))
            at = _slot(left, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        idx = cls(levels, cls._rank(levels), None, None, None)
        where = idx.slots(keys)
        n = len(keys)
        idx.fps, idx.counts, idx.last = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
        idx.fps[where], idx.counts[where], idx.last[where] = keys, counts, last
        return idx

    @staticmethod
    def _rank(levels):
        out, base = [], 0
        for bits in levels:
            words = np.pad(bits, (0, -len(bits) % 64)).reshape(-1, 64).sum(1)
            out.append(base + np.concatenate([[0], np.cumsum(words)]))
            base = int(out[-1][-1])
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Array slot of each key, -1 if surely absent."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            at = _slot(keys[todo], k, len(bits))
            hit = bits[at]
            pos, block = at[hit], at[hit] // 64
            inner = np.zeros(len(pos), np.int64)
            if len(pos):
                padded = np.pad(bits, (0, -len(bits) % 64)).reshape(-1, 64)
                before = np.cumsum(padded, axis=1, dtype=np.int8) - padded
                inner = before[block, pos % 64].astype(np.int64)
            out[todo[hit]] = rank[block] + inner
            todo = todo[~hit]
        return out

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest doc_id) of each key; count 0 if absent."""
        if not len(self.fps):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        s = self.slots(keys)
        ok = (s >= 0) & (self.fps[s] == keys)
        return np.where(ok, self.counts[s], 0), np.where(ok, self.last[s], 0)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.fps)] + [len(b) for b in self.levels], np.int64)
        return b"".join([A.pack(head)] + [np.packbits(b).tobytes() for b in self.levels]
                        + [A.pack(self.fps), A.pack(self.counts), A.pack(self.last)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> LineIndex:
        k, n = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, k, 16)
        at, levels = 16 + 8 * int(k), []
        for m in sizes:
            nb = -(-int(m) // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, nb, at), count=int(m)).astype(bool))
            at += nb
        n = int(n)
        fps = np.frombuffer(raw, np.uint64, n, at)
        counts = np.frombuffer(raw, np.int64, n, at + 8 * n)
        return cls(levels, cls._rank(levels), fps, counts, np.frombuffer(raw, np.int64, n, at + 16 * n))


# ------------------------------------------------------------------- lines

def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Start, end, row, key hash and "long enough" of every line of a batch.
    Lines are split at \\n; a row has at least one line."""
    breaks = np.flatnonzero(data == 10)
    rows_b = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), rows_b])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    nxt = np.concatenate([starts[1:] - 1, [0]])
    last = np.concatenate([rows[1:] != rows[:-1], [True]])
    ends = np.where(last, offsets[rows + 1], nxt)
    word = A._IS_WORD[data]
    pos = np.flatnonzero(word)
    if len(pos):
        a = np.searchsorted(pos, starts)
        b = np.searchsorted(pos, ends) - 1
        some = b >= a
        ks = np.where(some, pos[np.minimum(a, len(pos) - 1)], starts)
        ke = np.where(some, pos[np.maximum(b, 0)] + 1, starts)
    else:
        ks = ke = starts
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long_ = lead[ke] - lead[ks] >= min_chars
    h = np.zeros(len(starts), np.uint64)
    if long_.any():
        h[long_] = A.span_hashes(data, ks[long_], ke[long_])
    return starts, ends, rows, h, long_


def _pairs(batch, min_chars):
    ids = A.id_array(batch["_id"])
    data, offs = A.text_buffer(batch["_text"])
    for i, j in A.slabs(offs, 2 << 20):
        _, _, rows, h, ok = line_keys(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], min_chars)
        order = np.lexsort((h[ok], ids[i:j][rows[ok]]))
        hs, ds = h[ok][order], ids[i:j][rows[ok]][order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) if len(hs) else np.zeros(0, bool)
        yield hs[new], ds[new]


def repeated_lines(d: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h, n, last) of every key found in at least ``min_docs`` documents."""
    def emit(b):
        for h, ids in _pairs(b, min_chars):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], ["h", "doc"])
    pairs = A.map_arrow(d, emit, "h bigint, doc bigint").dropDuplicates(["h", "doc"])
    return (pairs.groupBy("h").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
            .where(F.col("n") >= min_docs))


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, index) rows, one per shard."""
    def build(t: pa.Table) -> pa.Table:
        idx = LineIndex.build(t["h"].to_numpy().view(np.uint64), t["n"].to_numpy(), t["last"].to_numpy())
        return pa.table({"shard": [t["shard"][0].as_py()], "index": [idx.to_bytes()]},
                        schema=pa.schema([("shard", pa.int32()), ("index", pa.binary())]))
    keyed = lines.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(build, "shard int, index binary")


def probe_shards(d: DataFrame, index: DataFrame, hot_keys, shards: int, min_chars: int) -> DataFrame:
    """(doc, h) pairs whose lines go, from packed probes of the shard arrays."""
    def send(b):
        for h, ids in _pairs(b, min_chars):
            cold = ~np.isin(h, hot_keys.value)
            h, ids = h[cold], ids[cold]
            shard = np.mod(h.view(np.int64), shards)          # pmod
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order])) + 1
            groups = [g for g in np.split(order, cut) if len(g)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[g[0]]) for g in groups], pa.int32()),
                 pa.array([A.pack(h[g]) for g in groups], pa.binary()),
                 pa.array([A.pack(ids[g]) for g in groups], pa.binary())], ["shard", "hs", "docs"])

    def answer(probes: pa.Table, idx: pa.Table) -> pa.Table:
        hs, ds = [], []
        if idx.num_rows:
            index_ = LineIndex.from_bytes(idx["index"][0].as_py())
            for hb, db in zip(probes["hs"].to_pylist(), probes["docs"].to_pylist()):
                h, doc = np.frombuffer(hb, np.uint64), np.frombuffer(db, np.int64)
                n, last = index_.probe(h)
                go = (n > 0) & (doc != last)
                hs.append(h[go].view(np.int64))
                ds.append(doc[go])
        z = [np.empty(0, np.int64)]
        return pa.table({"doc": np.concatenate(ds or z), "h": np.concatenate(hs or z)})

    packs = A.map_arrow(d, send, "shard int, hs binary, docs binary")
    return packs.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, "doc bigint, h bigint")


@own_names("id_col", "text_col")
def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``df`` with cleaned texts, ``n_lines`` (before) and ``n_dropped``."""
    spark = df.sparkSession
    d = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)).alias("_id"),
                  F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    lines = written(repeated_lines(d, min_chars, min_docs), "lines")
    n_keys, n_pairs = lines.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = lines.where(F.col("n") * HOT >= F.lit(n_pairs))     # at most HOT rows by counting
    top = [(r["h"], r["n"], r["last"]) for r in hot.collect()]
    hot_h = np.array([r[0] for r in top], np.int64).view(np.uint64)
    hot_index = spark.sparkContext.broadcast(LineIndex.build(
        hot_h, np.array([r[1] for r in top], np.int64), np.array([r[2] for r in top], np.int64)).to_bytes())
    hot_keys = spark.sparkContext.broadcast(hot_h)
    shards = max(parts_of(spark), -(-n_keys // shard_keys))   # probes load the shards too
    index = build_shards(lines.where(F.col("n") * HOT < F.lit(n_pairs)), shards)
    gone = (probe_shards(d, index, hot_keys, shards, min_chars)
            .groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("h").alias("_gone")))

    names = [f for f in df.schema.fields if f.name not in ("n_lines", "n_dropped")]
    keep = [F.col(f"`{f.name}`") for f in names]
    at_text = [f.name for f in names].index(text_col)
    full = (df.select(*keep).withColumn("_id", F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)))
            .join(gone, F.col("_id") == F.col("_doc"), "left").drop("_doc"))
    schema = StructType(names[:at_text] + [StructField(text_col, StringType())] + names[at_text + 1:]
                        + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def clean(b):
        index_ = LineIndex.from_bytes(hot_index.value)
        ids = A.id_array(b["_id"])
        data, offs = A.text_buffer(b[text_col].cast(pa.string()))
        lists = b["_gone"].to_pylist()
        texts, n_lines, n_drop = [], [], []
        for i, j in A.slabs(offs, 2 << 20):
            part, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            s, e, rows, h, ok = line_keys(part, o, min_chars)
            n, last = index_.probe(h)
            go = ok & (n > 0) & (last != ids[i:j][rows])
            cut = np.searchsorted(rows, np.arange(j - i + 1))
            raw = part.tobytes()
            for r in range(j - i):
                a, z = cut[r], cut[r + 1]
                out = go[a:z]
                if lists[i + r]:
                    out = out | (ok[a:z] & np.isin(h[a:z].view(np.int64), lists[i + r]))
                n_lines.append(z - a)
                n_drop.append(int(out.sum()))
                if n_drop[-1]:
                    texts.append(b"\n".join(raw[s[k]:e[k]] for k in range(a, z) if not out[k - a]).decode())
                else:
                    texts.append(raw[o[r]:o[r + 1]].decode())
        cols = [b.column(f.name) for f in names]
        cols[at_text] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols + [pa.array(n_lines, pa.int64()), pa.array(n_drop, pa.int64())],
                                         schema.names)

    return A.map_arrow(full, clean, schema, text_col)
