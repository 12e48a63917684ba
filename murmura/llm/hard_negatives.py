"""Hard negatives by slot-decomposed selection.

Scores are integer inner products of vectors scaled to ``floor(256 * x)``.  An
anchor's positives are its ``n_pos`` best rows of the same label; a positive
with score p admits the different-label rows with low * p <= high * score and
score <= p, and the first ``k`` of them are its hard negatives.

All windows of an anchor overlap, so none is searched by itself.  The positives'
scores p1 >= p2 >= ... are the upper limits of disjoint slots (p2, p1],
(p3, p2], ..., [(below the least lower limit), pn].  Every task keeps the top k of each
slot of each anchor; the slots' combined lists, walked from the last to the
first, give the suffix lists: the first k rows at or below p_j are the first k
of slot j followed by the suffix list of slot j + 1.  The lower limit then cuts
the end of that list.

Anchors meet rows on a grid: rows are packed into blocks of ROWS and dealt to
groups of at most GROUP blocks, anchors into blocks of ANCHORS and groups of
GROUP blocks; a task step multiplies one group with the other by numpy, block by
block, and keeps a running top k, so its memory follows the block sizes and
anchors may be as many as they like.

Rows with a null label, id or vector, or a null or non-finite component take no
part.  A shorter vector counts as filled up with zeros (an empty one scores 0).
Ties go to the smaller id.  Rows that share an id are rows of their own, but an
id is an anchor once (by its smallest label and vector), and rows of the
anchor's id are neither its positives nor its negatives.  Sums of products up
to 2**53 run in float64 (exact), up to 2**63 in int64; vectors whose products
could pass 64 bits raise OverflowError.  An empty table gives an empty result.
Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.tables import parts_of, written

ROWS = 4096                    # rows of a packed block
ANCHORS = 1024                 # anchors of a packed block
LOW, HIGH = 80, 100            # a negative scores at least LOW / HIGH of its positive
K, POSITIVES = 5, 5

GROUP = 32                     # blocks of one side of a task step

_BLOCK = "ids binary, labels binary, vectors binary, kind string, limits binary"


def scaled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, q): usable rows with their scaled integer vectors."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.where(v.isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & fine)
            .select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * 256)).cast("array<bigint>").alias("q")))


def _matrix(col: pa.ListArray) -> np.ndarray:
    """Rows of a list column as one matrix, short rows filled up with zeros."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _packer(rows: int):
    """Blocks of at most ``rows`` rows; vectors in the narrowest integer type."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                m = _matrix(part["q"])
                kind = next(k for k in (np.int16, np.int32, np.int64)
                            if m.size == 0 or (m.min() >= np.iinfo(k).min and m.max() <= np.iinfo(k).max))
                limits = _matrix(part["limits"]).tobytes() if "limits" in part.schema.names else b""
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([part["vec_id"].to_numpy().tobytes()], pa.binary()),
                    "labels": pa.array([part["label"].to_numpy().tobytes()], pa.binary()),
                    "vectors": pa.array([m.astype(kind).tobytes()], pa.binary()), "kind": pa.array([np.dtype(kind).name]),
                    "limits": pa.array([limits], pa.binary())})
    return run


def _blocks(t: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, labels, vectors, limits of every packed block."""
    for r in t.to_batches():
        for x in r.to_pylist():
            ids = np.frombuffer(x["ids"], np.int64)
            m = np.frombuffer(x["vectors"], x["kind"]).astype(np.int64)
            lim = np.frombuffer(x["limits"], np.int64)
            yield ids, np.frombuffer(x["labels"], np.int64), m.reshape(len(ids), -1), lim.reshape(len(ids), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 inner products of all rows of ``a`` with all rows of ``b``."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if w == 0:
        return np.zeros((len(a), len(b)), np.int64)
    most = w * max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min())))
    if most >= 2 ** 63:
        raise OverflowError("an inner product may pass 64 bits")
    if most >= 2 ** 53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each owner by score descending, id."""
    order = np.lexsort((ids, -score, owner))
    o = owner[order]
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.empty(0, np.int64)
    nth = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    return order[nth < k]


def _meet(rows: DataFrame, anchors: DataFrame, k: int, slots: int) -> DataFrame:
    """Top k rows of each (anchor, slot) in every task step: without slots rows
    of the anchor's label (slot 0), else rows of other labels in the slots that
    the anchors' packed limits give: falling upper limits, least lower limit."""
    def top(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        sides = list(_blocks(b))
        for a_ids, a_labels, a_vec, limits in _blocks(a):
            held, least = [], np.full((len(a_ids), max(slots, 1)), np.iinfo(np.int64).min)
            for ids, labels, m, _ in sides:
                s = products(a_vec, m)
                fits = (a_ids[:, None] != ids[None, :]) & ((a_labels[:, None] == labels[None, :]) != bool(slots))
                if slots:
                    fits &= (s <= limits[:, :1]) & (s >= limits[:, -1:])
                own, col = np.nonzero(fits)
                got = s[own, col]
                slot = np.zeros(len(got), np.int64) - bool(slots)
                for j in range(slots):
                    slot += got <= limits[own, j]
                good = got >= least[own, slot]
                held.append((own[good], slot[good], got[good], ids[col[good]]))
                own, slot, got, of = (np.concatenate(x) for x in zip(*held))
                keep = best(own * 64 + slot, got, of, k)
                held = [(own[keep], slot[keep], got[keep], of[keep])]
                full = np.bincount(own[keep] * least.shape[1] + slot[keep], minlength=least.size).reshape(least.shape) == k
                low = np.full(least.shape, np.iinfo(np.int64).max)
                np.minimum.at(low, (own[keep], slot[keep]), got[keep])
                least = np.where(full, low, least)
            if held:
                own, slot, got, of = held[0]
                found.append(pa.table({"anchor_id": a_ids[own], "slot": slot.astype(np.int32), "score": got, "vec_id": of}))
        kind = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
        return pa.concat_tables(found) if found else kind.empty_table()

    return (anchors.groupBy("g", "s").cogroup(rows.groupBy("g", "s"))
            .applyInArrow(top, "anchor_id bigint, slot int, score bigint, vec_id bigint"))


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, k: int = K, n_pos: int = POSITIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows (vec_id, label, q) of ``scaled``; ``is_anchor``
    is a condition on those columns."""
    if not 1 <= n_pos <= 32:
        raise ValueError("n_pos must be 1 to 32")
    parts = parts_of(rows.sparkSession)
    rows = written(rows, "hard-rows")
    one = Window.partitionBy("vec_id").orderBy("label", "q")
    anchors = rows.where(is_anchor).withColumn("_n", F.row_number().over(one)).where("_n = 1").select("vec_id", "label", "q")
    nth = F.monotonically_increasing_id()                # a block's number, settled when it is written
    blocks = written(rows.mapInArrow(_packer(ROWS), _BLOCK).withColumn("nth", F.xxhash64(nth)), "hard-blocks")
    n_blocks = blocks.count()
    groups = max(1, min(parts, n_blocks), -(-n_blocks // GROUP))

    def met(side: DataFrame, n_slots: int) -> DataFrame:
        packed = written(side.mapInArrow(_packer(ANCHORS), _BLOCK).withColumn("nth", F.xxhash64(nth)), "hard-anchors")
        supers = max(1, -(-packed.count() // GROUP))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = packed.withColumn("s", F.pmod("nth", F.lit(supers)).cast("int")).withColumn("g", every(groups))
        right = blocks.withColumn("g", F.pmod("nth", F.lit(groups)).cast("int")).withColumn("s", every(supers))
        return _meet(right, left, k if n_slots else n_pos, n_slots)

    near = _first(met(anchors, 0), ["anchor_id"], n_pos)
    positives = written(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                                    F.col("rank").alias("place")), "hard-positives")
    upper = F.sort_array(F.collect_list("positive_score"), asc=False)                   # at most n_pos
    filled = F.concat(upper, F.array_repeat(F.lit(-2 ** 63), F.lit(n_pos) - F.size(upper)))
    least = F.min(F.floor(F.col("positive_score").cast("decimal(20,0)") * low / high) - 1).cast("bigint")
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.concat(filled, F.array(least)).alias("limits"))
    slots = _first(met(anchors.join(limits, "vec_id"), n_pos), ["anchor_id", "slot"], k)
    lists = slots.groupBy("anchor_id", "slot").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("top"))
    by_slot = lists.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "top"))).alias("slots"))
    own = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(
        "place", "positive_id", "positive_score"))).alias("pos")).join(by_slot, "anchor_id")
    # upper limits with equal scores share the last slot of the run, so a suffix starts at its own place
    suffix = lambda j: F.slice(F.flatten(F.filter(F.transform(
        F.sequence(j, F.lit(n_pos - 1)), lambda t: F.try_element_at("slots", t)), lambda x: x.isNotNull())), 1, k)
    window = own.select("anchor_id", "slots", F.explode("pos").alias("p")).select(
        "anchor_id", "p.positive_id", "p.positive_score", suffix(F.col("p.place") - 1).alias("top"))
    return (window.select("anchor_id", "positive_id", "positive_score", F.posexplode("top").alias("rank", "t"))
            .where(F.col("t.negative_score") * F.lit(high) >= F.col("positive_score") * F.lit(low))
            .select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.negative_id", "positive_score",
                    "t.negative_score"))
