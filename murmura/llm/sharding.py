"""Uniform shuffle into shards by a hypergeometric communication matrix.

Rows are dealt to source blocks by a hash of the row, and the target is cut
into chunks of fixed size: ``shards`` shards whose row counts differ by at most
one, each a run of chunks.  A uniformly random permutation sends from block i
to chunk j a number of rows that follows the multivariate hypergeometric
distribution given the block and chunk sizes.  Those counts are drawn exactly:

1. local permutation: rows of a block are ordered by a seeded hash;
2. matrix row: block i draws its counts by walking a binary tree over the
   blocks; the draw at a tree node is seeded by the node, so all blocks see the
   same splits and no matrix is ever held whole;
3. exchange: rows go to their chunks;
4. local permutation again: rows of a chunk are ordered by a second hash, and
   the place in the chunk gives the slot in the shard.

Work per task is bounded by block and chunk size, whatever the keys hold;
only block sizes (one number per block) reach the driver.  Reruns agree.

Rows may have null in any column; repeated rows are dealt one by one.  (Rows
that are alike in every hashed column may swap places, which changes nothing.)
Columns ``shard`` and ``slot`` are added, replacing such columns of the input;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from murmura.llm.tables import own_names

BLOCK_ROWS = 1 << 16           # aim for the rows of a block and of a chunk


LIMIT = 10 ** 9                # numpy draws from urns up to this size


def split(rng: np.random.Generator, colours: np.ndarray, take: int) -> np.ndarray:
    """Counts by colour of ``take`` draws without replacement."""
    if int(colours.sum()) < LIMIT:
        return rng.multivariate_hypergeometric(colours, take, method="marginals")
    out, left = np.zeros(len(colours), np.int64), int(colours.sum())
    for j in range(len(colours)):
        c = int(colours[j])
        left -= c
        out[j] = take if left == 0 else wide_hypergeometric(rng, c, left, take)
        take -= int(out[j])
    return out


def wide_hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """Hypergeometric draw from an urn of any size: inversion over the values
    around the mode that hold all but 1e-16 of the mass, with weights from the
    recurrence of the probabilities (floating-point exact, as numpy's own)."""
    lo, hi = max(0, take - bad), min(good, take)
    total = good + bad
    if total < LIMIT:
        return int(rng.hypergeometric(good, bad, take))
    mode = min(max((take + 1) * (good + 1) // (total + 2), lo), hi)
    sd = (take * (good / total) * (bad / total) * ((total - take) / max(1, total - 1))) ** 0.5
    reach = int(9 * sd) + 60
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))


def matrix_row(block: int, sizes: np.ndarray, chunks: np.ndarray, seed: int) -> np.ndarray:
    """Row ``block`` of the communication matrix."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, urn = 0, len(sizes), chunks.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = split(rng, urn, int(before[mid] - before[lo]))
        lo, hi, urn = (lo, mid, left) if block < mid else (mid, hi, urn - left)
    return urn


def layout(n: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk sizes, the shard of each chunk and its first slot."""
    each = [n // shards + (s < n % shards) for s in range(shards)]
    per = max(1, -(-max(each) // block_rows)) if n else 1
    sizes, owner, first = [], [], []
    for s, m in enumerate(each):
        at = 0
        for c in range(per):
            k = m // per + (c < m % per)
            sizes.append(k)
            owner.append(s)
            first.append(at)
            at += k
    return np.array(sizes, np.int64), np.array(owner, np.int64), np.array(first, np.int64)


@own_names("key_cols")
def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 1, block_rows: int = BLOCK_ROWS,
                      key_cols: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with its ``shard`` and ``slot``.

    ``key_cols`` are the columns whose hash deals rows to blocks (default: all
    of simple type); repeated keys are fine, and a key held by a large share of
    rows is spread by the other columns."""
    names = [f.name for f in df.schema.fields if f.name not in ("shard", "slot")]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    keys = [F.col(f"`{c}`") for c in (key_cols or names)]
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    h = F.xxhash64(F.lit(seed), *keys)
    d = df.withColumn("_h", h).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, np.int64)
    for r in d.groupBy("_block").count().collect():    # one number per block of block_rows rows
        sizes[r[0]] = r[1]
    chunk_sizes, owner, first = layout(n, shards, block_rows)

    mid = StructType(df.schema.fields + [StructField("_h", LongType()), StructField("_chunk", IntegerType())])

    def permute_and_deal(t: pa.Table) -> pa.Table:
        h = t["_h"].to_numpy()
        block = t["_block"][0].as_py()
        order = np.argsort(h, kind="stable")
        row = matrix_row(block, sizes, chunk_sizes, seed)
        # _h also orders the rows inside a block, so the next hash is fresh
        chunk = np.repeat(np.arange(len(row), dtype=np.int32), row)
        fresh = np.random.default_rng([seed, 7, block]).permutation(len(order))
        t = t.take(pa.array(order[fresh]))
        return t.drop_columns(["_block"]).append_column("_chunk", pa.array(chunk))

    done = StructType(df.schema.fields + [StructField("shard", IntegerType()), StructField("slot", LongType())])

    def permute_and_place(t: pa.Table) -> pa.Table:
        c = t["_chunk"][0].as_py()
        h = t["_h"].to_numpy()
        order = np.argsort(h, kind="stable")
        perm = np.random.default_rng([seed, 8, c]).permutation(len(h))
        t = t.take(pa.array(order[perm])).drop_columns(["_h", "_chunk"])
        k = t.num_rows
        return (t.append_column("shard", pa.array(np.full(k, owner[c], np.int32)))
                .append_column("slot", pa.array(first[c] + np.arange(k, dtype=np.int64))))

    dealt = d.groupBy("_block").applyInArrow(permute_and_deal, mid)
    return dealt.groupBy("_chunk").applyInArrow(permute_and_place, done)
