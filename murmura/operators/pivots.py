"""Exact nearest-neighbour join over a pivot-partitioned vector layout.

For query sets too large to broadcast.  The vectors are laid out in Voronoi
cells: a group (a store) with n vectors uses the first ceil(n / CELL) of at most
PIVOTS pivot vectors, each vector goes to its nearest pivot, and a cell keeps its
size and its least and greatest distance to the pivot.  Then

1. every query visits the cells nearest to it that hold k vectors together; the
   k-th distance found there bounds its true k-th distance;
2. the triangle inequality (ring of the cell) and the bisector of two pivots give
   each other cell a least distance to the query; the query is sent to the cells
   whose least distance is not beyond its bound, and to no other.

Both visits are one shuffle each.  Neighbouring cells stand in buckets of some
SPLIT vectors, and a query goes once to a bucket, with the cells it visits there,
so its vector is not copied for every cell.  Buckets and queries meet in a cogroup
on (group, bucket, split of the bucket, part of its queries), so a large cell or
many queries are many task steps of bounded size.  Queries of any number take one
pass.  Pivots (at most PIVOTS vectors) are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIVOTS = 256                 # pivot vectors, and cells of a group at most
CELL = 2048                  # vectors for which a group gets one more cell
SPLIT = 1 << 14              # vectors of a bucket in one task step
QUERIES = 1 << 13            # queries of a bucket in one task step
PLANNED = 1 << 8             # queries planned at once
HELD = 1 << 19               # found pairs that a task step holds


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` numbers as a float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def usable(vec: str, dim: int):
    """Condition: a vector of ``dim`` finite numbers."""
    v = F.col(f"`{vec}`")
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than the rounding error of ``distances``: what a bound must allow."""
    most = max((float(np.abs(x).max()) if x.size else 0.0) for x in (a, b))
    return 1e-6 * (1.0 + most * max(1, a.shape[1]) ** 0.5)


def lay_out(docs: DataFrame, dim: int, pivots: np.ndarray, cell: int = CELL) -> DataFrame:
    """(_g, doc id, _v, _cell, _r): every vector in the cell of its nearest
    pivot among those its group uses."""
    sizes = docs.groupBy("_g").agg(F.count("*").alias("_n"))
    d = docs.join(sizes.withColumnRenamed("_g", "_h"), F.col("_g") == F.col("_h")).drop("_h")
    d = d.withColumn("_use", F.least(F.lit(len(pivots)), F.ceil(F.col("_n") / F.lit(cell))).cast("int")).drop("_n")
    shared = docs.sparkSession.sparkContext.broadcast(pivots)
    kind = T.StructType([f for f in d.schema.fields if f.name != "_use"]
                        + [T.StructField("_cell", T.IntegerType()), T.StructField("_r", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if b.num_rows:
                far = distances(matrix(b["_v"], dim), p)
                far[np.arange(p.shape[0])[None, :] >= b["_use"].to_numpy()[:, None]] = np.inf
                cell = far.argmin(axis=1)
                keep = [c for c in b.schema.names if c != "_use"]
                yield pa.RecordBatch.from_arrays(
                    [b[c] for c in keep] + [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                    names=[*keep, "_cell", "_r"])

    return d.mapInArrow(assign, kind)


def _cells(flat: list) -> tuple[np.ndarray, ...]:
    """Cells of a group: number, size, least and greatest distance to the pivot,
    bucket and its splits."""
    m = np.array(flat, np.float64).reshape(-1, 6)
    number, size, bucket, splits = (m[:, i].astype(np.int64) for i in (0, 1, 4, 5))
    return number, size, m[:, 2], m[:, 3], bucket, splits


def least_distance(to: np.ndarray, between: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of a query to the members of each cell, from its
    distances ``to`` the pivots and those ``between`` the cells' pivots: the ring
    around the cell's pivot, and its bisectors with the other pivots."""
    ring = np.maximum(np.maximum(to[cell] - high, low - to[cell]), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = (to[cell][:, None] ** 2 - to[cell][None, :] ** 2) / (2.0 * between)
    half[~np.isfinite(half) | (between < 1e-5 * (1.0 + to.max()))] = 0.0      # pivots too near to tell apart
    return np.maximum(ring, half.max(axis=1, initial=0.0))


def _planner(shared, dim: int, k: int, first: bool):
    """Queries -> one row for each bucket to visit, with the cells wanted there:
    the nearest cells that hold k vectors together, or (with a bound) the others
    that the bound can't exclude."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in (whole.slice(i, PLANNED) for whole in batches for i in range(0, whole.num_rows, PLANNED)):
            q = matrix(b["_v"], dim)
            to, off = distances(q, p), slack(q, p)
            own, buckets, splits, want = [], [], [], []
            known = {}
            for i, g in enumerate(b["_g"].to_pylist()):
                if g not in known:
                    c = _cells(b["_cells"][i].as_py())
                    known[g] = (*c, distances(p[c[0]], p[c[0]]))
                cell, n, low, high, bucket, cuts, between = known[g]
                order = np.argsort(to[i][cell], kind="stable")
                near = np.zeros(len(cell), bool)
                near[order[:int(np.searchsorted(np.cumsum(n[order]), k)) + 1]] = True
                if not first:
                    theta = b["_theta"][i].as_py()
                    near = ~near & (least_distance(to[i], between, cell, low, high) <= (np.inf if theta is None else theta) + off)
                hit = np.flatnonzero(near)                       # cells, and so buckets, stand in order
                first_of = np.flatnonzero(np.diff(bucket[hit], prepend=-1))
                own += [i] * len(first_of)
                buckets += bucket[hit][first_of].tolist()
                splits += cuts[hit][first_of].tolist()
                want += np.split(cell[hit].astype(np.int32), first_of[1:]) if len(hit) else []
            keep = [c for c in b.schema.names if c != "_cells"]
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b[c].take(at) for c in keep]
                + [pa.array(x, pa.int32()) for x in (buckets, splits)] + [pa.array(want, pa.list_(pa.int32()))],
                names=[*keep, "_bucket", "_splits", "_want"])
    return plan


def _kernel(dim: int, k: int, doc_id: str, kind: pa.Schema):
    """Top k of one split of a bucket for the queries of one part, each in the
    cells it wants."""
    def run(d: pa.Table, q: pa.Table) -> pa.Table:
        from murmura.operators.vectors import _exact_candidates, _first_k
        if not d.num_rows or not q.num_rows:
            return kind.empty_table()
        x, m = matrix(d["_v"], dim), matrix(q["_v"], dim)
        ids = d[doc_id].combine_chunks()
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        theta = q["_theta"].combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False)
        cell = d["_cell"].combine_chunks().to_numpy()
        wanted = q["_want"].combine_chunks()
        asks = np.repeat(np.arange(len(m)), wanted.value_lengths().to_numpy())
        asked = wanted.flatten().to_numpy()
        by_cell, by_want = np.argsort(cell, kind="stable"), np.argsort(asked, kind="stable")
        found, held = [], 0
        for c in np.unique(cell):
            rows = by_cell[np.searchsorted(cell, c, "left", by_cell):np.searchsorted(cell, c, "right", by_cell)]
            mine = asks[by_want[np.searchsorted(asked, c, "left", by_want):np.searchsorted(asked, c, "right", by_want)]]
            for i in range(0, len(mine), 512):
                for j in range(0, len(rows), 8192):
                    r, s = rows[j:j + 8192], mine[i:i + 512]
                    a, b, far = _exact_candidates(x[r], m[s], k, place[r])
                    good = far <= theta[s][a]
                    found.append((s[a[good]], place[r[b[good]]], far[good]))
                    held += len(found[-1][0])
                    if held > HELD:
                        found = [_first_k(*(np.concatenate(f) for f in zip(*found)), k)]
                        held = -(-len(found[0][0]) // 2)        # what stays counts half: room is left to go on
        if not held:
            return kind.empty_table()
        own, at, dist = _first_k(*(np.concatenate(f) for f in zip(*found)), k)
        return pa.Table.from_arrays([q["_q"].take(pa.array(own)), ids.take(pa.array(order[at])), pa.array(dist)], schema=kind)
    return run


def _visit(cells: DataFrame, plan: DataFrame, k: int, dim: int, doc_id: str, doc_type) -> DataFrame:
    """(_q, doc id, _dist): what the planned queries find in their cells."""
    out = T.StructType([T.StructField("_q", T.LongType()), T.StructField(doc_id, doc_type), T.StructField("_dist", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    parts = plan.groupBy("_g", "_bucket").agg(F.count("*").alias("_m"))
    parts = parts.select(F.col("_g").alias("_h"), F.col("_bucket").alias("_c"), F.ceil(F.col("_m") / F.lit(QUERIES)).cast("int").alias("_parts"))
    here = (F.col("_g") == F.col("_h")) & (F.col("_bucket") == F.col("_c"))
    q = plan.join(parts, here).drop("_h", "_c").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int")).drop("_parts")
    q = q.withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)))
    d = cells.join(parts, here).drop("_h", "_c").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    keys = ["_g", "_bucket", "_split", "_part"]
    return (d.select(*keys, doc_id, "_cell", "_v").groupBy(*keys)
            .cogroup(q.select(*keys, "_q", "_v", "_theta", "_want").groupBy(*keys))
            .applyInArrow(_kernel(dim, k, doc_id, to_arrow_schema(out)), out))


def pivot_knn(docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str, doc_vec: str, qid: str, query_vec: str,
              group_cols: Sequence[str] = (), pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """``qid, rank, doc_id, dist``: the k nearest documents of each query id by
    exact L2 distance, ties by ``doc_id``.  Vectors that are null, not finite or
    of another length than the first document's take no part."""
    from murmura.session import work_dir
    spark = docs.sparkSession
    path = work_dir(spark, "pivots")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    out = T.StructType([queries.schema[qid], T.StructField("rank", T.IntegerType()), docs.schema[doc_id], T.StructField("dist", T.DoubleType())])
    some = docs.where(F.col(f"`{doc_vec}`").isNotNull() & (F.size(f"`{doc_vec}`") > 0)).select(F.size(f"`{doc_vec}`").alias("n")).head()
    if some is None:
        return spark.createDataFrame([], out)
    dim = some["n"]
    group = F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}) if group_cols else F.lit("")
    d = docs.where(usable(doc_vec, dim)).select(group.alias("_g"), doc_id, F.col(f"`{doc_vec}`").cast("array<double>").alias("_v"))
    sample = d.orderBy(F.xxhash64("_v"), doc_id).limit(pivots).select("_v").collect()           # PIVOTS vectors
    if not sample:
        return spark.createDataFrame([], out)
    p = np.array([r["_v"] for r in sample])
    shared = spark.sparkContext.broadcast(p)
    cells = keep(lay_out(d, dim, p, cell), "cells")
    stats = cells.groupBy("_g", "_cell").agg(F.count("*").alias("n"), F.min("_r").alias("low"), F.max("_r").alias("high"))
    before = F.sum("n").over(Window.partitionBy("_g").orderBy("_cell")) - F.col("n")
    stats = stats.withColumn("_bucket", F.floor(before / F.lit(SPLIT)).cast("int"))
    together = F.sum("n").over(Window.partitionBy("_g", "_bucket"))
    stats = keep(stats.withColumn("_splits", F.ceil(together / F.lit(SPLIT)).cast("int")), "stats")
    listed = F.array_sort(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("_cell", "n", "low", "high", "_bucket", "_splits")])))
    of_group = keep(stats.groupBy(F.col("_g").alias("_h")).agg(F.flatten(listed).alias("_cells")), "groups")      # at most PIVOTS cells
    split = F.pmod(F.xxhash64(doc_id), F.col("_splits")).cast("int")
    own = stats.select(F.col("_g").alias("_h"), F.col("_cell").alias("_c"), "_bucket", "_splits")
    cells = (cells.join(own, (F.col("_g") == F.col("_h")) & (F.col("_cell") == F.col("_c"))).withColumn("_split", split)
             .drop("_h", "_c", "_splits", "_r"))
    q = keep(queries.where(usable(query_vec, dim)).select(group.alias("_g"), F.col(qid).alias("_qid"), F.col(f"`{query_vec}`").cast("array<double>").alias("_v"))
             .withColumn("_q", F.monotonically_increasing_id()), "queries")
    asked = q.drop("_qid").join(of_group, F.col("_g") == F.col("_h")).drop("_h")
    kind = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField("_q", T.LongType()),
                         T.StructField("_theta", T.DoubleType()), T.StructField("_bucket", T.IntegerType()), T.StructField("_splits", T.IntegerType()),
                         T.StructField("_want", T.ArrayType(T.IntegerType()))])
    cols = ["_g", "_v", "_q", "_theta", "_cells"]
    found = []
    w = Window.partitionBy("_q").orderBy("_dist", doc_id)
    for step in ("near", "rest"):
        if step == "near":
            todo = asked.withColumn("_theta", F.lit(None).cast("double"))
        else:
            bound = found[0].where(F.col("_rank") == k).select(F.col("_q").alias("_p"), F.col("_dist").alias("_theta"))
            todo = asked.join(bound, F.col("_q") == F.col("_p"), "left").drop("_p")
        plan = keep(todo.select(*cols).mapInArrow(_planner(shared, dim, k, step == "near"), kind), f"plan-{step}")
        hits = _visit(cells, plan, k, dim, doc_id, docs.schema[doc_id].dataType)
        found.append(keep(hits.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k), step))
    every = found[0].unionByName(found[1]).join(q.select(F.col("_q").alias("_p"), "_qid"), F.col("_q") == F.col("_p"))
    last = Window.partitionBy("_qid").orderBy("_dist", doc_id)
    return (every.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select(F.col("_qid").alias(qid), "rank", doc_id, F.col("_dist").alias("dist")))
