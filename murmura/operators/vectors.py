"""Exact vector search, centroids and clustering.

Exact k-nearest-neighbour search is O(queries x docs).  The query side is a
small, size-checked set (question variants, cluster centroids); it is shipped
to the executors once as a broadcast numpy matrix and the document side is
streamed through ``mapInPandas`` in Arrow batches (a larger set is joined over
the pivot layout of ``operators.pivots``).  Each task keeps only a
running top-k per query, so a partition emits at most ``k x queries`` rows and
no (query, doc) pair is ever materialised as a row.  The final top-k per query
is a window over those survivors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.text import _c

DEFAULT_MAX_QUERIES = 20_000


def l2_normalize(c) -> Column:
    """x / ||x||_2 element-wise; a zero (or empty) vector stays as it is."""
    v = _c(c)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def _collect_bounded(df: DataFrame, vec: str, max_rows: int):
    """The rows of ``df`` if there are at most ``max_rows`` and their vectors
    take at most MAX_BYTES, else None.  Never fetches more than that."""
    dim = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).head()
    most = min(max_rows, MAX_BYTES // (8 * max(1, dim["n"] if dim else 1)))
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _stack(series: pd.Series, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list column -> (mask of usable rows, float64 matrix).  A row that
    is null, holds a null or a NaN or infinity, or is of another length than the
    others cannot be measured and is left out, alone."""
    ok = series.notna().to_numpy().copy()
    out = [np.asarray(v, dtype=np.float64) for v in series[ok]]
    dim = len(out[0]) if out and dim is None else dim
    fits = np.array([len(v) == dim for v in out], dtype=bool)
    X = np.concatenate([v for v in out if len(v) == dim] or [np.zeros(0)]).reshape(int(fits.sum()), dim or 0)
    finite = np.isfinite(X).all(axis=1)
    fits[fits] = finite
    ok[ok] = fits
    return ok, X[finite]


TILE = 256                   # queries measured at once
PAIRS = 1 << 16              # near pairs re-measured at once
MAX_BYTES = 256 << 20        # vectors that one broadcast may hold


def _exact_candidates(X: np.ndarray, Q: np.ndarray, k: int, ids: np.ndarray | None = None):
    """Exact k nearest rows of X for every row of Q.

    Squared distances come from one BLAS product per tile of queries
    (|x|^2 + |q|^2 - 2 x.q); rows within a small slack of a query's k-th value
    are re-measured with the direct formula sqrt(sum((x-q)^2)), so the selection
    and the distances are exact, not approximate.  Of rows at one distance only
    the k smallest ids are kept, so equal vectors cost k rows, not all of them.
    Returns (query index, row index, distance) arrays.
    """
    n = X.shape[0]
    kk = min(k, n)
    ids = np.arange(n) if ids is None else ids
    at_id = np.argsort(ids, kind="stable")
    by_id = np.argsort(at_id, kind="stable")
    xx = np.einsum("ij,ij->i", X, X)
    cols, rows, dist = [], [], []
    for t in range(0, Q.shape[0], TILE):
        q = Q[t:t + TILE]
        qq = np.einsum("ij,ij->i", q, q)
        d2 = xx[:, None] + qq[None, :] - 2.0 * (X @ q.T)            # (n, tile)
        kth = np.partition(d2, kk - 1, axis=0)[kk - 1] if kk < n else d2.max(axis=0)
        # rounding error of the expansion is ~1e-16 of the magnitudes involved
        slack = 1e-9 * (1.0 + np.abs(kth) + qq + xx.max())
        j, r = np.nonzero((d2 <= (kth + slack)[None, :]).T)
        d = np.empty(len(r))
        for a in range(0, len(r), PAIRS):                           # ties may be many: a bounded number at once
            some = slice(a, a + PAIRS)
            d[some] = np.sqrt(((X[r[some]] - q[j[some]]) ** 2).sum(axis=1))
        if len(r) > kk * len(q):
            best, place, d = _first_k(j, by_id[r], d, kk)
            j, r = best, at_id[place]
        cols.append(j + t)
        rows.append(r)
        dist.append(d)
    z = np.empty(0, np.int64)
    return np.concatenate(cols or [z]), np.concatenate(rows or [z]), np.concatenate(dist or [z.astype(float)])


def _first_k(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int):
    """Keep the k smallest (dist, id) per query value."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    start = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    return q[keep], ids[keep], d[keep]


def knn_topk(docs: DataFrame, queries: DataFrame, k: int, *,
             doc_id: str = "doc_id", doc_vec: str = "embedding",
             qid: str = "qid", query_vec: str = "embedding",
             group_cols: Sequence[str] = (),
             max_queries: int = DEFAULT_MAX_QUERIES) -> DataFrame:
    """k nearest documents per query by exact L2 distance.

    ``group_cols`` restricts each query to documents of the same group (e.g.
    ``user_id, keyword`` of a per-tenant store).  Ties break on ``doc_id``.
    Returns ``qid, rank, doc_id, dist``.
    """
    group_cols = list(group_cols)
    side = queries.select(qid, *group_cols, query_vec)
    rows = _collect_bounded(side, query_vec, max_queries)
    names = dict(doc_id=doc_id, doc_vec=doc_vec, qid=qid, query_vec=query_vec, group_cols=group_cols)
    types = (queries.schema[qid].dataType, docs.schema[doc_id].dataType)
    if rows is None:                         # too many for one broadcast
        from murmura.operators.pivots import pivot_knn
        return pivot_knn(docs, side, k, **names)
    survivors = _survivors(docs, rows, k, types, **names)
    # two merge levels: k rows of each salt, then k rows of the query
    salt = F.pmod(F.xxhash64(doc_id), F.lit(SALTS))
    order = [F.col("dist"), F.col(doc_id)]
    some = (survivors.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(Window.partitionBy(qid, "_salt").orderBy(*order)))
            .where(F.col("_rn") <= k).drop("_rn", "_salt"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)))
            .where(F.col("rank") <= k)
            .select(qid, "rank", doc_id, "dist"))


SALTS = 64                   # parts of a query's survivors that are merged apart first


def _survivors(docs: DataFrame, rows: list, k: int, types, *, doc_id, doc_vec, qid, query_vec, group_cols) -> DataFrame:
    """(qid, doc_id, dist): each task's k nearest documents of every query."""
    by_group: dict[tuple, tuple[list, np.ndarray]] = {}
    for r in rows:
        if r[query_vec] is None or not all(x is not None and np.isfinite(x) for x in r[query_vec]):
            continue
        key = tuple(r[g] for g in group_cols)
        ids, vecs = by_group.setdefault(key, ([], []))
        ids.append(r[qid])
        vecs.append(np.asarray(r[query_vec], dtype=np.float64))
    # queries numbered 0..n-1 across groups; a group maps to (first index, matrix)
    keys_all, packed, start = [], {}, 0
    for key, (ids, vecs) in by_group.items():
        packed[key] = (start, np.stack(vecs))
        keys_all.extend(ids)
        start += len(ids)
    spark = docs.sparkSession
    bc = spark.sparkContext.broadcast((keys_all, packed))
    out_schema = T.StructType([T.StructField(qid, types[0]), T.StructField(doc_id, types[1]),
                               T.StructField("dist", T.DoubleType())])

    def kernel(batches):
        keys, groups = bc.value
        bq = np.empty(0, dtype=np.int64)       # running top-k per query:
        bi = None                              # query index, doc id, distance
        bd = np.empty(0)
        for pdf in batches:
            if group_cols:
                parts = pdf.groupby(group_cols, sort=False, dropna=False).indices.items()
            else:
                parts = [((), np.arange(len(pdf)))]
            for key, idx in parts:
                key = key if isinstance(key, tuple) else (key,)
                hit = groups.get(tuple(key) if group_cols else ())
                if hit is None:
                    continue
                first, qmat = hit
                sub = pdf.iloc[idx]
                ok, X = _stack(sub[doc_vec], qmat.shape[1])
                if X.shape[0] == 0:
                    continue
                ids = sub[doc_id].to_numpy()[ok]
                qi, ri, d = _exact_candidates(X, qmat, k, ids)
                bi = ids[ri] if bi is None else np.concatenate([bi, ids[ri]])
                bq = np.concatenate([bq, qi + first])
                bd = np.concatenate([bd, d])
                bq, bi, bd = _first_k(bq, bi, bd, k)   # bounded: <= k per query
        if bi is not None and len(bq):
            yield pd.DataFrame({qid: [keys[j] for j in bq], doc_id: bi, "dist": bd})

    return docs.select(*group_cols, doc_id, doc_vec).mapInPandas(kernel, out_schema)


def multi_query_topk(docs: DataFrame, variants: DataFrame, k: int, *,
                     parent: str = "parent_qid", variant: str = "variant",
                     doc_id: str = "doc_id", doc_vec: str = "embedding",
                     query_vec: str = "embedding", group_cols: Sequence[str] = (),
                     max_queries: int = DEFAULT_MAX_QUERIES) -> DataFrame:
    """Top-k of every query variant, then the distinct union of documents per
    parent question in first-seen order (variant, then rank).

    Returns ``parent, ord, doc_id, variant, rank, dist``.
    """
    q = variants.withColumn("_qid", F.struct(F.col(parent).alias("p"), F.col(variant).alias("v")))
    hits = knn_topk(docs, q, k, doc_id=doc_id, doc_vec=doc_vec, qid="_qid",
                    query_vec=query_vec, group_cols=group_cols, max_queries=max_queries)
    first = (hits.groupBy(F.col("_qid.p").alias(parent), doc_id)
             .agg(F.min(F.struct(F.col("_qid.v").alias(variant), F.col("rank"), F.col("dist"))).alias("m")))
    w = Window.partitionBy(parent).orderBy(F.col("m." + variant), F.col("m.rank"), F.col(doc_id))
    return first.select(parent, F.row_number().over(w).alias("ord"), doc_id,
                        F.col("m." + variant).alias(variant), F.col("m.rank").alias("rank"),
                        F.col("m.dist").alias("dist"))


def centroids_by(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Per-label mean vector (``label, centroid ARRAY<DOUBLE>``).

    A partial/final hash aggregate over vectors: a skewed label costs one
    running sum per task, not a gathered group.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return (df.where(F.col(vec).isNotNull())
            .select(label, array_to_vector(F.col(vec)).alias("_v"))
            .groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(label, vector_to_array(F.col("_m")).alias("centroid")))


def centroid_assign(vectors: DataFrame, centroids: DataFrame, *, id_col: str = "vec_id",
                    vec: str = "embedding", label: str = "label",
                    centroid: str = "centroid", max_centroids: int = 100_000) -> DataFrame:
    """Nearest centroid of every vector (exact; ties -> smallest label).

    Returns ``id_col, label, dist``.
    """
    side = centroids.select(label, centroid)
    rows = _collect_bounded(side, centroid, max_centroids)
    if rows is None:
        from murmura.operators.pivots import pivot_knn
        near = pivot_knn(side.where(F.col(centroid).isNotNull()), vectors.select(id_col, vec), 1, doc_id=label, doc_vec=centroid,
                         qid=id_col, query_vec=vec)
        return near.select(id_col, label, "dist")
    return _assign(vectors, rows, centroids.schema[label].dataType, id_col, vec, label, centroid)


def _assign(vectors: DataFrame, rows: list, label_type, id_col, vec, label, centroid) -> DataFrame:
    rows = [r for r in rows if r[centroid] is not None]
    labels = np.array([r[label] for r in rows])
    cmat = np.stack([np.asarray(r[centroid], dtype=np.float64) for r in rows]) if rows else np.zeros((0, 0))
    bc = vectors.sparkSession.sparkContext.broadcast((labels, cmat))
    out_schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType),
                               T.StructField(label, label_type),
                               T.StructField("dist", T.DoubleType())])

    def kernel(batches):
        labs, C = bc.value
        for pdf in batches:
            ok, X = _stack(pdf[vec], C.shape[1] or None)
            if X.shape[0] == 0 or len(labs) == 0:
                continue
            # nearest centroid per row = the 1-nearest row of C for each row of X
            # ties: smallest label (sort by row, distance, label)
            lab_rank = np.argsort(np.argsort(labs, kind="stable"), kind="stable")
            ci, ri, d = _exact_candidates(C, X, 1, lab_rank)
            r, c, dd = _first_k(ci, lab_rank[ri], d, 1)
            by_rank = np.empty_like(labs)
            by_rank[lab_rank] = labs
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[ok][r], label: by_rank[c], "dist": dd})

    return vectors.select(id_col, vec).mapInPandas(kernel, out_schema)


def nearest_label(vec, centroids: DataFrame, label: str = "label", centroid: str = "centroid",
                  max_centroids: int = 10_000) -> Column:
    """The label of the nearest centroid as a column (ties: smallest label; null
    for an unusable vector).  The centroids must fit one broadcast."""
    rows = _collect_bounded(centroids.select(label, centroid), centroid, max_centroids)
    if rows is None:
        raise ValueError("too many centroids for a column; use centroid_assign")
    rows = sorted((r for r in rows if r[centroid] is not None), key=lambda r: r[label])
    labels = [r[label] for r in rows]
    C = np.stack([np.asarray(r[centroid], dtype=np.float64) for r in rows]) if rows else np.zeros((0, 0))

    @F.pandas_udf(centroids.schema[label].dataType)
    def nearest(s: pd.Series) -> pd.Series:
        out = np.full(len(s), None, dtype=object)
        ok, X = _stack(s, C.shape[1] or None)
        if len(X) and labels:
            q, r, _ = _exact_candidates(C, X, 1)
            out[np.flatnonzero(ok)[q]] = np.array(labels, dtype=object)[r]
        return pd.Series(out)
    return nearest(_c(vec))


def topic_cluster(df: DataFrame, k: int = 10, *, vec: str = "embedding", seed: int = 42,
                  id_col: str = "doc_id", max_iter: int = 20) -> DataFrame:
    """KMeans on L2-normalised vectors with k = min(k, rows).

    ``min(k, n)`` is computed as ``limit(k).count()`` so it never scans more
    than k rows.  Returns ``id_col, cluster``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = df.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(l2_normalize(vec)).alias("features"))
    kk = data.limit(k).count()
    if kk == 0:
        return data.select(id_col, F.lit(None).cast("int").alias("cluster")).limit(0)
    if kk == 1:
        return data.select(id_col, F.lit(0).alias("cluster"))
    from pyspark import StorageLevel
    cached = data.persist(StorageLevel.MEMORY_AND_DISK)   # iterative: one read per fit
    try:
        model = KMeans(k=kk, seed=seed, maxIter=max_iter, featuresCol="features",
                       predictionCol="cluster").fit(cached)
    finally:
        cached.unpersist()
    return model.transform(data).select(id_col, "cluster")


def _weighted_starts(X: np.ndarray, w: np.ndarray, k: int, rng, steps: int = 10) -> np.ndarray:
    """At most ``k`` centres of weighted points: k-means++ draws, then Lloyd steps."""
    first = int(rng.choice(len(X), p=w / w.sum()))
    chosen, d2 = [first], ((X - X[first]) ** 2).sum(axis=1)
    while len(chosen) < k and (d2 * w).sum() > 0:
        nxt = int(rng.choice(len(X), p=d2 * w / (d2 * w).sum()))
        chosen.append(nxt)
        d2 = np.minimum(d2, ((X - X[nxt]) ** 2).sum(axis=1))
    C = X[chosen]
    for _ in range(steps):
        near = np.stack([((X - c) ** 2).sum(axis=1) for c in C]).argmin(axis=0)
        moved = np.stack([np.average(X[near == j], axis=0, weights=w[near == j]) if (near == j).any() else C[j]
                          for j in range(len(C))])
        if np.array_equal(moved, C):
            break
        C = moved
    return C


def cluster_stores(df: DataFrame, k: int = 10, *, vec: str = "embedding", id_col: str = "doc_id",
                   group_cols: Sequence[str] = ("user_id", "keyword"), rounds: int = 8, seed: int = 42,
                   with_centres: bool = False, draws: int = 3, tol: float = 1e-4):
    """Lloyd's k-means within every store, all stores in one job.

    At most ``min(k, distinct vectors)`` clusters a store.  First centres come by
    k-means||: from one vector a store, ``draws`` passes take every vector with a
    probability of 2k times its share of the store's squared distance (a seeded
    hash of id and vector decides), some 2k candidates a pass; weighted k-means++
    over the candidates, each with the number of vectors nearest to it, leaves k.
    A round takes each vector's nearest centre (ties: smallest cluster) and
    averages with a partial aggregate, so a store of any size is never gathered in
    a task; rounds end when no centre of any store moves further than ``tol``, or
    after ``rounds``.  Centres that fit one broadcast are measured in numpy over
    Arrow batches, others meet their documents by a join.

    Vectors are L2-normalised; rows without a usable vector, or whose vector is
    shorter than the longest, are left out.  Returns ``group, id_col, cluster,
    dist``, with ``with_centres`` also the centres ``group, cluster, c``.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from murmura.session import null_safe, work_dir
    g = list(group_cols)
    spark = df.sparkSession
    path = work_dir(spark, "topics")

    def keep(d, name):
        d.write.parquet(f"{path}/{name}")
        return spark.read.schema(d.schema).parquet(f"{path}/{name}")

    usable = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = keep(df.where(usable).select(*g, id_col, F.transform(l2_normalize(vec), lambda x: x.cast("double")).alias("v")), "vectors")
    d = d.where(F.size("v") == (d.agg(F.max(F.size("v"))).head()[0] or 0))
    measured = T.StructType([*d.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())])

    def nearest(centres):
        """Every vector with its nearest centre and the squared distance to it."""
        rows = _collect_bounded(centres, "c", DEFAULT_MAX_QUERIES)
        if rows is None:
            per = centres.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
            far = F.transform("cs", lambda s: F.struct(
                F.aggregate(F.zip_with(F.col("v"), s["c"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("d2"),
                s["cluster"].alias("cluster")))
            return (null_safe(d, per, g).withColumn("m", F.array_min(far))
                    .select(*d.columns, F.col("m.cluster").alias("cluster"), F.col("m.d2").alias("d2")))
        of = {}
        for r in sorted(rows, key=lambda r: r["cluster"]):
            of.setdefault(tuple(r[c] for c in g), []).append((r["cluster"], r["c"]))
        bc = spark.sparkContext.broadcast({s: (np.array([c for c, _ in m]), np.array([c for _, c in m])) for s, m in of.items()})

        def kernel(batches):
            for pdf in batches:
                for at in pdf.groupby(g, sort=False, dropna=False).indices.values():
                    part = pdf.iloc[at]
                    store = tuple(None if pd.isna(x) else x for x in part[g].iloc[0])
                    names, C = bc.value[store]
                    X = np.stack(part["v"].to_list())
                    d2 = np.stack([((X - c) ** 2).sum(axis=1) for c in C])
                    best = d2.argmin(axis=0)
                    yield part.assign(cluster=names[best].astype(np.int32), d2=d2[best, np.arange(len(X))])
        return d.mapInPandas(kernel, measured)

    def numbered(points):
        """The candidates of a store, some tens of rows, numbered from 0."""
        w = Window.partitionBy(*g).orderBy(F.xxhash64(F.lit(seed), "c"), "c")
        return points.distinct().select(*g, (F.row_number().over(w) - 1).cast("int").alias("cluster"), "c")

    points = keep(d.groupBy(*g).agg(F.min_by("v", F.struct(F.xxhash64(F.lit(seed), id_col, "v"), "v")).alias("c")), "first")
    for r in range(draws):
        near = nearest(numbered(points))
        whole = near.groupBy(*g).agg(F.sum("d2").alias("whole"))
        chance = (F.xxhash64(F.lit(seed + 1 + r), id_col, "v").bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53)))
        more = null_safe(near, whole, g).where(chance * F.col("whole") < 2 * k * F.col("d2")).select(*g, F.col("v").alias("c"))
        points = keep(points.unionByName(more), f"points-{r}")
    points = keep(numbered(points), "points")
    weight = nearest(points).groupBy(*g, "cluster").agg(F.count("*").alias("w"))
    start = T.StructType([*[d.schema[c] for c in g], T.StructField("cluster", T.IntegerType()),
                          T.StructField("c", T.ArrayType(T.DoubleType()))])

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        C = _weighted_starts(np.stack(pdf["c"].to_list()), pdf["w"].to_numpy(float), k, np.random.default_rng(seed))
        out = pd.concat([pdf[g].iloc[:1]] * len(C), ignore_index=True)
        return out.assign(cluster=np.arange(len(C), dtype=np.int32), c=list(C))

    centres = keep(null_safe(points, weight, [*g, "cluster"]).groupBy(*g).applyInPandas(reduced, start), "centres-0")
    for r in range(rounds):
        mean = nearest(centres).groupBy(*g, "cluster").agg(Summarizer.mean(array_to_vector("v")).alias("m"))
        moved = keep(mean.select(*g, "cluster", vector_to_array("m").alias("c")), f"centres-{r + 1}")
        old = centres.withColumnRenamed("c", "o")
        step = F.aggregate(F.zip_with("c", "o", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        furthest = null_safe(moved, old, [*g, "cluster"]).agg(F.max(step)).head()[0]
        centres = moved
        if furthest is None or furthest <= tol * tol:
            break
    out = nearest(centres).select(*g, id_col, "cluster", F.sqrt("d2").alias("dist"))
    return (out, centres) if with_centres else out
