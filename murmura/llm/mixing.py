"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
and share ``share`` of all words; no target exceeds ``cap`` times its source's
words, the excess is reshared by weight until none is above (water filling).
A document's expected copies are target / source words, one number per source.

Rounding: the whole part is taken; fractional parts are settled by pivotal
pairing.  Two documents with fractions x, y and word masses a, b exchange mass
so that a*x + b*y stays the same, in a random direction chosen so that both
expectations stay, until one fraction is 0 or 1; the other goes on to the next
pair.  Documents are paired inside chunks of bounded size, a hot source having
many; each chunk leaves at most one fraction, and those are combined in turn by
a reduction tree over the chunks.  A source's taken words thus miss its target
by less than one document.  Draws are seeded by source and chunk: reruns agree.

Null text has size 0 and takes nothing; null sources form one source; repeated
rows are mixed one by one (more equal rows than a chunk holds are dealt over
chunks by their place in the scan); an empty table gives an empty result.  Columns
``size``, ``source_size``, ``target``, ``copies``, ``taken`` are added (replaced
if present).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from murmura.llm.tables import written

WEIGHTS = (5, 2, 1)
CHUNK = 4096                   # documents paired by one task step; fan-in of the tree
ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).
    Sources are numbered by a distributed sort; water filling runs as one small
    aggregate a round, and a round that fixes no further source is the last."""
    spark = sizes.sparkSession
    order = sizes.orderBy(F.col("source").asc_nulls_last())
    schema = StructType(sizes.schema.fields + [StructField("w", DoubleType())])
    numbered = order.rdd.zipWithIndex().map(lambda r: (*r[0], float(weights[r[1] % len(weights)])))
    table = written(spark.createDataFrame(numbered, schema), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, None
    limit = F.col("source_size") * F.lit(float(cap))
    while True:
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) > limit
        fixed, open_w, n_full = table.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("w"))),
                                          F.count(F.when(full, 1))).first()
        if level is not None and n_full == before:
            break
        before = n_full
        if not open_w:
            break
        level = (budget - (fixed or 0.0)) / open_w
    value = F.least(F.col("w") * F.lit(level or 0.0), limit)
    return table.select("source", "source_size", "n_docs", value.alias("target"))


def settle(x: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal pass over one chunk: all but at most one entry become 0 or 1."""
    x = x.copy()
    u = rng.random(len(x))
    open_ = np.flatnonzero((x > 0) & (x < 1))
    if not len(open_):
        return x
    xs, a = x.tolist(), mass.tolist()
    i = -1                                                 # the open fraction that meets the next one
    for j in open_.tolist():
        if i < 0:
            i = j
            continue
        up = min((1 - xs[i]) * a[i], xs[j] * a[j])         # words that can move to i
        down = min(xs[i] * a[i], (1 - xs[j]) * a[j])       # words that can move to j
        if u[j] * (up + down) < down:
            i_full, j_empty = up == (1 - xs[i]) * a[i], up == xs[j] * a[j]
            xs[i], xs[j] = (1.0 if i_full else xs[i] + up / a[i]), (0.0 if j_empty else xs[j] - up / a[j])
        else:
            i_empty, j_full = down == xs[i] * a[i], down == (1 - xs[j]) * a[j]
            xs[i], xs[j] = (0.0 if i_empty else xs[i] - down / a[i]), (1.0 if j_full else xs[j] + down / a[j])
        if not 0 < xs[i] < 1:
            i = j if 0 < xs[j] < 1 else -1
    return np.array(xs)


def _tree_level(d: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    schema = d.schema

    def run(t: pa.Table) -> pa.Table:
        src, chunk = t["_sid"][0].as_py(), t["_chunk"][0].as_py()
        rng = np.random.default_rng([seed, level, src & (2 ** 63 - 1), chunk])
        order = np.lexsort((t["_place"].to_numpy(), t["_order"].to_numpy()))
        t = t.take(pa.array(order))
        x = settle(t["_x"].to_numpy(), t["_mass"].to_numpy().astype(np.float64), rng)
        if last:
            frac = (x > 0) & (x < 1)
            x[frac] = rng.random(int(frac.sum())) < x[frac]
        return t.set_column(t.schema.get_field_index("_x"), "_x", pa.array(x))

    return d.groupBy("_sid", "_chunk").applyInArrow(run, schema)


def mix(df: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 11, source_col: str = "source",
        size=None, chunk: int = CHUNK, weights=WEIGHTS) -> DataFrame:
    """Every row of ``df`` with its size, its source's size and target, its
    ``copies`` and the words ``taken``.  Carries the columns of ``df`` through
    one shuffle, so pass the slim columns only and join texts afterwards.
    ``size`` is a column of word counts (default: words of ``text``)."""
    keep = [c for c in df.columns if c not in ADDED or c == source_col]
    size = word_count(F.col("text")) if size is None else size
    plain = [F.col(f"`{c}`") for c in keep]
    # the caller's columns travel as one struct: no name of theirs can meet one of ours
    d = df.select(F.struct(*plain).alias("_row"), size.alias("_size"), F.col(f"`{source_col}`").alias("_src"),
                  F.xxhash64(F.lit(seed), *plain).alias("_order"))
    stats = d.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = written(targets(stats.withColumnRenamed("_src", "source"), share, cap, weights), "mix-targets")
    g = goal.select(F.col("source").alias("_gs"), F.col("source_size").alias("_ssize"),
                    F.col("n_docs").alias("_nd"), F.col("target").alias("_target"))
    d = d.join(g, F.col("_src").eqNullSafe(F.col("_gs"))).drop("_gs")
    p = F.when(F.col("_ssize") > 0, F.least(F.col("_target") / F.col("_ssize"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    chunks = F.ceil(F.col("_nd") / F.lit(chunk)).cast("bigint")
    # equal rows share a hash; those too many for a chunk are told apart by their place in the scan
    many = d.groupBy("_order").count().where(F.col("count") > chunk).select(F.col("_order").alias("_often"))
    d = d.withColumn("_place", F.monotonically_increasing_id()).join(many, F.col("_order") == F.col("_often"), "left")
    d = d.withColumn("_place", F.when(F.col("_often").isNull(), F.lit(-1)).otherwise(F.col("_place"))).drop("_often")
    d = (d.withColumn("_whole", F.floor(p)).withColumn("_x", p - F.floor(p)).withColumn("_mass", F.col("_size"))
         .withColumn("_x", F.when(F.col("_mass") > 0, F.col("_x")).otherwise(F.lit(0.0)))
         .withColumn("_sid", F.coalesce(F.xxhash64("_src"), F.lit(0)))
         .withColumn("_chunk", F.pmod(F.xxhash64("_order", "_place", F.lit(seed)), chunks)).drop("_src"))
    widest = (goal.agg(F.max(F.ceil(F.col("n_docs") / F.lit(chunk)))).first()[0]) or 1
    level, settled = 0, None
    while True:
        last = widest <= 1
        out = written(_tree_level(d, level, seed, last), f"mix-{level}")
        done = out.where((F.col("_x") <= 0) | (F.col("_x") >= 1))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        d = out.where((F.col("_x") > 0) & (F.col("_x") < 1)).withColumn("_chunk", F.floor(F.col("_chunk") / F.lit(chunk)))
        widest, level = -(-widest // chunk), level + 1
    copies = (F.col("_whole") + F.col("_x")).cast("int")
    return settled.select(*[F.col(f"_row.`{c}`") for c in keep], F.col("_size").alias("size"), F.col("_ssize").alias("source_size"),
                          F.col("_target").alias("target"), copies.alias("copies"),
                          (copies * F.col("_size")).cast("bigint").alias("taken"))
