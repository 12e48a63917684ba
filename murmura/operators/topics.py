"""Topic tables over clustered documents, per (user, keyword) store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.functions.text import contains_any, render, tokens, ustrip
from murmura.operators.sentiment import STORE_GROUP, pct


def cluster_sizes(df: DataFrame, cluster_col: str = "cluster", id_col: str = "doc_id",
                  group_cols: Sequence[str] = STORE_GROUP) -> DataFrame:
    """Count per cluster (blank documents included), share of all documents
    of the group, and the first position (for stable tie breaks)."""
    g = list(group_cols)
    sizes = df.groupBy(*g, cluster_col).agg(F.count(F.lit(1)).alias("count"),
                                            F.min(id_col).alias("min_pos"))
    # the per-group total is a window over the tiny per-cluster table
    tot = F.sum("count").over(Window.partitionBy(*g)) if g else F.sum("count").over(Window.partitionBy())
    return sizes.withColumn("pct", pct(F.col("count"), tot))


def cluster_samples(df: DataFrame, cluster_col: str = "cluster", text_col: str = "document",
                    id_col: str = "doc_id", group_cols: Sequence[str] = STORE_GROUP,
                    n: int = 3) -> DataFrame:
    """First ``n`` stripped, non-blank contents per cluster in store order."""
    g = list(group_cols)
    x = (df.select(*g, cluster_col, id_col, ustrip(text_col).alias("content"))
         .where(F.col("content") != ""))
    w = Window.partitionBy(*g, cluster_col).orderBy(id_col)
    x = x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return x.groupBy(*g, cluster_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "content"))),
                    lambda s: s["content"]).alias("samples"))


def topic_terms(df: DataFrame, cluster_col: str = "cluster", text_col: str = "document",
                group_cols: Sequence[str] = STORE_GROUP, n_terms: int = 3,
                max_len: int = K.TOPIC_MAX_NAME_LEN) -> DataFrame:
    """Name clusters by class TF-IDF: tf = term count in the cluster,
    idf = ln(#clusters / #clusters containing the term).  Top ``n_terms`` by
    score (ties by term).  Returns ``group, cluster, terms, topic``.  Every term
    counts, however short; a name over ``max_len`` gives up its last terms, and
    a single longer term is cut, so no topic is lost for its name.

    Plan: tokens -> partial/final count per (group, cluster, term) (the only
    pass over text; map-side combine) -> document frequency as a window over
    (group, term), whose partitions hold at most one row per cluster -> join
    the per-group cluster count (one row per group) -> top-n per cluster with
    a partial WindowGroupLimit before its shuffle.
    """
    g = list(group_cols)
    if not g:
        df = df.withColumn("_all", F.lit(0))
        g = ["_all"]
    tf = (df.select(*g, cluster_col, F.explode(tokens(text_col)).alias("term"))
          .groupBy(*g, cluster_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(*g, "term")))
    n_clusters = df.groupBy(*g).agg(F.count_distinct(cluster_col).alias("n_clusters"))
    sc = (tf.join(n_clusters, g)
          .withColumn("score", F.round(F.col("tf") * F.log(F.col("n_clusters") / F.col("df")), 9))
          .where(F.col("score") > 0))
    w = Window.partitionBy(*g, cluster_col).orderBy(F.desc("score"), F.col("term"))
    top = sc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_terms)
    out = top.groupBy(*g, cluster_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "term"))), lambda s: s["term"]).alias("terms")
    ).withColumn("topic", fitting_name("terms", max_len))
    return out.drop("_all") if "_all" in g else out


def fitting_name(terms, max_len: int):
    """The longest run of leading terms, joined by spaces, of at most
    ``max_len`` characters; at least the first term, cut."""
    names = F.transform(terms, lambda t, i: F.array_join(F.slice(terms, F.lit(1), i + 1), " "))
    fit = F.filter(names, lambda x: F.char_length(x) <= max_len)
    return F.when(F.size(fit) > 0, F.element_at(fit, -1)).otherwise(F.substring(F.element_at(names, 1), 1, max_len))


def topic_table(sizes: DataFrame, samples: DataFrame, names: DataFrame,
                cluster_col: str = "cluster", group_cols: Sequence[str] = STORE_GROUP,
                drop_markers: Sequence[str] = tuple(K.TOPIC_DROP_MARKERS),
                max_len: int = K.TOPIC_MAX_NAME_LEN) -> DataFrame:
    """Topics by size (ties by first appearance), skipping clusters without
    any non-blank content and dropping unnamed / off-topic / over-long names.
    Dropped topics stay in the percentage denominator."""
    g = list(group_cols)
    t = (sizes.join(samples, g + [cluster_col], "inner")
         .join(names.select(*g, cluster_col, "topic"), g + [cluster_col], "left")
         .withColumn("topic", F.coalesce(F.col("topic"), F.concat(F.lit("topic "), F.col(cluster_col).cast("string")))))
    t = t.where(~contains_any(F.col("topic"), drop_markers) & (F.char_length("topic") <= max_len))
    w = Window.partitionBy(*g).orderBy(F.desc("count"), F.col("min_pos"))
    return t.withColumn("rank", F.row_number().over(w))


def topic_summary_text(table: DataFrame, group_cols: Sequence[str] = STORE_GROUP) -> DataFrame:
    """Header plus ``i. topic: count건 (pct%)`` lines, one row per group."""
    g = list(group_cols)
    line = render(K.TOPIC_LINE, i="rank", topic="topic", count="count", pct="pct")
    agg = table.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))),
                                 lambda s: s["line"]), "\n").alias("lines"))
    header = render(K.TOPIC_HEADER, n="n")
    return agg.select(*g, F.concat(header, F.lit("\n"), F.col("lines")).alias("topic_text"))


def naming_prompts(df: DataFrame, cluster_col: str = "cluster", text_col: str = "document",
                   id_col: str = "doc_id", group_cols: Sequence[str] = STORE_GROUP,
                   keyword_col: str = "keyword") -> DataFrame:
    """The model input that names a cluster: the first few contents of the
    cluster, each cut to a short sample, inside the naming instruction.
    One bounded row per cluster."""
    g = list(group_cols)
    s = cluster_samples(df, cluster_col, text_col, id_col, g, n=K.TOPIC_NAME_SAMPLES)
    sample = F.array_join(F.transform("samples", lambda x: F.concat(
        F.lit("- "), F.substring(x, 1, K.TOPIC_NAME_SAMPLE_CHARS))), "\n")
    kw = F.col(keyword_col) if keyword_col in g else F.lit("")
    return s.select(*g, cluster_col, render(K.TOPIC_NAME_PROMPT, keyword=kw, sample=sample).alias("prompt"))


def model_topic_names(df: DataFrame, namer, cluster_col: str = "cluster", text_col: str = "document",
                      id_col: str = "doc_id", group_cols: Sequence[str] = STORE_GROUP) -> DataFrame:
    """Names from a pluggable model (an ``ArrowScorer`` over the prompts),
    stripped; a drop-in replacement for ``topic_terms`` in ``topic_table``."""
    p = naming_prompts(df, cluster_col, text_col, id_col, group_cols)
    return p.select(*group_cols, cluster_col, ustrip(namer.column(F.col("prompt"))).alias("topic"))
