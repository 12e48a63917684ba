"""Sentiment counts, shares and top opinions per (user, keyword) store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.functions.text import render, safe_int

STORE_GROUP = ("user_id", "keyword")


def pct(n, total):
    """round(100 * n / total, 1); null when total is 0 (no division error)."""
    return F.round(F.try_divide(F.lit(100.0) * n, total), 1)


def sentiment_summary(df: DataFrame, label_col: str = "sentiment",
                      group_cols: Sequence[str] = STORE_GROUP) -> DataFrame:
    """Exact-match counts of the three labels; ``total`` counts every row, so
    an unknown label is counted in the total only.  One pass, partial
    aggregation before the shuffle."""
    lab = F.col(label_col)
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lab == K.POSITIVE).alias("pos"),
        F.count_if(lab == K.NEGATIVE).alias("neg"),
        F.count_if(lab == K.NEUTRAL).alias("neu"))
    return agg.select(*group_cols, "total",
                      "pos", pct(F.col("pos"), F.col("total")).alias("pos_pct"),
                      "neg", pct(F.col("neg"), F.col("total")).alias("neg_pct"),
                      "neu", pct(F.col("neu"), F.col("total")).alias("neu_pct"))


def top_opinions(df: DataFrame, label_col: str = "sentiment", *, text_col: str = "document",
                 views_col: str = "views", id_col: str = "doc_id",
                 group_cols: Sequence[str] = STORE_GROUP,
                 labels: Sequence[str] = (K.POSITIVE, K.NEGATIVE), n: int = 3,
                 prefix: int = 200, profanity: Sequence[str] = tuple(K.PROFANITY)) -> DataFrame:
    """Per label: the ``n`` most viewed texts (first ``prefix`` chars), ties in
    store order (``id_col``); profane texts are removed before taking ``n``.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a label holding most rows still ships only n rows per
    task.
    """
    from murmura.operators.filters import exclude_profanity
    x = (df.where(F.col(label_col).isin(list(labels)))
         .select(*group_cols, F.col(label_col).alias("sentiment"), id_col,
                 safe_int(views_col).alias("views_n"),
                 F.substring(F.col(text_col), 1, prefix).alias("opinion")))
    x = exclude_profanity(x, "opinion", profanity)
    w = Window.partitionBy(*group_cols, "sentiment").orderBy(F.desc("views_n"), F.col(id_col))
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _lines(tops: DataFrame, label: str, group_cols) -> "F.Column":
    return F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("sentiment") == label,
                                           F.struct("rank", "opinion")))),
        lambda x: F.concat(F.lit("- "), x["opinion"])), "\n")


def sentiment_text(summary: DataFrame, tops: DataFrame,
                   group_cols: Sequence[str] = STORE_GROUP) -> DataFrame:
    """The sentiment block of the report context, one row per group."""
    lines = tops.groupBy(*group_cols).agg(_lines(tops, K.POSITIVE, group_cols).alias("pos_lines"),
                                         _lines(tops, K.NEGATIVE, group_cols).alias("neg_lines"))
    j = summary.join(lines, list(group_cols), "left")
    body = F.concat(
        F.lit("\n"), render(K.SENTIMENT_HEADER, total="total"), F.lit("\n"),
        render(K.SENTIMENT_LINE, name=F.lit(K.POSITIVE), n="pos", pct="pos_pct"), F.lit("\n"),
        render(K.SENTIMENT_LINE, name=F.lit(K.NEGATIVE), n="neg", pct="neg_pct"), F.lit("\n"),
        render(K.SENTIMENT_LINE, name=F.lit(K.NEUTRAL), n="neu", pct="neu_pct"), F.lit("\n\n"),
        F.lit(K.TOP_POS_HEADER), F.lit("\n"), F.coalesce(F.col("pos_lines"), F.lit("")), F.lit("\n\n"),
        F.lit(K.TOP_NEG_HEADER), F.lit("\n"), F.coalesce(F.col("neg_lines"), F.lit("")), F.lit("\n"))
    return j.select(*group_cols, body.alias("sentiment_text"))
