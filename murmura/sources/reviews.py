"""App-store reviews: a nested list per app flattened into post records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators.extract import to_post


def normalize_reviews(df: DataFrame, reviews_col: str = "reviews", url=None, site=None,
                      keep=()) -> DataFrame:
    """``ARRAY<STRUCT<content, thumbsUpCount, at, ...>>`` -> one post per
    review: content -> document, thumbsUpCount -> likes, at -> postdate,
    constant url and site, every other post column null."""
    x = df.select(*keep, F.inline(F.col(reviews_col)))
    return to_post(x, keep=list(keep),
                   url=url if url is not None else F.lit(None),
                   site=site if site is not None else F.lit(None),
                   document=F.col("content"), likes=F.col("thumbsUpCount"),
                   postdate=F.col("at"))
