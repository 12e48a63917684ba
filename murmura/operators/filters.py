"""Row filters and projections of the post table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.constants import EXCLUDE_CATEGORIES, PROFANITY
from murmura.functions.text import _c, contains_any, is_blank, ustrip


def drop_null_text(df: DataFrame, col: str = "document") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def drop_blank_text(df: DataFrame, col: str = "document") -> DataFrame:
    """Drop rows whose text is empty after a Unicode-aware strip."""
    return df.where(~is_blank(col))


def valid_posts(df: DataFrame, col: str = "document") -> DataFrame:
    return drop_blank_text(drop_null_text(df, col), col)


def exclude_categories(df: DataFrame, terms: Sequence[str] = tuple(EXCLUDE_CATEGORIES),
                       cols: Sequence[str] = ("boardcategory", "documentcategory")) -> DataFrame:
    """Drop a row when any present category column contains any term.

    A null category keeps the row; an absent column is skipped.
    """
    for c in cols:
        if c in df.columns:
            df = df.where(~contains_any(F.coalesce(F.col(c), F.lit("")), terms))
    return df


def exclude_sites(df: DataFrame, sites: Sequence[str], col: str = "site") -> DataFrame:
    if not sites:
        return df
    return df.where(~F.col(col).isin(list(sites)) | F.col(col).isNull())


def is_yes(label) -> "F.Column":
    """A label accepts when ``strip().lower()`` starts with 'yes'."""
    return F.startswith(F.lower(ustrip(_c(label))), F.lit("yes"))


def relevance_filter(df: DataFrame, label_col: str = "relevance") -> DataFrame:
    return df.where(F.coalesce(is_yes(label_col), F.lit(False)))


def exclude_profanity(df: DataFrame, col: str, terms: Sequence[str] = tuple(PROFANITY)) -> DataFrame:
    return df.where(~contains_any(F.col(col), terms))


def to_document(df: DataFrame, content_col: str = "document") -> DataFrame:
    """One content column plus every other column as a metadata struct."""
    rest = [c for c in df.columns if c != content_col]
    return df.select(F.col(content_col).alias("page_content"),
                     F.struct(*[F.col(c) for c in rest]).alias("metadata"))
