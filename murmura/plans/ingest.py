"""The incremental ingest flow of one or many runs.

    posts -> valid -> category filter -> relevance score (persisted once)
          -> relevant -> anti join by url with the store -> embed -> append

Scoring is the expensive, possibly remote step, and its result is used
three times (persist, count, merge), so it is written once as a table
(``posts_scored``) and read back, rather than recomputed per action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from murmura.functions.constants import EXCLUDE_CATEGORIES
from murmura.operators.filters import exclude_categories, relevance_filter, valid_posts
from murmura.operators.scoring import Scorer, score
from murmura.operators.store import VectorStore, anti_by_url, drop_stale_runs, observed_rows, replace_runs
from murmura.schema import STORE_KEYS


def filter_relevant(df: DataFrame, scorer: Scorer, categories: Sequence[str] = tuple(EXCLUDE_CATEGORIES),
                    text_col: str = "document", keyword_col: str = "keyword") -> DataFrame:
    """Cheap native filters first (Catalyst keeps them below the scorer),
    then the scorer, then the yes-filter."""
    x = exclude_categories(valid_posts(df, text_col), categories)
    return relevance_filter(score(x, scorer, text_col, "relevance", keyword_col))


def ingest_metrics(relevant: DataFrame, store: DataFrame) -> DataFrame:
    """Per store: relevant rows of the run and rows new to the store.
    ``relevant`` feeds two aggregates; pass the persisted scored rows."""
    new = anti_by_url(relevant, store)
    tot = relevant.groupBy(*STORE_KEYS).agg(F.count(F.lit(1)).alias("total_filtered"))
    add = new.groupBy(*STORE_KEYS).agg(F.count(F.lit(1)).alias("added"))
    return (tot.join(add, STORE_KEYS, "left")
            .select(*STORE_KEYS, "total_filtered", F.coalesce("added", F.lit(0).cast("long")).alias("added")))


def run_ingest(spark: SparkSession, merged: DataFrame, root: str, scorer: Scorer,
               categories: Sequence[str] = tuple(EXCLUDE_CATEGORIES), embedder=None) -> dict:
    """Ingest merged runs into the stores below ``root``.

    1. replace these runs by their relevant rows in one commit
       (posts_filtered); a run without any leaves nothing behind;
    2. append the new ones to the store in one commit (before any run goes);
    3. only then drop the runs other than the latest, in one commit.
    A job that dies on the way leaves every table at its last commit, and
    repeating it gives what an undisturbed job gives.
    Returns ``{'status', 'added', 'total_filtered'}``.
    """
    filtered_path = f"{root}/posts_filtered"
    obs = Observation("relevant")
    rel = filter_relevant(merged, scorer, categories).observe(obs, F.count(F.lit(1)).alias("rows"))
    persisted = replace_runs(rel, filtered_path, merged)       # the scorer runs once, here
    total = observed_rows(obs)
    store = VectorStore(spark, root, embedder)
    added = store.append_new(persisted.drop("run_id", "relevance"))
    drop_stale_runs(spark, filtered_path, merged)
    return {"status": "ok", "added": added, "total_filtered": total}
