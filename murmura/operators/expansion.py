"""Query variants by pseudo-relevance feedback.

A question's vector is moved towards the mean of its nearest documents, round
after round; the vectors met on the way are its variants (the first is the
question itself), the input of ``multi_query_topk`` and ``answer_inputs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators.vectors import centroids_by, knn_topk
from murmura.session import work_dir


def expand_queries(questions: DataFrame, store: DataFrame, k: int = 4, rounds: int = 2, keep: float = 0.5, *,
                   qid: str = "qid", query_vec: str = "embedding", doc_id: str = "doc_id",
                   doc_vec: str = "embedding", group_cols: Sequence[str] = ()) -> DataFrame:
    """``rounds + 1`` variants of every question:
    ``parent_qid, variant, group_cols, embedding``.

    Variant 0 is the question's vector; variant r is ``keep`` times variant
    r - 1 and ``1 - keep`` times the mean of its ``k`` nearest documents (of the
    same group).  A round is one exact search and an aggregate of at most ``k``
    vectors a question; its result is written, so no round runs twice.  A
    question without documents keeps its vector; a null vector stays null.
    """
    from murmura.plans.retrieval import fetch
    assert rounds >= 0 and 0 <= keep <= 1
    g = list(group_cols)
    spark = questions.sparkSession
    path = work_dir(spark, "variants")
    docs = store.select(*g, F.col(doc_id).alias("doc_id"), F.col(doc_vec).cast("array<double>").alias("v"))
    now = questions.select(F.col(qid).alias("parent_qid"), F.lit(0).alias("variant"), *g,
                           F.col(query_vec).cast("array<double>").alias("embedding"))
    for r in range(rounds + 1):
        if r:
            hits = knn_topk(docs, now, k, doc_vec="v", qid="parent_qid", group_cols=g).select("parent_qid", "doc_id")
            if g:
                hits = hits.join(now.select("parent_qid", *g), "parent_qid")
            near = centroids_by(fetch(hits, docs, now, k, g).select("parent_qid", "v"), "parent_qid", "v")
            moved = F.zip_with("embedding", "centroid", lambda x, y: keep * x + (1 - keep) * y)
            now = now.join(near, "parent_qid", "left").select(
                "parent_qid", F.lit(r).alias("variant"), *g, F.coalesce(moved, "embedding").alias("embedding"))
        now.write.parquet(f"{path}/variant={r}")
        now = spark.read.schema(now.schema).parquet(f"{path}/variant={r}")
    return spark.read.schema(now.schema).parquet(*[f"{path}/variant={r}" for r in range(rounds + 1)])
