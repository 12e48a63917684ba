"""Answer-time retrieval: top-k documents per question -> formatted context,
joined with the last k turns of the conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.constants import CHAT_DOCUMENT_TEMPLATE
from murmura.functions.text import render
from murmura.operators.vectors import knn_topk
from murmura.session import null_safe

BROADCAST_HITS = 100_000


def fetch(hits: DataFrame, store: DataFrame, questions: DataFrame, k: int, keys=()) -> DataFrame:
    """The stored rows of ``hits``.  There are at most ``k`` hits a question;
    if the questions are few enough the hits are broadcast, so no document text
    is shuffled, else the join is a shuffle join."""
    most = max(1, BROADCAST_HITS // max(1, k))
    few = questions.limit(most + 1).count() <= most
    return null_safe(store, F.broadcast(hits) if few else hits, [*keys, "doc_id"])


def retrieve_context(questions: DataFrame, store: DataFrame, k: int = 4,
                     template: str = CHAT_DOCUMENT_TEMPLATE, sep: str = "\n\n") -> DataFrame:
    """``questions(qid, embedding)`` x ``store(doc_id, document, ..., embedding)``
    -> ``qid, context``.  No store rows -> empty context (the answer is still
    produced from history alone)."""
    hits = knn_topk(store, questions, k)
    docs = fetch(hits, store.drop("embedding"), questions, k).select(
        "qid", "rank", render(template, page_content="document").alias("t"))
    ctx = docs.groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda s: s["t"]), sep).alias("context"))
    return (questions.select("qid").join(ctx, "qid", "left")
            .select("qid", F.coalesce("context", F.lit("")).alias("context")))


def answer_inputs(questions: DataFrame, variants: DataFrame, store: DataFrame, history: DataFrame,
                  k: int = 4, last_k: int = 5, keys=("user_id", "keyword")) -> DataFrame:
    """Everything an external model needs to answer a question of a store:
    the context from the distinct union of the variants' top-k documents of
    that store, and the last ``last_k`` question/answer turns of its history.

    ``questions(qid, user_id, keyword)``, ``variants(parent_qid, variant,
    user_id, keyword, embedding)``, ``store(doc_id, user_id, keyword,
    document, postdate, embedding)``, ``history(user_id, keyword, conv_id,
    turn, role, text)``.  Returns ``qid, context, history``.
    """
    from murmura.operators.history import last_k_turns
    from murmura.operators.vectors import multi_query_topk
    g = list(keys)
    hits = multi_query_topk(store, variants, k, group_cols=g)
    # a question asks one store: ids that repeat in other stores are not its documents
    hits = hits.join(questions.select(F.col("qid").alias("parent_qid"), *g), "parent_qid")
    docs = fetch(hits, store.drop("embedding"), variants, k, g).select(
        F.col("parent_qid").alias("qid"), "ord", render(CHAT_DOCUMENT_TEMPLATE, page_content="document").alias("t"))
    ctx = docs.groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda s: s["t"]), "\n\n").alias("context"))
    turns = last_k_turns(history, last_k, g, ["conv_id", "turn"])    # one history a store
    hist = turns.groupBy(*g).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))),
        lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("history"))
    return (questions.join(ctx, "qid", "left").join(hist, g, "left")
            .select("qid", *g, F.coalesce("context", F.lit("")).alias("context"),
                    F.coalesce("history", F.lit("")).alias("history")))
