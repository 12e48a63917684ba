"""Chat history: positions, question/answer pairs, last-k window, appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.session import null_safe

DEFAULT_BLOCK = 1 << 16


def positions(df: DataFrame, group_cols: Sequence[str], order_col: str,
              block: int = DEFAULT_BLOCK, out: str = "pos") -> DataFrame:
    """Dense 0-based position of each row inside its group, by ``order_col``.

    Skew-safe: rows are cut into blocks of ``block`` consecutive order values,
    each block is numbered by its own window task, and block offsets come
    from a running sum over the (small) per-block counts.  One huge
    conversation therefore never lands in a single sort task.  Blocks are
    ranges of order values, so this assumes (like turn numbers) values that
    are dense within a group; sparse keys only make the blocks emptier.
    """
    g = list(group_cols)
    b = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block)))
    counts = b.groupBy(*g, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy(*g).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    ties = [c for c in ("role", "text") if c in df.columns]       # equal order values: by role and text
    w = Window.partitionBy(*g, "_blk").orderBy(order_col, *ties)
    return (null_safe(b.withColumn("_rn", F.row_number().over(w)), offs, g + ["_blk"])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_blk", "_rn", "_off"))


def messages(history: DataFrame, group_cols: Sequence[str] = ("conv_id",), order_col: str = "turn",
             drop_roles: Sequence[str] = ("system",), block: int = DEFAULT_BLOCK) -> DataFrame:
    """Question/answer messages (system turns removed) with their position."""
    x = history.where(~F.col("role").isin(list(drop_roles)) | F.col("role").isNull()) if drop_roles else history
    return positions(x, group_cols, order_col, block)


def pair_turns(history: DataFrame, group_cols: Sequence[str] = ("conv_id",), order_col: str = "turn",
               drop_roles: Sequence[str] = ("system",), block: int = DEFAULT_BLOCK) -> DataFrame:
    """Messages 2i and 2i+1 -> (question, answer); an odd tail is dropped.

    ``history_id`` joins the group values and the pair index with '_'
    (``{user}_{keyword}_{i}`` for a store's history).
    Returns ``group, pair, history_id, question, answer``.
    """
    g = list(group_cols)
    m = messages(history, g, order_col, drop_roles, block).withColumn("pair", F.floor(F.col("pos") / 2).cast("long"))
    par = F.col("pos") % 2
    pairs = (m.groupBy(*g, "pair").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(par == 0, F.col("text"))).alias("question"),
        F.max(F.when(par == 1, F.col("text"))).alias("answer")))
    pairs = pairs.where(F.col("_n") == 2).drop("_n")
    pairs = pairs.withColumn("history_id", F.concat_ws("_", *[F.col(c).cast("string") for c in g],
                                                       F.col("pair").cast("string")))
    return pairs.select(*g, "pair", "history_id", "question", "answer")


def last_k_turns(history: DataFrame, k: int = 5, group_cols: Sequence[str] = ("conv_id",),
                 order_col: str | Sequence[str] = "turn", drop_roles: Sequence[str] = ("system",)) -> DataFrame:
    """Messages of the last ``k`` complete pairs; when there are at most ``k``
    pairs, every message (an unanswered tail included) is kept.

    Only the last 2k + 1 messages of a group can be kept, so each task ships at
    most that many (a group limit before the shuffle); the count per group is
    one partial aggregate.  Null keys are a group; ties go by role and text."""
    g = list(group_cols)
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    x = history.where(~F.col("role").isin(list(drop_roles)) | F.col("role").isNull()) if drop_roles else history
    w = Window.partitionBy(*g).orderBy(*[F.col(c).desc() for c in (*order, "role", "text")])
    last = x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2 * k + 1)
    m = null_safe(last, x.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), g)
    pairs = F.floor(F.col("_n") / 2)
    pos = (F.col("_n") - F.col("_rn")).cast("long")
    keep = (pairs <= k) | ((pos < 2 * pairs) & (F.floor(pos / 2) >= pairs - k))
    return m.withColumn("pos", pos).where(keep).drop("_rn", "_n")


def append_turn(history: DataFrame, answered: DataFrame, group_cols: Sequence[str] = ("conv_id",),
                order_col: str = "turn") -> DataFrame:
    """Rows to append after an answer: (question, answer) at turns n, n+1
    where n follows the last stored turn (0 for a new conversation)."""
    g = list(group_cols)
    last = history.groupBy(*g).agg(F.max(order_col).alias("_last"))
    a = answered.join(last, g, "left").withColumn("_next", F.coalesce(F.col("_last") + 1, F.lit(0)).cast("long"))
    rows = F.array(
        F.struct(F.col("_next").alias(order_col), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct((F.col("_next") + 1).alias(order_col), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return a.select(*g, F.inline(rows))


def conversation_json(pairs: DataFrame, group_cols: Sequence[str] = ("conv_id",)) -> DataFrame:
    """``{"n": .., "conversation": [{history_id, question, answer}, ...]}``."""
    g = list(group_cols)
    agg = pairs.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("pair", "history_id", "question", "answer"))).alias("_c"))
    conv = F.transform("_c", lambda s: F.struct(s["history_id"].alias("history_id"),
                                                s["question"].alias("question"),
                                                s["answer"].alias("answer")))
    return agg.select(*g, "n", F.to_json(F.struct(F.col("n"), conv.alias("conversation"))).alias("json"))


def conversation_segments(pairs: DataFrame, group_cols: Sequence[str] = ("conv_id",), pairs_each: int = 1024) -> DataFrame:
    """The text of ``conversation_json`` in segments of ``pairs_each`` pairs.

    A conversation's segments, joined in their order without anything between
    them, are its JSON.  A task gathers the pairs of one segment, never those of a
    conversation; only a count and the last pair of each conversation meet the
    segments.  Null group values are a group.  Returns ``group, segment, n_pairs,
    json``.
    """
    g = list(group_cols)
    one = F.to_json(F.struct("history_id", "question", "answer"))
    parts = (pairs.select(*g, "pair", one.alias("_one"))
             .groupBy(*g, F.floor(F.col("pair") / pairs_each).cast("long").alias("segment"))
             .agg(F.count("*").alias("n_pairs"), F.array_sort(F.collect_list(F.struct("pair", "_one"))).alias("_c")))
    whole = pairs.groupBy(*g).agg(F.count("*").alias("_n"), F.floor(F.max("pair") / pairs_each).alias("_last"))
    head = F.when(F.col("segment") == 0, F.concat(F.lit('{"n":'), F.col("_n").cast("string"), F.lit(',"conversation":['))).otherwise(",")
    tail = F.when(F.col("segment") == F.col("_last"), "]}").otherwise("")
    return (null_safe(parts, whole, g)
            .select(*g, "segment", "n_pairs", F.concat(head, F.array_join("_c._one", ","), tail).alias("json")))
