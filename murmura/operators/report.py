"""Report inputs (facts, context), deterministic report checks and the
parsing of a written report into typed lines and diagram links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.functions.text import R_FENCE, _c, base64_utf8, render, truncate_ellipsis


def combine_documents(docs: DataFrame, group_cols: Sequence[str], order_col: str,
                      template: str = K.REPORT_DOCUMENT_TEMPLATE, sep: str = "\n",
                      max_chars: int = 1000, text_col: str = "document") -> DataFrame:
    """Format each retrieved document (content cut at ``max_chars`` + '...')
    and join them in retrieval order.  Bounded input: top-k per group."""
    g = list(group_cols)
    txt = render(template, page_content=truncate_ellipsis(text_col, max_chars))
    return docs.groupBy(*g).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), txt.alias("t")))),
                                 lambda s: s["t"]), sep).alias("docs_text"))


def report_context(sentiment_text: DataFrame, topic_text: DataFrame, docs_text: DataFrame,
                   group_cols: Sequence[str]) -> DataFrame:
    """sentiment block + topic block + detail documents, in that order."""
    g = list(group_cols)
    j = sentiment_text.join(topic_text, g, "full").join(docs_text, g, "full")
    ctx = F.concat(F.coalesce(F.col("sentiment_text"), F.lit("")), F.lit("\n\n"),
                   F.coalesce(F.col("topic_text"), F.lit("")), F.lit("\n\n"),
                   F.lit(K.DETAIL_HEADER), F.lit("\n"), F.coalesce(F.col("docs_text"), F.lit("")))
    return j.select(*g, ctx.alias("context"))


def report_facts(summary: DataFrame, topics: DataFrame, tops: DataFrame,
                 group_cols: Sequence[str]) -> DataFrame:
    """One row per store: sentiment numbers, topic lines and top opinions."""
    g = list(group_cols)
    tl = topics.groupBy(*g).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", render("- {topic}: {count}건({pct}%)", topic="topic", count="count", pct="pct").alias("l")))),
        lambda s: s["l"]), "\n").alias("topic_lines"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("pct")))), lambda s: s["pct"]).alias("topic_pcts"))
    op = tops.groupBy(*g).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("sentiment") == K.POSITIVE, F.struct("rank", "opinion")))),
                    lambda s: s["opinion"]).alias("top_pos"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("sentiment") == K.NEGATIVE, F.struct("rank", "opinion")))),
                    lambda s: s["opinion"]).alias("top_neg"))
    s = summary.withColumn("summary", render(
        "전체 {total}건 중 긍정 {pos}건({pos_pct}%), 부정 {neg}건({neg_pct}%), 중립 {neu}건({neu_pct}%)",
        total="total", pos="pos", pos_pct="pos_pct", neg="neg", neg_pct="neg_pct", neu="neu", neu_pct="neu_pct"))
    return (s.join(tl, g, "left").join(op, g, "left")
            .withColumn("topic_lines", F.coalesce("topic_lines", F.lit("")))
            .withColumn("topic_pcts", F.coalesce("topic_pcts", F.array().cast("array<double>")))
            .withColumn("top_pos", F.coalesce("top_pos", F.array().cast("array<string>")))
            .withColumn("top_neg", F.coalesce("top_neg", F.array().cast("array<string>"))))


def report_check(drafts: DataFrame, draft_col: str = "draft", iteration_col: str = "iteration",
                 quote_len: int = 30, max_iterations: int = K.MAX_REPORT_ITERATIONS) -> DataFrame:
    """Deterministic critic over (facts ⨝ drafts): the draft must quote the
    three sentiment percentages, every topic ratio (numbers are compared whole, and
    one that several facts share is wanted as often) and at least one real, non-empty
    opinion (its first ``quote_len`` chars).  PASS, or RETRY with the missing
    items; accepted anyway from ``max_iterations`` on."""
    d = F.col(draft_col)

    # every percentage of the draft, as whole numbers: 5.0% is not in 45.0%
    told_expr = F.regexp_extract_all(d, F.lit(r"(?<![0-9.,])([0-9]+(?:\.[0-9]+)?)%"), F.lit(1))
    topics = F.coalesce("topic_pcts", F.array().cast("array<double>"))
    shares = F.array(*[F.col(c).cast("string") for c in ("pos_pct", "neg_pct", "neu_pct")])
    want_expr = F.concat(shares, F.transform(topics, lambda p: p.cast("string")))
    # as columns they are made once a draft; an expression would be run for every fact
    found, wanted = _unused(drafts, "told"), _unused(drafts, "want")
    told, want = F.col(found), F.col(wanted)
    full = drafts.withColumns({found: told_expr, wanted: want_expr})

    def times(values, x):
        return F.size(F.filter(values, lambda v: v == x))

    # a number that several facts share must be quoted as often as they do
    def quoted_as_often(x):
        return F.coalesce((times(told, x) > 0) & (times(told, x) >= times(want, x)), F.lit(False))

    def has_pct(c):
        return quoted_as_often(c.cast("string"))

    ops = F.filter(F.concat(F.coalesce("top_pos", F.array().cast("array<string>")),
                            F.coalesce("top_neg", F.array().cast("array<string>"))),
                   lambda o: o.isNotNull() & (o != ""))
    quoted = F.exists(ops, lambda o: d.contains(F.substring(o, 1, quote_len)))
    topics_ok = F.forall(topics, lambda p: quoted_as_often(p.cast("string")))
    missing = F.array_compact(F.array(
        F.when(~has_pct(F.col("pos_pct")), F.lit("positive share")),
        F.when(~has_pct(F.col("neg_pct")), F.lit("negative share")),
        F.when(~has_pct(F.col("neu_pct")), F.lit("neutral share")),
        F.when(~F.coalesce(topics_ok, F.lit(False)), F.lit("topic ratios")),
        F.when(~F.coalesce(quoted, F.lit(False)), F.lit("quoted opinion"))))
    lacks = F.col("missing")
    status = (F.when((F.size(lacks) == 0) | (F.col(iteration_col) >= max_iterations), F.lit("PASS"))
              .otherwise(F.concat(F.lit("RETRY: missing "), F.array_join(lacks, ", "))))
    return full.withColumn("missing", missing).withColumn("status", status).drop(found, wanted)


def _unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def convert_fences(c) -> Column:
    """Each closed ```...``` block -> its content with newlines as ';' and the
    fences dropped.  Blocks pair up left to right like a lazy regex."""
    parts = F.split(_c(c), "```", -1)
    n = F.size(parts)
    fixed = F.transform(parts, lambda x, i: F.when(i % 2 == 0, x)
                        .when(i < n - 1, F.replace(x, F.lit("\n"), F.lit(";")))
                        .otherwise(F.concat(F.lit("```"), x)))
    return F.array_join(fixed, "")


def fenced_blocks(df: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """Every fenced block as one line (newlines -> ';')."""
    arr = F.regexp_extract_all(F.col(text_col), F.lit(R_FENCE), F.lit(1))
    return df.select(*keys, F.posexplode(arr).alias("pos", "block")).withColumn(
        "block", F.replace(F.col("block"), F.lit("\n"), F.lit(";")))


def report_lines(df: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """Parse a report: fences first, then ``**x**`` -> ``<b>x</b>``, split by
    newline, skip empty lines; classify each line and strip its markers."""
    t = F.regexp_replace(convert_fences(text_col), r"\*\*(.+?)\*\*", "<b>$1</b>")
    x = df.select(*keys, F.posexplode(F.split(t, "\n", -1)).alias("line_no", "raw")).where(F.col("raw") != "")
    first = F.substring("raw", 1, 1)
    kind = (F.when(F.col("raw").contains(K.DIAGRAM_MARKER), F.lit("diagram"))
            .when(first == "*", F.lit("title")).when(first == "#", F.lit("heading")).otherwise(F.lit("body")))
    text = (F.when(kind == "title", F.replace("raw", F.lit("*"), F.lit("")))
            .when(kind == "heading", F.replace("raw", F.lit("#"), F.lit("")))
            .otherwise(F.col("raw")))
    return x.select(*keys, "line_no", kind.alias("kind"), text.alias("text"))


def diagram_urls(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """png and svg links for each diagram line (base64 of its UTF-8 text)."""
    src = F.replace(F.col("text"), F.lit(K.DIAGRAM_MARKER), F.lit(""))
    b64 = base64_utf8(src)
    return lines.where(F.col("kind") == "diagram").select(
        *keys, "line_no", F.concat(F.lit(K.DIAGRAM_PNG_PREFIX), b64).alias("png_url"),
        F.concat(F.lit(K.DIAGRAM_SVG_PREFIX), b64).alias("svg_url"))


def template_defaults(t: DataFrame, min_len: int = K.MIN_TEMPLATE_LEN,
                      defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Resolve template parameters against their ``*_default`` siblings.

    system/prompt shorter than ``min_len`` -> default; company/product info
    defaulted only when both are empty; the conversation prompt defaults only
    when prompt and system are both short.  Builds the crawl instruction,
    the conversation template and the report / document prompts."""
    def short(c):
        return F.coalesce(F.char_length(F.col(c)) < min_len, F.lit(True))

    system = F.when(short("system"), F.col("system_default")).otherwise(F.col("system"))
    prompt = F.when(short("prompt"), F.col("prompt_default")).otherwise(F.col("prompt"))
    both_empty = (F.coalesce(F.col("company_info"), F.lit("")) == "") & (F.coalesce(F.col("product_info"), F.lit("")) == "")
    info = F.when(both_empty, F.concat(F.lit("\n\n"), F.col("company_info_default"), F.lit("\n\n"), F.col("product_info_default"))) \
            .otherwise(F.concat(F.lit("\n\n"), F.coalesce("company_info", F.lit("")), F.lit("\n\n"), F.coalesce("product_info", F.lit(""))))
    crawl = F.concat(F.lit("[INST]<<SYS>>\n"), info, F.lit("\n"), system, F.lit("\n<</SYS>>\n\n"),
                     F.lit("'User: {user_input}' "), prompt, F.lit("[/INST]"))
    conv_prompt = F.when(short("prompt") & short("system"), F.col("prompt_default")).otherwise(F.col("prompt"))
    conversation = F.concat(conv_prompt, F.lit(": {context}\nQuestion: {question}"))
    return t.select("*", crawl.alias("crawl_template"), conversation.alias("conversation_template"),
                    prompt.alias("report_template"), system.alias("standalone_template"))
