"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (or data Spark derives from them); none
filters ids to make the check cheap.  Modulo expressions below only *build*
fixture columns (a user id, a stored subset, a null url) from every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.functions import text as TX
from murmura.plans.sqltext import (WS, q, s_contains_any, s_pct, s_render, s_safe_int, s_tokens,
                                   s_truncate, sstrip)
from murmura.schema import POST_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ views

def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as post records of runs of (user, keyword) stores."""
    d = table(spark, sf_dir, "documents")
    s = F.col("doc_id").cast("string")
    fields = {
        "url": F.concat(F.lit("doc/"), s), "site": F.col("source"), "document": F.col("text"),
        "views": F.col("n_chars").cast("string"), "boardcategory": F.col("source"),
        "documentcategory": F.col("lang"),
    }
    cols = [F.col("doc_id")] + [fields.get(c, F.lit(None).cast("string")).alias(c) for c in POST_COLUMNS]
    cols += [F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string")).alias("user_id"),
             F.col("lang").alias("keyword"),
             F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("T00h00m00s")).alias("run_id")]
    return d.select(*cols)


POSTS = """posts AS (
  SELECT doc_id, 'doc/' || CAST(doc_id AS VARCHAR) AS url, source AS site, text AS document,
         CAST(NULL AS VARCHAR) AS documenttype, CAST(NULL AS VARCHAR) AS postdate,
         CAST(NULL AS VARCHAR) AS likes, CAST(NULL AS VARCHAR) AS dislike,
         CAST(NULL AS VARCHAR) AS comment_cnt, CAST(n_chars AS VARCHAR) AS views,
         source AS boardcategory, lang AS documentcategory,
         'u' || CAST(doc_id % 3 AS VARCHAR) AS user_id, lang AS keyword,
         '2024-01-0' || CAST(doc_id % 5 + 1 AS VARCHAR) || 'T00h00m00s' AS run_id
  FROM documents)"""


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a sentiment label taken from ``labels`` (toxic -> negative,
    quality -> positive, else neutral); unlabelled posts carry a label that
    is none of the three, so they count in the total only."""
    lab = table(spark, sf_dir, "labels")
    s = (F.when(F.col("toxic") == 1, F.lit(K.NEGATIVE)).when(F.col("quality") == 1, F.lit(K.POSITIVE))
         .when(F.col("l_id").isNotNull(), F.lit(K.NEUTRAL)).otherwise(F.lit("unlabelled")))
    return (posts(spark, sf_dir).join(lab.withColumnRenamed("doc_id", "l_id"),
                                      F.col("doc_id") == F.col("l_id"), "left")
            .withColumn("sentiment", s).drop("l_id", "quality", "toxic"))


LABELED = POSTS + f""",
labeled AS (
  SELECT p.*, CASE WHEN l.toxic = 1 THEN {q(K.NEGATIVE)} WHEN l.quality = 1 THEN {q(K.POSITIVE)}
                   WHEN l.doc_id IS NOT NULL THEN {q(K.NEUTRAL)} ELSE 'unlabelled' END AS sentiment
  FROM posts p LEFT JOIN labels l ON p.doc_id = l.doc_id)"""

VALID = f"document IS NOT NULL AND {sstrip('document')} <> ''"

# ---------------------------------------------- 1. minimum end-to-end slice

CATEGORY_TERMS = ["src1", "de"]


@register("valid_posts", f"WITH {POSTS} SELECT doc_id, url, site, views FROM posts WHERE {VALID}")
def q_valid_posts(spark, sf):
    from murmura.operators.filters import valid_posts
    return valid_posts(posts(spark, sf)).select("doc_id", "url", "site", "views")


@register("exclude_categories", f"""WITH {POSTS}
SELECT doc_id, boardcategory, documentcategory FROM posts
WHERE {VALID} AND NOT {s_contains_any("coalesce(boardcategory, '')", CATEGORY_TERMS)}
  AND NOT {s_contains_any("coalesce(documentcategory, '')", CATEGORY_TERMS)}""")
def q_exclude_categories(spark, sf):
    from murmura.operators.filters import exclude_categories, valid_posts
    return (exclude_categories(valid_posts(posts(spark, sf)), CATEGORY_TERMS)
            .select("doc_id", "boardcategory", "documentcategory"))


SENTIMENT_SUMMARY_SQL = f"""summary AS (
  SELECT user_id, keyword, total,
         pos, {s_pct('pos', 'total')} AS pos_pct,
         neg, {s_pct('neg', 'total')} AS neg_pct,
         neu, {s_pct('neu', 'total')} AS neu_pct
  FROM (SELECT user_id, keyword, count(*) AS total,
               count(*) FILTER (WHERE sentiment = {q(K.POSITIVE)}) AS pos,
               count(*) FILTER (WHERE sentiment = {q(K.NEGATIVE)}) AS neg,
               count(*) FILTER (WHERE sentiment = {q(K.NEUTRAL)}) AS neu
        FROM labeled GROUP BY user_id, keyword))"""


@register("sentiment_summary", f"WITH {LABELED}, {SENTIMENT_SUMMARY_SQL} SELECT * FROM summary")
def q_sentiment_summary(spark, sf):
    from murmura.operators.sentiment import sentiment_summary
    return sentiment_summary(labeled(spark, sf), "sentiment")


# ------------------------------------------------ 2. rankings and text

TOP_SQL = f"""tops AS (
  SELECT user_id, keyword, sentiment, doc_id, views_n, opinion,
         row_number() OVER (PARTITION BY user_id, keyword, sentiment ORDER BY views_n DESC, doc_id) AS rank
  FROM (SELECT user_id, keyword, sentiment, doc_id, {s_safe_int('views')} AS views_n,
               substr(document, 1, 200) AS opinion
        FROM labeled WHERE sentiment IN ({q(K.POSITIVE)}, {q(K.NEGATIVE)}))
  WHERE NOT {s_contains_any('opinion', K.PROFANITY)}
  QUALIFY rank <= 3)"""


@register("top_opinions", f"""WITH {LABELED}, {TOP_SQL}
SELECT user_id, keyword, sentiment, doc_id, views_n, opinion, CAST(rank AS INTEGER) AS rank FROM tops""")
def q_top_opinions(spark, sf):
    from murmura.operators.sentiment import top_opinions
    return top_opinions(labeled(spark, sf), "sentiment").select(
        "user_id", "keyword", "sentiment", "doc_id", "views_n", "opinion", "rank")


@register("sentiment_text", f"""WITH {POSTS}
SELECT doc_id, {sstrip("replace(replace(substr(document, 1, 300), chr(0), ''), chr(13), ' ')")} AS text300
FROM posts""")
def q_sentiment_text(spark, sf):
    return posts(spark, sf).select("doc_id", TX.prep_for_sentiment("document").alias("text300"))


@register("truncate_docs", f"WITH {POSTS} SELECT doc_id, {s_truncate('document')} AS text FROM posts")
def q_truncate_docs(spark, sf):
    return posts(spark, sf).select("doc_id", TX.truncate_ellipsis("document").alias("text"))


@register("format_documents", f"""WITH {POSTS}
SELECT doc_id, {s_render(K.REPORT_DOCUMENT_TEMPLATE, page_content=s_truncate('document'))} AS formatted
FROM posts""")
def q_format_documents(spark, sf):
    return posts(spark, sf).select("doc_id", TX.render(
        K.REPORT_DOCUMENT_TEMPLATE, page_content=TX.truncate_ellipsis("document")).alias("formatted"))


@register("clean_str", f"""WITH {POSTS}
SELECT doc_id, {sstrip("replace(replace(replace(coalesce(document, ''), chr(10), ''), chr(9), ''), chr(160), ' ')")} AS cleaned
FROM posts""")
def q_clean_str(spark, sf):
    return posts(spark, sf).select("doc_id", TX.clean_str("document").alias("cleaned"))


DATE_RAW_SQL = ("document || '  수정일 :  2024-01-0' || CAST(doc_id % 5 + 1 AS VARCHAR) "
                "|| ' 03:04:05' || chr(160) || ' '")


@register("clean_date", f"""WITH {POSTS}
SELECT doc_id, {sstrip(f"regexp_replace({DATE_RAW_SQL}, '{WS}*수정일{WS}*:{WS}*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}', '', 'g')")} AS postdate
FROM posts""")
def q_clean_date(spark, sf):
    raw = F.concat("document", F.lit("  수정일 :  2024-01-0"),
                   (F.col("doc_id") % 5 + 1).cast("string"), F.lit(" 03:04:05\u00a0 "))
    return posts(spark, sf).select("doc_id", TX.clean_date(raw).alias("postdate"))


BOARD_RAW_SQL = "CAST(doc_id AS VARCHAR) || '  ' || site || '   - ' || keyword"


@register("clean_board", f"""WITH {POSTS}
SELECT doc_id, split_part({sstrip(f"regexp_replace({BOARD_RAW_SQL}, '^[0-9]+{WS}*|{WS}{{2,}}', ' ', 'g')")}, '-', 1) AS board
FROM posts""")
def q_clean_board(spark, sf):
    raw = F.concat(F.col("doc_id").cast("string"), F.lit("  "), F.col("site"), F.lit("   - "), F.col("keyword"))
    return posts(spark, sf).select("doc_id", TX.clean_board(raw).alias("board"))


@register("collapse_ws", f"WITH {POSTS} SELECT doc_id, regexp_replace(document, '{WS}+', ' ', 'g') AS text FROM posts")
def q_collapse_ws(spark, sf):
    return posts(spark, sf).select("doc_id", TX.collapse_ws("document").alias("text"))


@register("head_sample", f"WITH {POSTS} SELECT doc_id, url FROM posts ORDER BY doc_id LIMIT 20")
def q_head_sample(spark, sf):
    # a sample for estimates: the limit is the feature
    return posts(spark, sf).select("doc_id", "url").orderBy("doc_id").limit(20)


# ------------------------------------------------------------ 3. ingest

@register("merge_sites", f"""WITH {POSTS}
SELECT doc_id, site, url, documentcategory FROM posts WHERE keyword = 'en'
UNION ALL SELECT doc_id, site, url, NULL FROM posts WHERE keyword <> 'en'""")
def q_merge_sites(spark, sf):
    from murmura.operators.store import merge_sites
    p = posts(spark, sf).select("doc_id", "site", "url", "documentcategory", "keyword")
    a = p.where(F.col("keyword") == "en").drop("keyword")
    b = p.where(F.col("keyword") != "en").drop("keyword", "documentcategory")  # one site lacks a column
    c = p.where(F.lit(False)).drop("keyword")                                  # an empty site
    return merge_sites([a, b, c])


EXCLUDED_SITES = ["src1", "src2"]


@register("exclude_sites", f"""WITH {POSTS}
SELECT doc_id, site FROM posts WHERE site IS NULL OR site NOT IN ({', '.join(q(s) for s in EXCLUDED_SITES)})""")
def q_exclude_sites(spark, sf):
    from murmura.operators.filters import exclude_sites
    return exclude_sites(posts(spark, sf), EXCLUDED_SITES).select("doc_id", "site")


@register("run_row_counts", f"""WITH {POSTS}
SELECT user_id, keyword, run_id, count(*) AS n_rows FROM posts GROUP BY user_id, keyword, run_id""")
def q_run_row_counts(spark, sf):
    """Land the runs as a partitioned table, scan it back, count per run."""
    from murmura.operators.store import read_runs, run_row_counts, write_runs
    from murmura.session import work_dir
    path = work_dir(spark, "runs") + "/posts_merged"
    write_runs(posts(spark, sf), path)
    return run_row_counts(read_runs(spark, path))


@register("latest_run", f"""WITH {POSTS},
latest AS (SELECT user_id, keyword, max(run_id) AS run_id FROM posts GROUP BY user_id, keyword)
SELECT p.user_id, p.keyword, p.run_id, count(*) AS n_rows
FROM posts p SEMI JOIN latest l ON p.user_id = l.user_id AND p.keyword = l.keyword AND p.run_id = l.run_id
GROUP BY p.user_id, p.keyword, p.run_id""")
def q_latest_run(spark, sf):
    from murmura.operators.store import retain_latest_run
    kept = retain_latest_run(posts(spark, sf))
    return kept.groupBy("user_id", "keyword", "run_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("run_id_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%Hh%Mm%Ss') AS run_id FROM events")
def q_run_id_format(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", K.RUN_ID_PATTERN).alias("run_id"))


@register("csv_roundtrip", f"""WITH {POSTS}
SELECT url, site, document, documenttype, views, boardcategory, documentcategory FROM posts""")
def q_csv_roundtrip(spark, sf):
    """Export post records as CSV (newlines, commas, quotes inside fields) and
    read them back with the fixed schema."""
    from murmura.session import work_dir
    from murmura.sources.posts import export_csv, read_posts_csv
    path = work_dir(spark, "csv") + "/A_site"
    export_csv(posts(spark, sf).select(*POST_COLUMNS), path)
    back = read_posts_csv(spark, path + "/*.csv")
    return back.select("url", "site", "document", "documenttype", "views", "boardcategory", "documentcategory")


@register("normalize_reviews", f"""
SELECT doc_id, 'app/' || source AS url, 'app_store' AS site, line AS document,
       CAST(NULL AS VARCHAR) AS documenttype,
       CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(i) AS VARCHAR) AS postdate,
       CAST(i AS VARCHAR) AS likes, CAST(NULL AS VARCHAR) AS dislike, CAST(NULL AS VARCHAR) AS comment_cnt,
       CAST(NULL AS VARCHAR) AS views, CAST(NULL AS VARCHAR) AS boardcategory,
       CAST(NULL AS VARCHAR) AS documentcategory
FROM (SELECT doc_id, source, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))""")
def q_normalize_reviews(spark, sf):
    """Each document is an app with its lines as a nested review list."""
    from murmura.sources.reviews import normalize_reviews
    d = table(spark, sf, "documents")
    reviews = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        x.alias("content"), i.cast("long").alias("thumbsUpCount"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=i)).alias("at")))
    apps = d.select("doc_id", F.concat(F.lit("app/"), F.col("source")).alias("app_url"), reviews.alias("reviews"))
    return normalize_reviews(apps, keep=["doc_id", "app_url"], url=F.col("app_url"),
                             site=F.lit("app_store")).drop("app_url")


@register("prompt_column", f"""WITH {POSTS}
SELECT doc_id, {s_render(K.RELEVANCE_PROMPT, keyword='keyword', text='document')} AS prompt FROM posts""")
def q_prompt_column(spark, sf):
    return posts(spark, sf).select("doc_id", TX.render(K.RELEVANCE_PROMPT, keyword="keyword", text="document").alias("prompt"))


@register("sentiment_prompt", f"""WITH {POSTS}
SELECT doc_id, {s_render(K.SENTIMENT_PROMPT, keyword='keyword', text=sstrip("replace(replace(substr(document, 1, 300), chr(0), ''), chr(13), ' ')"))} AS prompt
FROM posts""")
def q_sentiment_prompt(spark, sf):
    """The sentiment instruction for every stored post (batch-inference input)."""
    return posts(spark, sf).select("doc_id", TX.render(
        K.SENTIMENT_PROMPT, keyword="keyword", text=TX.prep_for_sentiment("document")).alias("prompt"))


RELEVANCE_EXCLUDE = ["ouch", "sch"]
RELEVANCE_YES = " Yes, relevant"


def relevance_scorer():
    from murmura.operators.scoring import RuleRelevance
    return RuleRelevance(exclude=RELEVANCE_EXCLUDE, yes=RELEVANCE_YES, no="no")


REL_LABEL_SQL = (f"CASE WHEN document IS NULL THEN NULL "
                 f"WHEN coalesce(contains(lower(document), lower(keyword)), FALSE) "
                 f"AND NOT {s_contains_any('lower(document)', RELEVANCE_EXCLUDE)} "
                 f"THEN {q(RELEVANCE_YES)} ELSE 'no' END")
IS_YES_SQL = f"coalesce(starts_with(lower({sstrip('relevance')}), 'yes'), FALSE)"
SCORED = POSTS + f""",
valid AS (SELECT * FROM posts WHERE {VALID}),
scored AS (SELECT *, {REL_LABEL_SQL} AS relevance FROM valid)"""


@register("relevance_filter", f"WITH {SCORED} SELECT doc_id, url, relevance FROM scored WHERE {IS_YES_SQL}")
def q_relevance_filter(spark, sf):
    from murmura.operators.filters import relevance_filter, valid_posts
    from murmura.operators.scoring import score
    s = score(valid_posts(posts(spark, sf)), relevance_scorer(), "document", "relevance", "keyword")
    return relevance_filter(s).select("doc_id", "url", "relevance")


@register("pass_rate", f"""WITH {SCORED}
SELECT keyword, count(*) AS n, round(avg(CASE WHEN {IS_YES_SQL} THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM scored GROUP BY keyword""")
def q_pass_rate(spark, sf):
    from murmura.operators.filters import is_yes, valid_posts
    from murmura.operators.scoring import score
    s = score(valid_posts(posts(spark, sf)), relevance_scorer(), "document", "relevance", "keyword")
    return s.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(
        F.coalesce(is_yes("relevance"), F.lit(False)).cast("double")), 6).alias("pass_rate"))


INGEST_CATEGORIES = ["src1"]


def stored_fixture(p: DataFrame) -> DataFrame:
    """The store before this run: every fourth post, with some null urls."""
    return (p.where(F.col("doc_id") % 4 == 0)
            .withColumn("url", F.when(F.col("doc_id") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("url"))))


def batch_fixture(p: DataFrame) -> DataFrame:
    return p.withColumn("url", F.when(F.col("doc_id") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("url")))


STORE_SQL = POSTS + """,
stored AS (SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN NULL ELSE url END AS url) FROM posts WHERE doc_id % 4 = 0),
batch AS (SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN NULL ELSE url END AS url) FROM posts)"""

INGEST_SQL = STORE_SQL + f""",
valid AS (SELECT * FROM batch WHERE {VALID}
          AND NOT {s_contains_any("coalesce(boardcategory, '')", INGEST_CATEGORIES)}
          AND NOT {s_contains_any("coalesce(documentcategory, '')", INGEST_CATEGORIES)}),
scored AS (SELECT *, {REL_LABEL_SQL} AS relevance FROM valid),
relevant AS (SELECT * FROM scored WHERE {IS_YES_SQL}),
added AS (SELECT * FROM relevant r WHERE NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.user_id = r.user_id AND s.keyword = r.keyword
      AND (s.url IS NULL OR s.url <> '') AND s.url IS NOT DISTINCT FROM r.url))"""


def ingest_relevant(spark, sf):
    from murmura.plans.ingest import filter_relevant
    return filter_relevant(batch_fixture(posts(spark, sf)), relevance_scorer(), INGEST_CATEGORIES)


@register("ingest_flow", f"WITH {INGEST_SQL} SELECT user_id, keyword, doc_id, url, site, views FROM added")
def q_ingest_flow(spark, sf):
    """valid -> category -> relevance -> anti join with the store."""
    from murmura.operators.store import anti_by_url
    new = anti_by_url(ingest_relevant(spark, sf), stored_fixture(posts(spark, sf)))
    return new.select("user_id", "keyword", "doc_id", "url", "site", "views")


@register("ingest_metrics", f"""WITH {INGEST_SQL}
SELECT r.user_id, r.keyword, r.total_filtered, coalesce(a.added, 0) AS added
FROM (SELECT user_id, keyword, count(*) AS total_filtered FROM relevant GROUP BY ALL) r
LEFT JOIN (SELECT user_id, keyword, count(*) AS added FROM added GROUP BY ALL) a
  ON r.user_id = a.user_id AND r.keyword = a.keyword""")
def q_ingest_metrics(spark, sf):
    from murmura.plans.ingest import ingest_metrics
    return ingest_metrics(ingest_relevant(spark, sf), stored_fixture(posts(spark, sf)))


# ------------------------------------------------------------- 4. store

@register("to_document", f"WITH {POSTS} SELECT doc_id, document AS page_content, url, site, views FROM posts")
def q_to_document(spark, sf):
    from murmura.operators.filters import to_document
    d = to_document(posts(spark, sf).select("doc_id", "url", "site", "views", "document"))
    return d.select(F.col("metadata.doc_id").alias("doc_id"), "page_content", "metadata.url",
                    "metadata.site", "metadata.views")


@register("store_merge", f"""WITH {STORE_SQL},
added AS (SELECT * FROM batch b WHERE {VALID} AND NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.user_id = b.user_id AND s.keyword = b.keyword
      AND (s.url IS NULL OR s.url <> '') AND s.url IS NOT DISTINCT FROM b.url))
SELECT user_id, keyword, doc_id, url FROM stored UNION ALL SELECT user_id, keyword, doc_id, url FROM added""")
def q_store_merge(spark, sf):
    """Write a store, append a batch (null urls on both sides), read it back."""
    from murmura.operators.store import VectorStore
    from murmura.session import work_dir
    p = posts(spark, sf)
    vs = VectorStore(spark, work_dir(spark, "store"))
    vs.overwrite(stored_fixture(p))
    vs.append_new(batch_fixture(p))
    return vs.read().select("user_id", "keyword", "doc_id", "url")


@register("store_overwrite", f"""WITH {POSTS}
SELECT user_id, keyword, doc_id, 64 AS n_dims FROM posts WHERE document IS NOT NULL""")
def q_store_overwrite(spark, sf):
    """Replace stores twice (the second write must not duplicate rows)."""
    from murmura.operators.store import VectorStore
    from murmura.session import work_dir
    p = posts(spark, sf)
    vs = VectorStore(spark, work_dir(spark, "store"))
    vs.overwrite(p)
    vs.overwrite(p)
    return vs.read().select("user_id", "keyword", "doc_id", F.size("embedding").alias("n_dims"))


def history_keyword():
    """Keyword of the store a conversation belongs to (built from conv_id)."""
    return F.element_at(F.array(*[F.lit(x) for x in ["en", "fr", "de", "es", "it"]]),
                        (F.col("conv_id") % 5 + 1).cast("int"))
HISTORY_KEYWORD_SQL = "['en', 'fr', 'de', 'es', 'it'][conv_id % 5 + 1]"


@register("store_delete_status", f"""WITH {POSTS},
s AS (SELECT DISTINCT user_id, keyword FROM posts WHERE keyword <> 'es'),
h AS (SELECT DISTINCT 'u' || CAST(conv_id % 3 AS VARCHAR) AS user_id, {HISTORY_KEYWORD_SQL} AS keyword FROM conversations),
r AS (SELECT * FROM s UNION SELECT * FROM h)
SELECT r.user_id, r.keyword,
       CASE WHEN s.user_id IS NOT NULL AND h.user_id IS NOT NULL THEN 'delete success'
            ELSE 'abnormal delete request' END AS status
FROM r LEFT JOIN s ON r.user_id = s.user_id AND r.keyword = s.keyword
       LEFT JOIN h ON r.user_id = h.user_id AND r.keyword = h.keyword""")
def q_store_delete_status(spark, sf):
    from murmura.operators.store import delete_status
    stores = posts(spark, sf).where(F.col("keyword") != "es").select("user_id", "keyword")
    hist = table(spark, sf, "conversations").select(
        F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")).alias("user_id"), history_keyword().alias("keyword"))
    return delete_status(stores.unionByName(hist), stores, hist)


@register("list_keywords", f"WITH {POSTS} SELECT DISTINCT user_id, keyword FROM posts")
def q_list_keywords(spark, sf):
    """The stores that exist, from their folders."""
    from murmura.operators.store import VectorStore
    from murmura.session import work_dir
    vs = VectorStore(spark, work_dir(spark, "store"))
    vs.overwrite(posts(spark, sf))
    return vs.keywords()


EMBED_DIM = 64


@register("hash_embed", f"""
SELECT doc_id, bucket, count(*) AS cnt
FROM (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 7))::BIGINT % {EMBED_DIM} AS INTEGER) AS bucket
      FROM (SELECT doc_id, unnest({s_tokens('text')}) AS t FROM documents))
GROUP BY doc_id, bucket""")
def q_hash_embed(spark, sf):
    """Hashed bag-of-words counts, long form (non-zero buckets)."""
    from murmura.operators.scoring import HashEmbedder
    d = table(spark, sf, "documents")
    v = HashEmbedder(EMBED_DIM).counts_column(F.col("text"))
    return (d.select("doc_id", F.posexplode(v).alias("bucket", "cnt"))
            .where(F.col("cnt") > 0).select("doc_id", "bucket", F.col("cnt").cast("long").alias("cnt")))


# ----------------------------------------------------------- 5. vectors

EMB_SQL = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ex AS (SELECT vec_id, label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
cents AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i) GROUP BY label)"""


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def label_centroids(spark, sf) -> DataFrame:
    from murmura.operators.vectors import centroids_by
    return centroids_by(embeddings(spark, sf), "label")


@register("l2_normalize", """
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(x / nrm AS FLOAT) AS DOUBLE), 6) AS val
FROM (SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS pos, unnest(v) AS x,
             sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nrm
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def q_l2_normalize(spark, sf):
    from murmura.operators.vectors import l2_normalize
    e = embeddings(spark, sf)
    return e.select("vec_id", F.posexplode(l2_normalize("embedding")).alias("pos", "x")).select(
        "vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("val"))


def _knn_sql(k: int) -> str:
    return f"""WITH {EMB_SQL}
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM (
  SELECT c.label AS qid, e.vec_id, list_distance(e.v, c.c) AS dist,
         row_number() OVER (PARTITION BY c.label ORDER BY list_distance(e.v, c.c), e.vec_id) AS rank
  FROM e, cents c) WHERE rank <= {k}"""


def _knn(spark, sf, k):
    from murmura.operators.vectors import knn_topk
    qs = label_centroids(spark, sf).select(F.col("label").alias("qid"), F.col("centroid").alias("embedding"))
    r = knn_topk(embeddings(spark, sf), qs, k, doc_id="vec_id")
    return r.select("qid", "rank", "vec_id", F.round("dist", 6).alias("dist"))


@register("knn_topk", _knn_sql(4))
def q_knn_topk(spark, sf):
    """Exact 4 nearest vectors of each label centroid (the chat default k)."""
    return _knn(spark, sf, 4)


@register("knn_top30", _knn_sql(30))
def q_knn_top30(spark, sf):
    """Exact 30 nearest vectors of each label centroid (the report k)."""
    return _knn(spark, sf, 30)


@register("knn_join", f"""WITH {EMB_SQL}
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM (
  SELECT q.vec_id AS qid, e.vec_id, list_distance(e.v, q.v) AS dist,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.v, q.v), e.vec_id) AS rank
  FROM e, e q) WHERE rank <= 5""")
def q_knn_join(spark, sf):
    """The 5 nearest vectors of every vector: queries as many as the vectors, so
    both sides are shuffled to pivot cells."""
    from murmura.operators.pivots import pivot_knn
    e = embeddings(spark, sf)
    r = pivot_knn(e, e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 5, doc_id="vec_id", doc_vec="embedding",
                  qid="qid", query_vec="q", cell=64)
    return r.select("qid", "rank", "vec_id", F.round("dist", 6).alias("dist"))


@register("multi_query_topk", f"""WITH {EMB_SQL},
vex AS (SELECT label, vec_id % 3 AS variant, i, avg(x) AS m FROM ex GROUP BY label, vec_id % 3, i),
variants AS (SELECT label AS parent_qid, variant, list(m ORDER BY i) AS c FROM vex GROUP BY label, variant),
hits AS (SELECT * FROM (
  SELECT q.parent_qid, q.variant, e.vec_id, list_distance(e.v, q.c) AS dist,
         row_number() OVER (PARTITION BY q.parent_qid, q.variant ORDER BY list_distance(e.v, q.c), e.vec_id) AS rank
  FROM e, variants q) WHERE rank <= 4),
firsts AS (SELECT parent_qid, vec_id, min((variant, rank)) AS m, arg_min(dist, (variant, rank)) AS dist
           FROM hits GROUP BY parent_qid, vec_id)
SELECT parent_qid, CAST(row_number() OVER (PARTITION BY parent_qid ORDER BY m.variant, m.rank, vec_id) AS INTEGER) AS ord,
       vec_id, m.variant AS variant, CAST(m.rank AS INTEGER) AS rank, round(dist, 6) AS dist
FROM (SELECT parent_qid, vec_id, struct_pack(variant := m[1], rank := m[2]) AS m, dist FROM firsts)""")
def q_multi_query_topk(spark, sf):
    """Three variants per question (label): union of their top-4, first seen."""
    from murmura.operators.vectors import centroids_by, multi_query_topk
    e = embeddings(spark, sf)
    v = (centroids_by(e.withColumn("variant", F.col("vec_id") % 3)
                      .withColumn("key", F.struct(F.col("label"), F.col("variant"))), "key")
         .select(F.col("key.label").alias("parent_qid"), F.col("key.variant").alias("variant"),
                 F.col("centroid").alias("embedding")))
    r = multi_query_topk(e, v, 4, doc_id="vec_id")
    return r.select("parent_qid", "ord", "vec_id", "variant", "rank", F.round("dist", 6).alias("dist"))


@register("centroid_assign", f"""WITH {EMB_SQL}
SELECT vec_id, label, round(dist, 6) AS dist FROM (
  SELECT e.vec_id, c.label, list_distance(e.v, c.c) AS dist,
         row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.v, c.c), c.label) AS r
  FROM e, cents c) WHERE r = 1""")
def q_centroid_assign(spark, sf):
    from murmura.operators.vectors import centroid_assign
    e = embeddings(spark, sf)
    r = centroid_assign(e, label_centroids(spark, sf))
    return r.select("vec_id", "label", F.round("dist", 6).alias("dist"))


def stored_posts(spark, sf) -> DataFrame:
    """Every post with its sentiment, the vector of its whole text and the
    nearest label centroid as its cluster: embedded and written once, read back
    by every branch of a plan (each reads only its columns)."""
    from murmura.operators.scoring import HashEmbedder
    from murmura.operators.vectors import nearest_label
    from murmura.session import work_dir
    path = work_dir(spark, "stored")
    p = labeled(spark, sf).withColumn("embedding", HashEmbedder(EMBED_DIM).column(F.col("document")))
    p = p.withColumn("cluster", nearest_label("embedding", label_centroids(spark, sf)))
    p.write.parquet(path)
    return spark.read.schema(p.schema).parquet(path)


# the same vectors by hand: token counts by bucket over their length
VECTORS_SQL = f"""{EMB_SQL}, {POSTS},
tok AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 7))::BIGINT % {EMBED_DIM} AS INTEGER) AS b, count(*) AS n
        FROM (SELECT doc_id, unnest({s_tokens('document')}) AS t FROM posts) GROUP BY ALL),
len AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM tok GROUP BY doc_id),
sv AS (SELECT p.*, vv.v FROM posts p JOIN (
         SELECT g.doc_id, list(CASE WHEN l > 0 THEN CAST(CAST(coalesce(n, 0) / l AS FLOAT) AS DOUBLE) ELSE 0.0 END ORDER BY g.b) AS v
         FROM (SELECT doc_id, unnest(range({EMBED_DIM})) AS b FROM posts) g LEFT JOIN tok ON tok.doc_id = g.doc_id AND tok.b = g.b
              LEFT JOIN len ON len.doc_id = g.doc_id GROUP BY g.doc_id) vv USING (doc_id))"""


@register("retrieve_context", f"""WITH {VECTORS_SQL},
hits AS (SELECT * FROM (
  SELECT c.label AS qid, sv.doc_id,
         row_number() OVER (PARTITION BY c.label ORDER BY list_distance(sv.v, c.c), sv.doc_id) AS rank
  FROM sv, cents c) WHERE rank <= 4),
docs AS (SELECT h.qid, h.rank, {s_render(K.CHAT_DOCUMENT_TEMPLATE, page_content='d.text', postdate='NULL')} AS t
         FROM hits h JOIN documents d USING (doc_id))
SELECT c.label AS qid, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY rank), '') AS context
FROM cents c LEFT JOIN docs ON docs.qid = c.label GROUP BY c.label""")
def q_retrieve_context(spark, sf):
    """Top-4 documents per question formatted and joined with blank lines;
    a question without documents gets an empty context."""
    from murmura.plans.retrieval import retrieve_context
    qs = label_centroids(spark, sf).select(F.col("label").alias("qid"), F.col("centroid").alias("embedding"))
    from murmura.operators.scoring import HashEmbedder
    p = posts(spark, sf)            # one pass over vectors: nothing is written, the hits alone are fetched
    store = p.select("doc_id", "document", "postdate", HashEmbedder(EMBED_DIM).column(F.col("document")).alias("embedding"))
    return retrieve_context(qs, store, k=4)


# ------------------------------------------------------------- 6. topics

CLUSTERED_SQL = VECTORS_SQL + """,
clustered AS (
  SELECT sv.*, cluster FROM sv JOIN (
    SELECT doc_id, arg_min(label, (dist, label)) AS cluster
    FROM (SELECT sv.doc_id, c.label, list_distance(sv.v, c.c) AS dist FROM sv, cents c) GROUP BY doc_id) USING (doc_id))"""

TERMS_SQL = f"""tf AS (SELECT user_id, keyword, cluster, t AS term, count(*) AS tf
       FROM (SELECT user_id, keyword, cluster, unnest({s_tokens('document')}) AS t FROM clustered) GROUP BY ALL),
dfreq AS (SELECT user_id, keyword, term, count(*) AS df FROM tf GROUP BY ALL),
nc AS (SELECT user_id, keyword, count(DISTINCT cluster) AS n_clusters FROM clustered GROUP BY ALL),
sc AS (SELECT tf.user_id, tf.keyword, tf.cluster, tf.term, round(tf.tf * ln(nc.n_clusters / dfreq.df), 9) AS score
       FROM tf JOIN dfreq USING (user_id, keyword, term) JOIN nc USING (user_id, keyword)),
topt AS (SELECT *, row_number() OVER (PARTITION BY user_id, keyword, cluster ORDER BY score DESC, term) AS rn
         FROM sc WHERE score > 0 QUALIFY rn <= 3),
runs AS (SELECT user_id, keyword, cluster, rn, term,
                string_agg(term, ' ') OVER (PARTITION BY user_id, keyword, cluster ORDER BY rn) AS topic FROM topt),
names AS (SELECT user_id, keyword, cluster,
                 coalesce(max_by(topic, rn) FILTER (WHERE length(topic) <= {K.TOPIC_MAX_NAME_LEN}),
                          substr(min_by(term, rn), 1, {K.TOPIC_MAX_NAME_LEN})) AS topic FROM runs GROUP BY ALL)"""

TOPIC_TABLE_SQL = CLUSTERED_SQL + ",\n" + TERMS_SQL + f""",
sizes AS (SELECT user_id, keyword, cluster, count(*) AS count, min(doc_id) AS min_pos FROM clustered GROUP BY ALL),
sizes2 AS (SELECT *, round(100.0::DOUBLE * count / sum(count) OVER (PARTITION BY user_id, keyword), 1) AS pct FROM sizes),
samples AS (SELECT user_id, keyword, cluster, list(content ORDER BY rn) AS samples
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id, keyword, cluster ORDER BY doc_id) AS rn
                  FROM (SELECT user_id, keyword, cluster, doc_id, {sstrip('document')} AS content FROM clustered)
                  WHERE content <> '' QUALIFY rn <= 3)
            GROUP BY ALL),
tt AS (SELECT s.*, coalesce(n.topic, 'topic ' || CAST(s.cluster AS VARCHAR)) AS topic, sm.samples
       FROM sizes2 s JOIN samples sm USING (user_id, keyword, cluster) LEFT JOIN names n USING (user_id, keyword, cluster)),
topics AS (SELECT *, row_number() OVER (PARTITION BY user_id, keyword ORDER BY count DESC, min_pos) AS rank
           FROM tt WHERE NOT {s_contains_any('topic', K.TOPIC_DROP_MARKERS)} AND length(topic) <= {K.TOPIC_MAX_NAME_LEN})"""


def topic_table_df(c: DataFrame) -> DataFrame:
    from murmura.operators.topics import cluster_samples, cluster_sizes, topic_table, topic_terms
    return topic_table(cluster_sizes(c), cluster_samples(c), topic_terms(c))


@register("topic_cluster")
def q_topic_cluster(spark, sf):
    """KMeans (k = min(10, n), seed 42) on normalised vectors; rows-only (ids
    are implementation specific; invariants are unit-tested)."""
    from murmura.operators.vectors import topic_cluster
    return topic_cluster(embeddings(spark, sf), 10, id_col="vec_id")


@register("topic_terms", f"WITH {CLUSTERED_SQL}, {TERMS_SQL} SELECT user_id, keyword, cluster, topic FROM names")
def q_topic_terms(spark, sf):
    from murmura.operators.topics import topic_terms
    return topic_terms(stored_posts(spark, sf)).select("user_id", "keyword", "cluster", "topic")


@register("topic_table", f"""WITH {TOPIC_TABLE_SQL}
SELECT user_id, keyword, cluster, topic, count, pct, array_to_string(samples, ' | ') AS samples,
       CAST(rank AS INTEGER) AS rank FROM topics""")
def q_topic_table(spark, sf):
    t = topic_table_df(stored_posts(spark, sf))
    return t.select("user_id", "keyword", "cluster", "topic", "count", "pct",
                    F.array_join("samples", " | ").alias("samples"), "rank")


TOPIC_TEXT_SQL = f"""topic_text AS (
  SELECT user_id, keyword,
         '[토픽 클러스터링 결과 - 상위 ' || CAST(count(*) AS VARCHAR) || '개 주제]' || chr(10) ||
         string_agg({s_render(K.TOPIC_LINE, i='rank', topic='topic', count='count', pct='pct')}, chr(10) ORDER BY rank)
         AS topic_text
  FROM topics GROUP BY user_id, keyword)"""


@register("topic_summary_text", f"WITH {TOPIC_TABLE_SQL}, {TOPIC_TEXT_SQL} SELECT * FROM topic_text")
def q_topic_summary_text(spark, sf):
    from murmura.operators.topics import topic_summary_text
    return topic_summary_text(topic_table_df(stored_posts(spark, sf)))


def _lines_sql(label):
    return (f"coalesce((SELECT string_agg('- ' || opinion, chr(10) ORDER BY rank) FROM tops t "
            f"WHERE t.user_id = s.user_id AND t.keyword = s.keyword AND t.sentiment = {q(label)}), '')")


SENTIMENT_TEXT_SQL = f"""sentiment_text AS (
  SELECT user_id, keyword, chr(10) || {s_render(K.SENTIMENT_HEADER, total='total')} || chr(10) ||
         {s_render(K.SENTIMENT_LINE, name=q(K.POSITIVE), n='pos', pct='pos_pct')} || chr(10) ||
         {s_render(K.SENTIMENT_LINE, name=q(K.NEGATIVE), n='neg', pct='neg_pct')} || chr(10) ||
         {s_render(K.SENTIMENT_LINE, name=q(K.NEUTRAL), n='neu', pct='neu_pct')} || chr(10) || chr(10) ||
         {q(K.TOP_POS_HEADER)} || chr(10) || {_lines_sql(K.POSITIVE)} || chr(10) || chr(10) ||
         {q(K.TOP_NEG_HEADER)} || chr(10) || {_lines_sql(K.NEGATIVE)} || chr(10) AS sentiment_text
  FROM summary s)"""


def sentiment_text_df(lab: DataFrame) -> DataFrame:
    from murmura.operators.sentiment import sentiment_summary, sentiment_text, top_opinions
    return sentiment_text(sentiment_summary(lab), top_opinions(lab))


@register("sentiment_summary_text",
          f"WITH {LABELED}, {SENTIMENT_SUMMARY_SQL}, {TOP_SQL}, {SENTIMENT_TEXT_SQL} SELECT * FROM sentiment_text")
def q_sentiment_summary_text(spark, sf):
    return sentiment_text_df(labeled(spark, sf))


LEX_POS, LEX_NEG = ["the", "of"], ["der", "la"]


@register("lexicon_sentiment", f"""
SELECT doc_id, pos_hits, neg_hits,
       CASE WHEN text IS NULL THEN {q(K.NEUTRAL)} WHEN pos_hits > neg_hits THEN {q(K.POSITIVE)}
            WHEN neg_hits > pos_hits THEN {q(K.NEGATIVE)} ELSE {q(K.NEUTRAL)} END AS label
FROM (SELECT doc_id, text,
             CAST(len(list_filter({s_tokens('text')}, lambda t: t IN ({', '.join(q(t) for t in LEX_POS)}))) AS INTEGER) AS pos_hits,
             CAST(len(list_filter({s_tokens('text')}, lambda t: t IN ({', '.join(q(t) for t in LEX_NEG)}))) AS INTEGER) AS neg_hits
      FROM documents)""")
def q_lexicon_sentiment(spark, sf):
    from murmura.operators.scoring import LexiconSentiment
    sc = LexiconSentiment(LEX_POS, LEX_NEG)
    pos, neg = sc.hits(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", pos.alias("pos_hits"), neg.alias("neg_hits"), sc.column(F.col("text")).alias("label"))


# -------------------------------------------------------------- 7. pages

from murmura.functions import html as H  # noqa: E402
from murmura.operators import extract as X  # noqa: E402

# The page oracles spell their patterns out by hand (RE2), apart from the code under test.
NOBLOCK_SQL = (r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), "
               r"'(?is)<style\b.*?</style>', '', 'g')")
TAG_SQL = r"(?s)</?([^ >/]+).*?>"
P_SQL, LI_SQL = r"(?s)<p(?:\s[^>]*)?>(.*?)</p>", r"(?s)<li(?:\s[^>]*)?>(.*?)</li>"
TITLE_TAG_SQL, H1_SQL = r"(?s)<title(?:\s[^>]*)?>(.*?)</title>", r"(?s)<h1(?:\s[^>]*)?>(.*?)</h1>"
LANG_SQL, HREF_SQL = r'<html[^>]*\slang="([^"]*)"', r'<a\s[^>]*?href="([^"]*)"'
ANCHOR_SQL = r'(?s)<a\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>'
HOST_SQL, ORIGIN_SQL = r"^https?://([^/?#:]+)", r"^(https?://[^/?#]+)"


def _first_sql(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, 1), '')"


def _unescape_sql(x: str) -> str:
    """The character references that occur in the driver pages' elements."""
    for name, ch in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">")):
        x = f"replace({x}, '&{name};', {q(ch)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _text_joined_sql(pattern: str, sep: str = " ") -> str:
    inner = sstrip(_unescape_sql(f"regexp_replace(x, {q(TAG_SQL)}, '', 'g')"))
    return (f"array_to_string(list_filter(list_transform(regexp_extract_all({NOBLOCK_SQL}, {q(pattern)}, 1), "
            f"lambda x: {inner}), lambda x: x <> ''), {q(sep)})")


def _abs_sql(base: str, href: str) -> str:
    """The driver pages link by absolute path or url (other forms: unit test)."""
    return (f"CASE WHEN starts_with({href}, '/') THEN regexp_extract({base}, {q(ORIGIN_SQL)}, 1) || {href} "
            f"ELSE {href} END")


def pages_df(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")


@register("strip_tags", f"""SELECT page_id,
  regexp_replace({NOBLOCK_SQL}, {q(TAG_SQL)}, '', 'g') AS text FROM pages""")
def q_strip_tags(spark, sf):
    return pages_df(spark, sf).select("page_id", TX.strip_tags("html").alias("text"))


@register("page_text", f"SELECT page_id, {_text_joined_sql(P_SQL)} AS text FROM pages")
def q_page_text(spark, sf):
    return X.page_text(pages_df(spark, sf))


_ITEM_TEXT_SQL = _unescape_sql(f"regexp_replace(x, {q(TAG_SQL)}, '', 'g')")
CLEAN_ITEM_SQL = sstrip(f"replace(replace(replace({_ITEM_TEXT_SQL}, chr(10), ''), chr(9), ''), chr(160), ' ')")


@register("page_text_list", f"""SELECT page_id, CAST(len(l) AS INTEGER) AS n_items, array_to_string(l, chr(10)) AS items
FROM (SELECT page_id, list_transform(regexp_extract_all({NOBLOCK_SQL}, {q(LI_SQL)}, 1),
                                     lambda x: {CLEAN_ITEM_SQL}) AS l FROM pages)""")
def q_page_text_list(spark, sf):
    return X.page_text_list(pages_df(spark, sf))


TITLE_SQL = f"regexp_replace({_first_sql('html', TITLE_TAG_SQL)}, '(?s)<[^>]*>', '', 'g')"


@register("page_fields", f"""SELECT page_id, {_first_sql('html', LANG_SQL)} AS lang, {TITLE_SQL} AS title,
  coalesce(nullif({sstrip(f"regexp_replace({_first_sql('html', H1_SQL)}, '(?s)<[^>]*>', '', 'g')")}, ''), {TITLE_SQL}) AS headline,
  {sstrip(f"regexp_replace(coalesce({_first_sql('html', '(?s)<div class=\"ad\">(.*?)</div>')}, '0'), {q(TAG_SQL)}, '', 'g')")} AS ad_text,
  coalesce({_first_sql('html', '<em class=\"reply\">([0-9]+)</em>')}, {_first_sql('html', '<span class=\"reply\">([0-9]+)</span>')}, '0') AS comment_cnt
FROM pages""")
def q_page_fields(spark, sf):
    return X.page_fields(pages_df(spark, sf))


OUTLINKS_SQL = f"""outlinks AS (
  SELECT page_id, CAST(pos AS INTEGER) AS pos, href, {_abs_sql('url', 'href')} AS abs_url
  FROM (SELECT page_id, url, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS href
        FROM (SELECT page_id, url, regexp_extract_all(html, {q(HREF_SQL)}, 1) AS l FROM pages)))"""


@register("outlinks", f"WITH {OUTLINKS_SQL} SELECT * FROM outlinks")
def q_outlinks(spark, sf):
    return X.outlinks(pages_df(spark, sf))


@register("zip_links", f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label FROM (
  SELECT page_id, unnest(generate_series(0, n - 1)) AS pos, unnest(a[1:n]) AS href,
         unnest(list_transform(b[1:n], lambda x: {sstrip(_unescape_sql(f"regexp_replace(x, {q(TAG_SQL)}, '', 'g')"))})) AS label
  FROM (SELECT page_id, a, b, least(len(a), len(b)) AS n
        FROM (SELECT page_id, regexp_extract_all(html, {q(HREF_SQL)}, 1) AS a,
                     regexp_extract_all(html, {q(ANCHOR_SQL)}, 1) AS b FROM pages)))""")
def q_zip_links(spark, sf):
    return X.zip_links(pages_df(spark, sf))


RESULT_URL = "https://%s/search?page=%d"


@register("result_pages", f"""SELECT host, n_pages, page_no, printf({q(RESULT_URL)}, host, page_no) AS url
FROM (SELECT host, n_pages, unnest(generate_series(1, n_pages)) AS page_no
      FROM (SELECT host, CAST(replace(hit_text, ',', '') AS BIGINT) // {K.RESULTS_PER_PAGE} + 1 AS n_pages
            FROM (SELECT host, format('{{:,}}', count(*) * 100) AS hit_text
                  FROM (SELECT regexp_extract(url, {q(HOST_SQL)}, 1) AS host FROM pages) GROUP BY host)))""")
def q_result_pages(spark, sf):
    """Hit counts per host (text with thousands separators) -> page urls."""
    hits = (pages_df(spark, sf).groupBy(H.host_of("url").alias("host"))
            .agg(F.format_string("%,d", F.count(F.lit(1)) * 100).alias("hit_text")))
    return X.result_pages(hits, RESULT_URL).select("host", "n_pages", "page_no", "url")


@register("frontier", f"""WITH {OUTLINKS_SQL}
SELECT DISTINCT abs_url AS url FROM outlinks o
WHERE abs_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = o.abs_url)""")
def q_frontier(spark, sf):
    p = pages_df(spark, sf)
    req = X.outlinks(p).select(F.col("abs_url").alias("url"))
    return X.frontier(req, p.select("url"))


@register("pages_to_posts", f"""SELECT page_id, url, regexp_extract(url, {q(HOST_SQL)}, 1) AS site,
  {_text_joined_sql(P_SQL)} AS document, CAST(NULL AS VARCHAR) AS documenttype,
  CAST(NULL AS VARCHAR) AS postdate, CAST(NULL AS VARCHAR) AS likes, CAST(NULL AS VARCHAR) AS dislike,
  coalesce({_first_sql('html', '<em class="reply">([0-9]+)</em>')}, '0') AS comment_cnt,
  CAST(NULL AS VARCHAR) AS views, {TITLE_SQL} AS boardcategory, {_first_sql('html', LANG_SQL)} AS documentcategory
FROM pages""")
def q_pages_to_posts(spark, sf):
    return X.pages_to_posts(pages_df(spark, sf))   # no driver page is of a registered site: the article extractor


# the posts as pages of two sites: blocks nested in the body's block
SITE_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: " + sstrip("x") + "), lambda x: x <> '')"


@register("site_posts", f"""SELECT doc_id AS page_id,
  CASE WHEN doc_id % 2 = 0 THEN 'clien' ELSE 'meeco' END AS site,
  nullif(CASE WHEN doc_id % 2 = 0 THEN array_to_string({SITE_LINES}, ' ')
         ELSE {sstrip(f"regexp_replace(array_to_string({SITE_LINES}, ' '), '{WS}+', ' ', 'g')")} END, '') AS document,
  CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) END AS views
FROM documents""")
def q_site_posts(spark, sf):
    """Post records from pages with the markup of two sites, the body's blocks
    nested in one another."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    lines = F.split(escaped, "\n", -1)
    wrapped = lambda a, z: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(a), x, F.lit(z))), "")
    clien = F.concat(F.lit('<span class="view_count"><strong>'), F.col("n_chars").cast("string"), F.lit('</strong></span><div class="post_article">'),
                     wrapped('<div class="box"><div><img></div></div><p>', "</p>"), F.lit("</div><div><p>reply</p></div>"))
    meeco = F.concat(F.lit('<div id="bBd"><article><header><p>h</p></header><div><div>by</div><div>'),
                     wrapped('<div>', '<div></div></div>'), F.lit("</div><div>tail</div></div></article></div>"))
    even = F.col("doc_id") % 2 == 0
    pages = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.when(even, F.lit("https://www.clien.net/1")).otherwise(F.lit("https://meeco.kr/1")).alias("url"),
        F.when(even, clien).otherwise(meeco).alias("html"))
    return X.pages_to_posts(pages).select("page_id", "site", "document", "views")


@register("html_files_scan", "SELECT page_id, html FROM pages")
def q_html_files_scan(spark, sf):
    """Land pages as files (one page a file, files of many pages a folder), then
    list and read them; the first line of a file names its page."""
    from murmura.session import work_dir
    from murmura.sources.html_files import land_files, read_html_files
    root = work_dir(spark, "html")
    named = F.concat(F.lit("<!-- page "), F.col("page_id").cast("string"), F.lit(" -->\n"), F.coalesce("html", F.lit("")))
    land_files(pages_df(spark, sf).select(named.alias("value")), root)
    f = read_html_files(spark, root, ext=".txt")
    return f.select(F.regexp_extract("html", r"^<!-- page ([0-9]+) -->", 1).cast("long").alias("page_id"),
                    F.regexp_replace("html", r"(?s)^<!-- page [0-9]+ -->\n|\n\z", "").alias("html"))


# ------------------------------------------------------------ 8. history

def conversations(spark, sf) -> DataFrame:
    """Chat messages of (user, keyword) stores, one conversation each."""
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")).alias("user_id"),
        history_keyword().alias("keyword"), "conv_id", "turn", "role", "text")


HIST_KEYS = ["user_id", "keyword", "conv_id"]
MSG_SQL = f"""m AS (
  SELECT 'u' || CAST(conv_id % 3 AS VARCHAR) AS user_id, {HISTORY_KEYWORD_SQL} AS keyword, conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role IS NULL OR role <> 'system')"""


@register("history_pairs", f"""WITH {MSG_SQL}
SELECT user_id, keyword, conv_id, pair, user_id || '_' || keyword || '_' || CAST(conv_id AS VARCHAR) || '_' || CAST(pair AS VARCHAR) AS history_id,
       question, answer
FROM (SELECT user_id, keyword, conv_id, pos // 2 AS pair, count(*) AS n,
             max(CASE WHEN pos % 2 = 0 THEN text END) AS question, max(CASE WHEN pos % 2 = 1 THEN text END) AS answer
      FROM m GROUP BY ALL) WHERE n = 2""")
def q_history_pairs(spark, sf):
    from murmura.operators.history import pair_turns
    return pair_turns(conversations(spark, sf), HIST_KEYS)


@register("last_k_turns", f"""WITH {MSG_SQL}, n AS (SELECT conv_id, count(*) AS n_msgs FROM m GROUP BY ALL)
SELECT user_id, keyword, conv_id, turn, role, text, pos FROM m JOIN n USING (conv_id)
WHERE n_msgs // 2 <= 5 OR (pos < 2 * (n_msgs // 2) AND pos // 2 >= n_msgs // 2 - 5)""")
def q_last_k_turns(spark, sf):
    from murmura.operators.history import last_k_turns
    return last_k_turns(conversations(spark, sf), 5, HIST_KEYS).select(*HIST_KEYS, "turn", "role", "text", "pos")


@register("append_turn", """WITH last AS (
  SELECT conv_id, max(turn) AS t, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id),
ans AS (SELECT conv_id, t, text AS question, 'ack: ' || text AS answer FROM last WHERE role = 'user')
SELECT conv_id, t + 1 AS turn, 'user' AS role, question AS text FROM ans
UNION ALL SELECT conv_id, t + 2, 'assistant', answer FROM ans""")
def q_append_turn(spark, sf):
    """Conversations ending on a question get it answered; the pair is
    appended after the last stored turn."""
    from murmura.operators.history import append_turn
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m"))
    answered = last.where(F.col("m.role") == "user").select(
        "conv_id", F.col("m.text").alias("question"),
        F.concat(F.lit("ack: "), F.col("m.text")).alias("answer"))
    return append_turn(c, answered)


@register("conversation_json", f"""WITH {MSG_SQL},
pairs AS (SELECT user_id, keyword, conv_id, pair,
                 user_id || '_' || keyword || '_' || CAST(conv_id AS VARCHAR) || '_' || CAST(pair AS VARCHAR) AS history_id,
                 question, answer
          FROM (SELECT user_id, keyword, conv_id, pos // 2 AS pair, count(*) AS c,
                       max(CASE WHEN pos % 2 = 0 THEN text END) AS question,
                       max(CASE WHEN pos % 2 = 1 THEN text END) AS answer
                FROM m GROUP BY ALL) WHERE c = 2)
SELECT user_id, keyword, conv_id, count(*) AS n,
       CAST(to_json(struct_pack(n := count(*), conversation := list(struct_pack(
           history_id := history_id, question := question, answer := answer) ORDER BY pair))) AS VARCHAR) AS json
FROM pairs GROUP BY user_id, keyword, conv_id""")
def q_conversation_json(spark, sf):
    """``{n, conversation:[{history_id, question, answer}]}`` per history."""
    from murmura.operators.history import conversation_json, pair_turns
    return conversation_json(pair_turns(conversations(spark, sf), HIST_KEYS), HIST_KEYS)


@register("conversation_segments", f"""WITH {MSG_SQL},
pairs AS (SELECT user_id, keyword, conv_id, pair, pair // 2 AS segment,
                 user_id || '_' || keyword || '_' || CAST(conv_id AS VARCHAR) || '_' || CAST(pair AS VARCHAR) AS history_id,
                 question, answer
          FROM (SELECT user_id, keyword, conv_id, pos // 2 AS pair, count(*) AS c,
                       max(CASE WHEN pos % 2 = 0 THEN text END) AS question,
                       max(CASE WHEN pos % 2 = 1 THEN text END) AS answer
                FROM m GROUP BY ALL) WHERE c = 2),
whole AS (SELECT user_id, keyword, conv_id, count(*) AS n, max(segment) AS final FROM pairs GROUP BY ALL)
SELECT p.user_id, p.keyword, p.conv_id, p.segment, count(*) AS n_pairs,
       CASE WHEN p.segment = 0 THEN '{{"n":' || any_value(w.n) || ',"conversation":[' ELSE ',' END
       || string_agg(CAST(to_json(struct_pack(history_id := history_id, question := question, answer := answer)) AS VARCHAR), ',' ORDER BY pair)
       || CASE WHEN p.segment = any_value(w.final) THEN ']}}' ELSE '' END AS json
FROM pairs p JOIN whole w USING (user_id, keyword, conv_id) GROUP BY p.user_id, p.keyword, p.conv_id, p.segment""")
def q_conversation_segments(spark, sf):
    """The JSON of each history in segments of two pairs."""
    from murmura.operators.history import conversation_segments, pair_turns
    return conversation_segments(pair_turns(conversations(spark, sf), HIST_KEYS), HIST_KEYS, pairs_each=2)


# ------------------------------------------------------------- 9. report

def facts_df(store: DataFrame) -> DataFrame:
    from murmura.operators.report import report_facts
    from murmura.operators.sentiment import sentiment_summary, top_opinions
    return report_facts(sentiment_summary(store), topic_table_df(store), top_opinions(store), ["user_id", "keyword"])


FACTS_SQL = f"""facts AS (
  SELECT s.*, {s_render('전체 {total}건 중 긍정 {pos}건({pos_pct}%), 부정 {neg}건({neg_pct}%), 중립 {neu}건({neu_pct}%)')} AS summary,
         coalesce(t.topic_lines, '') AS topic_lines, coalesce(t.topic_pcts, []) AS topic_pcts,
         coalesce(op.top_pos, []) AS top_pos, coalesce(op.top_neg, []) AS top_neg
  FROM summary s
  LEFT JOIN (SELECT user_id, keyword,
                    string_agg({s_render('- {topic}: {count}건({pct}%)')}, chr(10) ORDER BY rank) AS topic_lines,
                    list(pct ORDER BY rank) AS topic_pcts
             FROM topics GROUP BY ALL) t USING (user_id, keyword)
  LEFT JOIN (SELECT user_id, keyword,
                    coalesce(list(opinion ORDER BY rank) FILTER (WHERE sentiment = {q(K.POSITIVE)}), []) AS top_pos,
                    coalesce(list(opinion ORDER BY rank) FILTER (WHERE sentiment = {q(K.NEGATIVE)}), []) AS top_neg
             FROM tops GROUP BY ALL) op USING (user_id, keyword))"""
REPORT_BASE_SQL = (TOPIC_TABLE_SQL + LABELED.replace(POSTS, "", 1) + ",\n" + SENTIMENT_SUMMARY_SQL + ",\n" + TOP_SQL
                   + ",\n" + FACTS_SQL)


@register("report_facts", f"""WITH {REPORT_BASE_SQL}
SELECT user_id, keyword, total, pos, pos_pct, neg, neg_pct, neu, neu_pct, summary, topic_lines,
       array_to_string(list_transform(topic_pcts, lambda p: CAST(p AS VARCHAR)), ',') AS topic_pcts,
       array_to_string(top_pos, chr(10)) AS top_pos, array_to_string(top_neg, chr(10)) AS top_neg
FROM facts""")
def q_report_facts(spark, sf):
    f = facts_df(stored_posts(spark, sf))
    return f.select("user_id", "keyword", "total", "pos", "pos_pct", "neg", "neg_pct", "neu", "neu_pct",
                    "summary", "topic_lines",
                    F.array_join(F.transform("topic_pcts", lambda p: p.cast("string")), ",").alias("topic_pcts"),
                    F.array_join("top_pos", "\n").alias("top_pos"), F.array_join("top_neg", "\n").alias("top_neg"))


@register("report_context", f"""WITH {REPORT_BASE_SQL}, {SENTIMENT_TEXT_SQL}, {TOPIC_TEXT_SQL},
svx AS (SELECT user_id, keyword, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM sv),
gc AS (SELECT user_id, keyword, list(m ORDER BY i) AS c
       FROM (SELECT user_id, keyword, i, avg(x) AS m FROM svx GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT sv.*, row_number() OVER (PARTITION BY sv.user_id, sv.keyword
                                         ORDER BY list_distance(sv.v, gc.c), sv.doc_id) AS rank
         FROM sv JOIN gc USING (user_id, keyword) QUALIFY rank <= 30),
docs AS (SELECT user_id, keyword,
                string_agg({s_render(K.REPORT_DOCUMENT_TEMPLATE, page_content=s_truncate('document'))}, chr(10) ORDER BY rank) AS docs_text
         FROM hits GROUP BY ALL)
SELECT user_id, keyword,
       coalesce(sentiment_text, '') || chr(10) || chr(10) || coalesce(topic_text, '') || chr(10) || chr(10) ||
       {q(K.DETAIL_HEADER)} || chr(10) || coalesce(docs_text, '') AS context
FROM sentiment_text FULL JOIN topic_text USING (user_id, keyword) FULL JOIN docs USING (user_id, keyword)""")
def q_report_context(spark, sf):
    """Per store: sentiment block + topic block + 30 documents nearest to the
    store's mean vector (the report retrieval), formatted and cut at 1000."""
    from murmura.operators.report import combine_documents, report_context
    from murmura.operators.topics import topic_summary_text
    from murmura.operators.vectors import centroids_by, knn_topk
    from murmura.plans.retrieval import fetch
    keys = ["user_id", "keyword"]
    sv = stored_posts(spark, sf)
    qv = (centroids_by(sv.withColumn("g", F.struct(*keys)), "g")
          .select(F.col("g").alias("qid"), F.col("g.user_id"), F.col("g.keyword"), F.col("centroid").alias("embedding")))
    hits = knn_topk(sv, qv, 30, group_cols=keys)
    hits = hits.select(F.col("qid.user_id").alias("user_id"), F.col("qid.keyword").alias("keyword"), "doc_id", "rank")
    docs = fetch(hits, sv.drop("embedding"), qv, 30, keys)
    return report_context(sentiment_text_df(sv), topic_summary_text(topic_table_df(sv)),
                          combine_documents(docs, keys, "rank"), keys)


def _pcts_sql(arr):
    return f"array_to_string(list_transform({arr}, lambda p: CAST(p AS VARCHAR) || '%'), ' ')"


DRAFT_SQL = (f"concat_ws(' ', p.document, "
             f"CASE WHEN p.doc_id % 2 = 0 THEN CAST(f.pos_pct AS VARCHAR) || '%' END, "
             f"CASE WHEN p.doc_id % 3 = 0 THEN CAST(f.neg_pct AS VARCHAR) || '%' END, "
             f"CASE WHEN p.doc_id % 5 <> 0 THEN CAST(f.neu_pct AS VARCHAR) || '%' END, "
             f"CASE WHEN p.doc_id % 7 <> 0 THEN {_pcts_sql('f.topic_pcts')} END, "
             f"CASE WHEN p.doc_id % 4 = 0 THEN substr(f.top_pos[1], 1, 30) END)")


def _often(x: str) -> str:
    """The number stands in the draft, as often as the facts hold it."""
    n = lambda l: f"len(list_filter({l}, lambda y: y = CAST({x} AS VARCHAR)))"
    return f"coalesce({n('told')} > 0 AND {n('told')} >= {n('want')}, FALSE)"


@register("report_check", f"""WITH {REPORT_BASE_SQL},
d AS (SELECT p.doc_id, p.user_id, p.keyword, p.doc_id % 3 AS iteration, {DRAFT_SQL} AS draft, f.*
      EXCLUDE (user_id, keyword) FROM posts p JOIN facts f USING (user_id, keyword)),
n AS (SELECT *, regexp_extract_all(replace(draft, '%', '% '), '(^|[^0-9.,])([0-9]+([.][0-9]+)?)%', 2) AS told,
             list_transform([pos_pct, neg_pct, neu_pct] || topic_pcts, lambda x: CAST(x AS VARCHAR)) AS want FROM d),
c AS (SELECT doc_id, user_id, keyword, iteration, list_filter([
        CASE WHEN NOT {_often('pos_pct')} THEN 'positive share' END,
        CASE WHEN NOT {_often('neg_pct')} THEN 'negative share' END,
        CASE WHEN NOT {_often('neu_pct')} THEN 'neutral share' END,
        CASE WHEN NOT coalesce(list_bool_and(list_transform(topic_pcts, lambda x: {_often('x')})), TRUE) THEN 'topic ratios' END,
        CASE WHEN NOT coalesce(list_bool_or(list_transform(list_filter(top_pos || top_neg, lambda o: o <> ''),
                                                           lambda o: contains(draft, substr(o, 1, 30)))), FALSE) THEN 'quoted opinion' END
      ], lambda x: x IS NOT NULL) AS missing FROM n)
SELECT doc_id, user_id, keyword, array_to_string(missing, ', ') AS missing,
       CASE WHEN len(missing) = 0 OR iteration >= {K.MAX_REPORT_ITERATIONS} THEN 'PASS'
            ELSE 'RETRY: missing ' || array_to_string(missing, ', ') END AS status
FROM c""")
def q_report_check(spark, sf):
    """Drafts assembled from posts and their store's facts, checked."""
    from murmura.operators.report import report_check
    p = stored_posts(spark, sf)
    f = facts_df(p)
    pcts = F.array_join(F.transform("topic_pcts", lambda x: F.concat(x.cast("string"), F.lit("%"))), " ")
    pid = F.col("doc_id")
    draft = F.concat_ws(" ", "document",
                        F.when(pid % 2 == 0, F.concat(F.col("pos_pct").cast("string"), F.lit("%"))),
                        F.when(pid % 3 == 0, F.concat(F.col("neg_pct").cast("string"), F.lit("%"))),
                        F.when(pid % 5 != 0, F.concat(F.col("neu_pct").cast("string"), F.lit("%"))),
                        F.when(pid % 7 != 0, pcts),
                        F.when(pid % 4 == 0, F.substring(F.try_element_at("top_pos", F.lit(1)), 1, 30)))
    d = p.select("doc_id", "user_id", "keyword", "document").join(f, ["user_id", "keyword"]) \
        .withColumn("draft", draft).withColumn("iteration", pid % 3)
    r = report_check(d)
    return r.select("doc_id", "user_id", "keyword", F.array_join("missing", ", ").alias("missing"), "status")


REPORT_TEXT = "* {title}\n# {site} 개요\n\n**{keyword}** {body}\n```mermaid\ngraph TD\nA{id}-->B\n```\n- {tail} *#\n"
REPORT_FIELDS_SQL = dict(title="site", site="site", keyword="keyword", body="document", id="doc_id", tail="url")


def report_texts(spark, sf) -> DataFrame:
    return posts(spark, sf).select("doc_id", TX.render(REPORT_TEXT, title="site", site="site", keyword="keyword",
                                                       body="document", id="doc_id", tail="url").alias("report"))


REPORT_TEXT_SQL = f"texts AS (SELECT doc_id, {s_render(REPORT_TEXT, **REPORT_FIELDS_SQL)} AS report FROM posts)"
FENCES_SQL = ("array_to_string(list_transform(string_split(report, '```'), lambda x, i: CASE WHEN i % 2 = 1 THEN x "
              "WHEN i < len(string_split(report, '```')) THEN replace(x, chr(10), ';') ELSE '```' || x END), '')")
LINES_SQL = f"""lines AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
         CASE WHEN contains(raw, {q(K.DIAGRAM_MARKER)}) THEN 'diagram' WHEN substr(raw, 1, 1) = '*' THEN 'title'
              WHEN substr(raw, 1, 1) = '#' THEN 'heading' ELSE 'body' END AS kind, raw
  FROM (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS raw
        FROM (SELECT doc_id, string_split(regexp_replace({FENCES_SQL}, '\\*\\*(.+?)\\*\\*', '<b>\\1</b>', 'g'), chr(10)) AS l
              FROM texts))
  WHERE raw <> ''),
typed AS (SELECT doc_id, line_no, kind, CASE kind WHEN 'title' THEN replace(raw, '*', '')
                                             WHEN 'heading' THEN replace(raw, '#', '') ELSE raw END AS text FROM lines)"""


@register("report_lines", f"WITH {POSTS}, {REPORT_TEXT_SQL}, {LINES_SQL} SELECT * FROM typed")
def q_report_lines(spark, sf):
    from murmura.operators.report import report_lines
    return report_lines(report_texts(spark, sf), "report", ["doc_id"])


@register("fenced_blocks", f"""WITH {POSTS}, {REPORT_TEXT_SQL}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, replace(block, chr(10), ';') AS block
FROM (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS block
      FROM (SELECT doc_id, regexp_extract_all(report, {q(TX.R_FENCE)}, 1) AS l FROM texts))""")
def q_fenced_blocks(spark, sf):
    from murmura.operators.report import fenced_blocks
    return fenced_blocks(report_texts(spark, sf), "report", ["doc_id"])


@register("diagram_urls", f"""WITH {POSTS}, {REPORT_TEXT_SQL}, {LINES_SQL}
SELECT doc_id, line_no, {q(K.DIAGRAM_PNG_PREFIX)} || b64 AS png_url, {q(K.DIAGRAM_SVG_PREFIX)} || b64 AS svg_url
FROM (SELECT doc_id, line_no, to_base64(encode(replace(text, {q(K.DIAGRAM_MARKER)}, ''))) AS b64
      FROM typed WHERE kind = 'diagram')""")
def q_diagram_urls(spark, sf):
    from murmura.operators.report import diagram_urls, report_lines
    return diagram_urls(report_lines(report_texts(spark, sf), "report", ["doc_id"]), ["doc_id"])


TEMPLATE_DEFAULTS = {"system_default": "You judge relevance.", "prompt_default": "Answer yes or no.",
                     "company_info_default": "company info: default", "product_info_default": "product info: default"}


def templates(spark, sf) -> DataFrame:
    """Template parameters per user as they were typed (short, empty, long)."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.when(i % 2 == 0, F.col("lang")).otherwise(F.col("text")).alias("system"),
        F.when(i % 3 == 0, F.col("lang")).otherwise(F.col("text")).alias("prompt"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("company_info"),
        F.when(i % 2 == 0, F.lit("")).otherwise(F.col("source")).alias("product_info"),
        *[F.lit(v).alias(k) for k, v in TEMPLATE_DEFAULTS.items()])


@register("template_defaults", f"""WITH t AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END AS system,
         CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END AS prompt,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS company_info,
         CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS product_info,
         {', '.join(f'{q(v)} AS {k}' for k, v in TEMPLATE_DEFAULTS.items())}
  FROM documents),
r AS (SELECT *, CASE WHEN length(system) < 6 THEN system_default ELSE system END AS sys_r,
             CASE WHEN length(prompt) < 6 THEN prompt_default ELSE prompt END AS prompt_r,
             CASE WHEN company_info = '' AND product_info = ''
                  THEN chr(10) || chr(10) || company_info_default || chr(10) || chr(10) || product_info_default
                  ELSE chr(10) || chr(10) || company_info || chr(10) || chr(10) || product_info END AS info
      FROM t)
SELECT doc_id,
       '[INST]<<SYS>>' || chr(10) || info || chr(10) || sys_r || chr(10) || '<</SYS>>' || chr(10) || chr(10)
         || '''User: {{user_input}}'' ' || prompt_r || '[/INST]' AS crawl_template,
       CASE WHEN length(prompt) < 6 AND length(system) < 6 THEN prompt_default ELSE prompt END
         || ': {{context}}' || chr(10) || 'Question: {{question}}' AS conversation_template,
       prompt_r AS report_template, sys_r AS standalone_template
FROM r""")
def q_template_defaults(spark, sf):
    from murmura.operators.report import template_defaults
    return template_defaults(templates(spark, sf)).select(
        "doc_id", "crawl_template", "conversation_template", "report_template", "standalone_template")


# ---------------------------------------------------------- 10. streaming

def _land_runs(df: DataFrame, landing: str) -> None:
    """Land the posts run by run; a run of any size is split into files."""
    df.hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(landing)


@register("stream_ingest", f"""WITH {SCORED}
SELECT user_id, keyword, doc_id, url FROM scored
WHERE {IS_YES_SQL} AND NOT {s_contains_any("coalesce(boardcategory, '')", INGEST_CATEGORIES)}
  AND NOT {s_contains_any("coalesce(documentcategory, '')", INGEST_CATEGORIES)}""")
def q_stream_ingest(spark, sf):
    """Runs arrive as files; the stream merges them into empty stores; a
    second start with the same checkpoint adds nothing."""
    from murmura.operators.store import VectorStore
    from murmura.session import work_dir
    from murmura.streaming.ingest import stream_ingest
    root = work_dir(spark, "stream")
    p = posts(spark, sf)
    _land_runs(p, f"{root}/landing")
    for _ in range(2):
        stream_ingest(spark, f"{root}/landing", root, relevance_scorer(), p.schema,
                      categories=INGEST_CATEGORIES, files_per_trigger=1)
    return VectorStore(spark, root).read().select("user_id", "keyword", "doc_id", "url")


@register("stream_dedup", f"WITH {OUTLINKS_SQL} SELECT DISTINCT abs_url AS url FROM outlinks")
def q_stream_dedup(spark, sf):
    """Crawl requests (page links) stream in per page batch; each url once."""
    from murmura.session import work_dir
    from murmura.streaming.dedup import stream_dedup
    root = work_dir(spark, "dedup")
    links = X.outlinks(pages_df(spark, sf)).select("page_id", F.col("abs_url").alias("url"))
    links.hint("rebalance").write.parquet(f"{root}/landing")
    src = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/landing")
    q = (stream_dedup(src).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("url")


_TTL, _DELAY_S = 86400, 7200
_NEXT_VISIT = """
SELECT c.url, min(s.ts) AS ts FROM {c} c JOIN {s} s ON s.url = c.url
WHERE floor(epoch(s.ts)) >= floor(epoch(c.ts)) + {ttl} GROUP BY c.url, c.ts"""


@register("stream_dedup_ttl", f"""WITH RECURSIVE
req AS (SELECT 'https://site.test/u/' || user_id || '/' || event_type AS url, ts,
               ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) OR event_id % 10 = 0 AS late
        FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
one AS (SELECT * FROM req WHERE NOT late),
two AS (SELECT * FROM req WHERE late AND ts > (SELECT max(ts) - INTERVAL {_DELAY_S} SECOND FROM one)),
a AS (SELECT url, min(ts) AS ts FROM one GROUP BY url UNION ALL {_NEXT_VISIT.format(c="a", s="one", ttl=_TTL)}),
last AS (SELECT url, max(ts) AS ts FROM a GROUP BY url),
b AS (SELECT two.url, min(two.ts) AS ts FROM two LEFT JOIN last USING (url)
      WHERE last.ts IS NULL OR floor(epoch(two.ts)) >= floor(epoch(last.ts)) + {_TTL} GROUP BY two.url
      UNION ALL {_NEXT_VISIT.format(c="b", s="two", ttl=_TTL)})
SELECT url, ts FROM a UNION ALL SELECT url, ts FROM b""")
def q_stream_dedup_ttl(spark, sf):
    """Visits to pages stream in; a page passes again a day after it last passed.
    A first start takes the earlier half of the events, a second start from the
    same checkpoint the later half and a tenth of the earlier, which is late:
    what is more than two hours behind the newest is dropped."""
    from murmura.session import work_dir
    from murmura.streaming.dedup import stream_dedup_ttl
    root = work_dir(spark, "dedup-ttl")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    half = ends.select(F.timestamp_micros(((F.unix_micros("lo") + F.unix_micros("hi")) / 2).cast("long"))).head()[0]
    req = (e.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("event_type").isNotNull())
           .select(F.concat(F.lit("https://site.test/u/"), "user_id", F.lit("/"), "event_type").alias("url"), "ts",
                   ((F.col("ts") >= F.lit(half)) | (F.col("event_id") % 10 == 0)).alias("late")))
    schema = "url string, ts timestamp"
    for late in (False, True):
        req.where(F.col("late") == late).select("url", "ts").write.mode("append").parquet(f"{root}/landing")
        src = spark.readStream.schema(schema).parquet(f"{root}/landing")
        q = (stream_dedup_ttl(src, _TTL, delay=f"{_DELAY_S} seconds").writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/_ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


@register("ingest_run", f"""WITH {SCORED},
relevant AS (SELECT * FROM scored WHERE {IS_YES_SQL}
  AND NOT {s_contains_any("coalesce(boardcategory, '')", INGEST_CATEGORIES)}
  AND NOT {s_contains_any("coalesce(documentcategory, '')", INGEST_CATEGORIES)})
SELECT 1 AS attempt, 'ok' AS status, count(*) AS added, count(*) AS total_filtered FROM relevant
UNION ALL SELECT 2, 'ok', 0, count(*) FROM relevant""")
def q_ingest_run(spark, sf):
    """The whole ingest of the merged runs, twice: the first run fills empty
    stores, the re-run finds every relevant url stored and adds nothing."""
    from murmura.plans.ingest import run_ingest
    from murmura.session import work_dir
    root = work_dir(spark, "ingest")
    merged = posts(spark, sf)
    res = [dict(attempt=i + 1, **run_ingest(spark, merged, root, relevance_scorer(), INGEST_CATEGORIES))
           for i in range(2)]
    return spark.createDataFrame(res, "attempt int, status string, added long, total_filtered long")


# ------------------------------------------------------- answer lifecycle

@register("answer_context", f"""WITH {VECTORS_SQL},
svx AS (SELECT user_id, keyword, doc_id % 3 AS variant, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM sv),
var AS (SELECT user_id, keyword, variant, user_id || '|' || keyword AS parent_qid, list(m ORDER BY i) AS c
        FROM (SELECT user_id, keyword, variant, i, avg(x) AS m FROM svx GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT * FROM (
  SELECT var.parent_qid, var.variant, sv.doc_id,
         row_number() OVER (PARTITION BY var.parent_qid, var.variant ORDER BY list_distance(sv.v, var.c), sv.doc_id) AS rank
  FROM sv JOIN var USING (user_id, keyword)) WHERE rank <= 4),
firsts AS (SELECT parent_qid, doc_id, min((variant, rank)) AS m FROM hits GROUP BY ALL),
ordered AS (SELECT parent_qid, doc_id,
                   row_number() OVER (PARTITION BY parent_qid ORDER BY m[1], m[2], doc_id) AS ord FROM firsts),
ctx AS (SELECT o.parent_qid AS qid,
               string_agg({s_render(K.CHAT_DOCUMENT_TEMPLATE, page_content='d.document', postdate='NULL')},
                          chr(10) || chr(10) ORDER BY ord) AS context
        FROM ordered o JOIN sv d USING (doc_id) GROUP BY ALL),
{MSG_SQL},
one AS (SELECT user_id, keyword, role, text, row_number() OVER (PARTITION BY user_id, keyword ORDER BY conv_id, turn) - 1 AS pos,
               count(*) OVER (PARTITION BY user_id, keyword) AS n_msgs FROM m),
turns AS (SELECT * FROM one WHERE n_msgs // 2 <= 5 OR (pos < 2 * (n_msgs // 2) AND pos // 2 >= n_msgs // 2 - 5)),
hist AS (SELECT user_id, keyword, string_agg(role || ': ' || text, chr(10) ORDER BY pos) AS history
         FROM turns GROUP BY ALL),
qs AS (SELECT DISTINCT parent_qid AS qid, user_id, keyword FROM var)
SELECT qs.qid, qs.user_id, qs.keyword, coalesce(ctx.context, '') AS context, coalesce(hist.history, '') AS history
FROM qs LEFT JOIN ctx USING (qid) LEFT JOIN hist USING (user_id, keyword)""")
def q_answer_context(spark, sf):
    """What an answer needs, per store question: the context from the
    distinct union of three query variants' top-4 documents, and the last
    five question/answer turns of the store's history."""
    from murmura.operators.vectors import centroids_by
    from murmura.plans.retrieval import answer_inputs
    sv = stored_posts(spark, sf).select("doc_id", "user_id", "keyword", "document", "postdate", "embedding")
    g = F.struct("user_id", "keyword", (F.col("doc_id") % 3).alias("variant"))
    v = (centroids_by(sv.withColumn("g", g), "g")
         .select(F.concat_ws("|", "g.user_id", "g.keyword").alias("parent_qid"), F.col("g.variant").alias("variant"),
                 F.col("g.user_id").alias("user_id"), F.col("g.keyword").alias("keyword"),
                 F.col("centroid").alias("embedding")))
    qs = v.select(F.col("parent_qid").alias("qid"), "user_id", "keyword").distinct()
    return answer_inputs(qs, v, sv, conversations(spark, sf), k=4, last_k=5)


@register("topic_pipeline", f"""WITH {POSTS}, n AS (SELECT user_id, keyword, count(*) AS n_docs FROM posts GROUP BY ALL)
SELECT user_id, keyword, n_docs, n_docs AS n_assigned, TRUE AS one_cluster_each, TRUE AS few_enough, TRUE AS nearest_own FROM n""")
def q_topic_pipeline(spark, sf):
    """Posts clustered within their own (user, keyword) store, all stores in one
    job.  The oracle states what must hold: every document has one cluster, a
    store has at most min(10, n) of them, and no document is nearer to another
    of its store's final centres than to its own."""
    from murmura.operators.scoring import HashEmbedder
    from murmura.operators.vectors import cluster_stores
    keys = ["user_id", "keyword"]
    p = posts(spark, sf).select(*keys, "doc_id", HashEmbedder(EMBED_DIM).column(F.col("document")).alias("embedding"))
    c, centres = cluster_stores(p, 10, with_centres=True)
    per = centres.groupBy(*keys).agg(F.collect_list("c").alias("cs"))
    from murmura.operators.vectors import l2_normalize
    v = p.select(*keys, "doc_id", l2_normalize("embedding").alias("v")).join(c, keys + ["doc_id"]).join(per, keys)
    far = F.transform("cs", lambda x: F.sqrt(F.aggregate(F.zip_with("v", x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)))
    per_doc = v.groupBy(*keys, "doc_id").agg(F.count("*").alias("k"), F.max(F.col("dist") - F.array_min(far)).alias("gap"),
                                             F.first("cluster").alias("cluster"))
    return (per_doc.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.sum("k").alias("n_assigned"), F.max("k").alias("k"),
                                       F.countDistinct("cluster").alias("c"), F.max("gap").alias("gap"))
            .select(*keys, "n_docs", "n_assigned", (F.col("k") == 1).alias("one_cluster_each"),
                    (F.col("c") <= F.least(F.lit(10), F.col("n_docs"))).alias("few_enough"),
                    (F.col("gap") <= 1e-9).alias("nearest_own")))


@register("ingest_then_retrieve", f"""WITH {SCORED},
relevant AS (SELECT * FROM scored WHERE {IS_YES_SQL}
  AND NOT {s_contains_any("coalesce(boardcategory, '')", INGEST_CATEGORIES)}
  AND NOT {s_contains_any("coalesce(documentcategory, '')", INGEST_CATEGORIES)})
SELECT user_id, keyword, count(*) AS n_stored, count(*) AS n_ids, least(2, count(*)) AS n_hits,
       TRUE AS context_from_store FROM relevant GROUP BY user_id, keyword""")
def q_ingest_then_retrieve(spark, sf):
    """The user's path over all posts: records without ids are ingested into
    stores, then each store is asked with the vector of one of its documents.
    Every stored post has its own id, and the answer's context is made of stored
    documents of that store."""
    from murmura.operators.vectors import knn_topk
    from murmura.operators.store import VectorStore
    from murmura.plans.ingest import run_ingest
    from murmura.plans.retrieval import fetch
    from murmura.session import work_dir
    keys = ["user_id", "keyword"]
    root = work_dir(spark, "answer")
    run_ingest(spark, posts(spark, sf).drop("doc_id"), root, relevance_scorer(), INGEST_CATEGORIES)
    store = VectorStore(spark, root).read()
    asked = (store.groupBy(*keys).agg(F.min_by("embedding", "doc_id").alias("embedding"))
             .withColumn("qid", F.concat_ws("|", *keys)))
    hits = knn_topk(store, asked, 2, group_cols=keys)
    mine = hits.join(asked.select("qid", *keys), "qid").select(*keys, "doc_id", "rank")
    docs = fetch(mine, store.select(*keys, "doc_id", "document"), asked, 2, keys)
    got = docs.groupBy(*keys).agg(F.countDistinct("doc_id").alias("n_hits"), F.max(F.col("document").isNotNull()).alias("context_from_store"))
    n = store.groupBy(*keys).agg(F.count("*").alias("n_stored"), F.countDistinct("doc_id").alias("n_ids"))
    return n.join(got, keys).select(*keys, "n_stored", "n_ids", "n_hits", "context_from_store")


@register("history_roundtrip", f"""WITH {MSG_SQL.replace("WHERE role IS NULL OR role <> 'system'", "")}
SELECT user_id, keyword, conv_id, turn, role, text FROM m""")
def q_history_roundtrip(spark, sf):
    """Every message appended to the history of its store and read back."""
    from murmura.session import work_dir
    from murmura.sources.history import read_history, write_turns
    path = work_dir(spark, "history")
    c = conversations(spark, sf)
    write_turns(c.where(F.col("role") == "user"), path)
    write_turns(c.where((F.col("role") != "user") | F.col("role").isNull()), path)
    return read_history(spark, path).select("user_id", "keyword", "conv_id", "turn", "role", "text")


@register("model_sentiment", f"""SELECT doc_id, CASE WHEN contains(text, '!!') THEN {q(K.NEGATIVE)} ELSE {q(K.POSITIVE)} END AS label
FROM documents WHERE text IS NOT NULL""")
def q_model_sentiment(spark, sf):
    """The model hook: a local function in the place of a remote model, eight
    requests at once in a task, its client made once a task."""
    import pandas as pd

    from murmura.operators.scoring import ArrowScorer
    sc = ArrowScorer(lambda texts, kws, client: pd.Series([client[("!!" in t)] for t in texts]),
                     init=lambda: {True: K.NEGATIVE, False: K.POSITIVE}, concurrency=8, on_error="default")
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", sc.column(F.col("text")).alias("label"))


from murmura.plans import model_queries  # noqa: E402,F401  (they register theirs)
