"""Registered queries of the fitted scorers, query variants, the topic namer and
the reader of CSV files in ranges."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.plans.catalog import (CLUSTERED_SQL, EMB_SQL, POSTS, LEX_NEG, LEX_POS, embeddings, label_centroids,
                                   labeled, register, posts, stored_posts)
from murmura.plans.sqltext import q, s_render, sstrip
from murmura.schema import POST_COLUMNS

# ------------------------------------------------------- J8: query variants

_ROUND = """
h{r} AS (SELECT * FROM (
  SELECT q.label, e.v, row_number() OVER (PARTITION BY q.label ORDER BY list_distance(e.v, q.c), e.vec_id) AS rank
  FROM e, v{p} q) WHERE rank <= 4),
m{r} AS (SELECT label, i, avg(x) AS m FROM (
  SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM h{r}) GROUP BY label, i),
v{r} AS (SELECT label, list(0.5 * c[i] + 0.5 * m ORDER BY i) AS c FROM v{p} JOIN m{r} USING (label) GROUP BY label)"""
VARIANTS_SQL = (EMB_SQL + ", v0 AS (SELECT label, c FROM cents)," + _ROUND.format(r=1, p=0) + ","
                + _ROUND.format(r=2, p=1) + """,
variants AS (SELECT label AS parent_qid, 0 AS variant, c FROM v0 UNION ALL SELECT label, 1, c FROM v1
             UNION ALL SELECT label, 2, c FROM v2)""")


def _variants(spark, sf):
    from murmura.operators.expansion import expand_queries
    qs = label_centroids(spark, sf).select(F.col("label").alias("qid"), F.col("centroid").alias("embedding"))
    return expand_queries(qs, embeddings(spark, sf), 4, 2, doc_id="vec_id")


@register("expand_query", f"""WITH {VARIANTS_SQL}
SELECT parent_qid, variant, CAST(pos AS INTEGER) AS pos, CASE WHEN round(x, 6) = 0 THEN 0.0 ELSE round(x, 6) END AS val
FROM (SELECT parent_qid, variant, unnest(generate_series(0, len(c) - 1)) AS pos, unnest(c) AS x FROM variants)""")
def q_expand_query(spark, sf):
    """Each question's own vector and two that its nearest documents moved."""
    v = _variants(spark, sf)
    return v.select("parent_qid", "variant", F.posexplode("embedding").alias("pos", "x")).select(
        "parent_qid", "variant", "pos", F.when(F.round("x", 6) == 0, 0.0).otherwise(F.round("x", 6)).alias("val"))


@register("expanded_topk", f"""WITH {VARIANTS_SQL},
hits AS (SELECT * FROM (
  SELECT q.parent_qid, q.variant, e.vec_id,
         row_number() OVER (PARTITION BY q.parent_qid, q.variant ORDER BY list_distance(e.v, q.c), e.vec_id) AS rank
  FROM e, variants q) WHERE rank <= 4),
firsts AS (SELECT parent_qid, vec_id, min((variant, rank)) AS m FROM hits GROUP BY ALL)
SELECT parent_qid, CAST(row_number() OVER (PARTITION BY parent_qid ORDER BY m[1], m[2], vec_id) AS INTEGER) AS ord,
       vec_id, m[1] AS variant, CAST(m[2] AS INTEGER) AS rank FROM firsts""")
def q_expanded_topk(spark, sf):
    """The union of the variants' four nearest documents, first seen first."""
    from murmura.operators.vectors import multi_query_topk
    r = multi_query_topk(embeddings(spark, sf), _variants(spark, sf), 4, doc_id="vec_id")
    return r.select("parent_qid", "ord", "vec_id", "variant", "rank")


# ------------------------------------------------- J6, J7: fitted scorers

def _folds(docs, answer: str, listed):
    """Per fold and label: documents, and how many of them the scorer fitted on
    the other fold and the word list get right."""
    from murmura.operators.trained import TrainedScorer
    docs = docs.withColumn("held_out", F.col("doc_id") % 5 == 0)
    model = TrainedScorer.fit(docs.where(~F.col("held_out")), "document", answer)
    told = model.transform(docs.withColumn("listed", listed), "document", "told")
    right = lambda c: F.sum((F.col(c) == F.col(answer)).cast("long"))
    return told.groupBy("held_out", F.col(answer).alias("label")).agg(
        F.count("*").alias("n"), right("told").alias("n_right"), right("listed").alias("n_list_right"))


def _judged(spark, sf):
    return labeled(spark, sf).where((F.col("sentiment") != "unlabelled") & F.col("document").isNotNull())


@register("trained_sentiment")
def q_trained_sentiment(spark, sf):
    """Sentiment by a model fitted on four fifths of the labelled posts, beside
    the word list; rows-only (a fitted model), held-out figures are tested."""
    from murmura.operators.scoring import LexiconSentiment
    return _folds(_judged(spark, sf), "sentiment", LexiconSentiment(LEX_POS, LEX_NEG).column(F.col("document")))


@register("trained_relevance")
def q_trained_relevance(spark, sf):
    """Relevance (good posts: yes) by a fitted model beside the keyword rule."""
    from murmura.operators.scoring import RuleRelevance
    d = _judged(spark, sf).withColumn("relevant", F.when(F.col("sentiment") == K.POSITIVE, "yes").otherwise("no"))
    return _folds(d, "relevant", RuleRelevance().column(F.col("document"), F.col("keyword")))


# ------------------------------------------------------- U3: topic namer

NAMED_SQL = f"""picked AS (SELECT user_id, keyword, cluster, doc_id, content FROM (
    SELECT user_id, keyword, cluster, doc_id, {sstrip('document')} AS content FROM clustered) WHERE content <> ''
  QUALIFY row_number() OVER (PARTITION BY user_id, keyword, cluster ORDER BY doc_id) <= {K.TOPIC_NAME_SAMPLES}),
asked AS (SELECT user_id, keyword, cluster,
                 string_agg('- ' || substr(content, 1, {K.TOPIC_NAME_SAMPLE_CHARS}), chr(10) ORDER BY doc_id) AS sample
          FROM picked GROUP BY ALL),
words AS (SELECT user_id, keyword, cluster, w, count(*) AS n FROM (
            SELECT user_id, keyword, cluster, unnest(regexp_extract_all(sample, '[A-Za-z]{{4,}}')) AS w FROM asked)
          GROUP BY ALL),
best AS (SELECT user_id, keyword, cluster, w FROM words
         QUALIFY row_number() OVER (PARTITION BY user_id, keyword, cluster ORDER BY n DESC, w) = 1)"""


def _commonest(prompt: str) -> str:
    """The commonest word of the samples in a naming prompt."""
    words = Counter(re.findall("[A-Za-z]{4,}", prompt.split("\n\n", 1)[-1]))
    return f" {min(words, key=lambda w: (-words[w], w))}\n" if words else K.TOPIC_DROP_MARKERS[0]


@register("topic_naming", f"""WITH {CLUSTERED_SQL}, {NAMED_SQL}
SELECT user_id, keyword, cluster, {s_render(K.TOPIC_NAME_PROMPT)} AS prompt,
       coalesce(w, {q(K.TOPIC_DROP_MARKERS[0])}) AS topic
FROM asked LEFT JOIN best USING (user_id, keyword, cluster)""")
def q_topic_naming(spark, sf):
    """The prompt that asks for each cluster's name, and the answer of a local
    function in the model's place, through the model hook."""
    import pandas as pd

    from murmura.operators.scoring import ArrowScorer
    from murmura.operators.topics import model_topic_names, naming_prompts
    st = stored_posts(spark, sf)
    namer = ArrowScorer(lambda prompts, _: pd.Series([_commonest(p) for p in prompts]), concurrency=4)
    keys = ["user_id", "keyword", "cluster"]
    return naming_prompts(st).join(model_topic_names(st, namer), keys).select(*keys, "prompt", "topic")


# ------------------------------------------------- A1: CSV in byte ranges

@register("csv_split", f"""WITH {POSTS}
SELECT url, site, document, documenttype, views, boardcategory, documentcategory FROM posts""")
def q_csv_split(spark, sf):
    """All posts exported as CSV and read back in byte ranges."""
    from murmura.session import work_dir
    from murmura.sources.posts import export_csv
    from murmura.sources.split_csv import read_csv_split
    path = work_dir(spark, "csv") + "/A_site"
    export_csv(posts(spark, sf).select(*POST_COLUMNS), path)
    back = read_csv_split(spark, path + "/*.csv")
    return back.select("url", "site", "document", "documenttype", "views", "boardcategory", "documentcategory")
