"""Vectors against numpy brute force, page extraction, report parsing,
templates, CSV round trip and scorer error policies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data_dirs import SF_SMALL
from murmura.functions import constants as K
from murmura.operators import extract as X
from murmura.operators.report import report_lines, template_defaults
from murmura.operators.scoring import ArrowScorer
from murmura.operators.vectors import centroid_assign, centroids_by, knn_topk, topic_cluster


def emb(spark):
    return spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")


def test_knn_matches_brute_force(spark):
    e = emb(spark)
    pdf = e.toPandas()
    X_ = np.stack(pdf.embedding.map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf.vec_id.to_numpy()
    qs = e.where(F.col("vec_id") < 5).select(F.col("vec_id").alias("qid"), "embedding")
    got = knn_topk(e, qs, 7, doc_id="vec_id").orderBy("qid", "rank").collect()
    for qid in range(5):
        d = np.sqrt(((X_ - X_[ids == qid][0]) ** 2).sum(1))
        exp = ids[np.lexsort((ids, d))[:7]].tolist()
        assert [r.vec_id for r in got if r.qid == qid] == exp


def test_centroid_assignment_is_nearest(spark):
    e = emb(spark)
    c = centroids_by(e, "label")
    cent = {r.label: np.asarray(r.centroid) for r in c.collect()}
    for r in centroid_assign(e, c).collect()[:50]:
        v = np.asarray(e.where(F.col("vec_id") == r.vec_id).first().embedding, dtype=np.float64)
        best = min(cent, key=lambda k: (np.linalg.norm(v - cent[k]), k))
        assert r.label == best


def test_topic_cluster_invariants(spark):
    e = emb(spark)
    r = topic_cluster(e, 10, id_col="vec_id")
    sizes = r.groupBy("cluster").count().collect()
    assert len(sizes) <= 10 and sum(x["count"] for x in sizes) == e.count()
    one = topic_cluster(e.limit(1), 10, id_col="vec_id").collect()
    assert len(one) == 1


def test_page_text_traps(spark):
    html = ('<html lang="ko"><head><title>T</title><script>var t="</p>";</script></head><body>'
            '<p><b>bold<br><p>second</p><p> </p><a href="/x">X</a><a href="http://o/y">Y</a></body></html>')
    pages = spark.createDataFrame([(1, "http://h.example/a/b?q=1", html)], "page_id long, url string, html string")
    t = X.page_text(pages).first().text
    assert t == "boldsecond"  # lazy match spans the unclosed tags; blank paragraph dropped
    links = [(r.href, r.abs_url) for r in X.outlinks(pages).orderBy("pos").collect()]
    assert links == [("/x", "http://h.example/x"), ("http://o/y", "http://o/y")]
    f = X.page_fields(pages).first()
    assert (f.lang, f.title, f.headline, f.comment_cnt) == ("ko", "T", "T", "0")


def test_result_pages_from_hit_count(spark):
    hits = spark.createDataFrame([("h", "1,050")], "host string, hit_text string")
    assert X.result_pages(hits, "https://%s/?p=%d").count() == 51


def test_report_lines_kinds(spark):
    txt = "**a** b\n* t*\n# h#\n\n```mermaid\ngraph\n```\nplain"
    df = spark.createDataFrame([(1, txt)], "id long, r string")
    got = [(r.kind, r.text) for r in report_lines(df, "r", ["id"]).orderBy("line_no").collect()]
    assert got == [("body", "<b>a</b> b"), ("title", " t"), ("heading", " h"),
                   ("diagram", "mermaid;graph;"), ("body", "plain")]


def test_template_short_parameters(spark):
    t = spark.createDataFrame([("12345", "123456", "", "", "SD", "PD", "CD", "XD")],
                              "system string, prompt string, company_info string, product_info string, "
                              "system_default string, prompt_default string, company_info_default string, "
                              "product_info_default string")
    r = template_defaults(t).first()
    assert r.standalone_template == "SD" and r.report_template == "123456"
    assert "CD" in r.crawl_template and "XD" in r.crawl_template


def test_csv_roundtrip_keeps_text(spark, tmp_path):
    from murmura.schema import POST_COLUMNS
    from murmura.sources.posts import export_csv, read_posts_csv
    doc = 'line1\nline2, "quoted" and ""doubled""'
    rows = [{c: None for c in POST_COLUMNS} | {"url": "u1", "document": doc},
            {c: None for c in POST_COLUMNS} | {"url": "u2", "document": "NA"}]
    from murmura.schema import POST_SCHEMA
    export_csv(spark.createDataFrame(rows, POST_SCHEMA), str(tmp_path / "c"))
    back = read_posts_csv(spark, str(tmp_path / "c")).orderBy("url").collect()
    assert [r.document for r in back] == [doc, "NA"]


def test_arrow_scorer_error_policies(spark):
    def flaky(texts, kws):
        if texts.str.contains("boom").any():
            raise RuntimeError("model down")
        return pd.Series([K.POSITIVE] * len(texts))

    df = spark.createDataFrame([("ok",), ("boom",)], "t string")
    soft = ArrowScorer(flaky, on_error="default", default=K.NEUTRAL)
    got = sorted(r.s for r in df.select(soft.column(F.col("t")).alias("s")).collect())
    assert got == sorted([K.POSITIVE, K.NEUTRAL])
    hard = ArrowScorer(flaky, on_error="raise")
    with pytest.raises(Exception):
        df.select(hard.column(F.col("t")).alias("s")).collect()


def test_knn_and_assign_chunked_paths_agree(spark):
    e = emb(spark)
    qs = e.where(F.col("vec_id") < 40).select(F.col("vec_id").alias("qid"), "embedding")
    one = sorted(knn_topk(e, qs, 3, doc_id="vec_id").collect())
    many = sorted(knn_topk(e, qs, 3, doc_id="vec_id", max_queries=7).collect())
    assert one == many
    c = centroids_by(e, "label")
    a = sorted(centroid_assign(e, c).collect())
    b = sorted(centroid_assign(e, c, max_centroids=3).collect())
    assert [(r.vec_id, r.label) for r in a] == [(r.vec_id, r.label) for r in b]


def test_get_clean(spark):
    from murmura.functions.html import get_clean
    df = spark.createDataFrame([("<div><span>\ta b\n</span></div>",), ("<p>x</p>",)], "html string")
    got = [r.v for r in df.select(get_clean("html", r"(?s)<span>(.*?)</span>").alias("v")).collect()]
    assert got == ["a b", ""]


def test_pages_to_posts_registry_single_pass(spark):
    html = '<html lang="en"><head><title>T</title></head><body><p>para</p><b class="n">7</b></body></html>'
    pages = spark.createDataFrame([(1, "http://a.example/x", html), (2, "http://b.example/y", html)],
                                  "page_id long, url string, html string")
    special = {"b.example": lambda h, u: {"url": u, "site": F.lit("B"),
                                          "views": F.regexp_extract(h, r'<b class="n">(\d+)</b>', 1)}}
    got = {r.page_id: r for r in X.pages_to_posts(pages, extractors=special).collect()}
    assert (got[1].site, got[1].document, got[1].views) == ("a.example", "para", None)
    assert (got[2].site, got[2].document, got[2].views) == ("B", None, "7")
    plan = X.pages_to_posts(pages, extractors=special)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_entities_decoded_once(spark):
    from murmura.functions.html import unescape_entities
    df = spark.createDataFrame([("a &amp;lt; b &lt; c&nbsp;&quot;d&quot; &#39;e&#39;",)], "t string")
    assert df.select(unescape_entities("t").alias("u")).first().u == "a &lt; b < c\u00a0\"d\" 'e'"


def test_fences_unclosed_and_multiple(spark):
    from murmura.operators.report import convert_fences
    df = spark.createDataFrame([("a```x\ny```b```c\nd```e```open\nz",)], "t string")
    assert df.select(convert_fences("t").alias("c")).first().c == "ax;ybc;de```open\nz"


def test_report_check_statuses(spark):
    from murmura.operators.report import report_check
    rows = [("긍정 10.0% 부정 20.0% 중립 70.0% 주제 50.0% quote: great product indeed", 0),
            ("only 10.0%", 0), ("only 10.0%", 2)]
    d = spark.createDataFrame(rows, "draft string, iteration int").select(
        "*", F.lit(10.0).alias("pos_pct"), F.lit(20.0).alias("neg_pct"), F.lit(70.0).alias("neu_pct"),
        F.array(F.lit(50.0)).alias("topic_pcts"), F.array(F.lit("great product indeed and more")).alias("top_pos"),
        F.array().cast("array<string>").alias("top_neg"))
    got = [r.status for r in report_check(d, quote_len=12).collect()]
    assert got[0] == "PASS" and got[2] == "PASS"
    assert got[1] == "RETRY: missing negative share, neutral share, topic ratios, quoted opinion"


def test_zip_links_cut_at_shorter(spark):
    html = '<a href="/1">one</a><a href="/2">two</a><a href="/3" >'
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert [(r.href, r.label) for r in X.zip_links(pages).orderBy("pos").collect()] == [("/1", "one"), ("/2", "two")]


def test_leaf_elements_with_attributes(spark):
    html = '<title id="t">Tt</title><p class="a">one</p><pre>no</pre><p>two</p><li data-x="1">i</li>'
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert X.page_text(pages).first().text == "one two"
    assert X.page_fields(pages).first().title == "Tt"
    assert X.page_text_list(pages).first()["items"] == "i"


def test_report_check_reads_a_draft_once_and_keeps_columns(spark):
    """The numbers of a draft are one column, not an expression of every fact."""
    from murmura.operators.report import report_check
    d = spark.createDataFrame([("10.0% 20.0% 70.0% 50.0% fine words", 0, "a", "b")], "draft string, iteration int, told string, _want string").select(
        "*", F.lit(10.0).alias("pos_pct"), F.lit(20.0).alias("neg_pct"), F.lit(70.0).alias("neu_pct"),
        F.array(F.lit(50.0)).alias("topic_pcts"), F.array(F.lit("fine words")).alias("top_pos"), F.array().cast("array<string>").alias("top_neg"))
    r = report_check(d)
    assert r._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = r.collect()[0]
    assert (got.status, got.told, got._want) == ("PASS", "a", "b") and r.columns == [*d.columns, "missing", "status"]


def test_embedder_counts_runs_of_rows(monkeypatch):
    """Memory follows AT_ONCE tokens, not the batch; counts do not depend on it."""
    import pyarrow as pa
    from murmura.operators import scoring as S
    words = pa.array([["a", "b", "a"], None, [], ["c"] * 50, ["b"], ["a", "d"]], pa.list_(pa.string()))
    whole, seen, run = S._bucket_counts(words, 16), [], S._run_counts
    monkeypatch.setattr(S, "AT_ONCE", 4)
    monkeypatch.setattr(S, "_run_counts", lambda w, dim: (seen.append(len(w.flatten())), run(w, dim))[1])
    assert (S._bucket_counts(words, 16) == whole).all() and whole.sum() == 56
    assert sum(seen) == 56 and sorted(seen)[-1] == 50 and sorted(seen)[-2] <= 4
