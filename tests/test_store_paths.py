"""The path from posts without ids to answers: ids, keys, empty and repeated
runs, declared types; and settings that the deployment made."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions.html import absolute_url, get_clean, hrefs, unescape_entities
from murmura.operators import extract as X
from murmura.operators.scoring import ArrowScorer, RuleRelevance
from murmura.operators.store import VectorStore, drop_stale_runs, merge_sites, read_runs, write_runs
from murmura.operators.vectors import cluster_stores, knn_topk
from murmura.plans.ingest import run_ingest
from murmura.plans.retrieval import answer_inputs, retrieve_context
from murmura.schema import POST_SCHEMA, RUN_KEYS
from murmura.sources.history import read_history, write_turns

RUN = "2024-01-01T00h00m00s"


def posts(spark, docs, user="u", keyword="k", run=RUN):
    rows = [{**{c: None for c in POST_SCHEMA.fieldNames()}, "url": f"url/{i}", "document": d} for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, POST_SCHEMA)
    return df.withColumns({"user_id": F.lit(user).cast("string"), "keyword": F.lit(keyword).cast("string"), "run_id": F.lit(run)})


def test_posts_without_ids_can_be_answered(spark, tmp_path):
    res = run_ingest(spark, posts(spark, [f"k word{i}" for i in range(5)] + ["off topic"]), str(tmp_path), RuleRelevance())
    assert res == {"status": "ok", "added": 5, "total_filtered": 5}
    store = VectorStore(spark, str(tmp_path)).read()
    ids = [r.doc_id for r in store.collect()]
    assert None not in ids and len(set(ids)) == 5
    asked = store.where(F.col("url") == "url/3").select(F.lit("q").alias("qid"), "embedding")
    assert "word3" in retrieve_context(asked, store, k=2).first().context


def test_equal_posts_get_different_stable_ids(spark, tmp_path):
    a, b = VectorStore(spark, str(tmp_path / "a")), VectorStore(spark, str(tmp_path / "b"))
    df = posts(spark, ["same", "x"]).withColumn("url", F.lit("one"))
    df = df.unionByName(df)
    a.overwrite(df)
    b.overwrite(df.repartition(3))
    ids = sorted(r.doc_id for r in a.read().collect())
    assert len(set(ids)) == 4 and ids == sorted(r.doc_id for r in b.read().collect())


@pytest.mark.parametrize("user,keyword", [("01", "007"), ("u", "a:b/c"), ("u", "two words"), ("ü", "가=나%"), (None, "k")])
def test_keys_stay_as_they_are(spark, tmp_path, user, keyword):
    runs = str(tmp_path / "runs")
    p = posts(spark, ["x", "y"], user, keyword)
    write_runs(p.unionByName(posts(spark, ["z"], user, keyword, "2024-01-02T00h00m00s")), runs)
    assert {(r.user_id, r.keyword) for r in read_runs(spark, runs).collect()} == {(user, keyword)}
    assert drop_stale_runs(spark, runs, p) == 1 and read_runs(spark, runs).count() == 1
    vs = VectorStore(spark, str(tmp_path))
    vs.append_new(p.drop("run_id"))
    assert [tuple(r) for r in vs.keywords().collect()] == [(user, keyword)]
    turns = spark.createDataFrame([(1, 0, "user", "q", user, keyword)],
                                  "conv_id long, turn long, role string, text string, user_id string, keyword string")
    write_turns(turns, vs.history_path)
    assert read_history(spark, vs.history_path).first().keyword == keyword
    assert vs.delete(user, keyword) == "delete success" and vs.read().count() == 0
    assert vs.delete(user, keyword) == "abnormal delete request"


def test_a_rerun_with_less_leaves_nothing_stale(spark, tmp_path):
    root = str(tmp_path)
    run_ingest(spark, posts(spark, ["k one", "k two"]).unionByName(posts(spark, ["k"], keyword="j")), root, RuleRelevance())
    again = run_ingest(spark, posts(spark, ["none", "nothing"]), root, RuleRelevance(yes="yes", exclude=["n"]))
    assert again["total_filtered"] == 0 and again["added"] == 0
    assert read_runs(spark, f"{root}/posts_filtered").where("keyword = 'k'").count() == 0


def test_empty_runs(spark, tmp_path):
    assert run_ingest(spark, posts(spark, ["nothing"]), str(tmp_path), RuleRelevance(exclude=["nothing"]))["added"] == 0
    assert read_runs(spark, str(tmp_path / "none")).count() == 0
    assert merge_sites([]).columns == POST_SCHEMA.fieldNames()


def test_null_keys_and_equal_turns_in_histories(spark):
    from murmura.operators.history import last_k_turns, pair_turns
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 0, "assistant", "d"), (1, 2, "user", "e")]
    h = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert last_k_turns(h, 5).count() == 5
    assert pair_turns(h).count() == 2
    plan = last_k_turns(h, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_answers_stay_in_their_store_and_history(spark):
    store = spark.createDataFrame([(1, "u", "k", "mine", None, [1.0, 0.0]), (1, "v", "k", "another tenant", None, [1.0, 0.0])],
                                  "doc_id long, user_id string, keyword string, document string, postdate string, embedding array<float>")
    qs = spark.createDataFrame([("q", "u", "k")], "qid string, user_id string, keyword string")
    var = spark.createDataFrame([("q", 0, "u", "k", [1.0, 0.0])],
                                "parent_qid string, variant int, user_id string, keyword string, embedding array<float>")
    hist = spark.createDataFrame([("u", "k", c, t, r, f"{c}.{t}") for c in (1, 2) for t, r in enumerate(["user", "assistant"] * 4)],
                                 "user_id string, keyword string, conv_id long, turn long, role string, text string")
    r = answer_inputs(qs, var, store, hist, k=2).first()
    assert "mine" in r.context and "tenant" not in r.context
    assert r.history.startswith("user: 1.6") and r.history.endswith("assistant: 2.7") and r.history.count("\n") == 9


def test_unusable_vectors_do_not_take_their_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [None, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0])]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.1]), ("n", [float("nan"), 1.0])], "qid string, embedding array<double>")
    assert [r.doc_id for r in knn_topk(docs, q, 2).orderBy("rank").collect()] == [1, 4]


def test_repeated_query_keys_beyond_one_broadcast(spark):
    docs = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 1.0])] * 4 + [("q", [float(i), 1.0]) for i in range(4)], "qid string, embedding array<double>")
    one = sorted(knn_topk(docs, q.dropDuplicates(), 3).collect())
    assert sorted(knn_topk(docs, q, 3, max_queries=3).collect())[:1] == one[:1]
    equal = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(500)], "doc_id long, embedding array<double>")
    assert [r.doc_id for r in knn_topk(equal, q.limit(1), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_stores_are_clustered_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, (rng.normal(size=4) + 5 * np.eye(4)[i % 3]).tolist()) for s, n in (("a", 40), ("b", 2)) for i in range(n)]
    df = spark.createDataFrame(rows + [("a", 999, [float("nan")] * 4)], "user_id string, doc_id long, embedding array<double>")
    got = cluster_stores(df, 10, group_cols=["user_id"]).collect()
    assert len(got) == 42 and len({r.cluster for r in got if r.user_id == "b"}) == 2
    assert len({r.cluster for r in got if r.user_id == "a"}) <= 10


def test_scorer_runs_requests_at_once_with_its_client(spark):
    import threading

    import pandas as pd
    barrier_size = 4

    def ask(texts, kws, client):
        client.wait(timeout=20)                        # passes only if four requests run together
        return pd.Series(["ok"] * len(texts))

    df = spark.range(0, barrier_size, 1, 1).select(F.col("id").cast("string").alias("t"))
    sc = ArrowScorer(ask, init=lambda: threading.Barrier(barrier_size), concurrency=barrier_size, request_rows=1)
    assert df.select(sc.column(F.col("t")).alias("s")).where("s = 'ok'").count() == barrier_size


@pytest.mark.parametrize("base", ["https://a.com", "https://a.com/", "https://a.com/x/y?q=1", "http://a.com/x/y/z#f", "https://a.com/d/"])
@pytest.mark.parametrize("href", ["foo", "?p=2", "../z", "#f", "", "./a/./b", "../../../up", "/abs/../c?d#e", "//o.com/x", "http://q/r", "mailto:x@y", "a/b/..", "x?y=../z"])
def test_urls_resolve_like_urljoin(spark, base, href):
    from urllib.parse import urljoin
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(absolute_url("b", "h").alias("u")).first().u == urljoin(base, href)


def test_links_in_any_quotes_and_all_references(spark):
    html = """<A HREF='/one'>1</A><a class=x href=/two>2</a><a href="/t?a=1&amp;b=2">3</a>"""
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(hrefs("html").alias("h")).first().h == ["/one", "/two", "/t?a=1&b=2"]
    t = spark.createDataFrame([("a&#8217;b &#x27;c&#39; &hellip; &copy; &middot; &amp;lt;",), (None,)], "t string")
    assert [r.u for r in t.select(unescape_entities("t").alias("u")).collect()] == ["a’b 'c' … © · &lt;", None]
    g = spark.createDataFrame([("<i>a &amp; b</i>",)], "html string")
    assert g.select(get_clean("html", "<i>(.*?)</i>").alias("v")).first().v == "a & b"


def test_hit_counts_with_words(spark):
    hits = spark.createDataFrame([("h", "1,050건"), ("n", "none")], "host string, hit_text string")
    assert X.result_pages(hits, "https://%s/?p=%d").groupBy("host").count().collect() == [("h", 51)]


CLIEN = """<div class="board_name"><h2><a href="#">새소식</a></h2></div><span class="post_category">[기타]</span>
<a class="post_reply" href="#"><span>12</span></a><div class="post_author"><span>2024-01-02 03:04:05 수정일 : 2024-01-03 03:04:05</span></div>
<span class="view_count"><strong>1,234</strong></span><a class="symph_count disable"><strong>3</strong></a>
<div class="post_article"><p>첫 문단 &amp; 더</p><p><strong>둘째</strong></p></div>"""
QUASAR = """<div class="l-title"><h2>12 뉴스   게시판 - x</h2></div><span class="date notranslate"><em>2024.01.02</em></span>
<em class="view">77</em><em class="reply">4</em><div id="org_contents">본문 글</div>"""
MEECO = """<div id="bBd"><header class="bBd-hd"><a href="#">미니</a></header><article><header><ul><li>a</li><li>b</li><li>2024-05-06</li></ul></header>
<div class="c"><div>x</div><div>본문   하나
둘</div></div></article></div><div class="atc-vote-bts"><span class="num">9</span></div><span class="ptCl num cmt-cnt-ori">2</span>
<ul class="ldd-title-under"><li><span class="num">55</span></li></ul><span class="atc-ctg"><a href="#">잡담</a></span>"""


def test_site_extractors(spark):
    rows = [(1, "https://www.clien.net/service/1", CLIEN), (2, "https://quasarzone.com/bbs/1", QUASAR), (3, "https://meeco.kr/mini/1", MEECO)]
    got = {r.page_id: r for r in X.pages_to_posts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.document, a.postdate, a.views, a.likes, a.comment_cnt, a.boardcategory, a.documentcategory) == \
        ("첫 문단 & 더 둘째", "2024-01-02 03:04:05", "1,234", "3", "12", "새소식", "[기타]")
    assert (b.document, b.postdate, b.views, b.comment_cnt, b.boardcategory) == ("본문 글", "2024.01.02", "77", "4", "뉴스 게시판 ")
    assert (c.document, c.postdate, c.views, c.likes, c.comment_cnt, c.boardcategory, c.documentcategory) == \
        ("본문 하나둘", "2024-05-06", "55", "9", "2", "미니", "잡담")


def test_report_check_compares_whole_numbers(spark):
    from murmura.operators.report import report_check
    d = spark.createDataFrame([("45.0% and 13.0% and 5.0%, a real opinion",), ("3.0% 5.0% 5.0% and 92.0%: a real opinion",)], "draft string").select(
        "*", F.lit(0).alias("iteration"), F.lit(5.0).alias("pos_pct"), F.lit(3.0).alias("neg_pct"), F.lit(92.0).alias("neu_pct"),
        F.array(F.lit(5.0)).alias("topic_pcts"), F.array(F.lit("a real opinion"), F.lit("")).alias("top_pos"),
        F.array().cast("array<string>").alias("top_neg"))
    assert [r.status == "PASS" for r in report_check(d).collect()] == [False, True]


def test_no_topic_is_lost_for_its_name(spark):
    from murmura.operators.topics import topic_terms
    rows = [(0, "요금 요금 속도"), (0, "요금"), (1, "x" * 40), (2, "alphabetical alphabetically alphabetised")]
    df = spark.createDataFrame(rows, "cluster int, document string")
    got = {r.cluster: r.topic for r in topic_terms(df, group_cols=[]).collect()}
    assert got == {0: "요금 속도", 1: "x" * 30, 2: "alphabetical alphabetically"}


def test_views_beyond_bigint_still_rank(spark):
    from murmura.functions.text import safe_int
    df = spark.createDataFrame([("9" * 20,), ("12",), ("1,2",), (None,)], "v string")
    assert [int(r.n) for r in df.select(safe_int("v").alias("n")).collect()] == [int("9" * 20), 12, 0, 0]


def test_given_settings_survive(tmp_path):
    code = ("from murmura.session import get_spark; s = get_spark(); c = s.sparkContext; "
            "get_spark(shuffle_partitions=8); print('GOT', c.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.ui.enabled'))")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.sql.shuffle.partitions=37 pyspark-shell",
                        "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout
    assert "GOT local[2] 37 false" in out


def test_no_text_is_shuffled_for_a_few_hits(spark):
    import __spark_entry__ as E
    from data_dirs import SF_SMALL
    plan = E.queries()["retrieve_context"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_run_keys_are_text():
    from murmura.schema import RUN_SCHEMA
    assert {RUN_SCHEMA[k].dataType.simpleString() for k in RUN_KEYS} == {"string"}
