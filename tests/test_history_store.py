"""History pairing/windows and the store's url semantics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmura.operators.history import last_k_turns, pair_turns, positions
from murmura.operators.store import VectorStore, anti_by_url, delete_status
from murmura.schema import POST_SCHEMA


def msgs(spark, n, conv=1):
    roles = ["user", "assistant"]
    return spark.createDataFrame([(conv, t, roles[t % 2], f"m{t}") for t in range(n)],
                                 "conv_id long, turn long, role string, text string")


def test_odd_history_gives_one_pair(spark):
    p = pair_turns(msgs(spark, 3)).collect()
    assert [(r.question, r.answer) for r in p] == [("m0", "m1")]


def test_last_k_all_messages_when_k_covers(spark):
    assert last_k_turns(msgs(spark, 7), k=5).count() == 7     # 3 pairs + tail, k >= pairs
    assert last_k_turns(msgs(spark, 14), k=5).count() == 10   # 7 pairs -> last 5 pairs


def test_system_turns_dropped_before_pairing(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")],
                               "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in pair_turns(df).collect()] == [("q", "a")]


def test_blocked_positions_equal_row_number(spark):
    df = spark.createDataFrame([(c, t * 3 + c) for c in range(3) for t in range(50)], "g long, o long")
    got = positions(df, ["g"], "o", block=4).select("g", "o", "pos")
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(got.collect()) == sorted(exp.collect())


def post_rows(spark, rows):
    full = [{**{c: None for c in POST_SCHEMA.fieldNames()}, **r} for r in rows]
    return spark.createDataFrame(full, POST_SCHEMA).withColumn("user_id", F.lit("u")).withColumn("keyword", F.lit("k"))


def test_null_url_matches_stored_null_and_batch_duplicates_kept(spark):
    store = post_rows(spark, [{"url": None, "document": "x"}, {"url": "a", "document": "y"}])
    batch = post_rows(spark, [{"url": None, "document": "n"}, {"url": "b", "document": "1"},
                              {"url": "b", "document": "2"}, {"url": "a", "document": "z"}])
    new = anti_by_url(batch, store).collect()
    assert sorted(r.document for r in new) == ["1", "2"]


def test_store_append_and_replay(spark, tmp_path):
    vs = VectorStore(spark, str(tmp_path))
    batch = post_rows(spark, [{"url": "a", "document": "hello"}, {"url": "b", "document": "world"},
                              {"url": "c", "document": "   "}])
    assert vs.append_new(batch) == 2       # no store yet: every valid row
    assert vs.append_new(batch) == 0       # replay adds nothing
    assert vs.read().count() == 2
    assert vs.keywords().count() == 1


def test_delete_status(spark):
    k = "user_id string, keyword string"
    s = spark.createDataFrame([("u", "a"), ("u", "b")], k)
    h = spark.createDataFrame([("u", "a")], k)
    r = {(x.keyword): x.status for x in delete_status(s, s, h).collect()}
    assert r == {"a": "delete success", "b": "abnormal delete request"}


def test_read_history_empty_and_delete(spark, tmp_path):
    from murmura.sources.history import read_history
    assert read_history(spark, str(tmp_path / "none")).count() == 0
    vs = VectorStore(spark, str(tmp_path))
    assert vs.delete("u", "k") == "abnormal delete request"
    vs.append_new(post_rows(spark, [{"url": "a", "document": "hello"}]))
    assert vs.delete("u", "k") == "abnormal delete request"     # no history yet
    h = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    (h.withColumn("user_id", F.lit("u")).withColumn("keyword", F.lit("k"))
     .write.partitionBy("user_id", "keyword").parquet(vs.history_path))
    assert read_history(spark, vs.history_path, "u", "k").count() == 1
    assert vs.delete("u", "k") == "delete success"
    assert vs.read().count() == 0


def test_drop_stale_runs_keeps_latest(spark, tmp_path):
    from murmura.operators.store import drop_stale_runs, read_runs, write_runs
    rows = [("u", "k", f"2024-01-0{d}T00h00m00s", f"doc{d}") for d in (1, 2, 3)] + [("u", "j", "2024-01-01T00h00m00s", "x")]
    df = spark.createDataFrame(rows, "user_id string, keyword string, run_id string, document string")
    path = str(tmp_path / "runs")
    write_runs(df, path)
    assert drop_stale_runs(spark, path, df) == 2
    left = sorted((r.keyword, r.run_id) for r in read_runs(spark, path).select("keyword", "run_id").collect())
    assert left == [("j", "2024-01-01T00h00m00s"), ("k", "2024-01-03T00h00m00s")]


def test_land_run_csvs_replaces_and_removes(spark, tmp_path):
    from murmura.operators.store import land_run_csvs, read_runs
    from murmura.sources.posts import export_csv
    src = str(tmp_path / "csv")
    export_csv(post_rows(spark, [{"url": "a", "document": "x,\n\"y\""}, {"url": "b", "document": "z"}])
               .drop("user_id", "keyword"), src)
    out = str(tmp_path / "merged")
    assert land_run_csvs(spark, src + "/*.csv", out, "u", "my kw", "2024-01-01T00h00m00s", remove_sources=True) == 2
    # sources are gone: a second landing is an empty run and keeps the merge
    assert land_run_csvs(spark, src + "/*.csv", out, "u", "my kw", "2024-01-01T00h00m00s") == 0
    back = read_runs(spark, out, "u", "my_kw")
    assert sorted(r.document for r in back.collect()) == ['x,\n"y"', "z"]


def test_answer_inputs(spark):
    from murmura.plans.retrieval import answer_inputs
    store = spark.createDataFrame(
        [(1, "u", "k", "near", None, [1.0, 0.0]), (2, "u", "k", "far", None, [0.0, 1.0]),
         (3, "v", "k", "other store", None, [1.0, 0.0])],
        "doc_id long, user_id string, keyword string, document string, postdate string, embedding array<float>")
    qs = spark.createDataFrame([("q1", "u", "k")], "qid string, user_id string, keyword string")
    var = spark.createDataFrame([("q1", 0, "u", "k", [1.0, 0.1]), ("q1", 1, "u", "k", [0.1, 1.0])],
                                "parent_qid string, variant int, user_id string, keyword string, embedding array<float>")
    hist = spark.createDataFrame([("u", "k", 1, 0, "user", "hi"), ("u", "k", 1, 1, "assistant", "yo")],
                                 "user_id string, keyword string, conv_id long, turn long, role string, text string")
    r = answer_inputs(qs, var, store, hist, k=1).first()
    assert r.context == "내용 : near, 날짜 : nan\n\n내용 : far, 날짜 : nan"
    assert r.history == "user: hi\nassistant: yo"


def test_stream_batch_replay_adds_nothing(spark, tmp_path):
    from murmura.operators.scoring import RuleRelevance
    from murmura.streaming.ingest import ingest_batch_fn
    batch = post_rows(spark, [{"url": "a", "document": "k is great"}, {"url": "b", "document": "about k"},
                              {"url": "c", "document": "nothing"}])
    run = ingest_batch_fn(spark, str(tmp_path), RuleRelevance(), categories=[])
    run(batch, 0)
    run(batch, 0)          # the same micro-batch delivered again after a failure
    assert VectorStore(spark, str(tmp_path)).read().count() == 2


def test_hot_url_anti_join(spark):
    # one url holds a third of the batch: every copy is new (none stored) or none is
    rows = [{"url": "hot", "document": f"d{i}"} for i in range(30)] + \
           [{"url": f"u{i}", "document": f"e{i}"} for i in range(60)]
    batch = post_rows(spark, rows)
    store = post_rows(spark, [{"url": "u1", "document": "x"}])
    assert anti_by_url(batch, store).count() == 89
    store2 = post_rows(spark, [{"url": "hot", "document": "x"}])
    assert anti_by_url(batch, store2).count() == 60


def test_stream_dedup_with_watermark(spark, tmp_path):
    from murmura.streaming.dedup import stream_dedup
    land = str(tmp_path / "land")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:01:00")]
    (spark.createDataFrame(rows, "url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
     .write.parquet(land))
    src = spark.readStream.schema("url string, ts timestamp").parquet(land)
    out = str(tmp_path / "out")
    q = (stream_dedup(src, event_time="ts", delay="1 hour").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_sized_broadcast_bound(spark):
    from murmura.session import sized_broadcast
    df = spark.range(10)
    small = sized_broadcast(df, 10)
    big = sized_broadcast(df, 9)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower() or small is not df
    assert big is df


def test_segments_joined_are_the_whole_json(spark):
    from murmura.operators.history import conversation_json, conversation_segments, pair_turns
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f'{c} "q" {t}\n' if t % 5 else None)
            for c, n in ((1, 41), (2, 2), (None, 9), (3, 1)) for t in range(n)]
    pairs = pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = conversation_segments(pairs, pairs_each=3).collect()
    assert max(r.n_pairs for r in parts) == 3 and len(parts) == 7 + 1 + 2
    joined = {}
    for r in sorted(parts, key=lambda r: r.segment):
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.json
    assert joined == {r.conv_id: r.json for r in conversation_json(pairs).collect()}
    assert conversation_segments(pairs.limit(0)).count() == 0
