"""Commits of runs and stores: a job killed between two steps leaves the old state."""

import pytest
from pyspark.sql import functions as F

from murmura.operators import commits as C
from murmura.operators import store as S
from murmura.operators.scoring import RuleRelevance
from murmura.plans.ingest import run_ingest
from murmura.schema import POST_SCHEMA, RUN_KEYS


class Killed(Exception):
    pass


def posts(spark, urls, user="u", keyword="k", run="2024-01-01T00h00m00s", text="k is fine"):
    full = [{**{c: None for c in POST_SCHEMA.fieldNames()}, "url": u, "document": f"{text} {u}"} for u in urls]
    d = spark.createDataFrame(full, POST_SCHEMA)
    return d.withColumn("user_id", F.lit(user)).withColumn("keyword", F.lit(keyword)).withColumn("run_id", F.lit(run))


def urls(df):
    return sorted(r.url for r in df.select("url").collect())


def die(*a, **k):
    raise Killed


@pytest.mark.parametrize("step", ["publish", "_entry", "written"])
def test_killed_replace_keeps_the_old_run(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "runs")
    S.write_runs(posts(spark, ["a", "b"]), path)
    with monkeypatch.context() as m:
        m.setattr(C.CommitLog, step, die)
        with pytest.raises(Killed):
            S.write_runs(posts(spark, ["c"]), path)
    assert urls(S.read_runs(spark, path)) == ["a", "b"]
    S.write_runs(posts(spark, ["c"]), path)
    assert urls(S.read_runs(spark, path)) == ["c"]


def test_killed_rename_keeps_the_old_store(spark, tmp_path, monkeypatch):
    vs = S.VectorStore(spark, str(tmp_path))
    vs.append_new(posts(spark, ["a"]).drop("run_id"))
    real = C.file_system
    with monkeypatch.context() as m:                          # the entry is written, its rename never happens
        def broken(s, p):
            if "/_log/_" in p:
                raise Killed
            return real(s, p)
        m.setattr(C, "file_system", broken)
        with pytest.raises(Killed):
            vs.append_new(posts(spark, ["b"]).drop("run_id"))
        with pytest.raises(Killed):
            vs.overwrite(posts(spark, ["c"]).drop("run_id"))
    assert urls(vs.read()) == ["a"]
    assert vs.append_new(posts(spark, ["a", "b"]).drop("run_id")) == 1 and urls(vs.read()) == ["a", "b"]
    assert vs.overwrite(posts(spark, ["c"]).drop("run_id")) == 1 and urls(vs.read()) == ["c"]


@pytest.mark.parametrize("at", ["replace_runs", "append_new", "drop_stale_runs"])
def test_killed_ingest_is_repeated_without_loss(spark, tmp_path, monkeypatch, at):
    import murmura.plans.ingest as I
    root, scorer = str(tmp_path), RuleRelevance()
    first, second = posts(spark, ["a", "b"]), posts(spark, ["b", "c"], run="2024-01-02T00h00m00s")
    run_ingest(spark, first, root, scorer)
    with monkeypatch.context() as m:
        m.setattr(*((S.VectorStore, at) if at == "append_new" else (I, at)), die)
        with pytest.raises(Killed):
            run_ingest(spark, second, root, scorer)
    left = S.read_runs(spark, f"{root}/posts_filtered")
    assert urls(left.where("run_id like '2024-01-01%'")) == ["a", "b"]           # nothing goes before the store has it
    assert urls(S.VectorStore(spark, root).read()) == (["a", "b", "c"] if at == "drop_stale_runs" else ["a", "b"])
    run_ingest(spark, second, root, scorer)
    assert urls(S.VectorStore(spark, root).read()) == ["a", "b", "c"]
    assert urls(S.read_runs(spark, f"{root}/posts_filtered")) == ["b", "c"]


def test_run_without_rows_is_dropped_in_the_same_commit(spark, tmp_path):
    path = str(tmp_path / "runs")
    d = posts(spark, ["a"]).unionByName(posts(spark, ["b"], keyword="j"))
    S.write_runs(d, path)
    S.replace_runs(d.where("keyword = 'j'"), path, d)
    assert urls(S.read_runs(spark, path)) == ["b"] and len(S.run_log(spark, path).entries()) == 2


def test_retention_of_many_stores_is_one_entry(spark, tmp_path):
    path = str(tmp_path / "runs")
    d = None
    for k in range(30):
        for run in ("r1", "r2", "r3"):
            x = spark.range(1).select(F.lit(f"k{k}").alias("keyword"), F.lit(run).alias("run_id"))
            d = x if d is None else d.unionByName(x)
    rows = posts(spark, ["a"]).drop("keyword", "run_id").crossJoin(d)
    rows = rows.withColumn("user_id", F.when(F.col("keyword") != "k3", F.lit("u")))            # a null key too
    S.write_runs(rows, path)
    touched = rows.where("keyword in ('k1', 'k2', 'k3')")
    assert S.drop_stale_runs(spark, path, touched) == 6 and S.drop_stale_runs(spark, path, touched) == 0
    assert S.read_runs(spark, path).count() == 90 - 6 and len(S.run_log(spark, path).entries()) == 2


def test_fold_and_vacuum_change_no_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "ENTRIES", 4)
    path = str(tmp_path / "runs")
    for n in range(7):
        S.write_runs(posts(spark, [f"a{n}"]).unionByName(posts(spark, [f"b{n}"], run=f"r{n}")), path)
    log = S.run_log(spark, path)
    want = sorted(["a6", *[f"b{n}" for n in range(7)]])
    assert urls(S.read_runs(spark, path)) == want and len(log.entries()) < 7
    log.write(posts(spark, ["never committed"]))
    assert urls(S.read_runs(spark, path)) == want
    log.publish(log.drops(log.live().where("run_id = 'r2'").select(*RUN_KEYS)))
    S.write_runs(posts(spark, ["x"], run="r5"), path)
    want = sorted({*want, "x"} - {"b2", "b5"})
    assert log.vacuum() == 0 and log.vacuum(older_than_seconds=-1) >= 1
    assert urls(S.read_runs(spark, path)) == want
    log.fold()
    assert len(log.entries()) == 1 and urls(S.read_runs(spark, path)) == want


def test_ids_of_empty_urls_and_equal_rows(spark, tmp_path):
    vs = S.VectorStore(spark, str(tmp_path))
    batch = posts(spark, ["", "", "a"]).drop("run_id").repartition(2)
    assert vs.append_new(batch) == 3 and vs.append_new(batch) == 2       # '' is no url: added again
    ids = [r.doc_id for r in vs.read().select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == 5
