"""CSV files read in byte ranges against the reader of whole files."""

import random

import pytest

from murmura.schema import POST_SCHEMA
from murmura.sources.posts import export_csv, read_posts_csv
from murmura.sources.split_csv import read_csv_split


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_ranges_give_the_rows_of_whole_files(spark, small_ranges, tmp_path):
    rng = random.Random(3)
    bits = ["plain", "a,b", 'say ""x""'.replace('""', '"'), "line\nbreak", "\n", '"', "", None, "ünï", "z" * 900, "q\n" * 200,
            "two  spaces", '",\n"']
    rows = [tuple(rng.choice(bits) for _ in POST_SCHEMA) for _ in range(150)]
    rows = [("u%d" % i, *r[1:]) for i, r in enumerate(rows)]
    export_csv(spark.createDataFrame(rows, POST_SCHEMA).repartition(2), str(tmp_path / "c"))
    want = rows_of(read_posts_csv(spark, str(tmp_path / "c")))
    assert len(want) == 150
    got = read_csv_split(spark, str(tmp_path / "c"))
    assert got.schema == POST_SCHEMA and rows_of(got) == want
    lines = spark.read.text(str(tmp_path / "c"))
    assert lines.rdd.getNumPartitions() > 20               # each file is many ranges


def test_empty_and_header_only_files_and_line_ends(spark, small_ranges, tmp_path):
    head = ",".join(POST_SCHEMA.names)
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text(head)
    (tmp_path / "c.csv").write_bytes((head + "\r\n" + "u1,s,\"x\r\ny\"" + "," * 8 + "\r\n\r\nu2,s,short\r\n").encode())
    (tmp_path / "d.csv").write_text(head + "\n" + "u3,s," + '"' + "long\n" * 500 + '"' + "," * 8)
    want = rows_of(read_posts_csv(spark, str(tmp_path)))
    assert [r[0] for r in want] == ["u1", "u2", "u3"]
    assert rows_of(read_csv_split(spark, str(tmp_path))) == want
