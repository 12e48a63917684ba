"""Property checks: the JVM column functions against the Python behaviour
they reproduce, on random strings (one Spark job per property)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from murmura.functions import text as TX

WS = [c for c in map(chr, range(0x3001)) if c.isspace()]          # Python's own whitespace set
alphabet = st.sampled_from(WS + list("ab-1 수정일:") + ["한", "é", "\u200b"])
texts = st.lists(st.text(alphabet=alphabet, max_size=30), min_size=50, max_size=50)


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_strip_matches_python(spark, values):
    assert run(spark, TX.ustrip, values) == [v.strip() for v in values]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_collapse_and_board_match_python(spark, values):
    assert run(spark, TX.collapse_ws, values) == [re.sub(r"\s+", " ", v) for v in values]
    exp = [re.sub(r"^\d+\s*|\s{2,}", " ", v).strip().split("-")[0] for v in values]
    assert run(spark, TX.clean_board, values) == exp


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_blank_matches_python(spark, values):
    from pyspark.sql import functions as F
    got = run(spark, lambda c: TX.is_blank(c).cast("boolean"), values)
    assert got == [v.strip() == "" for v in values]
    assert run(spark, lambda c: F.char_length(c), values) == [len(v) for v in values]


dates = st.lists(st.builds(lambda a, b, c: a + b + c, st.text(alphabet=alphabet, max_size=8),
                           st.sampled_from(["수정일 : 2024-01-03 03:04:05", " 수정일:2024-01-03 03:04:05 ", ""]),
                           st.text(alphabet=alphabet, max_size=8)), min_size=50, max_size=50)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=dates)
def test_clean_date_matches_python(spark, values):
    exp = [re.sub(r"\s*수정일\s*:\s*\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "", v).strip() for v in values]
    assert run(spark, TX.clean_date, values) == exp


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=st.sampled_from(WS + ["a", "\x00", "\r", "한"]), max_size=12),
                       min_size=50, max_size=50))
def test_prep_and_truncate_match_python(spark, values):
    assert run(spark, lambda c: TX.prep_for_sentiment(c, 5), values) == \
        [v[:5].replace("\x00", "").replace("\r", " ").strip() for v in values]
    assert run(spark, lambda c: TX.truncate_ellipsis(c, 4), values) == \
        [v[:4] + "..." if len(v) > 4 else v for v in values]
