"""Hand-made rows for the semantics decisions of text and filter operators."""

from pyspark.sql import functions as F

from murmura.functions import text as TX
from murmura.operators import filters as FL
from murmura.schema import POST_SCHEMA


def posts_df(spark, rows):
    full = [{c: r.get(c) for c in POST_SCHEMA.fieldNames()} for r in rows]
    return spark.createDataFrame(full, POST_SCHEMA)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_blank_and_null_documents_dropped(spark):
    df = posts_df(spark, [{"url": "a", "document": " 　"}, {"url": "b", "document": None},
                          {"url": "c", "document": " ok "}, {"url": "d", "document": "\x1c\t"}])
    assert [r.url for r in FL.valid_posts(df).collect()] == ["c"]


def test_category_substring_null_and_absent(spark):
    df = posts_df(spark, [{"url": "a", "boardcategory": "중고장터"}, {"url": "b"},
                          {"url": "c", "documentcategory": "정치 게시판"}, {"url": "d", "boardcategory": "뉴스"}])
    assert sorted(r.url for r in FL.exclude_categories(df).collect()) == ["b", "d"]
    # absent column: filter on it is skipped
    only = df.drop("boardcategory", "documentcategory")
    assert FL.exclude_categories(only).count() == 4


def test_relevance_label_case(spark):
    df = spark.createDataFrame([(" Yes, because",), ("no",), ("YES",), (None,)], "relevance string")
    assert [r.relevance for r in FL.relevance_filter(df).collect()] == [" Yes, because", "YES"]


def test_views_parsing(spark):
    df = spark.createDataFrame([("12",), ("1,234",), (None,), ("abc",)], "v string")
    assert [r.n for r in df.select(TX.safe_int("v").alias("n")).collect()] == [12, 0, 0, 0]


def test_clean_date_board_and_ws(spark):
    assert one(spark, TX.clean_date, "2024-01-02 03:04:05 수정일 : 2024-01-03 03:04:05") == "2024-01-02 03:04:05"
    assert one(spark, TX.clean_board, "12 뉴스   게시판 - x") == "뉴스 게시판 "
    assert one(spark, TX.collapse_ws, "a \n\t b　c") == "a b c"
    assert one(spark, TX.clean_str, "\ta b\n ") == "a b"
    assert one(spark, TX.clean_str, None) == ""


def test_prep_and_truncate(spark):
    assert one(spark, TX.prep_for_sentiment, "  a\x00b\rc  ") == "ab c"
    assert one(spark, lambda c: TX.truncate_ellipsis(c, 3), "abcd") == "abc..."
    assert one(spark, lambda c: TX.truncate_ellipsis(c, 3), "abc") == "abc"


def test_strip_counts_code_points(spark):
    assert one(spark, lambda c: F.char_length(TX.ustrip(c)), "　한국어 ") == 3


def test_render_missing_prints_nan(spark):
    df = spark.createDataFrame([("x", None)], "page_content string, postdate string")
    r = df.select(TX.render("내용 : {page_content}, 날짜 : {postdate}").alias("t")).first().t
    assert r == "내용 : x, 날짜 : nan"
