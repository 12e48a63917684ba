"""Stored HTML pages -> post records, links and result-page requests."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import constants as K
from murmura.functions.elements import Step, first_text, inner_html
from murmura.functions.html import (R_ANCHOR_TEXT, absolute_url, extract_all, extract_field, first_match, get_clean, host_of,
                                    hrefs, leaf_pattern, strings_of, text_joined, unescape_all, unescape_entities)
from murmura.functions.text import clean_board, clean_date, clean_str, collapse_ws, strip_tags, ustrip
from murmura.schema import POST_COLUMNS

P_PARAGRAPH = leaf_pattern("p")
P_LIST_ITEM = leaf_pattern("li")
P_TITLE = leaf_pattern("title")
P_H1 = leaf_pattern("h1")
P_LANG = r'<html[^>]*\slang="([^"]*)"'


def page_text(pages: DataFrame, pattern: str = P_PARAGRAPH, sep: str = " ") -> DataFrame:
    """Text of the matched leaf elements, stripped, empties dropped, joined."""
    return pages.select("page_id", text_joined("html", pattern, sep).alias("text"))


def page_text_list(pages: DataFrame, pattern: str = P_LIST_ITEM, sep: str = "\n") -> DataFrame:
    """``string(.)`` of every match, cleaned, as a list and joined."""
    arr = strings_of("html", pattern)
    return pages.select("page_id", F.size(arr).alias("n_items"), F.array_join(arr, sep).alias("items"))


def page_fields(pages: DataFrame) -> DataFrame:
    """Single-valued fields with ordered fallbacks and defaults."""
    h = F.col("html")
    title = F.regexp_replace(first_match(h, P_TITLE), r"(?s)<[^>]*>", "")
    h1 = F.regexp_replace(first_match(h, P_H1), r"(?s)<[^>]*>", "")
    return pages.select(
        "page_id",
        first_match(h, P_LANG).alias("lang"),
        title.alias("title"),
        F.coalesce(F.nullif(ustrip(h1), F.lit("")), title).alias("headline"),
        ustrip(strip_tags(extract_field(h, [r'(?s)<div class="ad">(.*?)</div>'], default="0"), False)).alias("ad_text"),
        extract_field(h, [r'<em class="reply">(\d+)</em>', r'<span class="reply">(\d+)</span>'], default="0").alias("comment_cnt"))


def outlinks(pages: DataFrame) -> DataFrame:
    """Every ``<a href>`` with its position and the absolute url."""
    x = pages.select("page_id", "url", F.posexplode(hrefs("html")).alias("pos", "href"))
    return x.select("page_id", "pos", "href", absolute_url("url", "href").alias("abs_url"))


def zip_links(pages: DataFrame) -> DataFrame:
    """Positional pairing of link targets and link texts, cut at the shorter."""
    a = hrefs("html")
    b = F.transform(unescape_all(F.transform(extract_all("html", R_ANCHOR_TEXT), lambda x: strip_tags(x, False))), ustrip)
    n = F.least(F.size(a), F.size(b))
    z = F.arrays_zip(F.slice(a, 1, n).alias("href"), F.slice(b, 1, n).alias("label"))
    return pages.select("page_id", F.posexplode(z).alias("pos", "z")).select(
        "page_id", "pos", F.col("z.href").alias("href"), F.col("z.label").alias("label"))


def result_pages(hits: DataFrame, url_template: str, per_page: int = K.RESULTS_PER_PAGE,
                 key_cols=("host",), hit_col: str = "hit_text", chunk: int = 4096) -> DataFrame:
    """Hit count text (thousands separators allowed) -> n // per_page + 1
    result pages -> one request url per page (``%d`` in the template).

    Pages are expanded in two steps: ranges of ``chunk`` pages are spread
    over the shuffle partitions first, then each range is expanded, so one
    host with a huge hit count is not expanded by a single task."""
    n = F.regexp_replace(F.col(hit_col), "[^0-9]", "").try_cast("bigint")     # "1,050 hits" is 1050
    x = hits.select(*key_cols, (F.floor(n / per_page) + 1).cast("bigint").alias("n_pages"))
    ranges = x.select(*key_cols, "n_pages",
                      F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_pages") - 1) / chunk).cast("bigint"))).alias("_c"))
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(parts, *key_cols, "_c")
    lo = F.col("_c") * chunk + 1
    hi = F.least((F.col("_c") + 1) * chunk, F.col("n_pages"))
    x = ranges.select(*key_cols, "n_pages", F.explode(F.sequence(lo, hi)).alias("page_no"))
    return x.withColumn("url", F.format_string(url_template, *[F.col(c) for c in key_cols], F.col("page_no")))


def frontier(requests: DataFrame, seen: DataFrame, url_col: str = "url") -> DataFrame:
    """Requests not seen before, each url once."""
    r = requests.select(url_col).where(F.col(url_col).isNotNull()).distinct()
    s = seen.select(F.col(url_col).alias("_seen")).distinct()
    return r.join(s, r[url_col] == s["_seen"], "left_anti")


def to_post(df: DataFrame, **fields) -> DataFrame:
    """Assemble the 11-column post record (string columns; missing -> null).

    ``fields`` maps post column -> Column / column name / literal; other
    columns of ``df`` named in ``keep`` are passed through first."""
    keep = fields.pop("keep", [])
    cols = [F.col(c) for c in keep]
    for c in POST_COLUMNS:
        v = fields.get(c)
        if v is None:
            cols.append(F.lit(None).cast("string").alias(c))
        elif isinstance(v, Column):
            cols.append(v.cast("string").alias(c))
        elif isinstance(v, str) and v in df.columns:
            cols.append(F.col(v).cast("string").alias(c))
        else:
            cols.append(F.lit(v).cast("string").alias(c))
    return df.select(*cols)


def generic_fields(html: Column, url: Column) -> dict[str, Column]:
    """Article pages: paragraphs as the document, page url as the post url."""
    return {
        "url": url, "site": host_of(url), "document": text_joined(html, P_PARAGRAPH, " "),
        "comment_cnt": extract_field(html, [r'<em class="reply">(\d+)</em>'], default="0"),
        "boardcategory": F.regexp_replace(first_match(html, P_TITLE), r"(?s)<[^>]*>", ""),
        "documentcategory": first_match(html, P_LANG),
    }


def _inner(tag: str, attr: str) -> str:
    """Pattern of the content of the first ``tag`` whose opening holds ``attr``."""
    return f"(?s)<{tag}\\b[^>]*{attr}[^>]*>(.*?)</{tag}>"


def _cls(name: str) -> str:
    return f'class="{name}"'


def clien_fields(html: Column, url: Column) -> dict[str, Column]:
    """Posts of www.clien.net."""
    article = inner_html(html, Step("div", "class", "post_article"))
    blank = lambda c: F.nullif(c, F.lit(""))
    return {
        "url": url, "site": F.lit("clien"), "document": blank(text_joined(article, P_PARAGRAPH, " ")),
        "postdate": blank(clean_date(get_clean(first_match(html, _inner("div", _cls("post_author"))), _inner("span", "")))),
        "likes": blank(get_clean(html, _inner("a", 'class="symph_count(?: disable)?"'))),
        "comment_cnt": F.coalesce(blank(get_clean(first_match(html, _inner("a", _cls("post_reply"))), _inner("span", ""))), F.lit("0")),
        "views": blank(get_clean(first_match(html, _inner("span", _cls("view_count"))), _inner("strong", ""))),
        "boardcategory": blank(get_clean(first_match(html, _inner("div", _cls("board_name"))), _inner("a", ""))),
        "documentcategory": blank(get_clean(html, _inner("span", _cls("post_category")))),
    }


def quasarzone_fields(html: Column, url: Column, first_node: bool = False) -> dict[str, Column]:
    """Posts of quasarzone.com; the date stands in one of two places.  The
    document is the whole text of the contents, with ``first_node`` its first
    text node alone."""
    contents = inner_html(html, Step("*", "id", "org_contents"))
    whole = clean_str(unescape_entities(strip_tags(first_text(contents) if first_node else contents, drop_blocks=False)))
    blank = lambda c: F.nullif(c, F.lit(""))
    right = get_clean(first_match(html, _inner("p", _cls("right"))), _inner("span", ""))
    plain = get_clean(first_match(html, _inner("span", _cls("date notranslate"))), _inner("em", ""))
    return {
        "url": url, "site": F.lit("quasarzone"),
        "document": blank(whole),
        "postdate": F.coalesce(blank(right), blank(plain)),
        "comment_cnt": blank(get_clean(html, _inner("em", _cls("reply")))),
        "views": blank(get_clean(html, _inner("em", _cls("view")))),
        "boardcategory": blank(clean_board(get_clean(first_match(html, _inner("div", _cls("l-title"))), _inner("h2", "")))),
    }


def meeco_fields(html: Column, url: Column) -> dict[str, Column]:
    """Posts of meeco.kr: the second block of the article's first block."""
    blank = lambda c: F.nullif(c, F.lit(""))
    block = inner_html(html, Step("*", "id", "bBd"), Step("article"), Step("div", nth=1, direct=True), Step("div", nth=2, direct=True))
    body = clean_str(unescape_entities(strip_tags(F.regexp_replace(block, "<", " <"), drop_blocks=False)))
    head = first_match(html, r'(?s)id="bBd".*?<article\b[^>]*>.*?<header\b[^>]*>.*?<ul\b[^>]*>(.*?)</ul>')
    return {
        "url": url, "site": F.lit("meeco"), "document": blank(ustrip(collapse_ws(body))),
        "postdate": blank(get_clean(head, r"(?s)<li\b[^>]*>.*?</li>\s*<li\b[^>]*>.*?</li>\s*<li\b[^>]*>(.*?)</li>")),
        "likes": blank(get_clean(first_match(html, _inner("div", _cls("atc-vote-bts"))), _inner("span", _cls("num")))),
        "comment_cnt": blank(get_clean(html, _inner("span", _cls("ptCl num cmt-cnt-ori")))),
        "views": blank(get_clean(first_match(html, _inner("ul", _cls("ldd-title-under"))), _inner("span", _cls("num")))),
        "boardcategory": blank(get_clean(first_match(html, _inner("header", _cls("bBd-hd"))), _inner("a", ""))),
        "documentcategory": blank(get_clean(first_match(html, _inner("span", _cls("atc-ctg"))), _inner("a", ""))),
    }


# site (host) -> field extractor ``(html, url) -> {post column: Column}``.
EXTRACTORS: dict[str, Callable[[Column, Column], dict]] = {
    "www.clien.net": clien_fields, "quasarzone.com": quasarzone_fields, "meeco.kr": meeco_fields,
}


def register_extractor(site: str, fn: Callable[[Column, Column], dict]) -> None:
    EXTRACTORS[site] = fn


def pages_to_posts(pages: DataFrame, extractors: Mapping[str, Callable] | None = None,
                   default: Callable[[Column, Column], dict] | None = generic_fields,
                   keep=("page_id",)) -> DataFrame:
    """Post records from stored pages, each page parsed by the extractor of
    its host (the default for other hosts; without a default they yield
    nulls).  One projection with a CASE per column: a single pass over the
    pages whatever the number of sites, no union of per-site scans."""
    extractors = dict(EXTRACTORS if extractors is None else extractors)
    html, url = F.col("html"), F.col("url")
    host = host_of(url)
    per_site = {site: fn(html, url) for site, fn in extractors.items()}
    base = default(html, url) if default is not None else {}
    cols = [F.col(c) for c in keep]
    for c in POST_COLUMNS:
        expr = None
        for site, fields in per_site.items():
            v = fields.get(c, F.lit(None))
            expr = (F.when(host == site, v) if expr is None else expr.when(host == site, v))
        d = base.get(c, F.lit(None))
        expr = d if expr is None else expr.otherwise(d)
        cols.append(expr.cast("string").alias(c))
    return pages.select(*cols)
