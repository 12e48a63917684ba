"""Balanced elements, and the site extractors on nested blocks."""

from pyspark.sql import functions as F

from murmura.functions.elements import Step, find, first_text, inner_html
from murmura.functions.html import hrefs
from murmura.operators import extract as X


def test_balanced_content():
    page = "<div class='a'>one<div>two</div><p>x<p>three</div><div class='a'>no</div>"
    assert find(page, [Step("div", "class", "a")]) == "one<div>two</div><p>x<p>three"
    assert find(page, [Step("div", "class", "a"), Step("p", nth=2)]) == "three"
    assert find("<div id=z><i>never closed", [Step("*", "id", "z")]) == "<i>never closed"
    assert find("<div data-id='z'></div>", [Step("*", "id", "z")]) is None and find("", [Step("p")]) is None
    assert find("<div><script>'</div><p>'</script><p>in</p></div>", [Step("div"), Step("p", direct=True)]) == "in"
    assert find("<b><i></b>x</i><p>y</p>", [Step("p")]) == "y"
    assert find("<div><div><p>deep</p></div><p>own</p></div>", [Step("div", direct=True), Step("p", direct=True)]) == "own"
    assert find('<p title="never>broken</p><p>b</p>', [Step("p")]) == "broken"


def test_deep_pages_take_linear_time():
    import time
    began = time.perf_counter()
    find("<div>" * 20000 + "</span>" * 20000, [Step("p")])
    assert time.perf_counter() - began < 5


def test_nested_site_blocks(spark):
    clien = '<div class="post_article"><p>one</p><div><p>two</p></div><p>three</p></div><p>reply</p>'
    quasar = '<div id="org_contents">first <b>bold</b><div>inner</div> last</div>'
    meeco = '<div id="bBd"><article><div><div>x</div><div><div>a</div>b <div>c<div>d</div></div></div><div>no</div></div></article></div>'
    rows = [(1, "https://www.clien.net/1", clien), (2, "https://quasarzone.com/1", quasar), (3, "https://meeco.kr/1", meeco), (4, "https://meeco.kr/2", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.document for r in X.pages_to_posts(df).collect()}
    assert got == {1: "one two three", 2: "first boldinner last", 3: "a b c d", 4: None}
    first = {"quasarzone.com": lambda h, u: X.quasarzone_fields(h, u, first_node=True)}
    assert X.pages_to_posts(df.where("page_id = 2"), first).first().document.strip() == "first"
    assert df.select(first_text(F.lit("<b><!-- c -->x<i>y")).alias("t")).first().t == "x"
    assert df.where("page_id = 4").select(inner_html("html", Step("p")).alias("t")).first().t is None


def test_href_is_the_attribute_of_that_name(spark):
    html = """<a data-href="/track" href="/real">x</a><a title='href="/no"' href=/two>y</a><a data-href="/only">z</a>"""
    assert spark.createDataFrame([(html,)], "html string").select(hrefs("html").alias("h")).first().h == ["/real", "/two"]
