"""Main text, toxicity, quality rules, token counts: edge cases and brute force."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, awkward, documents, prose, row, words

from murmura.llm import html_blocks as H
from murmura.llm import quality as Q
from murmura.llm import token_counts as T
from murmura.llm import toxicity as X
from murmura.llm.queries import vocabulary

MODEL = vocabulary()


# ------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name that is not the article</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work as you expect it to, please accept them all now.</p></div>
<div class="content"><h2>A &amp; B</h2><p>The first   paragraph&nbsp;is long enough to be a surge of text, and it has a <b>bold</b> word
and a <a href="/x">link</a> inside.<p>Short.<div class="ad">Buy this thing today, it is the best thing that you can buy</div>
<p>Last one &#8217;quoted&#x27; &hellip; 1 &lt; 2</p><form><input><label>Your mail address</label></form></div>
<aside><p>Related things that other readers liked very much and that you may like as well, who knows.</p></aside>
<section id="comments"><p>I do not agree with any of this and I will say so at length in this comment here.</p></section>
<footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_page_without_article_element():
    assert H.main_text(PAGE) == ("A & B\nThe first paragraph is long enough to be a surge of text, and it has a bold word "
                                 "and a link inside.\nShort.\nLast one ’quoted' … 1 < 2")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"),
    ("<article><p>x</p></article><p>outside</p>", "x"), ("<p>a &lt;b&gt; c</p>", "a <b> c"),
    ("<p>cut off <b", "cut off"), ("<p>x</p><script>var t = 1", "x"), ("<p>x<!-- never closed <p>y", "x"),
    ("<P CLASS='Ad'>no</P><P>yes</P>", "yes"), ("<p>a<br>b</p>", "a b"), ("</div></p><p>ok</p>", "ok")])
def test_main_text_of_broken_and_small_pages(page, text):
    assert H.main_text(page) == text


def test_surge_and_dive():
    w = np.array([0, 5, 0, 0, 0, 40, 60, 3, 0, 50, 0, 0, 0, 7])
    assert H.runs(w) == [(5, 10)]
    assert H.runs(np.array([0, 3, 0, 0, 0, 9])) == [(5, 6)]           # nothing surges: the heaviest run
    assert H.runs(np.zeros(3, int)) == []


def test_pages_with_nulls_repeats_and_clashes(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, "old"), (None, "v", "<p>z", None),
            (3, "w", "<p>" + "long text " * 50000 + "</p>", "old")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract_main_text(df).orderBy("page_id").collect()
    assert [r.text if r.page_id != 3 else len(r.text) for r in got] == ["z", H.main_text(PAGE), H.main_text(PAGE), "", 499999]
    assert H.extract_main_text(df.limit(0)).count() == 0


# ------------------------------------------------------------------ tokens

@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_add_up_to_the_whole(name, monkeypatch):
    rng = random.Random(1)
    pieces = ["a", "the", " ", "  ", "\n", "é", "foo", "\t", " a", "▁", "1", "中", "'s", "<s>", "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    run, cut = T.encoder(vocabulary(name))
    whole = [len(run([t])[0]) for t in texts]
    small = T.parts
    monkeypatch.setattr(T, "parts", lambda t, c, size=20: small(t, c, 20))
    assert [sum(map(len, p)) for p in T.encoded(vocabulary(name), texts)] == whole


def test_token_counts_on_awkward_rows(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = documents(spark, awkward())
    got = T.token_counts(df.withColumn("n_tokens", df.n), MODEL)
    assert got.columns == df.columns + ["n_tokens"]
    for r in got.collect():
        assert r.n_tokens == len(sp.encode(r.text or ""))
    assert T.token_counts(df.limit(0), MODEL).count() == 0


# ----------------------------------------------------------------- quality

def brute_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = [], 0
    for line in text.split("\n"):
        dup += bool(words(line)) and line in seen
        seen.append(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
    cover = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_base_counts_against_brute_force():
    rng = random.Random(2)
    texts = [r[1] for r in awkward()] + ["a b c d e a b c d e", "x\nx\n\n\n x\nx", "#*$ a|b <c>\n#*$ a|b <c>", "\x1ca b\x0bc"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    col = pa.array([t or "" for t in texts])
    from murmura.llm import arrays as A
    got = Q.base_counts(*A.text_buffer(col), col.to_pylist())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in names) == brute_counts(t), repr(t)[:80]


def test_bands_keep_prose_and_reject_noise(spark):
    rng = random.Random(3)
    rows = [row(i, prose(rng, rng.randint(60, 120))) for i in range(300)]
    rows += [row(1000 + i, " ".join("".join(rng.choice("xqzjkw%~") for _ in range(5)) for _ in range(35))) for i in range(10)]
    rows += [row(2000, None), row(2001, ""), row(2002, "too short"), row(None, prose(rng, 90), None, None), row(0, rows[0][1])]
    got = {r.doc_id: r for r in Q.quality(documents(spark, rows), MODEL).collect()}
    assert sum(got[i].kept for i in range(300)) >= 297
    assert not any(got[1000 + i].kept for i in range(10))
    assert [got[i].base_failed for i in (2000, 2001, 2002)] == [True] * 3 and not got[2000].kept
    assert got[None].kept
    assert Q.quality(spark.createDataFrame([], DOCS), MODEL).count() == 0


def test_bands_by_hand(spark):
    """Median and spread of a group, worked out on the driver: bins with under
    30 texts take in their neighbours, so every bin has a band."""
    rng = random.Random(4)
    df = Q.measure(documents(spark, [row(i, prose(rng, 70 if i < 60 else 30 * (i - 50))) for i in range(75)]), MODEL).cache()
    rows = df.where(~Q.base_failed()).collect()
    bands = {r._b: r for r in Q.fit_bands(df, df.lang).collect()}
    assert sorted(bands) == list(range(4, 15))
    bin_of = lambda r: min(max(int(math.log2(r.n_tokens)), 4), 14)
    mids, devs = {}, {}
    for b in bands:
        wide = next(w for w in range(11) if sum(abs(bin_of(r) - b) <= w for r in rows) >= 30)
        q = sorted(round(r.chars_per_token * Q.STEP) for r in rows if abs(bin_of(r) - b) <= wide)
        mids[b] = q[(len(q) + 1) // 2 - 1]
        devs[b] = sorted(abs(x - mids[b]) for x in q)[(len(q) + 1) // 2 - 1]
    for b, band in bands.items():
        dev = max(devs[b], min(devs[b - 1], devs[b + 1])) if b - 1 in devs and b + 1 in devs else devs[b]
        assert abs(band._lo_chars_per_token - (mids[b] / Q.STEP - 6 * max(dev / Q.STEP * 1.4826, 0.02))) < 1e-9


def test_a_text_alone_in_its_bin_language_and_script_is_judged(spark):
    """Junk is rejected though no other text has its size or language."""
    rng = random.Random(5)
    rows = [row(i, prose(rng, rng.randint(60, 90))) for i in range(80)]
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(9)) for _ in range(3000))
    got = {r.doc_id: r.kept for r in Q.quality(documents(spark, rows + [row(900, junk, lang="xx"), row(901, prose(rng, 4000), lang="yy")]), MODEL).collect()}
    assert not got[900] and got[901] and sum(got[i] for i in range(80)) >= 78


# ---------------------------------------------------------------- toxicity

def toxic_table(spark, n=400):
    rng = random.Random(6)
    bad = ["idiot", "moron", "scum", "worthless", "lowei"]
    docs, labels = [], []
    for i in range(n):
        t = prose(rng, rng.randint(30, 150)).split(" ")
        y = int(i % 5 == 0)
        for _ in range(4 * y):
            w = rng.choice(bad)
            t.insert(rng.randrange(len(t)), w + (rng.choice(["schaft", "ent", "chen"]) if w == "lowei" else ""))
        docs.append(row(i, " ".join(t)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_table(spark)
    docs += [row(9000, None), row(9001, ""), row(None, "what an idiot you moron scum worthless idiot"), row(0, docs[0][1])]
    lab = spark.createDataFrame([(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5] + [(None, 1), (7, None), (9000, 0)],
                                "doc_id bigint, toxic int")
    df = documents(spark, docs)
    model = X.fit(df, lab)
    got = {r.doc_id: r for r in X.score(df, model).collect()}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1
    assert X.score(df.limit(0), model).count() == 0
    again = {r.doc_id: r.score for r in X.score(df, X.fit(df, lab)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_without_a_class(spark):
    df = documents(spark, awkward())
    none = X.fit(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in X.score(df, none).select("score").collect()} == {0.5}
    clean = X.fit(df, spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int"))
    assert all(r.score < 0.5 for r in X.score(df, clean).select("score").collect())


# ---------------------------------------------------------- bands and copies

def test_bands_do_not_follow_copies(spark):
    rng = random.Random(13)
    rows = [row(i, prose(rng, rng.randint(60, 120))) for i in range(200)]
    copies = [row(5000 + i, rows[0][1]) for i in range(600)]
    alone = {r.doc_id: r.kept for r in Q.quality(documents(spark, rows), MODEL).collect()}
    among = Q.quality(documents(spark, rows + copies), MODEL)
    assert Q.TEXT_KEY not in among.columns
    got = {r.doc_id: r.kept for r in among.collect()}
    assert {i: got[i] for i in alone} == alone and sum(alone.values()) >= 195


def test_spread_of_a_bin_is_not_below_its_neighbours(spark):
    rows = [(f"{b}-{i}", "en", 100, 0, 2 ** b, 4.0, 6.0 if b == 8 else 6.0 + i / 40, 0.0) for b in (7, 8, 9) for i in range(40)]
    df = spark.createDataFrame(rows, "_t string, g string, n_words int, n_repeat_words int, n_tokens int, chars_per_token double, entropy double, byte_share double")
    bands = {r._b: r for r in Q.fit_bands(df.selectExpr("*", f"xxhash64(_t) as {Q.TEXT_KEY}"), df.g).collect()}
    assert bands[8]._hi_entropy - bands[8]._lo_entropy >= 0.99 * (bands[9]._hi_entropy - bands[9]._lo_entropy)


# ------------------------------------------------- wrappers and whole articles

LONG = "This paragraph is long enough to be a surge of text all by itself, and it goes on for a while longer."


@pytest.mark.parametrize("page,text", [
    (f"<div class='page has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div id='wrap' class='no-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<div class='widget'><article><p>{LONG}</p></article></div>", LONG),
    (f"<main><p>Top</p><div class='widget'><article><p>{LONG}</p></article></div></main>", f"Top\n{LONG}"),
    (f"<article><p>{LONG}</p></article><div id='comments'><article><p>I do not agree.</p></article></div>", LONG),
    (f"<article><h1>Short title</h1><ul class='share'><li>a<li>b<li>c</ul><p>{LONG}</p><div class='ad'><p>x</p><p>y</p><p>z</p></div>"
     "<p>Last.</p><p><a href='/'>All a link</a></p></article>", f"Short title\n{LONG}\nLast.\nAll a link")])
def test_main_text_keeps_whole_articles(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ('<article><p>Text of it.</p><article class="comment"><p>a reader</p></article><article class="teaser related">more</article></article>', "Text of it."),
    ('<article class="post share"><p>Only this one.</p></article>', "Only this one."),
    ('<form id="aspnetForm"><div><p>' + "Long text here. " * 9 + '</p></div></form>', ("Long text here. " * 9).strip()),
    ('<p>' + "Long text here. " * 9 + '</p><form><p>Name</p><input></form>', ("Long text here. " * 9).strip()),
    ('<p>' + "\u0130" * 40 + '</p><script>x</script><p>after the script</p>', "\u0130" * 40 + "\nafter the script"),
    ('<p>' + "Words of it. " * 12 + '</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>The last one.</p>', ("Words of it. " * 12).strip() + "\nThe last one."),
    ('<p>' + "Words of it. " * 12 + '</p><p><a href="x">One link alone</a></p><p>' + "More of it. " * 12 + '</p>',
     ("Words of it. " * 12).strip() + "\nOne link alone\n" + ("More of it. " * 12).strip()),
    ('<article><p title="abc>broken</p><p>whole</p></article>', "broken\nwhole"),
    ('<head><title>t</title><header><p>x</p></header><body><article>in the body</article>', "in the body"),
])
def test_main_text_loses_nothing_else(page, text):
    assert H.main_text(page) == text


def test_main_text_without_article_tags_is_the_same():
    """The line blocks alone find what the article element marks, on pages whose
    parts stand in paragraphs."""
    rng = random.Random(9)
    for _ in range(40):
        body = "".join(f"<p>{prose(rng, rng.randint(12, 60))}</p>" for _ in range(rng.randint(1, 6)))
        page = f"<html><body><nav><a>Home</a></nav>%s<h1>Of it</h1>{body}%s<footer>end</footer></body></html>"
        assert H.main_text(page % ("<article>", "</article>")) == H.main_text(page % ("", "")) != ""


def test_main_text_of_deep_pages_takes_linear_time():
    import time
    began = time.perf_counter()
    H.main_text("<div>" * 20000 + "</span>" * 20000)
    H.main_text("<article>" * 2000 + "<p>text</p>" * 20000)
    assert time.perf_counter() - began < 6
