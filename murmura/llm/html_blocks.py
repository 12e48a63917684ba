"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element.  Each line weighs its
characters outside links; a line inside a menu, header, footer, sidebar,
notice, advert, form or reader-comment element weighs nothing.  The sum over a
sliding window of lines is the block distribution: the text starts at a surge
(a window above the threshold whose lines go on) and ends at a dive (windows
that have fallen to zero); the lines in between are kept, however short.  If no
window reaches the threshold, the run with the most text is kept.  Where the
page marks an <article> or <main>, its lines are the text, all that are not apart
whatever they weigh.  A class or id word does not set apart an element that holds
the largest <article> or <main>, if what stands there else is less text.

Per page: character references decoded, white space inside a block made one
space, trimmed, blocks in page order joined by one line feed.  Null, empty or
text-free pages give "".  Broken markup never fails: an unclosed script, style
or comment swallows the rest, a tag cut off at the end of the page is dropped.
Repeated pages are extracted one by one; an empty table gives an empty result;
other columns pass through and an output column that exists already is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW = 3                     # lines in a block
THRESHOLD = 86                 # characters in a block that mark a surge
GAP = 2                        # empty lines that mark a dive

# Fixed values of HTML: elements by their part in a page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select textarea".split())
APART = frozenset("nav header footer aside button dialog menu fieldset".split())       # and a form that is not most of the page
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav "
                   "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul").split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
# Words of class and id values that mark what is not the article.
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|"
    r"promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|aside|widget|footer|masthead|"
    r"cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|reply|"
    r"replies|respond|disqus|discussion|pagination|pager|toolbar|copyright|disclaimer|paywall|teaser|search)"
    r"(?=$|[\s_-]|\d)", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(>|\Z)",
                    re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# has-sidebar, no-ads: a name that tells of the page, not of the element.
_STATE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|not|with|without)[_-]\S*", re.I)
_SPACE = re.compile(r"\s+")
_BODY = re.compile(r"<body(?=[\s/>]|\Z)", re.I)


def _apart(name: str, attrs: str, names: bool = True) -> bool:
    """Is the element apart; without ``names``, by other things than a class or id word?"""
    if name in APART:
        return True
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if names and key in ("class", "id") and APART_NAMES.search(_STATE.sub(" ", value)) and name not in ("body", "html", "main"):
            return True
        if key == "role" and value.lower() in APART_ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters in links, apart, article depth, in a paragraph or
    heading) of every block line.  ``apart`` elements inside an article still
    count as apart; a <header> of an article holds its heading and stays."""
    lines, arts, forms, total = _lines(page, frozenset())
    shown = sum(len(x[0]) for x in lines if x[3] and not x[2])
    open_ = {k for k, n in forms.items() if 2 * n > total}                # a form around the page
    held = [(n, k, h | (set() if shown else {k})) for k, (n, h) in arts.items()]
    size, _, holders = max((x for x in held if x[2]), default=(0, 0, frozenset()), key=lambda x: (x[0], -x[1]))
    if size > shown:                                                      # names around the largest article
        open_ |= holders
    return _lines(page, frozenset(open_))[0] if open_ else lines


def _lines(page: str, open_: frozenset) -> tuple[list, dict, dict, int]:
    """The lines; text and named holders of every article; text of every form;
    all text.  The class and id words of the elements ``open_`` do not count,
    nor that one is a form."""
    arts: dict[int, tuple[int, frozenset]] = {}        # place of the tag: characters, places of its soft holders
    forms: dict[int, int] = {}
    out: list[tuple[str, int, bool, int, bool]] = []
    # name; 1 for apart, by more than a name, article, link; place if softly apart; place; characters before it
    stack: list[tuple] = []
    opened: Counter = Counter()                        # names on the stack
    apart = hard = inside = link = total = 0
    block = ""
    buf: list[str] = []
    in_link = 0
    at = 0

    def add(s):
        nonlocal in_link
        if s:
            buf.append(s)
            if link:
                in_link += len(s)

    def flush():
        nonlocal in_link, total
        if buf:
            t = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            if t:
                out.append((t, min(in_link, len(t)), apart > 0, inside, block in PROSE))
                total += 0 if hard else len(t)
            buf.clear()
        in_link = 0

    def pop():
        nonlocal apart, hard, inside, link
        name, a, h, i, k, soft, place, before = stack.pop()
        opened[name] -= 1
        apart, hard, inside, link = apart - a, hard - h, inside - i, link - k
        if i:
            arts[place] = total - before, arts[place][1]
        if name == "form":
            forms[place] = total - before

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)
            add(rest[:cut.start()] if cut else rest)
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[4]:                                  # cut off inside a tag
            break
        if name == "br":
            add(" ")
            continue
        if m[1]:
            if name in BLOCK:
                flush()
                block = ""
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in SILENT:
            flush() if name in BLOCK else None
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            body = _BODY.search(page, at) if name == "head" else None
            if name == "head" and body and (end is None or body.start() < end.start()):
                end = body
            at = len(page) if end is None else end.start()
            continue
        if name in BLOCK:
            flush()
            block = name
            closes = CLOSES.get(name, ())
            if stack and stack[-1][0] in closes:
                pop()
            elif name != "p" and name not in CLOSES and stack and stack[-1][0] == "p":
                pop()
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        art = int(name in ("article", "main"))
        heading = name == "header" and inside
        other = int(_apart(name, m[3], False) and not heading)
        free = m.start() in open_
        out_of_text = int((_apart(name, m[3], not free) or name == "form" and not free) and not heading)
        soft = m.start() if out_of_text and not other else -1
        if art:
            arts[m.start()] = 0, frozenset(x[5] for x in stack if x[5] >= 0)
        stack.append((name, out_of_text, other, art, int(name == "a"), soft, m.start(), total))
        opened[name] += 1
        apart, hard, inside, link = apart + out_of_text, hard + other, inside + art, link + int(name == "a")
    flush()
    while stack:
        pop()
    return out, arts, forms, total


def _marked(lines) -> bool:
    return any(depth and not apart for _, _, apart, depth, _ in lines)


def weights(lines) -> np.ndarray:
    """Characters of each line that count as text."""
    marked = _marked(lines)
    w = np.zeros(len(lines), np.int64)
    for i, (text, in_link, apart, depth, _) in enumerate(lines):
        if not apart and (depth if marked else 2 * in_link <= len(text)):
            w[i] = len(text)
    return w


def runs(w: np.ndarray, window: int = WINDOW, threshold: int = THRESHOLD, gap: int = GAP) -> list[tuple[int, int]]:
    """Line ranges between a surge and its dive."""
    full = np.flatnonzero(w)
    if not len(full):
        return []
    cut = np.flatnonzero(np.diff(full) > gap)
    spans = list(zip(full[np.concatenate([[0], cut + 1])], full[np.concatenate([cut, [len(full) - 1]])] + 1))
    blocks = np.convolve(w, np.ones(window, np.int64))[window - 1:]
    good = [(a, b) for a, b in spans if blocks[a:b].max() >= threshold]
    return good or [max(spans, key=lambda s: (int(w[s[0]:s[1]].sum()), -s[0]))]


def chosen(lines) -> list[int]:
    """The lines of the main text.  The line-block distribution gives the part
    between the first surge and the last dive.  Inside it every line that counts
    as text stays, and a paragraph that is one link; outside it paragraphs and
    headings that count as text, and in a marked article every line of it."""
    w = weights(lines)
    spans = runs(w)
    if not spans:
        return []
    marked, first, last = _marked(lines), spans[0][0], spans[-1][1]
    return [i for i, (_, _, apart, _, prose) in enumerate(lines)
            if w[i] and (marked or prose or first <= i < last) or prose and not apart and not marked and first <= i < last]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines = lines_of(page)
    return "\n".join(lines[i][0] for i in chosen(lines))


@F.arrow_udf(StringType())
def main_text_udf(col: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in col.to_pylist()], pa.string())


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole page in ``out``."""
    return pages.withColumn(out, main_text_udf(F.col(html_col).cast("string")))
