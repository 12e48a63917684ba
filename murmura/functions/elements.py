"""Balanced elements of raw HTML.

Site pages nest blocks of one kind, which a pattern cannot match to its own
closing tag.  ``inner_html`` finds an element by a path of steps and returns what
stands between its tags: one scan of the page with a stack of open elements, in
an Arrow function.  An end tag closes the nearest open element of its name and
all that are open inside it; one without an open element is ignored; an element
that is never closed ends where its parent does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.text import _c

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
ITEMS = frozenset(("li", "p", "dt", "dd", "tr", "td", "th", "option"))      # the next one closes an open one

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>)|[^>]*)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)([a-zA-Z_:][\w:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


class Step(NamedTuple):
    """One step of a path: an element of ``tag`` ('*': any) with the attribute
    value (compared whole), the ``nth`` of its tag under its parent (0: any);
    ``direct``: a child, else at any depth."""

    tag: str
    attr: str = ""
    value: str = ""
    nth: int = 0
    direct: bool = False


class Element(NamedTuple):
    tag: str
    attrs: str
    parent: int
    nth: int
    start: int                # of the content


def elements(page: str) -> tuple[list[Element], list[int]]:
    """All elements in order of their start tags, and where their content ends."""
    found: list[Element] = []
    ends: list[int] = []
    stack: list[int] = []
    opened: Counter = Counter()
    kinds: list[Counter] = [Counter()]                 # children by tag, of the page and of each open element
    at = 0

    def close(end):
        i = stack.pop()
        kinds.pop()
        opened[found[i].tag] -= 1
        ends[i] = end

    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened[name]:
                while found[stack[-1]].tag != name:
                    close(m.start())
                close(m.start())
            continue
        if name in ITEMS and stack and found[stack[-1]].tag == name:
            close(m.start())
        kinds[-1][name] += 1
        found.append(Element(name, m[3], stack[-1] if stack else -1, kinds[-1][name], at))
        ends.append(at)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            ends[-1] = at = end.start() if end else len(page)
            continue
        stack.append(len(found) - 1)
        opened[name] += 1
        kinds.append(Counter())
    while stack:
        close(len(page))
    return found, ends


def find(page: str, path: Sequence[Step]) -> str | None:
    """The content of the first element at the end of ``path``."""
    found, ends = elements(page)
    # for each element, the steps that it and its ancestors have taken
    taken: list[set] = []
    for i, e in enumerate(found):
        above = taken[e.parent] if e.parent >= 0 else {0}
        mine = set()
        for k in above:
            step = path[abs(k)] if abs(k) < len(path) else None
            if step is None:
                continue
            fits = (step.tag in ("*", e.tag) and (not step.nth or e.nth == step.nth)
                    and (not step.attr or any(n.lower() == step.attr and v.strip("\"'") == step.value for n, v in _ATTR.findall(e.attrs))))
            if fits:
                if abs(k) + 1 == len(path):
                    return page[e.start:ends[i]]
                mine.add(abs(k) + 1)
            if not step.direct:
                mine.add(k)                            # the step may still be taken further down
        taken.append(mine)
    return None


SOME = 64                    # pages of a batch that stand as Python strings at once


def inner_html(html, *path: Step) -> Column:
    """Content of the first element at the end of ``path`` (null: none)."""
    steps = list(path)

    @F.arrow_udf(T.StringType())
    def inner(col: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else find(x, steps) for x in col.slice(i, SOME).to_pylist()], pa.string())
                 for i in range(0, len(col), SOME)]
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    return inner(_c(html))


def first_text(inner) -> Column:
    """The first text node of an element's content (null: none)."""
    bare = F.regexp_replace(_c(inner), r"(?s)<!--.*?-->", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)^(?:<[^>]*>)*([^<]+)", 1), F.lit(""))
