"""Regex selectors over raw HTML columns (JVM built-ins).

The built-in ``xpath*`` functions need well-formed XML, which real pages are
not, so regular leaf elements are matched by pattern.
"""

from __future__ import annotations

import html as _html

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.text import clean_str, strip_tags, ustrip, _c

# attributes before href are passed whole, so neither data-href nor a quoted "href=" is taken for it
R_LINK = r"""<a(?:\s+(?!href\s*=)[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*+\s+href\s*=\s*"""
R_HREF = "(?i)" + R_LINK + r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
R_ANCHOR_TEXT = "(?is)" + R_LINK + r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a>"""
R_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"
R_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
R_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"


def leaf_pattern(tag: str, attrs: str = "") -> str:
    """``<tag attrs>(inner)</tag>`` for a tag that does not nest in itself."""
    open_tag = f"<{tag}{attrs}>" if attrs else f"<{tag}(?:\\s[^>]*)?>"
    return f"(?s){open_tag}(.*?)</{tag}>"


def without_blocks(html) -> Column:
    """Drop script and style bodies (their text is not content)."""
    return F.regexp_replace(F.regexp_replace(_c(html), r"(?is)<script\b.*?</script>", ""),
                            r"(?is)<style\b.*?</style>", "")


def extract_all(html, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(pattern), F.lit(group))


def first_match(html, pattern: str, group: int = 1) -> Column:
    """First match or null (``regexp_extract`` returns '' for no match)."""
    return F.nullif(F.regexp_extract(_c(html), pattern, group), F.lit(""))


def extract_field(html, patterns, default=None) -> Column:
    """First non-empty match of ordered fallback patterns, else ``default``."""
    cands = [first_match(html, p) for p in patterns]
    if default is not None:
        cands.append(F.lit(default))
    return F.coalesce(*cands)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decode(col: pa.Array) -> pa.Array:
    """Decode the character references of the few strings that hold any."""
    flat = col.flatten()
    held = [x if x is None or "&" not in x else _html.unescape(x) for x in flat.to_pylist()]
    return pa.ListArray.from_arrays(_offsets(col), pa.array(held, pa.string()), mask=col.is_null())


def _offsets(col: pa.Array) -> pa.Array:
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())


def unescape_all(arr) -> Column:
    """Every string of an array with its character references decoded, named
    and numeric, once ("&amp;lt;" gives "&lt;")."""
    return _decode(_c(arr))


def unescape_entities(c) -> Column:
    """The text with its character references decoded (null stays null)."""
    return F.element_at(unescape_all(F.array(_c(c))), 1)


def text_nodes(html, pattern: str) -> Column:
    """Inner text of every match: tags removed, references decoded,
    stripped, blanks dropped."""
    arr = F.transform(extract_all(without_blocks(html), pattern), lambda x: strip_tags(x, drop_blocks=False))
    return F.filter(F.transform(unescape_all(arr), ustrip), lambda x: x != F.lit(""))


def text_joined(html, pattern: str, sep: str = " ") -> Column:
    return F.array_join(text_nodes(html, pattern), sep)


def strings_of(html, pattern: str) -> Column:
    """``string(.)`` of every match, cleaned (empties kept)."""
    arr = F.transform(extract_all(without_blocks(html), pattern), lambda x: strip_tags(x, drop_blocks=False))
    return F.transform(unescape_all(arr), clean_str)


def hrefs(html) -> Column:
    """The target of every link, quotes dropped, references decoded, in order."""
    raw = F.transform(extract_all(html, R_HREF), lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    return F.transform(unescape_all(raw), ustrip)


def _without_dots(path: Column) -> Column:
    """A path without dot segments and without empty ones inside."""
    seg = F.split(path, "/", -1)
    n = F.size(seg)
    inner = F.filter(F.slice(seg, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, i: (x != "") | (i == n - 2))
    kept = F.aggregate(inner, F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x))))
    last = F.element_at(seg, -1)
    folder = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), folder)


def absolute_url(base, href) -> Column:
    """Resolve ``href`` against the page url: absolute, //host, /path, relative
    with dot segments, ?query, #fragment and empty targets."""
    b, h = _c(base), _c(href)
    origin = F.regexp_extract(b, R_ORIGIN, 1)
    scheme = F.regexp_extract(b, R_SCHEME, 1)
    page = F.regexp_replace(b, r"[?#].*$", "")
    path = F.regexp_replace(page, R_ORIGIN, "")
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    own = F.regexp_extract(h, r"^([^?#]*)", 1)
    rest = F.regexp_extract(h, r"^[^?#]*([?#].*)?$", 1)
    target = F.when(h.startswith("/"), own).otherwise(F.concat(folder, own))
    return (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == F.lit(""), b)
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), h))
            .when(h.startswith("?"), F.concat(page, h))
            .otherwise(F.concat(origin, _without_dots(target), rest)))


def host_of(url) -> Column:
    return F.regexp_extract(_c(url), R_HOST, 1)


def get_clean(html, pattern: str) -> Column:
    """First match, tags removed, references decoded, cleaned like ``clean_str``
    ('' when absent)."""
    return clean_str(unescape_entities(strip_tags(first_match(html, pattern), drop_blocks=False)))
