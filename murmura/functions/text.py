"""Column-level string functions (all JVM-side built-ins, no Python UDF)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() whitespace set: Unicode White_Space plus the
# information separators U+001C..U+001F.
WS_CLASS = r"[\s\x{1c}-\x{1f}]"
R_TAG = r"(?s)</?([^ >/]+).*?>"
R_SCRIPT = r"(?is)<script\b.*?</script>"
R_STYLE = r"(?is)<style\b.*?</style>"
R_CLEAN_DATE = r"(?U)" + WS_CLASS + r"*수정일" + WS_CLASS + r"*:" + WS_CLASS + r"*\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
R_CLEAN_BOARD = r"(?U)^\d+" + WS_CLASS + r"*|" + WS_CLASS + r"{2,}"
R_WS_RUN = r"(?U)" + WS_CLASS + r"+"
R_FENCE = r"(?s)```(.*?)```"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters str.isspace() accepts (fixed by the Unicode standard).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def ustrip(c) -> Column:
    """``str.strip()``: trims Unicode whitespace (``trim`` only trims U+0020).

    ``btrim`` with the explicit character set touches only the two ends of
    the string, unlike a regex replace which scans every character."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """Nothing but whitespace (or empty): no non-space character is found.
    The search stops at the first non-space, i.e. at once for real text."""
    return ~_c(c).rlike(r"(?U)[^" + WS_CLASS[1:-1] + r"]")


def strip_tags(c, drop_blocks: bool = True) -> Column:
    """Remove markup, keep text.  ``script``/``style`` bodies go first so a
    ``"</p>"`` inside a script cannot end a paragraph."""
    x = _c(c)
    if drop_blocks:
        x = F.regexp_replace(F.regexp_replace(x, R_SCRIPT, ""), R_STYLE, "")
    return F.regexp_replace(x, R_TAG, "")


def clean_date(c) -> Column:
    """Drop the "modified at" suffix, then strip."""
    return ustrip(F.regexp_replace(_c(c), R_CLEAN_DATE, ""))


def clean_board(c) -> Column:
    """Leading digits / runs of 2+ spaces -> one space, strip, text before '-'."""
    x = ustrip(F.regexp_replace(_c(c), R_CLEAN_BOARD, " "))
    return F.split(x, "-", -1).getItem(0)


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), R_WS_RUN, " ")


def clean_str(c) -> Column:
    """null -> '', delete newline and tab, nbsp -> space, strip."""
    x = F.coalesce(_c(c), F.lit(""))
    x = F.translate(x, "\n\t", "")
    x = F.translate(x, "\u00a0", " ")
    return ustrip(x)


def prep_for_sentiment(c, n: int = 300) -> Column:
    """First n chars, drop NUL, CR -> space, strip (in that order)."""
    x = F.substring(_c(c), 1, n)
    x = F.replace(x, F.lit("\x00"), F.lit(""))
    x = F.replace(x, F.lit("\r"), F.lit(" "))
    return ustrip(x)


def truncate_ellipsis(c, n: int = 1000) -> Column:
    x = _c(c)
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def render(template: str, missing: str | None = "nan", **cols) -> Column:
    """Fill ``{name}`` fields of a template from columns.

    A null field prints ``missing`` (the reference prints ``nan`` for absent
    metadata).  Compiles to one ``concat`` of literals and columns.
    """
    parts = []
    for lit, field, _spec, _conv in string.Formatter().parse(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            col = _c(cols[field]) if field in cols else F.col(field)
            col = col.cast("string")
            parts.append(F.coalesce(col, F.lit(missing)) if missing is not None else col)
    return F.concat(*parts) if parts else F.lit("")


def tokens(c, min_len: int = 1) -> Column:
    """Lower-cased maximal runs of letters/digits (any script) of at least
    ``min_len`` characters: one regex scan, no intermediate split array."""
    n = max(min_len, 1)
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}]{" + str(n) + r",}"), F.lit(0))


def contains_any(c, terms) -> Column:
    """Substring match against any term (null never matches).  A chain of
    ``contains`` (indexOf) beats a regex alternation on long texts."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    x = _c(c)
    cond = None
    for t in terms:
        cond = x.contains(t) if cond is None else (cond | x.contains(t))
    return F.coalesce(cond, F.lit(False))


def safe_int(c) -> Column:
    """Integer if the text is all ASCII digits (38 of them at most), else 0
    (null -> 0).  Decimal, so a count above the BIGINT range still ranks."""
    x = _c(c)
    return F.coalesce(F.when(x.rlike(r"^[0-9]+$"), x.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def base64_utf8(c) -> Column:
    """Base64 of the UTF-8 bytes, without MIME line breaks."""
    return F.regexp_replace(F.base64(F.encode(_c(c), "UTF-8")), r"[\r\n]", "")


__all__ = [
    "ustrip", "is_blank", "strip_tags", "clean_date", "clean_board", "collapse_ws",
    "clean_str", "prep_for_sentiment", "truncate_ellipsis", "render", "tokens",
    "contains_any", "safe_int", "base64_utf8",
    "R_TAG", "R_SCRIPT", "R_STYLE", "R_FENCE", "PY_WHITESPACE",
]
