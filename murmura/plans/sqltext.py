"""SQL text helpers for the DuckDB oracle (RE2 dialect).

RE2's ``\\s`` is ASCII only, so Python's ``str.isspace`` set is spelled out.
"""

from __future__ import annotations

import string

WS = (r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_contains_any(x: str, terms) -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(f"coalesce(contains({x}, {q(t)}), FALSE)" for t in terms) + ")"


def s_render(template: str, missing: str | None = "nan", **cols) -> str:
    parts = []
    for lit, field, _s, _c in string.Formatter().parse(template):
        if lit:
            parts.append(q(lit))
        if field is not None:
            e = f"CAST({cols.get(field, field)} AS VARCHAR)"
            parts.append(f"coalesce({e}, {q(missing)})" if missing is not None else e)
    return "(" + " || ".join(parts) + ")"


def s_truncate(x: str, n: int = 1000) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def s_safe_int(x: str) -> str:
    return f"coalesce(CASE WHEN regexp_full_match({x}, '[0-9]+') THEN TRY_CAST({x} AS DECIMAL(38,0)) END, 0)"


def s_tokens(x: str, min_len: int = 1) -> str:
    return (f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: length(t) >= {max(min_len, 1)})")


def s_pct(n: str, total: str) -> str:
    return f"round(CASE WHEN {total} = 0 THEN NULL ELSE 100.0::DOUBLE * {n} / {total} END, 1)"


def s_dbl(x: str) -> str:
    """Double -> text the way Spark casts it (shortest repr, '.0' kept)."""
    return f"CAST({x} AS VARCHAR)"
