"""Quality rules from tokeniser fertility.

A public vocabulary is used as a yardstick: clean prose of a language costs it
a typical number of characters per token, hardly any byte fall-back and a
token distribution of a typical entropy.  Shouted text, symbol noise, lists
and loops of one word move at least one of the three far out of its band.

``measure`` adds, per whole text,

* base counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
  ``n_repeat_words`` (definitions in ``base_counts``);
* fertility: ``n_tokens``, ``chars_per_token``, ``byte_share`` (share of tokens
  that are byte fall-backs, the line feed excepted) and ``entropy_ratio``
  (token entropy over the entropy of as many draws from the group's own token
  use, see ``fit_bands``), and ``script``, the script of most letters.

``fit_bands`` measures the centre and spread of each quantity over the distinct
texts of *all* documents of a group (language, else script) with a partial/final
aggregate, so a group of copies weighs as one text;
``verdict`` rejects a document outside ``centre +- width * spread``.

Null or empty text: all counts 0, base_failed (fewer than 10 words), rejected.
Null or unknown group: banded with its script.  Repeated rows are measured one
by one; extra columns pass through, an output column that exists already is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import arrays as A
from murmura.llm.tables import own_names, written
from murmura.llm.token_counts import encoded

SYMBOLS = b"#*$%&|<>"
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
WINDOW = 5                     # words in a repeat window
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF),
           ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]


def base_counts(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of each row: words; code points in words; symbols; lines (split
    at \\n) with a word that equal an earlier line; words inside 5-word windows
    that occur twice or more in the row."""
    k = len(offsets) - 1
    out = {n: np.zeros(k, np.int64) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, j in A.slabs(offsets, 1 << 20):
        d, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        s, e, rows = A.word_spans(d, o)
        m = j - i
        lead = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
        out["n_words"][i:j] = np.bincount(rows, minlength=m)
        out["word_chars"][i:j] = np.bincount(rows, lead[e] - lead[s], minlength=m).astype(np.int64)
        sym = np.concatenate([[0], np.cumsum(_SYM[d])])
        out["n_symbols"][i:j] = sym[o[1:]] - sym[o[:-1]]
        words = A.span_hashes(d, s, e, lower=False)
        grams, _ = A.ngram_hashes(words, rows, WINDOW)
        n = len(words) - WINDOW + 1
        if n > 0:
            at = np.flatnonzero(rows[WINDOW - 1:] == rows[:n])
            key = grams + A.mix(rows[at].astype(np.uint64) + A.U(1))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, at[twice], 1)
            np.add.at(mark, at[twice] + WINDOW, -1)
            out["n_repeat_words"][i:j] = np.bincount(rows, np.cumsum(mark)[:-1] > 0, minlength=m).astype(np.int64)
    for r, t in enumerate(texts):
        if "\n" in t:
            seen, dup = set(), 0
            for line in t.split("\n"):
                if line in seen:
                    dup += bool(line.strip(" \t\n\x0b\x0c\r"))
                else:
                    seen.add(line)
            out["n_dup_lines"][r] = dup
    return out


def script_of(text: str) -> str:
    """The script of most letters ('other' if none is listed; ties: list order)."""
    if text.isascii():
        return "latin"
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = [int(((cp >= lo) & (cp <= hi)).sum()) for _, lo, hi in SCRIPTS]
    return SCRIPTS[int(np.argmax(n))][0] if max(n) else "other"


def fertility(path: str, texts: list[str], byte_ids: tuple[int, int] = (3, 258), newline: int = 13) -> dict:
    """Tokens, byte fall-back tokens (the line feed's excepted) and Shannon
    entropy in bits of the token distribution, for every text."""
    n, fall, ent = (np.zeros(len(texts), t) for t in (np.int64, np.int64, np.float64))
    for r, seqs in enumerate(encoded(path, texts)):
        ids = np.fromiter((x for s in seqs for x in s), np.int32)
        if len(ids):
            c = np.unique(ids, return_counts=True)[1]
            p = c / len(ids)
            n[r], ent[r] = len(ids), max(0.0, -(p * np.log2(p)).sum())
            fall[r] = ((ids >= byte_ids[0]) & (ids <= byte_ids[1]) & (ids != newline)).sum()
    return {"n_tokens": n, "n_fallback": fall, "entropy": ent}


TEXT_KEY = "_text_key"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_fallback", "entropy"]


def measure(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts, fertility measures, ``script`` and a hash of the text."""
    kind = "struct<" + ",".join(f"{c}:{'double' if c == 'entropy' else 'bigint'}" for c in COUNTS) + ",script:string>"

    @F.arrow_udf(kind)
    def probe(col: pa.Array) -> pa.Array:
        col = col.fill_null("")
        data, offs = A.text_buffer(col)
        texts = col.to_pylist()
        got = base_counts(data, offs, texts) | fertility(path, texts)
        arrays = [pa.array(got[c]) for c in COUNTS] + [pa.array([script_of(t) for t in texts], pa.string())]
        return pa.StructArray.from_arrays(arrays, COUNTS + ["script"])

    m = df.withColumn("_probe", probe(F.col(text_col).cast("string")))
    m = m.withColumns({c: F.col("_probe")[c] for c in COUNTS + ["script"]}).drop("_probe")
    m = m.withColumn(TEXT_KEY, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return m.withColumns({
        "chars_per_token": F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")).otherwise(F.lit(0.0)),
        "byte_share": F.when(F.col("n_tokens") > 0, F.col("n_fallback") / F.col("n_tokens")).otherwise(F.lit(0.0))})


# ------------------------------------------------------------------- bands

#: measure -> (spreads allowed below and above the centre, least spread)
WIDTHS = {"chars_per_token": (6.0, 12.0, 0.02), "entropy": (3.0, 12.0, 0.05), "byte_share": (1e9, 12.0, 0.01)}
STEP = 512.0                   # histogram cells per unit of a measure
MIN_GROUP = 30                 # texts that a band needs; fewer: neighbouring bins, then the script, then the corpus
BINS = (4, 14)                 # least and greatest size bin
MOST_BANDS = 50_000            # rows of bands that may be broadcast (a few hundred bytes each)


def size_bin(n):
    """Texts are compared with texts of about their own token count: entropy
    and the noise of every ratio depend on it."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)))), F.lit(BINS[0])), F.lit(BINS[1])).cast("int")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _middle(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Weighted median of ``value`` (weights ``n``) per key; exact and
    independent of row order, on a histogram of bounded size."""
    w = Window.partitionBy(*keys)
    run = hist.withColumn("_run", F.sum("n").over(w.orderBy(value))).withColumn("_all", F.sum("n").over(w))
    return (run.where(2 * F.col("_run") >= F.col("_all")).groupBy(*keys)
            .agg(F.min(value).alias("_mid"), F.first("_all").alias("_n")))


def fit_bands(measured: DataFrame, group, least: int = MIN_GROUP) -> DataFrame:
    """Centre (median) and spread (scaled median deviation) of every measure
    for each (group, size bin), over the distinct texts of all documents that
    pass the base rules.  A bin with under ``least`` texts takes in the bins
    around it, one more on either side until it has them; a group that has
    fewer in all has no band.  Copies are combined map-side, and the texts
    shrink to a histogram map-side; nothing is collected.  A bin's spread is at
    least the smaller one of its two neighbours, for near copies."""
    texts = measured.where(~base_failed()).select(
        TEXT_KEY, group.alias("_g"), size_bin(F.col("n_tokens")).alias("_b"),
        *[F.round(F.col(m) * STEP).cast("bigint").alias(f"_q_{m}") for m in WIDTHS]).distinct()
    cells = texts.select("_g", "_b", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(f"_q_{m}").alias("q")) for m in WIDTHS])).alias("_c"))
    keys = ["_g", "_b", "m"]
    hist = cells.groupBy("_g", "_b", F.col("_c.m").alias("m"), F.col("_c.q").alias("q")).agg(F.count("*").alias("n"))
    # how many bins on either side a bin needs: a few rows a group
    counts = hist.where(F.col("m") == next(iter(WIDTHS))).groupBy("_g", "_b").agg(F.sum("n").alias("n"))
    far = F.abs(F.col("_b") - F.col("_t"))
    near = (counts.withColumn("_t", F.explode(F.sequence(F.lit(BINS[0]), F.lit(BINS[1])))).groupBy("_g", "_t", far.alias("_far"))
            .agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy("_g", "_t").orderBy("_far"))))
    width = near.where(F.col("n") >= least).groupBy(F.col("_g").alias("_h"), "_t").agg(F.min("_far").alias("_wide"))
    hist = (hist.join(width, F.col("_g") == F.col("_h")).where(far <= F.col("_wide"))
            .groupBy("_g", F.col("_t").alias("_b"), "m", "q").agg(F.sum("n").alias("n")))
    mid = _middle(hist, keys, "q")
    dev = (hist.join(mid, keys).withColumn("d", F.abs(F.col("q") - F.col("_mid")))
           .groupBy(*keys, "d").agg(F.sum("n").alias("n")))
    spread = _middle(dev, keys, "d").select(*keys, F.col("_mid").alias("_dev"))
    bands = mid.join(spread, keys)
    at = Window.partitionBy("_g", "m").orderBy("_b")
    below_, above_ = (F.max("_dev").over(at.rangeBetween(k, k)) for k in (-1, 1))
    bands = bands.withColumn("_near", F.when(below_.isNotNull() & above_.isNotNull(), F.least(below_, above_)))
    bands = bands.withColumn("_dev", F.greatest("_dev", "_near"))
    lo, hi = F.lit(0.0), F.lit(0.0)
    for m, (below, above, least) in WIDTHS.items():
        s = F.greatest(F.col("_dev") / STEP * 1.4826, F.lit(least))
        lo = F.when(F.col("m") == m, F.col("_mid") / STEP - below * s).otherwise(lo)
        hi = F.when(F.col("m") == m, F.col("_mid") / STEP + above * s).otherwise(hi)
    one = bands.withColumn("_lo", lo).withColumn("_hi", hi)
    return one.groupBy("_g", "_b").agg(*[
        F.max(F.when(F.col("m") == m, F.col(c))).alias(f"{c}_{m}") for m in WIDTHS for c in ("_lo", "_hi")])


def verdict(measured: DataFrame, lang_col: str | None = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.  ``measured`` should be a
    written table: it is read for the bands and again for the verdict."""
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    by_lang = fit_bands(measured.where(lang.isNotNull()), lang) if lang_col else None
    by_script = fit_bands(measured, F.col("script"))
    of_all = fit_bands(measured, F.lit("all"), 1)
    d = measured.withColumn("_b", size_bin(F.col("n_tokens"))).withColumn("base_failed", base_failed())

    def out_of(p):
        bad = F.lit(False)
        for m in WIDTHS:
            bad = bad | (F.col(m) < F.col(f"{p}_lo_{m}")) | (F.col(m) > F.col(f"{p}_hi_{m}"))
        return bad

    def joined(d, bands, p, key):
        from murmura.session import sized_broadcast
        b = bands.select(*[F.col(c).alias(p + c) for c in bands.columns])
        b = sized_broadcast(written(b, "quality-bands"), MOST_BANDS)   # beyond it a shuffle join
        return d.join(b, (key == F.col(f"{p}_g")) & (F.col("_b") == F.col(f"{p}_b")), "left")

    d = joined(joined(d, by_script, "s", F.col("script")), of_all, "a", F.lit("all"))
    odd = F.coalesce(out_of("s"), out_of("a"), F.lit(False))
    if by_lang is not None:
        d = joined(d, by_lang, "l", lang)
        odd = F.coalesce(out_of("l"), odd)
    names = measured.columns
    return d.withColumn("kept", ~F.col("base_failed") & ~odd).select(
        *[F.col(f"`{c}`") for c in names if c not in ("base_failed", "kept", TEXT_KEY)], "base_failed", "kept")


@own_names("text_col", "lang_col")
def quality(docs: DataFrame, path: str, text_col: str = "text", lang_col: str | None = "lang",
            keep_text: bool = True) -> DataFrame:
    """Measures and verdict of every document.  The measured rows are written
    once to the shared folder, so no text is tokenised twice."""
    m = measure(docs, path, text_col)
    return verdict(written(m if keep_text else m.drop(text_col), "quality"), lang_col)
