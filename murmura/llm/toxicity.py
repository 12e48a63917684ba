"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents: one on windows of
ordinary text, one on windows that carry what sets toxic text apart.  Windows
are a word with its two spaces and the word's beginnings (stems take endings),
written after a fixed lead-in that both dictionaries hold, so that even a short
word is a compressible block.  The
window's distance is its compressed length under the ordinary dictionary minus
its length under the toxic one, if the latter is that of a window the toxic
dictionary holds whole, else 0: several bytes where only the toxic dictionary
has the window, 0 for ordinary words and for words that share a mere ending.  A document's thresholds are calibrated
by a logistic fit on (largest distance, number of windows over MARGIN, words).

Training reads at most ``sample`` labelled rows of each class, those with the
lowest id hash (the documented bound); everything else covers all documents and
whole texts.  Only bounded results reach the driver: the most telling word
beginnings, the windows of the dictionaries and the sample's three numbers.

Null or empty text has no windows and scores the prior of a document without
any.  A document labelled more than once is toxic if any label says so; null
labels are ignored; null doc_ids are never trained on.  Repeated rows are
scored one by one; extra columns pass through and ``score``/``predicted``
replace such columns; without any toxic or ordinary training row every score is
the smoothed share of toxic rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000                  # labelled rows of each class that training reads
TERMS = 4000                   # word beginnings that may mark toxic text
LEAST_SHARE = 0.015            # of toxic sample documents that hold a term
LEAST_LOG_ODDS = 2.5
DICT_BYTES = 8192
WORDS = 12                     # words of each mark in the toxic dictionary
LEVEL = 19
MARGIN = 3                     # bytes by which a window counts as toxic
GRAM = 5                       # a shorter match cannot save MARGIN bytes
SHORT = 8                      # bytes under which a whole word is written twice
LEAD = b" of the and to in that is for it with as was on be at by this "
CACHE = 300_000                # distances remembered by a Python worker

_LETTERS = re.compile(r"[^\W\d_]+")


def pieces(token: str) -> list[str]:
    return _LETTERS.findall(token)


def beginnings(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters."""
    return [f" {word} "] + [f" {word[:k]}" for k in (4, 5, 6, 7) if len(word) > k]


def window(text: str) -> bytes:
    """Bytes of a window; a short whole word is written twice, since one copy
    is no longer than the pointer that replaces it."""
    w = text.encode()
    return w * 2 if len(w) < SHORT and text.endswith(" ") else w


def shortest(terms: list[str]) -> list[str]:
    """The terms that no other term begins."""
    out: list[str] = []
    for t in sorted(terms):
        if not out or not t.startswith(out[-1]):
            out.append(t)
    return out


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    coef: list = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    whole: int = 0             # compressed length under the toxic dictionary of a window that it holds whole


@lru_cache(maxsize=2)
def _tools(ordinary: bytes, toxic: bytes):
    import zstandard as z

    def one(raw):
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(LEVEL)
        return z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                write_dict_id=False)

    grams = {toxic[i:i + GRAM] for i in range(len(toxic) - len(ordinary) - GRAM + 1)}
    return one(ordinary), one(toxic), grams, {}


def distance(model: Model, word: str) -> int:
    """Largest drop of compressed length from the ordinary to the toxic
    dictionary over the word's windows: itself and its beginnings."""
    a, b, grams, _ = _tools(model.ordinary, model.toxic)
    top = 0
    for text in beginnings(word):
        w = window(text)
        if len(w) > GRAM and any(w[i:i + GRAM] in grams for i in range(len(w) - GRAM + 1)):
            left = len(b.compress(LEAD + w))
            if left <= model.whole:
                top = max(top, len(a.compress(LEAD + w)) - left)
    return top                                         # 0 if only the ordinary dictionary could match


def features(model: Model, texts: list[str]) -> np.ndarray:
    """Per text: largest window distance, windows over MARGIN, words."""
    known = _tools(model.ordinary, model.toxic)[3]
    out = np.zeros((len(texts), 3))
    for r, t in enumerate(texts):
        tokens = t.lower().split()
        top, n = 0, 0
        for tok in tokens:
            d = known.get(tok)
            if d is None:
                if len(known) >= CACHE:
                    known.clear()
                d = known[tok] = max((distance(model, p) for p in pieces(tok)), default=0)
            if d > 0:
                top = max(top, d)
                n += d >= MARGIN
        out[r] = top, n, len(tokens)
    return out


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1]), np.log1p(x[:, 2]) / 10])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return b


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of the labelled rows with the lowest id hash of each class."""
    lab = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
           .groupBy(F.col(id_col).alias("_lid")).agg(F.max("toxic").alias("y")))
    ids = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("_lid"), "_lid").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(ids), d[id_col] == F.col("_lid")).select("text", "y")   # at most 2 * rows ids


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Dictionaries and thresholds from ``labels`` (doc_id, toxic)."""
    import zstandard as z

    from murmura.llm.tables import written
    s = written(_sample(docs, labels, sample, id_col, text_col), "tox-sample")
    counts = {r["y"]: r["n"] for r in s.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    every = {r["t"]: r["n"] for r in labels.where(F.col("toxic").isNotNull())
             .groupBy(F.col("toxic").alias("t")).agg(F.count("*").alias("n")).collect()}
    prior = (every.get(1, 0) + 0.5) / (sum(every.values()) + 1)
    flat = Model(LEAD, LEAD, [float(np.log(prior / (1 - prior))), 0.0, 0.0, 0.0])
    if not n1 or not n0:
        return flat

    def terms(batches):                                # (term, y) once a distinct text
        for b in batches:
            t, y = [], []
            for text, label in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                got = {f for w in {p for tok in set(text.lower().split()) for p in pieces(tok)} for f in beginnings(w)}
                t += got
                y += [label] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(y, pa.int32())], ["term", "y"])

    distinct = s.dropDuplicates(["text"])
    n_t = F.sum(F.col("y"))
    odds = F.log(((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1)))
    told = (distinct.mapInArrow(terms, "term string, y int").groupBy("term")
            .agg(n_t.alias("n1"), (F.count("*") - n_t).alias("n0"))
            .where((F.col("n1") >= max(3.0, LEAST_SHARE * n1)) & (odds >= LEAST_LOG_ODDS))
            .orderBy((odds * F.sqrt("n1")).desc(), "term").limit(TERMS))
    maybe = {r["term"] for r in told.collect()}

    def contexts(batches):                             # (candidate, hash of it with its neighbours, y)
        for b in batches:
            t, c, y = [], [], []
            for text, label in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                tokens = text.lower().split()
                for i, tok in enumerate(tokens):
                    for p in pieces(tok):
                        got = [f for f in beginnings(p) if f in maybe]
                        if got:
                            around = zlib.crc32(" ".join(tokens[max(0, i - 1):i + 2]).encode())
                            t += got
                            c += [around] * len(got)
                            y += [label] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(c, pa.int64()), pa.array(y, pa.int32())],
                                             ["term", "c", "y"])

    # copies of one toxic document repeat its contexts too, so they count once here
    seen = (distinct.mapInArrow(contexts, "term string, c bigint, y int").distinct().groupBy("term")
            .agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
            .where((F.col("c1") >= 4) & (F.log((F.col("c1") / n1) / ((F.col("c0") + 0.5) / n0)) >= LEAST_LOG_ODDS)))
    marks = shortest([r["term"] for r in seen.collect()])
    if not marks:
        return flat

    def windows(batches):                              # toxic words with a mark; ordinary runs of six words
        for b in batches:
            w, y = [], []
            for text, label in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                tokens = text.lower().split()
                if label:
                    got = {p for t in set(tokens) for p in pieces(t) if any(f" {p} ".startswith(m) for m in marks)}
                    w += [f" {p} " for p in got if len(p) <= 40]
                else:
                    got = [" ".join(tokens[i:i + 6]) for i in range(0, len(tokens), 6)]
                    w += [f" {g} " for g in got if len(g) <= 200]
                y += [label] * (len(w) - len(y))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int32())], ["w", "y"])

    grouped = (distinct.mapInArrow(windows, "w string, y int").groupBy("w", "y").agg(F.count("*").alias("n")))
    toxic = grouped.where("y = 1").orderBy(F.col("n").desc(), "w").limit(8000).collect()
    plain = grouped.where("y = 0").orderBy(F.xxhash64("w"), "w").limit(16000).collect()

    def trained(samples, size, **how):
        try:
            raw = z.train_dictionary(size, samples, **how).as_bytes()
        except z.ZstdError:                            # too few samples to train on: they are the dictionary
            raw = b"".join(samples)
        return raw[-size:]

    by_mark = {m: [r["w"].encode() for r in toxic if r["w"].startswith(m)][:WORDS] for m in marks}
    words = [w for some in by_mark.values() for w in some for _ in range(8)]
    # what follows a mark is ordinary text: both dictionaries get it
    ends = b"".join(w[max(len(m.encode()), len(w) // 2):] for m, some in by_mark.items() for w in some)[-DICT_BYTES:]
    base = trained([r["w"].encode() for r in plain], 2 * DICT_BYTES)[-12000:] + ends + LEAD
    own = trained(words, DICT_BYTES, d=6, k=64)[-DICT_BYTES // 2:] + b"".join(
        window(w.decode()) for rank in range(WORDS - 1, -1, -1) for some in by_mark.values()
        for w in some[rank:rank + 1])[-2 * DICT_BYTES:]
    model = Model(base, own + base)
    held = sorted(len(_tools(model.ordinary, model.toxic)[1].compress(LEAD + window(w.decode())))
                  for w in words)
    model.whole = held[len(held) // 2]                 # calibrated on the dictionary's own windows

    def numbers(batches):
        for b in batches:
            x = features(model, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(3)] + [b["y"]], ["a", "b", "c", "y"])

    rows = np.array([tuple(r) for r in s.mapInArrow(numbers, "a double, b double, c double, y int").collect()], float)
    x, y = rows[:, :3], rows[:, 3]
    w = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    model.coef = [float(v) for v in logistic(design(x), y, w)]
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5)."""
    @F.arrow_udf("double")
    def scored(col: pa.Array) -> pa.Array:
        x = features(model, col.fill_null("").to_pylist())
        return pa.array(1 / (1 + np.exp(-np.clip(design(x) @ np.array(model.coef), -30, 30))))
    d = docs.withColumn("score", scored(F.col(text_col).cast("string")))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
