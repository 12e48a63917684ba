"""Pluggable text scorers and embedders.

A scorer turns a text column into a label column.  Built-in defaults are JVM
expressions (rules, lexicon counts, hashed bags of words) so they stay inside
whole-stage code generation.  An external model plugs in as an Arrow batch
function (``ArrowScorer``) which Spark runs as a ``pandas_udf`` over
Iterator[Series]: one model initialisation per task, batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, and task parallelism as
the concurrency bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.constants import NEGATIVE, NEUTRAL, POSITIVE
from murmura.functions.text import contains_any, tokens


class Scorer:
    """text (+ keyword) -> label column."""

    def column(self, text: Column, keyword: Column | None = None) -> Column:  # pragma: no cover
        raise NotImplementedError


class RuleRelevance(Scorer):
    """Offline relevance rule: the text mentions the keyword (case-insensitive)
    and none of the exclusion terms (trade, sports, politics, ...).

    Answers 'yes'/'no' like the instruction asks a model to.
    """

    def __init__(self, exclude: Sequence[str] = (), yes: str = "yes", no: str = "no"):
        self.exclude = list(exclude)
        self.yes, self.no = yes, no

    def column(self, text: Column, keyword: Column | None = None) -> Column:
        low = F.lower(text)
        mention = F.lit(True) if keyword is None else F.coalesce(low.contains(F.lower(keyword)), F.lit(False))
        bad = contains_any(low, [t.lower() for t in self.exclude])
        return F.when(text.isNull(), F.lit(None).cast("string")) \
                .when(mention & ~bad, F.lit(self.yes)).otherwise(F.lit(self.no))


class LexiconSentiment(Scorer):
    """Offline sentiment: sign of (positive - negative) lexicon token hits."""

    def __init__(self, positive: Sequence[str], negative: Sequence[str]):
        self.positive = [t.lower() for t in positive]
        self.negative = [t.lower() for t in negative]

    def hits(self, text: Column) -> tuple[Column, Column]:
        toks = tokens(text)
        pos = F.size(F.filter(toks, lambda t: t.isin(self.positive)))
        neg = F.size(F.filter(toks, lambda t: t.isin(self.negative)))
        return pos, neg

    def column(self, text: Column, keyword: Column | None = None) -> Column:
        pos, neg = self.hits(text)
        return (F.when(text.isNull(), F.lit(NEUTRAL))
                .when(pos > neg, F.lit(POSITIVE)).when(neg > pos, F.lit(NEGATIVE))
                .otherwise(F.lit(NEUTRAL)))


class ArrowScorer(Scorer):
    """Wrap ``fn(texts: pd.Series, keywords: pd.Series) -> pd.Series`` (a model
    client, a local classifier) as a vectorised UDF.

    ``on_error='raise'`` fails the job on the first failure (relevance: one
    failure fails the run); ``on_error='default'`` retries a failing request
    row by row and answers ``default`` for rows that still fail (sentiment: an
    error counts as neutral).  ``init`` runs once per task; what it returns (a
    client, a loaded model) is passed to ``fn`` as a third argument.

    ``concurrency`` requests of ``request_rows`` rows run at once in a task (a
    remote model); 1 sends each Arrow batch as one request.
    """

    def __init__(self, fn: Callable[..., pd.Series], *,
                 on_error: str = "raise", default: str = NEUTRAL,
                 init: Callable[[], object] | None = None, concurrency: int = 1, request_rows: int = 16):
        assert on_error in ("raise", "default") and concurrency >= 1 and request_rows >= 1
        self.fn, self.on_error, self.default, self.init = fn, on_error, default, init
        self.concurrency, self.request_rows = concurrency, request_rows

    def udf(self):
        fn, on_error, default, init = self.fn, self.on_error, self.default, self.init
        concurrency, rows = self.concurrency, self.request_rows

        @F.pandas_udf(T.StringType())
        def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            from concurrent.futures import ThreadPoolExecutor
            resource = () if init is None else (init(),)

            def ask(texts, kws):
                return pd.Series(fn(texts, kws, *resource)).to_list()

            def answers(part):
                texts, kws = part
                try:
                    return ask(texts, kws)
                except Exception:
                    if on_error == "raise":
                        raise
                out = []
                for t, k in zip(texts, kws):
                    try:
                        out += ask(pd.Series([t]), pd.Series([k]))
                    except Exception:
                        out.append(default)
                return out

            with ThreadPoolExecutor(concurrency) as pool:
                for texts, kws in it:
                    step = len(texts) if concurrency == 1 else rows
                    cuts = range(0, len(texts), max(1, step))
                    parts = [(texts.iloc[i:i + step], kws.iloc[i:i + step]) for i in cuts]
                    vals = [v for some in pool.map(answers, parts) for v in some]
                    out = pd.Series(vals, index=texts.index, dtype=object)
                    yield out.where(out.notna(), None)

        return score

    def column(self, text: Column, keyword: Column | None = None) -> Column:
        kw = keyword if keyword is not None else F.lit(None).cast("string")
        return self.udf()(text, kw)


def score(df: DataFrame, scorer: Scorer, text_col: str, out_col: str,
          keyword_col: str | None = None) -> DataFrame:
    if hasattr(scorer, "transform"):          # a fitted model works on the table
        return scorer.transform(df, text_col, out_col)
    kw = F.col(keyword_col) if keyword_col else None
    return df.withColumn(out_col, scorer.column(F.col(text_col), kw))


# ---------------------------------------------------------------- embedding

AT_ONCE = 1 << 18            # tokens that are numbered at once: some tens of MB


def _bucket_counts(words: pa.Array, dim: int) -> np.ndarray:
    """Token lists -> bucket counts [rows, dim] (a null row counts nothing), by
    runs of rows with at most AT_ONCE tokens (a longer row alone), so memory does
    not follow the number of tokens in a batch."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    out, a = np.zeros((n, dim), np.int64), 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, "right")) - 1)
        out[a:z] = _run_counts(words.slice(a, z - a), dim)
        a = z
    return out


def _run_counts(words: pa.Array, dim: int) -> np.ndarray:
    """Bucket counts of some rows.  The bucket is the first 28 bits of md5(token)
    mod ``dim``; Arrow numbers the distinct tokens, so each is hashed once however
    often it stands."""
    n = len(words)
    coded = words.flatten().dictionary_encode()
    bucket = np.fromiter((int(md5(w.encode()).hexdigest()[:7], 16) % dim for w in coded.dictionary.to_pylist()),
                         np.int64, len(coded.dictionary))
    rows = np.repeat(np.arange(n), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = rows * dim + bucket[coded.indices.to_numpy(zero_copy_only=False)]
    return np.bincount(at, minlength=n * dim).reshape(n, dim)


def _lists(m: np.ndarray, like: pa.Array) -> pa.Array:
    """Rows of a matrix as an Arrow list column, null where ``like`` is."""
    n, dim = m.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(ends, pa.array(m.ravel()), mask=like.is_null() if like.null_count else None)


class HashEmbedder:
    """Offline embedder: L2-normalised hashed bag of words.

    The JVM cuts the text into tokens; an Arrow function numbers them, hashes each
    distinct one and counts buckets with one numpy ``bincount`` a batch.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def counts_column(self, text: Column) -> Column:
        """Raw bucket counts ``ARRAY<INT>`` of length ``dim``."""
        dim = self.dim

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def counts(words: pa.Array) -> pa.Array:
            return _lists(_bucket_counts(words, dim).astype(np.int32), words)

        return counts(tokens(text))

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def embed(words: pa.Array) -> pa.Array:
            m = _bucket_counts(words, dim).astype(np.float64)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return _lists((m / np.where(norm > 0, norm, 1.0)).astype(np.float32), words)

        return embed(tokens(text))


def embed(df: DataFrame, text_col: str = "document", out_col: str = "embedding",
          embedder=None) -> DataFrame:
    embedder = embedder or HashEmbedder()
    return df.withColumn(out_col, embedder.column(F.col(text_col)))
