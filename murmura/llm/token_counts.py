"""Token counts: batch encoding in Arrow functions that return lengths only.

``token_counts(df, path)`` adds the number of tokens that the vocabulary file
``path`` gives for each whole text, without begin, end or added special
tokens, truncation or padding.  Texts are encoded in batches balanced by
bytes; a long text is first cut at boundaries where no token can lie across
the cut, so the parts' counts add up to the count of the whole:

* ``.model`` (sentencepiece): before a space that follows a non-space.  Pieces
  hold the space mark only at their start (checked when the file is loaded;
  otherwise texts are never cut), and the part's own leading space is dropped
  because the library writes one before every text.
* ``.json`` (tokenizers): before a space between two ASCII letters, where the
  byte-level and word-end pre-tokenizers always start a new word.

Null text counts as the empty text (0 tokens).  Rows are independent: ties,
repeated rows and extra columns pass through; an output column that exists
already is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 16        # texts over this many characters are cut
BATCH_CHARS = 1 << 19       # characters handed to the library at once
MARK = "▁"             # sentencepiece's written space
_MODEL_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_JSON_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def parts(text: str, cut: re.Pattern | None, size: int = PART_CHARS) -> list[str]:
    """The text cut at safe boundaries into parts of about ``size`` characters.
    The match itself (a space, or nothing) is left out between parts."""
    if cut is None or len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.end()
    out.append(text[at:])
    return out


@lru_cache(maxsize=4)
def encoder(path: str):
    """(function: list of texts -> list of id sequences, cut pattern) of a
    vocabulary file, loaded once per Python worker."""
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
        return lambda t: sp.encode(t, num_threads=1), None if crossing else _MODEL_CUT
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda t: [e.ids for e in tok.encode_batch(t, add_special_tokens=False)], _JSON_CUT


def byte_batches(lengths: list[int], limit: int):
    """Runs of consecutive items whose lengths add up to about ``limit``."""
    i = total = 0
    for j, n in enumerate(lengths):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(lengths):
        yield i, len(lengths)


def encoded(path: str, texts: list[str]):
    """For every text in turn, the id sequences of its parts."""
    run, cut = encoder(path)
    pieces, owner = [], []
    for k, t in enumerate(texts):
        p = parts(t, cut)
        pieces += p
        owner += [k] * len(p)
    held, at = [], 0
    for i, j in byte_batches([len(p) for p in pieces], BATCH_CHARS):
        for k, ids in zip(owner[i:j], run(pieces[i:j])):
            if k != at:
                yield from _runs(held, at, k)
                held, at = [], k
            held.append(ids)
    if texts:
        yield from _runs(held, at, len(texts))


def _runs(held, at, k):
    yield held
    for _ in range(at + 1, k):
        yield []


def length_udf(path: str):
    @F.arrow_udf("bigint")
    def n_tokens(col: pa.Array) -> pa.Array:
        texts = col.fill_null("").to_pylist()
        return pa.array(np.fromiter((sum(map(len, p)) for p in encoded(path, texts)), np.int64, len(texts)))
    return n_tokens


def token_counts(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of every whole text in ``out``."""
    return df.withColumn(out, length_udf(path)(F.col(text_col).cast("string")))
