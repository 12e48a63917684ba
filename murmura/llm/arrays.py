"""Vectorised text helpers on Arrow string columns: word spans, word hashes,
n-gram hashes and set fingerprints, computed over a batch's byte buffer.

Words are ``[^\\x20\\x09-\\x0D]+``; every separator is a single ASCII byte, so
spans found on the UTF-8 bytes are spans of whole characters.  All hashes are
64-bit; two different inputs share one with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
NULL_ID = -(2 ** 63)          # stands for a null document id inside numpy
SLAB = 1 << 21                # bytes hashed at once

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240501).integers(1, 2 ** 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POW = np.cumprod(np.concatenate([[U(1)], np.full(SLAB, _BASE, dtype=np.uint64)]))
_INV = np.cumprod(np.concatenate([[U(1)], np.full(SLAB, pow(_BASE, -1, 2 ** 64), dtype=np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets (null = empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return raw, o - o[0]


def id_array(col) -> np.ndarray:
    """Document ids as int64, null as NULL_ID."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def slabs(offsets: np.ndarray, target: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``target`` bytes (a longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses a row."""
    if len(data) == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    w = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.concatenate([[False], w[:-1]])
    starts = np.flatnonzero(w & (~prev | edge[:-1]))
    nxt = np.concatenate([w[1:], [False]])
    ends = np.flatnonzero(w & (~nxt | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of the bytes of each (ordered, disjoint) span, A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLAB, "right")))
        seg = data[base:ends[j - 1]]
        if len(seg) > SLAB:                       # one very long word: fold it slab by slab
            h = U(len(seg) & (2 ** 63 - 1))
            for k in range(0, len(seg), SLAB):
                part = seg[k:k + SLAB]
                c = _CODES[_LOWER[part] if lower else part]
                h = mix(np.array([h * U(31) + (c * _POW[:len(part)]).sum(dtype=np.uint64)]))[0]
            out[i] = h
        else:
            c = _CODES[_LOWER[seg] if lower else seg] * _POW[:len(seg)]
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c, dtype=np.uint64)])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((s[b] - s[a]) * _INV[a] + (b - a).astype(np.uint64))
        i = j
    return out


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words inside one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ok = rows[n - 1:] == rows[:m]
    h = np.full(m, U(n), np.uint64)
    for k in range(n):
        h = mix(h * U(0x100000001B3) + words[k:k + m])
    return h[ok], rows[:m][ok]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of every row.  A row with fewer
    words has its whole sequence as one shingle; one without words has none."""
    s, e, rows = word_spans(data, offsets)
    words = span_hashes(data, s, e)
    grams, grow = ngram_hashes(words, rows, n)
    k = len(offsets) - 1
    cut, wcut = np.searchsorted(grow, np.arange(k + 1)), np.searchsorted(rows, np.arange(k + 1))
    out = []
    for r in range(k):
        g = grams[cut[r]:cut[r + 1]]
        if len(g) == 0 and wcut[r + 1] > wcut[r]:
            h = np.full(1, U(0x5EED + int(wcut[r + 1] - wcut[r])), np.uint64)
            for w in words[wcut[r]:wcut[r + 1]]:
                h = mix(h * U(0x100000001B3) + w)
            g = h
        out.append(np.unique(g))
    return out


def set_fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set given as sorted distinct hashes."""
    one = int(mix(s).sum(dtype=np.uint64)) + len(s)
    two = int(mix((s * U(0xD6E8FEB86659FD93)) ^ (s >> U(32))).sum(dtype=np.uint64))
    h = mix(np.array([(one ^ 3 * two) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return int(h.view(np.int64)[0])


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each 8-byte number, plane by plane (empty and
    repetitive planes vanish under the shuffle's compression)."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int, kind=np.int64) -> np.ndarray:
    p = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :width] = p.T
    return out.reshape(-1).view(kind)


PIECE = 8 << 20                # text bytes that a task step works on at once


def pieces(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PIECE bytes of its text column."""
    if text is None:
        yield batch
        return
    _, offs = text_buffer(batch[text])
    for i, j in slabs(offs, PIECE):
        yield batch.slice(i, j - i)


def map_arrow(df, fn, schema: str, text: str | None = None):
    """``mapInArrow`` over one-batch functions: fn(RecordBatch) -> RecordBatch
    iterator.  With ``text`` the batches are cut so that memory follows PIECE,
    not the number of rows that Spark puts into a batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                for part in pieces(b, text):
                    yield from fn(part)
                pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)
