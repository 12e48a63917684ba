"""Substring de-duplication by the difference-cover suffix-array algorithm.

Every byte of a document that is covered by a ``length``-byte string which also
starts in a document with a smaller doc_id is removed.  Strings are judged on
the input, never across documents.

Only strings of ``length`` bytes are compared, and equal strings have the same
minimiser (the least hash of their MER-byte substrings), so:

1. Filter: text is cut into slices, runs of windows that share a minimiser.
   Packed (minimiser, slice hash, document) entries go to the minimiser's
   bucket.  A slice that a smaller document has whole is marked there and then;
   a minimiser found in one document only, or with one slice only, is done.
   Equal slices of a batch are combined first, so a passage in a third of all
   documents sends one entry a batch.
2. Slices: where a minimiser has several slices, one document of each sends the
   slice's bytes, packed, on the routes of the minimiser with half of the bytes
   that a match needs before or after it (equal windows agree in one of them).
   A crowded minimiser (more than CROWD slices in a task step or MANY in all)
   would load a route: its slices are sent as hashes of their windows instead,
   each task step marks what a smaller document of the step has, and only the
   smallest document of a window goes on, so a window meets one entry a step.
3. In each bucket the distinct slices are one text, whose suffixes are sorted by
   the difference-cover algorithm (``suffix_array``): sort the sampled triples
   (positions 1 and 2 mod 3), recurse on their names, sort the rest by (byte,
   rank), merge.  The recursion ends when names are unique or cover ``length``
   bytes.  Neighbours that agree in ``length`` bytes form a class, and windows
   of a document larger than the class's smallest are marked.
4. Marks meet their documents, are united and cut out.

Null or empty text has no bytes.  A null doc_id is smaller than all others.
Rows that repeat a doc_id are one document for the comparison and are cut one by
one.  Extra columns pass through; ``kept`` (binary), ``n_bytes``, ``n_removed``,
``n_spans`` replace such columns.  An empty table gives an empty result.
Minimisers are compared by 40 bits of their hash and the bucket, slices of one
minimiser by 48 bits, what a document is told of a slice by 62, windows of
crowded minimisers by 64; other windows in a bucket byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from murmura.llm import arrays as A
from murmura.llm.tables import own_names, parts_of, written

LENGTH = 50
MER = 20
LONGEST = 64                # windows in a slice
CROWD = 64                  # slices of one minimiser in a task step that make it crowded
MANY = 1024                 # slices of one minimiser over all documents that make it crowded
STEP = 1 << 18              # windows of crowded minimisers hashed and combined at once
U = np.uint64
SLAB = 1 << 16              # bytes hashed at once: the arrays stay in the cache


# ----------------------------------------------- difference-cover suffix array

def _names(cols: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Rank (from 1) of each row of the columns, equal rows sharing one."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a text of positive integers, exact for the first
    ``depth`` symbols (difference cover {1, 2} mod 3)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    p1 = np.arange(1, n + (n % 3 == 1), 3)
    p2 = np.arange(2, n, 3)
    sample = np.concatenate([p1, p2])
    names, kinds = _names([t[sample], t[sample + 1], t[sample + 2]])
    if kinds < len(sample) and depth > 3:
        order = suffix_array(names, -(-depth // 3))
        ranks = np.empty(len(sample), np.int64)
        ranks[order] = np.arange(1, len(sample) + 1)
    else:
        ranks, order = names, np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranks
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]                  # without the padding position

    p0 = np.arange(0, n, 3)
    p0 = p0[np.lexsort((rank[p0 + 1], t[p0]))]
    # how many sampled suffixes stand before each unsampled one
    wide = int(rank.max()) + 1
    in1, in2 = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    key = lambda c, i: t[i] * wide + rank[c]
    before = np.searchsorted(np.sort(key(in1 + 1, in1)), key(p0 + 1, p0))
    pair, _ = _names([np.concatenate([t[p0], t[in2]]), np.concatenate([t[p0 + 1], t[in2 + 1]])])
    k0 = pair[:len(p0)] * wide + rank[p0 + 2]
    k2 = pair[len(p0):] * wide + rank[in2 + 2]
    before = before + np.searchsorted(np.sort(k2), k0)
    place = np.concatenate([np.arange(len(sorted12)) * 2 + 1, before * 2])
    return np.concatenate([sorted12, p0])[np.argsort(place, kind="stable")]


def marked_windows(text: np.ndarray, valid: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For every position: does the window starting there (``valid``) equal one
    of a smaller ``doc``?  Neighbours in suffix order are compared."""
    sa = suffix_array(text, length)
    sa = sa[valid[sa]]
    out = np.zeros(len(text), bool)
    if len(sa) < 2:
        return out
    same = np.empty(len(sa) - 1, bool)
    for a in range(0, len(sa) - 1, 1 << 16):
        b = min(a + (1 << 16), len(sa) - 1)
        eq = np.ones(b - a, bool)
        left, right = sa[a:b], sa[a + 1:b + 1]
        for k in range(length):
            eq &= text[left + k] == text[right + k]
        same[a:b] = eq
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc[sa], first)
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    out[sa] = doc[sa] > least[group]
    return out


# ------------------------------------------------------------- minimiser runs

def _window_hash(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of every ``size``-byte substring (its high bits order
    well), and the running sums it comes from."""
    n = len(data)
    c = A._CODES[data]
    c *= A._POW[:n]
    s = np.empty(n + 1, np.uint64)
    s[0] = 0
    np.cumsum(c, out=s[1:])
    h = s[size:] - s[:-size]
    h *= A._INV[:n - size + 1]
    return h, s


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    step, m = 1, h
    while step * 2 <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:len(m) - (w - step)], m[w - step:]) if w > step else m


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, mer: int):
    """(row, start, windows, key, hash of the bytes) of the runs of windows of each
    row that share a minimiser; ``start`` counts from the row's first byte."""
    rows, starts, counts, keys, hashes = [], [], [], [], []
    for r0, r1 in A.slabs(offsets, SLAB):
        lo, hi = int(offsets[r0]), int(offsets[r1])
        at = lo
        while hi - at >= length:                       # a long row is read in overlapping pieces
            end = min(hi, at + 4 * SLAB) if r1 - r0 == 1 else hi
            h, sums = _window_hash(data[at:end], mer)
            low = _sliding_min(h, length - mer + 1)
            first = np.empty(len(low), bool)
            first[0] = True
            np.not_equal(low[1:], low[:-1], out=first[1:])
            inner = offsets[r0 + 1:r1] - at
            first[inner[inner < len(low)]] = True
            i = np.flatnonzero(first)
            row = np.searchsorted(offsets, i + at, "right") - 1
            stop = np.minimum(np.concatenate([i[1:], [len(low)]]), offsets[row + 1] - at - length + 1)
            n = stop - i
            ok = n > 0
            row, i, n = row[ok], i[ok], n[ok]
            if len(n) and n.max() > LONGEST:           # loops: equal cuts of a loop are equal slices
                parts = -(-n // LONGEST)
                nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                row, i, n = (np.repeat(x, parts) for x in (row, i, n))
                i, n = i + nth * LONGEST, np.minimum(n - nth * LONGEST, LONGEST)
            size = n + length - 1
            rows.append(row)
            starts.append(i + at - offsets[row])
            counts.append(n)
            keys.append(low[i])
            hashes.append(A.mix((sums[i + size] - sums[i]) * A._INV[i] + size.astype(np.uint64)))
            if end == hi:
                break
            at = end - length + 1
    if not rows:
        z = np.empty(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(map(np.concatenate, (rows, starts, counts, keys, hashes)))


SORTED = 8                                             # sorted texts that a bucket's slices are dealt to
KEY, SLICE = 5, 6                                      # bytes compared of a minimiser (besides its bucket) and of a slice


def slices_of(data: np.ndarray, offsets: np.ndarray, length: int, mer: int, buckets: int):
    """(row, start, windows, bucket, key, slice): the runs with their bucket, the
    rest of the minimiser's hash and a hash of the run's bytes."""
    row, start, count, low, same = runs_of(data, offsets, length, mer)
    low = A.mix(low)
    bucket = (low % U(buckets)).astype(np.int32)
    key = (low // U(buckets)) & U(2 ** (8 * KEY) - 1)
    return row, start, count, bucket, key, same >> U(8 * (8 - SLICE))


WHOLE, BYTES, WINDOWS = 0, 1, 3


def _ids(bucket, key, same, told) -> np.ndarray:
    """What a document is told about a slice: its id, the low two bits of which
    say that a smaller document has the WHOLE slice, or that the document is to
    send the slice's BYTES or, of a crowded minimiser, its WINDOWS."""
    h = A.mix(A.mix(bucket.astype(np.uint64) + U(1)) ^ key * U(0x9E3779B97F4A7C15) ^ A.mix(same))
    return ((h & U(2 ** 64 - 4)) | np.asarray(told, np.uint64)).view(np.int64)


def _split(bucket):
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [g for g in np.split(order, cut) if len(g)]


def replies_of(d: DataFrame, length: int, mer: int, buckets: int) -> DataFrame:
    """(doc, id) for every slice that a smaller document has too, or whose
    minimiser another document has with other bytes around it.

    A crowded minimiser (a phrase or the edge of a passage that many documents
    hold) would load its bucket: its entries are dealt by slice instead, and the
    bucket only learns that it is crowded, so the slices of calmer tasks are
    sent too.  All its slices are told to go as windows."""
    def send(b):
        ids = A.id_array(b["_id"])
        data, offs = A.text_buffer(b["_text"])
        row, _, _, bucket, key, same = slices_of(data, offs, length, mer, buckets)
        if not len(row):
            return
        doc = ids[row]
        known = _ids(bucket, key, same, WHOLE)
        order = np.argsort(known, kind="stable")
        doc, bucket, key, same, known = doc[order], bucket[order], key[order], same[order], known[order]
        new = np.concatenate([[True], known[1:] != known[:-1]])
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[group]
        told = np.flatnonzero(doc > least)             # a smaller document of this step has the slice
        ask = np.flatnonzero(doc == least)
        ask = ask[np.concatenate([[True], np.diff(group[ask]) > 0])]
        ask = ask[np.argsort(doc[ask], kind="stable")]
        whole = A.mix(key ^ A.mix(bucket.astype(np.uint64) + U(1)))
        names, of, n = np.unique(whole[ask], return_inverse=True, return_counts=True)
        crowded = n[of] > CROWD
        hot, ask = ask[crowded], ask[~crowded]
        first = np.unique(whole[hot], return_index=True)[1]
        packs = [(KIND_ASK, int(bucket[ask[g[0]]]), A.planes(key[ask[g]], KEY), A.planes(same[ask[g]], SLICE), A.planes(doc[ask[g]], 8))
                 for g in _split(bucket[ask])]
        packs += [(KIND_CROWDED, int(bucket[hot[g[0]]]), A.planes(key[hot[g]], KEY), b"", b"")
                  for g in (first[x] for x in _split(bucket[hot[first]]))]
        dealt = (A.mix(known[hot].view(np.uint64)) % U(buckets)).astype(np.int32)
        packs += [(KIND_DEALT, int(dealt[g[0]]), A.planes(known[hot[g]], 8), b"", A.planes(doc[hot[g]], 8)) for g in _split(dealt)]
        some = np.array_split(told, max(1, len(told) // 8192)) if len(told) else []
        even = np.random.default_rng(len(key)).integers(0, buckets, len(some)).tolist()
        packs += [(KIND_TOLD, e, A.planes(known[g], 8), b"", A.planes(doc[g], 8)) for g, e in zip(some, even)]
        kinds, where, keys, slices, docs = zip(*packs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int32()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()),
             pa.array(slices, pa.binary()), pa.array(docs, pa.binary())], ["bucket", "kind", "keys", "slices", "docs"])

    def answer(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        rows = list(zip(*(t[c].to_pylist() for c in ("kind", "keys", "slices", "docs"))))
        out_i, out_d = [], []
        for _, k, _, d_ in (r for r in rows if r[0] == KIND_TOLD):
            out_i.append(A.unplanes(k, 8))
            out_d.append(A.unplanes(d_, 8))
        dealt = [(A.unplanes(k, 8), A.unplanes(d_, 8)) for kind, k, _, d_ in rows if kind == KIND_DEALT]
        if dealt:
            i, d_ = (np.concatenate(x) for x in zip(*dealt))
            order = np.lexsort((d_, i))
            i, d_ = i[order], d_[order]
            new = np.concatenate([[True], i[1:] != i[:-1]])
            least = d_[new][np.cumsum(new) - 1]
            out_i.append(np.where(d_ == least, i | WINDOWS, i))
            out_d.append(d_)
        ask = [(A.unplanes(k, KEY, np.uint64), A.unplanes(x, SLICE, np.uint64), A.unplanes(d_, 8)) for kind, k, x, d_ in rows if kind == KIND_ASK]
        if ask:
            k, s_, d_ = (np.concatenate(x) for x in zip(*ask))
            crowd = np.unique(np.concatenate([np.empty(0, np.uint64)] + [A.unplanes(x, KEY, np.uint64) for kind, x, _, _ in rows if kind == KIND_CROWDED]))
            order = np.argsort(k, kind="stable")
            same = k[order][1:] == k[order][:-1]
            again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            some = order[again | np.isin(k[order], crowd)]     # most minimisers stand alone
            k, s_, d_ = k[some], s_[some], d_[some]
            if len(k):
                order = np.lexsort((d_, s_, k))
                k, s_, d_ = k[order], s_[order], d_[order]
                nk = np.concatenate([[True], k[1:] != k[:-1]])
                ns = nk | np.concatenate([[True], s_[1:] != s_[:-1]])
                kf, of_k = np.flatnonzero(nk), np.cumsum(nk) - 1
                least = d_[ns][np.cumsum(ns) - 1]
                slices = np.add.reduceat(ns.astype(np.int64), kf)
                crowded = (slices > MANY)[of_k] | np.isin(k, crowd)
                mixed = ((np.minimum.reduceat(d_, kf) != np.maximum.reduceat(d_, kf)) & (slices > 1))[of_k] | crowded
                where = np.full(len(k), bucket, np.int32)
                for pick, say in ((d_ > least, WHOLE), ((d_ == least) & mixed & ~crowded, BYTES), ((d_ == least) & mixed & crowded, WINDOWS)):
                    out_i.append(_ids(where[pick], k[pick], s_[pick], say))
                    out_d.append(d_[pick])
        z = [np.empty(0, np.int64)]
        return pa.table({"doc": np.concatenate(out_d or z), "id": np.concatenate(out_i or z)})

    packed = A.map_arrow(d, send, "bucket int, kind int, keys binary, slices binary, docs binary", "_text")
    return packed.groupBy("bucket").applyInArrow(answer, "doc bigint, id bigint")


KIND_ASK, KIND_CROWDED, KIND_DEALT, KIND_TOLD = range(4)


def _told(batch, bucket, key, same, row, say: int) -> np.ndarray:
    """Which slices of the batch's rows were told so."""
    lists = batch["_told"]
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    flat = flat[at[0]:at[-1]].view(np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64)
    want = np.sort(A.mix(flat ^ A.mix(owner + U(1))))
    have = A.mix(_ids(bucket, key, same, say).view(np.uint64) ^ A.mix(row.astype(np.uint64) + U(1)))
    if not len(want):
        return np.zeros(len(have), bool)
    i = np.minimum(np.searchsorted(want, have), len(want) - 1)
    return want[i] == have


def sides(text: np.ndarray, put: np.ndarray, length: int, mer: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice, route) pairs of slices laid end to end (slice i is
    ``put[i]:put[i + 1]``).  Equal windows hold the minimiser with the same bytes
    around it, so they agree in half of the other bytes before it or after it:
    a slice is routed by the minimiser with either half, at every place of it."""
    half = (length - mer) // 2
    size = np.diff(put)
    run = np.concatenate([np.zeros(1, np.uint64), _prefix(text)])
    h = run[mer:] - run[:-mer]
    h *= _inverse(np.arange(len(h)))
    owner = np.repeat(np.arange(len(size)), size)[:len(h)]
    inside = np.arange(len(h)) + mer <= put[owner + 1]
    h[~inside] = U(2 ** 64 - 1)
    low = np.minimum.reduceat(h, put[:-1])
    here = np.flatnonzero((h == low[owner]) & inside)
    who, route = [], []
    for shift in (0, -half):
        a, w = here + shift, owner[here]
        ok = (a >= put[w]) & (a + mer + half <= put[w + 1])
        a, w = a[ok], w[ok]
        if len(a):
            who.append(w)
            route.append(A.mix((run[a + mer + half] - run[a]) * _inverse(a) + U(1 if shift else 2)))
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    who, route = np.concatenate(who), np.concatenate(route)
    order = np.lexsort((route, who))
    who, route = who[order], route[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (route[1:] != route[:-1])])
    return who[new], route[new]


def _laid(at: np.ndarray, size: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Source index of slices laid end to end (each followed by ``gap`` places), and their borders."""
    put = np.concatenate([[0], np.cumsum(size + gap)])
    return np.repeat(at - put[:-1], size + gap) + np.arange(int(put[-1])), put


SLICES, ASKED, MARKED = range(3)


def _packed(kind, where, cols, texts=None):
    """Rows of ``sent``: the columns of one kind, packed by ``where``."""
    groups = _split(where)
    empty = [b""] * len(groups)
    cols = [empty if c is None else [A.planes(c[g], 8) for g in groups] for c in cols]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(where[g[0]]) for g in groups], pa.int32()), pa.array([kind] * len(groups), pa.int32())]
        + [pa.array(c, pa.binary()) for c in (*cols, empty if texts is None else [texts(g) for g in groups])],
        ["bucket", "kind", "routes", "docs", "tks", "starts", "counts", "texts"])


def windows_of(text: np.ndarray, put: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, offset, 64-bit hash) of every window of slices laid end to end."""
    run = np.concatenate([np.zeros(1, np.uint64), _prefix(text)])
    which = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    a = put[which] + offset
    return which, offset, A.mix((run[a + length] - run[a]) * _inverse(a))


def _smaller(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of every entry: does a smaller document have an entry of this hash?"""
    order = np.lexsort((doc, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    out = np.empty(len(h), bool)
    out[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    return out


def sent(some: DataFrame, text_col: str, length: int, mer: int, buckets: int) -> DataFrame:
    """Packed rows per bucket: SLICES with their bytes by route; of crowded
    minimisers the windows that no smaller document of the step has (ASKED, by
    hash), and those that one has (MARKED, evenly)."""
    schema = "bucket int, kind int, routes binary, docs binary, tks binary, starts binary, counts binary, texts binary"
    parts = buckets * SORTED

    def send(b):
        ids, tk = A.id_array(b["_id"]), b["_tk"].to_numpy()
        data, offs = A.text_buffer(b[text_col].cast(pa.string()))
        row, start, count, bucket, key, same = slices_of(data, offs, length, mer, buckets)
        if not len(row):
            return
        told = [_told(b, bucket, key, same, row, say) for say in (BYTES, WINDOWS)]
        for x in range(2):
            r, s, n = (v[told[x]] for v in (row, start, count))
            if len(r):
                yield from (by_route, by_window)[x](data, offs[r] + s, ids[r], tk[r], s, n)

    def by_route(data, lo, doc, tk, start, count):
        size = count + length - 1
        src, put = _laid(lo, size)
        who, route = sides(data[src], put, length, mer)
        if not len(who):
            return
        lo, size = lo[who], size[who]
        raw = data.tobytes()
        yield _packed(SLICES, (route % U(parts)).astype(np.int32), [route] + [x[who] for x in (doc, tk, start, count)],
                      lambda g: b"".join(raw[x:x + y] for x, y in zip(lo[g].tolist(), size[g].tolist())))

    def by_window(data, lo, doc, tk, start, count):
        piece = (np.cumsum(count) - 1) // STEP
        for g in np.split(np.arange(len(count)), np.flatnonzero(np.diff(piece)) + 1):
            src, put = _laid(lo[g], count[g] + length - 1)
            which, offset, h = windows_of(data[src], put, count[g], length)
            d, k, s = doc[g][which], tk[g][which], start[g][which] + offset
            hit = _smaller(h, d)
            ask = np.flatnonzero(~hit)
            none = ask[d[ask] == A.NULL_ID]            # the smallest document: never marked, so one entry will do
            if len(none):
                ask = np.concatenate([ask[d[ask] != A.NULL_ID], none[np.unique(h[none], return_index=True)[1]]])
            yield _packed(ASKED, (h[ask] % U(buckets)).astype(np.int32), [h[ask], d[ask], k[ask], s[ask], None])
            p = np.flatnonzero(hit)
            if len(p):
                i = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (which[p[1:]] != which[p[:-1]])]))
                n, p = np.diff(np.concatenate([i, [len(p)]])), p[i]
                even = np.random.default_rng(len(p)).integers(0, parts, len(p) // 8192 + 1)
                yield _packed(MARKED, even[np.arange(len(p)) // 8192].astype(np.int32), [None, d[p], k[p], s[p], n])

    return A.map_arrow(some, send, schema, text_col)


def marks_of(some: DataFrame, text_col: str, length: int, mer: int, buckets: int) -> DataFrame:
    """(doc, tk, start, n): runs of n windows that start in a smaller document
    too, from the slices that had to be sent."""
    def sort(t: pa.Table) -> pa.Table:
        kinds = t["kind"].to_numpy()
        out = []
        for kind in np.unique(kinds).tolist():
            part = t.filter(pa.array(kinds == kind))
            route, doc, tk, start, count = (np.concatenate([A.unplanes(x, 8) for x in part[c].to_pylist()])
                                            for c in ("routes", "docs", "tks", "starts", "counts"))
            if kind == SLICES:
                out.append(_bucket_marks(b"".join(x.as_py() for x in part["texts"]), route, doc, tk, start, count, length))
            elif kind == ASKED:
                hit = _smaller(route, doc)
                out.append((doc[hit], tk[hit], start[hit], np.ones(int(hit.sum()), np.int64)))
            else:
                out.append((doc, tk, start, count))
        return pa.table(dict(zip(("doc", "tk", "start", "n"), map(np.concatenate, zip(*out)))))

    return (sent(some, text_col, length, mer, buckets)
            .groupBy("bucket").applyInArrow(sort, "doc bigint, tk bigint, start bigint, n bigint"))


def _prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a batch (any length)."""
    out, total = np.empty(len(data), np.uint64), np.zeros(1, np.uint64)
    for a in range(0, len(data), A.SLAB):
        part = data[a:a + A.SLAB]
        c = A._CODES[part] * A._POW[:len(part)] * U(pow(A._BASE, a, 2 ** 64))
        out[a:a + len(part)] = np.cumsum(c, dtype=np.uint64) + total
        total = out[a + len(part) - 1:a + len(part)].copy()
    return out


def _inverse(at: np.ndarray) -> np.ndarray:
    """BASE ** -at."""
    big = np.array([pow(A._BASE, -int(k) * A.SLAB, 2 ** 64) for k in range(int(at.max()) // A.SLAB + 1)], np.uint64)
    return A._INV[at % A.SLAB] * big[at // A.SLAB]


def _bucket_marks(raw: bytes, route, doc, tk, start, count, length: int):
    """Marked runs (doc, tk, start, n) among the slices of one bucket: the
    slices on routes that several documents share are one text to sort."""
    size = count + length - 1
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    order = np.argsort(route, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], route[order][1:] != route[order][:-1]]))
    d = doc[order]
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    todo = order[np.repeat(many, np.diff(np.concatenate([first, [len(order)]])))]
    if len(todo):                                      # a slice may come by several routes
        o = todo[np.lexsort((start[todo], tk[todo], doc[todo]))]
        new = np.concatenate([[True], (doc[o][1:] != doc[o][:-1]) | (tk[o][1:] != tk[o][:-1]) | (start[o][1:] != start[o][:-1])])
        todo = np.sort(o[new])
    z = np.empty(0, np.int64)
    if not len(todo):
        return z, z, z, z
    data = np.frombuffer(raw, np.uint8)
    src, put = _laid(at[todo], size[todo], 1)          # each slice ends in a separator
    which = np.repeat(np.arange(len(todo)), size[todo] + 1)
    inside = np.ones(len(src), bool)
    inside[put[1:] - 1] = False
    text = np.full(len(src), 1, np.int64)
    text[inside] = data[src[inside]].astype(np.int64) + 2
    offset = np.arange(len(src)) - put[which]
    hit = marked_windows(text, offset < count[todo][which], doc[todo][which], length)
    p = np.flatnonzero(hit)
    if not len(p):
        return z, z, z, z
    new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (which[p[1:]] != which[p[:-1]])])
    i = np.flatnonzero(new)
    w = todo[which[p[i]]]
    return doc[w], tk[w], start[w] + offset[p[i]], np.diff(np.concatenate([i, [len(p)]]))


# --------------------------------------------------------------- the operator

@own_names("id_col", "text_col")
def dedup_substrings(df: DataFrame, length: int = LENGTH, mer: int = MER, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``df`` with ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and
    ``n_spans`` (maximal removed runs)."""
    buckets = parts_of(df.sparkSession)
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [f for f in df.schema.fields if f.name not in added]
    at_id = F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)).alias("_id")
    replies = written(replies_of(df.select(at_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")),
                                 length, mer, buckets), "suffix-replies")
    told = replies.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("id").alias("_told"))
    # both joins below read one exchange of the texts by document
    full = df.select(*[F.col(f"`{f.name}`") for f in names], at_id,
                     F.xxhash64(F.col(text_col).cast("string")).alias("_tk"))
    some = full.join(told, F.col("_id") == F.col("_doc"))
    cuts = (marks_of(some, text_col, length, mer, buckets).groupBy(F.col("doc").alias("_cdoc"))
            .agg(F.collect_list(F.struct("tk", "start", "n")).alias("_cuts")))
    full = (full.join(told, F.col("_id") == F.col("_doc"), "left")
            .join(cuts, F.col("_id") == F.col("_cdoc"), "left"))
    schema = StructType(names + [StructField("kept", BinaryType())]
                        + [StructField(c, LongType()) for c in added[1:]])

    def cut(b):
        data, offs = A.text_buffer(b[text_col].cast(pa.string()))
        raw, tk = data.tobytes(), b["_tk"].to_numpy()
        row, start, count, bucket, key, same = slices_of(data, offs, length, mer, buckets)
        whole = _told(b, bucket, key, same, row, WHOLE) if len(row) else np.zeros(0, bool)
        row, start, count = row[whole], start[whole], count[whole]
        lists = b["_cuts"]
        at, flat = lists.offsets.to_numpy(), lists.values
        own = np.repeat(np.arange(b.num_rows), np.diff(at))
        part = [flat.field(c).to_numpy()[at[0]:at[-1]] for c in ("tk", "start", "n")]
        mine = part[0] == tk[own]
        row = np.concatenate([row, own[mine]])
        start, count = np.concatenate([start, part[1][mine]]), np.concatenate([count, part[2][mine]])
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], (start + count + length - 1)[order]
        first = np.searchsorted(row, np.arange(b.num_rows + 1))
        kept, total, gone, spans = [], [], [], []
        for r in range(b.num_rows):
            text = raw[offs[r]:offs[r + 1]]
            total.append(len(text))
            s, e = start[first[r]:first[r + 1]], end[first[r]:first[r + 1]]
            if not len(s):
                kept.append(text)
                gone.append(0)
                spans.append(0)
                continue
            e = np.maximum.accumulate(e)
            i = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
            lo, hi = s[i], e[np.concatenate([i[1:] - 1, [len(s) - 1]])]
            edges = [0] + [int(x) for pair in zip(lo, hi) for x in pair] + [len(text)]
            kept.append(b"".join(text[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
            gone.append(int((hi - lo).sum()))
            spans.append(len(lo))
        yield pa.RecordBatch.from_arrays(
            [b.column(f.name) for f in names] + [pa.array(kept, pa.binary())]
            + [pa.array(x, pa.int64()) for x in (total, gone, spans)], schema.names)

    return A.map_arrow(full, cut, schema, text_col)
