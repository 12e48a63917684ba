"""N-gram Jaccard self-join on count-vector R-trees.

A document is the set of its distinct 5-word shingle hashes.  Two documents link
when ``100 * intersection >= 75 * union``.  The result is each document's set
size and the smallest doc_id reachable over links.

Points.  Shingles are hashed into groups, one to two for each of the set's
shingles; a document's point is its count in every group.  The overlap of two
sets is at most the sum over the groups of the smaller count, and, for two boxes
of points, of the smaller upper corner.  Points of different length are folded to
the shorter one.

1. Equal sets are one node (a 64-bit fingerprint of the set).
2. Routing.  Of any common order of shingles, a document leads with its first
   ``n - ceil(0.75 n) + 1 + s`` ones, s = n // 16.  Two linked sets share more
   than min(s) of these.  The order puts last what many documents lead with (a
   bit table of fixed size marks as much as it holds, the most frequent first),
   so a passage that a million documents quote routes hardly any of them.  A
   document that shares too few of its leading shingles is done; most are.
3. Pivots.  Every routed node is verified against the node it shares most routes
   with of those that lead them.  Links found make components, so a
   group of thousands of near copies costs one verification a member, not all
   its pairs.
4. R-trees.  Routes whose nodes lie in several components are indexed by packed
   R-trees over the points, cut by size bands (linked sizes differ by 4/3 at
   most) and, if still large, into salted block pairs.  Two trees are walked
   together; a pair of boxes is dropped when its bound is too low or when all
   its nodes are in one component already.  Surviving pairs are verified, a few
   of each pair of components first.  No pair that could still join two
   components is left out, so the components are exact.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``.  A document with 1 to 4 words has
its whole word sequence as its one shingle; one without words (null or empty
text) has an empty set, links with nothing and is its own component.  A null
doc_id counts as the smallest id.  Repeated rows are equal sets.  Extra columns
play no part.  An empty table gives an empty result.  Two shingles are taken for
one when their 64-bit hashes agree, two sets when their fingerprints agree
(2**-64 a pair).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import arrays as A
from murmura.llm.components import components
from murmura.llm.tables import own_names, parts_of, written

WORDS, PERCENT = 5, 75
LEAST_GROUPS, MOST_GROUPS = 128, 1 << 15
TABLE_BITS = 26
LEAF = 16
BLOCK = 2048                   # nodes of a route and size band indexed by one task step
FIRST = 8                      # pairs of two components verified before the others
U = np.uint64


def prefix_len(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def lead_len(n, percent: int = PERCENT):
    """Leading shingles of a set: two linked sets share ``shared(n)`` of them,
    n being the smaller size."""
    return prefix_len(n, percent) + n // 16


def shared(n):
    return 1 + n // 16


def links(na: int, nb: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (na + nb - both)


def least_overlap(na, nb, percent: int = PERCENT):
    """Smallest overlap with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def groups_of(n: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << n.bit_length()))


def point(s: np.ndarray) -> np.ndarray:
    g = groups_of(len(s))
    return np.bincount((s >> U(40)).astype(np.int64) % g, minlength=g).astype(np.uint32)


def pack_point(p: np.ndarray) -> bytes:
    """A point in the narrowest number type that holds its counts."""
    top = int(p.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return np.dtype(kind).itemsize.to_bytes(1, "little") + p.astype(kind).tobytes()


def unpack_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]], offset=1).astype(np.uint32)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    """A point with fewer (a power of two) groups."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.uint32)


KEY = 5                                                # bytes of a shingle that routing compares besides its bucket


def _code(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rest) of a shingle; a chance agreement only adds a candidate."""
    return (h % U(buckets)).astype(np.int32), (h // U(buckets)) & U(2 ** (8 * KEY) - 1)


def _place(bucket, key: np.ndarray) -> np.ndarray:
    return (A.mix(key * U(0x9E3779B97F4A7C15) ^ A.mix(bucket.astype(np.uint64) + U(1)))
            >> U(64 - TABLE_BITS)).astype(np.int64)


def bit_table(bits: DataFrame) -> np.ndarray:
    """Packed table of 2**TABLE_BITS bits from a column ``bit``.  Its size is
    fixed, whatever the data, so it may reach the driver and be broadcast."""
    per = 1 << 16                                              # bits in a collected row

    def merge(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        some = np.zeros(per, bool)
        some[t["bit"].to_numpy() - part * per] = True
        return pa.table({"part": pa.array([part], pa.int64()), "bits": pa.array([np.packbits(some).tobytes()], pa.binary())})

    cut = bits.select("bit", F.floor(F.col("bit") / per).cast("bigint").alias("part"))
    out = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for r in cut.groupBy("part").applyInArrow(merge, "part bigint, bits binary").collect():
        out[r["part"] * per // 8:(r["part"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_table(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _cols(df, id_col, text_col):
    return (df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)).alias("_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
            .withColumn("_tk", F.xxhash64("_text")))


def _sets(batch, words):
    ids = A.id_array(batch["_id"])
    data, offs = A.text_buffer(batch["_text"])
    for i, j in A.slabs(offs, 2 << 20):
        for r, s in enumerate(A.shingle_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], words)):
            yield int(ids[i + r]), s


def _split(order_key: np.ndarray):
    """Index groups of equal keys, in key order."""
    order = np.argsort(order_key, kind="stable")
    cut = np.flatnonzero(np.diff(order_key[order])) + 1
    return [g for g in np.split(order, cut) if len(g)]


# ------------------------------------------------------ 1 and 2: nodes, routes

def scan_nodes(d: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Per document (doc, tk, n, node), tk being a hash of its text; and, in other
    rows, packed counts of the shingles that lead documents in hash order:
    (bucket, keys, counts)."""
    names = ["doc", "tk", "n", "node", "bucket", "keys", "counts"]

    def run(b):
        doc, size, node, lead, seen = [], [], [], [], set()
        for i, s in _sets(b, words):
            f = A.set_fingerprint(s) if len(s) else None
            doc.append(i)
            size.append(len(s))
            node.append(f)
            if f is not None and f not in seen:
                seen.add(f)
                lead.append(s[:lead_len(len(s), percent)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), b["_tk"], pa.array(size, pa.int64()), pa.array(node, pa.int64()),
             pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary()), pa.nulls(len(doc), pa.binary())], names)
        if lead:
            h, c = np.unique(np.concatenate(lead), return_counts=True)
            c = np.minimum(c, 255).astype(np.uint8)
            bucket, key = _code(h, buckets)
            groups = _split(bucket)
            k = len(groups)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64())] * 4
                + [pa.array([int(bucket[g[0]]) for g in groups], pa.int32()),
                   pa.array([A.planes(key[g], KEY) for g in groups], pa.binary()),
                   pa.array([A.pack(c[g]) for g in groups], pa.binary())], names)
    return A.map_arrow(d, run, "doc bigint, tk bigint, n bigint, node bigint, bucket int, keys binary, counts binary", "_text")


def frequent_bits(scanned: DataFrame, buckets: int) -> DataFrame:
    """Table places of shingles that several nodes lead with, the most frequent
    first as far as the table holds them (an eighth of it)."""
    most = max(1, (1 << TABLE_BITS) // 8 // buckets)

    def frequent(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        key = np.concatenate([A.unplanes(x, KEY, np.uint64) for x in t["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in t["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        key, n = key[n > 1], n[n > 1]
        key = key[np.lexsort((key, -n))][:most]
        return pa.table({"bit": np.unique(_place(np.full(len(key), bucket, np.int32), key))})

    return scanned.where(F.col("bucket").isNotNull()).groupBy("bucket").applyInArrow(frequent, "bit bigint")


def routes(d: DataFrame, table, words: int, percent: int, buckets: int) -> DataFrame:
    """(h, node) for every leading shingle that at least two nodes lead with, of
    the nodes that share enough of them."""
    def send(b):
        bits = np.frombuffer(table.value, np.uint8)
        seen, keys, own, rare, nodes, sizes = set(), [], [], [], [], []
        for _, s in _sets(b, words):
            if not len(s):
                continue
            f = A.set_fingerprint(s)
            if f in seen:
                continue
            seen.add(f)
            bucket, key = _code(s, buckets)
            late = in_table(bits, _place(bucket, key))
            order = np.argsort(late, kind="stable")[:lead_len(len(s), percent)]
            keys.append(s[order])
            rare.append(~late[order])
            own.append(np.full(len(order), len(nodes), np.int64))
            nodes.append(f)
            sizes.append(len(s))
        if not nodes:
            return
        h, own, rare = np.concatenate(keys), np.concatenate(own), np.concatenate(rare)
        nodes = np.array(nodes, np.int64)
        bucket, key = _code(h, buckets)
        # what few lead with is gathered by bucket; the rest, which could load a
        # bucket, has company for certain and passes through evenly
        groups = [np.flatnonzero(rare)[g] for g in _split(bucket[rare])]
        often = np.flatnonzero(~rare)
        some = np.array_split(often, max(1, len(often) // 8192)) if len(often) else []
        even = np.random.default_rng(len(h)).integers(0, buckets, len(some)).tolist()
        full = _route(bucket, key)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[g[0]]) for g in groups] + even, pa.int32()),
             pa.array([False] * len(groups) + [True] * len(some)),
             pa.array([A.planes(key[g], KEY) for g in groups] + [A.planes(full[g], 8) for g in some], pa.binary()),
             pa.array([A.planes(nodes[own[g]], 8) for g in groups + some], pa.binary())],
            ["bucket", "often", "keys", "nodes"])

    def gather(t: pa.Table) -> pa.Table:
        often, bucket = t["often"].to_pylist(), t["bucket"][0].as_py()
        nodes = [A.unplanes(x, 8) for x in t["nodes"].to_pylist()]
        raw = t["keys"].to_pylist()
        out_h = [A.unplanes(x, 8) for x, o in zip(raw, often) if o]
        out_n = [x for x, o in zip(nodes, often) if o]
        ask = [i for i, o in enumerate(often) if not o]
        if ask:
            k, n = np.concatenate([A.unplanes(raw[i], KEY, np.uint64) for i in ask]), np.concatenate([nodes[i] for i in ask])
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            keep = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
            k, n = k[keep], n[keep]
            same = np.zeros(len(k), bool)
            same[1:] |= k[1:] == k[:-1]
            same[:-1] |= k[1:] == k[:-1]
            out_h.append(_route(np.full(int(same.sum()), bucket, np.int32), k[same]).view(np.int64))
            out_n.append(n[same])
        z = [np.empty(0, np.int64)]
        return pa.table({"h": np.concatenate(out_h or z), "node": np.concatenate(out_n or z)})

    packed = A.map_arrow(d, send, "bucket int, often boolean, keys binary, nodes binary", "_text")
    return packed.groupBy("bucket").applyInArrow(gather, "h bigint, node bigint").distinct()


def _route(bucket, key) -> np.ndarray:
    return A.mix(key * U(0x9E3779B97F4A7C15) ^ A.mix(bucket.astype(np.uint64) + U(1)))


# ------------------------------------------------------- 3: points, verifying

def node_sets(d: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(node, n, point, set) of the routed nodes, one row each.  A bit table of
    the documents wanted thins the texts out where they are read; the chance
    survivors, copies of a wanted text among them, go by an exact join on the
    document, and of rows that repeat it one stays."""
    place = F.pmod(F.xxhash64("_id", "_tk"), F.lit(1 << TABLE_BITS))
    wanted = reps.select(F.col("rep").alias("_id"), F.col("rep_tk").alias("_tk"))
    table = d.sparkSession.sparkContext.broadcast(bit_table(wanted.select(place.alias("bit"))).tobytes())

    def run(b):
        thin = in_table(np.frombuffer(table.value, np.uint8), b["_at"].to_numpy())
        b = b.filter(pa.array(thin))
        node, n, vec, blob, at, seen = [], [], [], [], [], set()
        own = b["_tk"].to_pylist()
        for k, (i, s) in enumerate(_sets(b, words) if b.num_rows else ()):
            if len(s) and (i, own[k]) not in seen:
                seen.add((i, own[k]))
                at.append((i, own[k]))
                node.append(A.set_fingerprint(s))
                n.append(len(s))
                vec.append(pack_point(point(s)))
                blob.append(A.pack(s))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(vec, pa.binary()),
                                          pa.array(blob, pa.binary())]
                                         + [pa.array([x[c] for x in at], pa.int64()) for c in (0, 1)],
                                         ["node", "n", "point", "set", "_id", "_tk"])
    some = A.map_arrow(d.withColumn("_at", place), run,
                       "node bigint, n bigint, point binary, set binary, _id bigint, _tk bigint", "_text")
    one = ["node", "_id", "_tk"]
    exact = some.join(reps.select("node", F.col("rep").alias("_id"), F.col("rep_tk").alias("_tk")), one, "left_semi")
    return exact.dropDuplicates(one).drop("_id", "_tk")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bounded by their points, then counted."""
    p = sets.select(F.col("node").alias("_n"), "n", "point")

    def bound(b):
        ok = []
        for na, nb, x, y in zip(*(b[c].to_pylist() for c in ("na", "nb", "pa", "pb"))):
            x, y = unpack_point(x), unpack_point(y)
            g = min(len(x), len(y))
            ok.append(int(np.minimum(fold(x, g), fold(y, g)).sum()) >= least_overlap(na, nb, percent))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok)], ["a", "b"])

    def count(b):
        ok = []
        for x, y in zip(b["sa"].to_pylist(), b["sb"].to_pylist()):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(links(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)), percent))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok)], ["a", "b"])

    with_points = (pairs.join(p.select(F.col("_n").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), "a")
                   .join(p.select(F.col("_n").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b"))
    near = written(A.map_arrow(with_points, bound, "a bigint, b bigint"), "join-near")
    full = (near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b"))
    return A.map_arrow(full, count, "a bigint, b bigint")


def enough(c, n):
    """Shared leading shingles that a link to a node of at least 0.75 n needs."""
    return c >= 1 + F.floor(F.ceil(F.lit(PERCENT / 100) * n) / 16)


def pivot_pairs(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every node the leader it shares most routes with.  A route is led by
    its node with the most company over all its routes: of a document and its
    edited copies that is the document, which links to most of them."""
    size = lists.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    known = lists.join(size, "h")
    company = known.groupBy("node").agg(F.sum("k").alias("company"))
    lead = (known.join(company, "node").groupBy("h")
            .agg(F.max(F.struct("company", "node")).alias("m")).select("h", F.col("m.node").alias("a")))
    met = (lists.join(lead, "h").where("node <> a")
           .groupBy("node", "a").agg(F.count("*").alias("c")))
    best = met.groupBy("node").agg(F.max(F.struct("c", "a")).alias("m"))
    best = best.join(nodes.select("node", "n"), "node").where(enough(F.col("m.c"), F.col("n")))
    return best.select(F.col("m.a").alias("a"), F.col("node").alias("b"))


# ----------------------------------------------------------------- 4: R-trees

class Tree:
    """Packed R-tree over count points: the points are sorted by size and their
    widest coordinates in tiles, and every LEAF neighbours share a box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        order = self._pack(points, sizes, np.arange(len(sizes)), 0)
        self.order = order
        self.levels = []                               # from the leaves up: (lo index, hi index, upper corner, least size, comp or None)
        lo = np.arange(0, len(order), LEAF)
        hi = np.minimum(lo + LEAF, len(order))
        p, s, c = points[order], sizes[order], comps[order]
        top = np.maximum.reduceat(p, lo, axis=0)
        small, cmin, cmax = np.minimum.reduceat(s, lo), np.minimum.reduceat(c, lo), np.maximum.reduceat(c, lo)
        self.levels.append((lo, hi, top, small, cmin, cmax))
        while len(lo) > 1:
            k = np.arange(0, len(lo), 8)
            e = np.minimum(k + 8, len(lo))
            top, small = np.maximum.reduceat(top, k, axis=0), np.minimum.reduceat(small, k)
            cmin, cmax = np.minimum.reduceat(cmin, k), np.maximum.reduceat(cmax, k)
            lo, hi = k, e
            self.levels.append((lo, hi, top, small, cmin, cmax))

    @staticmethod
    def _pack(points, sizes, idx, depth):
        if len(idx) <= LEAF:
            return idx
        if depth == 0:
            axis = sizes[idx].astype(np.int64)
        else:
            spread = points[idx].astype(np.float64).std(axis=0)
            axis = points[idx, int(np.argmax(spread))].astype(np.int64)
        idx = idx[np.argsort(axis, kind="stable")]
        half = max(LEAF, len(idx) // 2 // LEAF * LEAF)
        return np.concatenate([Tree._pack(points, sizes, idx[:half], depth + 1),
                               Tree._pack(points, sizes, idx[half:], depth + 1)])


def tree_pairs(points, sizes, comps, left: np.ndarray, right: np.ndarray | None, percent: int):
    """Index pairs (i in left, j in right; or both in left) whose bound allows a
    link and whose components differ, by walking two trees together."""
    a = Tree(points[left], sizes[left], comps[left])
    b = a if right is None else Tree(points[right], sizes[right], comps[right])
    gi, gj = left[a.order], (left if right is None else right)[b.order]
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        loa, hia, ta, sa, mina, maxa = (x[i] for x in a.levels[la])
        lob, hib, tb, sb, minb, maxb = (x[j] for x in b.levels[lb])
        if min(mina, minb) == max(maxa, maxb):         # one component already
            continue
        if int(np.minimum(ta, tb).sum(dtype=np.int64)) < least_overlap(int(sa), int(sb), percent):
            continue
        if la == 0 and lb == 0:
            x, y = gi[loa:hia], gj[lob:hib]
            over = np.minimum(points[x][:, None, :], points[y][None, :, :]).sum(2, dtype=np.int64)
            ok = over >= least_overlap(sizes[x][:, None], sizes[y][None, :], percent)
            ok &= comps[x][:, None] != comps[y][None, :]
            if right is None and i == j:
                ok = np.triu(ok, 1)
            r, c = np.nonzero(ok)
            if len(r):
                yield x[r], y[c], over[r, c]
            continue
        if la >= lb:
            for k in range(int(loa), int(hia)):
                if right is not None or la != lb:
                    stack.append((la - 1, k, lb, j))
                else:
                    for m in range(int(lob) if i != j else k, int(hib)):
                        stack.append((la - 1, k, lb - 1, m))
        else:
            for m in range(int(lob), int(hib)):
                stack.append((la, i, lb - 1, m))


def residual_pairs(lists: DataFrame, sizes: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b, ca, cb, over): bounded pairs of different components on a common
    route."""
    c = lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = (c.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k"),
                                F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sig")).where("x <> y"))
    # routes with the same nodes are one route of their number's weight
    same = mixed.groupBy("k", "sig").agg(F.min("h").alias("h"), F.count("*").alias("w"))
    c = written(c.join(same.select("h", "k", "w"), "h"), "join-mixed")
    # a node's partners elsewhere share routes of weight l or more with it, so
    # those that begin within the first c - l of its weight c, small routes
    # first, are enough to meet any
    least = F.lit(1) + F.floor(F.ceil(F.lit(percent / 100) * F.col("n")) / 16)
    have = (c.groupBy("node").agg(F.sum("w").alias("c")).join(sizes.select("node", "n"), "node")
            .where(F.col("c") >= least).withColumn("room", F.col("c") - least))
    before = Window.partitionBy("node").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, -1)
    c = (c.join(have.select("node", "room"), "node")
         .withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).where("before <= room"))
    c = written(c.select("h", "node", "comp"), "join-few")
    # routes with the same first node are one family: the nodes of a route are in
    # one family, and a node's point goes to a family once, not to every route
    family = c.groupBy("h").agg(F.min("node").alias("f"))
    c = c.join(family, "h").select(F.col("f").alias("h"), "node", "comp").distinct()
    mixed = (c.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k"))
             .where("x <> y").select("h", "k"))
    c = written(c.join(mixed, "h"), "join-families")
    # a family of a few nodes is a single leaf: its pairs are bounded once (verify)
    leaf = c.where(F.col("k") <= LEAF)
    one, two = (leaf.select("h", *[F.col(x).alias(y + x[0]) for x in ("node", "comp")]) for y in ("a", "b"))
    near = (one.join(two, "h").where("an < bn and ac <> bc").groupBy("an", "bn")
            .agg(F.first("ac").alias("x"), F.first("bc").alias("y"), F.count("*").alias("over"))
            .select(F.col("an").alias("a"), F.col("bn").alias("b"), F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"), "over"))
    c = c.where(F.col("k") > LEAF).drop("k")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = c.join(sets.select("node", "n"), "node").withColumn("band", band)
    # a node stands in its band, and as the larger side in the band below
    rows = rows.select("h", "node", "comp", "n", F.explode(F.array(
        F.struct(F.col("band").alias("band"), F.lit(False).alias("up")),
        F.struct((F.col("band") - 1).alias("band"), F.lit(True).alias("up")))).alias("r")).select(
        "h", "node", "comp", "n", "r.band", "r.up")
    size = rows.groupBy("h", "band").agg(F.count("*").alias("m"), F.count(F.when(~F.col("up"), 1)).alias("own"))
    size = size.where("own > 0 and m > 1").withColumn("s", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.join(size.select("h", "band", "s"), ["h", "band"])
    own = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    salted = rows.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    salted = (salted.withColumn("p", F.least("i", "j")).withColumn("q", F.greatest("i", "j"))
              .withColumn("bucket", F.pmod(F.xxhash64("h", "band", "p", "q"), F.lit(4 * buckets)).cast("int"))
              .select("bucket", F.xxhash64("h", "band", "p", "q").alias("key"), "p", "q", "i", "up", "node", "comp", "n")
              .join(sets.select("node", "point"), "node"))

    def join(t: pa.Table) -> pa.Table:
        key, node, comp, n = (t[x].to_numpy() for x in ("key", "node", "comp", "n"))
        up, i, p, q = (t[x].to_numpy(zero_copy_only=False) for x in ("up", "i", "p", "q"))
        raw = t["point"].to_pylist()
        out = [[], [], [], [], []]

        for g in _split(key):
            pts = [unpack_point(raw[x]) for x in g]
            small = min(map(len, pts))
            pts = np.stack([fold(x, small) for x in pts])
            gn, gc, gs = node[g], comp[g], n[g]
            at = np.arange(len(g))
            lo, hi = at[~up[g]], at[up[g]]
            if p[g[0]] == q[g[0]]:
                sides = [(lo, None), (lo, hi)]
            else:                                      # two different blocks: only pairs across them
                f = lambda x, s: x[i[g][x] == s]
                pp, qq = p[g[0]], q[g[0]]
                sides = [(f(lo, pp), f(lo, qq)), (f(lo, pp), f(hi, qq)), (f(lo, qq), f(hi, pp))]
            for x, y in sides:
                if len(x) and (y is None or len(y)):
                    for v, w, over in tree_pairs(pts, gs, gc, x, y, percent):
                        for c_, r in zip(out, (gn[v], gn[w], gc[v], gc[w], over)):
                            c_.append(r)
        z = [np.concatenate(v) if v else np.empty(0, np.int64) for v in out]
        swap = z[0] > z[1]
        a, b = np.where(swap, z[1], z[0]), np.where(swap, z[0], z[1])
        order = np.lexsort((b, a))                     # a pair of several families once
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        x, y, over = (v[order][new] for v in z[2:])
        return pa.table({"a": a[new], "b": b[new], "ca": np.minimum(x, y), "cb": np.maximum(x, y), "over": over.astype(np.int64)})

    return (salted.groupBy("bucket").applyInArrow(join, "a bigint, b bigint, ca bigint, cb bigint, over bigint")
            .unionByName(near).dropDuplicates(["a", "b"]))


def labelled(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc, tk, n, label, first) of every row: its component's label and
    smallest document."""
    spark = df.sparkSession
    buckets = parts_of(spark)
    d = _cols(df, id_col, text_col)
    scanned = written(scan_nodes(d, words, percent, buckets), "join-nodes")
    docs = scanned.where(F.col("doc").isNotNull()).select("doc", "tk", "n", "node")
    table = spark.sparkContext.broadcast(bit_table(frequent_bits(scanned, buckets)).tobytes())
    nodes = (docs.where(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min(F.struct("doc", "tk")).alias("r"), F.first("n").alias("n"))
             .select("node", "n", F.col("r.doc").alias("rep"), F.col("r.tk").alias("rep_tk")))
    every = written(routes(d, table, words, percent, buckets), "join-routes")
    routed = written(every.groupBy("node").agg(F.count("*").alias("c")).join(nodes, "node")
                     .where(enough(F.col("c"), F.col("n"))), "join-routed")
    lists = written(every.join(routed.select("node"), "node", "left_semi"), "join-lists")
    sets = written(node_sets(d, routed, words), "join-sets")

    edges = written(verify(pivot_pairs(lists, nodes), sets, percent), "join-pivots")
    comps = components(edges)
    rest = residual_pairs(lists, routed, comps, sets, percent, buckets)
    rank = F.row_number().over(Window.partitionBy("ca", "cb").orderBy(F.col("over").desc(), "a", "b"))
    ranked = written(rest.withColumn("rank", rank), "join-ranked")
    for few in (True, False):
        todo = ranked.where(F.col("rank") <= FIRST) if few else ranked.where(F.col("rank") > FIRST)
        side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_now"))
        todo = (todo.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
                .where(F.coalesce("a_now", "a") != F.coalesce("b_now", "b")).select("a", "b"))
        more = written(verify(todo, sets, percent), "join-links")
        if more.limit(1).count():
            edges = edges.unionByName(more)
            comps = components(edges)

    least = (nodes.join(comps, "node").groupBy("comp").agg(F.min("rep").alias("first")))
    named = comps.join(least, "comp").select("node", F.col("comp").alias("label"), "first")
    own = nodes.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"),
                                                   F.coalesce("first", "rep").alias("first"))
    return docs.join(own, "node", "left").select(
        "doc", "tk", "n", F.coalesce("label", F.xxhash64("doc", "tk")).alias("label"), F.coalesce("first", "doc").alias("first"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df``."""
    null = lambda c: F.when(F.col(c) != A.NULL_ID, F.col(c))
    return labelled(df, id_col, text_col, words, percent).select(
        null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null("first").alias("component_id"))


@own_names("id_col", "text_col")
def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
             percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component; of rows that
    repeat both id and text, one."""
    found = labelled(df, id_col, text_col, words, percent)
    stay = found.groupBy("label").agg(F.min(F.struct("doc", "tk")).alias("k")).select(
        F.col("k.doc").alias("_kd"), F.col("k.tk").alias("_kt"))
    names = [F.col(f"`{c}`") for c in df.columns]
    full = df.select(*names, F.coalesce(F.col(id_col).cast("bigint"), F.lit(A.NULL_ID)).alias("_id"),
                     F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_tk"))
    kept = full.join(stay, (F.col("_id") == F.col("_kd")) & (F.col("_tk") == F.col("_kt")), "left_semi")
    one = F.row_number().over(Window.partitionBy("_id", "_tk").orderBy(F.xxhash64(*names)))
    return kept.withColumn("_one", one).where("_one = 1").select(*names)
