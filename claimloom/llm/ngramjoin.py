"""N-gram Jaccard join by adaptive multi-match prefixes, and the groups it makes.

Documents are sets of 64-bit hashes of `n`-word shingles; equal sets are one class, joined
once, and a class with many copies is made from its row of the lowest doc_id alone. Two sets link when 100 * intersection >= percent * union, exactly.

Order. Shingles are counted over all documents (packed and pre-summed per batch, so a
common shingle weighs no more than a rare one); the FREQUENT most common ones, a fixed
number, are broadcast with their counts. Every set is ordered by that count (0 if not among
them), then by hash: rare first.

Prefixes. Linked sets of sizes a and b share at least l of the first p + l - 1 shingles of
each, p = size - ceil(size * percent / 100) + 1, for every l. A document whose prefix is
costlier (longer, or with common shingles) gets a larger l: its prefix is lengthened by
l - 1, and a pair must share the smaller l of the two before it is verified. A shingle's
level is the least l whose prefix holds it; a match counts for a pair if both levels are
within the pair's l. Postings of prefixes meet by shingle; those of one class only end there.

Pairs. A shingle of up to SMALL classes gives all their pairs of fitting sizes. Of more
common ones, those of a class that can't reach the least l of any partner go: texts around a
shared passage share fewer than l, for every l, if a fifth of each is its own. Then come
three turns, the links of each merged before the next: every class with the likeliest of the
classes drawn by hash from its shingles; every class with the likeliest of all it shares a
shingle with; all pairs, counted. Each takes only pairs of different components whose parity
signatures allow a link. So a group of thousands of near copies costs a few comparisons for
each member, and no link between components is missed.

Signatures. 2**k slots, at least 4 a shingle, each odd or even by the number of shingles
hashed to it. Sets that differ in d shingles differ in d slots at most, so no link is lost.

Verification intersects the whole sets of both classes, made anew from the texts.

A document's n_shingles is its set's size; component_id is the smallest doc_id reachable by
links, itself included. Null, empty and blank texts have no shingles and link with nothing,
not even each other; texts of fewer than n words are one shingle. Rows that repeat a doc_id
are documents of their own that share ids. Null doc_ids count for links but don't name a
component unless all of it is null. Extra columns are ignored. Empty tables give no rows.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bitmap, components, cut, hinted, mix, pieces, release, shingle_set, skew_join, table, within

N, PERCENT = 5, 80
#: Most common shingles that are broadcast with their counts; 12 bytes each.
FREQUENT = 1 << 18
SMALL = 8
#: Shingles of up to GATHER classes are met in tasks of some PER_GATHER postings; others by join.
GATHER, PER_GATHER = 1 << 16, 1 << 12
#: Classes with more rows than this share, and this number, are made from one row only.
HEAVY, HEAVY_LEAST = 1e-4, 200
#: Shingles counted this often go to tasks by class, not all to one.
HOT = 1 << 13
#: Slots of a parity signature, as powers of two: the least and the most.
PARITY = 9, 16
#: Bits, as a power of two, of the sieve that spares most texts the way to verification.
BITMAP = 24
#: Classes, or pairs, up to which a table is broadcast; beyond, it is joined by shuffle.
SMALL_ROWS = 50_000
#: Hashes that one task handles at a time.
PER_BUCKET = 1 << 18
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _sets(col: pa.Array, n: int) -> list[np.ndarray]:
    w = Words(col)
    return [shingle_set(w.hash[lo:hi], n) for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True)]


def digest(s: np.ndarray) -> int | None:
    """A set's class, as a signed long; none for the empty set."""
    if not len(s):
        return None
    both = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))), np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D))), len(s)], np.uint64)
    return int(mix(np.bitwise_xor.reduce(mix(both * _TURN), keepdims=True)).view(np.int64)[0])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def classes_of(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, size, cid) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = _sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64())], names=["doc_id", "size", "cid"])

    return _texts(docs).mapInArrow(run, "doc_id long, size long, cid long")


def _once(b: pa.RecordBatch, n: int, heavy: dict[int, int | None]) -> list[tuple[int, np.ndarray]]:
    """The classes of a batch (doc_id, text), each once; heavy ones only where their least doc_id is."""
    out = {}
    for doc, s in zip(b.column(0).to_pylist(), _sets(b.column(1), n), strict=True):
        d = digest(s)
        if d is not None and heavy.get(d, doc) == doc:
            out[d] = s
    return list(out.items())


def heavy_classes(rows: DataFrame, count: int) -> dict[int, int | None]:
    """The least doc_id of each class of more than HEAVY of all rows; 1 / HEAVY classes at most."""
    sizes = rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    many = sizes.where(F.col("n") > max(HEAVY_LEAST, int(count * HEAVY))).select("cid", "doc_id").toArrow()
    return dict(zip(many.column(0).to_pylist(), many.column(1).to_pylist(), strict=True))


def _five(x: np.ndarray) -> bytes:
    """40-bit numbers as 5 bytes each."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def frequent(docs: DataFrame, total: int, n: int, heavy: dict[int, int | None], most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(first 48 bits of the hash, sorted; count) of the most common shingles, `most` at most."""
    bits = min(24, max(8, int(np.ceil(np.log2(max(1, total) / PER_BUCKET)))))
    rest = np.uint64(48 - bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [s for _, s in _once(b, n, heavy)]
            if not sets:
                continue
            keys, counts = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
            buckets = (keys >> rest).astype(np.int64)
            keys &= np.uint64((1 << int(rest)) - 1)
            at = np.flatnonzero(np.diff(buckets, prepend=-1))
            ends = np.append(at[1:], len(keys))
            one, many, more = [], [], []
            for lo, hi in zip(at, ends, strict=True):
                k, c = keys[lo:hi], counts[lo:hi]
                one.append(_five(k[c == 1]))
                many.append(_five(k[c > 1]))
                more.append(c[c > 1].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets[at].astype(np.int32)), pa.array(one, pa.binary()), pa.array(many, pa.binary()), pa.array(more, pa.binary())], names=["bucket", "one", "many", "more"])

    def add(bucket_rows: pa.Table) -> pa.Table:
        c = {k: b"".join(bucket_rows.column(k).to_pylist()) for k in ("one", "many", "more")}
        ones, many = _unfive(c["one"]), _unfive(c["many"])
        keys = np.concatenate([ones, many])
        weight = np.concatenate([np.ones(len(ones), np.int64), np.frombuffer(c["more"], "<u4").astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
        at = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight, at) if len(at) else weight
        keep = sums >= 4
        bucket = np.uint64(bucket_rows.column("bucket")[0].as_py())
        return pa.table({"key": pa.array(((bucket << rest) | keys[at][keep]).view(np.int64)), "df": pa.array(sums[keep])})

    packed = _texts(docs).mapInArrow(pack, "bucket int, one binary, many binary, more binary")
    counted = cut(packed.groupBy("bucket").applyInArrow(add, "key long, df long"))
    step = F.floor(F.log2("df") * 8)
    floor_, held = None, 0
    for s, c in sorted(counted.groupBy(step.alias("s")).count().collect(), reverse=True):  # a few hundred steps
        if held + c > most:
            break
        floor_, held = s, held + c
    got = counted.where(step >= (floor_ if floor_ is not None else 1 << 20)).toArrow()
    keys, df = got.column("key").to_numpy().astype(np.uint64), got.column("df").to_numpy()
    order = np.argsort(keys)
    return keys[order], df[order]


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(the lengthened prefix of a set, the matches it asks for, how common its shingles are)."""
    keys, df = common
    n = len(s)
    p = n - (n * percent + 99) // 100 + 1
    cost = np.zeros(n, np.int64)
    if len(keys):
        k = s >> np.uint64(16)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        cost = np.where(keys[at] == k, df[at], 0)
    order = np.lexsort((s, cost))
    spent = int(cost[order[:p]].sum())
    need = 1 + p // 4 + (p // 4 if spent else 0)
    need = min(need, n - p + 1)
    own = order[: p + need - 1]
    return s[own], need, cost[own]


def levels(m: int, need: int) -> np.ndarray:
    """Of each shingle of a prefix of m: the least number of matches that lengthens a prefix to it."""
    return np.maximum(1, np.arange(m) - (m - need) + 1)


POSTINGS = "kind int, token long, a long, b long, size int, need int, count int"


def postings(docs: DataFrame, total: int, common, n: int, percent: int, heavy: dict[int, int | None]) -> DataFrame:
    """What prefixes have in common, by bucket of hashes.

    The postings of a HOT shingle are dealt out by class, in buckets of their own, so no task
    has to hold them all; they are all of kind 1.

    kind 0: a pair (a, b) that shares `count` shingles here, each of SMALL classes at most,
    and needs `need` in all; kind 1: class a, with its size and need, holds a shingle of more
    classes, `token`, of level `count`.
    """
    buckets = 1 << min(24, max(5, int(np.ceil(np.log2(max(1, total * 0.35) / PER_BUCKET)))))
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [(d, len(s), *prefix(s, sent.value, percent)) for d, s in _once(b, n, heavy)]
            if not made:
                continue
            token = np.concatenate([m[2] for m in made])
            own = np.repeat(np.arange(len(made)), [len(m[2]) for m in made])
            level = np.concatenate([levels(len(m[2]), m[3]) for m in made])
            # the low bits decide: the high ones are what prefixes are sorted by
            bucket = (token & np.uint64(buckets - 1)).astype(np.int64)
            hot = np.concatenate([m[4] for m in made]) >= HOT
            ids = np.array([m[0] for m in made], np.int64).view(np.uint64)[own]
            bucket[hot] = buckets + (mix(token[hot] ^ mix(ids[hot])) & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, own, bucket, level = token[order], own[order], bucket[order], level[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            cids, sizes, needs = (np.array([m[i] for m in made]) for i in (0, 1, 3))
            rows = []
            for lo, hi in zip(at, np.append(at[1:], len(token)), strict=True):
                who, idx = np.unique(own[lo:hi], return_inverse=True)
                rows.append((token[lo:hi].astype("<u8").tobytes(), np.stack([idx, np.minimum(level[lo:hi], 65535)]).astype("<u2").tobytes(), cids[who].astype("<i8").tobytes(), np.stack([sizes[who], needs[who]]).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(4))], names=["bucket", "tokens", "own", "cids", "facts"])

    def meet(part: pa.Table) -> pa.Table:
        token, cid, size, need, level = [], [], [], [], []
        for t, o, c, f in zip(*(part.column(k).to_pylist() for k in ("tokens", "own", "cids", "facts")), strict=True):
            (o, lv), c, f = np.frombuffer(o, "<u2").reshape(2, -1), np.frombuffer(c, "<i8"), np.frombuffer(f, "<u4").reshape(2, -1)
            token.append(np.frombuffer(t, "<u8"))
            cid.append(c[o])
            size.append(f[0][o])
            need.append(f[1][o])
            level.append(lv)
        token, cid, size, need, level = (np.concatenate(x) for x in (token, cid, size, need, level))
        order = np.lexsort((cid, token))
        token, cid, size, need, level = token[order], cid[order], size[order].astype(np.int64), need[order].astype(np.int64), level[order].astype(np.int64)
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])  # copies of a class in other batches
        token, cid, size, need, level = token[first], cid[first], size[first], need[first], level[first]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        m = np.diff(np.append(at, len(token)))
        if part.column("bucket")[0].as_py() >= buckets:
            m[:] = SMALL + 1
        out = []
        for k in range(2, SMALL + 1):
            begins = at[m == k]
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = begins + i, begins + j
                    fit = np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent
                    x, y = x[fit], y[fit]
                    out.append(np.stack([cid[x], cid[y], np.minimum(need[x], need[y])]))
        pairs = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        order = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, order]
        starts = np.flatnonzero(np.concatenate([[True], (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])])) if pairs.shape[1] else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, pairs.shape[1]))
        pairs = pairs[:, starts]
        big = np.repeat(m > SMALL, np.diff(np.append(at, len(token))))
        z = np.zeros(len(starts), np.int64)
        cols = {
            "kind": np.concatenate([z, z[:0], np.ones(int(big.sum()), np.int64)]).astype(np.int32),
            "token": np.concatenate([z, token[big].view(np.int64)]),
            "a": np.concatenate([pairs[0], cid[big]]),
            "b": np.concatenate([pairs[1], np.zeros(int(big.sum()), np.int64)]),
            "size": np.concatenate([z, size[big]]).astype(np.int32),
            "need": np.concatenate([pairs[2], need[big]]).astype(np.int32),
            "count": np.concatenate([counts, level[big]]).astype(np.int32),
        }
        return pa.table({k: pa.array(v) for k, v in cols.items()})

    packed = _texts(docs).mapInArrow(pack, "bucket int, tokens binary, own binary, cids binary, facts binary")
    return packed.groupBy("bucket").applyInArrow(meet, POSTINGS)


def set_table(docs: DataFrame, wanted: DataFrame, n: int, heavy: dict[int, int | None]) -> DataFrame:
    """(cid, items) for wanted (cid): the sets, as packed sorted hashes, made from the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("cid"), BITMAP))  # digests are hashes already

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                made = dict(_once(part, n, heavy))
                cids = np.array(list(made), np.int64)
                if len(cids):
                    keep = cids[within(sent.value, cids)]
                    yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array([made[c].astype("<u8").tobytes() for c in keep.tolist()], pa.binary())], names=["cid", "items"])

    found = _texts(docs).mapInArrow(run, "cid long, items binary")
    return found.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first("items").alias("items"))


def parity(s: np.ndarray) -> bytes:
    """A set's parity signature."""
    slots = 1 << min(PARITY[1], max(PARITY[0], (4 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def signatures(sets: DataFrame) -> DataFrame:
    """(cid, size, sig) of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [np.frombuffer(x.as_py(), "<u8") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in made], pa.int32()), pa.array([parity(s) for s in made], pa.binary())], names=["cid", "size", "sig"])

    return sets.mapInArrow(run, "cid long, size int, sig binary")


class Parities:
    """Signatures of some classes, each as it is and folded to half its length."""

    def __init__(self, size: np.ndarray, sigs: list[bytes]):
        self.size, self.bytes = size.astype(np.int64), np.array([len(x) for x in sigs], np.int64)
        self.of = {}
        for n in np.unique(self.bytes).tolist():
            own, twice = np.flatnonzero(self.bytes == n), np.flatnonzero(self.bytes == 2 * n)
            whole = np.frombuffer(b"".join(sigs[i] for i in own), "<u8").reshape(-1, n // 8)
            halves = np.frombuffer(b"".join(sigs[i] for i in twice), "<u8").reshape(-1, n // 4)
            row = np.zeros(len(sigs), np.int64)
            row[own], row[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.of[n] = np.concatenate([whole, halves[:, : n // 8] ^ halves[:, n // 8 :]]), row

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least number of shingles in which classes x and y can differ; 0 where lengths are too unlike."""
        out = np.zeros(len(x), np.int64)
        short, long = np.minimum(self.bytes[x], self.bytes[y]), np.maximum(self.bytes[x], self.bytes[y])
        for n, (rows, row) in self.of.items():
            sel = np.flatnonzero((short == n) & (long <= 2 * n))
            step = max(1, (1 << 23) // n)
            for at in (sel[i : i + step] for i in range(0, len(sel), step)):
                out[at] = np.bitwise_count(rows[row[x[at]]] ^ rows[row[y[at]]]).sum(axis=1, dtype=np.int64)
        return out

    def share(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Twice the most that they can share, of the sum of their sizes."""
        both = self.size[x] + self.size[y]
        return (both - self.differ(x, y)) / both

    def near(self, share: np.ndarray, percent: int) -> np.ndarray:
        return share * (100 + percent) >= 2 * percent - 1e-6


def sieved(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(a, b, share) of the pairs (a, b) that signatures let link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n = b.num_rows
            all_ = Parities(np.concatenate([b.column(2).to_numpy(), b.column(4).to_numpy()]), b.column(3).to_pylist() + b.column(5).to_pylist())
            share = all_.share(np.arange(n), n + np.arange(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share)], names=["a", "b", "share"]).filter(pa.array(all_.near(share, percent)))

    one, two = sigs.toDF("a", "a_size", "a_sig"), sigs.toDF("b", "b_size", "b_sig")
    wide = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "a_size", "a_sig", "b_size", "b_sig")
    return wide.mapInArrow(run, "a long, b long, share double")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("cid").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of classes that keep every component whole. rows: classes_of(docs), cut."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy = heavy_classes(rows, count)
    common = frequent(docs, total, n, heavy)
    release(docs.sparkSession)
    met = cut(postings(docs, total, common, n, percent, heavy))
    release(docs.sparkSession)
    big = met.where("kind = 1").select("token", F.col("a").alias("cid"), "size", "need", F.col("count").alias("level"))
    counted = met.where("kind = 0").groupBy("a", "b").agg(F.sum("count").cast("long").alias("n"), F.min("need").alias("need"))
    small = cut(counted.where("n >= need").select("a", "b"))

    # a class whose matches can't reach what any partner needs is out: what it holds within a
    # prefix grows by 1 with each match more at most, so the least need decides
    least = F.ceil(F.col("size") * percent / 100)
    floor_ = F.least(1 + F.floor(F.floor(least * (100 - percent) / 100) / 4), F.greatest(F.ceil(least * percent / 100), F.lit(1)))
    held = big.groupBy("cid").agg(F.count("*").alias("held"), F.count(F.when(F.col("level") <= floor_, 1)).alias("held_first"))
    beside = counted.select(F.col("a").alias("cid"), "n").unionByName(counted.select(F.col("b").alias("cid"), "n")).groupBy("cid").agg(F.max("n").alias("beside"))
    big = big.join(held, "cid").join(beside, "cid", "left").withColumn("beside", F.coalesce("beside", F.lit(0)))
    big = cut(big.where(F.col("held_first") + F.col("beside") >= floor_).withColumn("most_shared", F.col("held") + F.col("beside")).select("token", "cid", "size", "need", "level", "most_shared"))

    posted = big.count()
    used = small.select(F.col("a").alias("cid")).union(small.select("b")).union(big.select("cid")).distinct()
    sets = cut(set_table(docs, cut(used), n, heavy))
    sigs = cut(signatures(sets))
    edges = cut(verified(small, sets, percent))
    release(docs.sparkSession)
    fit = F.least("size", "hs") * 100 >= F.greatest("size", "hs") * percent
    in_need = F.greatest("level", "hl") <= F.least("need", "hn")
    ends = [F.least("cid", "h").alias("a"), F.greatest("cid", "h").alias("b")]
    for turn in ("drawn", "likeliest", "all"):
        release(docs.sparkSession)
        groups = components(edges).select(F.col("node").alias("cid"), "component")
        now = big.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        per = now.groupBy("token", "component").agg(F.count("*").alias("c"))
        per = per.groupBy("token").agg(F.count("*").alias("groups"), F.sum("c").alias("m"), F.max_by("component", "c").alias("most"), F.max("c").alias("c"))
        open_ = cut(per.where("groups > 1").select("token", "m", "most", "c"))
        if not open_.take(1):
            break
        now = cut(skew_join(now, open_, "token", "m", posted, "cid"))
        release(docs.sparkSession)
        side = [F.col("cid").alias("h"), F.col("size").alias("hs"), F.col("need").alias("hn"), F.col("level").alias("hl"), F.col("component").alias("hc")]
        if turn == "drawn":  # one class of each shingle
            drawn = cut(now.groupBy("token").agg(F.min_by(F.struct(*side), F.xxhash64("token", "cid")).alias("x"), F.count("*").alias("hm")).select("token", "hm", "x.*"))
            pairs = skew_join(now, drawn, "token", "hm", posted, "cid").where("component <> hc").where(fit & in_need).select(F.col("cid").alias("a"), F.col("h").alias("b")).distinct()
            best = sieved(pairs, sigs, percent).groupBy("a").agg(F.max_by("b", "share").alias("b"))
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            edges = cut(edges.unionByName(verified(pairs, sets, percent)))
            continue
        # shingles of one component have no pairs left
        tasks = max(4, now.where(F.col("m") <= GATHER).count() // PER_GATHER)
        gathered = now.where(F.col("m") <= GATHER).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(tasks)).cast("int"))
        gathered = gathered.select("part", "token", "cid", "size", "need", "level", "component", "most_shared")
        beside_ = gathered.select("part", "cid").distinct().join(sigs.select("cid", "sig"), "cid").select("part", "cid", "sig").toDF("p", "c", "sig")
        some = gathered.groupBy("part").cogroup(beside_.groupBy("p")).applyInArrow(_across(percent, turn == "likeliest"), "a long, b long, n long, need int")
        if turn == "likeliest":
            edges = cut(edges.unionByName(verified(some.select("a", "b").distinct(), sets, percent)))
            continue
        rare = now.where(F.col("m") > GATHER)
        few = rare.where("component <> most").select("token", *side)
        wide = rare.join(few, "token").where("component <> hc").where(fit & in_need).where("component = most or cid < h").select(*ends, F.lit(1).cast("long").alias("n"), F.least("need", "hn").cast("int").alias("need"))
        shared = some.unionByName(wide).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        before = counted.select("a", "b", F.col("n").alias("n_small"))
        pairs = shared.join(before, ["a", "b"], "left").where("n + coalesce(n_small, 0) >= need and coalesce(n_small, 0) < need").select("a", "b")
        edges = cut(edges.unionByName(verified(sieved(pairs, sigs, percent), sets, percent)))
    return edges


def _across(percent: int, likeliest: bool):
    """Postings of some shingles, and signatures -> pairs of classes of different components
    that signatures let link, with their counts; likeliest: for each class one at most."""

    def run(part: pa.Table, beside: pa.Table) -> pa.Table:
        part = part.sort_by("token")
        token, cid, size, comp = (part.column(c).to_numpy() for c in ("token", "cid", "size", "component"))
        ids, at, who = np.unique(cid, return_index=True, return_inverse=True)
        need, level, most = (part.column(c).to_numpy().astype(np.int64) for c in ("need", "level", "most_shared"))
        sig = dict(zip(beside.column("c").to_pylist(), beside.column("sig").to_pylist(), strict=True))
        parities = Parities(size[at], [sig[c] for c in ids.tolist()])
        edges = np.flatnonzero(np.diff(token, prepend=token[0] - 1, append=token[-1] + 1))
        held, waiting = np.zeros((2, 0), np.int64), []

        def add(keys: np.ndarray, last: bool = False) -> None:
            nonlocal held, waiting
            waiting.append(keys)
            if last or sum(map(len, waiting)) > 1 << 19:
                held, waiting = _sum(held, waiting, parities, percent), []

        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            kinds, idx, counts = np.unique(comp[lo:hi], return_inverse=True, return_counts=True)
            main = int(np.argmax(counts))
            s = size[lo:hi].astype(np.int64)
            for i in np.flatnonzero(idx != main):
                j = np.flatnonzero((idx != idx[i]) & ((idx == main) | (np.arange(hi - lo) < i)) & (np.minimum(s, s[i]) * 100 >= np.maximum(s, s[i]) * percent))
                least = np.minimum(need[lo + j], need[lo + i])
                j = j[(np.minimum(most[lo + j], most[lo + i]) >= least) & (np.maximum(level[lo + j], level[lo + i]) <= least)]
                x, y = who[lo + i], who[lo + j]
                add(np.minimum(x, y).astype(np.int64) << 32 | np.maximum(x, y))
        add(np.zeros(0, np.int64), last=True)
        a, b = held[0] >> 32, held[0] & 0xFFFFFFFF
        if likeliest:  # for the class of the smaller component
            _, kind = np.unique(comp[at], return_inverse=True)
            weight = np.bincount(kind)[kind]
            mine = np.where(weight[a] <= weight[b], a, b)
            order = np.lexsort((-parities.share(a, b), mine))
            order = order[np.diff(mine[order], prepend=-1) != 0]
            a, b, held = a[order], b[order], held[:, order]
        needs = np.zeros(len(ids), np.int64)
        needs[who] = need
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b]), "n": pa.array(held[1]), "need": pa.array(np.minimum(needs[a], needs[b]).astype(np.int32))})

    return run


def _sum(held: np.ndarray, keys: list[np.ndarray], parities: Parities, percent: int) -> np.ndarray:
    """Distinct keys that signatures let link and their counts, those held so far with them."""
    new, n = np.unique(np.concatenate(keys), return_counts=True)
    near = parities.near(parities.share(new >> 32, new & 0xFFFFFFFF), percent)
    weight = np.concatenate([held[1], n[near]])
    out, at = np.unique(np.concatenate([held[0], new[near]]), return_inverse=True)
    return np.stack([out, np.bincount(at, weight, len(out)).astype(np.int64)])


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: doc_id, size, cid, component (its smallest cid), component_id."""
    rows = cut(classes_of(docs, n))
    edges = links(docs, rows, n, percent)
    names = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    groups = components(edges).select(F.col("node").alias("cid"), "component")
    named = cut(names.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named.join(least, "component").select("cid", "component", "component_id"), "cid", "left")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    out = _grouped(docs, n, percent)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _cids(texts: pa.Array, n: int) -> pa.Array:
    """The class of each text, made in pieces: Spark's batches are of 10,000 texts of any length."""
    cut_up = pieces([pa.RecordBatch.from_arrays([texts], names=["text"])])
    return pa.array([digest(s) for b in cut_up for s in _sets(b.column(0), n)], pa.int64())


def _class(docs: DataFrame, n: int) -> DataFrame:
    """docs with `__cid`, the class of each row's text."""

    @F.arrow_udf("long")
    def cid(texts: pa.Array) -> pa.Array:
        return _cids(texts, n)

    return docs.withColumn("__cid", cid(F.col("text").cast("string")))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Of each group of near duplicates the document of the lowest doc_id, columns as they are.

    Rows go by doc_id and class, so a row that links with nothing stays whatever its doc_id is.
    Rows of a group that repeat the doc_id that stays, stay; of a group whose doc_ids are all
    null one row stays, the least by a hash of its columns. Documents without words all stay.
    """
    rows = cut(_grouped(docs, n, percent).where("cid is not null"))
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("cid").alias("__gone")).distinct()
    idless = rows.where("component_id is null").select(F.col("cid").alias("__idless"), F.col("component").alias("__component")).distinct()
    gone, idless = hinted(cut(gone), 10 * SMALL_ROWS), hinted(cut(idless), 10 * SMALL_ROWS)
    own, id_ = _class(docs, n), F.col("doc_id").cast("long")
    stay = own.join(gone, (F.col("__cid") == F.col("__gone")) & id_.eqNullSafe(F.col("__id")), "left_anti")
    stay = stay.join(idless, F.col("__cid") == F.col("__idless"), "left_anti").select(*docs.columns)
    row = F.struct(*docs.columns)
    one = own.join(idless, F.col("__cid") == F.col("__idless")).groupBy("__component").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
    return stay.unionByName(one.select("row.*"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
