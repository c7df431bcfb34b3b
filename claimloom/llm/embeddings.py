"""Embedding near-dedup by an epsilon grid order join, within equal labels.

Unit vectors are rotated onto their principal directions (a rotation keeps all distances,
so which rows it was fitted on changes cost, never results) and sorted by label and the
grid cells, of width epsilon, on the leading ones. The sorted sequence is cut into blocks;
a block knows the box its vectors fill in the leading directions. Blocks of one label whose
boxes lie within epsilon are joined: each side is halved again and again, pairs of halves
that are provably distant are skipped, and what is left is compared by cosine in double
precision. cosine >= t is the same as a distance of at most sqrt(2 - 2 t) of unit vectors.

Vectors are first scaled by a power of two, so that their largest component is between 1/2
and 1. Equal ones of one label are one class, compared once. A block pair gives link counts by
class and a spanning forest of its links, never the links themselves, so its output is in
proportion to its rows.

Vectors that are null, of no components, zero, or with null or non-finite components link
with nothing, nor do rows of a null label; vectors of different lengths don't link. Repeated
vec_ids are rows of their own that count as links but share a component; null vec_ids are
class members without an id: they count for others and are their own component null. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, hinted, pieces, table

COSINE = 0.93
#: Rows the rotation is fitted on.
FIT_ROWS = 4096
DIMS, BLOCK, LEAF = 8, 512, 128
SLACK = 1e-9


def rotation(vectors: DataFrame, fit_rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """By vector length, the principal directions of a sample of fit_rows rows at most."""
    rows = vectors.where("ok").orderBy(F.xxhash64("raw"), "raw").select("raw").limit(fit_rows).toArrow().column(0).to_pylist()
    out, by = {}, {}
    for r in rows:
        by.setdefault(len(r), []).append(np.frombuffer(r, "<f8"))
    for n, xs in by.items():
        x = np.stack(xs)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        _, vecs = np.linalg.eigh(x.T @ x)
        out[n // 8] = vecs[:, ::-1]
    return out


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> raw: the components as doubles; ok: whether it can link."""
    for b in pieces(batches):
        col = b.column(2)
        flat, lens = np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)), np.asarray(col.value_lengths().fill_null(0))
        ends = np.cumsum(lens)
        raw, ok = [], []
        for hi, n in zip(ends, lens, strict=True):
            x = flat[hi - n : hi] + 0.0  # a null component is nan here; -0 becomes 0
            good = bool(n and np.isfinite(x).all() and x.any())
            if good:  # by a power of two, which changes no cosine, so that no square over- or underflows
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
            raw.append(x.astype("<f8").tobytes() if good else b"")
            ok.append(good)
        ok = np.array(ok, bool) & np.asarray(b.column(1).is_valid())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(ok)], names=["vec_id", "label", "raw", "ok"])


def _cells(turn: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keys = []
            for r in b.column("raw").to_pylist():
                x = np.frombuffer(r, "<f8")
                x = x / np.sqrt(x @ x)
                axes = turn.get(len(x))
                p = (x @ axes if axes is not None else x)[:DIMS]
                keys.append(np.floor(p / eps).astype(int).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*b.schema.names, "cell"])

    return run


BLOCKS_SCHEMA = "label long, dims int, block long, part int, ids array<long>, counts array<long>, raw binary, lo array<double>, hi array<double>"


def _blocks(turn: dict[int, np.ndarray], size: int):
    """Sorted rows -> blocks of one label and length."""

    def emit(rows: list, part: int, k: int) -> pa.RecordBatch:
        label, n = rows[0][1], len(rows[0][3])
        x = np.stack([np.frombuffer(r[3], "<f8") for r in rows])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        axes = turn.get(n // 8)
        p = (u @ axes if axes is not None else u)[:, :DIMS]
        row = {"label": label, "dims": n // 8, "block": part << 32 | k, "part": part, "ids": [r[0] for r in rows], "counts": [r[2] for r in rows], "raw": x.astype("<f8").tobytes(), "lo": p.min(0).tolist(), "hi": p.max(0).tolist()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    ints, floats = pa.list_(pa.int64()), pa.list_(pa.float64())
    schema = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("ids", ints), ("counts", ints), ("raw", pa.binary()), ("lo", floats), ("hi", floats)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []
        for b in pieces(batches):
            for row in zip(*(b.column(c).to_pylist() for c in ("class", "label", "members", "raw")), strict=True):
                if held and (len(held) == size or row[1] != held[0][1] or len(row[3]) != len(held[0][3])):
                    yield emit(held, part, k)
                    k, held = k + 1, []
                held.append(row)
        if held:
            yield emit(held, part, k)

    return run


class Side:
    """A run of a block's vectors, halved on demand."""

    def __init__(self, u: np.ndarray, at: np.ndarray):
        self.u, self.at, self.parts = u, at, None
        self.lo, self.hi = u.min(0), u.max(0)

    def halves(self) -> list[Side]:
        if self.parts is None:
            axis = int(np.argmax(self.hi - self.lo))
            order, mid = np.argsort(self.u[:, axis], kind="stable"), len(self.at) // 2
            self.parts = [Side(self.u[o], self.at[o]) for o in (order[:mid], order[mid:])]
        return self.parts


def close(a: Side, b: Side, eps2: float) -> Iterator[tuple[Side, Side]]:
    """Pairs of runs that may hold close vectors; a run with itself once."""
    gap = np.maximum(0, np.maximum(a.lo - b.hi, b.lo - a.hi))
    if gap @ gap > eps2:
        return
    if max(len(a.at), len(b.at)) <= LEAF:
        yield a, b
    elif a is b:
        x, y = a.halves()
        yield from close(x, x, eps2)
        yield from close(x, y, eps2)
        yield from close(y, y, eps2)
    elif len(a.at) >= len(b.at):
        for x in a.halves():
            yield from close(x, b, eps2)
    else:
        for y in b.halves():
            yield from close(a, y, eps2)


def _links(a: tuple, b: tuple, same: bool, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) of vectors with cosine >= t; i < j if the blocks are one."""
    (x, u), (y, v) = a, b
    eps2 = 2 - 2 * t + 1e-6
    one = Side(u, np.arange(len(u)))
    two = one if same else Side(v, np.arange(len(v)))
    out_i, out_j = [], []
    for p, q in close(one, two, eps2):
        s = p.u @ q.u.T
        i, j = np.nonzero(s >= t - SLACK)
        i, j = p.at[i], q.at[j]
        if same:
            i, j = np.minimum(i, j), np.maximum(i, j)
            keep = i < j
            i, j = i[keep], j[keep]
        out_i.append(i)
        out_j.append(j)
    i, j = np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])
    if same and len(i):  # a run met with itself gives each pair twice
        i, j = np.unique(np.stack([i, j], 1), axis=0).T
    dot = np.einsum("ij,ij->i", x[i], y[j])
    norm = np.sqrt(np.einsum("ij,ij->i", x[i], x[i])) * np.sqrt(np.einsum("ij,ij->i", y[j], y[j]))
    keep = dot / norm >= t
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Numbers of the links that join two trees, taken in order."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[b] = a
            out.append(k)
    return out


def _join(t: float):
    def unit(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(raw, "<f8").reshape(-1, n)
        return x, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for r in batch.to_pylist():
                same = r["block"] == r["block2"]
                a = unit(r["raw"], r["dims"])
                b = a if same else unit(r["raw2"], r["dims"])
                i, j = _links(a, b, same, t)
                if not len(i):
                    continue
                ids, ids2 = np.array(r["ids"]), np.array(r["ids"] if same else r["ids2"])
                n, n2 = np.array(r["counts"]), np.array(r["counts"] if same else r["counts2"])
                one = np.bincount(i, n2[j], len(ids)).astype(np.int64)
                two = np.bincount(j, n[i], len(ids2)).astype(np.int64)
                if same:
                    one, two = one + two, two * 0
                keep, keep2 = np.flatnonzero(one), np.flatnonzero(two)
                tree = forest(ids[i], ids2[j])
                a_ = np.concatenate([ids[keep], ids2[keep2], ids[i[tree]]])
                b_ = np.concatenate([np.full(len(keep) + len(keep2), -1), ids2[j[tree]]])
                c_ = np.concatenate([one[keep], two[keep2], np.zeros(len(tree), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), pa.array(c_, pa.int64()), pa.array(np.arange(len(a_)) >= len(keep) + len(keep2))], names=["a", "b", "links", "is_edge"])

    return run


def near_dedup(vectors: DataFrame, cosine: float = COSINE, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(rows.mapInArrow(_unpack, "vec_id long, label long, raw binary, ok boolean"))
    turn = rotation(rows)
    # classes of equal vectors; their number stands for them until the end
    classes = rows.where("ok").groupBy("label", "raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("members"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    celled = classes.select("class", "label", "members", "raw").mapInArrow(_cells(turn, eps), "class long, label long, members long, raw binary, cell array<int>")
    key = ["label", F.octet_length("raw"), "cell", "class"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = cut(celled).repartitionByRange(parts, *[F.col(k) if isinstance(k, str) else k for k in key]).sortWithinPartitions(*key)
    blocks = cut(sorted_.mapInArrow(_blocks(turn, block), BLOCKS_SCHEMA))

    meta = blocks.select("label", "dims", "block", "lo", "hi")
    first = lambda c: F.floor(F.col(c)[0] / eps).cast("int")
    left = meta.withColumn("cell", F.explode(F.sequence(first("lo") - 1, first("hi") + 1)))
    right = meta.select("label", "dims", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(first("lo"), first("hi"))).alias("cell"))
    gap = F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = left.join(right, ["label", "dims", "cell"]).where("block <= block2").where(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= 2 - 2 * cosine + 1e-6)
    near = near.select("block", "block2").distinct()
    other = blocks.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"), F.col("raw").alias("raw2"))
    one = blocks.select("block", "dims", "ids", "counts", "raw")
    found = cut(near.join(one, "block").join(other, "block2").mapInArrow(_join(cosine), "a long, b long, links long, is_edge boolean"))

    linked = found.where("not is_edge").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.select("class", "first", "members")
    comps = components(found.where("is_edge").select("a", "b")).select(F.col("node").alias("class"), "component")
    joined = cut(named.join(linked, "class", "left").join(comps, "class", "left").withColumn("component", F.coalesce("component", "class")))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = joined.join(least, "component").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    by_vector = classes.join(of_class, "class").select("label", "raw", "component_id", "n_links")
    out = rows.where("ok").join(by_vector, ["label", "raw"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(r, o) AS (SELECT r, r FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.o = link.a),
comp AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.o = v.r GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, coalesce(v.vec_id = comp.component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""
