"""What the training-data operators share: durable cuts, batch tokenising, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cuts import cut

#: Words of the shingle operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a Python worker handles at a time; a longer text is handled alone.
PIECE_ROWS, PIECE_BYTES = 1000, 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of `rows` rows and, but for single rows, `size` bytes at most.

    Spark bounds batches itself (spark.sql.execution.arrow.maxBytesPerBatch), but what is made
    of a text is many times its size.
    """
    for batch in batches:
        waiting = [batch]
        while waiting:
            b = waiting.pop()
            if b.num_rows > rows or (b.num_rows > 1 and b.nbytes > size):
                half = b.num_rows // 2
                waiting += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b


def free(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no column of the frames has it in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which is seldom: jobs of many steps
    would hold the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hinted(df: DataFrame, max_rows: int) -> DataFrame:
    """df (already cut) with a broadcast hint if it has max_rows rows at most, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# ---------------------------------------------------------------- batch tokenising

_MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_BYTE = np.array([_splitmix(i + 1) for i in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_SPACE = np.ones(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
#: Bytes hashed at a time; bounds what a long text needs besides itself.
_STEP = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets; nulls have no bytes."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def _segment(b: np.ndarray, isw: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a stretch; fresh: positions at which a text begins."""
    before = np.empty_like(isw)
    before[:1], before[1:] = False, isw[:-1]
    before[fresh] = False
    starts = np.flatnonzero(isw & ~before)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    after = np.empty_like(isw)
    after[-1:], after[:-1] = False, isw[1:]
    inner = fresh[fresh > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(isw & ~after) + 1
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))])
    place[~isw] = 0
    powers = np.full(int((ends - starts).max()), np.uint64(_BASE), dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    v = _BYTE[b] * powers[place]
    v[~isw] = 0
    return starts, ends, mix(np.add.reduceat(v, starts) ^ (ends - starts).astype(np.uint64))


class Words:
    """The words of a column of texts: hash, text number, and byte span within the joined texts."""

    def __init__(self, col: pa.Array, alnum: bool = False):
        self.bytes, self.at = buffers(col)
        keep = _ALNUM if alnum else _SPACE
        lens = np.diff(self.at)
        begins = self.at[:-1][lens > 0]
        parts, pos, n = [], 0, len(self.bytes)
        while pos < n:
            end = min(n, pos + _STEP)
            while end < n:  # no word is cut
                ahead = keep[_LOWERED[self.bytes[end : end + 4096]]]
                if not ahead.all():
                    end += int(np.argmin(ahead))
                    break
                end = min(n, end + 4096)
            b = _LOWERED[self.bytes[pos:end]]
            lo, hi = np.searchsorted(begins, [pos, end])
            s, e, h = _segment(b, keep[b], begins[lo:hi] - pos)
            parts.append((s + pos, e + pos, h))
            pos = end
        self.start, self.end, self.hash = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        #: Words of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.start, self.at)
        self.bounds[-1] = len(self.start)


_TURN = [np.uint64(_splitmix(1000 + i) | 1) for i in range(16)]


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words (all of one text)."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(w) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out += w[i : len(w) - n + 1 + i] * _TURN[i]
    return mix(out)


def shingle_set(w: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, of none no shingle."""
    if 0 < len(w) < n:
        return grams(w, len(w))
    return np.unique(grams(w, n))


# ---------------------------------------------------------------- sieves and skewed joins


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """The one column of hashes, longs, as a bitmap of 2**bits bits: a sieve of a size that is set."""
    at = hashes.toDF("h").select(F.pmod("h", F.lit(1 << bits)).alias("p"))
    parts = at.groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("b"))
    out = bytearray(1 << (bits - 3))
    for part, b in parts.collect():  # 2**(bits - 15) rows of 4 KB at most, in one job for all partitions
        out[part << 12 : (part + 1) << 12] = b
    return bytes(out)


def within(sieve: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold each of the hashes (signed longs)."""
    at = hashes & (len(sieve) * 8 - 1)
    return np.frombuffer(sieve, np.uint8)[at >> 3] >> (at & 7) & 1 == 1


#: A key with more than this share of all rows, and this number, is hot: 1 / HOT_SHARE keys at most.
HOT_SHARE, HOT_LEAST = 1e-4, 500


def skew_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, salt: str) -> DataFrame:
    """rows with the facts of their key, where it has any; facts: one row a key, with its number of rows.

    The rows of hot keys meet their facts by broadcast and are dealt out by salt, so no task
    gets them all; the others meet theirs by shuffle.
    """
    hot = F.col(weight) > max(HOT_LEAST, int(total * HOT_SHARE))
    names = [c for c in facts.columns if c != key]
    few = F.broadcast(facts.where(hot).select(key, *[F.col(c).alias(f"__hot_{c}") for c in names], F.lit(True).alias("__hot")))
    marked = rows.join(few, key, "left")
    marked = marked.withColumn("__k", F.when(F.col("__hot"), F.xxhash64(salt)).otherwise(F.col(key).cast("long"))).withColumn("__k2", F.when(F.col("__hot").isNull(), F.lit(0)))
    rest = facts.where(~hot).select(F.col(key).cast("long").alias("__k"), F.lit(0).alias("__k2"), *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__rest"))
    found = marked.join(rest, ["__k", "__k2"], "left").where("__hot is not null or __rest is not null")
    return found.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__{c}").alias(c) for c in names])


# ---------------------------------------------------------------- components


def _stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a centre."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    roles = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return roles.where("out > 1 or out = 1 and `in` = 1").limit(1).count() == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the graph of edges (a, b), component: its smallest node.

    Large-star and small-star steps on DataFrames, each cut; nothing goes to the driver but
    whether more are needed. Isolated nodes and loops aren't returned.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _stars(e):
            break
        total = 2 * e.count()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = cut(skew_join(both.where("b > a"), low, "a", "n", total, "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = skew_join(large, low, "a", "n", total, "b").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct())
        release(e.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
