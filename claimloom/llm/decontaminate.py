"""Benchmark decontamination with suffix arrays of the training words.

A shard is a stretch of documents that a worker handles at a time. Its suffix array holds, in
the order of all their words, the suffixes of its stretches of benchmark words (a suffix ends
where such a stretch does: no match goes further), sorted by doubling prefixes. Every suffix
of every benchmark item is looked up in it by binary search, word by word; the suffixes that
share its first `window` words lie side by side there, and each is followed to the last word
that both have in common. That gives all longest verbatim matches with their places, and from
these come the words hit, the items, and the documents that are removed. Documents are read
once for each block of the benchmark and nothing is shuffled but, for several blocks, matches.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased;
they are compared by 64-bit hashes. An item of fewer than `window` words, but not none, is
one window. Null and empty texts have no words and are never hit; null items and items
without words match nothing; repeated items count under each of their ids; repeated
document rows each get their row. Extra columns of either table are ignored by report() and
longest_matches() and kept by clean().

The benchmark is the query set: it goes to the executors in blocks of at most `block_bytes`
of text (or one longer item), one after the other, so neither the driver nor a broadcast
holds more than one of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, free, pieces, table

WINDOW = 10
BLOCK_BYTES = 64 << 20


class Suite:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        words = Words(pa.array([t for _, t in rows], pa.string()), alnum=True)
        self.ids = [str(i) for i, _ in rows]
        self.vocab = np.unique(words.hash)
        lens = np.diff(words.bounds)
        self.least = int(min(window, lens[lens > 0].min())) if (lens > 0).any() else 0
        item = np.repeat(np.arange(len(rows)), lens)
        begin, end = np.repeat(words.bounds[:-1], lens), np.repeat(words.bounds[1:], lens)
        pos = np.arange(len(words.hash))
        full = np.minimum(window, np.repeat(lens, lens))
        keep = pos + full <= end  # suffixes with enough words, or the whole of a short item
        self.words = np.append(np.searchsorted(self.vocab, words.hash) + 1, 0).astype(np.int64)
        self.at, self.size, self.item, self.begin, self.end = pos[keep], full[keep], item[keep], begin[keep], end[keep]


class Shard:
    """The suffix array of a stretch of documents: `order` has the suffixes' places in `words`.

    words: the stretches of benchmark words of `least` words or more, each with a 0 after it;
    place: where each is among the words of the documents.
    """

    def __init__(self, words: Words, suite: Suite):
        near = np.minimum(np.searchsorted(suite.vocab, words.hash), len(suite.vocab) - 1)
        ids = np.where(suite.vocab[near] == words.hash, near + 1, 0)
        own = np.append(ids > 0, False)
        first = own.copy()
        first[1:] &= ~own[:-1]
        first[words.bounds[:-1]] = own[words.bounds[:-1]]
        starts = np.flatnonzero(first)
        after = ~own
        after[words.bounds] = True
        stops = np.flatnonzero(after)
        ends = stops[np.searchsorted(stops, starts, side="right")]
        starts, ends = starts[ends - starts >= suite.least], ends[ends - starts >= suite.least]
        size = ends - starts
        begins = np.cumsum(size + 1) - size - 1
        at = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
        self.place = np.zeros(int((size + 1).sum()), np.int64)
        self.words, left = self.place.copy(), self.place.copy()
        self.place[at] = at - np.repeat(begins, size) + np.repeat(starts, size)
        self.words[at] = ids[self.place[at]]
        left[at] = np.repeat(ends, size) - self.place[at]
        rank, k, most = self.words.copy(), 1, int(size.max(initial=0))
        while len(at):
            kinds, inverse = np.unique(rank[at], return_inverse=True)
            rank[at] = inverse + 1
            if len(kinds) == len(at) or k >= most:
                break
            further = np.where(left[at] > k, rank[np.minimum(at + k, len(rank) - 1)], 0)
            rank[at] = rank[at] * (len(kinds) + 1) + further
            k *= 2
        self.order = at[np.argsort(rank[at], kind="stable")]
        self.firsts = self.words[self.order]


def _compared(shard: Shard, suite: Suite, at: np.ndarray, wanted: np.ndarray, size: np.ndarray) -> np.ndarray:
    """-1, 0, 1: how the suffixes of the shard at `at` stand to the first `size` words of those wanted."""
    out, open_ = np.zeros(len(at), np.int8), np.arange(len(at))
    for d in range(int(size.max(initial=0))):
        open_ = open_[size[open_] > d]
        a, b = shard.words[at[open_] + d], suite.words[wanted[open_] + d]
        out[open_] = np.sign(a - b)
        open_ = open_[a == b]
        if not len(open_):
            break
    return out


def matches(words: Words, suite: Suite) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of the documents, number of the suffix in suite, words): the longest matches.

    Each from its first word on: what begins a word earlier on both sides is another match.
    """
    none = np.zeros(0, np.int64)
    if not len(words.hash) or not suite.least:
        return none, none, none
    shard = Shard(words, suite)
    if not len(shard.order):
        return none, none, none
    lo, hi = (np.searchsorted(shard.firsts, suite.words[suite.at], side) for side in ("left", "right"))
    number = np.flatnonzero(hi > lo)
    bounds = []
    for upper in (0, 1):  # the first suffix that isn't smaller, the first that is larger
        low, high = lo[number].copy(), hi[number].copy()
        open_ = np.arange(len(number))
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            right = _compared(shard, suite, shard.order[mid], suite.at[number[open_]], suite.size[number[open_]]) < upper
            low[open_[right]], high[open_[~right]] = mid[right] + 1, mid[~right]
            open_ = open_[low[open_] < high[open_]]
        bounds.append(low)
    count = bounds[1] - bounds[0]
    number, start, count = number[count > 0], bounds[0][count > 0], count[count > 0]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, number = shard.order[np.repeat(start, count) + within], np.repeat(number, count)
    own = suite.at[number]
    opens = (own == suite.begin[number]) | (shard.words[at - 1] != suite.words[own - 1])
    at, number, own = at[opens], number[opens], own[opens]
    long, open_ = suite.size[number].copy(), np.arange(len(at))
    while len(open_):
        open_ = open_[own[open_] + long[open_] < suite.end[number[open_]]]
        open_ = open_[shard.words[at[open_] + long[open_]] == suite.words[own[open_] + long[open_]]]
        long[open_] += 1
    return shard.place[at], number, long


def _suites(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Suite, bool]]:
    """The benchmark in blocks, and whether one is the only one; the driver holds one at a time
    and the text that follows it."""
    rows, held, first = [], 0, True
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length(F.col("i").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    ordered = items.orderBy("i", "t")
    # what fits a block comes in one job; more, partition by partition
    for i, t in ordered.collect() if size <= block_bytes else ordered.toLocalIterator():
        if rows and held + len(t.encode()) > block_bytes:
            yield Suite(rows, window), False
            rows, held, first = [], 0, False
        rows.append((i, t))
        held += len(t.encode())
    yield Suite(rows, window), first


def _texts(docs: DataFrame, row: str | None = None) -> DataFrame:
    key = F.col(row) if row else F.col("doc_id").cast("long")
    return docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))


class Covered:
    """Which words of a batch are hit."""

    def __init__(self, words: Words):
        self.words, self.marks = words, np.zeros(len(words.hash) + 1, np.int64)

    def add(self, at: np.ndarray, size: np.ndarray) -> None:
        np.add.at(self.marks, at, 1)
        np.add.at(self.marks, at + size, -1)

    def hits(self) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(np.cumsum(self.marks)[:-1] > 0)])
        return upto[self.words.bounds[1:]] - upto[self.words.bounds[:-1]]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
MATCH = ["item_word", "doc_word", "n_words", "start", "end"]


def _row_batch(ids: pa.Array, n: np.ndarray, hits: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    digest = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([digest(x) for x in items], pa.string()), pa.array(np.asarray(hits) > 0)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted id strings), items_sha256, contaminated."""
    suites = _suites(benchmark, window, block_bytes)
    suite, only = next(suites)
    if not only:
        return _report_blocks(docs, suite, suites)
    sent = docs.sparkSession.sparkContext.broadcast(suite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words, suite = Words(b.column(1), alnum=True), sent.value
            at, number, size = matches(words, suite)
            covered, items = Covered(words), [[] for _ in range(b.num_rows)]
            covered.add(at, size)
            text = np.searchsorted(words.bounds, at, side="right") - 1
            for t, i in np.unique(np.stack([text, suite.item[number]], 1), axis=0) if len(at) else ():
                items[t].append(suite.ids[i])
            yield _row_batch(b.column(0), np.diff(words.bounds), covered.hits(), [sorted(set(x)) for x in items])

    return _texts(docs).mapInArrow(run, SCHEMA)


def _report_blocks(docs: DataFrame, suite: Suite, rest: Iterator[tuple[Suite, bool]]) -> DataFrame:
    """report() for a benchmark of several blocks: the matches of each, cut, then put together by row."""
    row = free("__row", docs)
    whole = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for s in itertools.chain([suite], (x for x, _ in rest)):
        now = _matches(_texts(whole, row), s)
        found = now if found is None else found.unionByName(now)
    spans = found.groupBy("key").agg(F.collect_set("item_id").alias("items"), F.collect_set(F.struct("doc_word", "n_words")).alias("spans"))
    rows = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("key"), F.col("text").cast("string").alias("text")).join(spans, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1), alnum=True)
            covered = Covered(words)
            for base, x in zip(words.bounds[:-1], b.column(3).to_pylist(), strict=True):
                for s in x or ():
                    covered.add(np.array([base + s["doc_word"]]), np.array([s["n_words"]]))
            yield _row_batch(b.column(0), np.diff(words.bounds), covered.hits(), [sorted(x or ()) for x in b.column(2).to_pylist()])

    return rows.select("doc_id", "text", "items", "spans").mapInArrow(run, SCHEMA)


def _matches(texts: DataFrame, suite: Suite) -> DataFrame:
    """(key, item_id, ...) of the matches of texts (key, text), cut, so the block can go."""
    sent = texts.sparkSession.sparkContext.broadcast(suite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words, s = Words(b.column(1), alnum=True), sent.value
            at, number, size = matches(words, s)
            text = np.searchsorted(words.bounds, at, side="right") - 1
            chars = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
            origin = chars[words.at[text]]
            cols = [s.at[number] - s.begin[number], at - words.bounds[text], size, chars[words.start[at]] - origin, chars[words.end[at + size - 1]] - origin]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array([s.ids[i] for i in s.item[number]], pa.string()), *(pa.array(c.astype(np.int64)) for c in cols)], names=["key", "item_id", *MATCH])

    out = cut(texts.mapInArrow(run, "key long, item_id string, " + ", ".join(f"{n} long" for n in MATCH)))
    sent.unpersist()
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Maximal verbatim matches: doc_id, item_id (as string), item_word, doc_word, n_words, start, end.

    item_word and doc_word are 0-based word numbers, start and end character offsets in the
    text. A match is given once, from its first word on, extended as far as both sides agree.
    """
    found = [_matches(_texts(docs), s) for s, _ in _suites(benchmark, window, block_bytes)]
    return reduce(lambda a, b: a.unionByName(b), found).withColumnRenamed("key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a verbatim match of a window of the benchmark, all columns as they are."""
    for suite, only in _suites(benchmark, window, block_bytes):
        docs = _without(docs, suite)
        docs = docs if only else cut(docs)
    return docs


def _without(docs: DataFrame, suite: Suite) -> DataFrame:
    sent, at = docs.sparkSession.sparkContext.broadcast(suite), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(at), alnum=True)
            hit, _, _ = matches(words, sent.value)
            keep = np.ones(b.num_rows, bool)
            keep[np.searchsorted(words.bounds, hit, side="right") - 1] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.p, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
