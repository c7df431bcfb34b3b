"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct lower-cased words, word pairs and pairs that skip one
word, hashed into 2**BITS places (presence, each once). FTRL-proximal keeps a learning rate
per place and drops weights whose gradient sum stays within L1, so the model is the few
places that matter; it is sent to the executors as two short arrays.

The classifier is fitted on labelled rows only, at most `max_train` of them, taken in the
order of a hash of doc_id, classes apart (half of the bound each), so the bound never
starves a class; of these, in the same order, those whose features fill `max_places` places
at most, which bounds the memory of the fit for texts of any length. Everything else covers
every row: all texts are read whole and scored.

Null and empty texts have the bias as their only feature and still get a score; rows with a
null label, and labels of unknown documents, train nothing. With no labelled rows of both
classes the score is 0 for every row. Ties in the training order are broken by doc_id;
repeated rows are scored each. Other columns are kept by score() and clean() and ignored by
op7; score() adds `score`, with underscores before it if the table has such a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, column, free, mix, pieces, table

BITS = 21
#: Labelled rows the fit takes at most.
MAX_TRAIN = 16_000
#: Features of these rows that the fit holds at most, 4 bytes each.
MAX_PLACES = 64 << 20
THRESHOLD = 0.7
#: Chosen on a split within the training rows, never on held-out ones.
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 3.0, 0.5, 5
_SEED = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def features(w: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of one text's words, pairs and skip-pairs, distinct and sorted."""
    parts = [mix(w ^ _SEED[0])]
    for skip, seed in ((1, _SEED[1]), (2, _SEED[2])):
        if len(w) > skip:
            parts.append(mix(w[:-skip] * np.uint64(3) + mix(w[skip:] ^ seed)))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def train_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, toxic) of the rows the fit may see; held-out ids are never among them."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = max_train // 2
    ranked = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
    chosen = ranked(0).unionByName(ranked(1))  # max_train rows of 12 bytes at most: the bound of the broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS, epochs: int = EPOCHS, max_places: int = MAX_PLACES) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the fitted model, the bias at place -1."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1))
            x = [features(words.hash[lo:hi], bits).astype("<i4").tobytes() for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["doc_id", "toxic", "x"])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in parts:
            for x, y in zip(b.column("x"), b.column("toxic").to_pylist(), strict=True):
                if held <= max_places:
                    rows.append((np.frombuffer(x.as_py(), "<i4"), y))
                    held += len(rows[-1][0])
        at, w = ftrl(rows, bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w, pa.float64())], names=["at", "w"])

    rows = train_rows(docs, labels, max_train).mapInArrow(places, "doc_id long, toxic int, x binary")
    # one task, whose rows max_train bounds: an online learner sees them in one order
    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).mapInArrow(learn, "at int, w double")
    got = model.orderBy("at").toArrow()
    return got.column("at").to_numpy().astype(np.int64), got.column("w").to_numpy()


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: per-coordinate rates from summed squares, L1 by lazy weights."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    if len({y for _, y in rows}) < 2:
        return np.zeros(0, np.int64), np.zeros(0)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    seen = np.zeros(size, np.int32)
    for x, _ in rows:
        seen[x] += 1
    rows = [(x[seen[x] > 1], y) for x, y in rows]  # what one row alone has says nothing about others
    share = sum(y for _, y in rows) / len(rows)
    gain = min(1.0, (1 - share) / max(share, 1e-9))  # no class outweighs the other by more than its number
    for _ in range(epochs):
        for x, y in rows:
            at = np.append(x, size).astype(np.int64)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (gain if y else 1.0)
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    w = weights(at)
    return np.where(at == size, -1, at), w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """docs with a column score; whole texts, no shuffle."""
    return _scored(docs, model, free("score", docs), bits)


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str, bits: int = BITS) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = sent.value
        dense = np.zeros((1 << bits) + 1)
        dense[places] = weights  # -1 is the last
        bias = dense[-1]
        for b in pieces(batches):
            words = Words(b.column(at))
            if len(places):
                total = [bias + dense[features(words.hash[lo:hi], bits)].sum() if hi > lo else bias for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                p = 1.0 / (1.0 + np.exp(-np.clip(np.array(total, dtype=float), -35, 35)))
            else:
                p = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that the classifier does not reject (score below the threshold)."""
    name = free("__score", docs)
    return _scored(docs, fit(docs, labels, max_train), name).where(F.col(name) < threshold).select(*map(column, docs.columns))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
