"""Substring dedup by hashing lines and the sentences in them.

Lines. A line's digest, 128 bits, is taken of its words, A-Z lower-cased, so white space
doesn't count. Digests are grouped over all documents; of each, the occurrence of the lowest
(doc_id, row, place) stays and every other one is removed, by its offsets in the text as it
was. `min_words` spares lines of fewer words; it is 1, which spares none.

Sentences. A passage need not begin and end with a line, so the parts of lines that end after
`.`, `!` or `?` (quotes and brackets may follow) before white space have digests too, in the
same groups. Sentences that recur by themselves are no passage; repeats that follow one
another are, if they have `passage_words` words or more together, and go like lines. Sentences
of under TINY words, which meet by chance, count for that length only if they are repeated
together with what follows them: from each, the fewest sentences that hold TINY words have a
digest of their own, and a repeat of it counts all of them.

Lines without words aren't units. Null and empty texts have none and no row. Every row is a
document of its own, also those that repeat a doc_id or have none; null doc_ids rank first,
rows of one doc_id by their place in the table. dedup() writes the rows down with their
numbers first; repeats() reads its input twice and needs its rows in the same order each time,
as a table has them. Extra columns are ignored by op3 and kept by dedup(), which adds
`removed`, with underscores before it if there is such a column. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bitmap, column, cut, free, mix, pieces, table, within

#: Words from which on a repeated line goes: all do.
MIN_WORDS = 1
#: Words from which on repeated sentences that follow one another are a passage.
PASSAGE_WORDS = 30
TINY = 4
#: Digests with more than this share of all repeats, and this number, are joined by broadcast: 1 / HOT_SHARE at most.
HOT_SHARE, HOT_LEAST = 1e-4, 1000
#: Bits of the sieve for each repeated digest, and of all as a power of two (32 MB).
SIEVE, MOST_BITS = 16, 28
_POWERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
NAMES = ["unit", "last", "line", "start", "end", "words"]
UNITS = "doc_id long, row long, " + ", ".join(f"{n} int" for n in NAMES) + ", h1 long, h2 long"


def _digests(hashes: np.ndarray, begins: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """h1, h2 of the stretches of `size` words from `begins` on."""
    at = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(at, size)
    words, out = hashes[np.repeat(begins, size) + place], []
    for base in _POWERS:
        powers = np.full(int(size.max()), base, np.uint64)
        powers[0] = 1
        out.append(mix(np.add.reduceat(words * np.cumprod(powers, dtype=np.uint64)[place], at) ^ size.astype(np.uint64)).view(np.int64))
    return {"h1": out[0], "h2": out[1]}


def units_of(col: pa.Array) -> dict[str, np.ndarray]:
    """text (its number), unit, last (sentences the unit begins and ends with), line (whether it
    is a whole line), start, end (characters), words, h1, h2."""
    w = Words(col)
    n = len(w.hash)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("text", *NAMES, "h1", "h2")}
    chars = np.concatenate([[0], np.cumsum((w.bytes & 0xC0) != 0x80)])
    breaks = np.concatenate([[0], np.cumsum(w.bytes == 10)])
    back = w.end - 1
    closers = np.isin(w.bytes, np.frombuffer(b"\"')]", np.uint8))
    for _ in range(3):
        back = np.where(closers[back] & (back > w.start), back - 1, back)
    line_end = np.zeros(n, bool)
    line_end[:-1] = breaks[w.start[1:]] != breaks[w.end[:-1]]
    line_end[w.bounds[1:][w.bounds[1:] > w.bounds[:-1]] - 1] = True
    ends = np.flatnonzero(np.isin(w.bytes[back], np.frombuffer(b".!?", np.uint8)) | line_end)
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = ends - begins + 1
    text = np.searchsorted(w.bounds, begins, side="right") - 1
    unit = np.arange(len(ends)) - np.searchsorted(text, np.arange(len(w.bounds) - 1))[text]
    closes = line_end[ends]  # the sentence is a line's last one
    opens = np.concatenate([[True], closes[:-1]])
    line_first = np.flatnonzero(opens)
    line_last = np.flatnonzero(closes)

    def rows(u: np.ndarray, v: np.ndarray, line: np.ndarray) -> dict[str, np.ndarray]:
        if not len(u):
            return {}
        long, origin = ends[v] - begins[u] + 1, chars[w.at[text[u]]]
        return {"text": text[u], "unit": unit[u], "last": unit[v], "line": line.astype(np.int64), "start": chars[w.start[begins[u]]] - origin, "end": chars[w.end[ends[v]]] - origin, "words": long, **_digests(w.hash, begins[u], long)}

    every = np.arange(len(ends))
    parts = [rows(every, every, opens & closes)]
    several = line_last > line_first  # lines of one sentence are that sentence
    parts.append(rows(line_first[several], line_last[several], np.ones(int(several.sum()), bool)))
    u = np.flatnonzero(size < TINY)
    v = np.searchsorted(ends, begins[u] + TINY - 1)
    inside = v < len(ends)
    u, v = u[inside], v[inside]
    u, v = u[text[u] == text[v]], v[text[u] == text[v]]
    is_line = np.isin(u, line_first) & closes[v] & (v == line_last[np.searchsorted(line_last, u)])
    u, v = u[~is_line], v[~is_line]  # which has its row already
    parts.append(rows(u, v, np.zeros(len(u), bool)))
    parts = [p for p in parts if p]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _units(rows: DataFrame, sieve: bytes | None = None) -> DataFrame:
    """The units of rows (doc_id, row, text); with a sieve, those whose h1 it may hold."""
    sent = rows.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            u = units_of(b.column(2))
            if sent.value is not None:
                keep = within(sent.value, u["h1"])
                u = {k: x[keep] for k, x in u.items()}
            at = pa.array(u["text"])
            cols = [b.column(0).take(at), b.column(1).take(at)]
            cols += [pa.array(u[k].astype(np.int32)) for k in NAMES] + [pa.array(u[k]) for k in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", *NAMES, "h1", "h2"])

    return rows.mapInArrow(run, UNITS)


def _later(rows: DataFrame) -> DataFrame:
    """The units of rows (doc_id, row, text) that occurred before, with `origin`, the doc_id of the first occurrence.

    Units meet their digest's first occurrence by shuffle; those of digests with more than
    HOT_SHARE of all repeats, of which there can't be many, by broadcast instead, so no task
    gets them all. A bitmap of the repeated digests, of SIEVE bits for each and MOST_BITS at
    most, keeps most other units from being shuffled; beyond that size it lets more through.
    """
    place = F.struct("doc_id", "row", "unit")
    known = cut(_units(rows).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total, kinds = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    units = _units(rows, bitmap(known.select("h1"), min(MOST_BITS, max(16, (SIEVE * kinds).bit_length()))))
    hot = F.col("n") > F.lit(max(HOT_LEAST, int(total * HOT_SHARE)))
    few = F.broadcast(known.where(hot).select("h1", "h2", F.col("first").alias("hot_first")))
    marked = units.join(few, ["h1", "h2"], "left")
    spread = F.col("hot_first").isNotNull()  # under a key that no digest has, dealt out evenly
    marked = marked.withColumn("k1", F.when(spread, F.xxhash64("row", "unit", "last")).otherwise(F.col("h1"))).withColumn("k2", F.when(~spread, F.col("h2")))
    rest = known.where(~hot).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    found = marked.join(rest, ["k1", "k2"], "left").withColumn("first", F.coalesce("hot_first", "first"))
    return found.where("first is not null").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "row", *NAMES, F.col("first.doc_id").alias("origin"))


def passages(units: list[dict], min_words: int, passage_words: int) -> list[list[dict]]:
    """Of a text's repeated units, the runs of sentences to remove."""
    inside = lambda u: range(u["unit"], u["last"] + 1)
    one = sorted((u for u in units if u["last"] == u["unit"]), key=lambda u: u["unit"])
    counted = {n for u in units if u["last"] > u["unit"] for n in inside(u)}
    gone = {n for u in units if u["line"] and u["words"] >= min_words for n in inside(u)}
    runs: list[list[dict]] = []
    for u in one:
        if runs and runs[-1][-1]["unit"] + 1 == u["unit"]:
            runs[-1].append(u)
        else:
            runs.append([u])
    for run in runs:
        if sum(u["words"] for u in run if u["words"] >= TINY or u["unit"] in counted) >= passage_words:
            gone.update(u["unit"] for u in run)
    out: list[list[dict]] = []
    for u in (u for u in one if u["unit"] in gone):
        if out and out[-1][-1]["unit"] + 1 == u["unit"]:
            out[-1].append(u)
        else:
            out.append([u])
    return out


def _repeats(rows: DataFrame, min_words: int, passage_words: int) -> DataFrame:
    """repeats() of rows (doc_id, row, text), with `row`."""
    item = F.struct("unit", "last", "line", "start", "end", "words", "origin")
    per_row = _later(rows).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(item).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for row, doc, us in zip(*(b.column(k).to_pylist() for k in ("row", "doc_id", "units")), strict=True):
                for held in passages(us, min_words, passage_words):
                    out.append({"row": row, "doc_id": doc, "start": held[0]["start"], "end": held[-1]["end"], "n_words": sum(x["words"] for x in held), "n_units": len(held), "first_doc_ids": sorted({x["origin"] for x in held}, key=lambda x: (x is not None, x))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    longs = ["row", "doc_id", "start", "end", "n_words", "n_units"]
    schema = pa.schema([*((n, pa.int64()) for n in longs), ("first_doc_ids", pa.list_(pa.int64()))])
    return per_row.select("row", "doc_id", "units").mapInArrow(run, ", ".join(f"{n} long" for n in longs) + ", first_doc_ids array<long>")


def _numbered(docs: DataFrame, row: str | None = None) -> DataFrame:
    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """What is to be removed: doc_id, start, end, n_words, n_units, first_doc_ids.

    n_units: sentences. first_doc_ids: the documents in which they stay, sorted.
    """
    return _repeats(_numbered(docs), min_words, passage_words).drop("row")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with `text` without what repeats, and `removed`, its (start, end) in the old text."""
    row, removed = free("__row", docs), free("removed", docs)
    whole = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    spans = _repeats(_numbered(whole, row), min_words, passage_words).groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(removed))
    out = whole.join(spans, row, "left")
    text = F.col("text").cast("string")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(removed, lambda x: x["end"]))
    ends = F.concat(F.transform(removed, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    return out.withColumn("text", F.when(F.col(removed).isNull(), text).otherwise(kept)).select(*map(column, docs.columns), removed)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
