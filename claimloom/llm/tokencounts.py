"""Token counts with offset-mapped attribution to sections.

A document is encoded once, whole, by a byte-level BPE vocabulary. A token's byte length is
known from the vocabulary, so running sums give every token's span; sections have spans too
(by default lines, each with its line break), and tokens are joined to the sections they
overlap by interval. A token that crosses section borders goes, by the rule stated,

- `start`: to the section that holds its first byte (the default),
- `most`: to the section that holds most of its bytes, the first of equals.

Sections tile the text and each token is counted once, so a document's counts add up.

A null or empty text is one section of no tokens; a text that ends in a line break has no
empty section after it. Characters are code points. Repeated rows are counted each; doc_id
may be null. Texts of any length are encoded whole; strings that look like special tokens
are ordinary text. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, pieces, table

#: A vocabulary as lines of base64 token and rank; every executor must see this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merging: the public pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most")


@lru_cache(2)
def encoder(path: str, pattern: str):
    """(encoding, byte length of each token), once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lens = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lens[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lens


def lines(text: np.ndarray) -> np.ndarray:
    """First bytes of the lines of a text (bytes)."""
    after = np.flatnonzero(text == 10) + 1
    return np.concatenate([[0], after[after < len(text)]])


def attribute(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross its end) for sections that begin at starts and tile the text."""
    begins = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    own = first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "most":
        edges = np.append(starts, size)
        for k in crossing:
            over = [min(token_ends[k], edges[s + 1]) - max(begins[k], edges[s]) for s in range(first[k], last[k] + 1)]
            own[k] = first[k] + int(np.argmax(over))
    return np.bincount(own, minlength=len(starts)), np.bincount(first[crossing], minlength=len(starts))


def count_tokens(docs: DataFrame, rule: str = "start", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Per section: doc_id, section, start, end (characters), n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lens = encoder(path, pattern)
        for b in pieces(batches):
            data, at = buffers(b.column(1))
            text, rows = [], []
            for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                raw = data[lo:hi]
                starts = lines(raw)
                ids = encoding.encode_to_numpy(raw.tobytes().decode(), disallowed_special=())
                counts, crossing = attribute(np.cumsum(lens[ids]), starts, hi - lo, rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                edges = chars[np.append(starts, hi - lo)]
                text.append(np.full(len(starts), i))
                rows.append(np.stack([np.arange(len(starts)), edges[:-1], edges[1:], counts, crossing, np.full(len(starts), len(ids))]))
            cols = np.concatenate(rows, axis=1) if rows else np.zeros((6, 0), np.int64)
            ids = b.column(0).take(pa.array(np.concatenate(text) if text else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in cols)], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
