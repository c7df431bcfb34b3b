"""Documents to sections, paragraphs and sentences; offsets are 0-based code points, half open.

A document is segmented by itself, in Python, so this also runs on streams; nodes() explodes
its arrays into a tree of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import text as T

# Endings in a full stop that end no sentence.
ABBREVIATIONS = [
    "dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "jr.", "st.",
    "fig.", "figs.", "eq.", "eqs.", "sec.", "ch.", "vol.", "no.", "pp.",
    "e.g.", "i.e.", "et al.", "etc.", "vs.", "cf.", "ca.", "approx.",
    "u.s.", "u.k.", "a.m.", "p.m.",
    "z.b.", "d.h.", "bzw.", "usw.", "nr.", "vgl.", "u.a.",
]
MARK = "\u0001"
#: A heading block: level marks, then the title.
HEADING = r"^(#{1,6})\s+([^\n]*)$"


#: End marks before white space and an opening capital or digit.
_END = re.compile(rf"""[.!?]["')\]]*(?P<gap>[{T.WHITE}]+)(?=["'(\[]*[A-Z0-9])""")
_HEADING = re.compile(HEADING, re.ASCII)
#: Letters beyond ASCII that are one of it in another case.
_SAME = {ord(c): x for c in map(chr, range(0x80, 0x3000)) for x in (T.folded(c),) if x.isascii()}

#: Rows that leave Python at a time, however many a text makes.
ROWS = 1 << 15
SECTION = "struct<id:string,start:int,end:int,title:string>"
PARAGRAPH = "struct<id:string,section:string,section_path:string,start:int,end:int,text:string,first_sentence:int,n_sentences:int>"
SENTENCE = "struct<id:string,paragraph:string,start:int,end:int,text:string>"


def _ends(text: str, at: int, strict: bool) -> bool:
    """Whether the full stop before `at` ends a sentence: no abbreviation and no single letter does.

    An abbreviation is any ending equal to one, so "first." counts as "st."; strict asks for
    a word border before it.
    """
    tail = text[max(at - 9, 0) : at]
    tail = tail.lower() if tail.isascii() else tail.translate(_SAME).lower()
    short = [a for a in ABBREVIATIONS if tail.endswith(a)] if tail.endswith(_SHORT) else []
    if short and not (strict and all(len(tail) > len(a) and "a" <= tail[-len(a) - 1] <= "z" for a in short)):
        return False
    letter = at > 1 and text[at - 2].isascii() and text[at - 2].isalpha()
    return not (letter and (at < 3 or not (text[at - 3] == "_" or category(text[at - 3])[0] in "LN")))


_SHORT = tuple(ABBREVIATIONS)


def split_sentences(text: str, offset: int = 0, strict: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences of a paragraph."""
    cuts = [at for m in _END.finditer(text) for at in (m.start("gap"),) if text[at - 1] != "." or _ends(text, at, strict)]
    parts, out, at = [text[a:z] for a, z in zip([0, *cuts], [*cuts, len(text)], strict=True)], [], offset
    if MARK in text:
        parts = [x for p in parts for x in p.split(MARK)]
    for p in parts:
        if body := p.strip(T.WHITE):
            start = at + len(p) - len(p.lstrip(T.WHITE))
            out.append((start, start + len(body), body))
        at += len(p)
    return out


def blocks(text: str) -> list[tuple[int, str, str]]:
    """(start, text, text without white space around it) of what empty lines part, without empty blocks."""
    out, at = [], 0
    for b in text.split("\n\n"):
        if body := b.strip(T.WHITE):
            out.append((at, b, body))
        at += len(b) + 2
    return out


def paragraphs(text: str) -> Iterator[tuple[int, str, str | None]]:
    """(start, text, title) of the blocks in order; the title is that of a heading, which opens a section."""
    for at, b, body in blocks(text):
        head = _HEADING.search(body)
        yield at, b, head and head[2].strip(T.WHITE)


def sentences(text: str, strict: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences of a text; headings have none."""
    return [s for at, b, title in paragraphs(text) if title is None for s in split_sentences(b, at, strict)]


def structure(text: str, title: str | None, strict: bool = False) -> tuple[list, list, list]:
    """(sections, paragraphs, sentences) of a text, each a list of the fields of its struct.

    A heading block opens a section that runs to the next one; what comes before the first
    is in the root section s0, which has the document's title.
    """
    heads, body, said = [(0, title or "")], [], []
    for at, b, head in paragraphs(text):
        if head is not None:
            heads.append((at, head))
            continue
        own = split_sentences(b, at, strict)
        name = f"p{len(body)}"
        body.append((name, f"s{len(heads) - 1}", heads[-1][1], at, at + len(b), b, len(said), len(own)))
        said += [(f"t{i}", name, *s) for i, s in enumerate(own, len(said))]
    ends = [*(h[0] for h in heads[1:]), len(text)]
    return [(f"s{i}", at, end, head) for i, ((at, head), end) in enumerate(zip(heads, ends, strict=True))], body, said


def _lists(rows: list[list[tuple] | None], kind: pa.StructType) -> pa.Array:
    """Lists of the fields of structs as an array of lists of structs."""
    flat = list(zip(*(x for row in rows for x in row or ()), strict=True)) or [()] * kind.num_fields
    ends = np.cumsum([0, *(len(row or ()) for row in rows)]).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields, mask=pa.array([row is None for row in rows]))


def segment(docs: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, title, text, ...) with `sections` (id, start, end, title), `paragraphs` (id, section,
    section_path, start, end, text and, of its sentences, first_sentence and n_sentences) and
    `sentences` (id, paragraph, start, end, text)."""
    kinds = {"sections": SECTION, "paragraphs": PARAGRAPH, "sentences": SENTENCE}
    types = [to_arrow_type(T.struct_of(k)) for k in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches):
            pairs = zip(b.column("text").to_pylist(), b.column("title").to_pylist(), strict=True)
            made = [(None,) * 3 if text is None else structure(text, title, strict) for text, title in pairs]
            columns = [_lists([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *kinds])

    schema = StructType([*docs.schema.fields, *(StructField(k, ArrayType(T.struct_of(v))) for k, v in kinds.items())])
    return docs.withColumn("text", F.make_valid_utf8("text")).mapInArrow(run, schema)


def by_text(docs: DataFrame, schema: str, each: Callable[[str], Iterable[tuple]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with, for each row that each() makes of its `text`, the columns of schema."""
    made = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in made]

    def batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kept = b.select(list(keep)).take(pa.array(at, pa.int32())).columns
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*keep, *made.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches):
            at, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                more = iter(() if text is None else each(text))
                while some := list(islice(more, ROWS - len(rows))):
                    rows += some
                    at += [i] * len(some)
                    if len(rows) == ROWS:
                        yield batch(b, at, rows)
                        at, rows = [], []
            if rows:
                yield batch(b, at, rows)

    rows = docs.select(*keep, F.make_valid_utf8("text").alias("text"))
    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keep), *made]))


def overlapping(sentences: Column, start: Column, end: Column) -> Column:
    """Ids of the sentences that a span overlaps."""
    return F.transform(F.filter(sentences, lambda s: (s["start"] < end) & (s["end"] > start)), lambda s: s["id"])


def nodes(segmented: DataFrame) -> DataFrame:
    """The tree as rows: doc_id, id, type, start, end, parent, children, title."""
    null = F.lit(None).cast("string")
    node = lambda id_, kind, start, end, parent, title: F.struct(id_.alias("id"), F.lit(kind).alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), parent.alias("parent"), title.alias("title"))
    doc = F.array(node(F.lit("d0"), "document", F.lit(0), F.length("text"), null, F.col("title")))
    sections = F.transform("sections", lambda s: node(s["id"], "section", s["start"], s["end"], F.lit("d0"), s["title"]))
    paragraphs = F.transform("paragraphs", lambda p: node(p["id"], "paragraph", p["start"], p["end"], p["section"], null))
    sentences = F.transform("sentences", lambda s: node(s["id"], "sentence", s["start"], s["end"], s["paragraph"], null))
    rows = segmented.select("doc_id", F.posexplode(F.concat(doc, sections, paragraphs, sentences)).alias("seq", "n")).select("doc_id", "seq", "n.*")
    kids = rows.where("parent is not null").groupBy("doc_id", F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("id").alias("kid")))), lambda x: x["kid"]).alias("children"))
    return rows.join(kids, ["doc_id", "id"], "left").select("doc_id", "id", "type", "start", "end", "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"), "title")
