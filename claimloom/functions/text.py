"""Text to text, as Column expressions: markup removal, claim wording, content tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The words that carry no content.
STOPWORDS = """
a an the and or but if then than that this these those of in on at to for
with by from as is are was were be been being has have had will would can
could should must may might do does did not no nor it its they them their
he she his her we our you your i me my which who whom whose what when where
why how all any both each few more most other some such only own same so
too very just also into over under between about against during before
after above below up down out off again further once here there because
while although though since until unless
""".split()
# What a token is, and how many first letters of it count.
WORD = r"[A-Za-z0-9][A-Za-z0-9\-']*"
KEY = 5
#: Letters whose capital, by Unicode's full mapping, is several letters, and their capital in one.
SPREAD = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x250 * 512)) if len(c.upper()) > 1}
#: Elements that one fold takes at a time: folds copy what they have made so far.
CHUNK = 256

# The patterns of MARKUP, LAYOUT and BLOCKS, which decide the text. The pattern of
# emphasis is the shorter form of one alternative for each of the marks *, **, ***, _, __, ___.
#: Markup rules in order: (name, pattern, replacement). (?d): only \n ends a line; (?U): Unicode white space.
MARKUP = [
    ("code fence", r"(?s)```.*?```", " "),
    ("image", r"!\[[^\]]*\]\([^)]*\)", " "),
    ("link", r"\[([^\]]+)\]\([^)]*\)", "$1"),
    ("reference link", r"\[([^\]]+)\]\[[^\]]*\]", "$1"),
    ("inline code", r"`([^`]*)`", "$1"),
    ("tag", r"</?[a-zA-Z][^>]*>", " "),
    ("emphasis", r"(?dU)(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", "$2"),
    ("nested emphasis", r"(?dU)(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", "$2"),
    ("quote mark", r"(?dmU)^\s{0,3}>\s?", ""),
    ("list mark", r"(?dmU)^\s{0,6}(?:[-*+]|\d{1,3}[.)])\s+", ""),
]
LAYOUT = [
    ("blanks", r"[ \t]+", " "),
    ("line ends", r"(?dmU)^[^\S\n]+|[^\S\n]+$", ""),
]
BLOCKS = [
    ("headings apart", r"\n(#{1,6} [^\n]*)", "\n\n$1\n\n"),
    ("empty lines", r"\n{3,}", "\n\n"),
    ("soft breaks", r"(?<!\n)\n(?!\n)", " "),
    ("blanks", r"[ \t]+", " "),
]


#: What a text must contain for a rule to find anything: a cheap look before the pattern.
SIGNS = {"code fence": ["```"], "image": ["!["], "link": ["]("], "reference link": ["]["], "inline code": ["`"], "tag": ["<"], "emphasis": ["*", "_"], "nested emphasis": ["*", "_"], "quote mark": [">"], "blanks": ["\t", "  "], "headings apart": ["#"], "empty lines": ["\n\n\n"]}
#: Unicode's white space, which is (?U)\\s in the patterns above.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts of so many characters in all are handled in Python at a time.
PIECE = 4 << 20


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column `name`, made once a row: projections are copied into all that uses them, filters too."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def chunks(xs: Column) -> Column:
    """xs as an array of arrays of CHUNK elements at most; of none, one empty array."""
    last = F.greatest(F.ceil(F.size(xs) / CHUNK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))


def in_python(pattern: str) -> re.Pattern:
    """One of the patterns above as Python's re has it: with \n as the only line end, and white space spelled out."""
    flags, body = re.fullmatch(r"(?s)(?:\(\?([a-zA-Z]+)\))?(.*)", pattern).groups("")
    if "U" in flags:
        body = body.replace(r"[^\S\n]", f"[{WHITE.replace(chr(10), '')}]").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return re.compile(body, sum(getattr(re, f.upper()) for f in flags if f in "ims"))


_RULES = {name: [(SIGNS.get(kind, [""]), kind, in_python(pattern), to.replace("$", "\\")) for kind, pattern, to in rules] for name, rules in (("markup", MARKUP), ("layout", LAYOUT), ("blocks", BLOCKS))}
#: Rules that are done by line or block, with what their patterns do.
_PLAIN = {"line ends": lambda t: "\n".join([x.strip(WHITE) for x in t.split("\n")]), "soft breaks": lambda t: "\n\n".join([x.replace("\n", " ") for x in t.split("\n\n")])}


def _apply(text: str, rules: str) -> str:
    for signs, kind, pattern, to in _RULES[rules]:
        if any(x in text for x in signs):
            text = _PLAIN[kind](text) if kind in _PLAIN else pattern.sub(to, text)
    return text


def normalized(raw: str) -> str:
    """Plain prose: markup gone, headings as blocks of their own, soft line breaks undone."""
    text = _apply(_apply(raw.replace("\r\n", "\n").replace("\r", "\n"), "markup"), "layout")
    return _apply("\n" + text, "blocks").strip(WHITE)


def normalize(raw: Column) -> Column:
    """normalized() of a column."""

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalized(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")(F.make_valid_utf8(raw))


def struct_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl.removeprefix("struct<").removesuffix(">"))


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes, single rows aside: what is made of a text is many times its size."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            b = waiting.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                waiting += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(letter: str) -> str:
    """What letters that differ in case only have in common, as Java's matcher compares them: one by one."""
    upper = letter.upper() if len(letter.upper()) == 1 else letter.title() if len(letter.title()) == 1 else letter
    return "i" if upper == "İ" else upper.lower()


def capital(letter: Column) -> Column:
    """A small letter's capital as one letter: ẞ for ß, and the letter itself where none exists."""
    upper = F.upper(letter)
    return F.when(F.length(upper) == 1, upper).otherwise(F.translate(letter, "".join(SPREAD), "".join(SPREAD.values())))


def claim_text(text: Column) -> Column:
    """A claim's wording: one line, a capital first, an end mark last. Null counts as empty."""
    opened = lambda t: F.when(t.rlike(r"^\p{Ll}"), F.concat(capital(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
    ended = lambda t: F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))
    return let(let(squeeze(F.coalesce(text, F.lit(""))), opened), ended)


def content_tokens(text: Column) -> Column:
    """Lower-cased ASCII words of 3 letters or more that aren't stopwords, with repeats."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


_TOKEN, _STOP = re.compile(WORD), frozenset(STOPWORDS)
_LONG = re.compile(r"[a-z0-9][a-z0-9\-']{2,}")


def tokens_in(text: str | None) -> list[str]:
    """content_tokens() of one text."""
    if text and text.isascii():
        return [w for w in _LONG.findall(text.lower()) if w not in _STOP]
    return [w for x in _TOKEN.findall(text or "") if len(x) > 2 and (w := x.lower()) not in _STOP]


def key(token: Column) -> Column:
    """Two tokens match if equal, or both of KEY letters or more with the first KEY equal: if their keys are."""
    return F.substring(token, 1, KEY)


def keys(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, key))


def coverage(tokens: Column, pool_keys: Column) -> Column:
    """Share of tokens, with repeats, whose key is in the pool; null without tokens."""
    share = lambda ts, ks: F.when(F.size(ts) > 0, F.size(F.filter(ts, lambda t: F.array_contains(ks, key(t)))) / F.size(ts))
    return let(pool_keys, lambda ks: let(tokens, lambda ts: share(ts, ks)))


def sequence_repr(items: Column) -> Column:
    """['a', 'b'] as text, the form that ids are hashed from."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
