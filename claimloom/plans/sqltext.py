"""DuckDB SQL with which the catalogue's results are compared."""

from __future__ import annotations

from ..functions import checks as C
from ..functions import text as T
from ..operators import segment as G
from ..operators import windows as W
from ..schemas import STANCES

NL = "chr(10)"


def text_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sub(t: str, pattern: str, to: str = "''") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({t}, '{pattern}', {to}, 'g')"


def strip(t: str) -> str:
    return sub(t, r"^\s+|\s+$")


def emphasis(t: str) -> str:
    # one alternative for each mark, since there are no back references here
    marks = [r"\*\*\*", r"\*\*", r"\*", "___", "__", "_"]
    return sub(t, "|".join(rf"{m}(\S|\S.*?\S){m}" for m in marks), r"'\1\2\3\4\5\6'")


def normalize(t: str) -> str:
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for pattern, to in ((r"(?s)```.*?```", "' '"), (r"!\[[^\]]*\]\([^)]*\)", "' '"), (r"\[([^\]]+)\]\([^)]*\)", r"'\1'"), (r"\[([^\]]+)\]\[[^\]]*\]", r"'\1'"), (r"`([^`]*)`", r"'\1'"), (r"</?[a-zA-Z][^>]*>", "' '")):
        t = sub(t, pattern, to)
    t = emphasis(emphasis(t))
    t = sub(sub(t, r"(?m)^\s{0,3}>\s?"), r"(?m)^\s{0,6}(?:[-*+]|\d{1,3}[.)])\s+")
    t = sub(sub(t, r"[ \t]+", "' '"), r"(?m)^[ \t\r\f\v]+|[ \t\r\f\v]+$")
    t = sub(f"({NL} || {t})", r"\n(#{1,6} [^\n]*)", rf"{NL} || {NL} || '\1' || {NL} || {NL}")
    t = sub(t, r"\n{3,}", f"{NL} || {NL}")
    t = f"replace(replace(replace({t}, {NL} || {NL}, chr(1)), {NL}, ' '), chr(1), {NL} || {NL})"
    return strip(sub(t, r"[ \t]+", "' '"))


def marked(t: str) -> str:
    short = "|".join(a.replace(".", r"\.") for a in G.ABBREVIATIONS)
    t = sub(t, r"""([.!?]["')\]]*)(\s+["'(\[]*[A-Z0-9])""", r"'\1' || chr(1) || '\2'")
    t = sub(t, rf"(?i)({short})\x01", r"'\1'")
    return sub(t, r"((?:^|[^\pL\pN_])[A-Za-z]\.)\x01", r"'\1'")


def claim_text(t: str) -> str:
    t = strip(sub(t, r"\s+", "' '"))
    capital = f"CASE WHEN regexp_matches({t}, '^\\p{{Ll}}') THEN upper({t}[1:1]) || {t}[2:] ELSE {t} END"
    return f"CASE WHEN {t} = '' OR regexp_matches({t}, '[.!?]$') THEN {capital} ELSE {capital} || '.' END"


def tokens(t: str) -> str:
    found = f"list_transform(regexp_extract_all({t}, '{T.WORD.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x))"
    return f"list_filter({found}, lambda x: length(x) > 2 AND NOT list_contains({text_list(T.STOPWORDS)}, x))"


def words(t: str) -> str:
    return rf"regexp_extract_all({t}, '\S+')"


def opener(t: str) -> str:
    first = sub(f"coalesce({words(t)}[1], '')", "^[\"']+|[\"']+$")
    return sub(f"lower({first})", ",+$")


def fragment(t: str) -> str:
    return f"CASE WHEN len({words(t)}) < {C.MIN_WORDS} THEN 'fragment_too_short:' || len({words(t)}) || '_words' END"


def deixis(t: str) -> str:
    o = opener(t)
    excused = f"(({o} = 'it' AND regexp_matches({t}, '{C.PLEONASTIC_IT}')) OR ({o} = 'there' AND regexp_matches({t}, '{C.EXISTENTIAL_THERE}')))"
    return f"CASE WHEN len({words(t)}) = 0 THEN 'empty_text' WHEN list_contains({text_list(C.DEIXIS_OPENERS)}, {o}) AND NOT {excused} THEN 'unresolved_deixis_opener:' || {o} END"


def compound(t: str) -> str:
    tail = rf"{words(f'regexp_extract({t}, {chr(39)}{C.COORDINATED}{chr(39)}, 1)')}[1:7]"
    return f"len(list_filter({tail}, lambda w: regexp_matches(w, '{C.FINITE}') OR regexp_matches(w, '{C.PARTICIPLE}'))) > 0"


def atomicity(t: str) -> str:
    return f"CASE WHEN contains({t}, '; ') THEN 'compound_semicolon' END"


#: blk: the blocks of a text with their place; par: paragraphs; sent: sentences.
def segmented(source: str) -> str:
    """CTEs over source (doc_id, t), t normalized."""
    return rf"""
blk AS (SELECT doc_id, unnest(string_split(t, {NL} || {NL})) AS b, unnest(range(1, len(string_split(t, {NL} || {NL})) + 1)) AS i, length(t) AS n FROM {source}),
blo AS (SELECT *, CAST(coalesce(sum(length(b) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM blk),
seen AS (SELECT *, regexp_matches({strip("b")}, '^#{{1,6}}\s+[^\n]*$') AS head FROM blo WHERE regexp_matches(b, '\S')),
sec AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS s FROM seen),
par AS (SELECT doc_id, i, pos AS p_start, pos + length(b) AS p_end, b, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM sec WHERE NOT head),
pcs AS (SELECT doc_id, i, p, p_start, string_split({marked("b")}, chr(1)) AS ps FROM par),
pc AS (SELECT doc_id, i, p, p_start, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS k FROM pcs),
po AS (SELECT *, CAST(coalesce(sum(length(x)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM pc),
sent AS (SELECT doc_id, p, CAST(p_start + o + length(x) - length({sub("x", r"^\s+")}) AS BIGINT) AS s_start, {strip("x")} AS s_text,
                row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS n FROM po WHERE regexp_matches(x, '\S'))"""


DOCS = f"norm AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, {normalize('text')} AS t FROM documents)"
TALK = f"""raw AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg('## ' || role || ' ' || turn || {NL} || {NL} || text, {NL} || {NL} ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
norm AS (SELECT doc_id, {normalize('t')} AS t FROM raw)"""
SENT = f"WITH {DOCS}, {segmented('norm')}"
PARTS = f"WITH RECURSIVE {TALK}, {segmented('norm')}"
TURNS = "turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS w FROM conversations)"


def names(t: str) -> str:
    t = sub(t, r"[^\x00-\x7F]", "'_'")  # letters beyond ASCII are word characters, no borders
    cleaned = f"list_transform(regexp_extract_all({t}, '{W.NAME}'), lambda x: array_to_string(list_filter(string_split_regex(x, '\\s+'), lambda y: NOT list_contains({text_list(W.STOP_CAPS)}, y)), ' '))"
    return f"list_filter({cleaned}, lambda x: length(x) >= 3)"


def overlap(a: str, b: str) -> str:
    """Of two lists of distinct tokens."""
    keys = lambda x: f"list_transform({x}, lambda t: left(t, {T.KEY}))"
    hits = lambda x, y: f"len(list_filter({x}, lambda t: list_contains({keys(y)}, left(t, {T.KEY}))))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN ({hits(a, b)} + {hits(b, a)}) / (len({a}) + len({b})) ELSE 0.0 END"


STANCE_LIST = text_list(STANCES)
