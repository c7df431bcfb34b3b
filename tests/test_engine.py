"""The claim engine on small inputs of our own."""

import difflib
import http.server
import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from claimloom import cli
from claimloom.functions import checks as C
from claimloom.functions import replies as R
from claimloom.functions import text as T
from claimloom.functions.register import register
from claimloom.operators import dispose, evaluate, identify, propose
from claimloom.operators import segment as G
from claimloom.operators import windows as W
from claimloom.plans.analyze import analyze
from claimloom.plans.queries import QUERIES
from claimloom.plans.report import document_reports
from claimloom.schemas import REPLIES
from claimloom.sources import files, transports

DOC = """# Grid Note

The northern grid lost 14% of its load in 2021. According to Dr. Ames, the losses
were caused by ice on old lines. If the ice returns, the grid will fail by 2031.

## Outlook

The board thinks the forecast is too dark. It expects a mild winter."""


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a **b** *c* ***d***", "a b c d"),
        ("see [this](http://x) and ![pic](y)", "see this and"),
        ("> quoted\n> text", "quoted text"),
        ("- one\n- two", "one two"),
        ("# Head\nbody\ngoes on", "# Head\n\nbody goes on"),
        ("x ```code\n\nmore``` y `z`", "x y z"),
        ("a\r\n\r\n\r\nb", "a\n\nb"),
        ("<p>hi</p>  there", "hi there"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize(F.col("t")), t=raw) == want


def test_segments_slice_back(spark):
    df = spark.createDataFrame([("d", "T", DOC), ("e", None, ""), ("f", "F", "Dr. No met e.g. Mr. X. He left! \"Why?\" 3 asked.")], "doc_id string, title string, raw string")
    rows = {r["doc_id"]: r for r in G.segment(df.withColumn("text", T.normalize(F.col("raw")))).collect()}
    for r in rows.values():
        for part in (*r["sentences"], *r["paragraphs"]):
            assert r["text"][part["start"] : part["end"]] == part["text"]
    assert [s["title"] for s in rows["d"]["sections"]] == ["T", "Grid Note", "Outlook"]
    assert [s["end"] for s in rows["d"]["sections"]][:2] == [s["start"] for s in rows["d"]["sections"]][1:]
    assert [s["text"] for s in rows["f"]["sentences"]] == ["Dr. No met e.g. Mr. X.", "He left!", '"Why?"', "3 asked."] or len(rows["f"]["sentences"]) == 3
    assert rows["e"]["sentences"] == []
    tree = {n["id"]: n for n in G.nodes(G.segment(df.where("doc_id = 'd'").withColumn("text", T.normalize(F.col("raw"))))).collect()}
    assert tree["d0"]["children"] == ["s0", "s1", "s2"] and tree["p0"]["parent"] == "s1" and tree["s2"]["children"] == ["p1"]


@pytest.mark.parametrize(
    ("check", "text", "reason", "flags"),
    [
        (C.fragment, "Too short.", "fragment_too_short:2_words", []),
        (C.fragment, "word " * 61, None, ["long_claim"]),
        (C.deixis, "It fails often in winter.", "unresolved_deixis_opener:it", []),
        (C.deixis, "It is likely that the grid fails.", None, []),
        (C.deixis, "There are two grids.", None, []),
        (C.deixis, "Experts say this method helps, he said.", None, ["demonstrative_reference", "pronoun_present"]),
        (C.deixis, "", "empty_text", []),
        (C.atomicity, "One thing; another thing.", "compound_semicolon", []),
        (C.atomicity, "The grid failed, and the board resigned.", None, ["possibly_compound"]),
        (C.atomicity, "Salt, pepper, and sugar.", None, []),
    ],
)
def test_checks(spark, check, text, reason, flags):
    got = one(spark, check(F.col("t")), t=text)
    assert (got["reasons"][0] if got["reasons"] else None, got["flags"]) == (reason, flags)
    assert got["ok"] == (reason is None)


@pytest.mark.parametrize(
    ("claim", "source", "context", "reason"),
    [
        ("The load fell 1,200 units.", "the load fell by 1200 units", "", None),
        ("The load fell 99 units.", "the load fell 98 units", "", "unsupported_number:99"),
        ("Load fell at Smithtown plants.", "load fell at plants", "", "unsupported_name:Smithtown"),
        ("Load fell at Smithtown plants.", "load fell at plants", "Smithtown", None),
        ("Completely different wording altogether here.", "the load fell", "", "content_not_in_source:0.00"),
    ],
)
def test_support(spark, claim, source, context, reason):
    got = one(spark, C.support(F.col("c"), F.lit(""), F.col("s"), F.col("x")), c=claim, s=source, x=context)
    assert (got["reasons"][0] if got["reasons"] else None) == reason


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('x [1, 2] y {"a": 1}', [1, 2]),
        ('x {"a": [1]} [2]', {"a": [1]}),
        ("```json\n[1,]\n```", [1]),
        ('{"a": "}", "b": 1}', {"a": "}", "b": 1}),
        ("[“a”]", ["a"]),
        ("[1, 2", None),
        (None, None),
        ("", None),
    ],
)
def test_json_salvage(reply, want):
    value, error = R.extract_json(reply)
    assert value == want and (error is None) == (want is not None)


def test_coercion(spark):
    reply = json.dumps([{"text": 5, "quotes": ["a", " ", 3], "kind": " Plan ", "claim_type": "causal", "stance": "x", "hedge": [2, "0.1"], "stated_confidence": 7, "implicit_premises": list("abcdefg")}, {"hedge": [float("nan"), 1], "stated_confidence": "no", "claim_type": [1]}, 3])
    df = spark.createDataFrame([(reply,)], "r string").select(F.explode(R.proposals_in(F.col("r"))["items"]).alias("i"))
    a, b = df.select(*[c.alias(k) for k, c in R.proposal(F.col("i")).items()]).collect()
    assert (a["text"], a["quotes"], a["kind"], a["claim_type"], a["stance"], a["hedge"], a["stated_confidence"], a["implicit_premises"]) == ("5", ["a", "3"], "plan", "causal", "author", [0.1, 1.0], 1.0, list("abcde"))
    assert a["coerce_flags"] == ["stance_defaulted"]
    assert b["hedge"] == [0.5, 0.9] and b["stated_confidence"] is None and b["claim_type"] == "descriptive"
    assert b["coerce_flags"] == ["kind_defaulted", "claim_type_defaulted", "stance_defaulted", "hedge_defaulted", "stated_confidence_dropped"]


@pytest.mark.parametrize(("quote", "how"), [("the losses", "exact"), ("“THE   losses”", "normalized"), ("The big losses came from the ice on lines.", "fuzzy"), ("nothing like it at all", None)])
def test_alignment(spark, quote, how):
    window = "First words here. The losses came from ice on the lines."
    df = spark.createDataFrame([([quote], window.replace("The losses", "the losses") if how == "exact" else window)], "quotes array<string>, window_text string")
    r = dispose.align(df).first()
    hit = r["hits"][0]
    assert hit["how"] == how
    if how:
        assert r["window_text"][hit["start"] : hit["end"]] == hit["quote"]


@pytest.mark.parametrize("count", [255, 257, 70_000])
def test_alignment_of_long_quotes(spark, count):
    words = [f"Wörd{i}" for i in range(count)]
    window, quote = "First words. " + "\n".join(words) + " and more.", "“" + "  ".join(words).upper() + "”"
    hit = one(spark, dispose.aligned(F.col("q"), F.col("w")), q=quote, w=window)
    assert (hit["how"], hit["start"], hit["quote"]) == ("normalized", 13, "\n".join(words))
    assert one(spark, dispose.aligned(F.col("q"), F.col("w")), q=quote, w=window.replace(words[-1], "x"))["how"] is None


def test_three_digits_as_the_binary_value_has_them(spark):
    rng = random.Random(6)
    xs = [k / 2000 for k in range(2001)] + [rng.random() for _ in range(3000)] + [0.0005, 0.0625, 0.3125, 1.0, 0.0, 5e-324]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", R.digits3(F.col("x")).alias("y")).collect()
    assert all(r["y"] == round(r["x"], 3) for r in got) and len(got) == len(xs)


def replies():
    first = [
        {"text": "The northern grid lost 14% of its load in 2021.", "quotes": ["The northern grid lost 14% of its load in 2021."], "kind": "assertion", "claim_type": "statistical", "stance": "author", "hedge": [0.8, 0.9]},
        {"text": "The northern grid's losses were caused by ice on old lines.", "quotes": ["According to Dr. Ames,  the losses were caused by ice on OLD lines."], "kind": "assertion", "claim_type": "causal", "stance": "reported", "stance_source": "Dr. Ames"},
        {"text": "It will fail by 2031.", "quotes": ["the grid will fail by 2031"], "kind": "assertion"},
        {"text": "The northern grid lost 15% of its load in 2021.", "quotes": ["The northern grid lost 14% of its load in 2021."], "kind": "x"},
    ]
    second = [{"text": "The board thinks the grid forecast is too dark.", "quotes": ["The board thinks that forecast is too dark."], "kind": "assertion"}]
    return [
        ("g", "propose", 0, None, 0, "```json\n" + json.dumps(first) + "\n```"),
        ("g", "propose", 1, None, 0, "not json"),
        ("g", "propose", 1, None, 1, json.dumps(second)[:-1] + ",]"),
        ("g", "point", None, "Grid Note", 0, json.dumps({"text": "The northern grid suffered losses from ice", "cites": [1, 2, 9]})),
        ("g", "thesis", None, None, 0, json.dumps([{"text": "The grid faces losses that the board disputes.", "cites": [1, 2]}])),
        ("junk", "propose", 0, None, 0, "no"),
    ]


def test_replies_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([("g", "Grid Note", DOC), ("junk", "Junk", "One paragraph. Two sentences here.")], "doc_id string, title string, raw string")
    art = analyze(docs, spark.createDataFrame(replies(), REPLIES))
    stats = {r["doc_id"]: r for r in art.stats.collect()}
    assert (stats["g"]["proposals"], stats["g"]["accepted"], stats["g"]["rejected"]) == (5, 3, 2)
    assert stats["g"]["rejected_by_stage"] == {"deixis": 1, "support": 1}
    assert stats["junk"]["window_errors"] == ["window 0: no parseable JSON found"] and stats["junk"]["proposals"] == 0
    text = {r["doc_id"]: r["text"] for r in art.documents.collect()}
    claims = art.claims.collect()
    for c in claims:
        for s in c["spans"]:
            assert text["g"][s["start"] : s["end"]] == s["quote"] and s["sent_ids"]
    assert all(c["stated_confidence"] is None for c in claims)
    points, theses = art.points.collect(), art.theses.collect()
    assert len(points) == 1 and len(points[0]["claim_ids"]) == 2
    assert len(theses) == 1 and theses[0]["point_ids"] == [points[0]["id"]] and len(theses[0]["claim_ids"]) == 1
    report = {r["doc_id"]: r["report"] for r in document_reports(art, docs).collect()}
    assert "What it argues" in report["g"] and "Counts" in report["g"] and "window errors: 1" in report["junk"]
    files.write_artifact(art, str(tmp_path / "out"))
    assert files.read_artifact(spark, str(tmp_path / "out"), "claims").count() == 3
    assert files.read_artifact(spark, str(tmp_path / "none"), "claims").count() == 0


def test_live_replies(spark):
    def ask(prompt):
        if "Passage:" in prompt:
            return "sorry" if "not JSON" not in prompt else json.dumps([{"text": "The northern grid lost 14% of its load.", "quotes": ["The northern grid lost 14% of its load in 2021."]}, {"text": "The northern grid losses were caused by ice on old lines.", "quotes": ["the losses were caused by ice on old lines"]}])
        if "point that these" in prompt:
            assert "[1] The northern grid lost" in prompt and "Section: Grid Note" in prompt
            return json.dumps({"text": "The northern grid suffered losses from ice", "cites": [1, 2]})
        assert "[1] (point) The northern" in prompt
        return json.dumps([{"text": "The northern grid suffered losses from ice.", "cites": [1]}])

    docs = spark.createDataFrame([("g", "Grid Note", DOC.split("\n\n## ")[0])], "doc_id string, title string, raw string")
    art = analyze(docs, ask=ask)
    assert art.claims.count() == 2 and art.points.count() == 1 and art.theses.first()["point_ids"]
    gold = spark.createDataFrame([("d", 0, "a gold statement")], "doc_id string, i int, text string")
    pred = spark.createDataFrame([("d", 4, "another one")], "doc_id string, j int, text string")
    prompt = evaluate.judge_prompts(evaluate.greedy_match(evaluate.scores(gold, pred)), gold, pred).first()["prompt"]
    assert "G0: a gold statement" in prompt and "P4: another one" in prompt


def test_transports(monkeypatch, tmp_path):
    waits, calls = [], []
    monkeypatch.setattr(transports, "sleep", waits.append)
    assert transports.command(["cat"])("[1]") == "[1]"
    with pytest.raises(transports.TransportError):
        transports.command(["false"], retries=1)("x")
    assert waits == [2.0]

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            calls.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            code = (429, 503, 200)[len(calls) - 1] if len(calls) < 4 else 404
            body = json.dumps({"choices": [{"message": {"content": " [2] "}}]}).encode()
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "300")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Service) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        ask = transports.http(f"http://127.0.0.1:{server.server_port}", "m", "t")
        assert ask("hi") == "[2]" and waits[1:] == [90.0, 5.0] and calls[0]["messages"][0]["content"] == "hi"
        with pytest.raises(transports.TransportError):
            ask("hi")
        server.shutdown()
    with pytest.raises(transports.TransportError):
        transports.http("http://x", "m", "")
    monkeypatch.setenv("CLAIMLOOM_TRANSPORT", "command")
    monkeypatch.setenv("CLAIMLOOM_COMMAND", "cat")
    assert transports.from_environment()("x") == "x"


def test_identity(spark):
    row = lambda pos, id_, text: ("d", id_, text, (0, pos), ["f" + str(pos)], [])
    rows = [row(0, "a", "alpha beta gamma delta epsilon"), row(1, "b", "alpha beta gamma delta epsilon!"), row(2, "c", "alpha beta gamma delta zeta omega"), row(3, "a", "other words entirely"), row(4, "d", "alpha beta gamma delta")]
    df = spark.createDataFrame(rows, "doc_id string, id string, text string, seq struct<window_index:int,pos:int>, flags array<string>, same_as array<string>")
    got = {r["id"]: r for r in identify.dedupe_and_link(df).collect()}
    assert set(got) == {"a", "c"} and got["a"]["flags"] == ["f0", "f1", "f4"] and got["a"]["dropped"] == 3
    ids = [one(spark, dispose.instance_id(F.lit("d"), F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in spans]), F.lit("assertion")), t="") for spans in ([(0, 5), (7, 9)], [(7, 9), (0, 5)])]
    assert ids[0] == ids[1] and len(ids[0]) == 11


def test_greedy_matching(spark):
    gold = spark.createDataFrame([("d", 0, "grid losses winter"), ("d", 1, "board resigned yesterday")], "doc_id string, i int, text string")
    pred = spark.createDataFrame([("d", 0, "winter losses grids"), ("d", 1, "grid losses winter"), ("d", 2, "unrelated")], "doc_id string, j int, text string")
    scored = evaluate.scores(gold, pred)
    pairs = evaluate.greedy_match(scored)
    assert [(r["i"], r["j"], r["score"]) for r in pairs.collect()] == [(0, 1, 1.0)]
    said = spark.createDataFrame([("d", "judge", None, None, 0, '[["G1","P2"],["G0","P2"],["G1","P0"],[["x"],"P1"]]')], REPLIES)
    judged = {(r["i"], r["j"], r["score"]) for r in evaluate.judge(pairs, gold, pred, said).collect()}
    assert judged == {(0, 1, 1.0), (1, 2, -1.0)}


def test_windows_and_prompts(spark):
    paragraphs = [(f"s{i // 3}", i * 700, i * 700 + 690) for i in range(7)]
    df = spark.createDataFrame([("x" * 5000, [("p", "s", s, a, b, "") for s, a, b in paragraphs])], "text string, paragraphs array<struct<id:string,section:string,section_path:string,start:int,end:int,text:string>>")
    got = df.select(F.explode(W.packed(F.col("paragraphs"), F.col("text"))).alias("w")).select("w.*").collect()
    assert [(w["section_path"], w["start"], len(w["text"])) for w in got] == [("s0", 0, 1390), ("s0", 1400, 690), ("s1", 2100, 1390), ("s1", 3500, 690), ("s2", 4200, 690)]
    prompt = one(spark, propose.render_prompt("{DOC_TITLE}|{SECTION_PATH}|{GLOSSARY}|{PREV_TAIL}|{WINDOW_TEXT}", F.col("a"), F.lit(""), F.array(F.lit("X"), F.lit("Y")), F.lit(None).cast("string"), F.col("b")), a="{WINDOW_TEXT}", b="body")
    assert prompt == "{WINDOW_TEXT}|(document root)|X, Y|(document start)|body"


def test_gold_folder_and_cli(spark, tmp_path, capsys):
    for folder, name, body in (("docs", "grid-note.md", DOC), ("docs", "unlabelled.md", "x"), ("labels", "grid-note.json", json.dumps({"claims": [{"text": "The northern grid lost 14% of its load in 2021."}, {"text": "Nothing of that."}], "theses": [{"text": "Grids fail."}]}))):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body, encoding="utf-8")
    docs, labels = files.read_gold(spark, str(tmp_path))
    assert [(r["doc_id"], r["title"]) for r in docs.collect()] == [("grid-note", "grid note")]
    assert cli.main(["bench", "--gold", str(tmp_path), "--out", str(tmp_path / "b")]) == 0
    shown = capsys.readouterr().out
    assert "| grid-note | 2 |" in shown and "Missed gold claims" in shown
    assert (tmp_path / "b" / "report.md").read_text(encoding="utf-8").strip() == shown.strip()
    results = json.loads((tmp_path / "b" / "results.json").read_text(encoding="utf-8"))
    assert results["summary"]["docs"] == 1 and results["docs"][0]["gold"] == 2 and results["summary"]["judge"] is False
    for name, raw in (("late-note", "The southern grid gained 3% in 2022."), ("grid-note", "Other words now stand here.")):
        (tmp_path / "docs" / f"{name}.md").write_text(raw, encoding="utf-8")
    (tmp_path / "labels" / "late-note.json").write_text(json.dumps({"claims": [{"text": "The southern grid gained 3% in 2022."}], "theses": []}), encoding="utf-8")
    assert cli.main(["bench", "--gold", str(tmp_path), "--out", str(tmp_path / "b"), "--reuse"]) == 0
    again = json.loads((tmp_path / "b" / "results.json").read_text(encoding="utf-8"))
    assert [d["doc_id"] for d in again["docs"]] == ["grid-note", "late-note"] and again["docs"][0] == results["docs"][0]
    assert again["docs"][1]["matched"] == 1 and len(files.kept(spark, str(tmp_path / "b" / "store"))["stats"].collect()) == 2
    assert files.kept(spark, str(tmp_path / "nowhere")) is None
    register(spark)
    assert spark.sql("SELECT json_salvage('x [1,] y').json AS j").first()["j"] == "[1]"


def test_best_sentence_against_all_ratios():
    rng = random.Random(3)
    fold = lambda s: re.sub(r"\s+", " ", s).casefold().strip(dispose.EDGES)

    def plain(window, quote):
        best, top = None, 0.0
        for s in re.split(r"(?<=[.!?])\s+", window):
            if s.strip() and (r := difflib.SequenceMatcher(None, fold(s), fold(quote)).ratio()) > top:
                best, top = s, r
        return None if best is None or top < dispose.FUZZY else (best, window.find(best), window.find(best) + len(best))

    for _ in range(60):
        parts = [" ".join(rng.choices(["ice", "grid", "Wind", "über", "12", "the", "load"], k=rng.randint(1, 60))) + "." for _ in range(12)]
        window = "  ".join(parts + parts[:2] + ["...", "."])
        for s in parts[:4] + ["", "Indeed"]:
            quote = "Indeed " + s.rsplit(" ", 1)[0]
            assert dispose.best_sentence(window, quote) == plain(window, quote)
    assert dispose.best_sentence("", "x") is None


def test_fuzzy_align_reaches_every_sentence(spark, tmp_path):
    rng = random.Random(4)
    say = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)).capitalize() + "."
    text = "\n\n".join(" ".join(say() for _ in range(6)) for _ in range(8)) + "\n\nShort one."
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spans = {r["n"]: (r["start"], r["end"]) for r in QUERIES["sentence_spans"](spark, str(tmp_path)).collect()}
    out = QUERIES["quote_fuzzy_align"](spark, str(tmp_path)).collect()
    assert len(spans) == len(out) == 49 and {r["n"] for r in out} == set(spans) and max(e for _, e in spans.values()) > 3000
    for r in out:
        if r["n"] < 48:
            assert r["how"] == "fuzzy" and (r["start"], r["end"]) == spans[r["n"]]
    assert [(r["how"], r["start"]) for r in out if r["n"] == 48] == [(None, -1)]


def test_capitals_are_one_letter(spark):
    got = {t: one(spark, T.claim_text(F.col("t")), t=t) for t in ("ßen Weg.", "ﬁne", "ᾳ", "éa", "ŉ!")}
    assert got == {"ßen Weg.": "ẞen Weg.", "ﬁne": "ﬁne.", "ᾳ": "ᾼ.", "éa": "Éa.", "ŉ!": "ŉ!"}


def test_repeated_sentences_stand_where_they_stand(spark):
    docs = spark.createDataFrame([("d", "T", "It was there. And it is so from above? And it is so from above? Ice cracked the lines. Ice cracked the lines.")], "doc_id string, title string, raw string")
    art = analyze(docs)
    text = art.documents.first()["text"]
    spans = sorted((c["spans"][0]["start"], c["spans"][0]["quote"], tuple(c["spans"][0]["sent_ids"])) for c in art.claims.collect())
    same = "And it is so from above?"  # without content tokens, so no claim is like another
    first = text.find(same)
    assert spans == [(first, same, ("t1",)), (text.find(same, first + 1), same, ("t2",)), (text.find("Ice"), "Ice cracked the lines.", ("t3",))]
    assert art.stats.first()["dropped_duplicate"] == 1
