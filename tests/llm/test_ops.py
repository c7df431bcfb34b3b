"""The training-data operators on small fixtures, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import chat, common, decontaminate, embeddings, mixing, ngramjoin, sharding, substrings, tokencounts, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long, hash long, slot string"
RNG = np.random.default_rng(0)
SF = "/root/testdata/sf0.001"
VOCAB = [f"w{i}" for i in range(400)] + ["É", "ß", "Ünï", "the", "of"]


@pytest.fixture(autouse=True)
def own_generator(request):
    global RNG
    RNG = np.random.default_rng(zlib.crc32(request.node.name.encode()))


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


def plain(n):
    return " ".join(RNG.choice(VOCAB[:400], n))


def edited(text, k):
    w = text.split(" ")
    for i in RNG.choice(len(w), k, replace=False):
        w[i] = f"e{RNG.integers(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    global RNG
    RNG = np.random.default_rng(5)
    base = [prose(60) for _ in range(12)]
    long = prose(12_000)
    out = [*base, *[edited(base[0], 1) for _ in range(14)], *[edited(base[1], 2) for _ in range(3)], base[2], base[2].upper(), "", None, " \n ", "one two", "One  TWO", "x" * 40_000, long, edited(long, 300), "a b c d e", "\u2003em space", "The "]
    return list(enumerate(out)) + [(3, base[3]), (None, base[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), 1, "x") for i, t in texts], DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    sets, up = [shingles(t) for _, t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else low.get(top(i))) for i, (d, _) in enumerate(texts)), key=repr)


def test_words_of_any_cut(monkeypatch, texts):
    import pyarrow as pa

    col = pa.array([t for _, t in texts])
    whole = common.Words(col)
    monkeypatch.setattr(common, "_STEP", 7)
    parts = common.Words(col)
    assert (whole.hash == parts.hash).all() and (whole.bounds == parts.bounds).all()
    for i, (_, t) in enumerate(texts):
        got = [whole.bytes[s:e].tobytes().decode() for s, e in zip(whole.start[whole.bounds[i] : whole.bounds[i + 1]], whole.end[whole.bounds[i] : whole.bounds[i + 1]], strict=True)]
        assert got == WORDS.findall(t or "")


def test_components(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {n: c for n, c in up.items() if any(n in e for e in edges if e[0] != e[1])}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    edges = [(1000, i) for i in range(0, 200, 2)] + [(5, i) for i in range(1, 200, 4)] + [(199, 300), (300, 301), (401, 400)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_near_duplicates(docs, texts, none, monkeypatch):
    got = lambda: sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(docs).collect()), key=repr)
    assert got() == groups(texts)
    monkeypatch.setattr(ngramjoin, "GATHER", 9)  # the path for the commonest shingles
    assert got() == groups(texts)
    monkeypatch.setattr(ngramjoin, "HOT", 6)  # of which tasks get parts
    monkeypatch.setattr(ngramjoin, "HEAVY_LEAST", 1)  # and classes of copies made once
    assert got() == groups(texts)
    assert ngramjoin.near_duplicates(none).count() == 0


def test_keep_one_goes_by_row(spark):
    base = [prose(60) for _ in range(6)]
    rows = [(1, base[0]), (None, base[0]), (None, base[1]), (None, base[2]), (None, None), (None, None), (4, base[0]), (4, base[3]), (None, base[4]), (None, base[4]), (None, edited(base[4], 1)), (6, base[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ngramjoin.keep_one(d)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == d.columns
    sure = [(1, base[0]), (None, base[1]), (None, base[2]), (None, None), (None, None), (4, base[3]), (6, base[5])]
    rest = [r for r in got if r not in sure]
    assert sorted((r for r in got if r in sure), key=repr) == sorted(sure, key=repr)
    assert len(rest) == 1 and rest[0] in {rows[8], rows[10]}


def test_classes_are_made_in_pieces(spark, texts, monkeypatch):
    import pyarrow as pa

    col = pa.array([t for _, t in texts] * 60)
    want = [ngramjoin.digest(s) for s in ngramjoin._sets(col, 5)]
    asked, sets = [], ngramjoin._sets
    monkeypatch.setattr(ngramjoin, "_sets", lambda c, n: asked.append((len(c), c.nbytes)) or sets(c, n))
    assert ngramjoin._cids(col, 5).to_pylist() == want and ngramjoin._cids(col[:0], 5).to_pylist() == []
    assert len(col) > 2000 and all(k == 1 or k <= common.PIECE_ROWS and b <= common.PIECE_BYTES for k, b in asked)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(col.to_pylist())], "doc_id long, text string").coalesce(1)
    assert [r["__cid"] for r in ngramjoin._class(d, 5).orderBy("doc_id").collect()] == want


def test_sharding(docs, texts, none, spark, tmp_path):
    out = sharding.assign(docs, shards=4, slots=64)
    assert out.count() == len(texts) and sorted(out.columns) == sorted(docs.columns + ["_slot", "shard"])
    even = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    slotted, _, first = sharding.plan(even, 4, 64)
    stats = common.cut(sharding.slot_stats(slotted, 64))
    assert first.count() == 64 and stats.agg(F.sum("rows")).first()[0] == 500
    sharding.save_map(first, str(tmp_path / "map"))
    sharding.save_map(sharding.rebalance(first, stats, 5), str(tmp_path / "map"))
    old = {r["slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 0).collect()}
    new = {r["slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    assert set(new.values()) == set(range(5)) and len(new) == 64 and 0 < sum(old[s] != new[s] for s in old) < 40
    assert sharding.assign(none, 4, 64).count() == 0


def test_hot_text_is_spread(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    slotted, hot, slot_map = sharding.plan(spark.createDataFrame(rows, "doc_id long, text string"), 8, 256)
    assert hot.count() == 1
    loads = [r["b"] for r in slot_map.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(loads) < 1.02 * min(loads)


def test_mixing(docs, texts, none, spark):
    rows = mixing.draws(docs).collect()
    assert len(rows) == len(texts)
    assert all(len(r["copies"]) <= 2 for r in rows)
    size = lambda t: len(WORDS.findall(t or ""))
    by = {}
    for i, t in texts:
        s = f"s{(i or 0) % 3}" if (i or 0) % 7 else None
        by[s] = by.get(s, 0) + size(t)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, rest = {}, set(), 1.5 * sum(by.values())
    while True:
        left = rest - sum(2 * by[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 2 * by[s] if s in full else left * weights[s] / sum(weights[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * by[s]}
        if not over:
            break
        full |= over
    assert sorted({round(r["target"], 6) for r in rows}) == sorted({round(x, 6) for x in target.values()})
    for t in {r["target"] for r in rows}:  # whole documents: short of the target by less than the longest
        own = [r for r in rows if r["target"] == t]
        taken = sum(r["size"] * len(r["copies"]) for r in own)
        assert t + 1e-6 >= taken > t - max(r["size"] for r in own) - 1
    again = {r["row"]: r["copies"] for r in mixing.draws(docs).collect()}
    assert again == {r["row"]: r["copies"] for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(len(r["copies"]) for r in rows)
    assert mixing.mix(none).count() == 0


def test_mix_tells_rows_apart(spark):
    rows = [(1, "a b c", None, "zz", None, 1), (1, "a b c", "zz", None, None, 2), (1, "a b c", None, "zz", None, 3), (None, "d e", None, "x", {"k": 1}, 4), (None, "d e", None, "x", {"k": 2}, 5), (2, "d e", None, "y", None, 6), (2, "f " * 300, None, "y", None, 7), (3, None, None, "y", None, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string, source string, m map<string,int>, mix_shard int")
    out = mixing.mix(d, 2)
    assert out.columns == [*d.columns, "_mix_shard", "mix_order"]
    got = [tuple(r)[:6] for r in out.collect()]
    wanted = {r["row"]: len(r["copies"]) for r in mixing.draws(d, 2).collect()}
    assert len(got) == sum(wanted.values()) and set(map(repr, got)) <= set(map(repr, rows))
    assert max(sum(x == r for x in got) for r in rows) <= 2
    every = mixing.mix(d, 2, budget=2.0)  # everything is wanted twice
    assert sorted(repr(tuple(r)[:6]) for r in every.collect()) == sorted(map(repr, rows * 2))


def test_mixing_of_copies(spark):
    rows = [(None, "same words here", "s")] * 3000 + [(i, f"own words {i}", "t") for i in range(1000)]
    out = mixing.draws(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size in {r["source_size"] for r in out}:
        own = [r for r in out if r["source_size"] == size]
        assert abs(sum(r["size"] * len(r["copies"]) for r in own) - own[0]["target"]) <= 3


def test_split_tree_meets_quotas(spark):
    tree = mixing.split_tree(spark.createDataFrame([(0, 100), (1, 7), (2, 0)], "sidx int, quota long"), 8)
    upto = {r["sidx"]: r["upto"] for r in tree.collect()}
    assert {k: v[-1] for k, v in upto.items()} == {0: 100, 1: 7, 2: 0} and all(v == sorted(v) for v in upto.values())
    sizes = [sum(v[j] - (v[j - 1] if j else 0) for v in upto.values()) for j in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_decontamination(docs, texts, spark, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    t = [x for _, x in texts]
    items = [(1, t[0][:120]), (2, "W9, " + t[1].upper()), (10, "one two"), (11, None), (12, "..."), (13, t[0][:120]), (14, prose(30))]
    bench = spark.createDataFrame([(i, x, "z") for i, x in items], "item_id long, text string, doc_id string")
    want = []
    for d, x in texts:
        w, hit, found = words(x), set(), set()
        for i, y in items:
            v = words(y)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = lambda **k: sorted((tuple(r) for r in decontaminate.report(docs, bench, **k).drop("items").collect()), key=repr)
    assert got() == sorted(want, key=repr) and got(block_bytes=1) == sorted(want, key=repr)
    clean = decontaminate.clean(docs, bench)
    assert decontaminate.clean(docs, bench, block_bytes=1).count() == sum(not x[5] for x in want)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    every = {tuple(r) for r in decontaminate.longest_matches(docs, bench).select("doc_id", "item_id", "item_word", "doc_word", "n_words").collect()}
    brute = set()
    for d, x in texts:
        w = words(x)
        for i, y in items:
            v = words(y)
            n = min(10, len(v))
            for a in range(len(w) - n + 1) if n else ():
                for b in range(len(v) - n + 1):
                    if w[a : a + n] == v[b : b + n] and (not a or not b or w[a - 1] != v[b - 1]):
                        m = n
                        while a + m < len(w) and b + m < len(v) and w[a + m] == v[b + m]:
                            m += 1
                        brute.add((d, str(i), b, a, m))
    assert every == brute and {tuple(r) for r in decontaminate.longest_matches(docs, bench, block_bytes=1).select("doc_id", "item_id", "item_word", "doc_word", "n_words").collect()} == brute
    longest = decontaminate.longest_matches(docs, bench).where("item_id = '2' and doc_id = 1").first()
    assert words(texts[1][1][longest["start"] : longest["end"]]) == words(texts[1][1])
    assert longest["n_words"] == 60 and longest["item_word"] == 1
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_toxicity(spark, none):
    bad = ["vile", "scum", "trash"]
    rows = [(i, prose(25) + (f" {bad[i % 3]} " + prose(5) if i % 4 == 0 else "")) for i in range(600)] + [(9000, None), (9001, "")]
    d = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, toxic double, held_out string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i % 50 else None) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) == 602 and all(0 <= s <= 1 for s in out.values())
    right = sum((out[i] >= 0.7) == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.95 and out[9000] < 0.7 and out[9001] < 0.7
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.fit(d, flipped)[1] == model[1]).all()  # held-out labels change nothing
    assert toxicity.clean(none, labels).count() == 0
    assert toxicity.clean(d, labels.limit(0)).count() == 602


def removed_by_hand(rows, min_words, passage_words):
    """(doc_id, start, end, words) of what substrings.repeats() should give for rows in order."""
    units = []
    for n, (doc, text) in enumerate(rows):
        sentences, lines, at = [], [], 0
        for line in re.split(r"\n", text or ""):
            first, held = len(sentences), []
            for m in WORDS.finditer(line):
                held.append((m[0].translate(LOW), at + m.start(), at + m.end()))
                if re.search(r"[.!?][\"')\]]{0,3}$", m[0]):
                    sentences.append(held)
                    held = []
            sentences += [held] if held else []
            if len(sentences) > first:
                lines.append((first, len(sentences) - 1))
            at += len(line) + 1
        spans = [(k, k, (k, k) in lines) for k in range(len(sentences))] + [(a, b, True) for a, b in lines if b > a]
        for k in range(len(sentences)):
            b, size = k, len(sentences[k])
            while size < substrings.TINY and b + 1 < len(sentences):
                b, size = b + 1, size + len(sentences[b + 1])
            if b > k and size >= substrings.TINY:
                spans.append((k, b, False))
        units.append((n, doc, sentences, spans))
    words = lambda ss, a, b: tuple(w for s in ss[a : b + 1] for w, _, _ in s)
    rank = lambda n, doc: (doc is not None, doc or 0, n)
    first = {}
    for n, doc, ss, spans in units:
        for a, b, _ in spans:
            key = words(ss, a, b)
            first[key] = min(first.get(key, ((9,), 0)), (rank(n, doc), a))
    out = []
    for n, doc, ss, spans in units:
        found = [x for x in spans if first[words(ss, *x[:2])] != (rank(n, doc), x[0])]
        single = {a for a, b, _ in found if a == b}
        together = {k for a, b, _ in found if b > a for k in range(a, b + 1)}
        gone = {k for a, b, line in found if line and len(words(ss, a, b)) >= min_words for k in range(a, b + 1)}
        k = 0
        while k < len(ss):
            e = k
            while e in single:
                e += 1
            if sum(len(ss[i]) for i in range(k, e) if len(ss[i]) >= substrings.TINY or i in together) >= passage_words:
                gone |= set(range(k, e))
            k = e + 1
        for k in sorted(gone):
            if k - 1 not in gone:
                e = k
                while e + 1 in gone:
                    e += 1
                out.append((doc, ss[k][0][1], ss[e][-1][2], len(words(ss, k, e))))
    return sorted(out, key=repr)


def test_substrings(spark, none):
    passage = ". ".join(plain(11).capitalize() for _ in range(6)) + "."
    rows = [(1, f"Own start here. {passage}\n{plain(9)}"), (2, f"Another text é. {passage} And a tail."), (3, "All rights reserved.\n" + plain(40)), (4, "All rights reserved."), (5, None), (6, ""), (7, passage.upper())]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, start int, removed string").coalesce(1)
    got = {r["doc_id"]: r for r in substrings.repeats(d).collect()}
    assert set(got) == {2, 4, 7} and got[2]["first_doc_ids"] == [1]
    assert rows[1][1][got[2]["start"] : got[2]["end"]] == passage
    out = {r["doc_id"]: r for r in substrings.dedup(d).collect()}
    assert out[2]["text"] == "Another text é.  And a tail." and out[7]["text"] == out[4]["text"] == "" and out[1]["text"] == rows[0][1] and out[5]["text"] is None
    assert out[2]["removed"] == "x" and len(out[2]["_removed"]) == 1 and out[1]["_removed"] is None
    assert {r["doc_id"] for r in substrings.repeats(d, min_words=4).collect()} == {2, 7}
    assert substrings.repeats(none).count() == 0 and substrings.dedup(none).count() == 0


def test_substrings_fold_ascii_only(spark):
    d = spark.createDataFrame([(1, "Über Éa stands HERE."), (2, "über éa stands here."), (3, "Über Éa  stands here.")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in substrings.repeats(d).collect()} == {3}


def test_substrings_keep_other_rows(spark):
    own, copied = plain(500), plain(60)
    rows = [(1, copied), (5, copied), (5, own), (None, copied + "."), (None, plain(50)), (None, copied + ".")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r["doc_id"], r["text"]) for r in substrings.dedup(d).collect()), key=repr)
    assert out == sorted([rows[0], (5, ""), rows[2], rows[3], rows[4], (None, "")], key=repr)


def test_substrings_of_short_units(spark):
    verse = "\n".join(f"{a} {b}!" for a, b in zip(plain(80).split(" "), range(80), strict=True))
    words = [f"v{i}" for i in range(120)]
    rows = [(1, verse), (2, f"Own words here. \n{verse}\nThe end of it."), (3, "\n".join(words)), (4, "\n".join(words[::-1])), (5, "All rights.\n" + plain(9)), (6, "All rights.\n" + plain(9))]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in substrings.repeats(d, min_words=30).collect()}
    assert set(got) == {2}  # the words of 4 are those of 3 in another order
    assert rows[1][1][got[2]["start"] : got[2]["end"]] == verse and got[2]["n_words"] == 160
    assert {r["doc_id"] for r in substrings.repeats(d).collect()} == {2, 4, 6}  # every line that repeats


@pytest.mark.parametrize("how", [(1, 30), (5, 30), (30, 12), (1, 10**9)])
def test_substrings_against_brute_force(spark, how, monkeypatch):
    pool = [plain(int(n)).capitalize() + str(RNG.choice([".", "!", '."', "", "...", "?')"])) for n in RNG.integers(1, 9, 40)]
    rows = [(int(i) if i % 9 else None, "".join(str(RNG.choice(pool)) + str(RNG.choice([" ", "\n", "  ", "\n\n"])) for _ in range(RNG.integers(1, 14)))) for i in RNG.integers(0, 60, 90)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = lambda: sorted(((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in substrings.repeats(d, *how).collect()), key=repr)
    want = removed_by_hand(rows, *how)
    assert want and got() == want
    if how == (1, 30):  # the commonest digests by broadcast
        monkeypatch.setattr(substrings, "HOT_LEAST", 5)
        assert got() == want


def test_op3_of_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in substrings.op3_substring_dedup(spark, SF).collect()), key=repr)
    assert got == removed_by_hand(rows, substrings.MIN_WORDS, substrings.PASSAGE_WORDS)


def test_op2_of_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op2_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and {r["law"] for r in rows} == {"bytes"}
    loads, places, of_text = [0] * sharding.SHARDS, {}, {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw)) and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        if not r["spread"]:
            assert of_text.setdefault(raw, r["shard"]) == r["shard"]  # equal texts stay together
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert max(loads) <= max(1.02 * sum(loads) / len(loads), max(r["size"] for r in rows))


def test_op5_of_tables(spark):
    encoding, _ = tokencounts.encoder(tokencounts.VOCABULARY, tokencounts.PATTERN)
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        raw, lines = r["text"].encode(), r["text"].split("\n")
        starts = np.cumsum([0, *(len(x.encode()) + 1 for x in lines[:-1])])
        tally, at = [0] * len(lines), 0
        for token in encoding.encode_ordinary(r["text"]):
            tally[max(k for k, x in enumerate(starts) if x <= at)] += 1
            at += len(encoding.decode_single_token_bytes(token))
        assert at == len(raw)
        want += [(r["doc_id"], k, n) for k, n in enumerate(tally) if k == 0 or starts[k] < len(raw)]
    ids = {w[0] for w in want}
    got = [(r["doc_id"], r["section"], r["n_tokens"]) for r in tokencounts.op5_token_counts(spark, SF).where(F.col("doc_id").isin(list(ids))).collect()]
    assert sorted(got) == sorted(want)


def test_ftrl_against_a_plain_loop():
    rows = [(np.sort(RNG.choice(60, 9, replace=False)).astype("<i4"), int(RNG.random() < 0.3)) for _ in range(200)]
    at, w = toxicity.ftrl(rows, 6, 2)
    seen = {}
    for x, _ in rows:
        for i in x.tolist():
            seen[i] = seen.get(i, 0) + 1
    z, n, share = {}, {}, sum(y for _, y in rows) / len(rows)
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= toxicity.L1 else (np.sign(z[i]) * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(2):
        for x, y in rows:
            places = [i for i in x.tolist() if seen[i] > 1] + [-1]
            old = {i: weight(i) for i in places}
            p = 1 / (1 + np.exp(-sum(old.values())))
            g = (p - y) * (min(1, (1 - share) / share) if y else 1)
            for i in places:
                m = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((m + g * g) ** 0.5 - m**0.5) / toxicity.ALPHA * old[i]
                n[i] = m + g * g
    want = {i: weight(i) for i in z if abs(z[i]) > toxicity.L1}
    assert want and set(want) == set(at.tolist()) and np.allclose([want[i] for i in at.tolist()], w)


def test_toxicity_columns_and_bound(spark):
    d = spark.createDataFrame([(i, "vile scum" if i % 2 else "kind words", "x", 1.0) for i in range(60)], "doc_id long, text string, score string, __score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    assert toxicity.score(d, model).columns == [*d.columns, "_score"]
    assert toxicity.clean(d, labels).columns == d.columns
    less = toxicity.fit(d, labels, max_places=40)
    assert len(less[0]) and abs(less[1]).sum() < abs(model[1]).sum()


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_tokens(docs, texts, none, rule):
    encoding, _ = tokencounts.encoder(tokencounts.VOCABULARY, tokencounts.PATTERN)
    want = sorted((i if i is not None else -1, len(encoding.encode_ordinary(t or ""))) for i, t in texts)
    rows = tokencounts.count_tokens(docs.where("doc_id is null or doc_id <> 3"), rule).collect()
    total = {}
    for r in rows:
        total.setdefault(r["doc_id"], []).append(r["n_tokens"])
        assert r["start"] <= r["end"]
    assert sum(map(sum, total.values())) == sum(n for i, n in want if i != 3)
    ends = np.array([3, 5, 9])
    starts = np.array([0, 4, 6])
    counts, crossing = tokencounts.attribute(ends, starts, 9, rule)
    assert counts.tolist() == ([2, 1, 0] if rule == "start" else [2, 0, 1]) and crossing.tolist() == [1, 1, 0]
    assert tokencounts.count_tokens(none).count() == 0


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "hi <|im_end|> &amp; <", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 3, "us\ner", "&lt;|", 1.0), (1, 5, 4, "assistant", chat.TRICKY, 0.0), (2, 7, 99, None, "orphan", None), (2, 8, 9, "user", "loop", 0.0), (2, 9, 8, "user", "loop", 0.0), (None, 1, None, "assistant", "x", 0.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    out = {(r["tree"], r["rank"]): r for r in chat.format_trees(m).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1), (None, 1)} and out[1, 1]["leaf"] == 5
    turns = chat.parse(out[1, 1]["formatted"])
    assert turns == [("user", "hi <|im_end|> &amp; <"), ("assistant", ""), ("us\ner", "&lt;|"), ("assistant", chat.TRICKY)]
    said = "".join(chat.unescape(out[1, 1]["formatted"][x["start"] : x["end"]]) for x in out[1, 1]["loss"])
    assert said == chat.TRICKY
    assert chat.format_trees(m, top=1).count() == 3 and chat.format_trees(m.limit(0)).count() == 0
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)], m.schema)
    assert [t for _, t in chat.parse(chat.format_trees(chain).first()["formatted"])] == [str(i) for i in range(70)]


def test_embeddings(spark):
    base = RNG.normal(size=(6, 16))
    rows = [(i, i % 2, (base[i % 6] * RNG.uniform(0.5, 2) + RNG.normal(size=16) * 0.13).tolist()) for i in range(300)]
    rows += [(400 + i, 0, rows[0][2]) for i in range(5)] + [(500, None, rows[0][2]), (501, 0, None), (502, 0, [0.0] * 16), (503, 0, [float("nan")] * 16), (504, 0, []), (505, 0, [1.0, None]), (506, 0, [1.0]), (507, 0, [3.0]), (5, 0, rows[0][2]), (600, 1, [1e200, 0.0]), (601, 1, [1e200, 0.0]), (602, 1, [1e-200, 0.0]), (603, 1, [1.0, 0.0]), (604, 1, [5e-324, 5e-324])]
    scaled = lambda e: np.array(e) / max(map(abs, e))
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<double>, n_links int")
    ok = [k for k, (_, l, e) in enumerate(rows) if l is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links, up = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            x, y = scaled(rows[a][2]), scaled(rows[b][2])
            if a != b and rows[a][1] == rows[b][1] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links[a] += 1
                up[top(a)] = top(b)
    low = {}
    for k in range(len(rows)):
        low[top(k)] = min(low.get(top(k), 10**9), rows[k][0])
    want = sorted((rows[k][0], links[k], low[top(k)], rows[k][0] == low[top(k)]) for k in range(len(rows)))
    got = sorted(tuple(r) for r in embeddings.near_dedup(df, block=32).collect())
    assert got == want
    assert embeddings.near_dedup(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [(i, f"https://bad.example.net/spam/{i}") for i in range(60)] + [(100 + i, f"https://bad.example.net/fine/{i}?q=/spam/") for i in range(60)]
    odd = [(900, None), (901, "no scheme"), (902, "HTTP://A.Example.ORG/es/1#x"), (903, "x://example.org"), (904, "x://example.org/en/17"), (905, "x://myexample.org/es/"), (906, "x://com/de/"), (902, "HTTP://A.Example.ORG/es/1#x")]
    pages = spark.createDataFrame([(i, u, 1) for i, u in urls + odd], "page_id long, url string, doc_id int")
    labels = spark.createDataFrame([(i, int(i >= 100), int(i < 100 and i % 2)) for i, _ in urls] + [(7, None, None)], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r for r in urlfilter.judge(pages, labels).collect()}
    assert urlfilter.judge(pages, labels).count() == len(urls + odd)
    assert {out[i]["verdict"] for i in range(60)} == {"block"} and {out[100 + i]["verdict"] for i in range(60)} == {"allow"}
    assert out[3]["template"] == "/spam/{n}"
    get = lambda i: (out[i]["host"], out[i]["path"], out[i]["rule"])
    assert get(900) == get(901) == ("", "", None)
    assert get(902) == ("a.example.org", "/es/1", "example.org/es/") and get(903) == ("example.org", "", None)
    assert get(904) == ("example.org", "/en/17", "example.org/en/1") and get(905)[2] == "org/" and get(906)[2] == "com/de/"
    assert urlfilter.judge(pages.limit(0), labels).count() == 0 and urlfilter.judge(pages, labels.limit(0)).count() == len(urls + odd)


def _verdicts(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not bad(u)), 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    return {urls[r["page_id"]]: (r["verdict"], r["template"]) for r in urlfilter.judge(pages, labels).collect()}


def test_urls_small_branch_of_a_large_host(spark):
    urls = [f"https://a.example.net/{d}/{i}" for d, n in (("fine", 3000), ("spam", 30), ("junk", 30)) for i in range(n)]
    out = _verdicts(spark, urls, lambda u: "/fine/" not in u)
    assert {v for u, v in out.items() if "/spam/" in u} == {("block", "/{junk|+1}/{n}")} and {v for u, v in out.items() if "/fine/" in u} == {("allow", "/fine/{n}")}
    many = [f"https://b.example.net/{d}{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}" for d in ("ok-", "no-") for k in range(70) for i in range(25)]
    out = _verdicts(spark, many, lambda u: "/no-aa/" in u)  # 1 of 140 branches, under a fiftieth of the pages
    assert {u for u, v in out.items() if v[0] == "block"} == {u for u in many if "/no-aa/" in u}


def test_urls_deep_branches(spark):
    urls = [f"https://a.example.net/en/a/b/c/{d}/{i}" for d in ("spam", "fine") for i in range(60)]
    urls += [f"https://a.example.net/1/2/3/4/5/6/{d}/{i}/x" for d in ("bad", "good") for i in range(60)] + ["https://a.example.net/en/a/b/c/fine/1" + "/y" * 40]
    out = _verdicts(spark, urls, lambda u: "/spam/" in u or "/bad/" in u)
    assert {u for u, v in out.items() if v[0] == "block"} == {u for u in urls if "/spam/" in u or "/bad/" in u}
    assert out[urls[0]][1] == "/*/*/*/*/spam/{n}" and out[urls[-1]][1].count("/") == 46


def tree_by_hand(urls, bad, support, z):
    """url -> (template, purity): the tree over urls that are all labelled."""
    forms = {u: tuple(re.sub(r"^[0-9]+$", "{n}", x) for x in u.split("/")[3:] if x) for u in urls}
    template = {u: () for u in urls}

    def differ(a, n, b, m):
        if not n or not m:
            return False
        p = (a + b) / (n + m)
        return abs(a / n - b / m) > z * (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    level, grown = 0, True
    while grown:
        grown, parents = False, {}
        for u in urls:
            if len(forms[u]) > level:
                parents.setdefault((u.split("/")[2], template[u]), {}).setdefault(forms[u][level], []).append(u)
        for kids in parents.values():
            every = [u for us in kids.values() for u in us]
            grown |= len(every) >= support
            rate = lambda us: sum(bad(u) for u in us)
            own = [k for k, us in kids.items() if len(every) >= support and len(us) >= support and (len(us) == len(every) or differ(rate(us), len(us), rate(every) - rate(us), len(every) - len(us)))]
            runs = []
            for k in sorted(own, key=lambda k: (rate(kids[k]) / len(kids[k]), k)):
                a, n = rate(kids[k]), len(kids[k])
                if runs and not differ(runs[-1][1], runs[-1][2], a, n):
                    runs[-1] = [runs[-1][0] + [k], runs[-1][1] + a, runs[-1][2] + n]
                else:
                    runs.append([[k], a, n])
            names = {k: r[0][0] if len(r[0]) == 1 else f"{{{min(r[0])}|+{len(r[0]) - 1}}}" for r in runs for k in r[0]}
            for k, us in kids.items():
                for u in us:
                    template[u] += (names.get(k, "*"),)
        level += 1
    template = {u: t + ("*",) * (len(forms[u]) - len(t)) for u, t in template.items()}
    base, out = sum(map(bad, urls)) / len(urls), {}
    for u in urls:
        host = [v for v in urls if v.split("/")[2] == u.split("/")[2]]
        same = [v for v in host if template[v] == template[u]]
        prior = (sum(map(bad, host)) + 10 * base) / (len(host) + 10)
        out[u] = ("/" + "/".join(template[u]), (sum(map(bad, same)) + 10 * prior) / (len(same) + 10))
    return out


def test_urls_alike_branches_merge(spark):
    urls = [f"https://a.example.net/{d}/{i}/x" for d in ("spama", "spamb", "finea", "fineb") for i in range(40)]
    out = _verdicts(spark, urls, lambda u: "/spam" in u)
    assert {v for u, v in out.items() if "/spam" in u} == {("block", "/{spama|+1}/{n}/x")} and {v for u, v in out.items() if "/fine" in u} == {("allow", "/{finea|+1}/{n}/x")}


def test_urls_against_brute_force(spark):
    names = ["alpha", "beta", "gamma", "delta", "eps"]
    urls = sorted({f"https://{RNG.choice(['h.example.net', 'g.example.net'])}/{RNG.choice(names)}/{RNG.choice(names)}/{RNG.choice(names + ['7'])}/{RNG.integers(10**6)}" for _ in range(1500)})
    odds = {n: k / 4 for k, n in enumerate(names)}
    luck = dict(zip(urls, RNG.random(len(urls)), strict=True))
    bad = lambda u: bool(luck[u] < odds[u.split("/")[4]] * odds[u.split("/")[3]])
    want = tree_by_hand(urls, bad, urlfilter.SUPPORT, urlfilter.Z)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(bad(u))) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = {urls[r["page_id"]]: (r["template"], round(r["purity"], 9)) for r in urlfilter.judge(pages, labels).collect()}
    assert got == {u: (t, round(p, 9)) for u, (t, p) in want.items()} and len({t for t, _ in got.values()}) > 5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = SF
    d = spark.read.parquet(f"{src}/documents.parquet")
    for name, df in (("documents", d.unionByName(d.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], d.schema))), ("labels", spark.read.parquet(f"{src}/labels.parquet")), ("benchmark", spark.read.parquet(f"{src}/benchmark.parquet"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{sf}/stage{k}")
        seen[name] = (before.collect(), docs.collect())
    kept = [r["doc_id"] for r in seen["n-gram Jaccard join"][1]]
    want = [d for d, _, c in groups([(r["doc_id"], r["text"]) for r in seen["n-gram Jaccard join"][0]]) if d == c]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    before, after = seen["sharding"]
    assert len(before) == len(after) and {r["shard"] for r in after} <= set(range(24))
    run = corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect()
    assert sorted(map(repr, map(tuple, run))) == sorted(repr((r["doc_id"], r["shard"])) for r in after)
