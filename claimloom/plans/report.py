"""Reports as Markdown: one document's pyramid, and a run against gold labels."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from .analyze import Artifact

QUOTE = 140


def _lines(rows: DataFrame, line: Column, name: str, *order: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"]), "\n").alias(name))


def _flagged(prefix: str, joint: str) -> Column:
    return F.when(F.size("flags") > 0, F.concat(F.lit(prefix), F.array_join("flags", joint))).otherwise(F.lit(""))


def document_reports(art: Artifact, titles: DataFrame) -> DataFrame:
    """(doc_id, report) for every document: theses, points, claims and the funnel."""
    c = F.col
    theses = _lines(art.theses, F.concat(F.lit("- **"), "text", F.lit("**"), _flagged("  ⚑ ", ", "), F.lit("\n  - support: "), F.array_join(F.concat("point_ids", "claim_ids"), ", ")), "theses", "seq")
    section = F.when(c("section_path") == "", "(root)").otherwise(c("section_path"))
    points = _lines(art.points, F.concat(F.lit("- `"), "id", F.lit("` ["), section, F.lit("] "), "text", _flagged("  ⚑ ", ", "), F.lit("\n  - claims: "), F.array_join("claim_ids", ", ")), "points", "seq")
    stance = F.when(c("stance") == "reported", F.concat(F.lit(" (reported: "), F.coalesce("stance_source", F.lit("?")), F.lit(")"))).when(c("stance") == "hypothetical", " (hypothetical)").when(c("stance") == "refuted", " (REFUTED by source)").otherwise("")
    quotes = F.array_join(F.transform("spans", lambda s: F.concat(F.lit("\n  > "), F.when(F.length(s["quote"]) <= QUOTE, s["quote"]).otherwise(F.concat(F.substring(s["quote"], 1, QUOTE - 3), F.lit("..."))))), "")
    hedge = F.format_string("[%.2f-%.2f]", F.get("hedge", F.lit(0)), F.get("hedge", F.lit(1)))
    claims = _lines(art.claims, F.concat(F.lit("- `"), "id", F.lit("` **"), F.coalesce("claim_type", "kind"), F.lit("** "), hedge, stance, _flagged(" ⚑", ","), F.lit("\n  "), "text", quotes), "claims", "seq")
    df = titles.select("doc_id", "title").join(art.stats, "doc_id")
    for part in (theses, points, claims):
        df = df.join(part.withColumnRenamed(part.columns[1], f"md_{part.columns[1]}"), "doc_id", "left")
    block = lambda head, col: F.when(c(col).isNotNull(), F.concat(F.lit(f"## {head}\n\n"), c(col), F.lit("\n\n"))).otherwise(F.lit(""))
    stages = F.array_join(F.transform(F.array_sort(F.map_entries("rejected_by_stage")), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
    funnel = F.concat(F.format_string("- windows: %d · proposals: %d · accepted: %d · rejected: %d · merged: %d\n", "windows", "proposals", "accepted", "rejected", "dropped_duplicate"), F.when(F.size("rejected_by_stage") > 0, F.concat(F.lit("- rejections by stage: "), stages, F.lit("\n"))).otherwise(""), F.when(F.size("window_errors") > 0, F.concat(F.lit("- window errors: "), F.size("window_errors").cast("string"), F.lit("\n"))).otherwise(""))
    text = F.concat(
        F.lit("# "), F.coalesce(F.nullif(c("title"), F.lit("")), "doc_id"), F.lit("\n\n`"), "doc_id", F.lit("` · engine "), "engine_version", F.lit(" · prompt "), "prompt_version", F.lit("\n\n"),
        block("What it argues", "md_theses"), block("Points by section", "md_points"), F.format_string("## Claims (%d)\n\n", "accepted"), F.coalesce(F.concat("md_claims", F.lit("\n\n")), F.lit("\n")), F.lit("## Counts\n\n"), funnel,
    )
    return df.select("doc_id", text.alias("report"))


def bench(art: Artifact | SimpleNamespace, labels: DataFrame, replies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per document, micro) metrics of an artifact (its claims, theses and stats) against labels (doc_id, claims, theses)."""
    from ..sources.files import gold_texts

    gold, gold_theses = gold_texts(labels, "claims"), gold_texts(labels, "theses")
    number = lambda df: df.select("doc_id", F.posexplode(F.array_sort(F.col("xs"))).alias("j", "x")).select("doc_id", "j", "x.text")
    collect = lambda df: number(df.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "text")).alias("xs")))
    pred, pred_theses = collect(art.claims), collect(art.theses)
    pairs = evaluate.greedy_match(evaluate.scores(gold, pred))
    if replies is not None:
        pairs = evaluate.judge(pairs, gold, pred, replies)
    thesis_pairs = evaluate.greedy_match(evaluate.scores(gold_theses, pred_theses, evaluate.THESIS_FLOOR))
    out = labels.select("doc_id")
    parts = {"gold": gold, "pred": pred, "matched": pairs, "judge_matched": pairs.where("score = -1"), "gold_theses": gold_theses, "pred_theses": pred_theses, "matched_theses": thesis_pairs}
    for name, df in parts.items():
        out = out.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    stats = art.stats.select("doc_id", "proposals", "rejected", "rejected_by_stage")
    misses = lambda df, key, name: evaluate.unmatched(df, pairs, key).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]).alias(name))
    rows = evaluate.by_document(out).join(stats, "doc_id", "left").join(misses(gold, "i", "unmatched_gold"), "doc_id", "left").join(misses(pred, "j", "unmatched_pred"), "doc_id", "left")
    total = rows.agg(F.sum("matched_theses").alias("mt"), F.sum("gold_theses").alias("gt"), F.sum("proposals").alias("proposals"), F.sum("rejected").alias("rejected"))
    micro = evaluate.micro(out).join(total.select(F.round(F.try_divide("mt", "gt"), 3).alias("thesis_recall"), "proposals", "rejected"))  # one row each
    return rows, micro


def by_stage(rows: list) -> dict[str, int]:
    """Rejections by stage over the rows of documents, most first."""
    total = Counter()
    for r in rows:
        total.update(r["rejected_by_stage"] or {})
    return dict(sorted(total.items(), key=lambda e: (-e[1], e[0])))


def bench_report(rows: DataFrame, micro: DataFrame, name: str = "run") -> str:
    """The run as Markdown; a row per document comes to the driver."""
    m, got = micro.first(), sorted(rows.toLocalIterator(), key=lambda r: r["doc_id"])
    stages = by_stage(got)
    at = " (" + ", ".join(f"{k} {n}" for k, n in stages.items()) + ")" if stages else ""
    out = [f"# Bench: {m['docs']} docs, {name}", "", f"**micro P {m['precision']} · R {m['recall']} · F1 {m['f1']} · compression {m['compression']} · thesis recall {m['thesis_recall']}**", "", f"funnel: {m['proposals']} proposals, {m['rejected']} rejected{at}", "", "| doc | gold | pred | match (judge) | P | R | F1 | compr | theses |", "|---|---|---|---|---|---|---|---|---|"]
    out += [f"| {r['doc_id']} | {r['gold']} | {r['pred']} | {r['matched']} ({r['judge_matched']}) | {r['precision']} | {r['recall']} | {r['f1']} | {r['compression']} | {r['matched_theses']}/{r['gold_theses']} |" for r in got]
    for r in got:
        for head, key in (("Missed gold claims", "unmatched_gold"), ("Unmatched predictions", "unmatched_pred")):
            if r[key]:
                out += ["", f"## {r['doc_id']}: {head}", *(f"- {t}" for t in r[key])]
    return "\n".join(out) + "\n"
