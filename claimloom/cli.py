"""Command line: analyze files, score a gold folder, print a stored report."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ENGINE_VERSION
from .cuts import cut
from .operators.propose import TEMPLATE
from .plans.analyze import analyze
from .plans.report import bench, bench_report, by_stage, document_reports
from .schemas import REPLIES
from .sources import files
from .sources.transports import from_environment


def _replies(spark: SparkSession, path: str | None):
    return files.load_rows(spark, path, REPLIES) if path else None


def _analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = files.read_texts(spark, a.path)
    if a.doc_id or a.title:
        docs = docs.withColumn("doc_id", F.lit(a.doc_id) if a.doc_id else F.col("doc_id")).withColumn("title", F.lit(a.title) if a.title else F.col("title"))
    template = Path(a.template).read_text(encoding="utf-8") if a.template else TEMPLATE
    art = analyze(docs, _replies(spark, a.replies), not a.no_assemble, ask=from_environment() if a.ask else None, template=template)
    files.write_artifact(art, a.out, by_document=a.by_document)
    reports = cut(document_reports(art, docs))
    reports.write.mode("overwrite").parquet(f"{a.out}/reports")
    if a.by_document:
        reports.write.mode("overwrite").partitionBy("doc_id").text(f"{a.out}/markdown")
    for s in art.stats.limit(20).collect():
        print(f"{s['doc_id']}: {s['accepted']} claims, {s['points']} points, {s['theses']} theses ({s['rejected']} rejected) -> {a.out}")
    return 0


def _report(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.parquet(f"{a.path}/reports")
    for r in (rows.where(F.col("doc_id") == a.doc_id) if a.doc_id else rows.orderBy("doc_id")).toLocalIterator():
        print(r["report"])
    return 0


def _bench(spark: SparkSession, a: argparse.Namespace) -> int:
    docs, labels = files.read_gold(spark, a.gold)
    replies = _replies(spark, a.replies)
    store = f"{a.out}/store"
    held = files.kept(spark, store) if a.reuse else None
    todo = cut(files.not_stored(docs, held["stats"]) if held else docs)
    if todo.take(1):
        art = analyze(todo, replies)
        files.keep(art, store)
        held = {k: df.unionByName(getattr(art, k), allowMissingColumns=True) for k, df in held.items()} if held else art._asdict()
    rows, micro = map(cut, bench(SimpleNamespace(**held), labels, replies if a.judge else None))
    files.write_rows(rows, f"{a.out}/docs")
    files.write_rows(micro, f"{a.out}/summary")
    report = bench_report(rows, micro)
    got = [r.asDict(recursive=True) for r in rows.orderBy("doc_id").toLocalIterator()]
    files.write_json({"summary": micro.first().asDict() | {"judge": a.judge, "rejected_by_stage": by_stage(got)}, "docs": got}, f"{a.out}/results.json")
    files.write_text(report, f"{a.out}/report.md")
    print(report)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="claimloom")
    top.add_argument("--version", action="version", version=ENGINE_VERSION)
    sub = top.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("analyze", help="claims, points and theses of text files")
    p.add_argument("path")
    p.add_argument("--doc-id")
    p.add_argument("--title")
    p.add_argument("--replies", help="JSON lines of model replies; without it sentences propose themselves")
    p.add_argument("--ask", action="store_true", help="ask the service that the environment names for what replies lack")
    p.add_argument("--template", help="a file with the prompt for a window")
    p.add_argument("--out", default="out")
    p.add_argument("--no-assemble", action="store_true")
    p.add_argument("--by-document", action="store_true", help="a folder for each document, its report as text among them")
    p.set_defaults(fn=_analyze)
    p = sub.add_parser("report", help="print stored reports")
    p.add_argument("path")
    p.add_argument("--doc-id")
    p.set_defaults(fn=_report)
    p = sub.add_parser("bench", help="score a folder of docs/*.md and labels/*.json")
    p.add_argument("--gold", default="gold")
    p.add_argument("--replies")
    p.add_argument("--judge", action="store_true", help="let stored verdicts add matches")
    p.add_argument("--reuse", action="store_true", help="analyze only documents that the folder of results doesn't have yet")
    p.add_argument("--out", default="bench_out")
    p.set_defaults(fn=_bench)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("claimloom").getOrCreate()
    return a.fn(spark, a)


if __name__ == "__main__":
    sys.exit(main())
