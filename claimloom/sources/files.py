"""Reading documents, labels, replies and stored rows; writing artifacts. All by Spark's readers."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analyze import Artifact
from ..schemas import CLAIMS, GOLD, POINTS, REJECTIONS, REPLIES, STATS, THESES

SCHEMAS = {"claims": CLAIMS, "points": POINTS, "theses": THESES, "rejections": REJECTIONS, "stats": STATS, "replies": REPLIES}


def _stem(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1"))


def read_texts(spark: SparkSession, path: str, blanks: str = "-_") -> DataFrame:
    """doc_id, title, raw: one row per file; the title is the name with `blanks` as spaces."""
    files = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("raw"))
    return files.select("doc_id", F.translate("doc_id", blanks, " " * len(blanks)).alias("title"), "raw")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, claims, theses of JSON label files."""
    return spark.read.schema(GOLD).json(path, multiLine=True).select(_stem(F.col("_metadata.file_path")).alias("doc_id"), "claims", "theses")


def gold_texts(labels: DataFrame, kind: str) -> DataFrame:
    """doc_id, i, text of the labels' claims or theses."""
    return labels.select("doc_id", F.posexplode(kind).alias("i", "x")).select("doc_id", "i", "x.text")


def read_gold(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents with labels, labels) of a folder with docs/*.md and labels/*.json."""
    labels = read_labels(spark, f"{folder}/labels/*.json")
    return read_texts(spark, f"{folder}/docs/*.md", "-").join(labels.select("doc_id"), "doc_id", "left_semi"), labels


def load_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; none if there is no such path. Blank lines are skipped."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines, committed as a whole."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_text(text: str, path: str) -> None:
    """One small file on this machine, there as a whole or not at all."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
    part.write_text(text, encoding="utf-8")
    os.replace(part, to)


def write_json(obj: Any, path: str) -> None:
    """One object as an indented JSON file on this machine."""
    write_text(json.dumps(obj, indent=2, ensure_ascii=False, default=str) + "\n", path)


def write_artifact(art: Artifact, path: str, format: str = "json", mode: str = "overwrite", by_document: bool = False) -> None:
    """A folder per entity, with its rows of all documents; by_document: in a folder for each."""
    for name, df in art._asdict().items():
        out = df.drop("seq", "dropped").write.mode(mode).format(format)
        (out.partitionBy("doc_id") if by_document else out).save(f"{path}/{name}")


def read_artifact(spark: SparkSession, path: str, name: str) -> DataFrame:
    return load_rows(spark, f"{path}/{name}", SCHEMAS[name])


KEPT = ("claims", "theses", "stats")


def keep(art: Artifact, path: str) -> None:
    """Adds what a bench needs of art to the store at path.

    Statistics are written last: rows of a run that didn't get that far count for nothing.
    """
    run = uuid.uuid4().hex
    for name in KEPT:
        getattr(art, name).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/{name}")


def kept(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """claims, theses and stats of the store at path, with `run`; None if nothing is stored."""
    try:
        stats = spark.read.parquet(f"{path}/stats")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    last = stats.groupBy("doc_id").agg(F.max("run").alias("run"))
    return {name: spark.read.parquet(f"{path}/{name}").join(last, ["doc_id", "run"], "left_semi") for name in KEPT}


def not_stored(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents without stored statistics: what a run that reuses results has still to do."""
    return docs.join(stored.select("doc_id"), "doc_id", "left_anti")
