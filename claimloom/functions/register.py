"""The scalar checks as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .replies import _json_text, _proposals, _udf, ITEM


def register(spark: SparkSession) -> None:
    """json_salvage(text) and parse_proposals(text) for SQL texts."""
    spark.udf.register("json_salvage", _udf(_json_text, "json string, error string"))
    spark.udf.register("parse_proposals", _udf(_proposals, f"error string, parsed boolean, items array<{ITEM}>"))
