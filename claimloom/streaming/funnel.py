"""Streams of documents: the stages of one document keep no state, so they run as they are."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def documents_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files; the schema is that of the files there now. Few files are dealt out to all cores."""
    now, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    spread = lambda s: s.repartition(cores) if len(now.inputFiles()) < cores else s
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in now.inputFiles()] == [name]:  # one file: streams read folders
        return spread(stream.option("pathGlobFilter", name).parquet(folder))
    return spread(stream.parquet(path))


def funnel(disposed: DataFrame) -> DataFrame:
    """Running counts by stage of a stream of disposed proposals."""
    return disposed.groupBy(F.coalesce("stage", F.lit("accepted")).alias("stage")).agg(F.count("*").alias("n"))


def start(counts: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Writes running counts to the in-memory table `name` until what is there now is read."""
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def funnel_once(spark: SparkSession, path: str, dispose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The funnel of all documents at path, by one run of the stream."""
    name = f"funnel_{uuid.uuid4().hex}"
    start(funnel(dispose(documents_stream(spark, path))), name).awaitTermination()
    return spark.table(name)


def unseen(claims: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Claims whose id hasn't come within the delay; later copies are dropped."""
    return claims.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doc_id", "id"])
