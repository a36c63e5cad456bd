"""Streaming over the trace log; an addition, the batch sinks and scans do without it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "trace_id string, timestamp timestamp, query string, refused boolean, analysis struct<intent: string, product_area: string>"


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def intent_counts(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Questions and refusals by intent in tumbling windows; traces later than ``late`` are left out."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), F.col("analysis.intent").alias("intent")).agg(F.count("*").alias("questions"), F.count(F.when(F.col("refused"), 1)).alias("refused"))


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append traces as JSON once each, micro-batch by micro-batch."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def closed_counts(spark: SparkSession, path: str, target: str, checkpoint: str, window: str = "10 minutes", late: str = "30 minutes", files: int | None = None) -> None:
    """Take in what has come to the log at ``path`` since the last call and append the counts of the windows that are closed to ``target``.

    One run over what is there (``files`` of them at a time): the checkpoint keeps the
    place in the log and the open windows, so a run that is killed, or the next one,
    goes on from there and no trace counts twice. A window closes when a trace comes that
    is ``late`` after its end; traces of closed windows are left out.
    """
    reader = spark.readStream.schema(SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)
    counts = intent_counts(stream, window, late).select(F.col("window.start").alias("start"), "intent", "questions", "refused")
    query = counts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
