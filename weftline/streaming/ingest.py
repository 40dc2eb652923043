"""Incremental ingest: new files become rows of metrics as they arrive. An extension; the batch operators are row-local, so they run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.operators.workflow import metrics, parsed, prepared


def stream_metrics(spark: SparkSession, folder: str, schema: StructType, text: str, keep: list[str], files_per_batch: int = 64) -> DataFrame:
    """keep, status and the metrics of the texts in the Parquet files that arrive in a folder; metrics are null unless the status is ok."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    docs = prepared(rows.select(*keep, F.col(text).alias("text"), parsed(F.col(text)).alias("doc")))
    ok = F.col("doc.status") == "ok"
    return docs.select(*keep, F.col("doc.status").alias("status"), *(F.when(ok, c).alias(n) for n, c in metrics("doc", "text").items()))


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, keys, count per time window; events later than `late` behind the newest are not waited for."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("count"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "count")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Handles all files there are, then stops; a later call goes on behind them."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
