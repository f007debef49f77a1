"""Incremental ingestion: what the batch operators compute, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import ALLC


def allc_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Base-level rows of the files that arrive in ``folder``."""
    return spark.readStream.schema(ALLC).option("sep", "\t").option("maxFilesPerTrigger", per_batch).csv(folder)


def table_stream(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def running_bins(sites: DataFrame, bin_size: int) -> DataFrame:
    """Sums per chrom and bin over everything seen so far (state: one row per bin)."""
    return sites.groupBy("chrom", F.floor((F.col("pos") - 1) / bin_size).alias("bin")).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], window: str = "1 day", late: str = "1 day", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) per window of event time; rows more than ``late`` behind the latest are dropped and
    closed windows leave the state."""
    made = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(*made).select(F.col("window.start").alias("start"), *keys, "n", *(["total"] if value else []))


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events per session of a key: a session ends after ``gap`` without events."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream over what is there into a memory table and ends; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_to_store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appended to a Parquet store partitioned by chrom; the sink's log keeps every batch once."""
    return stream.writeStream.format("parquet").partitionBy("chrom").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
