"""Structured Streaming entry points: folders of texts, polls of jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators.jobs import state_of
from quirefold.plans.pipeline import refine


def refine_folder(spark: SparkSession, source: str, target: str, checkpoint: str, skip: Iterable[str] | str | None = None) -> StreamingQuery:
    """Refine every text that is dropped into a folder; all steps work row by row, so they run on the stream itself."""
    texts = spark.readStream.format("text").option("wholetext", True).load(source)
    named = texts.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    return refine(named, "text", skip=skip).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(polls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Last state of each job from a stream of polls; state is kept per job, polls later than the watermark are dropped."""
    return (
        polls.withWatermark("polled_at", late)
        .groupBy("job_id")
        .agg(F.max_by(F.struct("job_state", "total_pages", "extracted_pages"), F.struct("polled_at", "poll_id")).alias("x"), F.count("*").alias("polls"))
        .select("job_id", "polls", state_of(F.col("x.job_state")).alias("state"), F.col("x.total_pages").alias("total_pages"))
    )


def poll_counts(polls: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Polls per hour and state."""
    return polls.withWatermark("polled_at", late).groupBy(F.window("polled_at", window), state_of(F.col("job_state")).alias("state")).count()
