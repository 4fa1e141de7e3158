"""Spans as they arrive: duplicates dropped within a watermark, running metrics, windows, edges, and the store of traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.delivery import RunStore

WATERMARK = "30 minutes"


def timed(spans: DataFrame) -> DataFrame:
    return spans.withColumn("event_time", F.timestamp_micros(F.floor(F.col("start_unix_nano") / 1000).cast("long")))


def deduplicated(spans: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Each message once, as long as its copies arrive within the watermark; state is bounded by it."""
    keyed = timed(spans).withColumns({"trace_id": F.lower("trace_id"), "span_id": F.lower("span_id")})
    return keyed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def running_metrics(spans: DataFrame) -> DataFrame:
    """Per identity: calls, mean ms, error rate, hot; for update mode. State is a few sums for each identity."""
    got = spans.where("node_id IS NOT NULL").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.greatest("duration_ms", F.lit(0.0))).alias("ms"), F.avg(F.when(F.col("is_error"), 1.0).otherwise(0.0)).alias("errors")
    )
    return got.withColumn("hot", F.col("calls") > 1000)


def windowed_metrics(spans: DataFrame, length: str = "10 minutes", slide: str | None = None, delay: str = WATERMARK) -> DataFrame:
    """Per identity and window, for append mode: a window is final once the watermark has passed it."""
    at = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return timed(spans).withWatermark("event_time", delay).where("node_id IS NOT NULL").groupBy(at.alias("w"), "node_id").agg(
        F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("ms"), F.max("duration_ms").alias("worst_ms")
    ).select("w.start", "w.end", "node_id", "calls", "ms", "worst_ms")


def sessions(spans: DataFrame, gap: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """Stretches of a trace without longer gaps."""
    return timed(spans).withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("w"), "trace_id").agg(F.count(F.lit(1)).alias("spans")).select("w.start", "w.end", "trace_id", "spans")


def edges(spans: DataFrame, delay: str = WATERMARK, apart: str = "1 hour") -> DataFrame:
    """Children joined to parents of their trace, whichever arrives first, while both are within the watermark.

    Spans that have an event_time are taken to carry their watermark already, as `deduplicated` ones do.
    """
    keep = spans if "event_time" in spans.columns else timed(spans).withWatermark("event_time", delay)
    up = keep.select(F.lower("trace_id").alias("pt"), F.lower("span_id").alias("pv"), F.col("node_id").alias("source"), F.col("event_time").alias("at"))
    down = keep.where("parent_span_id IS NOT NULL").select(F.lower("trace_id").alias("t"), F.lower("parent_span_id").alias("p"), F.col("node_id").alias("target"), "duration_ms", "is_error", "event_time")
    near = F.expr(f"event_time BETWEEN at - INTERVAL {apart} AND at + INTERVAL {apart}")
    return down.join(up, (F.col("t") == F.col("pt")) & (F.col("p") == F.col("pv")) & near).select("t", "source", "target", "duration_ms", "is_error")


def store_batches(store: RunStore, payload: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch becomes the sorted run of its id, so a batch that is replayed replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, batch_id, payload)

    return write
