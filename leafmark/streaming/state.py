"""Incremental operators: each as a batch function over event tables and, where it keeps state, as a streaming query.

Events are (user_id, ts, ...); a user stands for a page's session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_time(events: DataFrame) -> DataFrame:
    """ts as TIMESTAMP, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, started, fires_at, n: bursts of events, each of which causes one rescan after a quiet gap. Works on
    batches and on streams (with_watermark first)."""
    bursts = events.groupBy(F.session_window("ts", gap).alias("burst"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return bursts.select("user_id", F.col("burst.start").alias("started"), F.col("burst.end").alias("fires_at"), "n")


def debounced_stream(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return debounced(with_time(stream).withWatermark("ts", late), gap)


def signature_changes(events: DataFrame, signature: str = "event_type") -> DataFrame:
    """The events whose signature differs from their user's event before: what a suppressing sink lets through."""
    before = F.lag(signature).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(signature))).drop("before")


def recent_distinct(events: DataFrame, k: int = 6, value: str = "event_type") -> DataFrame:
    """user_id, value, rank: the k values last seen of each user, the latest first."""
    last = events.groupBy("user_id", value).agg(F.max(F.struct("ts", "event_id")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))
    return last.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("user_id", value, "rank")


def alive(events: DataFrame, minutes: int = 10, value: str = "event_type") -> DataFrame:
    """The latest event of each user and value that is at most so old at the table's end (a cache with time to live)."""
    latest = events.groupBy("user_id", value).agg(F.max("ts").alias("ts"))
    now = events.agg(F.max("ts").alias("now"))  # one row
    return latest.join(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr(f"interval {minutes} minutes")).drop("now")


def in_request_order(events: DataFrame, request: str = "event_id") -> DataFrame:
    """Events whose request number is the largest so far of their user; older answers that come late are dropped."""
    so_far = F.max(request).over(Window.partitionBy("user_id").orderBy("ts", F.desc(request)).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("so_far", so_far).filter(F.col("so_far").isNull() | (F.col(request) > F.col("so_far"))).drop("so_far")


def deduplicated_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One event for each number, within the watermark."""
    return with_time(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def route_changes(events: DataFrame) -> DataFrame:
    """user_id, visits, changes: how often the route (event type) of a user changed."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    marked = events.withColumn("changed", (before.isNotNull() & (before != F.col("event_type"))).cast("long"))
    return marked.groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"), F.sum("changed").alias("changes"))
