"""Streams in event time: state that a watermark bounds, for deduplication, active vehicles and message rates.

Rows that come later than the watermark allows are dropped; ``late_rows`` tells how many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

DELAY = "10 seconds"


def deduplicated(rows: DataFrame, keys: list[str], ts: str = "kafka_timestamp", delay: str = DELAY) -> DataFrame:
    """The first row of each key; a key is known for at least ``delay`` of event time after it, then forgotten."""
    return rows.where(" and ".join(f"`{k}` is not null" for k in keys)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def active_vehicles(rows: DataFrame, ts: str = "kafka_timestamp", delay: str = DELAY, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Exactly how many vehicles each sliding window has seen, once the watermark has passed its end.

    A vehicle is kept once a window, and counted when the window closes.
    """
    seen = rows.where("vehicle_id is not null").withWatermark(ts, delay).select(F.window(ts, width, slide).alias("w"), "vehicle_id").dropDuplicates(["w", "vehicle_id"])
    return seen.groupBy("w").agg(F.count("*").alias("active_vehicles")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "active_vehicles")


def message_rate(rows: DataFrame, ts: str = "kafka_timestamp", delay: str = DELAY, width: str = "10 seconds") -> DataFrame:
    """Messages of each window, and a second, once the watermark has passed its end."""
    n = rows.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return n.select(F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("per_second"))


def to_table(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Closed windows, or rows, appended exactly once: the sink's log and the checkpoint agree."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped in the query's recent batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0
