"""Stateful vehicle features as windows: the batch twin of the streaming operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.config import DEFAULT, Config
from headway.functions.columns import haversine_m


def enrich(rows: DataFrame, c: Config = DEFAULT, ttl: bool = False) -> DataFrame:
    """Adds the features to rows of telemetry, in order of arrival (offset) within a vehicle.

    ``ttl``: state ends where the next event is more than the time-to-live later.
    """
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    rows = rows.withColumns({"speed_ms": zero("speed_ms").cast("double"), "delay_seconds": zero("delay_seconds"), "door_status": zero("door_status"), "heading": zero("heading")})
    keys = ["vehicle_id"]
    if ttl:
        arrival = Window.partitionBy("vehicle_id").orderBy("kafka_offset")
        gap = F.col("event_time_ms") - F.lag("event_time_ms").over(arrival) > c.state_ttl_ms
        rows = rows.withColumn("_gap", gap.cast("int")).withColumn("session", F.coalesce(F.sum("_gap").over(arrival), F.lit(0))).drop("_gap")
        keys.append("session")
    w = Window.partitionBy(*keys).orderBy("kafka_offset")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.col("speed_ms") < c.stop_speed_ms
    prev = lambda x: F.lag(x).over(w)
    first = lambda x, v: F.coalesce(x, F.lit(v))
    out = rows.withColumns({
        "delay_trend": F.col("delay_seconds") - first(F.avg("delay_seconds").over(w.rowsBetween(-c.history, -1)), 0.0),
        "speed_trend": first(F.col("speed_ms") - prev("speed_ms"), 0.0),
        "distance_since_last_m": first(haversine_m(prev("latitude"), prev("longitude"), F.col("latitude"), F.col("longitude")), 0.0),
        "time_since_last_ms": first(F.col("event_time_ms") - prev("event_time_ms"), 0),
        "is_stopped": stopped,
        "is_arrival": first(F.col("next_stop_id") != prev("next_stop_id"), False),
        "_moved": first(F.max(F.when(~stopped, F.col("kafka_offset"))).over(before), -1),
        "_opened": first(F.max(F.when(F.col("door_status") == 0, F.col("kafka_offset"))).over(before), -1),
    })
    island = Window.partitionBy(*keys, "_moved").orderBy("kafka_offset").rowsBetween(Window.unboundedPreceding, -1)
    door = Window.partitionBy(*keys, "_opened").orderBy("kafka_offset").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumns({
        "stopped_duration_ms": first(F.col("event_time_ms") - F.first(F.when(stopped, F.col("event_time_ms")), True).over(island), 0),
        "door_open_duration_ms": first(F.col("event_time_ms") - F.first(F.when(F.col("door_status") == 1, F.col("event_time_ms")), True).over(door), 0),
    }).drop("_moved", "_opened")


def arrivals(enriched: DataFrame) -> DataFrame:
    """Stop arrivals: the next stop differs from the one before; the dwell time is not known yet."""
    envelope = [x for x in ("kafka_partition", "kafka_offset", "kafka_timestamp", "ingestion_time", "date") if x in enriched.columns]
    return enriched.where("is_arrival").select("vehicle_id", F.col("next_stop_id").alias("stop_id"), "line_id", "direction_id", F.col("event_time_ms").alias("arrival_time"), F.col("delay_seconds").alias("delay_at_arrival"), F.lit(None).cast("long").alias("dwell_time_ms"), "door_status", "latitude", "longitude", *envelope)
