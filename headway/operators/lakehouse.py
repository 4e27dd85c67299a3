"""Silver cleaning and gold aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.config import DEFAULT, Config
from headway.functions.columns import clean_id, delay_category_gold, kmh, local_time


def keep_latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of highest offset (then partition) of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col("kafka_offset").desc(), F.col("kafka_partition").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def silver_enriched(rows: DataFrame) -> DataFrame:
    """Latest row of each (vehicle, event time) with a position; timestamps fall back to the epoch."""
    latest = keep_latest(rows, ["vehicle_id", "event_time_ms"]).where("latitude is not null and longitude is not null")
    text = F.col("timestamp") if "timestamp" in rows.columns else F.lit(None).cast("string")
    ts = F.when(text.isNotNull(), F.try_to_timestamp(text)).otherwise(F.timestamp_millis("event_time_ms"))
    out = latest.withColumns({"door_status": F.col("door_status").cast("int"), "delay_seconds": F.col("delay_seconds").cast("int"), "speed_kmh": kmh(F.col("speed_ms")), "timestamp": ts})
    if "is_stopped" in rows.columns:
        out = out.withColumn("is_stopped", F.col("is_stopped").cast("boolean"))
    return out.withColumn("event_timestamp", F.col("timestamp"))


def silver_stop_events(rows: DataFrame) -> DataFrame:
    latest = keep_latest(rows.where("vehicle_id is not null"), ["vehicle_id", "stop_id", "arrival_time"])
    return latest.withColumns({"arrival_timestamp": F.timestamp_millis("arrival_time"), "delay_at_arrival": F.col("delay_at_arrival").cast("int"), "door_status": F.col("door_status").cast("int")})


def daily_metrics(silver: DataFrame, c: Config = DEFAULT) -> DataFrame:
    on_time = delay_category_gold(F.col("delay_seconds"), c) == "on_time"
    return silver.groupBy("line_id", "date").agg(
        F.count("*").alias("total_events"),
        F.avg("delay_seconds").alias("avg_delay_seconds"),
        F.avg("speed_kmh").alias("avg_speed_kmh"),
        F.avg(F.col("door_status").cast("double")).alias("door_open_rate"),
        F.count_if(on_time).alias("on_time_count"),
        (F.count_if(on_time) * 100.0 / F.count("*")).alias("on_time_percentage"),
    )


def hourly_metrics(silver: DataFrame, c: Config = DEFAULT) -> DataFrame:
    hour = F.hour(local_time(F.col("timestamp"), c.local_zone))
    return silver.groupBy("line_id", "date", hour.alias("hour")).agg(F.count("*").alias("total_events"), F.avg("delay_seconds").alias("avg_delay_seconds"), F.avg("speed_kmh").alias("avg_speed_kmh"))


def stop_performance(stop_events: DataFrame, stops: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """By stop, line, local hour and local day of week (Sunday 1), with the stop's place and name."""
    local = local_time(F.col("arrival_timestamp"), c.local_zone)
    rows = stop_events.select(clean_id(F.col("stop_id")).alias("stop_id"), clean_id(F.col("line_id")).alias("line_id"), F.hour(local).alias("hour_of_day"), F.dayofweek(local).alias("day_of_week"), "delay_at_arrival", "dwell_time_ms")
    sums = rows.groupBy("stop_id", "line_id", "hour_of_day", "day_of_week").agg(F.count("*").alias("historical_arrival_count"), F.avg("delay_at_arrival").alias("historical_avg_delay"), F.avg("dwell_time_ms").alias("avg_dwell_time_ms"))
    named = stops.select(clean_id(F.col("stop_id")).alias("stop_id"), F.col("stop_lat").alias("latitude"), F.col("stop_lon").alias("longitude"), "stop_name")
    return sums.join(named, "stop_id", "left")


#: Decimals of gold figures as the tables hold them.
GOLD_DECIMALS = {"avg_delay_seconds": 2, "avg_speed_kmh": 2, "door_open_rate": 4, "on_time_percentage": 2, "historical_avg_delay": 2, "avg_dwell_time_ms": 0}


def for_gold(df: DataFrame) -> DataFrame:
    """A gold table's figures as they are written.

    They are rounded to eight places before, so that the order in which a mean was summed can't decide a half.
    """
    return df.withColumns({c: F.round(F.round(F.col(c).cast("double"), 8), n) for c, n in GOLD_DECIMALS.items() if c in df.columns})


def distinct_by(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the least, so that reruns agree."""
    rest = [x for x in rows.columns if x != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def stop_metadata(raw: DataFrame) -> DataFrame:
    return distinct_by(raw.select(clean_id(F.col("stop_id")).alias("stop_id"), "stop_name", F.col("stop_lat").alias("latitude"), F.col("stop_lon").alias("longitude")).where("stop_id <> ''"), "stop_id")


def line_metadata(raw: DataFrame) -> DataFrame:
    return distinct_by(raw.select(clean_id(F.col("line_id")).alias("line_id"), "line_name", "line_type", "operator_name").where("line_id <> ''"), "line_id")
