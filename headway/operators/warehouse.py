"""Staging, journeys, stop performance, slowly changing dimensions and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.config import DEFAULT, Config
from headway.functions.columns import clean_id, delay_category_mart, hours_between, in_geofence, kmh, ratio, surrogate_key


def stg_enriched(rows: DataFrame) -> DataFrame:
    zero = lambda x, t: F.coalesce(F.col(x), F.lit(0)).cast(t)
    own = [x for x in ("kafka_partition", "kafka_offset", "ingestion_time", "date") if x in rows.columns]
    out = rows.where(F.col("vehicle_id").isNotNull() & F.col("event_time_ms").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & in_geofence(F.col("latitude"), F.col("longitude")))
    return out.select(
        clean_id(F.col("vehicle_id")).alias("vehicle_id"), F.timestamp_millis("event_time_ms").alias("event_time"), "event_time_ms", "latitude", "longitude",
        zero("speed_ms", "double").alias("speed_ms"), kmh(zero("speed_ms", "double")).alias("speed_kmh"), zero("heading", "double").alias("heading"), zero("delay_seconds", "int").alias("delay_seconds"), zero("door_status", "int").alias("door_status"),
        clean_id(F.col("line_id")).alias("line_id"), F.col("direction_id").cast("string").alias("direction_id"), F.col("operator_id").cast("string").alias("operator_id"), clean_id(F.col("next_stop_id")).alias("next_stop_id"),
        F.col("delay_trend").cast("string").alias("delay_trend"), F.col("speed_trend").cast("string").alias("speed_trend"), zero("distance_since_last_m", "double").alias("distance_since_last_m"), zero("time_since_last_ms", "long").alias("time_since_last_ms"),
        F.coalesce("is_stopped", F.lit(False)).alias("is_stopped"), zero("stopped_duration_ms", "long").alias("stopped_duration_ms"), *own,
    )


def stg_stop_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.where("stop_id is not null and line_id is not null").select(clean_id(F.col("stop_id")).alias("stop_id"), clean_id(F.col("line_id")).alias("line_id"), F.col("hour_of_day").cast("int").alias("hour_of_day"), F.col("day_of_week").cast("int").alias("day_of_week"), F.col("historical_arrival_count").cast("long").alias("historical_arrival_count"), F.col("historical_avg_delay").cast("double").alias("historical_avg_delay"), F.col("avg_dwell_time_ms").cast("double").alias("avg_dwell_time_ms"), F.col("latitude").alias("stop_lat"), F.col("longitude").alias("stop_lon"), F.current_timestamp().alias("loaded_at"))


_JOURNEY = ("vehicle_id", "ingestion_time", "line_id", "operator_id")
_JOURNEY_SUMS = ("event_count", "delay_known", "delay_sum", "speed_known", "speed_sum", "on_time_count", "late_count", "early_count", "distance_m")


def journey_states(stg: DataFrame, *by: str, c: Config = DEFAULT) -> DataFrame:
    """What journeys are made of, by vehicle, ingestion time, line and operator: all of it can be added up."""
    d = F.col("delay_seconds")
    return stg.groupBy(*_JOURNEY, *by).agg(
        F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"), F.count("*").alias("event_count"), F.count(d).alias("delay_known"), F.sum(d.cast("double")).alias("delay_sum"), F.count("speed_kmh").alias("speed_known"), F.sum("speed_kmh").alias("speed_sum"),
        F.count_if(d <= c.on_time_seconds).alias("on_time_count"), F.count_if((d > c.on_time_seconds) & (d <= c.late_seconds)).alias("late_count"), F.count_if(d > c.late_seconds).alias("early_count"), F.sum("distance_since_last_m").alias("distance_m"),
    )


def added_journeys(states: DataFrame) -> DataFrame:
    return states.groupBy(*_JOURNEY).agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *[F.sum(x).alias(x) for x in _JOURNEY_SUMS])


def journeys_of(states: DataFrame) -> DataFrame:
    """Journeys of states that hold each of them once."""
    hours = hours_between(F.col("start_time"), F.col("end_time"))
    return states.withColumns({
        "avg_delay_seconds": F.try_divide("delay_sum", "delay_known"), "avg_speed_kmh": F.try_divide("speed_sum", "speed_known"),
        "journey_id": surrogate_key(*[F.col(k) for k in _JOURNEY]), "journey_date": F.to_date("start_time"), "total_distance_km": F.col("distance_m") / 1000,
        "on_time_percentage": F.try_divide(F.col("on_time_count") * 100.0, F.col("event_count")), "duration_hours": hours, "km_per_hour": F.try_divide(F.col("distance_m") / 1000, F.nullif(hours, F.lit(0.0))),
    }).drop("delay_known", "delay_sum", "speed_known", "speed_sum")


def journeys(stg: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """By vehicle, ingestion time, line and operator; ``early_count`` counts delays above the late limit, as it always did."""
    return journeys_of(journey_states(stg, c=c))


def stopped_events(stg: DataFrame) -> DataFrame:
    rows = stg.where(F.col("is_stopped") & F.col("next_stop_id").isNotNull())
    return rows.withColumns({"stop_id": clean_id(F.col("next_stop_id")), "line_id": clean_id(F.col("line_id")), "hour_of_day": F.hour("event_time"), "day_of_week": F.dayofweek("event_time") - 1, "event_date": F.to_date("event_time")})


def stop_states(stopped: DataFrame, *by: str) -> DataFrame:
    """Additive sums of stopped events by stop, line, event date and hour: all that their figures need."""
    d, late = F.col("delay_seconds"), F.col("delay_seconds") > DEFAULT.on_time_seconds
    return stopped.groupBy("stop_id", "line_id", "event_date", "hour_of_day", *by).agg(F.count("*").alias("n"), F.count(d).alias("known"), F.sum(d.cast("double")).alias("total"), F.sum(d.cast("double") * d).alias("squares"), F.count_if(late | d.isNull()).alias("late"))


def _with(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """A left join that takes null for a value; the keys stay once."""
    other, same = right.withColumnsRenamed({k: f"_{k}" for k in keys}), F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same, "left").drop(*[f"_{k}" for k in keys])


def with_history(stopped: DataFrame, states: DataFrame, metrics: DataFrame) -> DataFrame:
    """Stopped events with the figures of their stop, line and hour, from states and metrics alone.

    Where there is no metric, counts and means of the states stand in.  Metrics are summed to the join's grain first, so that no event comes out twice.
    """
    n = F.sum("historical_arrival_count")
    past = metrics.groupBy("stop_id", "line_id", "hour_of_day").agg(n.alias("past_count"), F.try_divide(F.sum(F.col("historical_avg_delay") * F.col("historical_arrival_count")), n).alias("past_delay"), F.avg("avg_dwell_time_ms").alias("past_dwell"))
    known, total = F.sum("known"), F.sum("total")
    by_hour = states.groupBy("stop_id", "line_id", "hour_of_day").agg(
        F.try_divide(total, known).alias("own_delay"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum("squares") - F.try_divide(total * total, known), known))).alias("historical_stddev_delay"),
        ((F.sum("n") - F.sum("late")) * 100.0 / F.sum("n")).alias("historical_on_time_pct"),
    )
    by_stop = states.groupBy("stop_id", "line_id", "event_date").agg(F.sum("n").alias("own_count"))
    hours = by_hour.join(past, ["stop_id", "line_id", "hour_of_day"], "left")
    both = _with(_with(stopped, hours, "stop_id", "line_id", "hour_of_day"), by_stop, "stop_id", "line_id", "event_date")
    return both.withColumns({
        "historical_arrival_count": F.coalesce("past_count", "own_count"), "historical_avg_delay": F.coalesce("past_delay", "own_delay"), "delay_category": delay_category_mart(F.col("delay_seconds")), "avg_dwell_time_ms": F.coalesce("past_dwell", F.lit(0.0)),
    }).drop("past_count", "past_delay", "past_dwell", "own_count", "own_delay")


def stop_performance(stg: DataFrame, metrics: DataFrame, target_date: str | None = None) -> DataFrame:
    """Stopped events with history, of one date or of all; the events are summed once, and all figures come from these sums."""
    stopped = stopped_events(stg if target_date is None else stg.where(F.col("date") == F.lit(target_date).cast("date")))
    return with_history(stopped, stop_states(stopped), metrics)


def mart_daily_performance(j: DataFrame) -> DataFrame:
    sums = j.groupBy("line_id", F.col("journey_date").alias("metric_date")).agg(F.count_distinct("journey_id").alias("total_journeys"), F.sum("event_count").alias("total_events"), F.count_distinct("vehicle_id").alias("unique_vehicles"), F.avg("avg_delay_seconds").alias("avg_delay_seconds"), F.avg("avg_speed_kmh").alias("avg_speed_kmh"), (ratio(F.sum("on_time_count").cast("double"), F.sum("event_count")) * 100).alias("on_time_percentage"), F.sum("total_distance_km").alias("total_distance_km"))
    return sums.withColumn("metric_id", surrogate_key(F.col("line_id"), F.col("metric_date")))


def snapshot(current: DataFrame | None, source: DataFrame, key: str, checked: list[str], now: str, hard_deletes: bool = True) -> DataFrame:
    """Versions of rows: a new one when a checked column changes; rows that are gone are closed.

    Unchanged rows stay, so that a rerun changes nothing.  ``valid_to`` is null in open versions.
    """
    at = F.lit(now).cast("timestamp")
    columns = [key, *checked, "valid_from", "valid_to"]
    fresh = source.select(key, *checked, at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    if current is None:
        return fresh
    closed, open_ = current.where("valid_to is not null").select(columns), current.where("valid_to is null")
    both = open_.alias("o").join(source.select(key, *checked, F.lit(1).alias("_there")).alias("s"), F.col(f"o.{key}") == F.col(f"s.{key}"), "full")
    same = F.lit(True)
    for c in checked:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    was, there = F.col(f"o.{key}").isNotNull(), F.col("_there").isNotNull()
    end = F.when(there & ~same | ~there & F.lit(hard_deletes), at)
    old = both.where(was).select(*[F.col(f"o.{c}") for c in [key, *checked]], "o.valid_from", end.alias("valid_to"))
    new = both.where(there & (~was | ~same)).select(*[F.col(f"s.{c}") for c in [key, *checked]], at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return closed.unionByName(old).unionByName(new)


def scd2_merge(current: DataFrame | None, source: DataFrame, key: str, checked: list[str], now: str, c: Config = DEFAULT) -> DataFrame:
    """The same with an end date for open versions and a current flag; rows missing in the source stay open."""
    end = F.lit(c.open_end).cast("timestamp")
    inner = None if current is None else current.withColumn("valid_to", F.when(F.col("valid_to") < end, F.col("valid_to")))
    out = snapshot(inner, source, key, checked, now, hard_deletes=False)
    return out.withColumns({"is_current": F.col("valid_to").isNull(), "valid_to": F.coalesce("valid_to", end)})


def empty_snapshot(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def dim_lines(snap: DataFrame) -> DataFrame:
    return snap.select(surrogate_key(F.col("line_id"), F.col("valid_from")).alias("line_key"), "line_id", "line_name", "line_type", "operator_name", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def place_states(stg: DataFrame, *by: str) -> DataFrame:
    """Sums of the places where telemetry has seen stops."""
    return stg.where("next_stop_id is not null").groupBy(clean_id(F.col("next_stop_id")).alias("stop_id"), *by).agg(F.sum("latitude").alias("lat_sum"), F.sum("longitude").alias("lon_sum"), F.count("*").alias("n"))


def dim_stops(snap: DataFrame, places: DataFrame) -> DataFrame:
    """Known stops with their history, and stops that only telemetry has seen, at their mean place (``places``: sums, or the rows themselves)."""
    if "lat_sum" not in places.columns:
        places = place_states(places)
    known = snap.select(clean_id(F.col("stop_id")).alias("stop_id"), "stop_name", "stop_lat", "stop_lon", "zone_id", "stop_code", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))
    seen = places.groupBy("stop_id").agg((F.sum("lat_sum") / F.sum("n")).alias("stop_lat"), (F.sum("lon_sum") / F.sum("n")).alias("stop_lon"))
    new = seen.join(known.select("stop_id").distinct(), "stop_id", "left_anti").select("stop_id", F.concat(F.lit("Stop "), F.col("stop_id")).alias("stop_name"), "stop_lat", "stop_lon", F.lit("Unmapped").alias("zone_id"), F.col("stop_id").alias("stop_code"), F.lit("1970-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"))
    return known.unionByName(new).withColumn("stop_key", surrogate_key(F.col("stop_id"), F.col("valid_from")))


def mart_stop_arrivals(perf: DataFrame, stops: DataFrame, lines: DataFrame, current_only: bool = True) -> DataFrame:
    s = (stops.where("is_current") if current_only else stops).select("stop_id", "stop_lat", "stop_lon", "stop_name", "zone_id", "stop_code")
    ln = lines.where("is_current").select("line_id", "line_name", "line_type")
    key = surrogate_key(F.col("vehicle_id"), F.col("stop_id"), F.col("line_id"), F.col("event_time_ms"))
    return perf.join(s, "stop_id").join(ln, "line_id", "left").select(
        key.alias("feature_id"), "stop_id", "line_id", "event_date", "hour_of_day", "day_of_week", "delay_category", F.col("historical_arrival_count").cast("long").alias("historical_arrival_count"), "historical_avg_delay", "historical_stddev_delay", "historical_on_time_pct", "avg_dwell_time_ms",
        "stop_lat", "stop_lon", F.coalesce("stop_name", F.lit("Unknown")).alias("stop_name"), F.coalesce("zone_id", F.lit("Unknown")).alias("zone_id"), "stop_code", F.coalesce("line_name", F.concat(F.lit("Line: "), F.col("line_id"))).alias("line_name"), F.coalesce("line_type", F.lit("Unknown")).alias("line_type"), "ingestion_time", "kafka_partition", "kafka_offset",
    )
