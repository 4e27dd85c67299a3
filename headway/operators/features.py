"""Online and offline features, best-match history, feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.config import DEFAULT, Config
from headway.functions.columns import four_decimals, parse_bool

#: Keys of a feature vector with their defaults.
VECTOR = {"current_delay": 0, "delay_trend": 0.0, "current_speed": 0.0, "speed_trend": 0.0, "is_stopped": 0, "stopped_duration_ms": 0, "latitude": 0.0, "longitude": 0.0, "historical_avg_delay": 0.0, "historical_stddev_delay": 0.0, "avg_dwell_time_ms": 0.0, "historical_arrival_count": 0, "feature_age_ms": -1}


def online_latest(enriched: DataFrame) -> DataFrame:
    """The latest row of each vehicle, by offset, as online features."""
    f = F.struct("line_id", F.col("delay_seconds").alias("current_delay"), four_decimals(F.col("delay_trend")).cast("double").alias("delay_trend"), F.col("speed_ms").alias("current_speed"), four_decimals(F.col("speed_trend")).cast("double").alias("speed_trend"), "is_stopped", "stopped_duration_ms", "latitude", "longitude", F.trim("next_stop_id").alias("next_stop_id"), F.col("event_time_ms").alias("updated_at"))
    return enriched.groupBy("vehicle_id").agg(F.max_by(f, "kafka_offset").alias("f")).select("vehicle_id", "f.*")


def alive(online: DataFrame, now_ms: int, c: Config = DEFAULT) -> DataFrame:
    """Unexpired rows with their age."""
    return online.withColumn("feature_age_ms", F.coalesce(F.lit(now_ms) - F.col("updated_at"), F.lit(-1))).where(F.col("feature_age_ms") <= c.feature_ttl_ms)


def active(online: DataFrame, now_ms: int, first: int = 50, c: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(the first vehicles with unexpired features, by id; their number in all)."""
    rows = alive(online, now_ms, c)
    return rows.orderBy("vehicle_id").limit(first), rows.agg(F.count("*").alias("active_vehicles"))


def parse_hash(rows: DataFrame) -> DataFrame:
    """Text records of the online store with aliases, defaults and ages, given ``now_ms``."""
    has = lambda *names: [F.col(n) for n in names if n in rows.columns]
    num = lambda t, d, *names: F.coalesce(*[x.try_cast(t) for x in has(*names)], F.lit(d))
    text = lambda x: F.when(~F.col(x).isin("None", ""), F.col(x))
    updated = num("long", 0, "updated_at", "event_time_ms")
    return rows.select("vehicle_id", text("line_id").alias("line_id"), num("int", 0, "current_delay", "delay").alias("current_delay"), num("double", 0.0, "delay_trend").alias("delay_trend"), num("double", 0.0, "current_speed", "speed").alias("current_speed"), num("double", 0.0, "speed_trend").alias("speed_trend"), parse_bool(F.col("is_stopped")).alias("is_stopped"), num("long", 0, "stopped_duration_ms").alias("stopped_duration_ms"), num("double", 0.0, "latitude").alias("latitude"), num("double", 0.0, "longitude").alias("longitude"), text("next_stop_id").alias("next_stop_id"), updated.alias("updated_at"), F.when(updated > 0, F.col("now_ms") - updated).otherwise(-1).alias("feature_age_ms"))


def valid_requests(requests: DataFrame, last_day: int = 7) -> tuple[DataFrame, DataFrame]:
    """(requests in bounds, the others); days go to 7 in lookups, to 6 in predictions."""
    ok = F.coalesce(F.col("hour_of_day").between(0, 23), F.lit(True)) & F.coalesce(F.col("day_of_week").between(0, last_day), F.lit(True))
    return requests.where(ok), requests.where(~ok)


#: What a lookup reads of the stop mart, beside the keys.
HISTORY = ("historical_avg_delay", "historical_stddev_delay", "avg_dwell_time_ms", "historical_arrival_count")


def history(mart: DataFrame) -> DataFrame:
    """One row of the stop mart for each stop, line, hour and day of week (UTC hour, Sunday 0): that of its last event."""
    figures = F.struct(*HISTORY, F.col("stop_lat").alias("latitude"), F.col("stop_lon").alias("longitude"))
    last = F.max_by(figures, F.struct("event_date", "kafka_partition", "kafka_offset"))
    return mart.groupBy("stop_id", "line_id", "hour_of_day", "day_of_week").agg(last.alias("h")).select("stop_id", "line_id", "hour_of_day", "day_of_week", "h.*")


def best_match(requests: DataFrame, history: DataFrame) -> DataFrame:
    """For each request the history of its stop (and line, if it names one) nearest to its hour and day.

    An exact (hour, day) first, then the nearest hour; ties by line, day, hour.  Requests of equal stop, line,
    hour and day have the same match, so history is searched once for each of these: a stop's history (hours and
    days of its lines) is one array, and the match its least entry in that order.
    """
    keys, own = ("stop_id", "line_id", "hour_of_day", "day_of_week"), {"line_id": "h_line", "day_of_week": "h_dow", "hour_of_day": "h_hour"}
    rest = [c for c in history.columns if c not in keys]
    entry = F.struct(*[F.col(c).alias(n) for c, n in own.items()], *rest)
    of_line = F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("line_id").cast("string"))))  # for requests without and with a line
    by_stop = history.select(F.col("stop_id").alias("h_stop"), of_line.alias("of_line"), entry.alias("h")).groupBy("h_stop", "of_line").agg(F.collect_list("h").alias("entries"))
    asked = requests.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    both = asked.join(by_stop, (F.col("_stop_id") == F.col("h_stop")) & F.col("_line_id").eqNullSafe(F.col("of_line")), "left")

    def ranked(h: Column) -> Column:
        exact = F.coalesce((h["h_hour"] == F.col("_hour_of_day")) & (h["h_dow"] == F.col("_day_of_week")), F.lit(False))
        away = F.abs(h["h_hour"] - F.col("_hour_of_day"))
        return F.struct((~exact).alias("a"), away.isNull().alias("b"), away.alias("c"), h.alias("h"))

    best = both.withColumn("h", F.array_min(F.transform("entries", ranked))["h"]).select(*[f"_{k}" for k in keys], *[F.col("h")[n].alias(n) for n in (*own.values(), *rest)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return requests.join(best, same, "left").drop(*[f"_{k}" for k in keys])


def combined(requests: DataFrame, online: DataFrame, history: DataFrame, both_known: bool = False) -> DataFrame:
    """Online and offline features of a batch of requests (request_id, vehicle_id, stop_id?, line_id?, hour_of_day?, day_of_week?, request_time?).

    Stop and line default to the vehicle's, hour and day (Sunday 0) to the request's time.  ``both_known``:
    history only where both stop and line are known.  ``history`` has the hour and day of the stop mart.
    """
    o = online.withColumnsRenamed({"line_id": "o_line", "next_stop_id": "o_stop"}).withColumn("online_available", F.lit(True))
    rows = requests.join(o, "vehicle_id", "left").withColumns({"stop_id": F.coalesce("stop_id", "o_stop"), "line_id": F.coalesce("line_id", "o_line"), "hour_of_day": F.coalesce("hour_of_day", F.hour("request_time")), "day_of_week": F.coalesce("day_of_week", F.dayofweek("request_time") - 1)})
    h = history.withColumnsRenamed({"latitude": "stop_latitude", "longitude": "stop_longitude"}).withColumn("offline_available", F.lit(True))
    if both_known:
        rows = rows.withColumn("stop_id", F.when(F.col("line_id").isNotNull(), F.col("stop_id")))
    return best_match(rows, h).withColumns({"online_available": F.coalesce("online_available", F.lit(False)), "offline_available": F.coalesce("offline_available", F.lit(False))})


def vector(rows: DataFrame) -> DataFrame:
    """14 keys, vehicle first; a latitude of 0.0 takes the stop's place; ``is_stopped`` is 1 or 0."""
    if "is_stopped" in rows.columns:
        rows = rows.withColumn("is_stopped", F.col("is_stopped").cast("int"))
    have = {k: F.coalesce(F.col(k) if k in rows.columns else F.lit(None), F.lit(v)) for k, v in VECTOR.items()}
    nowhere = have["latitude"] == 0.0
    for k, s in (("latitude", "stop_latitude"), ("longitude", "stop_longitude")):
        if s in rows.columns:
            have[k] = F.when(nowhere, F.coalesce(s, F.lit(0.0))).otherwise(have[k])
    own = [c for c in ("request_id",) if c in rows.columns]
    return rows.select(*own, "vehicle_id", *[c.alias(k) for k, c in have.items()])


def hit_rates(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("requests"), F.coalesce(F.avg(F.col("online_available").cast("double")), F.lit(0.0)).alias("online_hit_rate"), F.coalesce(F.avg(F.col("offline_available").cast("double")), F.lit(0.0)).alias("offline_hit_rate"))
