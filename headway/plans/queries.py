"""Registered queries of the engine over the driver's tables, each with its SQL for the comparison.

Floating-point results are rounded to six places on both sides, as sums may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.columns import delay_category_gold, delay_category_mart, delay_category_signed, haversine_m, in_geofence, in_helsinki_area, surrogate_key
from headway.operators import batches, enrich, features, lakehouse, ml, monitor, tables, validate, warehouse
from headway.session import scratch
from headway.sources import adapters as src
from headway.sources import connectors
from headway.streaming import ingest_stream as ingest_streams
from headway.streaming.enrich_stream import active_vehicles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the inputs, by name, with the inputs they need.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "telemetry": ("""SELECT CAST(user_id AS VARCHAR) AS vehicle_id, epoch_us(ts) // 1000 AS event_time_ms, CASE WHEN k = 50 THEN NULL ELSE 59.85::DOUBLE + k * 0.006::DOUBLE END AS latitude, 24.4::DOUBLE + (user_id % 100) * 0.009::DOUBLE AS longitude,
      CASE WHEN event_type IN ('view', 'error') THEN (k % 10)::DOUBLE / 10.0::DOUBLE ELSE k::DOUBLE / 5.0::DOUBLE END AS speed_ms, CAST((k * 3) % 361 AS INT) AS heading, CAST(floor(value * 4) AS INT) - 120 AS delay_seconds, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS door_status, event_type AS line_id,
      CAST(user_id % 2 + 1 AS INT) AS direction_id, CAST(user_id % 5 AS INT) AS operator_id, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN ' S' || CAST(k % 5 AS VARCHAR) || ' ' ELSE 'S' || CAST(k % 5 AS VARCHAR) END AS next_stop_id,
      CAST(user_id % 8 AS INT) AS kafka_partition, event_id AS kafka_offset, ts AS kafka_timestamp, date_trunc('hour', ts) AS ingestion_time, CAST(ts AS DATE) AS date
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""", ()),
    "replayed": ("SELECT * FROM telemetry UNION ALL SELECT * REPLACE (kafka_offset + 1000000 AS kafka_offset, delay_seconds + 1 AS delay_seconds) FROM telemetry WHERE kafka_offset % 10 = 0", ("telemetry",)),
    "latest": ("SELECT * FROM replayed QUALIFY row_number() OVER (PARTITION BY vehicle_id, event_time_ms ORDER BY kafka_offset DESC, kafka_partition DESC) = 1", ("replayed",)),
    "silver": ("SELECT *, speed_ms * 3.6 AS speed_kmh, make_timestamp(event_time_ms * 1000) AS timestamp FROM latest WHERE latitude IS NOT NULL AND longitude IS NOT NULL", ("latest",)),
    "stops": ("SELECT 'S' || CAST(r_regionkey AS VARCHAR) AS stop_id, r_name AS stop_name, 60.0::DOUBLE + r_regionkey * 0.1::DOUBLE AS stop_lat, 24.9::DOUBLE AS stop_lon, 'A' AS zone_id, 'H' || CAST(r_regionkey AS VARCHAR) AS stop_code FROM region WHERE r_regionkey < 3", ()),
    "lines": ("SELECT * FROM (VALUES ('click', 'Line Click', 'bus', 'OpA'), ('view', 'Line View', 'tram', 'OpB'), ('signup', 'Line Signup', 'metro', 'OpB'), ('purchase', 'Line Purchase', 'train', 'OpC')) AS t(line_id, line_name, line_type, operator_name)", ()),
    "moved": ("""SELECT *, speed_ms < 1.0 AS is_stopped, coalesce(max(CASE WHEN speed_ms >= 1.0 THEN kafka_offset END) OVER (PARTITION BY vehicle_id ORDER BY kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS moved,
      coalesce(max(CASE WHEN door_status = 0 THEN kafka_offset END) OVER (PARTITION BY vehicle_id ORDER BY kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opened,
      lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY kafka_offset)""", ("telemetry",)),
    "enriched": ("""SELECT * EXCLUDE (moved, opened, plat, plon), delay_seconds - coalesce(avg(delay_seconds) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS delay_trend, coalesce(speed_ms - lag(speed_ms) OVER w, 0) AS speed_trend,
      coalesce(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 0) AS distance_since_last_m, coalesce(event_time_ms - lag(event_time_ms) OVER w, 0) AS time_since_last_ms, coalesce(next_stop_id <> lag(next_stop_id) OVER w, false) AS is_arrival,
      coalesce(event_time_ms - min(CASE WHEN is_stopped THEN event_time_ms END) OVER (PARTITION BY vehicle_id, moved ORDER BY kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped_duration_ms,
      coalesce(event_time_ms - min(CASE WHEN door_status = 1 THEN event_time_ms END) OVER (PARTITION BY vehicle_id, opened ORDER BY kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS door_open_duration_ms
      FROM (SELECT *, pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2) AS h FROM moved) WINDOW w AS (PARTITION BY vehicle_id ORDER BY kafka_offset)""", ("moved",)),
    "arrivals": ("SELECT vehicle_id, next_stop_id AS stop_id, line_id, direction_id, event_time_ms AS arrival_time, delay_seconds AS delay_at_arrival, CAST(NULL AS BIGINT) AS dwell_time_ms, door_status, latitude, longitude, kafka_partition, kafka_offset, date FROM enriched WHERE is_arrival", ("enriched",)),
    "stop_metrics": ("""SELECT trim(stop_id) AS stop_id, line_id, hour(lt) AS hour_of_day, dayofweek(lt) + 1 AS day_of_week, count(*) AS historical_arrival_count, avg(delay_at_arrival) AS historical_avg_delay, avg(dwell_time_ms) AS avg_dwell_time_ms
      FROM (SELECT *, (make_timestamp(arrival_time * 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki' AS lt FROM arrivals) GROUP BY 1, 2, 3, 4""", ("arrivals",)),
    "stg": ("SELECT trim(vehicle_id) AS vehicle_id, make_timestamp(event_time_ms * 1000) AS event_time, event_time_ms, latitude, longitude, speed_ms, speed_ms * 3.6 AS speed_kmh, CAST(heading AS DOUBLE) AS heading, delay_seconds, door_status, line_id, CAST(direction_id AS VARCHAR) AS direction_id, CAST(operator_id AS VARCHAR) AS operator_id, trim(next_stop_id) AS next_stop_id, distance_since_last_m, time_since_last_ms, is_stopped, stopped_duration_ms, kafka_partition, kafka_offset, ingestion_time, date FROM enriched WHERE latitude BETWEEN 59.9 AND 60.4 AND longitude BETWEEN 24.5 AND 25.2", ("enriched",)),
    "journeys": ("""SELECT vehicle_id, ingestion_time, line_id, operator_id, min(event_time) AS start_time, max(event_time) AS end_time, CAST(min(event_time) AS DATE) AS journey_date, count(*) AS event_count, avg(delay_seconds) AS avg_delay_seconds, avg(speed_kmh) AS avg_speed_kmh, count(*) FILTER (delay_seconds <= 60) AS on_time_count, count(*) FILTER (delay_seconds > 60 AND delay_seconds <= 300) AS late_count, count(*) FILTER (delay_seconds > 300) AS early_count, sum(distance_since_last_m) / 1000 AS total_distance_km,
      (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 3.6e9 AS duration_hours FROM stg GROUP BY ALL""", ("stg",)),
    "past": ("SELECT stop_id, line_id, hour_of_day, sum(historical_arrival_count) AS past_count, sum(historical_avg_delay * historical_arrival_count) / sum(historical_arrival_count) AS past_delay, avg(avg_dwell_time_ms) AS past_dwell FROM stop_metrics GROUP BY 1, 2, 3", ("stop_metrics",)),
    "perf": ("""SELECT s.* EXCLUDE (next_stop_id), s.next_stop_id AS stop_id, hour(event_time) AS hour_of_day, dayofweek(event_time) AS day_of_week, CAST(event_time AS DATE) AS event_date, CASE WHEN delay_seconds <= 60 THEN 'ON_TIME' WHEN delay_seconds <= 300 THEN 'LATE' ELSE 'VERY_LATE' END AS delay_category,
      CAST(coalesce(past_count, count(*) OVER (PARTITION BY s.next_stop_id, s.line_id, CAST(event_time AS DATE))) AS BIGINT) AS historical_arrival_count, coalesce(past_delay, avg(delay_seconds) OVER h) AS historical_avg_delay, stddev_pop(delay_seconds) OVER h AS historical_stddev_delay, sum(CASE WHEN delay_seconds <= 60 THEN 1 ELSE 0 END) OVER h * 100.0 / count(*) OVER h AS historical_on_time_pct, coalesce(past_dwell, 0.0) AS avg_dwell_time_ms
      FROM stg s LEFT JOIN past p ON s.next_stop_id = p.stop_id AND s.line_id = p.line_id AND hour(event_time) = p.hour_of_day WHERE is_stopped AND s.next_stop_id IS NOT NULL WINDOW h AS (PARTITION BY s.next_stop_id, s.line_id, hour(event_time))""", ("stg", "past")),
    "history": ("SELECT p.stop_id, p.line_id, p.hour_of_day, p.day_of_week, historical_arrival_count, historical_avg_delay, historical_stddev_delay, avg_dwell_time_ms, s.stop_lat, s.stop_lon FROM perf p JOIN dim_stops s ON p.stop_id = s.stop_id QUALIFY row_number() OVER (PARTITION BY p.stop_id, p.line_id, hour_of_day, day_of_week ORDER BY event_date DESC, kafka_partition DESC, kafka_offset DESC) = 1", ("perf", "dim_stops")),
    "dim_stops": ("""SELECT stop_id, stop_name, stop_lat, stop_lon, zone_id, stop_code, TIMESTAMP '2026-01-01' AS valid_from FROM stops UNION ALL
      SELECT next_stop_id, 'Stop ' || next_stop_id, avg(latitude), avg(longitude), 'Unmapped', next_stop_id, TIMESTAMP '1970-01-01' FROM stg WHERE next_stop_id IS NOT NULL AND next_stop_id NOT IN (SELECT stop_id FROM stops) GROUP BY next_stop_id""", ("stops", "stg")),
    "predictions": ("SELECT o_orderkey AS request_id, CAST(o_custkey AS VARCHAR) AS vehicle_id, CAST(o_orderkey % 600 AS DOUBLE) AS prod, CAST(o_orderkey % 600 + o_custkey % 150 AS DOUBLE) AS shadow, CAST((o_orderkey * 7) % 650 AS DOUBLE) AS actual, CAST(o_custkey % 97 AS DOUBLE) AS latency_ms FROM orders", ()),
    "large": ("SELECT CAST(l_suppkey AS VARCHAR) AS line_id, CAST(l_partkey % 500 AS VARCHAR) AS stop_id, CAST(l_shipdate AS DATE) AS date, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) * 10 AS delay_seconds, CAST(l_quantity AS DOUBLE) AS speed_ms, l_orderkey * 10 + l_linenumber AS kafka_offset FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ()),
    "raw": ("""SELECT * EXCLUDE (value), CASE WHEN k = 1 THEN '{broken' WHEN k = 2 THEN '{"XX":1}' WHEN k = 15 THEN '{"VP":[]}' WHEN k = 25 THEN '[1]' WHEN k = 26 THEN '{"VP":"text"}' ELSE '{"VP":{"veh":' || CASE WHEN k = 6 THEN '"abc"' WHEN k = 8 THEN '" ' || CAST(user_id AS VARCHAR) || '"' WHEN k = 9 THEN CAST(user_id AS VARCHAR) || '.0' ELSE CAST(user_id AS VARCHAR) END
      || ',"tst":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","tsi":' || CASE WHEN k = 17 THEN 'null' ELSE '1' END || ',"desi":' || CASE WHEN k = 14 THEN '7' ELSE '"' || event_type || '"' END || ',"dir":' || CASE k WHEN 4 THEN '"x"' WHEN 11 THEN '"0"' WHEN 12 THEN '"-1"' WHEN 20 THEN '" 2 "' WHEN 21 THEN '""' WHEN 22 THEN '2' ELSE '"' || CAST(user_id % 2 + 1 AS VARCHAR) || '"' END
      || ',"lat":' || CASE WHEN k = 3 THEN 'null' WHEN k = 13 THEN '"60.13"' ELSE '60.' || lpad(CAST(k AS VARCHAR), 2, '0') END || ',"long":24.9,"spd":' || CASE WHEN k = 5 THEN '100' WHEN k = 7 THEN 'null' WHEN k = 19 THEN '"fast"' ELSE CAST(k % 40 AS VARCHAR) END
      || CASE k WHEN 10 THEN ',"dl":5.5' WHEN 16 THEN ',"drst":true' WHEN 18 THEN ',"dl":"12"' WHEN 23 THEN ',"dl":1e2' WHEN 24 THEN ',"dl":"1e2"' ELSE '' END || '}}' END AS value,
      CASE WHEN k = 1 THEN 'corrupt_json' WHEN k IN (2, 15) THEN 'missing_vp_wrapper' WHEN k = 3 THEN 'gps_dropout' WHEN k IN (4, 25) THEN 'runtime_error' WHEN k IN (5, 6, 10, 11, 12, 14, 17, 19, 22, 24, 26) THEN 'contract_violation' ELSE 'valid' END AS reason,
      CASE k WHEN 5 THEN 'speed_ms' WHEN 6 THEN 'veh' WHEN 10 THEN 'dl' WHEN 11 THEN 'direction_id' WHEN 12 THEN 'direction_id' WHEN 14 THEN 'desi' WHEN 17 THEN 'tsi' WHEN 19 THEN 'spd' WHEN 22 THEN 'dir' WHEN 24 THEN 'dl' WHEN 26 THEN 'veh' END AS field
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""", ()),
    "online": ("SELECT vehicle_id, arg_max(struct_pack(l := line_id, d := delay_seconds, dt := delay_trend, s := speed_ms, st := speed_trend, z := is_stopped, sd := stopped_duration_ms, la := latitude, lo := longitude, n := trim(next_stop_id), u := event_time_ms), kafka_offset) AS f FROM enriched GROUP BY 1", ("enriched",)),
    "requests": ("SELECT o_orderkey AS request_id, CAST(o_custkey % 50 AS VARCHAR) AS vehicle_id, CASE WHEN o_orderkey % 11 > 0 THEN 'S' || CAST(o_orderkey % 6 AS VARCHAR) END AS stop_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'view' ELSE 'error' END AS line_id, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey % 24 AS INT) END AS hour_of_day, CASE WHEN o_orderkey % 17 > 0 THEN CAST(o_orderkey % 7 AS INT) END AS day_of_week, CAST(o_orderdate AS TIMESTAMP) AS request_time FROM orders", ()),
    "live": ("SELECT r.* REPLACE (coalesce(r.stop_id, f.n) AS stop_id, coalesce(r.line_id, f.l) AS line_id, coalesce(r.hour_of_day, hour(r.request_time)) AS hour_of_day, coalesce(r.day_of_week, dayofweek(r.request_time)) AS day_of_week), o.vehicle_id IS NOT NULL AS online_available, f FROM requests r LEFT JOIN online o ON r.vehicle_id = o.vehicle_id", ("requests", "online")),
}


def sql(body: str, *needs: str) -> str:
    """body with the inputs that it needs in front, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][1]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body if order else body


def query(oracle: str | None = None, *needs: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *needs)
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _silver(s, d):
    return lakehouse.silver_enriched(src.with_replays(src.telemetry(s, d)))


def _enriched(s, d):
    return enrich.enrich(src.telemetry(s, d))


def _stop_events(s, d):
    return lakehouse.silver_stop_events(enrich.arrivals(_enriched(s, d)))


def _stg(s, d):
    return warehouse.stg_enriched(_enriched(s, d))


def _metrics(s, d):
    return lakehouse.stop_performance(_stop_events(s, d), src.stops(s, d))


def _kept(s, d):
    """Enriched rows, computed once and read by all that stands on them, as the jobs read their bronze table."""
    path = scratch(s)
    _enriched(s, d).write.parquet(path)
    return s.read.parquet(path)


def _perf(s, d, rows=None):
    rows = _kept(s, d) if rows is None else rows
    return warehouse.stop_performance(warehouse.stg_enriched(rows), lakehouse.stop_performance(lakehouse.silver_stop_events(enrich.arrivals(rows)), src.stops(s, d)))


def _mart(s, d, rows=None):
    rows = _kept(s, d) if rows is None else rows
    return warehouse.mart_stop_arrivals(_perf(s, d, rows), warehouse.dim_stops(_stops_snapshot(s, d), warehouse.stg_enriched(rows)), _dim_lines(s, d))


def _live(s, d):
    """(online features, history of the stop mart), from the same rows."""
    rows = _kept(s, d)
    return features.online_latest(rows), features.history(_mart(s, d, rows))


def _stops_snapshot(s, d):
    return warehouse.snapshot(None, src.stops(s, d), "stop_id", ["stop_name", "stop_lat", "stop_lon", "zone_id", "stop_code"], "2026-01-01")


def _dim_stops(s, d):
    return warehouse.dim_stops(_stops_snapshot(s, d), _stg(s, d))


def _dim_lines(s, d):
    return warehouse.dim_lines(warehouse.snapshot(None, src.lines(s), "line_id", ["line_name", "line_type", "operator_name"], "2026-01-01"))


@query("SELECT vehicle_id, event_time_ms, kafka_offset, delay_seconds FROM latest", "latest")
def silver_dedup(s, d):
    return lakehouse.keep_latest(src.with_replays(src.telemetry(s, d)), ["vehicle_id", "event_time_ms"]).select("vehicle_id", "event_time_ms", "kafka_offset", "delay_seconds")


@query("SELECT vehicle_id, kafka_offset, round(latitude, 6) AS latitude, round(speed_kmh, 6) AS speed_kmh, delay_seconds, door_status, epoch_us(timestamp) // 1000 AS timestamp_ms, date FROM silver", "silver")
def silver_clean(s, d):
    return r6(_silver(s, d).select("vehicle_id", "kafka_offset", "latitude", "speed_kmh", "delay_seconds", "door_status", F.unix_millis("timestamp").alias("timestamp_ms"), "date"), "latitude", "speed_kmh")


@query("""SELECT kafka_offset, CASE WHEN delay_seconds <= 60 THEN 'on_time' WHEN delay_seconds <= 300 THEN 'minor_delay' ELSE 'major_delay' END AS gold, CASE WHEN delay_seconds <= 60 THEN 'ON_TIME' WHEN delay_seconds <= 300 THEN 'LATE' ELSE 'VERY_LATE' END AS mart,
  CASE WHEN abs(delay_seconds) <= 60 THEN 'on_time' WHEN delay_seconds > 300 THEN 'delayed' WHEN delay_seconds < -300 THEN 'early' ELSE 'slight_delay' END AS signed FROM telemetry""", "telemetry")  # fmt: skip
def delay_categories(s, d):
    x = F.col("delay_seconds")
    return src.telemetry(s, d).select("kafka_offset", delay_category_gold(x).alias("gold"), delay_category_mart(x).alias("mart"), delay_category_signed(x).alias("signed"))


@query("""SELECT line_id, date, count(*) AS total_events, round(avg(delay_seconds), 6) AS avg_delay_seconds, round(avg(speed_kmh), 6) AS avg_speed_kmh, round(avg(CAST(door_status AS DOUBLE)), 6) AS door_open_rate, count(*) FILTER (delay_seconds <= 60) AS on_time_count, round(count(*) FILTER (delay_seconds <= 60) * 100.0 / count(*), 6) AS on_time_percentage FROM silver GROUP BY 1, 2""", "silver")
def gold_daily_metrics(s, d):
    return r6(lakehouse.daily_metrics(_silver(s, d)), "avg_delay_seconds", "avg_speed_kmh", "door_open_rate", "on_time_percentage")


@query("SELECT line_id, date, CAST(hour((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki') AS INT) AS hour, count(*) AS total_events, round(avg(delay_seconds), 6) AS avg_delay_seconds, round(avg(speed_kmh), 6) AS avg_speed_kmh FROM silver GROUP BY 1, 2, 3", "silver")
def gold_hourly_metrics(s, d):
    return r6(lakehouse.hourly_metrics(_silver(s, d)), "avg_delay_seconds", "avg_speed_kmh")


@query("SELECT m.stop_id, line_id, CAST(hour_of_day AS INT) AS hour_of_day, CAST(day_of_week AS INT) AS day_of_week, historical_arrival_count, round(historical_avg_delay, 6) AS historical_avg_delay, avg_dwell_time_ms, s.stop_lat AS latitude, s.stop_lon AS longitude, s.stop_name FROM stop_metrics m LEFT JOIN stops s ON m.stop_id = s.stop_id", "stop_metrics", "stops")
def gold_stop_performance(s, d):
    return r6(_metrics(s, d), "historical_avg_delay")


def _rounded(x: str, n: int, name: str) -> str:
    """As the gold tables round: half away from zero, on eight places."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 8)), {n}) AS DOUBLE) AS {name}"


@query(f"SELECT line_id, date, count(*) AS total_events, {_rounded('avg(delay_seconds)', 2, 'avg_delay_seconds')}, {_rounded('avg(speed_kmh)', 2, 'avg_speed_kmh')}, {_rounded('avg(CAST(door_status AS DOUBLE))', 4, 'door_open_rate')}, count(*) FILTER (delay_seconds <= 60) AS on_time_count, {_rounded('count(*) FILTER (delay_seconds <= 60) * 100.0::DOUBLE / count(*)', 2, 'on_time_percentage')} FROM silver GROUP BY 1, 2", "silver")
def gold_daily_table(s, d):
    """Daily metrics as the gold table holds them."""
    return lakehouse.for_gold(lakehouse.daily_metrics(_silver(s, d)))


@query(f"SELECT line_id, date, CAST(hour((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki') AS INT) AS hour, count(*) AS total_events, {_rounded('avg(delay_seconds)', 2, 'avg_delay_seconds')}, {_rounded('avg(speed_kmh)', 2, 'avg_speed_kmh')} FROM silver GROUP BY 1, 2, 3", "silver")
def gold_hourly_table(s, d):
    return lakehouse.for_gold(lakehouse.hourly_metrics(_silver(s, d)))


@query(f"SELECT m.stop_id, line_id, CAST(hour_of_day AS INT) AS hour_of_day, CAST(day_of_week AS INT) AS day_of_week, historical_arrival_count, {_rounded('historical_avg_delay', 2, 'historical_avg_delay')}, {_rounded('avg_dwell_time_ms', 0, 'avg_dwell_time_ms')}, s.stop_lat AS latitude, s.stop_lon AS longitude, s.stop_name FROM stop_metrics m LEFT JOIN stops s ON m.stop_id = s.stop_id", "stop_metrics", "stops")
def gold_stop_table(s, d):
    return lakehouse.for_gold(_metrics(s, d))


@query("SELECT trim(i) AS stop_id, n AS stop_name, la AS latitude, lo AS longitude FROM (SELECT CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE ' P' || CAST(p_partkey // 3 AS VARCHAR) || ' ' END AS i, p_name AS n, 60.0::DOUBLE + p_size * 0.01::DOUBLE AS la, 24.9::DOUBLE AS lo FROM part) WHERE trim(i) <> '' QUALIFY row_number() OVER (PARTITION BY trim(i) ORDER BY n, la, lo) = 1")
def gold_stop_metadata(s, d):
    """Parts as raw stops: three rows a stop, padded ids, some of them empty."""
    raw = src.table(s, d, "part").selectExpr("case when p_partkey % 97 = 0 then ' ' else concat(' P', cast(p_partkey div 3 as string), ' ') end as stop_id", "p_name as stop_name", "60.0D + p_size * 0.01D as stop_lat", "24.9D as stop_lon")
    return lakehouse.stop_metadata(raw)


@query("SELECT trim(i) AS line_id, n AS line_name, t AS line_type, o AS operator_name FROM (SELECT ' L' || CAST(c_custkey // 4 AS VARCHAR) AS i, c_name AS n, c_mktsegment AS t, CAST(c_nationkey AS VARCHAR) AS o FROM customer) QUALIFY row_number() OVER (PARTITION BY trim(i) ORDER BY n, t, o) = 1")
def gold_line_metadata(s, d):
    """Customers as raw lines, four rows a line."""
    return lakehouse.line_metadata(src.table(s, d, "customer").selectExpr("concat(' L', cast(c_custkey div 4 as string)) as line_id", "c_name as line_name", "c_mktsegment as line_type", "cast(c_nationkey as string) as operator_name"))


@query("SELECT kafka_offset, round(delay_trend, 6) AS delay_trend, round(speed_trend, 6) AS speed_trend FROM enriched", "enriched")
def enrich_trends(s, d):
    return r6(_enriched(s, d).select("kafka_offset", "delay_trend", "speed_trend"), "delay_trend", "speed_trend")


@query("SELECT kafka_offset, round(distance_since_last_m, 3) AS distance_since_last_m, time_since_last_ms FROM enriched", "enriched")
def enrich_motion(s, d):
    return _enriched(s, d).select("kafka_offset", F.round("distance_since_last_m", 3).alias("distance_since_last_m"), "time_since_last_ms")


@query("SELECT kafka_offset, is_stopped, stopped_duration_ms, door_open_duration_ms FROM enriched", "enriched")
def enrich_stopped_duration(s, d):
    return _enriched(s, d).select("kafka_offset", "is_stopped", "stopped_duration_ms", "door_open_duration_ms")


@query("SELECT vehicle_id, stop_id, line_id, arrival_time, delay_at_arrival, door_status, kafka_offset FROM arrivals", "arrivals")
def stop_arrivals(s, d):
    return enrich.arrivals(_enriched(s, d)).select("vehicle_id", "stop_id", "line_id", "arrival_time", "delay_at_arrival", "door_status", "kafka_offset")


@query("SELECT vehicle_id, epoch_us(event_time) // 1000 AS event_ms, event_time_ms, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(speed_ms, 6) AS speed_ms, round(speed_kmh, 6) AS speed_kmh, heading, delay_seconds, door_status, line_id, direction_id, operator_id, next_stop_id, round(distance_since_last_m, 3) AS distance_since_last_m, time_since_last_ms, is_stopped, stopped_duration_ms, kafka_partition, kafka_offset, epoch_us(ingestion_time) // 1000 AS ingestion_ms, date FROM stg", "stg")
def stg_enriched_geofence(s, d):
    """All columns but the trends, which staging turns into text."""
    rows = _stg(s, d).withColumns({"event_ms": F.unix_millis("event_time"), "ingestion_ms": F.unix_millis("ingestion_time"), "distance_since_last_m": F.round("distance_since_last_m", 3)})
    return r6(rows.drop("event_time", "ingestion_time", "delay_trend", "speed_trend"), "latitude", "longitude", "speed_ms", "speed_kmh")


@query("SELECT kafka_offset, coalesce(latitude BETWEEN 59.9 AND 60.5 AND longitude BETWEEN 24.0 AND 25.5, false) AS in_area, coalesce(latitude BETWEEN 59.9 AND 60.4 AND longitude BETWEEN 24.5 AND 25.2, false) AS in_fence, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS centre_m FROM (SELECT *, pow(sin(radians(60.17 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(60.17)) * pow(sin(radians(24.94 - longitude) / 2), 2) AS h FROM telemetry)", "telemetry")
def geo_predicates(s, d):
    lat, lon = F.col("latitude"), F.col("longitude")
    return src.telemetry(s, d).select("kafka_offset", F.coalesce(in_helsinki_area(lat, lon), F.lit(False)).alias("in_area"), F.coalesce(in_geofence(lat, lon), F.lit(False)).alias("in_fence"), F.round(haversine_m(lat, lon, F.lit(60.17), F.lit(24.94)), 3).alias("centre_m"))


@query("SELECT md5(vehicle_id || '-' || coalesce(next_stop_id, '_dbt_utils_surrogate_key_null_') || '-' || CAST(kafka_offset AS VARCHAR)) AS key, kafka_offset FROM telemetry", "telemetry")
def surrogate_keys(s, d):
    return src.telemetry(s, d).select(surrogate_key(F.col("vehicle_id"), F.col("next_stop_id"), F.col("kafka_offset")).alias("key"), "kafka_offset")


@query("""SELECT vehicle_id, epoch_us(ingestion_time) // 1000 AS ingestion_ms, line_id, operator_id, journey_date, event_count, round(avg_delay_seconds, 6) AS avg_delay_seconds, round(avg_speed_kmh, 6) AS avg_speed_kmh, on_time_count, late_count, early_count, round(total_distance_km, 6) AS total_distance_km, round(on_time_count * 100.0 / event_count, 6) AS on_time_percentage, round(duration_hours, 6) AS duration_hours FROM journeys""", "journeys")
def vehicle_journeys(s, d):
    j = warehouse.journeys(_stg(s, d)).select("vehicle_id", F.unix_millis("ingestion_time").alias("ingestion_ms"), "line_id", "operator_id", "journey_date", "event_count", "avg_delay_seconds", "avg_speed_kmh", "on_time_count", "late_count", "early_count", "total_distance_km", "on_time_percentage", "duration_hours")
    return r6(j, "avg_delay_seconds", "avg_speed_kmh", "total_distance_km", "on_time_percentage", "duration_hours")


_PERF = "kafka_offset, stop_id, line_id, delay_category, CAST(hour_of_day AS INT) AS hour_of_day, CAST(day_of_week AS INT) AS day_of_week, historical_arrival_count, round(historical_avg_delay, 6) AS historical_avg_delay, round(historical_stddev_delay, 6) AS historical_stddev_delay, round(historical_on_time_pct, 6) AS historical_on_time_pct, round(avg_dwell_time_ms, 6) AS avg_dwell_time_ms"


@query(f"SELECT {_PERF} FROM perf", "perf")
def stop_performance_windows(s, d):
    p = _perf(s, d).select("kafka_offset", "stop_id", "line_id", "delay_category", "hour_of_day", "day_of_week", "historical_arrival_count", "historical_avg_delay", "historical_stddev_delay", "historical_on_time_pct", "avg_dwell_time_ms")
    return r6(p, "historical_avg_delay", "historical_stddev_delay", "historical_on_time_pct", "avg_dwell_time_ms")


@query("SELECT stop_id, stop_name, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, zone_id, stop_code, CAST(valid_from AS DATE) AS valid_from FROM dim_stops", "dim_stops")
def dim_stops_discovery(s, d):
    return r6(_dim_stops(s, d).select("stop_id", "stop_name", "stop_lat", "stop_lon", "zone_id", "stop_code", F.to_date("valid_from").alias("valid_from")), "stop_lat", "stop_lon")


@query("""WITH old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS region FROM customer WHERE c_custkey % 5 > 0), new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_name ELSE c_name END AS name, c_mktsegment AS region FROM customer WHERE c_custkey % 7 > 0)
  SELECT o.id, o.name, o.region, DATE '2026-01-01' AS valid_from, CASE WHEN n.id IS NULL OR n.name <> o.name THEN DATE '2026-01-02' END AS valid_to FROM old o LEFT JOIN new n ON o.id = n.id
  UNION ALL SELECT n.id, n.name, n.region, DATE '2026-01-02', NULL FROM new n LEFT JOIN old o ON o.id = n.id WHERE o.id IS NULL OR o.name <> n.name""")  # fmt: skip
def scd2_snapshot(s, d):
    """Two states of all customers: a fifth comes new, a seventh goes, a quarter changes its name."""
    c = src.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region"))
    one = warehouse.snapshot(None, c.where("id % 5 > 0"), "id", ["name", "region"], "2026-01-01")
    changed = c.where("id % 7 > 0").withColumn("name", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name")))
    two = warehouse.snapshot(one, changed, "id", ["name", "region"], "2026-01-02")
    return two.withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})


@query("SELECT line_id, journey_date AS metric_date, CAST(count(*) AS BIGINT) AS total_journeys, CAST(sum(event_count) AS BIGINT) AS total_events, count(DISTINCT vehicle_id) AS unique_vehicles, round(avg(avg_delay_seconds), 6) AS avg_delay_seconds, round(avg(avg_speed_kmh), 6) AS avg_speed_kmh, round(sum(on_time_count) * 100.0 / sum(event_count), 6) AS on_time_percentage, round(sum(total_distance_km), 6) AS total_distance_km, md5(line_id || '-' || CAST(journey_date AS VARCHAR)) AS metric_id FROM journeys GROUP BY 1, 2", "journeys")
def mart_daily_performance(s, d):
    return r6(warehouse.mart_daily_performance(warehouse.journeys(_stg(s, d))), "avg_delay_seconds", "avg_speed_kmh", "on_time_percentage", "total_distance_km")


@query("""SELECT md5(vehicle_id || '-' || p.stop_id || '-' || p.line_id || '-' || CAST(event_time_ms AS VARCHAR)) AS feature_id, p.stop_id, p.line_id, event_date, CAST(hour_of_day AS INT) AS hour_of_day, CAST(day_of_week AS INT) AS day_of_week, delay_category, historical_arrival_count, round(historical_avg_delay, 6) AS historical_avg_delay, round(historical_stddev_delay, 6) AS historical_stddev_delay, round(historical_on_time_pct, 6) AS historical_on_time_pct, round(avg_dwell_time_ms, 6) AS avg_dwell_time_ms,
  round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, stop_name, zone_id, stop_code, coalesce(line_name, 'Line: ' || p.line_id) AS line_name, coalesce(line_type, 'Unknown') AS line_type, epoch_us(ingestion_time) // 1000 AS ingestion_ms, kafka_partition, kafka_offset
  FROM perf p JOIN dim_stops s ON p.stop_id = s.stop_id LEFT JOIN lines l ON p.line_id = l.line_id""", "perf", "dim_stops", "lines")  # fmt: skip
def mart_stop_arrivals(s, d):
    m = _mart(s, d)
    return r6(m.withColumn("ingestion_ms", F.unix_millis("ingestion_time")).drop("ingestion_time"), "historical_avg_delay", "historical_stddev_delay", "historical_on_time_pct", "avg_dwell_time_ms", "stop_lat", "stop_lon")


@query("SELECT vehicle_id, event_time_ms, kafka_offset, date FROM telemetry QUALIFY row_number() OVER (PARTITION BY vehicle_id, date, event_time_ms ORDER BY kafka_offset DESC) = 1", "telemetry")
def insert_only_merge(s, d):
    path, keys = scratch(s), ["vehicle_id", "date", "event_time_ms"]
    rows = src.telemetry(s, d)
    tables.insert_only_merge(s, rows, path, keys)
    tables.insert_only_merge(s, src.with_replays(rows), path, keys)  # replays are known already
    return tables.read(s, path).select("vehicle_id", "event_time_ms", "kafka_offset", F.col("date").cast("date").alias("date"))


_NEWEST = "QUALIFY row_number() OVER (PARTITION BY vehicle_id, date, event_time_ms ORDER BY kafka_offset DESC) = 1"


@query(f"SELECT vehicle_id, event_time_ms, kafka_offset, date FROM (SELECT *, 0 AS b FROM telemetry WHERE kafka_offset % 3 = 0 {_NEWEST} UNION ALL SELECT *, 1 FROM replayed {_NEWEST}) QUALIFY row_number() OVER (PARTITION BY vehicle_id, date, event_time_ms ORDER BY b) = 1", "telemetry", "replayed")
def batch_merge(s, d):
    """Two batches, the second one again as after a failure; keys of the first stay as they came."""
    path, keys, rows = scratch(s), ["vehicle_id", "date", "event_time_ms"], src.telemetry(s, d)
    day = 24 * batches.HOUR_MS
    batches.merge_batch(s, rows.where("kafka_offset % 3 = 0"), path, keys, 0, slot_ms=day)
    for _ in range(2):
        batches.merge_batch(s, src.with_replays(rows), path, keys, 1, slot_ms=day)
    return tables.read(s, path).select("vehicle_id", "event_time_ms", "kafka_offset", F.col("date").cast("date").alias("date"))


@query("""WITH m AS (SELECT o_orderpriority AS line_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2) SELECT line_id, date, CASE WHEN day(date) % 2 = 0 THEN n * 2 ELSE n END AS n FROM m""")
def upsert_merge(s, d):
    path = scratch(s)
    rows = src.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("line_id"), F.date_trunc("month", F.col("o_orderdate")).cast("date").alias("month"), F.col("o_orderdate").cast("date").alias("day")).count()
    # a table by month, as the driver's orders span years; its key holds the day
    rows = rows.select("line_id", "day", F.col("count").alias("n"), F.col("month").alias("date"))
    tables.upsert_merge(s, rows.where("line_id <> '1-URGENT' or day(day) % 2 = 0"), path, ["line_id", "day", "date"])
    tables.upsert_merge(s, rows.where("day(day) % 2 = 0 or line_id = '1-URGENT'").withColumn("n", F.when(F.day("day") % 2 == 0, F.col("n") * 2).otherwise(F.col("n"))), path, ["line_id", "day", "date"])
    return tables.read(s, path).select("line_id", F.col("day").alias("date"), "n")


@query("SELECT date, count(*) AS n FROM telemetry WHERE date >= (SELECT max(date) FROM telemetry) - INTERVAL 7 DAY GROUP BY 1", "telemetry")
def retention(s, d):
    path, rows = scratch(s), src.telemetry(s, d)
    tables.append(rows.select("vehicle_id", "date"), path)
    tables.apply_retention(s, path, 7, str(rows.agg(F.max("date")).first()[0]))
    return tables.read(s, path).groupBy(F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"))


@query("SELECT DATE '2024-01-03' AS date, 'enriched' AS table_name, a AS stream_count, b AS batch_count, abs(a - b) AS difference, round(CASE WHEN a > 0 THEN abs(a - b) * 100.0 / a ELSE 100.0 END, 6) AS diff_percentage, CASE WHEN a > 0 THEN abs(a - b) * 100.0 / a ELSE 100.0 END <= 20 AS passed, 20.0::DOUBLE AS threshold_pct FROM (SELECT (SELECT count(*) FROM replayed WHERE date = DATE '2024-01-03') AS a, (SELECT count(*) FROM silver WHERE date = DATE '2024-01-03') AS b)", "replayed", "silver")
def reconciliation(s, d):
    return r6(monitor.reconcile(src.with_replays(src.telemetry(s, d)), _silver(s, d), "enriched", "2024-01-03"), "diff_percentage")


@query("SELECT reason, count(*) AS count FROM raw GROUP BY 1", "raw")
def ingest_reasons(s, d):
    return validate.counters(validate.classify(src.raw_messages(s, d)))


@query("SELECT reason, count(*) AS count, CAST(CASE WHEN reason = 'valid' THEN count(*) ELSE 0 END AS BIGINT) AS telemetry, CAST(CASE WHEN reason IN ('valid', 'missing_vp_wrapper') THEN 0 ELSE count(*) END AS BIGINT) AS letters FROM raw GROUP BY 1", "raw")
def ingest_stream(s, d):
    """The same through the stream: its counters, and the rows of its tables by reason."""
    landing, root = scratch(s), scratch(s)
    src.raw_messages(s, d).select("value", "topic", F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp")).write.parquet(landing)
    rows = connectors.file_stream(s, landing, "value string, topic string, partition int, offset long, timestamp timestamp")
    ingest_streams.ingest(rows, root, scratch(s)).awaitTermination()
    kept = tables.read(s, f"{root}/telemetry").select(F.lit("valid").alias("reason"), F.lit(1).alias("t"), F.lit(0).alias("l"))
    letters = tables.read(s, f"{root}/dead_letters").select(F.col("error_message").alias("reason"), F.lit(0).alias("t"), F.lit(1).alias("l"))
    sums = kept.unionByName(letters).groupBy("reason").agg(F.sum("t").alias("telemetry"), F.sum("l").alias("letters"))
    counts = tables.read(s, f"{root}/counters").groupBy("reason").agg(F.sum("count").alias("count"))
    return counts.join(sums, "reason", "left").fillna(0)


@query("SELECT md5(value) AS payload_md5, reason AS error_message, field AS error_field, 'raw' AS topic, count(*) AS n FROM raw WHERE reason NOT IN ('valid', 'missing_vp_wrapper') GROUP BY 1, 2, 3, 4", "raw")
def dead_letters(s, d):
    letters = validate.split(validate.classify(src.raw_messages(s, d)))[1]
    return letters.groupBy(F.md5("raw_payload").alias("payload_md5"), "error_message", "error_field", "topic").agg(F.count("*").alias("n"))


@query("""SELECT CAST(user_id AS VARCHAR) AS vehicle_id, epoch_us(ts) // 1000 AS timestamp_ms, round(60 + k / 100.0::DOUBLE, 6) AS latitude, 24.9::DOUBLE AS longitude, CASE WHEN k = 7 THEN NULL ELSE CAST(k % 40 AS DOUBLE) END AS speed_ms, CAST(NULL AS INT) AS heading, CASE k WHEN 18 THEN 12 WHEN 23 THEN 100 END AS delay_seconds, CASE k WHEN 16 THEN 1 END AS door_status, CAST(NULL AS BIGINT) AS odometer,
  CAST(NULL AS VARCHAR) AS next_stop_id, CAST(NULL AS VARCHAR) AS route_id, event_type AS line_id, CASE k WHEN 20 THEN 2 WHEN 21 THEN 1 ELSE CAST(user_id % 2 + 1 AS INT) END AS direction_id, 0 AS operator_id, CAST(NULL AS VARCHAR) AS journey_start, epoch_us(ts) // 1000 AS event_time_ms FROM raw WHERE reason = 'valid'""", "raw")  # fmt: skip
def ingest_valid(s, d):
    good = validate.split(validate.classify(src.raw_messages(s, d)))[0]
    return r6(good.withColumn("timestamp_ms", F.unix_millis("timestamp")).drop("timestamp"), "latitude")


@query("SELECT reason, count(*) AS count FROM (SELECT CASE WHEN k IN (1, 2, 15, 25) THEN reason WHEN k = 26 THEN 'runtime_error' WHEN k = 14 OR event_type <> 'click' THEN 'filtered' ELSE reason END AS reason FROM raw) GROUP BY 1", "raw")
def ingest_one_line(s, d):
    """Ingest that follows one line: messages of other lines are counted, not kept."""
    return validate.counters(validate.classify(src.raw_messages(s, d), line="click"))


@query("SELECT event_id, k NOT IN (1, 2, 6, 15, 19, 25, 26) AS valid, CASE WHEN k IN (6, 15) THEN 'veh' WHEN k = 19 THEN 'spd' END AS error_field FROM raw", "raw")
def schema_conformance(s, d):
    """The inner part of messages against a declared schema: valid, and the first field in error."""
    inner = src.raw_messages(s, d).withColumn("value", F.get_json_object("value", "$.VP"))
    return validate.conforms(inner, "veh bigint, tst string, desi string, spd double, lat double", ("veh", "tst", "desi")).select("event_id", "valid", "error_field")


@query("""SELECT b.le, (SELECT count(*) FROM raw WHERE k - 20 > 0 AND (k - 20) / 10.0::DOUBLE <= b.x) AS n FROM (VALUES ('0.1', 0.1::DOUBLE), ('0.5', 0.5), ('1.0', 1), ('2.0', 2), ('5.0', 5), ('10.0', 10), ('30.0', 30), ('Infinity', 1e300)) AS b(le, x)""", "raw")
def ingest_latency(s, d):
    """Receipt from 2 seconds before to 8 seconds after the event."""
    rows = src.raw_messages(s, d).select(F.col("ts").alias("timestamp"), (F.col("ts") + F.make_dt_interval(secs=((F.col("k") - 20) / 10).cast("decimal(18,6)"))).alias("received_at"))
    return validate.ingest_latency(rows)


@query("SELECT b.le, (SELECT count(*) FROM predictions WHERE latency_ms <= b.x) AS n, (SELECT sum(latency_ms) FROM predictions) AS total FROM (VALUES ('1.0', 1.0), ('5.0', 5.0), ('10.0', 10.0), ('50.0', 50.0), ('Infinity', 1e300)) AS b(le, x)", "predictions")
def latency_histogram(s, d):
    return monitor.latency_histogram(src.predictions(s, d), "latency_ms", [1, 5, 10, 50])


@query("""SELECT window_start, count(DISTINCT vehicle_id) AS active_vehicles FROM (SELECT vehicle_id, unnest(generate_series(0, 5)) AS i, time_bucket(INTERVAL 10 SECOND, kafka_timestamp) AS b FROM telemetry) t, (SELECT 0) z, LATERAL (SELECT b - i * INTERVAL 10 SECOND AS window_start) w GROUP BY 1""", "telemetry")
def active_vehicles_sliding(s, d):
    return active_vehicles(src.telemetry(s, d)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "active_vehicles")


@query("SELECT time_bucket(INTERVAL 10 SECOND, kafka_timestamp) AS window_start, count(*) AS n, count(*) / 10.0::DOUBLE AS per_second FROM telemetry GROUP BY 1", "telemetry")
def message_rate_tumbling(s, d):
    rate = monitor.windowed(src.telemetry(s, d), "kafka_timestamp", "10 seconds", F.count("*").alias("n"), (F.count("*") / 10).alias("per_second"))
    return rate.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT vehicle_id, f.l AS line_id, f.d AS current_delay, CAST(printf('%.4f', f.dt) AS DOUBLE) AS delay_trend, f.s AS current_speed, f.z AS is_stopped, f.sd AS stopped_duration_ms, f.n AS next_stop_id, f.u AS updated_at FROM online", "online")
def online_features_latest(s, d):
    return features.online_latest(_enriched(s, d)).select("vehicle_id", "line_id", "current_delay", "delay_trend", "current_speed", "is_stopped", "stopped_duration_ms", "next_stop_id", "updated_at")


def _requests(s, d):
    return src.table(s, d, "orders").selectExpr("o_orderkey as request_id", "cast(o_custkey % 50 as string) as vehicle_id", "case when o_orderkey % 11 > 0 then concat('S', cast(o_orderkey % 6 as string)) end as stop_id", "case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'view' else 'error' end as line_id", "case when o_orderkey % 13 > 0 then cast(o_orderkey % 24 as int) end as hour_of_day", "case when o_orderkey % 17 > 0 then cast(o_orderkey % 7 as int) end as day_of_week", "cast(o_orderdate as timestamp) as request_time")


def _match(requests: str) -> str:
    return f"""SELECT r.*, m.line_id AS h_line, m.hour_of_day AS h_hour, m.day_of_week AS h_dow, historical_arrival_count, historical_avg_delay, historical_stddev_delay, avg_dwell_time_ms, m.stop_lat, m.stop_lon, m.stop_id IS NOT NULL AS offline_available FROM {requests} r LEFT JOIN history m ON r.stop_id = m.stop_id AND (r.line_id IS NULL OR r.line_id = m.line_id)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY coalesce(m.hour_of_day = r.hour_of_day AND m.day_of_week = r.day_of_week, false) DESC, abs(m.hour_of_day - r.hour_of_day) NULLS LAST, m.line_id NULLS FIRST, m.day_of_week NULLS FIRST, m.hour_of_day NULLS FIRST) = 1"""


@query(f"SELECT request_id, h_line, CAST(h_hour AS INT) AS h_hour, CAST(h_dow AS INT) AS h_dow, historical_arrival_count, round(historical_avg_delay, 6) AS historical_avg_delay, round(historical_stddev_delay, 6) AS historical_stddev_delay FROM ({_match('requests')})", "requests", "history")
def offline_best_match(s, d):
    found = features.best_match(_requests(s, d), features.history(_mart(s, d)))
    return r6(found.select("request_id", "h_line", "h_hour", "h_dow", "historical_arrival_count", "historical_avg_delay", "historical_stddev_delay"), "historical_avg_delay", "historical_stddev_delay")


_VECTOR_SQL = """SELECT request_id, vehicle_id, coalesce(f.d, 0) AS current_delay, coalesce(CAST(printf('%.4f', f.dt) AS DOUBLE), 0.0) AS delay_trend, coalesce(f.s, 0.0) AS current_speed, coalesce(CAST(printf('%.4f', f.st) AS DOUBLE), 0.0) AS speed_trend, CAST(coalesce(f.z, false) AS INT) AS is_stopped, coalesce(f.sd, 0) AS stopped_duration_ms,
  round(CASE WHEN coalesce(f.la, 0.0) = 0.0 THEN coalesce(stop_lat, 0.0) ELSE f.la END, 6) AS latitude, round(CASE WHEN coalesce(f.la, 0.0) = 0.0 THEN coalesce(stop_lon, 0.0) ELSE coalesce(f.lo, 0.0) END, 6) AS longitude,
  round(coalesce(historical_avg_delay, 0.0), 6) AS historical_avg_delay, round(coalesce(historical_stddev_delay, 0.0), 6) AS historical_stddev_delay, coalesce(avg_dwell_time_ms, 0.0) AS avg_dwell_time_ms, coalesce(historical_arrival_count, 0) AS historical_arrival_count, -1 AS feature_age_ms FROM ({})"""


def _vector(rows):
    return r6(features.vector(rows), "current_speed", "latitude", "longitude", "historical_avg_delay", "historical_stddev_delay", "avg_dwell_time_ms")


@query(_VECTOR_SQL.format(_match("live")), "live", "history")
def feature_vector(s, d):
    """All keys; stop, line, hour and day of a request default to the vehicle's and the request's."""
    return _vector(features.combined(_requests(s, d), *_live(s, d)))


@query(_VECTOR_SQL.format(_match("(SELECT * REPLACE (CASE WHEN line_id IS NOT NULL THEN stop_id END AS stop_id) FROM live)")), "live", "history")
def feature_vector_serving(s, d):
    """The serving variant: history only where stop and line are known."""
    return _vector(features.combined(_requests(s, d), *_live(s, d), both_known=True))


@query("SELECT count(*) AS requests, round(avg(CAST(online_available AS INT)), 6) AS online_hit_rate, round(avg(CAST(offline_available AS INT)), 6) AS offline_hit_rate FROM (" + _match("live") + ")", "live", "history")
def feature_hit_rates(s, d):
    both = features.combined(_requests(s, d), *_live(s, d))
    return r6(features.hit_rates(both), "online_hit_rate", "offline_hit_rate")


@query("""SELECT vehicle_id, CASE WHEN event_time_ms % 5 > 0 THEN line_id END AS line_id, CASE WHEN event_time_ms % 7 > 0 THEN delay_seconds ELSE 0 END AS current_delay, CASE WHEN event_time_ms % 3 = 0 THEN speed_ms ELSE 0.0 END AS current_speed, kafka_offset % 2 = 0 AS is_stopped, trim(next_stop_id) AS next_stop_id, event_time_ms AS updated_at, 2000000000000 - event_time_ms AS feature_age_ms FROM telemetry""", "telemetry")
def online_record_parse(s, d):
    """Text records of an online store: other names, 'None', text for numbers and booleans."""
    rows = src.telemetry(s, d).selectExpr("vehicle_id", "case when event_time_ms % 5 > 0 then line_id when event_time_ms % 2 = 0 then 'None' else '' end as line_id", "case when event_time_ms % 7 > 0 then cast(delay_seconds as string) else 'no number' end as delay", "case when event_time_ms % 3 = 0 then cast(speed_ms as string) end as speed", "case when kafka_offset % 2 = 0 then 'TRUE' else 'False' end as is_stopped", "trim(next_stop_id) as next_stop_id", "cast(event_time_ms as string) as event_time_ms", "2000000000000 as now_ms")
    return features.parse_hash(rows).select("vehicle_id", "line_id", "current_delay", "current_speed", "is_stopped", "next_stop_id", "updated_at", "feature_age_ms")


_NOW = "(SELECT max(event_time_ms) + 60000 FROM telemetry)"


@query(f"SELECT vehicle_id, f.u AS updated_at, {_NOW} - f.u AS feature_age_ms FROM online WHERE {_NOW} - f.u <= 300000 ORDER BY vehicle_id LIMIT 50", "telemetry", "online")
def active_vehicle_listing(s, d):
    """The first 50 vehicles with unexpired features, by id."""
    now = src.telemetry(s, d).agg(F.max("event_time_ms")).first()[0] + 60_000
    return features.active(features.online_latest(_enriched(s, d)), now)[0].select("vehicle_id", "updated_at", "feature_age_ms")


@query(f"SELECT count(*) AS active_vehicles FROM online WHERE {_NOW} - f.u <= 300000", "telemetry", "online")
def active_vehicle_count(s, d):
    now = src.telemetry(s, d).agg(F.max("event_time_ms")).first()[0] + 60_000
    return features.active(features.online_latest(_enriched(s, d)), now)[1]


@query("SELECT request_id, hour_of_day, day_of_week, ok FROM (SELECT request_id, CAST(request_id % 27 AS INT) AS hour_of_day, CAST(request_id % 9 AS INT) AS day_of_week, request_id % 27 <= 23 AND request_id % 9 <= 6 AS ok FROM requests)", "requests")
def request_bounds(s, d):
    """Requests of predictions, split by their bounds."""
    rows = _requests(s, d).select("request_id", (F.col("request_id") % 27).cast("int").alias("hour_of_day"), (F.col("request_id") % 9).cast("int").alias("day_of_week"))
    good, bad = features.valid_requests(rows, 6)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


_DRIFT = """, long AS (SELECT 'delay' AS feature, CAST(delay_seconds AS DOUBLE) AS x, kafka_offset % 3 = 0 AS base FROM telemetry UNION ALL SELECT 'speed', speed_ms, kafka_offset % 3 = 0 OR line_id = 'view' FROM telemetry UNION ALL SELECT 'latitude', latitude, kafka_offset % 3 = 0 FROM telemetry WHERE latitude IS NOT NULL),
  edges AS (SELECT feature, list_slice(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), 2, 10) AS e FROM long WHERE base GROUP BY 1),
  tot AS (SELECT feature, count(*) FILTER (base) AS nb, count(*) FILTER (NOT base) AS nc FROM long GROUP BY 1),
  cell AS (SELECT l.feature, len(list_filter(e.e, lambda v: v <= l.x)) AS bucket, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS c FROM long l JOIN edges e ON l.feature = e.feature GROUP BY 1, 2),
  grid AS (SELECT tot.feature, g.i, greatest(coalesce(b, 0) / nb::DOUBLE, 1e-4) AS e, greatest(coalesce(c, 0) / nc::DOUBLE, 1e-4) AS a FROM tot CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS i) g LEFT JOIN cell ON cell.feature = tot.feature AND cell.bucket = g.i),
  psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM grid GROUP BY 1) """


def _drift(s, d):
    rows = src.telemetry(s, d).withColumns({"delay": F.col("delay_seconds"), "speed": F.col("speed_ms")})
    base = F.col("kafka_offset") % 3 == 0
    one, two = monitor.long_form(rows.where(base), ["delay", "latitude"]), monitor.long_form(rows.where(~base), ["delay", "latitude"])
    mixed = base | (F.col("line_id") == "view")
    return monitor.psi(one.unionByName(monitor.long_form(rows.where(mixed), ["speed"])), two.unionByName(monitor.long_form(rows.where(~mixed), ["speed"])))


def _with(body: str) -> str:
    """The drift inputs continue the list of inputs."""
    return sql("", "telemetry").rstrip() + _DRIFT + body


@query()
def psi_drift(s, d):
    return r6(_drift(s, d), "psi")


@query()
def drift_severity(s, d):
    return monitor.severity(_drift(s, d)).select("feature", "severity")


@query()
def retrain_decision(s, d):
    return monitor.retrain_decision(_drift(s, d), dry_run=False)


ORACLES["psi_drift"] = _with("SELECT feature, round(psi, 6) AS psi FROM psi")
ORACLES["drift_severity"] = _with("SELECT feature, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'moderate' ELSE 'high' END AS severity FROM psi")
ORACLES["retrain_decision"] = _with("SELECT count(*) FILTER (psi > 0.2) > 0 AS retrain, CASE WHEN count(*) FILTER (psi > 0.2) > 0 THEN 'drift in ' || string_agg(feature, ', ' ORDER BY feature) FILTER (psi > 0.2) ELSE 'no drift' END AS reason, CASE WHEN count(*) FILTER (psi > 0.2) > 0 THEN 'trigger' ELSE 'skip' END AS action FROM psi")


@query("""SELECT 'inference_latency' AS name, 'p99_latency_ms' AS metric, v AS value, 50.0::DOUBLE AS target, CASE WHEN v > 50 THEN 'breached' WHEN v > 40 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT round(quantile_cont(latency_ms, 0.99), 6) AS v FROM predictions)
  UNION ALL SELECT 'shadow_agreement', 'agreement_rate', v, 0.9, CASE WHEN v < 0.9 THEN 'breached' ELSE 'ok' END FROM (SELECT round(avg(CASE WHEN abs(prod - shadow) <= 60 THEN 1.0 ELSE 0.0 END), 6) AS v FROM predictions)""", "predictions")  # fmt: skip
def slo_check(s, d):
    p = src.predictions(s, d)
    latency = monitor.latency_summary(p, "latency_ms").select(F.lit("p99_latency_ms").alias("metric"), F.round("p99", 6).alias("value"))
    agreed = ml.agreement(ml.shadow(p)).select(F.lit("agreement_rate").alias("metric"), F.round("agreement_rate", 6).alias("value"))
    return monitor.slo_check(s, latency.unionByName(agreed))


@query("SELECT count(*) AS n, round(avg(CASE WHEN abs(prod - shadow) <= 60 THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate, count(*) FILTER (abs(prod - shadow) > 120) AS divergent, round(avg(abs(prod - shadow)), 6) AS mean_diff FROM predictions", "predictions")
def shadow_agreement(s, d):
    return r6(ml.agreement(ml.shadow(src.predictions(s, d))), "agreement_rate", "mean_diff")


@query("SELECT request_id, CAST(count(*) OVER w AS BIGINT) AS compared, round(avg(CASE WHEN abs(prod - shadow) <= 60 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS agreement_rate FROM predictions WINDOW w AS (PARTITION BY vehicle_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "predictions")
def shadow_agreement_running(s, d):
    """The agreement so far after each comparison of a vehicle."""
    return r6(ml.running_agreement(ml.shadow(src.predictions(s, d)), ["vehicle_id"], "request_id").select("request_id", "compared", "agreement_rate"), "agreement_rate")


@query("""SELECT version, status, b.le, count(*) FILTER (x <= b.v) AS n, any_value(total) AS total FROM (SELECT CASE WHEN request_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN request_id % 10 = 0 THEN 'error' ELSE 'success' END AS status, latency_ms / 1000.0::DOUBLE AS x, count(*) OVER (PARTITION BY request_id % 3 = 0, request_id % 10 = 0) AS total FROM predictions) p,
  (VALUES ('0.005', 0.005::DOUBLE), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('Infinity', 1e300)) AS b(le, v) GROUP BY 1, 2, 3""", "predictions")  # fmt: skip
def prediction_latency(s, d):
    """Histogram and count of predictions by model version and status."""
    rows = src.predictions(s, d).select(F.when(F.col("request_id") % 3 == 0, "v2").otherwise("v1").alias("version"), F.when(F.col("request_id") % 10 == 0, "error").otherwise("success").alias("status"), (F.col("latency_ms") / 1000.0).alias("x"))
    return monitor.prediction_histogram(rows, "x", ["version", "status"])


@query("SELECT stop_id, line_id, CAST(hour_of_day AS INT) AS hour_of_day, CAST(day_of_week AS INT) AS day_of_week, historical_arrival_count, round(historical_avg_delay, 6) AS historical_avg_delay, round(avg_dwell_time_ms, 6) AS avg_dwell_time_ms FROM perf JOIN (SELECT stop_id FROM dim_stops) USING (stop_id)", "perf", "dim_stops")
def training_set(s, d):
    """The columns of the stop mart that a model is trained on."""
    mart = _mart(s, d)
    return r6(ml.training_set(mart), "historical_avg_delay", "avg_dwell_time_ms")


@query("SELECT quantile_cont(latency_ms, 0.5) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, max(latency_ms) AS max FROM predictions", "predictions")
def latency_percentiles(s, d):
    return r6(monitor.latency_summary(src.predictions(s, d), "latency_ms"), "p95", "p99")


@query("SELECT round(avg(abs(actual - prod)), 6) AS mae, round(sqrt(avg(pow(actual - prod, 2))), 6) AS rmse, round(1 - sum(pow(actual - prod, 2)) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)), 6) AS r2, 1 - sum(pow(actual - prod, 2)) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)) >= 0.75 AND avg(abs(actual - prod)) <= 120 AS passed FROM predictions", "predictions")
def regression_metrics(s, d):
    return r6(ml.gate(ml.metrics(src.predictions(s, d), "actual", "prod")), "mae", "rmse", "r2")


@query()
def delay_model(s, d):
    """Train on four fifths of the stop mart, score the rest beside the mean of the training rows; no SQL form."""
    fit, test, used = _delays(s, d)
    scored = ml.score(ml.train(fit, used), test, used)
    return ml.compared(scored, {"delay_model": F.col("prediction"), "mean": F.lit(ml.mean_predictor(fit))})


def _delays(s, d):
    path = scratch(s)
    rows, used = ml.prepare(_perf(s, d).withColumn("label_delay", F.col("delay_seconds")), "label_delay")
    rows.write.parquet(path)
    return *ml.split(s.read.parquet(path)), used


@query()
def two_models(s, d):
    """A saved model in use and a saved candidate score the held-out rows in one pass, beside the mean; no SQL form."""
    (fit, test, used), root = _delays(s, d), scratch(s)
    ml.save(ml.train(fit, used, trees=5, depth=3), f"{root}/production")
    ml.save(ml.train(fit, used, trees=20, depth=5), f"{root}/candidate")
    scored = ml.score_two(test, ml.load(s, f"{root}/production"), ml.load(s, f"{root}/candidate"))
    agreed = scored.agg(F.avg(F.col("agreed").cast("double")).alias("agreement_rate"), F.count_if("divergent").alias("divergent"))
    return ml.compared(scored, {"production": F.col("prod"), "candidate": F.col("shadow"), "mean": F.lit(ml.mean_predictor(fit))}).join(agreed, F.lit(True))  # one row


@query("SELECT 'latitude' AS column, count(*) FILTER (latitude IS NULL) AS failures FROM telemetry UNION ALL SELECT 'next_stop_id', count(*) FILTER (next_stop_id IS NULL) FROM telemetry UNION ALL SELECT 'vehicle_id', count(*) FILTER (vehicle_id IS NULL) FROM telemetry", "telemetry")
def dq_not_null(s, d):
    return monitor.not_null(src.telemetry(s, d), ["latitude", "next_stop_id", "vehicle_id"])


@query("SELECT vehicle_id, event_time_ms, count(*) AS count FROM replayed GROUP BY 1, 2 HAVING count(*) > 1", "replayed")
def dq_unique(s, d):
    return monitor.duplicates(src.with_replays(src.telemetry(s, d)), ["vehicle_id", "event_time_ms"])


@query("SELECT line_id, count(*) AS n FROM telemetry WHERE line_id NOT IN ('click', 'view') GROUP BY 1", "telemetry")
def dq_accepted_values(s, d):
    return monitor.not_accepted(src.telemetry(s, d), "line_id", ["click", "view"]).groupBy("line_id").agg(F.count("*").alias("n"))


_CHECKS = [
    monitor.Check("position", "not_null", ("latitude",)), monitor.Check("stop", "not_null", ("next_stop_id",), level="warn"), monitor.Check("known_line", "accepted", ("line_id",), ("click", "view")),
    monitor.Check("speed", "between", ("speed_ms",), (0, 15)), monitor.Check("event", "unique", ("vehicle_id", "event_time_ms")), monitor.Check("mapped_stop", "related", ("next_stop_id",), ("stops", "stop_id"), "warn"),
]
_FAILS = """SELECT kafka_offset, 'position' AS name, 'error' AS level FROM replayed WHERE latitude IS NULL UNION ALL SELECT kafka_offset, 'stop', 'warn' FROM replayed WHERE next_stop_id IS NULL UNION ALL SELECT kafka_offset, 'known_line', 'error' FROM replayed WHERE line_id NOT IN ('click', 'view')
  UNION ALL SELECT kafka_offset, 'speed', 'error' FROM replayed WHERE speed_ms NOT BETWEEN 0 AND 15 UNION ALL SELECT kafka_offset, 'mapped_stop', 'warn' FROM replayed WHERE next_stop_id NOT IN (SELECT stop_id FROM stops)"""


@query(f"SELECT n.name, n.level, coalesce(f.failures, 0) AS failures FROM (VALUES ('position', 'error'), ('stop', 'warn'), ('known_line', 'error'), ('speed', 'error'), ('event', 'error'), ('mapped_stop', 'warn')) AS n(name, level) LEFT JOIN (SELECT name, count(*) AS failures FROM ({_FAILS}) GROUP BY 1 UNION ALL SELECT 'event', count(*) FROM (SELECT 1 FROM replayed GROUP BY vehicle_id, event_time_ms HAVING count(*) > 1)) f ON f.name = n.name", "replayed", "stops")
def dq_all_checks(s, d):
    """A declared set of checks: those of rows in one scan."""
    return monitor.quality(src.with_replays(src.telemetry(s, d)), _CHECKS, {"stops": src.stops(s, d)})


@query(f"{_FAILS} UNION ALL SELECT kafka_offset, 'event', 'error' FROM replayed WHERE (vehicle_id, event_time_ms) IN (SELECT (vehicle_id, event_time_ms) FROM replayed GROUP BY vehicle_id, event_time_ms HAVING count(*) > 1)", "replayed", "stops")
def dq_failing_rows(s, d):
    rows = monitor.failing_rows(src.with_replays(src.telemetry(s, d)), _CHECKS, {"stops": src.stops(s, d)})
    return rows.select("kafka_offset", F.col("check").alias("name"), "level")


@query("SELECT next_stop_id AS stop_id, count(*) AS n FROM stg WHERE next_stop_id IS NOT NULL AND next_stop_id NOT IN (SELECT stop_id FROM stops) GROUP BY 1", "stg", "stops")
def dq_relationships(s, d):
    child = _stg(s, d).withColumnRenamed("next_stop_id", "stop_id")
    return monitor.orphans(child, "stop_id", src.stops(s, d), "stop_id").groupBy("stop_id").agg(F.count("*").alias("n"))


@query("SELECT round((epoch_us(TIMESTAMP '2030-01-01') - epoch_us(max(kafka_timestamp))) / 3.6e9, 6) AS age_hours, 'error' AS state FROM telemetry", "telemetry")
def source_freshness(s, d):
    return r6(monitor.freshness(src.telemetry(s, d), "kafka_timestamp", "2030-01-01"), "age_hours")


@query("SELECT CAST(sum(n) AS BIGINT) AS messages FROM (SELECT kafka_partition, max(kafka_offset) - min(kafka_offset) + 1 AS n FROM telemetry GROUP BY 1)", "telemetry")
def topic_volume(s, d):
    return monitor.topic_volume(src.telemetry(s, d))


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, quantile_cont(latency_ms, 0.5) AS p50, round(quantile_cont(latency_ms, 0.99), 6) AS p99, count(*) AS n, round(count(*) / 60.0::DOUBLE, 6) AS per_second FROM (SELECT ts, value AS latency_ms FROM events) GROUP BY 1")
def latency_by_minute(s, d):
    rows = src.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    return r6(monitor.latency_windows(rows, "ts", "latency_ms"), "p99", "per_second").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_LATENCY = [5, 10, 25, 50, 100, 250]


@query("""SELECT window_start, n, CASE WHEN n > 0 THEN round(low50 + (high50 - low50) * (r50 - b50) / c50, 6) END AS p50, CASE WHEN n > 0 THEN round(low99 + (high99 - low99) * (r99 - b99) / c99, 6) END AS p99 FROM (
  SELECT window_start, n, r50, r99, arg_min(lo, i) FILTER (upto >= r50) AS low50, arg_min(hi, i) FILTER (upto >= r50) AS high50, arg_min(upto - c, i) FILTER (upto >= r50) AS b50, arg_min(c, i) FILTER (upto >= r50) AS c50, arg_min(lo, i) FILTER (upto >= r99) AS low99, arg_min(hi, i) FILTER (upto >= r99) AS high99, arg_min(upto - c, i) FILTER (upto >= r99) AS b99, arg_min(c, i) FILTER (upto >= r99) AS c99
  FROM (SELECT window_start, i, lo, hi, c, sum(c) OVER (PARTITION BY window_start ORDER BY i) AS upto, n, n * 0.5::DOUBLE AS r50, n * 0.99::DOUBLE AS r99 FROM (
    SELECT window_start, i, any_value(b.lo) AS lo, any_value(b.hi) AS hi, count(*) FILTER (value > CASE WHEN i = 0 THEN -1e300 ELSE b.lo END AND value <= CASE WHEN i = 6 THEN 1e300 ELSE b.hi END) AS c, count(*) AS n
    FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, value FROM events) e, (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5, 10), (2, 10, 25), (3, 25, 50), (4, 50, 100), (5, 100, 250), (6, 250, 250)) AS b(i, lo, hi) GROUP BY 1, 2)) GROUP BY 1, 2, 3, 4)""")
def latency_quantiles(s, d):
    """Quantiles of hours from the bucket counts of their minutes."""
    rows = src.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    minutes = monitor.bucket_states(rows, "latency_ms", _LATENCY, F.window("ts", "1 minute").alias("w"))
    hours = monitor.added_states(minutes.withColumn("window_start", F.date_trunc("hour", F.col("w.start"))), "window_start")
    return r6(monitor.state_quantiles(hours, _LATENCY, {"p50": 0.5, "p99": 0.99}).drop("counts"), "p50", "p99").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(avg(abs(value - user_id % 150)), 6) AS mean_divergence FROM events GROUP BY 1")
def shadow_divergence(s, d):
    """Mean difference of two models' predictions in each window of five minutes."""
    rows = ml.shadow(src.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("prod"), (F.col("user_id") % 150).cast("double").alias("shadow")))
    return r6(monitor.windowed(rows, "ts", "5 minutes", F.avg("diff").alias("mean_divergence")), "mean_divergence").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, sum(gap) OVER (PARTITION BY vehicle_id ORDER BY kafka_offset) AS session FROM (SELECT *, CASE WHEN event_time_ms - lag(event_time_ms) OVER (PARTITION BY vehicle_id ORDER BY kafka_offset) > 300000 THEN 1 ELSE 0 END AS gap FROM telemetry))
  SELECT kafka_offset, CAST(session AS BIGINT) AS session, round(delay_seconds - coalesce(avg(delay_seconds) OVER (PARTITION BY vehicle_id, session ORDER BY kafka_offset ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 6) AS delay_trend, coalesce(event_time_ms - lag(event_time_ms) OVER (PARTITION BY vehicle_id, session ORDER BY kafka_offset), 0) AS time_since_last_ms FROM g""".replace("WITH g AS", "SELECT * FROM (WITH g AS") + ")", "telemetry")  # fmt: skip
def enrich_with_expiry(s, d):
    """Features where a vehicle's state ends after five minutes without an event."""
    return r6(enrich.enrich(src.telemetry(s, d), ttl=True).select("kafka_offset", "session", "delay_trend", "time_since_last_ms"), "delay_trend")


@query("SELECT trim(m.stop_id) AS stop_id, trim(line_id) AS line_id, CAST(hour_of_day AS INT) AS hour_of_day, CAST(day_of_week AS INT) AS day_of_week, historical_arrival_count, round(historical_avg_delay, 6) AS historical_avg_delay, avg_dwell_time_ms, s.stop_lat, s.stop_lon FROM stop_metrics m LEFT JOIN stops s ON m.stop_id = s.stop_id WHERE m.stop_id IS NOT NULL AND line_id IS NOT NULL", "stop_metrics", "stops")
def stg_stop_metrics(s, d):
    return r6(warehouse.stg_stop_metrics(_metrics(s, d)).drop("loaded_at"), "historical_avg_delay")


@query("SELECT 'baseline' AS part, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders WHERE o_orderdate > TIMESTAMP '1997-05-27' AND o_orderdate <= TIMESTAMP '1997-06-01' UNION ALL SELECT 'current', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-30' AND o_orderdate <= TIMESTAMP '1997-07-01'")
def drift_samples(s, d):
    """The windows that drift compares: five days that end 30 days back, and the last day."""
    rows = src.table(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    parts = zip(("baseline", "current"), monitor.drift_windows(rows, "o_orderdate", "1997-07-01", least=1), strict=True)
    one, two = (df.agg(F.count("*").alias("n"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last")).select(F.lit(name).alias("part"), "*") for name, df in parts)
    return one.unionByName(two)


@query("SELECT date, count(*) AS audits, count(*) FILTER (NOT passed) AS failed FROM (SELECT date, count(*) FILTER (kafka_offset >= 1000000) * 100.0 / count(*) <= 20 AS passed FROM replayed GROUP BY 1) WHERE date = DATE '2024-01-03' GROUP BY 1", "replayed")
def audit_presence(s, d):
    """Reconciliation rows that are there for a date, and the failed ones."""
    rows = src.with_replays(src.telemetry(s, d)).groupBy("date").agg((F.count_if(F.col("kafka_offset") >= 1_000_000) * 100.0 / F.count("*") <= 20).alias("passed"))
    return monitor.audited(rows, "2024-01-03").select(F.lit("2024-01-03").cast("date").alias("date"), "*")


@query("SELECT vehicle_id, kafka_offset, delay_seconds FROM silver ORDER BY kafka_offset LIMIT 3", "silver")
def silver_samples(s, d):
    """The first rows of a table, for an audit by eye."""
    return monitor.samples(_silver(s, d), ["vehicle_id", "kafka_offset", "delay_seconds"], "kafka_offset")


@query("SELECT 'silver' AS table_name, count(*) > 0 AS present FROM silver WHERE date = DATE '2024-01-03' UNION ALL SELECT 'stop_events', count(*) > 0 FROM arrivals WHERE date = DATE '2024-01-03'", "silver", "arrivals")
def partition_presence(s, d):
    return monitor.presence({"silver": _silver(s, d), "stop_events": _stop_events(s, d)}, "2024-01-03")


@query("""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, line_id, count(DISTINCT vehicle_id) AS active_vehicles, round(avg(delay_seconds), 6) AS avg_delay, max(delay_seconds) AS max_delay, count(*) FILTER (delay_seconds <= 60) AS on_time_count, count(*) FILTER (delay_seconds > 60) AS delayed_count FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, kafka_timestamp) AS window_start FROM telemetry) GROUP BY 1, 2, 3""", "telemetry")
def fleet_metrics(s, d):
    out = r6(monitor.fleet_metrics(src.telemetry(s, d)), "avg_delay")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""SELECT check_date, line_id, CAST(hour_of_day AS INT) AS hour_of_day, round(a, 6) AS stream_avg_delay, round(b, 6) AS batch_avg_delay, round(pct, 6) AS difference_pct, round(pct, 9) <= 20 AS passed FROM (SELECT *, CASE WHEN a = b THEN 0.0::DOUBLE WHEN a IS NULL OR b IS NULL OR a = 0 THEN 100.0::DOUBLE ELSE abs(a - b) * 100.0 / abs(a) END AS pct FROM
  (SELECT CAST(t AS DATE) AS check_date, line_id, hour(t) AS hour_of_day, avg(delay_seconds) AS a FROM (SELECT *, make_timestamp(event_time_ms * 1000) AS t FROM replayed) GROUP BY 1, 2, 3) x FULL JOIN (SELECT CAST(timestamp AS DATE) AS check_date, line_id, hour(timestamp) AS hour_of_day, avg(delay_seconds) AS b FROM silver GROUP BY 1, 2, 3) y USING (check_date, line_id, hour_of_day))""", "replayed", "silver")  # fmt: skip
def hourly_reconciliation(s, d):
    return r6(monitor.reconcile_hours(src.with_replays(src.telemetry(s, d)), _silver(s, d)), "stream_avg_delay", "batch_avg_delay", "difference_pct")


@query("SELECT line_id, date, count(*) AS n, round(avg(delay_seconds), 6) AS avg_delay, count(*) FILTER (delay_seconds <= 300) AS on_time FROM large GROUP BY 1, 2", "large")
def large_daily_metrics(s, d):
    x = F.col("delay_seconds")
    return src.large_arrivals(s, d).groupBy("line_id", "date").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("avg_delay"), F.count_if(x <= 300).alias("on_time"))


@query("SELECT line_id, stop_id, round(avg(m), 6) AS mean_trend, count(*) AS n FROM (SELECT *, delay_seconds - coalesce(avg(delay_seconds) OVER (PARTITION BY stop_id, line_id ORDER BY kafka_offset ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS m FROM large) GROUP BY 1, 2", "large")
def large_stop_windows(s, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("stop_id", "line_id").orderBy("kafka_offset").rowsBetween(-10, -1)
    trend = F.col("delay_seconds") - F.coalesce(F.avg("delay_seconds").over(w), F.lit(0.0))
    return src.large_arrivals(s, d).withColumn("m", trend).groupBy("line_id", "stop_id").agg(F.round(F.avg("m"), 6).alias("mean_trend"), F.count("*").alias("n"))
