"""The driver's tables as transit telemetry: users are vehicles, event types lines, event ids offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What messages are made of.
_EVENT = ("event_id", "user_id", "ts", "event_type", "props")


def _typed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(table(spark, sf_dir, "events"))


def spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows in even parts, two a core: work on them doesn't hang on how many row groups a file happens to have."""
    return rows.repartition(2 * spark.sparkContext.defaultParallelism)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "cast(user_id as string) as vehicle_id",
        "unix_millis(ts) as event_time_ms",
        "case when k = 50 then null else 59.85D + k * 0.006D end as latitude",
        "24.4D + (user_id % 100) * 0.009D as longitude",
        "case when event_type in ('view', 'error') then (k % 10) / 10.0D else k / 5.0D end as speed_ms",
        "cast((k * 3) % 361 as int) as heading",
        "cast(floor(value * 4) as int) - 120 as delay_seconds",
        "case when event_type = 'click' then 1 else 0 end as door_status",
        "event_type as line_id",
        "cast(user_id % 2 + 1 as int) as direction_id",
        "cast(user_id % 5 as int) as operator_id",
        "case when k % 10 = 0 then null when k % 10 = 1 then concat(' S', cast(k % 5 as string), ' ') else concat('S', cast(k % 5 as string)) end as next_stop_id",
        "cast(user_id % 8 as int) as kafka_partition",
        "event_id as kafka_offset",
        "ts as kafka_timestamp",
        "date_trunc('HOUR', ts) as ingestion_time",
        "cast(ts as date) as date",
    )


def with_replays(rows: DataFrame) -> DataFrame:
    """Every tenth row again, with a higher offset and another delay."""
    again = rows.where("kafka_offset % 10 = 0").withColumns({"kafka_offset": F.col("kafka_offset") + 1_000_000, "delay_seconds": F.col("delay_seconds") + 1})
    return rows.unionByName(again)


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the telemetry's five stops; the other two are left out so that there are unmapped ones."""
    key = "cast(r_regionkey as string)"
    return table(spark, sf_dir, "region").where("r_regionkey < 3").selectExpr(f"concat('S', {key}) as stop_id", "r_name as stop_name", "60.0D + r_regionkey * 0.1D as stop_lat", "24.9D as stop_lon", "'A' as zone_id", f"concat('H', {key}) as stop_code")


def lines(spark: SparkSession) -> DataFrame:
    rows = [("click", "Line Click", "bus", "OpA"), ("view", "Line View", "tram", "OpB"), ("signup", "Line Signup", "metro", "OpB"), ("purchase", "Line Purchase", "train", "OpC")]
    return spark.createDataFrame(rows, "line_id string, line_name string, line_type string, operator_name string")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages with planted faults, and with other spellings that are no faults, by k."""
    vp = """concat('{"VP":{"veh":', case when k = 6 then '"abc"' when k = 8 then concat('" ', cast(user_id as string), '"') when k = 9 then concat(cast(user_id as string), '.0') else cast(user_id as string) end,
        ',"tst":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '","tsi":', case when k = 17 then 'null' else '1' end, ',"desi":', case when k = 14 then '7' else concat('"', event_type, '"') end,
        ',"dir":', case when k = 4 then '"x"' when k = 11 then '"0"' when k = 12 then '"-1"' when k = 20 then '" 2 "' when k = 21 then '""' when k = 22 then '2' else concat('"', cast(user_id % 2 + 1 as string), '"') end,
        ',"lat":', case when k = 3 then 'null' when k = 13 then '"60.13"' else concat('60.', lpad(cast(k as string), 2, '0')) end, ',"long":24.9,"spd":', case when k = 5 then '100' when k = 7 then 'null' when k = 19 then '"fast"' else cast(k % 40 as string) end,
        case when k = 10 then ',"dl":5.5' when k = 16 then ',"drst":true' when k = 18 then ',"dl":"12"' when k = 23 then ',"dl":1e2' when k = 24 then ',"dl":"1e2"' else '' end, '}}')"""
    return spread(spark, table(spark, sf_dir, "events").select(*_EVENT)).transform(_typed).selectExpr("event_id", "ts", "k", f"""case when k = 1 then '{{broken' when k = 2 then '{{"XX":1}}' when k = 15 then '{{"VP":[]}}' when k = 25 then '[1]' when k = 26 then '{{"VP":"text"}}' else {vp} end as value""", "'raw' as topic")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as request_id", "cast(o_custkey as string) as vehicle_id", "cast(o_orderkey % 600 as double) as prod", "cast(o_orderkey % 600 + o_custkey % 150 as double) as shadow", "cast((o_orderkey * 7) % 650 as double) as actual", "cast(o_custkey % 97 as double) as latency_ms")


def large_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.selectExpr("cast(l_suppkey as string) as line_id", "cast(l_partkey % 500 as string) as stop_id", "cast(l_shipdate as date) as date", "datediff(cast(l_shipdate as date), cast(o_orderdate as date)) * 10 as delay_seconds", "l_quantity as speed_ms", "l_orderkey * 10 + l_linenumber as kafka_offset")
