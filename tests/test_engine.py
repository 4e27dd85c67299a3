"""Exact cases, idempotent writes, streaming against its batch twin, queries against their SQL."""

import datetime
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from headway.functions import columns as fn
from headway.operators import enrich, features, lakehouse, ml, monitor, tables, validate, warehouse
from headway.plans import queries as q
from headway.session import scratch
from headway.sources import adapters as src
from headway.sources import connectors
from headway.streaming import enrich_stream

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_signed_category(spark):
    df = spark.createDataFrame([(0,), (60,), (61,), (301,), (-301,), (None,)], "x int")
    assert [r[0] for r in df.select(fn.delay_category_signed(F.col("x"))).collect()] == ["on_time", "on_time", "slight_delay", "delayed", "early", "slight_delay"]
    assert df.where("x is null").select(fn.delay_category_gold(F.col("x")), fn.delay_category_mart(F.col("x"))).first() == ("major_delay", "VERY_LATE")


def test_geo(spark):
    at = lambda a, b, c, d: one(spark, fn.haversine_m(*map(F.lit, (a, b, c, d))))[0]
    assert at(60.1, 24.9, 60.1, 24.9) == 0 and 16_000 < at(60.1699, 24.9384, 60.3172, 24.9633) < 18_000
    assert one(spark, fn.in_helsinki_area(F.lit(60.17), F.lit(24.94)), fn.in_helsinki_area(F.lit(59.33), F.lit(18.07))) == (True, False)
    assert one(spark, fn.kmh(F.lit(10.0)))[0] == 36


def telemetry(spark, rows):
    schema = "vehicle_id string, event_time_ms long, latitude double, longitude double, speed_ms double, heading int, delay_seconds int, door_status int, line_id string, direction_id int, operator_id int, next_stop_id string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, ingestion_time timestamp, date date"
    t = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([("v", at, 60.0, 24.0, s, None, d, 0, "l", 1, 1, stop, 0, i, t, t, t.date()) for i, (at, s, d, stop) in enumerate(rows)], schema)


def test_state_features(spark):
    rows = [(5000, 0.0, None, "A"), (15000, 0.0, 10, "A"), (20000, 5.0, 20, "B"), (21000, 5.0, 20, None), (22000, 0.5, 0, "C")]
    out = enrich.enrich(telemetry(spark, rows)).orderBy("kafka_offset").collect()
    assert [r.stopped_duration_ms for r in out] == [0, 10000, 15000, 0, 0]
    assert [r.is_arrival for r in out] == [False, False, True, False, False]
    assert [r.delay_trend for r in out] == [0, 10, 15, 10, -12.5]
    assert [r.time_since_last_ms for r in out] == [0, 10000, 5000, 1000, 1000]


def test_stream_is_batch_twin(spark):
    rows = src.telemetry(spark, SF)
    path, root = scratch(spark), scratch(spark)
    for i in range(3):  # three micro-batches, shuffled inside
        rows.where((F.col("kafka_offset") >= i * 400) & (F.col("kafka_offset") < (i + 1) * 400)).orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(path)
    used = spark.read.parquet(path)
    stream = connectors.file_stream(spark, path, used.schema.simpleString()[7:-1].replace(":", " "), 1)
    query = enrich_stream.run(stream, root, scratch(spark))
    assert query.awaitTermination(120)
    same = ["kafka_offset", "is_stopped", "time_since_last_ms", "stopped_duration_ms", "door_open_duration_ms", "is_arrival"]
    near = [F.round(c, 6).alias(c) for c in ("delay_trend", "speed_trend", "distance_since_last_m")]
    batch = enrich.enrich(used)
    assert batch.count() > 900
    got = tables.read(spark, f"{root}/enriched").select(*same, *near)
    kept = lakehouse.keep_latest(batch, ["vehicle_id", "date", "event_time_ms"]).select(*same, *near)
    assert got.exceptAll(kept).isEmpty() and kept.exceptAll(got).isEmpty()
    assert tables.read(spark, f"{root}/stop_events").count() > 0


def test_merges_run_twice(spark):
    rows = spark.createDataFrame([("a", datetime.date(2026, 1, 1), 1, 1), ("a", datetime.date(2026, 1, 1), 1, 2), ("b", datetime.date(2026, 1, 2), 5, 3), (None, datetime.date(2026, 1, 2), 6, 4)], "vehicle_id string, date date, event_time_ms long, kafka_offset long")
    path = scratch(spark)
    for _ in range(2):
        tables.insert_only_merge(spark, rows, path, ["vehicle_id", "date", "event_time_ms"])
    assert sorted(r.kafka_offset for r in tables.read(spark, path).collect()) == [2, 3]
    path, m = scratch(spark), rows.where("vehicle_id is not null").groupBy("vehicle_id", "date").agg(F.count("*").alias("n"))
    tables.upsert_merge(spark, m, path, ["vehicle_id", "date"])
    for _ in range(2):
        tables.upsert_merge(spark, m.where("vehicle_id = 'a'").withColumn("n", F.lit(9).cast("long")), path, ["vehicle_id", "date"])
    assert sorted((r.vehicle_id, r.n) for r in tables.read(spark, path).collect()) == [("a", 9), ("b", 1)]
    assert not tables.replace_date(spark, m, path, "2030-01-01")


def test_retention_keeps_the_limit(spark):
    days = ["2026-01-06", "2025-12-20", "2025-12-31", "2026-01-01"]
    path = scratch(spark)
    tables.append(spark.createDataFrame([(d,) for d in days], "d string").select("d", F.to_date("d").alias("date")), path)
    assert tables.apply_retention(spark, path, 7, "2026-01-07") == ["2025-12-20"]
    tables.compact(spark, path, "2026-01-01")
    assert sorted(r.d for r in tables.read(spark, path).collect()) == sorted(set(days) - {"2025-12-20"})


def message(**over):
    vp = {"veh": 1, "tst": "2026-01-22T10:00:00Z", "tsi": 1, "desi": "M1", "dir": "1", "oper": 2, "spd": 5.5, "hdg": 10, "lat": 60.1, "long": 24.9, "dl": 3, "drst": 0, "line": 7}
    return json.dumps({"VP": vp | over})


def test_validation(spark):
    cases = [(message(), None), ("{x", "corrupt_json"), ("[1]", "runtime_error"), ('{"X":1}', "missing_vp_wrapper"), (message(lat=None), "gps_dropout"), (message(lat=50), "contract_violation"), (message(spd=100), "contract_violation"), (message(veh="a"), "contract_violation"), (message(dir="x"), "runtime_error"), (message(spd=None, hdg=None, dl=None, drst=None), None), (message(desi=None, line=None), None), (message(tst="2026-01-22T10:00:00"), None)]
    df = spark.createDataFrame([(i, v, "t") for i, (v, _) in enumerate(cases)], "i int, value string, topic string")
    out = validate.classify(df).orderBy("i").collect()
    assert [r.reason for r in out] == [c for _, c in cases]
    assert out[0].event_time_ms == out[11].event_time_ms == 1769076000000 and out[10].line_id == "unknown"
    assert out[9].speed_ms is None and out[9].delay_seconds is None and out[5].error_field == "latitude"


def test_scd2_is_idempotent(spark):
    s = spark.createDataFrame([("1", "x"), ("2", None)], "id string, name string")
    one_ = warehouse.scd2_merge(None, s, "id", ["name"], "2026-01-01")
    again = warehouse.scd2_merge(one_, s, "id", ["name"], "2026-01-02")
    assert again.count() == 2 and again.where("is_current").count() == 2
    three = warehouse.scd2_merge(again, s.withColumn("name", F.lit("y")), "id", ["name"], "2026-01-03")
    assert three.count() == 4 and three.where("is_current").count() == 2


def test_drift_slo_decision_gate(spark):
    rnd = spark.range(4000).select((F.randn(1) * 15 + 100).alias("x"), (F.randn(2) * 15 + 100).alias("y"), (F.randn(3) * 20 + 150).alias("z"), F.lit(1.0).alias("c"), F.lit(2.0).alias("d"))
    of = lambda a, b: monitor.psi(rnd.select(F.lit("f").alias("feature"), F.col(a).alias("x")), rnd.select(F.lit("f").alias("feature"), F.col(b).alias("x"))).first().psi
    assert of("x", "x") < 0.01 and of("x", "y") < 0.02 and of("x", "z") > 0.2 and of("c", "c") == 0 and math.isinf(of("c", "d"))
    m = spark.createDataFrame([("a", 50.0), ("b", 90.0), ("c", 110.0), ("d", 99.9), ("e", 98.0), ("zz", 1.0)], "metric string, value double")
    slos = [(x, x, 100.0, "lt") for x in "abc"] + [(x, x, 99.0, "gt") for x in "de"]
    assert {r.metric: r.status for r in monitor.slo_check(spark, m, slos).collect()} == {"a": "ok", "b": "warning", "c": "breached", "d": "ok", "e": "breached"}
    psi = lambda v: spark.createDataFrame([("p", v), ("q", 0.05)], "feature string, psi double")
    assert monitor.retrain_decision(psi(0.25), dry_run=False).first()[:] == (True, "drift in p", "trigger")
    assert monitor.retrain_decision(psi(0.1)).first().action == "skip"
    g = ml.gate(spark.createDataFrame([(100.0, 0.8), (100.0, 0.6)], "mae double, r2 double")).collect()
    assert [r.passed for r in g] == [True, False]
    p = spark.createDataFrame([(100.0, 105.0)], "prod double, shadow double")
    assert ml.shadow(p).first().agreed


def test_reconcile_and_quality(spark):
    day = lambda n: spark.range(n).select(F.lit("2026-01-01").cast("date").alias("date"))
    r = monitor.reconcile(day(1000), day(850), "t", "2026-01-01").first()
    assert (r.diff_percentage, r.passed) == (15.0, True) and not monitor.reconcile(day(0), day(1), "t", "2026-01-01").first().passed
    with pytest.raises(monitor.CheckFailed):
        monitor.enforce(day(1), "x")
    assert monitor.enforce(day(1), "x", "warn") == 1 and monitor.contract_errors(day(1), {"date": "string"})


def test_training_guards_and_empty_vector(spark):
    df = spark.createDataFrame([(1.0, "text")], "y double, f string")
    with pytest.raises(ml.BadTrainingData):
        ml.prepare(df, "nope")
    with pytest.raises(ml.BadTrainingData):
        ml.prepare(df, "y", ("nope",))
    with pytest.raises(Exception, match="CAST"):
        ml.prepare(df, "y", ("f",))[0].collect()
    v = features.vector(spark.createDataFrame([("v",)], "vehicle_id string")).first()
    assert len(v) == 14 and (v.current_delay, v.historical_avg_delay, v.feature_age_ms) == (0, 0.0, -1)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "supplier", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(q.ORACLES[name])
    columns = [c[0] for c in result.description]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(text, r)) for r in result.fetchall())
    df = q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(text, r)) for r in df.select(*columns).collect()) == want
