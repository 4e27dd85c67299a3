"""Jobs run twice, streams restarted, and the functions that no registered query shows."""

import datetime
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from headway.functions import columns as fn
from headway.operators import batches, enrich, features, lakehouse, ml, monitor, tables, validate, warehouse
from headway.plans import daily
from headway.session import scratch
from headway.sources import adapters as src
from headway.sources import connectors
from headway.streaming import enrich_stream

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def local(path):
    return pathlib.Path(path.removeprefix("file://"))


def test_daily_run_twice(spark):
    root, date = scratch(spark), "2024-01-03"
    enriched = enrich.enrich(src.telemetry(spark, SF)).withColumn("timestamp", F.lit(None).cast("string"))
    tables.append(enriched, f"{root}/bronze/enriched")
    tables.append(enrich.arrivals(enriched), f"{root}/bronze/stop_events")
    names = ["silver/enriched", "silver/stop_events", "gold/daily_metrics", "gold/hourly_metrics", "gold/stop_performance", "gold/stops", "gold/lines", "marts/daily_performance", "marts/stop_arrivals", "warehouse/enriched", "marts/journeys", "marts/stop_performance"]
    seen = []
    for _ in range(2):
        decision = daily.run(spark, root, date, src.stops(spark, SF), src.lines(spark)).first()
        assert decision.action in ("skip", "log only")
        seen.append({n: rows_of(spark.read.parquet(f"{root}/{n}")) for n in names})
        seen[-1]["stops"] = rows_of(tables.current(spark, f"{root}/snapshots/stops"))
    assert seen[0] == seen[1] and all(seen[0].values())
    assert spark.read.parquet(f"{root}/audit/reconciliation").where(F.col("date") == date).count() == 2
    assert len(list(local(f"{root}/silver/enriched/date={date}").glob("*.parquet"))) == 1  # compacted
    daily_rows = spark.read.parquet(f"{root}/gold/daily_metrics").collect()
    assert all(r.avg_delay_seconds == round(r.avg_delay_seconds, 2) and r.door_open_rate == round(r.door_open_rate, 4) for r in daily_rows)
    report = json.loads(next(local(f"{root}/monitoring/drift/date={date}").glob("*.json")).read_text())
    assert set(report["m"]) <= set(daily.DRIFT)
    found = daily.retrain(spark, root, trees=3)
    assert found is None or (spark.read.json(f"{root}/models/importances").count() == len(ml.FEATURES) and found.count() == 1)
    with pytest.raises(connectors.MissingSource):
        daily.run(spark, root, "2031-01-01", src.stops(spark, SF), src.lines(spark))


def test_key_is_checked_after_the_write(spark):
    twice = spark.createDataFrame([("a",), ("a",)], "feature_id string")
    store = scratch(spark)
    with pytest.raises(monitor.CheckFailed):
        monitor.enforce(monitor.duplicates(twice, ["feature_id"]), "key", store=store)
    assert spark.read.parquet(f"{store}/key").first()["count"] == 2


def test_maintenance_matrix(spark):
    root, days = scratch(spark), ["2026-01-01", "2026-01-20", "2026-01-27"]
    df = spark.createDataFrame([(d, i) for d in days for i in range(4)], "d string, i int").select("i", F.to_date("d").alias("date"))
    for layer in ("bronze", "gold", "warehouse"):
        tables.append(df.repartition(4), f"{root}/{layer}/t")
    layers = {layer: ["t", "none"] for layer in ("bronze", "gold", "warehouse")}
    done = tables.maintain(spark, root, "2026-01-27", layers)
    assert done["bronze/t"] == {"retention": ["2026-01-01"], "compaction": ["2026-01-27"]} and done["gold/t"] == {"retention": [], "compaction": ["2026-01-27"]}
    assert done["warehouse/t"] == {"retention": []} and done["gold/none"] == {"retention": [], "compaction": []}
    assert tables.maintain(spark, root, "2026-01-27", layers, only=("compaction",))["warehouse/t"] == {}
    assert len(list(local(f"{root}/gold/t/date=2026-01-27").glob("*.parquet"))) == 1
    assert tables.maintain(spark, root, "2026-01-27", layers)["gold/t"] == {"retention": [], "compaction": []}  # nothing is left to do
    assert spark.read.parquet(f"{root}/bronze/t").count() == 8


def test_replace_date(spark):
    path, day = scratch(spark), datetime.date(2026, 1, 1)
    rows = spark.createDataFrame([(1, day), (2, day), (3, datetime.date(2026, 1, 2))], "x int, date date")
    tables.append(rows, path)
    assert tables.replace_date(spark, rows.where("x = 2"), path, "2026-01-01")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3]


def raw_file(spark, rows):
    path = scratch(spark)
    spark.createDataFrame(rows, "value string, partition int, offset long, timestamp timestamp").coalesce(1).write.mode("append").parquet(path)
    return path


def test_bronze_stream_restarts(spark):
    at = datetime.datetime(2026, 1, 1, 10)
    message = lambda v, t: json.dumps({"vehicle_id": v, "event_time_ms": t})
    landing = raw_file(spark, [(message("a", 1), 0, 1, at), (message("a", 1), 0, 2, at), ("{broken", 0, 3, at), ("", 0, 4, at)])
    out, checkpoint = scratch(spark), scratch(spark)

    def drain():
        stream = connectors.file_stream(spark, landing, "value string, partition int, offset long, timestamp timestamp")
        decoded = connectors.decode(stream, "vehicle_id string, event_time_ms long")
        assert enrich_stream.bronze_stream(decoded, out, checkpoint, ["vehicle_id", "date", "event_time_ms"]).awaitTermination(120)
        return sorted((r.vehicle_id, r.event_time_ms, r.kafka_offset) for r in tables.read(spark, out).collect())

    assert drain() == [("a", 1, 2)]
    spark.createDataFrame([(message("a", 1), 0, 5, at), (message("b", 1), 0, 6, at)], "value string, partition int, offset long, timestamp timestamp").write.mode("append").parquet(landing)
    assert drain() == [("a", 1, 2), ("b", 1, 6)]  # from the checkpoint: only the new file; a known key is not written again


def stream_rows(spark, path, rows):
    t = datetime.datetime(2026, 1, 1)
    full = [("v", at, 60.0, 24.0, 0.0, 0, d, 0, "l", 1, 1, "S", 0, i, t, t, t.date()) for i, at, d in rows]
    spark.createDataFrame(full, enrich_stream._ROW).coalesce(1).write.mode("append").parquet(path)


def test_state_lives_over_a_restart_and_expires(spark):
    from headway.config import Config

    landing, root, checkpoint = scratch(spark), scratch(spark), scratch(spark)

    def drain(ttl=600_000, now=4000):
        stream = connectors.file_stream(spark, landing, enrich_stream._ROW)
        assert enrich_stream.run(stream, root, checkpoint, c=Config(state_ttl_ms=ttl), clock=lambda: now).awaitTermination(120)
        return {r.kafka_offset: r.delay_trend for r in tables.read(spark, f"{root}/enriched").collect()}

    stream_rows(spark, landing, [(1, 1000, 10)])
    drain()
    stream_rows(spark, landing, [(2, 2000, 30)])
    assert drain(ttl=1)[2] == 20.0  # the state came back from the checkpoint; what it leaves lives for a millisecond
    stream_rows(spark, landing, [(3, 3000, 50)])
    assert drain()[3] == 50.0  # and is gone after its time to live
    assert sorted(tables.folders(spark, f"{root}/online")) == ["batch=0", "batch=1", "batch=2"]
    now = batches.online(spark, f"{root}/online", 4000)
    assert [(r.vehicle_id, r.current_delay, r.feature_age_ms) for r in now.collect()] == [("v", 50, 1000)]
    assert batches.online(spark, f"{root}/online", 4000 + 10**6).isEmpty()
    assert {r.processing_time for r in tables.read(spark, f"{root}/enriched").collect()} == {datetime.datetime(1970, 1, 1, 0, 0, 4)}  # the clock that was given
    stream_rows(spark, landing, [(4, 10**6, 70)])
    drain(now=10**6)
    assert tables.folders(spark, f"{root}/online") == ["batch=3"]  # what has expired has left


def test_topic_rows(spark):
    df = spark.createDataFrame([(1, None)], "vehicle_id int, x string")
    r = enrich_stream.json_sink(df, "vehicle_id").first()
    assert (r.key, json.loads(r.value)) == ("1", {"vehicle_id": 1})


def test_sources(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("stop_id,stop_lat\nA,60.5\nB,\n")
    assert [tuple(r) for r in connectors.csv_seed(spark, str(tmp_path), "stop_id string, stop_lat double").orderBy("stop_id").collect()] == [("A", 60.5), ("B", None)]
    rows = spark.createDataFrame([(datetime.datetime(2026, 1, d), d) for d in range(1, 10)], "ts timestamp, x int")
    assert connectors.sample_between(rows, "ts", "2026-01-02", "2026-01-05").count() == 4
    assert connectors.sample_between(rows, "ts", "2026-01-02", "2026-01-05", 2).count() == 2
    connectors.register({"landing": rows})
    assert spark.table("landing").count() == 9
    assert connectors.kafka_options("s", "t")["startingOffsets"] == "earliest"
    assert connectors.jdbc_options("u", "t", "a", "b")["driver"].startswith("org.")
    with pytest.raises(connectors.MissingSource):
        connectors.table_on(spark, str(tmp_path / "none"))
    with pytest.raises(connectors.MissingSource):
        connectors.not_empty(rows.limit(0), "rows")


def test_materialise(spark):
    df = spark.range(3)
    tables.materialise(df, "a_view", as_view=True)
    assert spark.table("a_view").count() == 3


def test_snapshot_of_nothing(spark):
    none = warehouse.empty_snapshot(spark, "stop_id string, stop_name string, valid_from timestamp, valid_to timestamp")
    source = spark.createDataFrame([("1", "x")], "stop_id string, stop_name string")
    assert warehouse.snapshot(none, source, "stop_id", ["stop_name"], "2026-01-01").count() == 1


def test_booleans(spark):
    df = spark.createDataFrame([("TRUE",), ("true",), ("1",), (None,)], "x string")
    assert [r[0] for r in df.select(fn.parse_bool(F.col("x"))).collect()] == [True, True, False, None]


def test_vector_without_a_position_takes_the_stops(spark):
    rows = spark.createDataFrame([("v", 0.0, 0.0, True, 60.5, 24.5), ("w", 60.0, 24.0, False, 60.5, 24.5)], "vehicle_id string, latitude double, longitude double, is_stopped boolean, stop_latitude double, stop_longitude double")
    got = {r.vehicle_id: (r.latitude, r.longitude, r.is_stopped) for r in features.vector(rows).collect()}
    assert got == {"v": (60.5, 24.5, 1), "w": (60.0, 24.0, 0)}


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = {"a": [*rng.normal(size=501), *[0.25] * 300], "b": [1.0], "c": [-3.0, 0.0, 0.0, 1e9, 5.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "feature string, x double")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.feature: r for r in monitor.quantiles(df, shares).collect()}
    for k, v in data.items():
        assert got[k].q == pytest.approx(list(np.quantile(v, shares)), rel=1e-12, abs=1e-12) and got[k].n == len(v)


def test_model_beats_the_mean(spark):
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("label", F.col("a") * 10 + F.col("b"))
    fit, test = ml.split(rows.withColumn("k", F.monotonically_increasing_id()), "k")
    assert ml.mature(fit) and not ml.mature(fit.limit(49))
    model, mean = ml.train_or_mean(fit, ["a", "b"], trees=10), ml.train_or_mean(fit.limit(10), ["a", "b"])
    assert isinstance(mean, float)
    error = lambda m: ml.metrics(ml.score(m, test, ["a", "b"])).first().mae
    assert error(model) < 0.3 * error(ml.mean_predictor(fit))
    weights = {r.feature: r.importance for r in ml.importances(spark, model, ["a", "b"]).collect()}
    assert weights["a"] > weights["b"]
    missing = ml.score(model, test.drop("b"), ["a", "b"]).first()
    assert missing.prediction == round(missing.prediction, 1)
    cold = ml.score(None, spark.createDataFrame([(12.34,), (None,)], "current_delay double"), ["a"]).collect()
    assert [r.prediction for r in cold] == [12.3, 0.0]


def test_gold_is_rounded_half_up(spark):
    df = spark.createDataFrame([(12.345, 0.00005, 7.5)], "avg_delay_seconds double, door_open_rate double, avg_dwell_time_ms double")
    assert tuple(lakehouse.for_gold(df).first()) == (12.35, 0.0001, 8.0)


def test_schema_conformance(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":"x"}',), ('{"b":"x"}',), ("{",), ('{"a":2,"b":null}',)], "value string")
    got = [(r.valid, r.error_field) for r in validate.conforms(rows, "a int, b string", ("a",)).collect()]
    assert got == [(True, None), (False, "a"), (False, "a"), (False, None), (True, None)]


def test_stream_to_a_topic(spark):
    landing = raw_file(spark, [("x", 0, i, datetime.datetime(2026, 1, 1)) for i in range(5)])
    stream = connectors.file_stream(spark, landing, "value string, partition int, offset long, timestamp timestamp")
    out, checkpoint = scratch(spark), scratch(spark)
    for _ in range(2):  # a restart sends nothing again
        assert enrich_stream.write_topic(stream, "offset", {"path": out}, checkpoint, "json").awaitTermination(120)
        rows = spark.read.json(out).collect()
        assert sorted(r.key for r in rows) == list("01234") and json.loads(rows[0].value)["partition"] == 0


def test_dead_letters_are_written(spark):
    root = scratch(spark)
    good = json.dumps({"VP": {"veh": 1, "tst": "2026-01-22T10:00:00Z", "tsi": 1, "lat": 60.1, "long": 24.9}})
    rows = spark.createDataFrame([(good, "t"), ("{" + "x" * 6000, "t"), ('{"X":1}', "t")], "value string, topic string")
    validate.route(validate.classify(rows), root)
    assert spark.read.parquet(f"{root}/telemetry").count() == 1
    letter = spark.read.parquet(f"{root}/dead_letters").first()
    assert (letter.error_message, len(letter.raw_payload), letter.topic) == ("corrupt_json", 5000, "t") and letter.received_at


def test_overwrite_replaces_the_schema(spark):
    path = scratch(spark)
    tables.overwrite(spark.range(3), path, partitioned=False)
    tables.overwrite(spark.range(2).select(F.col("id").cast("string").alias("other")), path, partitioned=False)
    assert spark.read.parquet(path).columns == ["other"] and spark.read.parquet(path).count() == 2


def test_drift_falls_back_to_a_sample(spark):
    rows = spark.range(1000).select(F.lit("2026-01-01 12:00:00").cast("timestamp").alias("ts"), "id")
    base, current = monitor.drift_windows(rows, "ts", "2026-01-01 23:59:59")
    assert current.count() == 1000 and 400 < base.count() < 600


def test_training_set_needs_rows(spark):
    with pytest.raises(ml.BadTrainingData):
        ml.training_set(spark.createDataFrame([], ", ".join(f"{c} string" for c in ml.TRAINING)))


def bronze(spark, root, rows):
    tables.append(rows.withColumn("timestamp", F.lit(None).cast("string")), f"{root}/bronze/enriched")
    tables.append(enrich.arrivals(rows), f"{root}/bronze/stop_events")


def test_marts_by_day_are_the_full_runs(spark):
    """Three days one by one, the second again: the rows of a full run up to each date, from that date's events alone."""
    root, days = scratch(spark), ["2024-01-02", "2024-01-03", "2024-01-04"]
    rows = enrich.enrich(src.telemetry(spark, SF)).where(F.col("date").isin(days))
    # journeys that start before midnight and go on after it
    rows = rows.withColumns({"ingestion_time": F.when(F.hour("kafka_timestamp").isin(22, 23), F.date_trunc("day", "kafka_timestamp")).when(F.hour("kafka_timestamp") < 2, F.date_trunc("day", F.date_sub(F.to_date("kafka_timestamp"), 1).cast("timestamp"))).otherwise(F.col("ingestion_time")), "vehicle_id": F.concat(F.lit("v"), (F.col("kafka_offset") % 3).cast("string")), "line_id": F.lit("view"), "operator_id": F.lit(1), "latitude": F.lit(60.1), "longitude": F.lit(24.9)})
    bronze(spark, root, rows)
    stops, lines = src.stops(spark, SF), src.lines(spark)
    for date in (*days, days[1]):
        daily.run(spark, root, date, stops, lines)
    stg = spark.read.parquet(f"{root}/staging/enriched")
    at = lambda df, d: df.where(F.col("date") == F.lit(d).cast("date"))
    places = lambda df: rows_of(df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else c for c, t in sorted(df.dtypes)]))
    assert stg.count() > 30
    full = warehouse.journeys(stg)
    assert places(lakehouse.for_gold(warehouse.mart_daily_performance(full))) == places(spark.read.parquet(f"{root}/marts/daily_performance").drop("date"))
    both = full.where(F.to_date("start_time") != F.to_date("end_time")).count()
    assert both > 0 and full.count() == spark.read.parquet(f"{root}/marts/journeys").count()
    for d in days:
        until = stg.where(F.col("date") <= F.lit(d).cast("date"))
        metrics = warehouse.stg_stop_metrics(spark.read.parquet(f"{root}/gold/stop_performance").where(F.col("date") <= F.lit(d).cast("date")))
        want = at(warehouse.stop_performance(until, metrics), d)
        got = at(spark.read.parquet(f"{root}/marts/stop_performance"), d)
        assert places(want.drop("loaded_at")) == places(got) and got.count() > 0
        dims = warehouse.dim_stops(tables.current(spark, f"{root}/snapshots/stops"), until), warehouse.dim_lines(tables.current(spark, f"{root}/snapshots/lines"))
        assert places(warehouse.mart_stop_arrivals(want, *dims)) == places(at(spark.read.parquet(f"{root}/marts/stop_arrivals"), d).drop("date"))


def test_a_days_marts_read_one_date_of_events(spark, monkeypatch):
    root, days = scratch(spark), ["2024-01-02", "2024-01-03"]
    bronze(spark, root, enrich.enrich(src.telemetry(spark, SF)).where(F.col("date").isin(days)))
    scans, overwrite = [], tables.overwrite
    events = ("warehouse/enriched", "staging/enriched", "bronze/enriched", "silver/enriched", "marts/stop_performance")

    def seen(df, path, partitioned=True):
        plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        parts = [p for p in plan.split("\n\n") if "Location:" in p]
        scans.extend((path.removeprefix(root), p) for p in parts if any(f"{root.removeprefix('file:')}/{t}" in p.replace("file:", "") for t in events))
        overwrite(df, path, partitioned)

    monkeypatch.setattr(tables, "overwrite", seen)
    for date in days:
        scans.clear()
        daily.run(spark, root, date, src.stops(spark, SF), src.lines(spark))
    assert {"/marts/stop_performance", "/marts/stop_arrivals", "/marts/journey_states"} <= {p for p, _ in scans}
    assert all(f"= {days[1]})" in next(line for line in scan.split("\n") if line.startswith("PartitionFilters")) for _, scan in scans)


def test_a_crash_leaves_the_snapshot(spark, monkeypatch):
    path, overwrite = scratch(spark), tables.overwrite
    step = lambda names, now: tables.replace(spark, warehouse.snapshot(tables.current(spark, path), spark.createDataFrame(list(names.items()), "id string, name string"), "id", ["name"], now), path)
    step({"a": "x", "b": "y"}, "2026-01-01")
    before = rows_of(tables.current(spark, path))

    def breaks(df, path, partitioned=True):
        overwrite(df.limit(1), path, partitioned)
        tables.drop(spark, f"{path}/_SUCCESS")  # lost in the middle of the write
        raise OSError("lost")

    monkeypatch.setattr(tables, "overwrite", breaks)
    with pytest.raises(OSError, match="lost"):
        step({"a": "z"}, "2026-01-02")
    monkeypatch.setattr(tables, "overwrite", overwrite)
    assert rows_of(tables.current(spark, path)) == before
    step({"a": "z"}, "2026-01-02")
    now = tables.current(spark, path)
    assert now.count() == 3 and now.where("valid_to is null").collect()[0].name == "z" and now.where("id = 'b'").first().valid_to
    for day in range(3, 7):
        step({"a": "z"}, f"2026-01-0{day}")
    assert tables.current(spark, path).count() == 3 and len(tables.folders(spark, path)) == 2
