"""Registered queries do the whole job."""

import datetime

from headway.operators import features, ml
from headway.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_every_order_is_a_request(spark):
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    for query in (q.offline_best_match, q.feature_vector):
        rows = query(spark, SF)
        assert rows.count() == rows.select("request_id").distinct().count() == n
    assert q.feature_hit_rates(spark, SF).first().requests == n


def test_stop_hour_and_day_default(spark):
    sunday = datetime.datetime(2026, 1, 4, 9, 30)
    requests = spark.createDataFrame([(1, "v", None, None, None, None, sunday), (2, "v", "B", None, 5, 1, sunday), (3, "w", None, None, None, None, sunday)], "request_id int, vehicle_id string, stop_id string, line_id string, hour_of_day int, day_of_week int, request_time timestamp")
    online = spark.createDataFrame([("v", "l", "A", 60.0, 24.0)], "vehicle_id string, line_id string, next_stop_id string, latitude double, longitude double")
    history = spark.createDataFrame([("A", "l", 9, 0, 10), ("A", "l", 9, 1, 11), ("A", "k", 9, 0, 12), ("B", "l", 7, 1, 13), ("B", "k", 5, 1, 14)], "stop_id string, line_id string, hour_of_day int, day_of_week int, n int")
    out = features.combined(requests, online, history.withColumns({"latitude": features.F.lit(0.0), "longitude": features.F.lit(0.0)})).orderBy("request_id").collect()
    assert [(r.online_available, r.offline_available, r.n) for r in out] == [(True, True, 10), (True, True, 13), (False, False, None)]


def test_delay_model_is_the_whole_model(spark, monkeypatch):
    made, train = [], ml.train
    monkeypatch.setattr(ml, "train", lambda rows, used, *a, **b: made.append((used, train(rows, used, *a, **b))) or made[-1][1])
    q.delay_model(spark, SF)
    (used, model), = made
    gbt = model.stages[-1]
    assert (gbt.getNumTrees, gbt.getMaxDepth(), gbt.getStepSize()) == (100, 6, 0.1)
    assert used == list(ml.FEATURES) and gbt.numFeatures == len(ml.FEATURES)


def test_history_is_the_stop_marts(spark):
    """Hour and day of requests are the mart's; the gold table's (local hour, Sunday 1) would shift both."""
    mart = q._mart(spark, SF)
    rows = {(r.stop_id, r.line_id, r.hour_of_day, r.day_of_week): r for r in features.history(mart).collect()}
    assert len(rows) == mart.select("stop_id", "line_id", "hour_of_day", "day_of_week").distinct().count() and {k[3] for k in rows} <= set(range(7))
    last = {}
    for r in mart.collect():
        k = (r.stop_id, r.line_id, r.hour_of_day, r.day_of_week)
        last[k] = max(last.get(k, ()), (r.event_date, r.kafka_partition, r.kafka_offset, r.historical_arrival_count))
    assert all(rows[k].historical_arrival_count == v[3] for k, v in last.items())
    found = q.offline_best_match(spark, SF)
    exact = found.where("h_hour is not null").join(q._requests(spark, SF), "request_id").where("stop_id is not null and line_id is not null and hour_of_day is not null and day_of_week is not null").collect()
    assert all((r.h_hour, r.h_dow) == (r.hour_of_day, r.day_of_week) for r in exact if (r.stop_id, r.line_id, r.hour_of_day, r.day_of_week) in rows)
    vectors = q.feature_vector(spark, "/root/testdata/sf0.01")  # at the smallest size no request meets a stop with several events
    assert vectors.where("historical_stddev_delay > 0").count() > 0.5 * vectors.count()


def test_messages_are_spread_over_the_cores(spark):
    """A table of one row group would else be classified by one task, whatever its size."""
    from headway.sources import adapters

    parts = [n for n in adapters.raw_messages(spark, "/root/testdata/sf0.01").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(parts) == 2 * spark.sparkContext.defaultParallelism and max(parts) < 1.2 * min(parts)
