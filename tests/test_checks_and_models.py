"""Declared checks in one pass, quantiles from bucket states, and scoring with saved models."""

import datetime
import json
import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators import ml, monitor
from headway.plans import daily
from headway.plans import queries as q
from headway.session import scratch
from headway.sources import connectors
from headway.streaming import event_time

SF = "/root/testdata/sf0.001"
CHECKS = [
    monitor.Check("there", "not_null", ("a",)), monitor.Check("kind", "accepted", ("b",), ("x", "y"), "warn"), monitor.Check("range", "between", ("a",), (0, 10)),
    monitor.Check("key", "unique", ("a", "b")), monitor.Check("parent", "related", ("b",), ("kinds", "name"), "warn"),
]


def rows_of(spark):
    return spark.createDataFrame([(1, "x"), (1, "x"), (2, "z"), (None, "y"), (11, None), (None, None), (None, None)], "a int, b string")


def test_checks_count_and_list(spark):
    df, kinds = rows_of(spark), spark.createDataFrame([("x",), ("x",), ("w",)], "name string")
    got = {r.name: (r.level, r.failures) for r in monitor.quality(df, CHECKS, {"kinds": kinds}).collect()}
    assert got == {"there": ("error", 3), "kind": ("warn", 1), "range": ("error", 1), "key": ("error", 1), "parent": ("warn", 2)}
    rows = sorted((r.check, str(r.a), str(r.b)) for r in monitor.failing_rows(df, CHECKS, {"kinds": kinds}).collect())
    assert rows == sorted([("there", "None", "y"), ("there", "None", "None"), ("there", "None", "None"), ("kind", "2", "z"), ("range", "11", "None"), ("key", "1", "x"), ("key", "1", "x"), ("parent", "2", "z"), ("parent", "None", "y")])
    empty = monitor.quality(df.limit(0), CHECKS, {"kinds": kinds}).collect()
    assert len(empty) == 5 and not any(r.failures for r in empty)


def test_checks_of_rows_are_one_scan(spark):
    path = scratch(spark)
    rows_of(spark).write.parquet(path)
    df = spark.read.parquet(path)
    alone = [c for c in CHECKS if c.kind in ("not_null", "accepted", "between")]
    for made in (monitor.quality(df, alone), monitor.failing_rows(df, alone)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
    assert monitor.quality(df, CHECKS, {"kinds": spark.createDataFrame([("x",)], "name string")})._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3


def test_enforced_checks_keep_rows_and_raise(spark):
    df, kinds, store = rows_of(spark), spark.createDataFrame([("x",)], "name string"), scratch(spark)
    warn = [c for c in CHECKS if c.level == "warn"]
    assert monitor.enforce_all(df, warn, store, {"kinds": kinds}).count() == 2
    assert {(r.level, r.check) for r in spark.read.parquet(store).collect()} == {("warn", "kind"), ("warn", "parent")}
    with pytest.raises(monitor.CheckFailed, match="there: 3 rows; range: 1 rows; key: 1 rows"):
        monitor.enforce_all(df, CHECKS, store, {"kinds": kinds})
    kept = spark.read.parquet(store)
    assert kept.where("level = 'error'").count() == 6 and kept.where("check = 'key'").count() == 2
    fine = scratch(spark)
    monitor.enforce_all(df.where("a = 2"), [CHECKS[0]], fine)
    assert not pathlib.Path(fine.removeprefix("file://")).exists()


# ---- drift ----


@pytest.mark.parametrize("kind", ["normal", "few values", "ties", "wide", "small"])
def test_psi_is_numpys(spark, kind):
    rng = np.random.default_rng(6)
    make = {"normal": lambda n, s: rng.normal(s, 3, n), "few values": lambda n, s: rng.integers(0, 4 + s, n), "ties": lambda n, s: np.r_[rng.normal(s, 1, n), [0.5] * (n // 2)], "wide": lambda n, s: np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-9, 9 + s, n), "small": lambda n, s: rng.normal(s, 1, 7)}[kind]
    base, now = make(3000, 0).astype(float), make(2000, 1).astype(float)
    inner = np.quantile(base, [i / 10 for i in range(1, 10)])
    share = lambda v: np.maximum(np.bincount((v[:, None] >= inner[None, :]).sum(1), minlength=10) / len(v), 1e-4)
    e, a = share(base), share(now)
    long = lambda v: spark.createDataFrame([("f", float(x)) for x in v] + [("only", 1.0)] * 3, "feature string, x double")
    got = {r.feature: r.psi for r in monitor.psi(long(base), long(now).where("feature = 'f'")).collect()}
    assert got["f"] == pytest.approx(float(((a - e) * np.log(a / e)).sum()), rel=1e-9) and got["only"] == 0.0


def test_psi_reads_its_samples_twice(spark, monkeypatch):
    paths, scans = [scratch(spark), scratch(spark)], []
    for p, shift in zip(paths, (0, 10)):
        spark.range(500).select(F.lit("f").alias("feature"), (F.col("id") % 50 + shift).cast("double").alias("x")).write.parquet(p)
    kept = monitor._kept
    count = lambda df: sum(df._jdf.queryExecution().executedPlan().toString().count(p.removeprefix("file://")) for p in paths)
    monkeypatch.setattr(monitor, "_kept", lambda df: (scans.append(count(df)), kept(df))[1])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    out = monitor.psi(*[spark.read.parquet(p) for p in paths])
    last = count(out)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert (scans, last) == ([2, 2], 0) and out.first().psi > 0.2


# ---- quantiles from states ----

BOUNDS = [1, 2, 5, 10, 50]


def plain_quantile(values, share):
    """Linear inside the bucket that holds the rank."""
    edges, upto = [0, *BOUNDS], 0
    rank = share * len(values)
    for i in range(len(BOUNDS)):
        low = -math.inf if i == 0 else edges[i]
        n = sum(low < v <= edges[i + 1] for v in values)
        if upto + n >= rank:
            return edges[i] + (edges[i + 1] - edges[i]) * ((rank - upto) / n if n else 0)
        upto += n
    return BOUNDS[-1]


def test_minutes_make_the_hour(spark):
    rng = np.random.default_rng(4)
    values = [*rng.exponential(6, 900).tolist(), *[2.0] * 50, *[500.0] * 5, *[-1.0] * 5]
    t0 = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(t0 + datetime.timedelta(seconds=i * 7 % 7200), float(v)) for i, v in enumerate(values)] + [(t0, None), (t0, float("nan"))], "ts timestamp, x double")
    minutes = monitor.bucket_states(rows, "x", BOUNDS, F.date_trunc("minute", "ts").alias("at"))
    merged = monitor.added_states(minutes.withColumn("at", F.date_trunc("hour", "at")), "at")
    whole = monitor.bucket_states(rows, "x", BOUNDS, F.date_trunc("hour", "ts").alias("at"))
    key = lambda df: {r["at"]: (list(r.counts), r.n) for r in df.collect()}
    assert key(merged) == key(whole) and sum(n for _, n in key(merged).values()) == len(values)
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0, "p0": 0.0}
    for r in monitor.state_quantiles(merged, BOUNDS, shares).collect():
        own = [v for i, v in enumerate(values) if (t0 + datetime.timedelta(seconds=i * 7 % 7200)).replace(minute=0, second=0) == r["at"]]
        for name, share in shares.items():
            assert r[name] == pytest.approx(plain_quantile(own, share)), name
            exact = float(np.quantile(own, share, method="inverted_cdf"))
            if 0 < exact <= BOUNDS[-1]:  # off by the width of its bucket at most
                i = next(i for i, b in enumerate(BOUNDS) if exact <= b)
                assert abs(r[name] - exact) <= BOUNDS[i] - ([0, *BOUNDS][i])
    none = monitor.state_quantiles(monitor.bucket_states(rows.where("x is null"), "x", BOUNDS), BOUNDS, {"p50": 0.5}).first()
    assert none.p50 is None and none.n == 0


def test_states_of_a_stream(spark):
    landing, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    t0 = datetime.datetime(2026, 1, 1)
    for part in ([(t0 + datetime.timedelta(seconds=i), float(i % 12)) for i in range(120)], [(t0 + datetime.timedelta(minutes=9), 1.0)], [(t0 + datetime.timedelta(minutes=10), 1.0)]):
        spark.createDataFrame(part, "ts timestamp, x double").coalesce(1).write.mode("append").parquet(landing)
    stream = connectors.file_stream(spark, landing, "ts timestamp, x double", 1)
    assert event_time.to_table(monitor.quantile_stream(stream, "ts", "x", BOUNDS), out, checkpoint).awaitTermination(120)
    closed = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start, r.n) for r in closed] == [(t0, 60), (t0 + datetime.timedelta(minutes=1), 60)]
    got = monitor.state_quantiles(monitor.added_states(spark.read.parquet(out)), BOUNDS, {"p50": 0.5}).first()
    assert got.n == 120 and got.p50 == pytest.approx(plain_quantile([float(i % 12) for i in range(120)], 0.5))


# ---- saved models ----


def learned(spark):
    rows = spark.range(600).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.col("id").alias("k")).withColumn("label", F.col("a") * 30 + F.col("b"))
    return ml.split(rows, "k")


def test_two_saved_models_score_in_one_pass(spark):
    fit, test = learned(spark)
    root = scratch(spark)
    ml.save(ml.train(fit, ["a", "b"], trees=3, depth=2), f"{root}/one")
    ml.save(ml.train(fit, ["a", "b"], trees=15), f"{root}/two")
    one, two = ml.load(spark, f"{root}/one"), ml.load(spark, f"{root}/two")
    assert ml.load(spark, f"{root}/none") is None
    path = scratch(spark)
    test.write.parquet(path)
    rows = spark.read.parquet(path)
    scored = ml.score_two(rows, one, two)
    assert scored.columns == [*rows.columns, "prod", "shadow", "diff", "agreed", "divergent"]
    assert scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    alone = {r.k: r.prediction for r in ml.score(two, rows, ["a", "b"]).collect()}
    got = scored.collect()
    assert {r.k: r.shadow for r in got} == alone and all(r["diff"] == pytest.approx(abs(r["prod"] - r.shadow)) and r.agreed == (r["diff"] <= 60) for r in got)
    mean = ml.mean_predictor(fit)
    found = {r.model: r for r in ml.compared(scored, {"production": F.col("prod"), "candidate": F.col("shadow"), "mean": F.lit(mean)}).collect()}
    for name, column in (("production", "prod"), ("candidate", "shadow")):
        want = ml.gate(ml.metrics(scored, prediction=column)).first()
        assert tuple(found[name])[1:] == pytest.approx(tuple(want))
    assert found["candidate"].passed and found["candidate"].mae < found["production"].mae < found["mean"].mae and not found["mean"].passed and found["mean"].r2 <= 0.01


def test_a_failed_prediction_is_nought(spark):
    fit, _ = learned(spark)
    model = ml.train(fit, ["a", "b"], trees=3)
    odd = spark.createDataFrame([(1, 5.0, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, None, 1.0), (5, None, None)], "k int, a double, b double").withColumns({"features": F.lit("own"), "prediction": F.lit("own")})
    got = {r.k: r for r in ml.score_two(odd, model, None).collect()}
    assert got[2]["prod"] == got[3]["prod"] == 0.0 and got[1]["prod"] > 0 and {r.shadow for r in got.values()} == {0.0}
    assert got[4]["prod"] == got[4]["prod"] and got[1].features == "own" and got[1].prediction == "own"
    no_b = ml.score_two(odd.drop("b"), model, model).where("k = 1").first()
    assert no_b["prod"] == no_b.shadow


def test_a_candidate_replaces_the_model_only_through_the_gate(spark, monkeypatch):
    root = scratch(spark)
    rows = spark.range(300).select((F.col("id") % 24).cast("int").alias("hour_of_day"), (F.col("id") % 24 * 20).cast("int").alias("delay_seconds"), F.col("id").alias("event_time_ms"))
    rows.write.parquet(f"{root}/marts/stop_performance")
    first = {r.model: r for r in daily.retrain(spark, root, trees=40).collect()}
    assert first["production"].mae > 100 and first["candidate"].passed  # there was no model: 0.0 for every row
    kept = ml.load(spark, f"{root}/models/delay")
    assert kept is not None and {json.loads(line)["model"] for f in pathlib.Path(root.removeprefix("file://"), "models/metrics").glob("*.json") for line in f.read_text().splitlines()} == {"production", "candidate", "mean"}
    monkeypatch.setattr(ml, "gate", lambda found: found.withColumn("passed", F.lit(False)))
    again = {r.model: r for r in daily.retrain(spark, root, trees=1).collect()}
    assert not again["candidate"].passed and again["production"].mae == pytest.approx(first["candidate"].mae)
    assert ml.load(spark, f"{root}/models/delay").uid == kept.uid


def test_two_models_over_the_mart(spark):
    found = {r.model: r for r in q.two_models(spark, SF).collect()}
    assert set(found) == {"production", "candidate", "mean"} and found["candidate"].mae < found["mean"].mae


def test_training_rows_are_spread_over_the_cores(spark, monkeypatch):
    """Some hundred passes over one part of a small file would else leave all other cores idle."""
    seen = []

    def fit(self, rows):
        seen.extend(rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())

    monkeypatch.setattr(ml.Pipeline, "fit", fit)
    ml.train(spark.range(8000).coalesce(1).selectExpr("id * 1.0D as a", "id * 2.0D as label"), ["a"])
    assert len(seen) == spark.sparkContext.defaultParallelism and sum(seen) == 8000 and max(seen) < 1.2 * min(seen)
