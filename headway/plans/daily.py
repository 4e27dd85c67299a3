"""The daily run: bronze to warehouse copies, silver, reconciliation, gold, marts, maintenance, drift, decision, training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators import lakehouse, ml, monitor, tables, warehouse
from headway.sources.connectors import not_empty, table_on

LAYERS = {"bronze": ["enriched", "stop_events"], "silver": ["enriched", "stop_events"], "gold": ["daily_metrics", "hourly_metrics", "stop_performance"], "warehouse": ["enriched", "stop_events"]}
DRIFT = ["delay_seconds", "speed_ms", "distance_since_last_m"]


def _upto(df: DataFrame, date: str) -> DataFrame:
    return df.where(F.col("date") <= F.lit(date).cast("date"))


def update_journeys(spark: SparkSession, root: str, stg: DataFrame, date: str) -> list[str]:
    """Adds a date's rows to the journeys, and rewrites the days that they touch in journeys and daily mart; returns these days.

    A date's sums are kept; a journey whose rows lie in several dates is the sum of theirs.
    """
    day, path = F.lit(date).cast("date"), f"{root}/marts/journey_states"
    tables.overwrite(warehouse.journey_states(stg).withColumn("date", day), path)
    states = table_on(spark, path)
    own = states.where(F.col("date") == day)
    span = own.agg(F.min("ingestion_time").alias("a"), F.max("ingestion_time").alias("b")).first()
    keys = ["vehicle_id", "ingestion_time", "line_id", "operator_id"]
    near = states.where((F.col("date") != day) & F.col("ingestion_time").between(F.lit(span.a), F.lit(span.b)))
    same = own.select(*keys, F.lit(True).alias("_own"))
    others = near.join(same, [near[k].eqNullSafe(same[k]) for k in keys], "left_semi")
    new = warehouse.journeys_of(warehouse.added_journeys(own.unionByName(others).drop("date"))).withColumn("date", F.col("journey_date"))
    days = sorted(str(r.d) for r in new.select(F.col("date").alias("d")).union(others.select(F.to_date("start_time"))).distinct().collect())  # days of one date's journeys
    old = tables.read(spark, f"{root}/marts/journeys")
    if old is not None:
        kept = old.where(F.col("date").isin(*[F.lit(d).cast("date") for d in days])).join(new.select("journey_id"), "journey_id", "left_anti")
        new = new.unionByName(kept)
    tables.overwrite(new, f"{root}/marts/journeys")
    changed = table_on(spark, f"{root}/marts/journeys").where(F.col("date").isin(*[F.lit(d).cast("date") for d in days]))
    tables.overwrite(lakehouse.for_gold(warehouse.mart_daily_performance(changed)).withColumn("date", F.col("metric_date")), f"{root}/marts/daily_performance")
    return days


def update_stops(spark: SparkSession, root: str, stg: DataFrame, date: str) -> None:
    """A date's stop performance and arrivals, with history up to that date; only the date's events are read.

    History is kept as sums by stop, line, event date and hour, and by stop for the places of stops that nobody has mapped.
    """
    day, stopped = F.lit(date).cast("date"), warehouse.stopped_events(stg)
    tables.overwrite(warehouse.stop_states(stopped).withColumn("date", day), f"{root}/marts/stop_states")
    tables.overwrite(warehouse.place_states(stg).withColumn("date", day), f"{root}/marts/stop_places")
    kept = lambda name: _upto(table_on(spark, f"{root}/{name}"), date)
    perf = warehouse.with_history(stopped, kept("marts/stop_states"), warehouse.stg_stop_metrics(kept("gold/stop_performance")))
    tables.overwrite(perf.withColumn("date", day), f"{root}/marts/stop_performance")
    snapshot = lambda name: tables.current(spark, f"{root}/snapshots/{name}")
    dims = warehouse.dim_stops(snapshot("stops"), kept("marts/stop_places")), warehouse.dim_lines(snapshot("lines"))
    mart = warehouse.mart_stop_arrivals(table_on(spark, f"{root}/marts/stop_performance", date), *dims)
    tables.overwrite(mart.withColumn("date", day), f"{root}/marts/stop_arrivals")


def _marts(spark: SparkSession, root: str, date: str, stops: DataFrame, lines: DataFrame) -> None:
    """Snapshots of the dimensions, and both marts' partitions of a date; the stop mart's key has to be unique."""
    for name, rows, key, checked in (("stops", stops, "stop_id", ["stop_name", "stop_lat", "stop_lon", "zone_id", "stop_code"]), ("lines", lines, "line_id", ["line_name", "line_type", "operator_name"])):
        path = f"{root}/snapshots/{name}"
        tables.replace(spark, warehouse.snapshot(tables.current(spark, path), rows, key, checked, date), path)
    tables.overwrite(warehouse.stg_enriched(table_on(spark, f"{root}/warehouse/enriched", date)), f"{root}/staging/enriched")
    stg = table_on(spark, f"{root}/staging/enriched", date)
    update_journeys(spark, root, stg, date)
    update_stops(spark, root, stg, date)
    monitor.enforce(monitor.duplicates(table_on(spark, f"{root}/marts/stop_arrivals", date), ["feature_id"]), "stop_arrivals_key", store=f"{root}/checks")


def run(spark: SparkSession, root: str, date: str, stops: DataFrame, lines: DataFrame, trees: int = 100, dry_run: bool = True) -> DataFrame:
    """Runs a date over ``root``/bronze and returns the retraining decision; every step can run again.

    Unless ``dry_run``, a decision to retrain trains the delay model on the stop mart, if there are arrivals enough.
    """
    enriched = not_empty(table_on(spark, f"{root}/bronze/enriched", date), "bronze enriched")
    events = table_on(spark, f"{root}/bronze/stop_events", date)
    for name, df in (("enriched", enriched), ("stop_events", events)):
        tables.replace_date(spark, df, f"{root}/warehouse/{name}", date)
    tables.overwrite(lakehouse.silver_enriched(enriched), f"{root}/silver/enriched")
    tables.overwrite(lakehouse.silver_stop_events(events), f"{root}/silver/stop_events")
    silver, arrivals = table_on(spark, f"{root}/silver/enriched", date), table_on(spark, f"{root}/silver/stop_events", date)
    monitor.audit(monitor.reconcile(enriched, silver, "enriched", date), f"{root}/audit/reconciliation")
    tables.overwrite(lakehouse.stop_metadata(stops), f"{root}/gold/stops", partitioned=False)
    tables.overwrite(lakehouse.line_metadata(lines), f"{root}/gold/lines", partitioned=False)
    tables.upsert_merge(spark, lakehouse.for_gold(lakehouse.daily_metrics(silver)), f"{root}/gold/daily_metrics", ["line_id", "date"])
    tables.overwrite(lakehouse.for_gold(lakehouse.hourly_metrics(silver)), f"{root}/gold/hourly_metrics")
    performance = lakehouse.stop_performance(arrivals, stops).withColumn("date", F.lit(date).cast("date"))
    tables.overwrite(lakehouse.for_gold(performance), f"{root}/gold/stop_performance")
    _marts(spark, root, date, stops, lines)
    tables.maintain(spark, root, date, LAYERS)
    base, current = monitor.drift_windows(table_on(spark, f"{root}/warehouse/enriched"), "kafka_timestamp", f"{date} 23:59:59")
    drift = monitor.psi(monitor.long_form(base, DRIFT), monitor.long_form(current, DRIFT))
    report = f"{root}/monitoring/drift/date={date}"
    drift.agg(F.map_from_entries(F.collect_list(F.struct("feature", "psi"))).alias("m")).select("m").write.mode("overwrite").json(report)  # one entry a feature
    decision = monitor.retrain_decision(drift, dry_run)
    if not dry_run and decision.first().retrain:
        retrain(spark, root, trees)
    return decision


def retrain(spark: SparkSession, root: str, trees: int = 100) -> DataFrame | None:
    """Trains on four fifths of the stop mart's events and keeps the model if it passes the gate; None with too few arrivals.

    The model that is in use scores the same held-out rows in the same pass; both stand beside the training rows' mean.
    """
    rows, used = ml.prepare(spark.read.parquet(f"{root}/marts/stop_performance").withColumn("target", F.col("delay_seconds")), "target")
    if not ml.mature(rows):
        return None
    fit, test = ml.split(rows)
    model = ml.train(fit, used, trees)
    ml.save(model, f"{root}/models/candidate")
    ml.importances(spark, model, used).write.mode("overwrite").json(f"{root}/models/importances")
    scored = ml.score_two(test, ml.load(spark, f"{root}/models/delay"), ml.load(spark, f"{root}/models/candidate"))
    found = ml.compared(scored, {"production": F.col("prod"), "candidate": F.col("shadow"), "mean": F.lit(ml.mean_predictor(fit))})
    found.write.mode("overwrite").json(f"{root}/models/metrics")
    if found.where("model = 'candidate' and passed").count():
        ml.save(model, f"{root}/models/delay")
    return found
