"""Reconciliation, drift, service levels, histograms, freshness, data-quality checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.config import DEFAULT, Config
from headway.functions.columns import cumulative_histogram
from headway.session import scratch

#: Name, metric, target, operator.
SLOS = (("inference_latency", "p99_latency_ms", 50.0, "lt"), ("feature_freshness", "feature_age_s", 60.0, "lt"), ("shadow_agreement", "agreement_rate", 0.90, "gt"), ("drift", "max_psi", 0.2, "lt"))


def reconcile(stream: DataFrame, batch: DataFrame, name: str, date: str, c: Config = DEFAULT) -> DataFrame:
    """Row counts of a date in two tables; without source rows the difference is 100 % and fails."""
    n = lambda df, alias: df.where(F.col("date") == F.lit(date).cast("date")).agg(F.count("*").alias(alias))
    diff = F.abs(F.col("stream_count") - F.col("batch_count"))
    pct = F.when(F.col("stream_count") > 0, diff * 100.0 / F.col("stream_count")).otherwise(100.0)
    counts = n(stream, "stream_count").join(n(batch, "batch_count"), F.lit(True))  # one row each
    return counts.select(F.lit(date).cast("date").alias("date"), F.lit(name).alias("table_name"), "stream_count", "batch_count", diff.alias("difference"), pct.alias("diff_percentage"), (pct <= c.reconcile_pct).alias("passed"), F.lit(c.reconcile_pct).alias("threshold_pct"))


def reconcile_hours(stream: DataFrame, batch: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Mean delays of two tables by date, line and UTC hour, their difference in per cent of the stream's, and the verdict.

    ``stream`` has event_time_ms, ``batch`` timestamp; an hour that only one of them has differs by 100 %.
    """
    keys = ["check_date", "line_id", "hour_of_day"]

    def means(df: DataFrame, ts: Column, name: str) -> DataFrame:
        return df.groupBy(F.to_date(ts).alias("check_date"), "line_id", F.hour(ts).alias("hour_of_day")).agg(F.avg("delay_seconds").alias(name))

    a, b = means(stream, F.timestamp_millis("event_time_ms"), "stream_avg_delay"), means(batch, F.col("timestamp"), "batch_avg_delay")
    s, t = F.col("stream_avg_delay"), F.col("batch_avg_delay")
    pct = F.when(s == t, 0.0).otherwise(F.coalesce(F.try_divide(F.abs(s - t) * 100.0, F.abs(s)), F.lit(100.0)))
    return a.join(b, keys, "full").withColumn("difference_pct", pct).withColumn("passed", F.round("difference_pct", 9) <= c.reconcile_pct)


def fleet_metrics(rows: DataFrame, ts: str = "kafka_timestamp", width: str = "1 hour", c: Config = DEFAULT) -> DataFrame:
    """Vehicles and delays of each line and window."""
    x = F.col("delay_seconds")
    sums = rows.groupBy(F.window(ts, width).alias("w"), "line_id").agg(F.count_distinct("vehicle_id").alias("active_vehicles"), F.avg(x).alias("avg_delay"), F.max(x).alias("max_delay"), F.count_if(x <= c.on_time_seconds).alias("on_time_count"), F.count_if(x > c.on_time_seconds).alias("delayed_count"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def audit(df: DataFrame, path: str) -> None:
    df.withColumn("checked_at", F.current_timestamp()).write.mode("append").parquet(path)


def long_form(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, x) of numeric columns, null and NaN left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    return df.select(pairs.alias("p")).select("p.feature", "p.x").where("x is not null and not isnan(x)")


def _steps(x: Column) -> Column:
    """A step function that never falls: 32 steps between powers of two."""
    size = F.floor(F.log2(F.abs(x)) * 32) + 40_000
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")


def quantiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """(feature, q: array of exact quantiles, interpolated, n, lo, hi) of long-form rows.

    One pass counts rows by steps of x, a second one the distinct values in the steps that hold a quantile.
    """
    steps = rows.groupBy("feature", _steps(F.col("x")).alias("step")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    order = Window.partitionBy("feature").orderBy("step")  # a feature's steps
    steps = steps.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("feature"))})
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(shares)]))
    place = (F.col("total") - 1) * F.col("s.p")
    asked = steps.select("*", at.alias("s")).select("*", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    held = asked.groupBy("feature", "step").agg(F.collect_set("rank").alias("ranks"), F.first(F.col("upto") - F.col("n")).alias("before"))
    values = rows.withColumn("step", _steps(F.col("x"))).join(held, ["feature", "step"]).groupBy("feature", "step", "x").agg(F.count("*").alias("n"), F.first("ranks").alias("ranks"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("feature", "step").orderBy("x"))  # the distinct values of one step
    found = values.withColumn("upto", upto).select("feature", "x", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    by_rank = found.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))  # two a quantile at most

    def value(p: float) -> Column:
        spot = (F.col("total") - 1) * p
        low, high = F.col("x")[F.floor(spot)], F.col("x")[F.ceil(spot)]
        return low + (high - low) * (spot - F.floor(spot))

    sums = steps.groupBy("feature").agg(F.first("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return sums.join(by_rank, "feature").select("feature", F.array(*[value(p) for p in shares]).alias("q"), F.col("total").alias("n"), "lo", "hi")


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that what it stands on is read once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def psi(baseline: DataFrame, current: DataFrame, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of each feature of two long-form samples; 0 where one is empty.

    The samples are read twice: once for counts by steps of x, once for the distinct values in the steps where an edge of
    a bucket lies.  All other steps lie in one bucket as a whole.
    """
    rows = baseline.withColumn("base", F.lit(1)).unionByName(current.withColumn("base", F.lit(0))).withColumn("step", _steps(F.col("x")))
    of_base = F.when(F.col("base") == 1, F.col("x"))
    of_now = F.when(F.col("base") == 0, F.col("x"))
    steps = _kept(rows.groupBy("feature", "step").agg(F.sum("base").alias("b"), F.sum(1 - F.col("base")).alias("c"), F.min(of_base).alias("b_lo"), F.max(of_base).alias("b_hi"), F.min(of_now).alias("c_lo"), F.max(of_now).alias("c_hi")))
    totals = steps.groupBy("feature").agg(F.sum("b").alias("n_base"), F.sum("c").alias("n_cur"), F.min("b_lo").alias("b_lo"), F.max("b_hi").alias("b_hi"), F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi"))
    upto = F.sum("b").over(Window.partitionBy("feature").orderBy("step"))  # a feature's steps
    counted = steps.select("feature", "step", "b", "c", upto.alias("upto")).join(totals.select("feature", "n_base"), "feature")
    spots = [((F.col("n_base") - 1) * F.lit(i / bins)) for i in range(1, bins)]
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(p).alias("low"), F.ceil(p).alias("high")) for i, p in enumerate(spots)])).alias("r")
    holds = lambda rank: (F.col("b") > 0) & (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("b"))
    spans = counted.select("feature", "step", "b", "upto", ranks).groupBy("feature", "r.i").agg(F.min(F.when(holds(F.col("r.low")), F.col("step"))).alias("from"), F.min(F.when(holds(F.col("r.high")), F.col("step"))).alias("to"))
    spans = spans.groupBy("feature").agg(F.collect_list(F.struct("from", "to")).alias("spans"))  # one a bucket
    near = F.exists("spans", lambda p: F.col("step").between(p["from"], p["to"]))
    marked = counted.join(spans, "feature", "left").withColumn("refined", F.coalesce(near, F.lit(False)))
    refined = marked.where("refined").select("feature", "step", (F.col("upto") - F.col("b")).alias("before"))
    values = _kept(rows.join(refined, ["feature", "step"]).groupBy("feature", "step", "x").agg(F.sum("base").alias("b"), F.sum(1 - F.col("base")).alias("c"), F.first("before").alias("before")))
    ordered = values.withColumn("upto", F.col("before") + F.sum("b").over(Window.partitionBy("feature", "step").orderBy("x")))  # the distinct values of one step
    found = ordered.join(totals.select("feature", "n_base"), "feature").select("feature", "x", "b", "upto", ranks)
    edge = found.groupBy("feature", "r.i").agg(F.min(F.when(holds(F.col("r.low")), F.col("x"))).alias("low"), F.min(F.when(holds(F.col("r.high")), F.col("x"))).alias("high"))
    edge = edge.join(totals.select("feature", "n_base"), "feature").withColumn("spot", (F.col("n_base") - 1) * (F.col("i") + 1) / F.lit(float(bins)))
    edges = edge.groupBy("feature").agg(F.collect_list(F.col("low") + (F.col("high") - F.col("low")) * (F.col("spot") - F.floor("spot"))).alias("inner"))
    fine = values.join(edges, "feature").select("feature", F.size(F.filter("inner", lambda e: e <= F.col("x"))).alias("bucket"), "b", "c")
    coarse = marked.where("not refined").join(edges, "feature").select("feature", F.size(F.filter("inner", lambda e: _steps(e) < F.col("step"))).alias("bucket"), "b", "c")
    cells = fine.unionByName(coarse).groupBy("feature", "bucket").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    grid = totals.where("n_base > 0 and n_cur > 0").select("feature", "n_base", "n_cur", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket"))
    share = lambda n, total: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(total), F.lit(eps))
    e, a = share("b", "n_base"), share("c", "n_cur")
    sums = grid.join(cells, ["feature", "bucket"], "left").groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
    constant = F.col("b_lo") == F.col("b_hi")
    same = (F.col("c_lo") == F.col("c_hi")) & (F.col("b_lo") == F.col("c_lo"))
    value = F.when((F.col("n_base") == 0) | (F.col("n_cur") == 0), 0.0).when(constant, F.when(same, 0.0).otherwise(float("inf"))).otherwise(F.col("psi"))
    return totals.join(sums, "feature", "left").select("feature", value.alias("psi"))


def severity(drift: DataFrame) -> DataFrame:
    return drift.withColumn("severity", F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.2, "moderate").otherwise("high"))


def drift_windows(rows: DataFrame, ts: str, now: str, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(baseline, current): five days that end 30 days back, and the last day.

    With fewer than ``least`` baseline rows half of the current ones, drawn by a seed, stand in.
    """
    end = F.lit(now).cast("timestamp")
    current = rows.where((F.col(ts) > end - F.expr("interval 1 day")) & (F.col(ts) <= end))
    base = rows.where((F.col(ts) > end - F.expr("interval 35 days")) & (F.col(ts) <= end - F.expr("interval 30 days")))
    return (base if base.limit(least).count() >= least else current.sample(0.5, seed=42)), current


def retrain_decision(drift: DataFrame, dry_run: bool = True, c: Config = DEFAULT) -> DataFrame:
    over = F.col("psi") > c.psi_limit
    reasons = F.array_join(F.array_sort(F.collect_list(F.when(over, F.col("feature")))), ", ")
    retrain = F.count_if(over) > 0
    return drift.agg(retrain.alias("retrain"), F.when(retrain, F.concat(F.lit("drift in "), reasons)).otherwise("no drift").alias("reason"), F.when(retrain, F.lit("log only" if dry_run else "trigger")).otherwise("skip").alias("action"))


def slo_check(spark: SparkSession, metrics: DataFrame, slos=SLOS) -> DataFrame:
    """Each known objective: breached, or (upper limits only) above 80 % of it; metrics that are missing are skipped."""
    known = spark.createDataFrame(list(slos), "name string, metric string, target double, op string")
    breached = F.when(F.col("op") == "lt", F.col("value") > F.col("target")).otherwise(F.col("value") < F.col("target"))
    warn = (F.col("op") == "lt") & (F.col("value") > 0.8 * F.col("target")) & ~breached
    return metrics.join(known, "metric").select("name", "metric", "value", "target", F.when(breached, "breached").when(warn, "warning").otherwise("ok").alias("status"))


def latency_histogram(rows: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    hist = rows.agg(cumulative_histogram(F.col(column), bounds).alias("h"), F.sum(column).alias("total"))
    return hist.select(F.explode("h").alias("b"), "total").select(F.col("b.le").cast("string").alias("le"), F.col("b.n").alias("n"), "total")


#: Bounds in seconds of the prediction latency histogram.
PREDICTION_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]


def prediction_histogram(rows: DataFrame, column: str, labels: list[str], bounds=PREDICTION_BUCKETS) -> DataFrame:
    """Cumulative counts by bound, and the count in all, of each combination of labels."""
    hist = rows.groupBy(*labels).agg(cumulative_histogram(F.col(column), bounds).alias("h"), F.count("*").alias("total"))
    return hist.select(*labels, F.explode("h").alias("b"), "total").select(*labels, F.col("b.le").cast("string").alias("le"), F.col("b.n").alias("n"), "total")


def latency_summary(rows: DataFrame, column: str) -> DataFrame:
    q = quantiles(rows.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("x")).where("x is not null"), [0.5, 0.95, 0.99])
    return q.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), F.col("hi").alias("max"))


def latency_windows(rows: DataFrame, ts: str, column: str, width: str = "1 minute") -> DataFrame:
    """Median and 99th percentile of each window, and rows a second."""
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    q = rows.groupBy(F.window(ts, width).alias("w")).agg(F.percentile(column, F.array(F.lit(0.5), F.lit(0.99))).alias("q"), F.count("*").alias("n"))  # a window's distinct values
    return q.select(F.col("w.start").alias("window_start"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"), "n", (F.col("n") * 1e6 / seconds).alias("per_second"))


def bucket_states(rows: DataFrame, column: str, bounds: list[float], *by) -> DataFrame:
    """Counts of a column's values between bounds, and their number, of each group: states of fixed size that can be added up.

    ``by`` are columns or windows; works on streams.  NaN and null aren't counted.
    """
    x = F.col(column).cast("double")
    edges = [float("-inf"), *sorted(float(b) for b in bounds), float("inf")]
    known = x.isNotNull() & ~F.isnan(x)
    counts = [F.count_if(known & (x > lo) & (x <= hi)) if hi < float("inf") else F.count_if(known & (x > lo)) for lo, hi in zip(edges, edges[1:])]
    counts[0] = F.count_if(known & (x <= edges[1]))
    return rows.groupBy(*by).agg(F.array(*counts).alias("counts"), F.count_if(known).alias("n"))


def added_states(states: DataFrame, *by) -> DataFrame:
    """Sums of states, so that minutes make hours."""
    parts = states.select(*by, "n", F.posexplode("counts").alias("i", "c")).groupBy(*by, "i").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("counts"), F.first("n").alias("n"))  # one entry a bucket


def state_quantiles(states: DataFrame, bounds: list[float], shares: dict[str, float]) -> DataFrame:
    """Quantiles of states by linear interpolation inside the bucket that holds the rank share * n.

    The lowest bucket begins at 0 (or, if its bound isn't positive, is taken as its bound); in the highest one the largest bound stands for all.
    Null without values.  The error is at most the width of the bucket.
    """
    edges = sorted(float(b) for b in bounds)
    lows = F.array(*[F.lit(x) for x in (min(0.0, edges[0]), *edges)])
    highs = F.array(*[F.lit(x) for x in (*edges, edges[-1])])
    upto = F.transform(F.col("counts"), lambda _, i: F.aggregate(F.slice(F.col("counts"), 1, i + 1), F.lit(0).cast("long"), lambda a, c: a + c))
    rows = states.withColumn("_upto", upto)

    def value(share: float) -> Column:
        rank = F.col("n") * F.lit(float(share))
        i = F.size(F.filter("_upto", lambda u: u < rank))
        i = F.least(i, F.size("_upto") - 1)
        low, high, count = F.get(lows, i), F.get(highs, i), F.get(F.col("counts"), i)
        inside = F.coalesce(F.try_divide(rank - (F.get(F.col("_upto"), i) - count), count), F.lit(0.0))
        return F.when(F.col("n") > 0, low + (high - low) * inside)

    return rows.withColumns({name: value(s) for name, s in shares.items()}).drop("_upto")


def quantile_stream(rows: DataFrame, ts: str, column: str, bounds: list[float], width: str = "1 minute", delay: str = "10 seconds") -> DataFrame:
    """Bucket states of each window of a stream, out when the watermark has passed it: state is one row of counts a window."""
    states = bucket_states(rows.withWatermark(ts, delay), column, bounds, F.window(ts, width).alias("w"))
    return states.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "counts", "n")


def windowed(rows: DataFrame, ts: str, width: str, *aggs, slide: str | None = None) -> DataFrame:
    """Aggregates by tumbling or sliding window; works on streams too."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w")).agg(*aggs).select(F.col("w.start").alias("window_start"), "*").drop("w")


def freshness(rows: DataFrame, ts: str, now: str, warn_h: float = 12, error_h: float = 24) -> DataFrame:
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(ts))) / 3.6e9
    return rows.agg(age.alias("age_hours")).withColumn("state", F.when(F.col("age_hours") > error_h, "error").when(F.col("age_hours") > warn_h, "warn").otherwise("pass"))


def presence(tables: dict[str, DataFrame], date: str) -> DataFrame:
    """Whether each table has rows of a date; a table is read up to the first one, other partitions not at all."""
    day = lambda df: df.where(F.col("date") == F.lit(date).cast("date")).limit(1)
    parts = [day(df).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), (F.col("n") > 0).alias("present")) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def audited(audits: DataFrame, date: str) -> DataFrame:
    """Number of reconciliation rows of a date, and how many of them failed."""
    return audits.where(F.col("date") == F.lit(date).cast("date")).agg(F.count("*").alias("audits"), F.count_if(~F.col("passed")).alias("failed"))


def samples(df: DataFrame, columns: list[str], order: str, n: int = 3) -> DataFrame:
    """A few rows for an audit, the first by ``order``, without the columns that it doesn't look at."""
    return df.select(*columns).orderBy(order).limit(n)


def topic_volume(rows: DataFrame) -> DataFrame:
    by = rows.groupBy("kafka_partition").agg((F.max("kafka_offset") - F.min("kafka_offset") + 1).alias("n"))
    return by.agg(F.sum("n").alias("messages"))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, failures) of all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("failures")) for c in columns])).alias("r")).select("r.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def not_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def contract_errors(df: DataFrame, contract: dict[str, str]) -> list[str]:
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return sorted(f"{c}: {have.get(c)} is not {t}" for c, t in contract.items() if have.get(c) != t) + sorted(f"{c}: not in the contract" for c in have.keys() - contract.keys())


@dataclass(frozen=True)
class Check:
    """A declared check of a table: ``kind`` with its columns, and whether it only warns.

    Kinds: ``not_null``, ``accepted`` (``values``), ``between`` (``values`` low and high), ``unique`` (one column or several),
    ``related`` (``values``: the name of the other table and its key).  Except for ``not_null`` null passes.
    """

    name: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    level: str = "error"


def _failing(check: Check) -> Column:
    """Whether a row fails a check that looks at the row alone."""
    x = F.col(check.columns[0])
    if check.kind == "not_null":
        return x.isNull()
    inside = x.isin(*check.values) if check.kind == "accepted" else x.between(*check.values)
    return F.coalesce(~inside, F.lit(False))


def quality(df: DataFrame, checks: list[Check], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(name, level, failures) of all checks of a table.

    All checks of rows are one aggregation over one scan; each key that has to be unique and each related table is one
    more, grouped by key first, so that a frequent key doesn't matter.  ``related`` failures are counted in rows of df.
    """
    alone = [c for c in checks if c.kind in ("not_null", "accepted", "between")]
    parts = []
    if alone:
        counts = df.agg(*[F.count_if(_failing(c)).alias(f"c{i}") for i, c in enumerate(alone)])
        parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.level).alias("level"), F.col(f"c{i}").alias("failures")) for i, c in enumerate(alone)])).alias("r")).select("r.*"))
    for c in checks:
        if c.kind == "unique":
            failures = duplicates(df.dropna(subset=list(c.columns)), list(c.columns)).agg(F.count("*").alias("failures"))
        elif c.kind == "related":
            held = parents[c.values[0]].select(F.col(c.values[1]).alias(c.columns[0])).distinct()
            keys = df.where(F.col(c.columns[0]).isNotNull()).groupBy(c.columns[0]).agg(F.count("*").alias("n"))
            failures = keys.join(held, c.columns[0], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))
        else:
            continue
        parts.append(failures.select(F.lit(c.name).alias("name"), F.lit(c.level).alias("level"), "failures"))
    return reduce(DataFrame.unionByName, parts)


def failing_rows(df: DataFrame, checks: list[Check], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows that fail, once for each check that they fail, with its name and level; rows of a repeated key all fail.

    Checks of rows are one scan: a row is listed with all that it fails.
    """
    alone = [c for c in checks if c.kind in ("not_null", "accepted", "between")]
    own = [F.col(c) for c in df.columns]
    parts = []
    if alone:
        failed = F.filter(F.array(*[F.when(_failing(c), F.struct(F.lit(c.name).alias("check"), F.lit(c.level).alias("level"))) for c in alone]), lambda r: r.isNotNull())
        parts.append(df.select(F.explode(failed).alias("_r"), *own).select("_r.check", "_r.level", *own))
    for c in checks:
        if c.kind == "unique":
            rows = df.join(duplicates(df.dropna(subset=list(c.columns)), list(c.columns)).drop("count"), list(c.columns), "left_semi")
        elif c.kind == "related":
            rows = df.where(F.col(c.columns[0]).isNotNull()).join(parents[c.values[0]].select(F.col(c.values[1]).alias(c.columns[0])), c.columns[0], "left_anti")
        else:
            continue
        parts.append(rows.select(F.lit(c.name).alias("check"), F.lit(c.level).alias("level"), *own))
    return reduce(DataFrame.unionByName, parts)


def enforce_all(df: DataFrame, checks: list[Check], store: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Counts all checks, keeps the failing rows of those that failed by check and level at ``store``, and raises if one of them is an error."""
    counts = quality(df, checks, parents)
    found = {r.name: r for r in counts.collect() if r.failures}  # one row a check
    failed = [c for c in checks if c.name in found]
    if failed:
        failing_rows(df, failed, parents).write.mode("overwrite").partitionBy("level", "check").parquet(store)
    errors = [f"{c.name}: {found[c.name].failures} rows" for c in failed if c.level == "error"]
    if errors:
        raise CheckFailed("; ".join(errors))
    return counts


class CheckFailed(Exception):
    """A data-quality check of severity error found rows."""


def enforce(failures: DataFrame, name: str, level: str = "error", store: str | None = None) -> int:
    """Counts a check's failing rows, keeps them at ``store``, and raises unless it only warns."""
    if store:
        failures.write.mode("overwrite").parquet(f"{store}/{name}")
    n = failures.count()
    if n and level == "error":
        raise CheckFailed(f"{name}: {n} rows")
    return n
