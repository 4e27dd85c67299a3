"""Whole texts stay where they are read unless they hold what an operator looks for."""

import random

from pyspark.sql import functions as F

from headway.llm import line_runs, repeats
from headway.llm.shared import among


def stages(spark):
    """Bytes written to exchanges by every stage that ran so far, by stage."""
    store, out, k, missed = spark.sparkContext._jsc.sc().statusStore(), {}, 0, 0
    while missed < 1000:
        try:
            out[k], missed = store.lastStageAttempt(k).shuffleWriteBytes(), 0
        except Exception:  # it was skipped, or is forgotten
            missed += 1
        k += 1
    return out


def spread(spark):
    """(rows, bytes of text): 2000 long texts without anything in common, and one passage that two others share."""
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n))
    texts = [line(300) for _ in range(2000)]
    both = line(80)
    texts += [f"{line(20)}\n{both}\n{line(20)}" for _ in range(2)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sum(map(len, texts))


def measured(spark, run):
    """(bytes written to exchanges, rows) of run(), with joins as on tables that are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = stages(spark)
        rows = run().collect()
        return sum(v for k, v in stages(spark).items() if k not in known), rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeats_leaves_other_texts_where_they_are(spark):
    df, size = spread(spark)
    moved, rows = measured(spark, lambda: repeats.report(spark, df))
    assert {r.doc_id for r in rows if r.n_removed} == {2000, 2001} and len(rows) == 2002
    assert moved < size  # anchors of all texts


def test_line_dedup_leaves_other_texts_where_they_are(spark):
    df, size = spread(spark)
    moved, rows = measured(spark, lambda: line_runs.dedup(spark, df))
    assert sorted(r.doc_id for r in rows if "\n" in r.text) == [2000, 2001] and len(rows) == 2002
    assert min(len(r.text) for r in rows) < 400  # the later copy is gone
    assert moved < size / 2


def test_among_loses_no_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("t.t"))
    keys = spark.range(0, 20_000, 7).select(F.when(F.col("id") > 0, F.col("id")).alias("z"))
    some, rest = among(spark, rows, F.col("k"), keys, F.col("z"))
    assert some.columns == rows.columns and some.count() + rest.count() == 20_000
    assert rest.where("k % 7 = 0 or k is null").isEmpty() and some.count() < 3200
    some, rest = among(spark, rows, F.col("k"), keys.where("false"), F.col("z"))
    assert some.isEmpty() and rest.count() == 20_000
