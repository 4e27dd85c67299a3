"""Documents without ids of their own, and the splitting tree over many shards."""

import collections

from pyspark.sql import functions as F

from headway.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)


def taken(spark, df, **options):
    got = mixing.report(mixing.plan(spark, df, **options)).collect()
    targets, words = {}, collections.Counter()
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        targets[r.target] = targets.get(r.target, 0)
        words[r.target, r.source_size] += r.taken
    return got, words


def test_null_and_repeated_ids_meet_the_targets(spark):
    rows = [(None if i % 2 else 7, f"s{i % 4}", " ".join(f"w{i}x{j}" for j in range(20 + i % 60))) for i in range(1000)]
    got, _ = taken(spark, docs(spark, rows))
    by_source = collections.Counter()
    source_of = {}
    for r in mixing.plan(spark, docs(spark, rows), keep=True).collect():
        by_source[r.row.source] += r.size * len(r.draws)
        source_of[r.row.source] = r.target
    assert len(got) == 1000 and all(abs(by_source[s] - t) <= 80 for s, t in source_of.items())  # within one document


def test_shards_are_equal_and_reruns_agree(spark):
    rows = [(i, f"s{i % 3}", " ".join(["word"] * (1 + i % 50))) for i in range(4000)]
    one, two = (sorted((r.doc_id, r.taken, r.shards) for r in mixing.report(mixing.plan(spark, docs(spark, rows), shards=48)).collect()) for _ in range(2))
    assert one == two
    words = collections.Counter()
    for i, n, shards in one:
        for s in filter(None, shards.split(",")):
            words[int(s)] += 1 + i % 50
    draws = [n for _, n in sorted(words.items())]
    assert len(draws) >= 40 and set(words) <= set(range(48)) and max(draws) < 4 * sum(draws) / 48


def test_a_very_long_text(spark):
    rows = [(i, "s", "a b c") for i in range(50)] + [(99, "s", "x " * 400_000)]
    out = {r.doc_id: r for r in mixing.report(mixing.plan(spark, docs(spark, rows))).collect()}
    assert out[99].size == 400_000 and out[99].taken in (400_000 * k for k in range(4)) and F
