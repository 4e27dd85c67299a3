"""What is broadcast or collected stays bounded: windows of many items, many languages, equal vectors."""

import collections

import numpy as np
from pyspark.sql import functions as F

from headway.llm import decontaminate, language_id, vector_search


def test_a_window_of_many_items_is_broadcast_once(spark):
    one, other = (" ".join(f"{x}{i}" for i in range(10)) for x in "ab")
    bench = spark.createDataFrame([(i, one) for i in range(5000)] + [(9000 + i, f"{other} c{i}") for i in range(40)] + [(None, other)], "item_id long, text string")
    _, windows, blocks = decontaminate._blocks(spark, bench, 10, 20)
    assert windows.count() == 82 - 40 and blocks > 1
    assert windows.groupBy("block").count().agg(F.max("count")).first()[0] <= 20
    docs = spark.createDataFrame([(0, f"x {one} y"), (1, f"{one} {other}"), (2, other), (3, "clean"), (4, None), (2, other)], "doc_id long, text string")
    for block in (20, 200_000):
        got = collections.Counter((r.doc_id, r.n_hit, len(r["items"]), r["items"] == sorted(r["items"])) for r in decontaminate.scan(spark, docs, bench, block_windows=block).collect())
        assert got == {(0, 10, 5000, True): 1, (1, 20, 5040, True): 1, (2, 10, 40, True): 2, (3, 0, 0, True): 1, (4, 0, 0, True): 1}


def test_every_language_is_learned(spark):
    """More languages than a few hundred, each of letters of its own."""
    rng, many = np.random.default_rng(5), 400
    rows = []
    for i in range(many):
        letters = [chr(0x4E00 + 8 * i + k) for k in range(8)]
        rows += [(len(rows) + k, " ".join("".join(rng.choice(letters, 4)) for _ in range(12)), f"l{i:03}") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(spark, df)
    assert len(model.langs) == many
    out = language_id.predict(spark, df.where(language_id.held_out(F.col("doc_id"))), model, keep=("doc_id", "lang"))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_every_labelled_document_is_learned_from(spark):
    """Each document is a letter of its own, and its language hangs on nothing else; there are more than one state is trained on."""
    rows = [(i, f"{chr(0x3400 + i)} " * 3, "ab"[i * 7919 % 10007 % 2]) for i in range(26_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labelled = df.where(~language_id.held_out(F.col("doc_id")))
    model = language_id.fit(spark, df)
    assert model.trained + model.calibrated == labelled.count() > 19_000 and 0.15 < model.calibrated / (model.trained + model.calibrated) < 0.25
    right = language_id.predict(spark, labelled, model, keep=("doc_id", "lang")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    fewer = language_id.predict(spark, labelled, language_id.fit(spark, df, max_train=12_000), keep=("doc_id", "lang")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > fewer + 0.05


def exact_top(ids, ints, queries, k):
    """(vec_id, score) of the k best of each query, scored one by one."""
    out = {}
    for q in queries:
        row = ids.index(q)
        out[q] = [(i, -s) for s, i in sorted((-int(s), i) for i, s in zip(ids, ints @ ints[row], strict=True) if i != q)[:k]]
    return out


def searched(spark, ids, v, k=10):
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    ranked, reads = vector_search.search(spark, df, df.where("vec_id % 100 = 0"), k)
    got = collections.defaultdict(list)
    for r in ranked.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got), reads.agg(F.max("exact_reads")).first()[0]


def test_equal_vectors_cost_no_more_reads_than_others(spark):
    ids, v = list(range(4000)), np.tile(np.random.default_rng(1).normal(size=8), (4000, 1))
    got, reads = searched(spark, ids, v)
    assert got == exact_top(ids, np.floor(v * 1024).astype(np.int64), range(0, 4000, 100), 10)
    assert reads <= 11


def test_ties_of_different_vectors(spark):
    """Queries that are zero tie with everything; others tie with whole planes of vectors."""
    rng = np.random.default_rng(2)
    v = np.zeros((3000, 6))
    v[:, 1:] = rng.integers(-2, 3, (3000, 5)) / 4
    v[::100] = 0.0
    v[500::1000, 0] = 1.0  # orthogonal to all but each other
    ids = [int(i) for i in rng.permutation(3000)]
    at = np.argsort(ids)
    ids, v = [ids[i] for i in rng.permutation(3000)], v[at]
    got, reads = searched(spark, ids, v)
    assert got == exact_top(ids, np.floor(v * 1024).astype(np.int64), range(0, 3000, 100), 10)
    assert reads < 300


def test_reads_go_on_in_rounds(spark):
    """One far component makes all cells of the rest so wide that bounds say little: many rounds, exact results."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 8))
    v[7] = 4000.0
    v[13] = -4000.0
    ids = list(range(2000))
    got, reads = searched(spark, ids, v)
    assert got == exact_top(ids, np.floor(v * 1024).astype(np.int64), range(0, 2000, 100), 10)
    assert reads > 80
