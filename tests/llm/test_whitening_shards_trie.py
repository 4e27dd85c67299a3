"""Whitening, the hash tree and the prefix trie against plain versions."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from headway.llm import entry_queries, prefix_trie, sharding, spread, whitening

SF = "/root/testdata/sf0.001"


# ---- whitening ----


def vectors(spark, rows, ids=None):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, "x") for i, v in zip(ids or range(len(rows)), rows)], "vec_id long, embedding array<double>, ids string")


def check_whitening(df, data, ids, k=32):
    x = np.floor(64 * np.asarray(data, np.float64)).astype(np.int64) + 1_000_000
    n, d = x.shape
    sums = [sum(map(int, x[:, j])) for j in range(d)]
    centred = np.array([[(n * int(x[i, j]) - sums[j]) / n for j in range(d)] for i in range(n)])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    many = min(k, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.vec_id].append(r)
    assert collections.Counter(r.vec_id for v in out.values() for r in v) == {i: c * many for i, c in collections.Counter(ids).items()}
    white = np.zeros((n, many))
    place = {i: p for p, i in enumerate(ids)}
    for i, own in out.items():
        dev = sum((n * int(a) - s) ** 2 for a, s in zip(x[place[i]], sums))
        for r in own:
            assert r.n == n and r.deviation == (dev if dev < 1 << 63 else None) and r.identity_error <= 1e-8
            assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained + 1e-15
            white[place[i], r.component - 1] = r.whitened
    for i, at in enumerate(ids):
        white[i] = white[place[at]]
    assert np.abs(white.T @ white / n - np.eye(many)).max() < 1e-8
    back = np.linalg.lstsq(centred, white * np.sqrt(values[:many]), rcond=None)[0]
    for j in range(many):  # equal values may share their plane in any way
        near = np.abs(values - values[j]) <= 1e-9 * values[0]
        assert abs(np.linalg.norm(basis[:, near].T @ back[:, j]) - 1) < 1e-6
        if near.sum() == 1:
            assert np.abs(np.abs(centred @ basis[:, j] / math.sqrt(values[j])) - np.abs(white[:, j])).max() < 1e-6


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitening(entry_queries.op11_whitening(spark, SF), [r.embedding for r in rows], [r.vec_id for r in rows])


@pytest.mark.parametrize("kind", ["equal values", "rank 3", "steep", "two rows", "few dimensions", "repeated"])
def test_whitening_of_hard_spectra(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "equal values":
        data = np.vstack([s * np.eye(12) for s in (2, -2)])
    elif kind == "rank 3":
        data = np.round(rng.normal(size=(60, 3)) * 8) @ np.round(rng.normal(size=(3, 40)) * 4)
    elif kind == "steep":
        data = rng.normal(size=(300, 14)) * 2.0 ** np.arange(14)
    elif kind == "two rows":
        data = np.array([[1.0, 2, 3], [2, 0, 3]])
    elif kind == "few dimensions":
        data = rng.normal(size=(50, 2))
    else:
        data = np.repeat(rng.normal(size=(5, 9)), 30, axis=0)
    check_whitening(whitening.whiten(spark, vectors(spark, data.tolist()).repartition(5), 32, 64, 1_000_000), data, list(range(len(data))))


def test_whitening_in_several_runs(spark, monkeypatch):
    """Beyond STEPS dimensions a run stops early; later runs find the copies that it can't see."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    data = (rng.choice([-1.0, 1.0], size=(400, 40)) * np.r_[[900.0] * 3, 500, 300, [1.0] * 35]) @ q
    monkeypatch.setattr(whitening, "STEPS", 8)
    blocks, dims = whitening.packed(spark, vectors(spark, data.tolist()), 64, 0)
    found = whitening.fit(blocks, dims, 4)
    assert found.passes < 80
    check_whitening(whitening.whiten(spark, vectors(spark, data.tolist()), 4, 64, 1_000_000), data, list(range(400)), 4)


def test_whitening_edges(spark):
    good = [[1.0, 2.0], [3.0, 1.0], [0.5, 7.0], [0.5, 7.0]]
    odd = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, -float("inf")], [1.0, 2.0, 3.0], [1e300, 1.0]]
    ids = [5, None, 9, 9, *range(100, 108)]
    out = whitening.whiten(spark, vectors(spark, good + odd, ids), 32, 64, 1_000_000)
    assert collections.Counter(r.vec_id for r in out.collect()) == {5: 2, None: 2, 9: 4} and {r.n for r in out.collect()} == {4}
    for none in ([], odd[:6], [[2.0, 2.0]] * 5):
        empty = whitening.whiten(spark, vectors(spark, none), 32, 64, 1_000_000)
        assert empty.isEmpty() and empty.columns == out.columns
    far = whitening.whiten(spark, vectors(spark, [[1e12, 0.0], [-1e12, 1.0], [0.0, 5.0]]), 2, 64, 0)
    assert all(r.deviation is None for r in far.where("vec_id < 2").collect())  # beyond a long


# ---- hash tree ----


def plain_shard(key, tree):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
    nodes, path = list(tree), ""
    for name in (lambda s: f"{s.generation}/{s.region}", lambda s: f"{s.generation}/{s.region}/{s.rack}", lambda s: f"{s.generation}/{s.region}/{s.rack}/{s.shard}"):
        weights = collections.defaultdict(float)
        for s in nodes:
            weights[name(s)] += s.weight
        draws = []
        for path, w in sorted(weights.items()):
            if w > 0:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
                u = ((xxhash.xxh64_intdigest(path.encode(), seed) >> 11) + 0.5) / 2**53
                draws.append((-math.log(u) / w, path))
        best = min(draws)[1]
        nodes = [s for s in nodes if name(s) == best]
    return nodes[0].shard


def test_sharding_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tree = sharding.regular(2, 2, 4)
    later = sharding.grown(tree, "r0", "r0k0")
    out = entry_queries.op12_sharding(spark, SF).collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(want) and {r.law for r in out} == {"key"}
    for r in out:
        data = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), plain_shard(r.doc_id, tree), plain_shard(r.doc_id, later))
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        own = sorted((r.slot, r.doc_id) for r in out if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)


def shares(spark, tree, n=40_000):
    rows = spark.range(n).select(sharding.shard_of(F.col("id"), tree).alias("s"), "id").collect()
    return {r.id: r.s for r in rows}


def test_tree_moves_only_what_it_has_to(spark):
    tree = [*sharding.regular(2, 2, 3), sharding.Shard(12, "r9", "r9k0", 3.0)]
    before, total = shares(spark, tree), 15.0
    for s in tree:
        assert abs(sum(v == s.shard for v in before.values()) / len(before) - s.weight / total) < 0.01
    grown = tree
    for step in range(3):  # several new shards, one after the other, into racks that exist
        was, grown = shares(spark, grown), sharding.grown(grown, "r0", "r0k0")
        now = shares(spark, grown)
        moved = [k for k in now if now[k] != was[k]]
        assert {now[k] for k in moved} == {13 + step} and abs(len(moved) / len(now) - 1 / (16 + step)) < 0.01
    rack = [sharding.Shard(s.shard, s.region, s.rack, 2.0 if s.shard == 4 else s.weight) for s in tree]
    now = shares(spark, rack)
    moved = {(before[k], now[k]) for k in now if now[k] != before[k]}
    changed = {3, 4, 5}  # the rack of shard 4; its region has 0 to 5
    assert all(b in changed or (b in range(6) and a in range(6, 13)) or (a not in changed and b in range(6)) for a, b in moved)
    assert not [(a, b) for a, b in moved if a not in range(6) and b not in range(6)]  # never between regions that stayed
    assert not [(a, b) for a, b in moved if a in (0, 1, 2) and b in (0, 1, 2)]  # never inside a rack that stayed
    gone = [sharding.Shard(s.shard, s.region, s.rack, 0.0 if s.shard == 12 else 1.0) for s in tree]
    now = shares(spark, gone)
    assert all(now[k] == before[k] for k in now if before[k] != 12) and 12 not in now.values()


def test_sharding_edges(spark):
    rows = [(None, None), (None, "a"), (7, "é"), (7, "é"), (7, ""), (8, "x" * 3_000_000)] + [(9, "same")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(("shard", "slot", "size", "__part", "__salt", "law"))}).repartition(7)
    tree = sharding.regular(2, 2, 4)
    later = sharding.grown(tree, "r0", "r0k0")
    out = sharding.report(spark, docs, tree, later).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r.doc_id, r.shard) for r in out} == {(i, plain_shard(i, tree)) for i in (None, 7, 8, 9)}
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.report(spark, docs.limit(0), tree, later).isEmpty()
    assert sharding.placed(docs, [sharding.Shard(3, "a", "b")], "at").select("at").distinct().collect()[0].at == 3
    assert sharding.placed(docs, tree, "at").columns == [*docs.columns, "at"]
    for wrong in ([], [sharding.Shard(0, "a", "b", 0.0)], [sharding.Shard(0, "a", "b")] * 2, [sharding.Shard(0, "a", "b", -1.0), sharding.Shard(1, "a", "b")]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit(1), wrong)


def test_sharding_is_native(spark):
    plan = entry_queries.op12_sharding(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbering_spreads_one_group(spark):
    rows = spark.range(30_000).select(F.lit("hot").alias("g"), (F.col("id") % 7).alias("o"), "id").unionByName(spark.range(10).select(F.lit(None).cast("string").alias("g"), F.lit(None).cast("long").alias("o"), "id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = spread.numbered(spark, rows.repartition(6), "g", ["o"], "nth")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(p) for p in out.rdd.glom().collect()]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.g].append((r.nth, r.o))
    assert {g: sorted(x[0] for x in v) for g, v in got.items()} == {"hot": list(range(30_000)), None: list(range(10))}
    assert [o for _, o in sorted(got["hot"])] == sorted(o for _, o in got["hot"]) and max(sizes) < 20_000


# ---- prefix trie ----


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    ends = collections.defaultdict(list)
    for c, v in whole.items():
        ends[v].append(c)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items())


def trie_of(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("id", "parent", "nth", "conv", "a", "__salt")})


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(entry_queries.op13_prefix_trie(spark, SF)) == plain_trie(rows)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    says = ["yes", "no", "a b c", "", None, "tab\tand\nline", "Ünï cödé"]
    rows = []
    for c in [*range(-45, 120), 10**12, 10**12 + 1, None]:
        if c is not None and c % 20 == 0 and c % 3:
            continue  # the conversation that others start with is absent
        rows += [(c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None]), rng.choice(says)) for t in range(rng.choice([1, 1, 2, 3, 9]))]
    rows += [(2000 + i, t, "user", "all alike here") for i in range(700) for t in range(3)]  # a large group
    rows += [(4007, 1, "user", "x")] * 40  # repeated rows
    tied = {(c, t) for c, t, _, _ in rows}
    out = trie_of(prefix_trie.report(spark, conversations(spark, rows).repartition(9)))
    # turns of equal number come in the order of their hashes: compare where there are none, and the counts of all
    seen, single = set(), []
    for c, t, r, x in rows:
        if (c, t) not in seen or (c == 4007):
            seen.add((c, t))
            single.append((c, t, r, x))
    assert len(tied) and trie_of(prefix_trie.report(spark, conversations(spark, single))) == plain_trie(single)
    assert out[0][1] == 0 or any(r[1] == 0 and r[3] == len({c for c, *_ in rows if c is not None}) for r in out)
    assert prefix_trie.report(spark, conversations(spark, rows[:0])).isEmpty()
    only = [(7, 0, "user", "gone"), (None, 0, "user", "no id")]  # shorter than its head, nothing to start with: a turnless one
    assert trie_of(prefix_trie.report(spark, conversations(spark, only))) == plain_trie(only)


def test_trie_of_one_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t} of many") for t in range(5000)] + [(21, t, "user", f"turn {t} of many") for t in range(2600)] + [(2, t, "user", "x" * 200_000) for t in range(4)]
    out = trie_of(prefix_trie.report(spark, conversations(spark, rows).repartition(4)))
    assert len(out) > 5000 and sorted(out)[-1][1] <= 5000
    own = {(r[0], r[1]): r for r in out}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (1, 21, 2)}
    longest = max(r[1] for r in out)
    assert longest == 5000 - h[1] and own[(1, longest)][5] == 1  # absent start: the first turns go


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "binary", "forest", "one"])
def test_contraction(spark, shape):
    rng, n = random.Random(5), {"one": 1, "chain": 700}.get(shape, 400)
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"chain": i - 1, "star": 0, "random": rng.randrange(i), "caterpillar": i - 1 if i % 2 else max(i - 2, 0), "binary": (i - 1) // 2, "forest": None if i % 50 == 0 else i - 1 - rng.randrange(min(i % 50, 3))}[shape]
    own = {i: (rng.randrange(9), rng.randrange(1000)) for i in parent}
    want = {i: list(v) for i, v in own.items()}
    for i in range(n - 1, 0, -1):
        if parent[i] is not None:
            for j in (0, 1):
                want[parent[i]][j] += want[i][j]
    tree = spark.createDataFrame([(i, p, *own[i]) for i, p in parent.items()], "id long, parent long, x long, y long")
    got = {r.id: [r.x, r.y] for r in prefix_trie.subtree_totals(spark, tree, ["x", "y"]).collect()}
    assert got == want
