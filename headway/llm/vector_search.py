"""Exact top-k search by a vector-approximation file.

Vectors become integers, floor(scale * x).  A build job cuts each component's range into ``CELLS``
cells (bounds from one pass over all vectors) and writes the file: exact vectors, and one byte a component of
cell numbers in a column of their own, so that a scan of cells reads no exact vector.

1. Cells of ``CHUNK`` vectors are one row, and so are ``BLOCK`` queries; each pair of such rows is one step of
   the search, and no side is broadcast or collected whole.  The middle of a cell gives the score's middle, the
   cell's half width its possible error: from both come a lower and an upper bound of each inner product.
   The first scan finds for each query the k-th highest lower bound over all vectors, and its id.
2. The second scan names the candidates: vectors whose upper bound is over it, or equal with no larger id.
3. The candidates' exact vectors are taken from the file once, and read in the order of their bounds, in rounds: the
   ``AHEAD`` * k of highest bounds, then ``GROWTH`` times as many places each round, of those whose bound still
   reaches the k-th exact score.  When none is left the k-th result is certain.

Equal vectors tie for every query, so of each group of them only the k + 1 smallest ids (a query's own is no candidate
of it) are scanned; the others can't enter any result.  A group is found by a 128-bit hash of the vector.

Ties go to the smaller id.  Scores are exact: 64-bit arithmetic where it can't overflow, else Python integers.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, neither
as queries nor as candidates; vectors of another length than a query's are no candidates of it; rows
with a null id take no part; a vector of the query's own id is never its candidate, repeated ids are
else distinct candidates; a query row that repeats id and vector counts once; an empty table gives an empty result;
other columns are ignored.  Vectors with a component of 2**31 or more after scaling have no cells: they are
scored exactly against every query (or, as queries, against every vector) by Python integers.  A score beyond 64 bits
counts as the nearest 64-bit value.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.llm.shared import drop_stored, stored

CELLS = 64
BLOCK = 2048
CHUNK = 2048
AHEAD = 2
GROWTH = 4
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, d int, v array<int>, wide array<double>) of the vectors that take part; ``wide``: unscaled, where v can't hold them."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda y: y.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0))
    finite = F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    small = F.forall("x", lambda y: F.abs(y) < float((1 << 31) // scale))
    ints = F.when(small, F.transform("x", lambda y: F.floor(y * scale).cast("int")))
    return rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", F.size("x").alias("d"), ints.alias("v"), F.when(~small, F.col("x")).alias("wide"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_length(batch: pa.RecordBatch):
    """(length, rows) of a batch with column d."""
    d = batch.column("d").to_numpy()
    for n in np.unique(d):
        yield int(n), pa.array(np.flatnonzero(d == n))


def _ranges(batches):
    """(d, j, lo, hi) of each component in a partition."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for d, at in _by_length(batch):
            m = _matrix(batch.column("v").take(at), d)
            lo, hi = m.min(axis=0), m.max(axis=0)
            old = seen.get(d)
            seen[d] = (np.minimum(lo, old[0]), np.maximum(hi, old[1])) if old else (lo, hi)
    for d, (lo, hi) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], ["d", "j", "lo", "hi"])


def _encode(bounds):
    """bounds: broadcast of {length: cell bounds, CELLS + 1 by length}."""

    def run(batches):
        for batch in batches:
            cells: list = [None] * batch.num_rows
            same: list = [None] * batch.num_rows
            for d, at in _by_length(batch):
                m, edges = _matrix(batch.column("v").take(at), d), bounds.value[d]
                codes = np.stack([np.clip(np.searchsorted(edges[:, j], m[:, j], side="right") - 1, 0, CELLS - 1) for j in range(d)], axis=1).astype(np.uint8)
                for i, row, vector in zip(at.to_pylist(), codes, m, strict=True):
                    cells[i] = row.tobytes()
                    same[i] = hashlib.blake2b(vector.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "d", "v")), pa.array(cells, pa.binary()), pa.array(same, pa.binary())], ["vec_id", "d", "v", "cells", "same"])

    return run


def build(spark: SparkSession, ints: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The approximation file (vec_id, d, v, cells, same: a hash of v) and its cell bounds by vector length."""
    narrow = ints.where("v is not null").select("vec_id", "d", "v")
    # one row for each length and component
    seen = narrow.mapInArrow(_ranges, "d int, j int, lo long, hi long").groupBy("d", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    bounds: dict[int, np.ndarray] = {}
    for d in {r.d for r in seen}:
        own = sorted((r.j, r.lo, r.hi) for r in seen if r.d == d)
        bounds[d] = np.array([np.floor(np.linspace(lo, hi + 1, CELLS + 1)) for _, lo, hi in own]).T
    coded = narrow.mapInArrow(_encode(spark.sparkContext.broadcast(bounds)), "vec_id long, d int, v array<int>, cells binary, same binary")
    return stored(spark, coded), bounds


def _packed(*columns: str, rows: int):
    """Rows of one length as one row: d, and the bytes of each column (fixed width a value)."""

    def pack(d: int, table: pa.Table) -> pa.RecordBatch:
        parts = []
        for c in columns:
            col = table.column(c).combine_chunks()
            kind = col.type
            if pa.types.is_binary(kind):
                parts.append(b"".join(col.to_pylist()))
            else:
                parts.append((col.flatten() if pa.types.is_list(kind) else col).to_numpy(zero_copy_only=False).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["d", *columns])

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for d, at in _by_length(batch):
                own = held.setdefault(d, [])
                own.append(batch.take(at))
                table = pa.Table.from_batches(own)
                while table.num_rows >= rows:
                    yield pack(d, table.slice(0, rows))
                    table = table.slice(rows)
                held[d] = table.to_batches() if table.num_rows else []
        for d, own in held.items():
            if own:
                yield pack(d, pa.Table.from_batches(own))

    return run


def _bounds_of(row: dict, edges: np.ndarray):
    """Query ids, their keys, vector ids, lower and upper bounds of all scores of a pair of packed rows."""
    d = row["d"]
    qid, qkey, ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("query_id", "query_key", "vec_id"))
    q = np.frombuffer(row["q"], dtype=np.int32).reshape(-1, d).astype(np.float64)
    codes, cols = np.frombuffer(row["cells"], dtype=np.uint8).reshape(-1, d), np.arange(d)
    low, high = edges[codes, cols], edges[codes + 1, cols] - 1
    middle, half = (low + high) / 2, (high - low) / 2
    score, error = q @ middle.T, np.abs(q) @ half.T
    top = max(float(np.abs(q).max()), 1.0) * max(float(np.abs(middle).max()), 1.0) * d
    if 2 * top >= _EXACT:
        error += top * d * 2.0**-51  # rounding
    low, high = score - error, score + error
    if top >= 2.0**63:  # as the scores are cut
        low, high = np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63)
    own = qid[:, None] == ids[None, :]
    return qid, qkey, ids, np.where(own, -np.inf, low), np.where(own, -np.inf, high)


_PAIR = ("d", "query_id", "query_key", "q", "vec_id", "cells")


def _pairs(batches, *more: str):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in (*_PAIR, "of", *more)}
            if row["d"] == row["of"]:
                yield row


def _highest(low: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row of ``low``, ties to the smaller id, with their ids; all, if fewer."""
    if low.shape[1] <= k:
        return low, np.broadcast_to(ids, low.shape)
    order = np.argsort(ids, kind="stable")
    low, ids = low[:, order], ids[order]
    kth = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k]
    over, tie = low > kth, low == kth
    room = k - over.sum(axis=1, keepdims=True)
    r, c = np.nonzero(over | (tie & (np.cumsum(tie, axis=1) <= room)))
    return low[r, c].reshape(-1, k), ids[c].reshape(-1, k)


def _floors(edges, k: int):
    """The k highest lower bounds of each query in a task, with their ids."""

    def run(batches):
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        keys: dict[bytes, tuple] = {}
        for row in _pairs(batches):
            qid, qkey, ids, low, _ = _bounds_of(row, edges.value[row["d"]])
            low, at = _highest(low, ids, k)
            name = row["query_id"] + row["query_key"]
            if name in best:
                low, at = (np.concatenate((old, new), axis=1) for old, new in zip(best[name], (low, at), strict=True))
                order = np.lexsort((at, -low), axis=-1)[:, :k]
                low, at = np.take_along_axis(low, order, axis=1), np.take_along_axis(at, order, axis=1)
            best[name] = low, at
            keys[name] = (qid, qkey)
        for name, (low, at) in best.items():
            r, c = np.nonzero(low > -np.inf)
            qid, qkey = keys[name]
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(qkey[r]), pa.array(low[r, c]), pa.array(at[r, c])], ["query_id", "query_key", "low", "vec_id"])

    return run


def _named(edges):
    """The candidates: upper bound over the query's floor, or at it with no larger id."""

    def run(batches):
        for row in _pairs(batches, "floor", "floor_id"):
            qid, qkey, ids, _, high = _bounds_of(row, edges.value[row["d"]])
            floor, last = (np.frombuffer(row[c], dtype=t)[:, None] for c, t in (("floor", np.float64), ("floor_id", np.int64)))
            r, c = np.nonzero(((high > floor) | ((high == floor) & (ids[None, :] <= last))) & (high > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(qkey[r]), pa.array(ids[c]), pa.array(high[r, c])], ["query_id", "query_key", "vec_id", "upper"])

    return run


def _clip(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def _exact(batches):
    """Scores of pairs (q, v) of equal length."""
    for batch in batches:
        score = np.zeros(batch.num_rows, dtype=np.int64)
        for d, at in _by_length(batch):
            q, v = (_matrix(batch.column(c).take(at), d).astype(np.int64) for c in ("q", "v"))
            if float(np.abs(q).max()) * float(np.abs(v).max()) * d < 2.0**63:
                score[at.to_numpy()] = (q * v).sum(axis=1)
            else:
                score[at.to_numpy()] = [_clip(sum(int(a) * int(b) for a, b in zip(x, y, strict=True))) for x, y in zip(q, v, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "query_key", "vec_id")), pa.array(score)], ["query_id", "query_key", "vec_id", "score"])


def _big(v, wide, scale: int) -> list[int]:
    if v is not None:
        return v
    return [math.floor(x * scale) if abs(x) < _EXACT else int(x) * scale for x in wide]


def _slow(scale: int, k: int):
    """The k best of each query in a task, by Python integers."""

    def run(batches):
        best: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["d"] == r["of"] and r["query_id"] != r["vec_id"]:
                    score = _clip(sum(a * b for a, b in zip(_big(r["q"], r["q_wide"], scale), _big(r["v"], r["wide"], scale), strict=True)))
                    own = best.setdefault((r["query_id"], r["query_key"]), [])
                    own.append((-score, r["vec_id"]))
                    if len(own) > 4 * k:
                        own[:] = sorted(own)[:k]
        rows = [(*key, i, -s) for key, own in best.items() for s, i in sorted(own)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["query_id", "query_key", "vec_id", "score"])

    return run


_OUT = "query_id long, query_key long, vec_id long, score long"


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, *, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(query_id, query_key, rank, vec_id, score) and (query_id, query_key, exact_reads), the exact vectors read for each query."""
    ints = integer_vectors(vectors, scale, id_col, vec_col)
    file, edges = build(spark, ints)
    key = F.xxhash64("v", "wide")
    asked = integer_vectors(queries, scale, id_col, vec_col).select(F.col("vec_id").alias("query_id"), key.alias("query_key"), "d", F.col("v").alias("q"), F.col("wide").alias("q_wide"))
    asked = stored(spark, asked.dropDuplicates(["query_id", "query_key"]))
    narrow = asked.where("q is not null")
    blocks = max(1, math.ceil(narrow.count() / block))
    bounds = spark.sparkContext.broadcast(edges)
    # both limits are applied before the exchange too, so that a hot vector is no task's own
    nth_row, nth_id = F.row_number().over(Window.partitionBy("d", "same", "vec_id").orderBy("vec_id")), F.dense_rank().over(Window.partitionBy("d", "same").orderBy("vec_id"))
    few = file.select("vec_id", "d", "cells", "same").withColumn("nth", nth_row).where(F.col("nth") <= k).withColumn("nth", nth_id).where(F.col("nth") <= k + 1)
    chunks = stored(spark, few.select("vec_id", "d", "cells").mapInArrow(_packed("vec_id", "cells", rows=CHUNK), "d int, vec_id binary, cells binary"))

    def paired(q: DataFrame, *more: str) -> DataFrame:
        """Every chunk of cells with every block of queries."""
        names = ("query_id", "query_key", "q", *more)
        packed = q.repartition(blocks).mapInArrow(_packed(*names, rows=block), "d int, " + ", ".join(f"{c} binary" for c in names))
        return chunks.crossJoin(packed.withColumnRenamed("d", "of"))

    keys = ["query_id", "query_key"]
    lows = paired(narrow).mapInArrow(_floors(bounds, k), "query_id long, query_key long, low double, vec_id long")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("low").desc(), "vec_id"))
    floors = lows.withColumn("nth", nth).where(F.col("nth") == k).select(*keys, F.col("low").alias("floor"), F.col("vec_id").alias("floor_id"))
    floor, last = F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.coalesce("floor_id", F.lit((1 << 63) - 1)).alias("floor_id")
    floored = stored(spark, narrow.join(floors, keys, "left").select(*keys, "d", "q", floor, last))
    named = paired(floored, "floor", "floor_id").mapInArrow(_named(bounds), "query_id long, query_key long, vec_id long, upper double")
    by_bound = Window.partitionBy(*keys).orderBy(F.col("upper").desc(), "vec_id")
    named = named.groupBy(*keys, "vec_id").agg(F.max("upper").alias("upper"))  # rows of one id are read together
    ordered = stored(spark, named.withColumn("place", F.row_number().over(by_bound)))
    wanted = file.select("vec_id", "d", "v", "same").join(ordered.select("vec_id").distinct(), "vec_id", "left_semi")
    wanted = stored(spark, wanted.withColumn("nth", nth_row).where(F.col("nth") <= k).select("vec_id", F.col("d").alias("of"), "v"))

    def read(some: DataFrame) -> DataFrame:
        both = some.select(*keys, "vec_id").join(wanted, "vec_id").join(narrow.select(*keys, "d", "q"), keys).where("d = of")
        return stored(spark, both.select(*keys, "vec_id", "d", "q", "v").mapInArrow(_exact, _OUT))

    by_score = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    done = AHEAD * k
    scored = read(ordered.where(F.col("place") <= done))
    while True:
        reached = scored.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k).select(*keys, F.col("score").alias("reached"), F.col("vec_id").alias("reached_id"))
        before = (F.col("vec_id") < F.col("reached_id")) | (F.abs(F.col("reached").cast("double")) >= _EXACT)  # beyond, equal doubles say nothing
        enters = (F.col("upper") > F.col("reached")) | ((F.col("upper") >= F.col("reached")) & before)
        behind = ordered.where(F.col("place") > done).join(reached, keys, "left").where(F.col("reached").isNull() | enters)
        if behind.isEmpty():
            break
        scored = scored.unionByName(read(behind.where(F.col("place") <= GROWTH * done)))
        done *= GROWTH
    reads = scored.groupBy(*keys).agg(F.count("*").alias("exact_reads"))
    wide = ints.where("wide is not null")
    if not wide.isEmpty():  # a wide row takes part exactly, on either side
        every = ints.withColumnRenamed("d", "of")
        slow = wide.withColumnRenamed("d", "of").crossJoin(asked).unionByName(every.where("wide is null").crossJoin(asked.where("q is null")))
        scored = scored.unionByName(stored(spark, slow.mapInArrow(_slow(scale, k), _OUT)))
    drop_stored(spark, chunks, floored, ordered, wanted)
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(*keys, "rank", "vec_id", "score"), reads


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of every query row."""
    return search(spark, vectors, queries, k, scale, **options)[0].select("query_id", "rank", "vec_id", "score")
