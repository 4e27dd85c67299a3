"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word n-grams.

The benchmark side is hashed by Spark into windows of ``n`` words (an item of fewer words is one
window of its own length).  Each distinct window is broadcast once, in blocks of ``BLOCK_WINDOWS`` windows and
``BLOCK_BYTES`` bytes at most (or one window), counted block by block before anything is collected, so that what is broadcast
has a proven bound; a larger benchmark takes more passes.  Each pass scans the documents'
words once, tests window hashes in the set, verifies every hit word by word, and marks the words of
all occurrences.  The items of a window, of which there may be any number, stay a table: it is joined after the scan to the
distinct sets of windows that documents hold.

Nulls and edge cases: null or empty text has no words and no hits; a null item is ignored; an item
without words has no window; a null item_id is reported as ``null``'s absence (it marks words, but is
not listed); equal items are all listed; an empty benchmark leaves every document clean; documents
keep one result row per input row, also when ids repeat; other columns are ignored by the report and
kept by the removal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import maximal_runs, stored, text_rows
from headway.llm.spread import spread_join
from headway.llm.textvec import Sieve, Words, chunks, runs

BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 32_000_000
_WINDOW = "item string, n int, hash long, words binary"
_HITS = "n_words long, n_hit long, windows array<binary>, spans array<struct<start:int,end:int>>"


def _bench_windows(n: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                out = []
                for r, count in enumerate(w.counts()):
                    size = min(n, int(count))
                    for i in range(w.first[r], w.first[r + 1] - size + 1) if size else ():
                        out.append((ids[r], size, w.text(i, size)))
                hashes = {}
                for size in {x[1] for x in out}:
                    at, h = w.windows(size)
                    hashes |= {(size, w.text(int(i), size)): int(v.astype(np.int64)) for i, v in zip(at, h, strict=True)}
                rows = [(i, s, hashes[s, t], t) for i, s, t in out]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["item", "n", "hash", "words"])

    return run


def benchmark_windows(bench: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, hash, words) of every distinct window of every item."""
    rows = text_rows(bench, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInArrow(_bench_windows(n), _WINDOW).distinct()


def _scan(table):
    """table: broadcast of {n: (sorted hashes, words of each, names of each)}."""

    def run(batches):
        sieves = {n: (Sieve(h), words, names) for n, (h, words, names) in table.value.items()}
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"))
                hit, found = np.zeros(len(w.start) + 1, dtype=np.int64), [set() for _ in range(part.num_rows)]
                row = None
                for n, (sieve, words, names) in sieves.items():
                    at, h = w.windows(n)
                    where, which = sieve.find(h)
                    for i, k in zip(at[where], which, strict=True):
                        text = w.text(int(i), n)
                        for known, name in zip(words[k], names[k], strict=True):
                            if known == text:
                                hit[i] += 1
                                hit[i + n] -= 1
                                row = w.row() if row is None else row
                                found[row[i]].add(name)
                mask = np.cumsum(hit[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(mask)))
                spans = [[] for _ in range(part.num_rows)]
                if mask.any():
                    for s, e in zip(*runs(mask, w.first[:-1]), strict=True):
                        r = row[s]
                        spans[r].append({"start": int(s - w.first[r]), "end": int(e - w.first[r])})
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in part.schema.names if c != "text"]
                    + [pa.array(w.counts(), pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.binary())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    [c for c in part.schema.names if c != "text"] + ["n_words", "n_hit", "windows", "spans"],
                )

    return run


def _table(rows) -> dict:
    by: dict = {}
    for r in rows:
        by.setdefault(r.n, {}).setdefault(r.hash & ((1 << 64) - 1), {})[bytes(r.words)] = bytes(r.window)
    out = {}
    for n, known in by.items():
        h = np.array(sorted(known), dtype=np.uint64)
        out[n] = (h, [list(known[int(x)]) for x in h], [list(known[int(x)].values()) for x in h])
    return out


def _blocks(spark: SparkSession, bench: DataFrame, n: int, block_windows: int) -> tuple[DataFrame, DataFrame, int]:
    """(window, item) of all items; (window, n, hash, words, block) of each distinct window; number of blocks.

    A window is named by 128 bits of its words.  Blocks double until the largest is within its bounds.
    """
    name = F.unhex(F.md5(F.concat(F.col("n").cast("string").cast("binary"), F.lit(b" "), "words")))
    held = stored(spark, benchmark_windows(bench, n).withColumn("window", name))
    windows = stored(spark, held.select("window", "n", "hash", "words").distinct())
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("window"), F.lit(blocks))
        size = windows.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.length("words")).alias("bytes"))
        if size.where((F.col("n") > 1) & ((F.col("n") > block_windows) | (F.col("bytes") > BLOCK_BYTES))).isEmpty():
            return held.where("item is not null").select("window", "item"), windows.withColumn("block", block), blocks
        blocks *= 2


def _items(spark: SparkSession, found: DataFrame, held: DataFrame) -> DataFrame:
    """found with the sorted items of its windows instead of them; each distinct set of windows meets the items once."""
    found = stored(spark, found.withColumn("set_key", F.when(F.size("windows") > 0, F.md5(F.array_join(F.transform("windows", F.hex), "")))))
    sets = found.where("set_key is not null").groupBy("set_key").agg(F.first("windows").alias("windows"))
    listed = sets.select("set_key", F.explode("windows").alias("window")).join(held, "window").groupBy("set_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = spread_join(found.where("set_key is not null"), listed, "set_key")
    out = found.where("set_key is null").withColumn("items", F.lit(None).cast("array<string>")).unionByName(hit)
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def scan(spark: SparkSession, docs: DataFrame, bench: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), spans (word positions) of every document."""
    rows = text_rows(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_HITS}"
    held, windows, blocks = _blocks(spark, bench, n, block_windows)
    if blocks == 1:
        return _items(spark, rows.mapInArrow(_scan(spark.sparkContext.broadcast(_table(windows.collect()))), schema), held)  # one block
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = None
    for b in range(blocks):
        part = windows.where(F.col("block") == b).collect()
        one = rows.mapInArrow(_scan(spark.sparkContext.broadcast(_table(part))), schema.replace("n_words", "row_key long, n_words"))
        found = one if found is None else found.unionByName(one)
    copies = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
    found, keys = stored(spark, found), ("doc_id", "row_key")
    sets = found.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("windows"))
    runs_ = maximal_runs(found.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*"), keys)
    cuts = runs_.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))  # a group is one text
    same = F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.row_key") == F.col("t.row_key"))
    merged = sets.alias("s").join(cuts.alias("t"), same, "left").select("s.*", F.coalesce("t.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("t.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    key = F.col("c.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("c.row_key") == F.col("m.row_key"))
    both = copies.alias("c").join(merged.alias("m"), key).select("m.*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return _items(spark, both.select("doc_id", "n_words", "n_hit", "windows", "spans"), held)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _cut(table, column: str):
    find = _scan(table)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column):
                only = pa.RecordBatch.from_arrays([part.column(column)], ["text"])
                spans = next(iter(find([only]))).column("spans").to_pylist()
                w, out = Words(part.column(column)), []
                raw = part.column(column).to_pylist()
                for r, cuts in enumerate(spans):
                    if not cuts:
                        out.append(raw[r])
                        continue
                    data, at, kept = raw[r].encode(), 0, []
                    for c in cuts:
                        s, e = w.start[w.first[r] + c["start"]] - w.offsets[r], w.end[w.first[r] + c["end"] - 1] - w.offsets[r]
                        kept.append(data[at:s])
                        at = e
                    out.append(b"".join([*kept, data[at:]]).decode())
                cols = [pa.array(out, pa.string()) if c == column else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([bool(x) for x in spans])], [*part.schema.names, "_hit"])

    return run


def remove(spark: SparkSession, docs: DataFrame, bench: DataFrame, n: int = 10, *, drop_documents: bool = True, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without contaminated documents, or (``drop_documents=False``) without the hit spans."""
    columns = docs.columns
    docs, text_col = docs.toDF(*[f"c{i}" for i in range(len(columns))]), f"c{columns.index(text_col)}"  # any names will do
    _, windows, blocks = _blocks(spark, bench, n, block_windows)
    out = docs.withColumn("_any", F.lit(False))
    for b in range(blocks):
        part = windows.where(F.col("block") == b).collect()
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", _hit boolean"
        out = out.mapInArrow(_cut(spark.sparkContext.broadcast(_table(part)), text_col), kinds).withColumn("_any", F.col("_any") | F.col("_hit")).drop("_hit")
        if drop_documents:
            out = out.where(~F.col("_any"))
    return out.drop("_any").toDF(*columns)
