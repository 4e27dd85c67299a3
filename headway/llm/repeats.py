"""Removal of long repeated byte strings: column-wise sorting of aligned collections of segments.

Inserting one symbol of every document a round into the transform of the whole corpus needs as many
rounds, each over everything inserted so far, as the longest document has bytes.  Here documents are
first cut to the places where a string of ``length`` bytes can repeat at all, and the column-wise rounds
run over collections of short aligned segments:

1. Anchors.  Each window of ``length`` bytes has the ``GRAM``-byte string of smallest hash in it as its anchor
   (leftmost on ties), so equal windows have equal anchors at equal offsets.  A stretch is the run of windows
   of one anchor; it is known by the hash of the anchor and the hash of all bytes that its windows cover.
2. Anchors of one place only are out.  Equal stretches (map-side counts of their hashes) repeat as a whole,
   however many copies there are.
3. Of the anchors with different stretches, one segment for each different stretch is laid into the
   collection of its anchor, aligned there.  Each round takes the next symbol of every segment, moves the
   segments into the order of the transform's column (stable by symbol) and updates the common prefix
   with the neighbour, here counted back from the column.  A neighbour pair with ``length`` or more common
   bytes marks the window that ends there as repeated.
4. A collection of over ``hot`` segments is split: every window either reaches far left of the anchor or far
   right, so its segments go to collections by the bytes on the left and to others by the bytes on the right,
   again and again, until a collection is small or its segments agree on ``length`` bytes.

A task holds at most ``BATCH`` segments and one collection.  Segments of all collections of a batch are sorted
together.  The columns stay in memory, as a batch is bounded; there are no external files.

Edge cases: null text is empty; texts under ``length`` bytes keep all; strings never cross documents; overlapping
occurrences in one document count; rows with equal id and text are separate documents, all of them repeated;
an empty text's digest is that of no bytes; an empty table gives an empty result; null ids are kept; texts of any
length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import among, drop_stored, maximal_runs, shuffle_width, stored, text_rows
from headway.llm.textvec import chunks, mix64, prefix_sums, runs, span_hash, utf8

LENGTH = 400
SHORTER = 256
GRAM = 64
BATCH = 8192
HOT = 8192


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best() of every n neighbours."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, first window, windows, anchor place, anchor hash, hash of all bytes) of every stretch of a chunk."""
    total = len(data)
    empty = [np.zeros(0, np.int64)] * 6
    if total < length:
        return empty
    sums = prefix_sums(data)
    at = np.arange(total - gram + 1)
    h = span_hash(sums, at, at + gram)
    span = length - gram + 1
    least = _slide(h, span, np.minimum)  # of the window at each place
    valid = np.zeros(len(least), dtype=bool)
    mark = np.zeros(len(least) + 1, dtype=np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(mark, offsets[long], 1)
    np.add.at(mark, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    if not valid.any():
        return empty
    least = np.where(valid, least, np.uint64(0))
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    reach = _slide(padded, span, np.maximum)[: len(h)]  # the largest of the windows that hold each place
    cand = np.flatnonzero((h == reach) & (reach > 0))
    first = valid & np.concatenate(([True], (least[1:] != least[:-1]) | ~valid[:-1]))
    last = valid & np.concatenate(((least[1:] != least[:-1]) | ~valid[1:], [True]))
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    out: list[list[np.ndarray]] = [[], [], []]
    while len(s):
        k = np.searchsorted(cand, s)
        while len(wrong := np.flatnonzero(h[cand[k]] != least[s])):
            k[wrong] += 1
        p = cand[k]
        end = np.minimum(e, p)
        for x, y in zip(out, (s, end, p), strict=True):
            x.append(y)
        more = p < e
        s, e = p[more] + 1, e[more]
    s, e, p = (np.concatenate(x) for x in out)
    row = np.searchsorted(offsets, s, side="right") - 1
    return [row, s - offsets[row], e - s + 1, p - s, h[p], mix64(span_hash(sums, s, e + length) + (p - s).astype(np.uint64))]


_RAW = "row_key struct<a:long,b:long>, start int, windows int, place int, anchor long, whole long"


def _anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=1_000_000):
                data, offsets = utf8(part.column("text"))
                row, start, windows, place, anchor, whole = _stretches(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([part.column("row_key").take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (start, windows, place)), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in (anchor, whole))], ["row_key", "start", "windows", "place", "anchor", "whole"])

    return run


def _cut(batches):
    """The bytes of each asked stretch."""
    for batch in batches:
        for part in chunks(batch, limit=1_000_000):
            cols: list[list] = [[] for _ in range(7)]
            for text, asked in zip(part.column("text").to_pylist(), part.column("asked").to_pylist(), strict=True):
                data = text.encode()
                for a in asked:
                    row = (a["anchor"], a["whole"], a["copies"], a["windows"], a["place"], data[a["start"] : a["start"] + a["bytes"]], a["start"])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor", "whole", "copies", "windows", "place", "bytes", "start"])


def repeated_windows(key: np.ndarray, place: np.ndarray, segments: list[bytes], length: int, gram: int) -> np.ndarray:
    """[segment, offset of the window's start before the anchor] is true where the window also is in another segment of its key.

    Columns run from length - gram before the anchor to length behind its start.
    """
    left, m = length - gram, len(key)
    width = left + length
    table = np.zeros((width, m), dtype=np.uint8)
    begin = left - place.astype(np.int64)
    size = np.array([len(s) for s in segments], dtype=np.int64)
    for i, s in enumerate(segments):
        n = min(len(s), width - int(begin[i]))
        table[begin[i] : begin[i] + n, i] = np.frombuffer(s, np.uint8)[:n]
    stop = np.minimum(begin + size, width)
    _, key = np.unique(key, return_inverse=True)
    order = np.argsort(key, kind="stable")
    back = np.zeros(m, dtype=np.int64)  # column from which a segment agrees with the one before it
    key = key.astype(np.int64)
    out = np.zeros((m, left + 1), dtype=bool)
    for c in range(width):
        k = key[order] * 257 + np.where((begin[order] <= c) & (c < stop[order]), table[c, order].astype(np.int64), 256)
        moved = np.argsort(k, kind="stable")
        same = np.concatenate(([False], (k[moved[1:]] == k[moved[:-1]]) & (k[moved[1:]] % 257 != 256)))
        new = np.full(m, c + 1, dtype=np.int64)
        at = np.flatnonzero(same)
        if len(at):
            near = moved[at] - moved[at - 1] == 1  # neighbours stay neighbours
            new[at[near]] = back[moved[at[near]]]
            far = at[~near]
            if len(far):  # the largest value between them
                lo, hi = moved[far - 1] + 1, moved[far] + 1
                ends = np.stack((lo, hi), axis=1).ravel()
                new[far] = np.maximum.reduceat(np.append(back, 0), ends)[::2]
        order, back = order[moved], new
        start = c + 1 - length
        if 0 <= start <= left:
            hit = np.flatnonzero(back <= start)
            out[order[hit], start] = out[order[hit - 1], start] = True
    return out


def _collections(length: int, gram: int):
    """Spans of the repeated windows of the segments that are alone of their kind."""

    def solve(part: pa.Table):
        key, place = part.column("key").to_numpy(), part.column("place").to_numpy()
        hit = repeated_windows(key, place, part.column("bytes").to_pylist(), length, gram)
        own, windows, start = part.column("whole").to_pylist(), part.column("windows").to_numpy(), part.column("start").to_numpy()
        anchors, copies = part.column("anchor").to_pylist(), part.column("copies").to_numpy()
        rows: list[list] = [[], [], [], []]
        for i in np.flatnonzero(hit.any(axis=1) & (copies == 1)):
            first = length - gram - place[i]
            for s, e in zip(*runs(hit[i, first : first + windows[i]]), strict=True):
                for c, v in zip(rows, (anchors[i], own[i], int(start[i] + s), int(start[i] + e - 1 + length)), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["anchor", "whole", "start", "end"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                keys = batch.column("key").to_numpy()
                end = len(keys)
                if size >= BATCH:  # a new batch begins with a new collection
                    last = held[-1].column("key")[-1].as_py()
                    other = np.flatnonzero(keys != last)
                    end = int(other[0]) if len(other) else len(keys)
                    if len(other):
                        if end:
                            held.append(batch.slice(0, end))
                        yield solve(pa.Table.from_batches(held).combine_chunks())
                        held, size = [], 0
                        batch = batch.slice(end)
                        continue
                take = min(end, BATCH)
                held.append(batch.slice(0, take))
                size += take
                batch = batch.slice(take)
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _text_key(text: str) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


_PARTS = ["anchor", "whole", "copies", "windows", "place", "bytes", "start"]


def _split(spark: SparkSession, segments: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(segments with the key of a small collection, spans that whole collections agree on)."""
    level = segments.withColumns({"key": F.xxhash64("anchor"), "lo": F.col("place"), "hi": F.col("place") + gram})
    small, settled = None, None
    while True:
        sizes = stored(spark, level.groupBy("key").count().where(F.col("count") > hot).withColumnRenamed("count", "size"))
        if sizes.isEmpty():
            part = level.select(*_PARTS, "key")
            return (part if small is None else small.unionByName(part)), settled
        rest = level.join(sizes.select("key"), "key", "left_anti").select(*_PARTS, "key")
        small = rest if small is None else small.unionByName(rest)
        many = level.join(sizes, "key")
        whole = F.col("hi") - F.col("lo") >= length
        done = many.where(whole & (F.col("copies") == 1)).select("anchor", "whole", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("end"))
        settled = done if settled is None else settled.unionByName(done)
        step = F.ceil((length - (F.col("hi") - F.col("lo"))) / 2).cast("int")
        open_ = many.where(~whole).withColumn("step", step)
        sides = open_.withColumn("bounds", F.explode(F.array(F.struct((F.col("lo") - F.col("step")).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + F.col("step")).alias("hi")))))
        sides = sides.where((F.col("bounds.lo") >= 0) & (F.col("bounds.hi") <= F.length("bytes")))
        content: Column = F.substring("bytes", F.col("bounds.lo") + 1, F.col("bounds.hi") - F.col("bounds.lo"))
        level = stored(spark, sides.select(*_PARTS, F.xxhash64("key", content, F.col("bounds.lo") - F.col("lo"), F.col("bounds.hi") - F.col("hi")).alias("key"), F.col("bounds.lo").alias("lo"), F.col("bounds.hi").alias("hi")))


def spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, hot: int = HOT, only: DataFrame | None = None) -> DataFrame:
    """(row_key, cuts) of each distinct text with repeated strings; cuts: maximal (start, end) in bytes, ordered.

    ``row_key`` is a hash of the text, in 128 bits.  ``only``: row keys of the texts that can have any; few others are searched too.
    """
    gram = min(gram, length)
    texts, key = text_rows(docs, id_col, text_col).where("text is not null").select(_text_key("text").alias("row_key"), "text"), F.col("row_key")
    searched = texts if only is None else among(spark, texts, key, only, key)[0]
    raw = stored(spark, searched.mapInArrow(_anchors(length, gram), _RAW))
    shared = stored(spark, raw.groupBy("anchor").agg(F.count("*").alias("places"), (F.min("whole") != F.max("whole")).alias("mixed")).where("places > 1").select("anchor", "mixed"))
    several = stored(spark, raw.join(shared.hint("merge"), "anchor"))
    drop_stored(spark, raw, shared)
    cover = F.col("start") + F.col("windows") - 1 + length
    alike = several.where("not mixed").select("row_key", "start", cover.alias("end"))
    place = F.struct("row_key", "start")
    kinds = several.where("mixed").groupBy("anchor", "whole").agg(F.count("*").alias("copies"), F.min(place).alias("at"), F.min("windows").alias("windows"), F.min("place").alias("place"))
    kinds = stored(spark, kinds.select("anchor", "whole", "copies", "at.row_key", "at.start", "windows", "place"))
    copied = kinds.where("copies > 1").select("anchor", "whole")
    whole = several.where("mixed").join(copied, ["anchor", "whole"], "left_semi").select("row_key", "start", cover.alias("end"))
    asked = kinds.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "whole", "copies", "windows", "place", "start", (F.col("windows") - 1 + length).alias("bytes"))).alias("asked"))  # a text's own stretches
    asked = stored(spark, asked)
    wanted = asked.withColumnRenamed("row_key", "own")
    holders = among(spark, texts, key, asked, key)[0].join(wanted.hint("merge"), F.col("row_key") == F.col("own")).dropDuplicates(["own"])  # one exchange for both
    segments = stored(spark, holders.select("text", "asked").mapInArrow(_cut, "anchor long, whole long, copies long, windows int, place int, bytes binary, start int"))
    keyed, settled = _split(spark, segments, length, gram, hot)
    dealt = keyed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_collections(length, gram), "anchor long, whole long, start int, end int")
    if settled is not None:
        found = found.unionByName(settled)
    single = found.join(kinds.select("anchor", "whole", "row_key"), ["anchor", "whole"]).select("row_key", "start", "end")
    every = alike.unionByName(whole).unionByName(single).distinct()
    cuts = maximal_runs(every, ("row_key",)).groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))  # a group is one text
    cuts = stored(spark, cuts)
    drop_stored(spark, several, kinds, asked, segments)
    return cuts


def _kept(batches):
    for batch in batches:
        for part in chunks(batch):
            n, removed, count, sha = [], [], [], []
            for text, cuts in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist(), strict=True):
                data, at, digest = (text or "").encode(), 0, hashlib.sha256()
                for c in cuts or ():
                    digest.update(data[at : c["start"]])
                    at = c["end"]
                digest.update(data[at:])
                n.append(len(data))
                removed.append(sum(c["end"] - c["start"] for c in cuts or ()))
                count.append(len(cuts or ()))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()), part.column("n_repeated")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])


def report(spark: SparkSession, docs: DataFrame, length: int = LENGTH, shorter: int = SHORTER, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated of every document.

    ``n_repeated``: bytes covered by strings of ``shorter`` bytes that start anywhere else too (about 50 words), which are
    reported, not removed.  A text without any has no repeated string of ``length`` bytes either, so only the others
    are searched for these.
    """
    names, shorter = {"id_col": id_col, "text_col": text_col}, min(shorter, length)
    near = spans(spark, docs, shorter, **names, **options)
    cuts = near if shorter == length else spans(spark, docs, length, **names, **options, only=near.select("row_key"))
    covered = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + (c["end"] - c["start"]))
    known = stored(spark, near.select("row_key", covered.alias("n_repeated")).join(cuts, "row_key", "left"))
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    some, none = among(spark, rows.withColumn("row_key", _text_key("text")), F.col("row_key"), known, F.col("row_key"))
    none = none.withColumns({"cuts": F.lit(None).cast(known.schema["cuts"].dataType), "n_repeated": F.lit(None).cast("long")})
    both = some.join(known.hint("merge"), "row_key", "left").unionByName(none).select("doc_id", "text", "cuts", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"))
    return both.mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")
