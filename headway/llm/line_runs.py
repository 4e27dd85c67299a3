"""Line dedup with DataFrame functions only: a suffix array over line ids by distributed prefix doubling.

A document is the sequence of its non-blank lines, each a 128-bit line id.

1. Lines whose id occurs once are in no repeated run; the others stay if their neighbours that stay give ``min_words``
   words together.
2. The rank of a line is the place of its id in the sorted order of all that are left (a range-partitioned
   sort).  Round r gives the suffix at every line the rank of its first 2 ** (r + 1) lines: the place of the pair
   (rank of its first 2 ** r lines, rank of the next 2 ** r lines) in the sorted order of all pairs.  Suffixes
   whose pair occurs once leave, so that a round costs as much as there is left to tell apart.  Suffixes of one
   rank are next to each other in the suffix array: an interval whose longest common prefix is 2 ** (r + 1) lines
   or more.
3. For every line, the shortest stretches of at least ``min_words`` words that begin and that end there are n
   lines long.  The interval of n lines is named by two ranks of 2 ** r lines that overlap, with 2 ** r <= n.  It
   holds every place of the stretch; a maximal repeated run is the union of its stretches.  As each line has a
   word, n is ``min_words`` at most, so ranks of more lines than that can't change the result and rounds end there.
4. A line is deleted if it lies in a stretch whose interval also holds an earlier place (documents by id, then
   line).

Edge cases: null and empty texts have no lines; blank lines belong to no run and always stay; equal lines
inside one document count as copies too, overlapping ones included; rows with equal id and equal text
count as one document and get the same result; null ids come first; an empty table gives an empty result; a very
long text costs in proportion to its lines; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.llm.shared import among, drop_stored, maximal_runs, stored

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"^[\x20\x09-\x0D]*$"
#: Begins of lines that hold a word; only a line feed ends a line.
_FULL_LINE = r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"
_DOC = ("doc_id", "text_key")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, k (of the non-blank lines), line (of all lines), words, a, b (the line's id)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    known = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("line"), F.regexp_count(t, F.lit(_WORD)).alias("words"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit("second"), t).alias("b")))
    # the outer form: the plain one would have the lines made a second time, to leave out empty arrays
    out = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.filter(known, lambda s: s["words"] > 0)).alias("k", "s"))
    return out.where("s is not null").select(*_DOC, "k", "s.*")


def _ranked(spark: SparkSession, keys: DataFrame, *by: str) -> DataFrame:
    """keys with their place in sorted order: a larger key has a larger rank."""
    return stored(spark, keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("next", F.monotonically_increasing_id()))


def _same_doc(x: str, y: str) -> Column:
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.text_key") == F.col(f"{y}.text_key"))


def repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, k, line, words, upto (words so far), island, rank of all lines that can be in a repeated run."""
    lines = stored(spark, _lines(docs, id_col, text_col))
    names = _ranked(spark, lines.groupBy("a", "b").count().where("count > 1").select("a", "b"), "a", "b")
    often = lines.join(names, ["a", "b"]).select(*_DOC, "k", "line", "words", F.col("next").alias("rank")).distinct()
    in_doc = Window.partitionBy(*_DOC).orderBy("k")
    often = often.withColumns({"island": F.col("k") - F.row_number().over(in_doc), "upto": F.sum("words").over(in_doc)})
    whole = F.sum("words").over(Window.partitionBy(*_DOC, "island"))
    out = stored(spark, often.withColumn("whole", whole).where(F.col("whole") >= min_words).drop("whole"))
    drop_stored(spark, lines, names)
    return out


def suffix_ranks(spark: SparkSession, lines: DataFrame, most: int) -> DataFrame:
    """doc_id, text_key, k, level, rank: by prefix doubling, for stretches of 2 ** level <= ``most`` lines that repeat."""
    level, step = lines.select(*_DOC, "k", "rank"), 1
    out, r = level.withColumn("level", F.lit(0)), 0
    while 2 * step <= most:
        ahead = F.max("rank").over(Window.partitionBy(*_DOC).orderBy("k").rangeBetween(step, step))
        pairs = level.withColumn("ahead", ahead).where("ahead is not null")
        names = _ranked(spark, pairs.groupBy("rank", "ahead").count().where("count > 1").select("rank", "ahead"), "rank", "ahead")
        level = stored(spark, pairs.join(names, ["rank", "ahead"]).select(*_DOC, "k", F.col("next").alias("rank")))
        drop_stored(spark, names)
        step, r = 2 * step, r + 1
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("level", F.lit(r)))
    return out


def find(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, cuts, n_removed) of documents with deleted lines; cuts: maximal runs (start, end) of line numbers.

    Lines are numbered from 0, blank ones included; blank lines inside a run are not deleted.
    """
    lines = repeated_lines(spark, docs, min_words, id_col=id_col, text_col=text_col)
    ranks = suffix_ranks(spark, lines, min_words)
    before = F.col("upto") - F.col("words")
    island = Window.partitionBy(*_DOC, "island")
    # each line has a word, so a frame holds min_words rows at most
    ahead = island.orderBy("before").rangeBetween(0, min_words - 1)
    back = island.orderBy("upto").rangeBetween(1 - min_words, 0)
    both = lines.withColumn("before", before).withColumns({
        "fore": F.struct(F.col("k").alias("k"), F.count("*").over(ahead).cast("int").alias("n"), F.col("line").alias("start"), F.max("line").over(ahead).alias("last"), (F.max("upto").over(ahead) - F.col("before")).alias("held")),
        "hind": F.struct(F.min("k").over(back).alias("k"), F.count("*").over(back).cast("int").alias("n"), F.min("line").over(back).alias("start"), F.col("line").alias("last"), (F.col("upto") - F.min("before").over(back)).alias("held")),
    })
    stretches = both.select(*_DOC, F.explode(F.array_distinct(F.array("fore", "hind"))).alias("s")).select(*_DOC, "s.*").where(F.col("held") >= min_words).drop("held").distinct()
    level = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    stretches = stretches.withColumn("level", level).withColumn("k2", (F.col("k") + F.col("n") - F.pow(F.lit(2), F.col("level"))).cast("int"))

    def rank_at(rows: DataFrame, place: str, name: str) -> DataFrame:
        on = _same_doc("s", "r") & (F.col("s.level") == F.col("r.level")) & (F.col(f"s.{place}") == F.col("r.k"))
        return rows.alias("s").join(ranks.alias("r"), on).select("s.*", F.col("r.rank").alias(name))

    named = stored(spark, rank_at(rank_at(stretches, "k", "x"), "k2", "y"))
    place = F.struct(*_DOC, "k")
    intervals = named.groupBy("n", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    copies = named.join(intervals, ["n", "x", "y"]).where(~place.eqNullSafe(F.col("first"))).select(*_DOC, "k", "n", "start", (F.col("last") + 1).alias("end"))
    merged = maximal_runs(copies, _DOC, (F.max(F.col("k") + F.col("n")) - F.min("k")).alias("gone"))
    return merged.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"), F.sum("gone").cast("long").alias("n_removed"))  # a group is one document's runs


def _attach(spark: SparkSession, docs: DataFrame, min_words: int, id_col: str, text_col: str, columns: list[Column]) -> DataFrame:
    cuts = find(spark, docs, min_words, id_col=id_col, text_col=text_col)
    cuts = stored(spark, cuts.select(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("cuts").alias("_cuts"), F.col("n_removed").alias("_gone")))
    left = docs.select(*columns, F.col(f"`{id_col}`").alias("_own_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_own_key"))
    some, none = among(spark, left, F.struct("_own_id", "_own_key"), cuts, F.struct("_cut_id", "_cut_key"))  # texts without cuts stay where they are
    both = some.join(cuts, F.col("_own_id").eqNullSafe(F.col("_cut_id")) & (F.col("_own_key") == F.col("_cut_key")), "left")
    return both.unionByName(none.withColumns({c: F.lit(None).cast(cuts.schema[c].dataType) for c in cuts.columns}))


def report(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, n_runs, runs (start-end of each, comma-joined)."""
    full = F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(_FULL_LINE)).cast("bigint")
    both = _attach(spark, docs, min_words, id_col, text_col, [F.col(f"`{id_col}`").alias("doc_id"), full.alias("n_lines")])
    cuts = F.coalesce("_cuts", F.array().cast("array<struct<start:int,end:int>>"))
    runs = F.array_join(F.transform(cuts, lambda c: F.concat_ws("-", c["start"].cast("string"), c["end"].cast("string"))), ",")
    return both.select("doc_id", "n_lines", F.coalesce("_gone", F.lit(0).cast("long")).alias("n_removed"), F.size(cuts).cast("bigint").alias("n_runs"), runs.alias("runs"))


def _without(text: Column, cuts: Column) -> Column:
    """The text without its cut lines; blank lines inside a cut stay."""

    def cut(s: Column) -> Column:
        lines, runs = s["lines"], s["cuts"]
        end = lambda i: F.coalesce(F.get(runs, i)["end"], F.lit(0))

        def piece(c: Column, i: Column) -> Column:
            kept = F.slice(lines, end(i - 1) + 1, c["start"] - end(i - 1))
            return F.concat(kept, F.filter(F.slice(lines, c["start"] + 1, c["end"] - c["start"]), lambda t: t.rlike(_BLANK)))

        last = end(F.size(runs) - 1)
        return F.concat(F.flatten(F.transform(runs, piece)), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0))))

    one = F.array(F.struct(F.split(text, "\n").alias("lines"), cuts.alias("cuts")))  # so that a text is split once
    return F.array_join(F.element_at(F.transform(one, cut), 1), "\n")


def dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of repeated runs deleted from the text; documents of which nothing stays go."""
    both = _attach(spark, docs, min_words, id_col, text_col, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    text = F.col("_row").getField(text_col).cast("string")
    new = F.when(F.col("_cuts").isNull(), text).otherwise(_without(text, F.col("_cuts")))
    out = both.select("_row", "_cuts", new.alias("_new")).where(F.col("_cuts").isNull() | F.col("_new").rlike(_WORD))
    return out.select(*[F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
