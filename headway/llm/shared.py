"""Spark helpers of this folder: shared scratch space, sizes and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY_BITS = 25  # of the bitmap of keys: 2 ** 19 rows of 64


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lost executors cost no recomputation."""
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def among(spark: SparkSession, rows: DataFrame, key: Column, keys: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` can be an ``of`` of ``keys``, rows for which it surely is none): none is lost, none is in both.

    Long rows so need no exchange to meet keys that few of them have.  A bitmap of ``2 ** KEY_BITS`` hashes is broadcast; it
    doesn't grow, but lets more rows pass, one in eight at 4 million keys.  A null key is a key.
    """

    def place(c: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit("among"), c), 64 - KEY_BITS)

    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = stored(spark, keys.select(place(of).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")).coalesce(8))
    asked = rows.withColumn("_place", place(key)).join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "left")
    hit = F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(bit) != 0
    return asked.where(hit).select(*[F.col(f"`{c}`") for c in rows.columns]), asked.where(~hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, under fixed names, whatever else the input holds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def let(state: Column, *steps) -> Column:
    """Adds fields to a struct step by step; each is computed once, whatever uses it."""

    def applied(step):
        def add(s: Column) -> Column:
            for name, value in step(s).items():
                s = s.withField(name, value)
            return s

        return add

    one = F.array(state)
    for step in steps:
        one = F.transform(one, applied(step))
    return F.element_at(one, 1)


def sums_before(lengths: Column, bits: int = 6) -> Column:
    """The sum of all elements before each, from sums of blocks of 2 ** bits elements: near-linear in an array's length."""
    block, zero = 1 << bits, F.lit(0).cast("bigint")

    def total(x: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, first + 1, n), zero, lambda a, v: a + v)

    def blocks(s: Column) -> dict[str, Column]:
        at = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(s["x"]) - 1, F.lit(0)), bits))
        return {"b": F.transform(at, lambda i: total(s["x"], i * block, F.lit(block)))}

    def starts(s: Column) -> dict[str, Column]:
        return {"p": F.transform(s["b"], lambda _, i: total(s["b"], F.lit(0), i))}

    def each(s: Column) -> dict[str, Column]:
        return {"out": F.transform(s["x"], lambda _, i: F.get(s["p"], F.shiftright(i, bits)) + total(s["x"], F.shiftleft(F.shiftright(i, bits), bits), i.bitwiseAND(block - 1)))}

    return let(F.struct(F.transform(lengths, lambda v: v.cast("bigint")).alias("x")), blocks, starts, each)["out"]


def maximal_runs(rows: DataFrame, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """(keys, run, start, end, more) of the unions of (keys, start, end) that overlap or touch; ``more`` aggregates a union's rows."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", F.coalesce((before < F.col("start")).cast("int"), F.lit(1)))
    runs = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more)
