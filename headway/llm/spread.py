"""Numbering and joining by keys of which one may hold most rows: no key's rows come together in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.llm.shared import scratch, stored


def numbered(spark: SparkSession, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: 0, 1, .. of each group, in ascending order (nulls first); equal rows come in any order.

    All rows are sorted by ranges of group and order, so that a large group lies in many tasks, and written; a row's number is
    its place in its file, plus the rows of its group in the files before: one count a group and file.
    """
    own = ["__part", "__file", "__at"]
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    salt = F.monotonically_increasing_id()  # only splits equal rows
    path = scratch(spark)
    spread = rows.withColumn("__salt", salt).repartitionByRange(*by, F.col("__salt")).sortWithinPartitions(*by, "__salt")
    spread.drop("__salt").withColumn("__part", F.spark_partition_id()).write.option("maxRecordsPerFile", 0).parquet(path)
    files = spark.read.parquet(path).withColumn("__at", F.col("_metadata.row_index"))
    starts = files.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(spark, starts.withColumn("__before", F.coalesce(before, F.lit(0)) - F.col("__first")).select(F.col(group).alias("__group"), F.col("__part").alias("__of"), "__before"))
    found = files.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return found.withColumn(name, F.col("__at") + F.col("__before")).drop(*own, "__group", "__of", "__before")


def spread_join(left: DataFrame, right: DataFrame, key: str, salts: int = 1024) -> DataFrame:
    """left joined to right's one row a key (left join); right's row goes to each part of a key that left has, of ``salts`` at most."""
    parted = left.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts)).cast("int"))
    parts = parted.select(key, "__salt").distinct().join(right, key)
    return parted.join(parts, [key, "__salt"], "left").drop("__salt")
