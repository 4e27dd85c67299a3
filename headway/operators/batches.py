"""Tables that grow batch by batch: every batch owns its partitions, so that a repeated batch replaces what it wrote.

A merge keeps the keys of each batch beside the table as (date, slot of the event's time, batch, hash).  A later batch looks its own
keys up in the slots that it has, and opens only those batches of the table that hold one of them; usually there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.config import DEFAULT, Config
from headway.operators.features import alive
from headway.operators.tables import TARGET_BYTES, drop, exists, expired, folders, move, newest, size_of

HOUR_MS = 3_600_000


def write_batch(df: DataFrame, path: str, batch: int, by: tuple[str, ...] = ("date",)) -> None:
    """The batch's rows in partitions of their own."""
    rows = df.withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def holders(spark: SparkSession, keyed: DataFrame, path: str, batch: int) -> list[str]:
    """Folders of other batches that hold a key of (date, slot, hash); reads the index of the slots alone."""
    slots = [f"{path}_keys/date={r.date}/slot={r.slot}" for r in keyed.select("date", "slot").distinct().collect()]  # slots of one batch
    slots = [s for s in slots if exists(spark, s)]
    if not slots:
        return []
    index = spark.read.option("basePath", f"{path}_keys").schema("hash long, date date, slot long, batch long").parquet(*slots)
    found = index.where(F.col("batch") != batch).join(keyed, ["date", "slot", "hash"]).select("date", "batch").distinct().collect()  # one row a batch
    return sorted(p for p in (f"{path}/date={r.date}/batch={r.batch}" for r in found) if exists(spark, p))


def merge_batch(spark: SparkSession, df: DataFrame, path: str, keys: list[str], batch: int, time: str = "event_time_ms", slot_ms: int = HOUR_MS) -> list[str]:
    """Appends the rows whose key is new, as ``tables.insert_only_merge``; returns the folders of the table that it read.

    ``keys`` hold ``date``; ``time`` is milliseconds of the event,
    ``slot_ms`` the length of a slot (a stream's batch has one or two hours; a load of whole days does better with days).  Can be repeated until the next batch is merged.
    """
    hashed = newest(df, keys).withColumns({"_slot": F.floor(F.coalesce(time, F.lit(0)) / slot_ms), "_hash": F.xxhash64(*[F.col(k).cast("string") for k in keys])})
    own = hashed.persist()
    try:
        held = holders(spark, own.select(F.col("date").cast("date").alias("date"), F.col("_slot").alias("slot"), F.col("_hash").alias("hash")), path, batch)
        new = own
        if held:
            known = spark.read.option("basePath", path).parquet(*held).select(*[F.col(k).cast(own.schema[k].dataType).alias(k) for k in keys])
            new = own.join(known, keys, "left_anti")
        write_batch(new.select("date", F.col("_slot").alias("slot"), F.col("_hash").alias("hash")), f"{path}_keys", batch, ("date", "slot"))
        write_batch(new.drop("_slot", "_hash"), path, batch)
    finally:
        own.unpersist()
    return held


_FOLD = "_folding"


def _finish_fold(spark: SparkSession, folder: str) -> None:
    """Second half of a fold: the batches that were read go, the folded one comes. Can be repeated until it is through."""
    if exists(spark, f"{folder}/{_FOLD}/read/_SUCCESS"):  # without it nothing has been changed yet
        for r in spark.read.schema("batch string, target string").json(f"{folder}/{_FOLD}/read").collect():  # a row a batch
            drop(spark, f"{folder}/{r.batch}")
            if exists(spark, f"{folder}/{_FOLD}/made"):
                move(spark, f"{folder}/{_FOLD}/made", f"{folder}/{r.target}")
    drop(spark, f"{folder}/{_FOLD}")


def fold(spark: SparkSession, path: str, date: str, below: int, target: int = TARGET_BYTES, order: tuple[str, ...] = ("vehicle_id", "event_time_ms")) -> int:
    """Folds a date's batches below a number into one of about ``target`` bytes a file, sorted; returns how many there were.

    ``below`` is a batch that can't be repeated any more, or the next one.  The folded batch has a negative number, so that no stream's batch is
    ever taken for it.  The keys get its number before the rows move and lose the old ones after, so that a merge finds
    every key at any moment; a run that finds an unfinished fold ends it first.
    """
    folder, keys = f"{path}/date={date}", f"{path}_keys/date={date}"
    if exists(spark, f"{folder}/{_FOLD}"):
        _finish_fold(spark, folder)
    numbers = sorted(int(b.removeprefix("batch=")) for b in folders(spark, folder) if b.startswith("batch="))
    numbers = [b for b in numbers if b < below]
    if len(numbers) > 1:
        new, names = -max(abs(b) for b in numbers) - 1, [f"batch={b}" for b in numbers]
        if exists(spark, keys):
            index = spark.read.option("basePath", f"{path}_keys").schema("hash long, date date, slot long, batch long").parquet(keys)
            write_batch(index.where(F.col("batch").isin(numbers)).drop("batch"), f"{path}_keys", new, ("date", "slot"))
        sizes = sum(size_of(spark, f"{folder}/{n}") for n in names)
        rows = spark.read.option("basePath", path).parquet(*[f"{folder}/{n}" for n in names]).drop("date", "batch")
        own = [c for c in order if c in rows.columns]
        rows.repartitionByRange(max(1, -(-sizes // target)), *own).sortWithinPartitions(*own).write.parquet(f"{folder}/{_FOLD}/made")
        spark.createDataFrame([(n, f"batch={new}") for n in names], "batch string, target string").coalesce(1).write.json(f"{folder}/{_FOLD}/read")
        _finish_fold(spark, folder)
    there = set(folders(spark, folder))
    for slot in folders(spark, keys):  # keys of batches that are folded
        for b in folders(spark, f"{keys}/{slot}"):
            if b.startswith("batch=") and int(b.removeprefix("batch=")) < below and b not in there:
                drop(spark, f"{keys}/{slot}/{b}")
    return len(numbers) if len(numbers) > 1 else 0


def retain(spark: SparkSession, path: str, days: int, base_date: str) -> list[str]:
    """Drops expired dates of a merged table and of its keys; the folders' names decide, no file is opened."""
    dates = [d.removeprefix("date=") for d in folders(spark, path) if d.startswith("date=")]
    gone = sorted(r.date for r in expired(spark.createDataFrame([(d,) for d in dates], "date string").withColumn("date", F.col("date").cast("date")), days, base_date).select(F.col("date").cast("string").alias("date")).collect())
    for d in gone:
        drop(spark, f"{path}_keys/date={d}")
        drop(spark, f"{path}/date={d}")
    return gone


# ---- online features ----


def put_online(spark: SparkSession, latest: DataFrame, path: str, batch: int, now_ms: int, c: Config = DEFAULT) -> None:
    """A batch's latest row of each vehicle beside those of the batches before; a batch whose rows have all expired goes.

    What is written follows the batch, whatever the fleet; what is kept is what came within the time to live.
    The last moment of a batch stands in its folder's name.
    """
    for name in folders(spark, path):
        until = [int(u.removeprefix("until=")) for u in folders(spark, f"{path}/{name}")]
        if name == f"batch={batch}" or (until and max(until) + c.feature_ttl_ms < now_ms):
            drop(spark, f"{path}/{name}")
    rows = latest.persist()
    try:
        until = rows.agg(F.max("updated_at")).first()[0]
        if until is not None:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}/until={until}")
    finally:
        rows.unpersist()


def online(spark: SparkSession, path: str, now_ms: int, c: Config = DEFAULT) -> DataFrame | None:
    """The unexpired row of each vehicle, of the newest batch that has one, with its age."""
    if not any(n.startswith("batch=") for n in folders(spark, path)):
        return None
    rows = spark.read.parquet(path).drop("until")
    own = [c for c in rows.columns if c not in ("vehicle_id", "batch")]
    return alive(rows.groupBy("vehicle_id").agg(F.max_by(F.struct(*own), "batch").alias("f")).select("vehicle_id", "f.*"), now_ms, c)
