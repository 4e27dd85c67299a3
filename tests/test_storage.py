"""Compaction by size, and the database legs on an embedded database."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from headway.operators import tables
from headway.session import scratch
from headway.sources import connectors

DAY = "2026-01-05"


def test_bins():
    files = {"a": 90, "b": 60, "c": 50, "d": 40, "e": 10, "f": 5, "g": 75}
    packed = tables.bins(files, 100)
    assert sorted(map(sorted, packed)) == [["b", "d"], ["c", "e", "f"]]  # a and g are large enough
    assert tables.bins({"a": 10}, 100) == [] and tables.bins({}, 100) == []
    many = tables.bins({f"f{i}": 30 for i in range(1000)}, 100)
    assert all(len(b) <= 3 for b in many) and sum(map(len, many)) >= 999


def small_files(spark, path, n, rows=200):
    df = spark.range(n * rows).select((F.col("id") % 37).cast("string").alias("vehicle_id"), (F.col("id") * 7919 % 100_003).alias("event_time_ms"), F.sha2(F.col("id").cast("string"), 512).alias("payload"), F.lit(DAY).cast("date").alias("date"))
    df.repartition(n).write.mode("append").partitionBy("date").parquet(path)


def listed(path):
    return {f.name: f.stat().st_size for f in pathlib.Path(path.removeprefix("file://")).glob(f"date={DAY}/*.parquet")}


def contents(spark, path):
    return sorted((r.vehicle_id, r.event_time_ms, r.payload) for r in spark.read.parquet(path).collect())


def test_compaction_by_size(spark):
    path = scratch(spark)
    small_files(spark, path, 12)
    small_files(spark, path, 1, 8000)  # a large one
    before, rows = listed(path), contents(spark, path)
    large = max(before, key=before.get)
    target = sum(s for f, s in before.items() if f != large) // 3
    assert before[large] > target
    assert 11 <= tables.compact(spark, path, DAY, target) <= 12  # one may fit in no bin
    after = listed(path)
    assert large in after and 3 <= len(after) - 1 <= 5 and contents(spark, path) == rows  # several files, not one
    assert max(s for f, s in after.items() if f != large) <= target * 1.2
    for f in after:
        if f not in before:
            own = [(r.vehicle_id, r.event_time_ms) for r in spark.read.parquet(f"{path}/date={DAY}/{f}").collect()]
            assert own == sorted(own)
    stamps = lambda: {f: pathlib.Path(path.removeprefix("file://"), f"date={DAY}", f).stat().st_mtime_ns for f in listed(path)}
    was = stamps()
    tables.compact(spark, path, DAY, target)
    third = stamps()
    tables.compact(spark, path, DAY, target)
    assert stamps() == third and third[large] == was[large]  # a further run does nothing
    assert tables.compact(spark, path, "2030-01-01") == 0 and tables.compact(spark, scratch(spark), DAY) == 0


@pytest.mark.parametrize("when", ["before the list", "after the list", "half deleted"])
def test_compaction_ends_after_a_crash(spark, monkeypatch, when):
    path = scratch(spark)
    small_files(spark, path, 6)
    rows, finish, dropped = contents(spark, path), tables._finish, []

    def breaks(spark, folder):
        if when == "before the list":
            tables.drop(spark, f"{folder}/{tables._PLAN}/read")
        if when == "half deleted":
            drop = tables.drop

            def few(spark, p):
                dropped.append(p)
                if len(dropped) > 3:
                    raise OSError("lost")
                drop(spark, p)

            monkeypatch.setattr(tables, "drop", few)
            try:
                finish(spark, folder)
            finally:
                monkeypatch.setattr(tables, "drop", drop)
        raise OSError("lost")

    monkeypatch.setattr(tables, "_finish", breaks)
    with pytest.raises(OSError, match="lost"):
        tables.compact(spark, path, DAY)
    monkeypatch.setattr(tables, "_finish", finish)
    tables.compact(spark, path, DAY)
    assert contents(spark, path) == rows and len(listed(path)) == 1
    assert tables.folders(spark, f"{path}/date={DAY}") == []


@pytest.fixture
def database(tmp_path):
    return {"url": f"jdbc:derby:{tmp_path}/db;create=true", "user": "app", "password": "app", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database_round_trip(spark, database):
    day = lambda d: datetime.date(2026, 1, d)
    rows = spark.createDataFrame([(i, f"stop {i}", day(1 + i % 3)) for i in range(90)], "id int, name string, date date")
    options = database | {"dbtable": "stops"}
    read = lambda **more: connectors.jdbc_table(spark, table="stops", **database, **more)
    values = lambda df: sorted((r[0], r[1], r[2]) for r in df.collect())
    tables.write_jdbc(rows, options)
    tables.write_jdbc(rows.where("id < 60"), options)  # truncate and load: nothing stays
    assert values(read()) == values(rows.where("id < 60"))
    tables.write_jdbc(rows, options)
    by_range = read(column="id", parts=4)
    assert by_range.rdd.getNumPartitions() == 4 and values(by_range) == values(rows)
    by_date = read(column="date", parts=2)
    assert by_date.rdd.getNumPartitions() == 2 and values(by_date) == values(rows)
    by_condition = read(predicates=['"id" < 10', '"id" >= 10 and "id" < 50', '"id" >= 50'])
    assert by_condition.rdd.getNumPartitions() == 3 and values(by_condition) == values(rows)
    assert max(len(p) for p in by_range.rdd.glom().collect()) < 40
    empty = spark.createDataFrame([], rows.schema)
    tables.write_jdbc(empty, database | {"dbtable": "nothing"})
    assert connectors.jdbc_table(spark, table="nothing", column="id", **database).isEmpty()


def test_a_date_is_replaced_in_the_database(spark, database):
    day = lambda d: datetime.date(2026, 1, d)
    rows = spark.createDataFrame([(i, day(1 + i % 3)) for i in range(30)], "id int, date date")
    options = database | {"dbtable": "events"}
    read = lambda: sorted((r[0], r[1]) for r in connectors.jdbc_table(spark, table="events", **database).collect())
    tables.write_jdbc(rows, options)
    new = spark.createDataFrame([(100 + i, day(2)) for i in range(4)] + [(200, day(3))], rows.schema)
    want = sorted([(i, day(1 + i % 3)) for i in range(30) if i % 3 != 1] + [(100 + i, day(2)) for i in range(4)])
    assert tables.replace_date_jdbc(new, options, "2026-01-02") == 10 and read() == want
    assert tables.replace_date_jdbc(new, options, "2026-01-02") == 4 and read() == want  # again: the same
    assert tables.replace_date_jdbc(new, options, "2026-01-09") is None and read() == want


    with pytest.raises(Exception):
        tables.replace_date_jdbc(new.withColumn("id", F.lit("no number")), options, "2026-01-02")
    assert tables.replace_date_jdbc(new, options, "2026-01-02") == 0 and read() == want
    assert tables.retain_jdbc(spark, options, 1, "2026-01-03") == 10 and {d for _, d in read()} == {day(2), day(3)}
