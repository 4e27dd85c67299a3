"""Table writes on partitioned Parquet: append, merges, replacement, retention and compaction.

Every write can run again with the same rows and leave the same table.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.config import DEFAULT


def read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("date").parquet(path)


def overwrite(df: DataFrame, path: str, partitioned: bool = True) -> None:
    """Replaces the partitions that df has; an unpartitioned table as a whole."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partitioned else "static")
    (w.partitionBy("date") if partitioned else w).parquet(path)


def _touched(df: DataFrame) -> list:
    return [r.date for r in df.select("date").distinct().collect()]  # dates of one batch


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of highest offset of each key; null keys go."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    if "kafka_offset" not in df.columns:
        return df
    rest = [c for c in df.columns if c not in keys and c != "kafka_offset"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest, "kafka_offset"), "kafka_offset").alias("r")).select(*keys, "r.*")


def insert_only_merge(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key is new; within the batch the highest offset wins; null keys go."""
    df, table = newest(df, keys), read(spark, path)
    if table is not None:
        df = df.join(table.where(F.col("date").isin(_touched(df))).select(*keys), keys, "left_anti")
    append(df, path)


def upsert_merge(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Updates rows whose key is there, inserts the others; only touched partitions are rewritten."""
    table = read(spark, path)
    if table is not None:
        old = table.where(F.col("date").isin(_touched(df))).join(df.select(*keys), keys, "left_anti")
        df = old.unionByName(df, allowMissingColumns=True)
    overwrite(df, path)


def replace_date(spark: SparkSession, df: DataFrame, path: str, date: str) -> bool:
    """One date's rows replaced; nothing happens without rows."""
    rows = df.where(F.col("date") == F.lit(date).cast("date"))
    if rows.isEmpty():
        return False
    overwrite(rows, path)
    return True


def write_jdbc(df: DataFrame, options: dict[str, str]) -> None:
    """Truncate and load; ``numPartitions`` in the options bounds the connections."""
    df.write.format("jdbc").options(**options).option("truncate", True).mode("overwrite").save()


def _execute(spark: SparkSession, options: dict[str, str], statement: str, *values: str) -> int:
    """One statement in a transaction of its own; rows that it changed."""
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user", ""), options.get("password", ""))
    try:
        prepared = connection.prepareStatement(statement)
        for i, v in enumerate(values):
            prepared.setDate(i + 1, jvm.java.sql.Date.valueOf(v))
        return prepared.executeUpdate()
    finally:
        connection.close()


def quoted(spark: SparkSession, url: str, column: str) -> str:
    """A column as the database has it: Spark creates columns with quoted names."""
    return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)


def replace_date_jdbc(df: DataFrame, options: dict[str, str], date: str) -> int | None:
    """One date's rows of a database table deleted, then appended; rows deleted, None if there are no rows to append.

    Deleting comes first, so that a run after a failure of either half leaves each row once.
    """
    spark, rows = df.sparkSession, df.where(F.col("date") == F.lit(date).cast("date"))
    if rows.isEmpty():
        return None
    gone = _execute(spark, options, f"DELETE FROM {options['dbtable']} WHERE {quoted(spark, options['url'], 'date')} = ?", date)
    rows.write.format("jdbc").options(**options).mode("append").save()
    return gone


def retain_jdbc(spark: SparkSession, options: dict[str, str], days: int, base_date: str) -> int:
    """Deletes a database table's rows of dates before base_date - days; their number."""
    limit = (datetime.date.fromisoformat(base_date) - datetime.timedelta(days)).isoformat()
    return _execute(spark, options, f"DELETE FROM {options['dbtable']} WHERE {quoted(spark, options['url'], 'date')} < ?", limit)


def expired(df: DataFrame, days: int, base_date: str) -> DataFrame:
    """Rows of dates before base_date - days; the limit's own day stays."""
    return df.where(F.col("date") < F.date_sub(F.lit(base_date).cast("date"), days))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, path: str, target: str) -> None:
    p, fs = _file_system(spark, path)
    if not fs.rename(p, _file_system(spark, target)[0]):
        raise OSError(f"{path} can't become {target}")


def size_of(spark: SparkSession, path: str) -> int:
    p, fs = _file_system(spark, path)
    return fs.getContentSummary(p).getLength()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    p, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to the end."""
    return sorted(int(v.removeprefix("v=")) for v in folders(spark, path) if v.startswith("v=") and exists(spark, f"{path}/{v}/_SUCCESS"))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table that is replaced as a whole."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={done[-1]}") if done else None


def replace(spark: SparkSession, df: DataFrame, path: str, keep: int = 2) -> None:
    """df, which may be made from the current version, as the next one; a crash leaves the current version what it was."""
    done = _versions(spark, path)
    now = done[-1] + 1 if done else 0
    overwrite(df, f"{path}/v={now}", partitioned=False)
    for v in done[: -keep + 1 or None]:
        drop(spark, f"{path}/v={v}")


def apply_retention(spark: SparkSession, path: str, days: int, base_date: str) -> list[str]:
    """Drops the expired partitions' folders; returns their dates."""
    table = read(spark, path)
    if table is None:
        return []
    gone = sorted(str(r.date) for r in expired(table.select("date"), days, base_date).distinct().collect())
    for date in gone:
        drop(spark, f"{path}/date={date}")
    return gone


TARGET_BYTES = 256 << 20
_PLAN = "_compaction"


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the Parquet files in a folder."""
    p, fs = _file_system(spark, path)
    listed = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []
    return {n: size for n, size in listed if n.endswith(".parquet") and not n.startswith(("_", "."))}


def bins(files: dict[str, int], target: int) -> list[list[str]]:
    """Files under three quarters of ``target`` in bins of ``target`` at most, the largest first; a bin of one file isn't any."""
    out: list[tuple[int, list[str]]] = []
    for name, size in sorted(files.items(), key=lambda x: (-x[1], x[0])):
        if size * 4 >= target * 3:
            continue
        at = next((i for i, (used, _) in enumerate(out) if used + size <= target), None)
        if at is None:
            out.append((size, [name]))
        else:
            out[at] = (out[at][0] + size, [*out[at][1], name])
    return [names for _, names in out if len(names) > 1]


def _finish(spark: SparkSession, folder: str) -> None:
    """Second half of a compaction: the files that were read go, the new ones come. Can be repeated until it is through."""
    made, plan = f"{folder}/{_PLAN}/made", f"{folder}/{_PLAN}/read"
    if exists(spark, f"{plan}/_SUCCESS"):  # without it nothing has been changed yet
        for r in spark.read.schema("file string").json(plan).toLocalIterator():
            drop(spark, f"{folder}/{r.file}")
        for name in _files(spark, made):
            move(spark, f"{made}/{name}", f"{folder}/{name}")
    drop(spark, f"{folder}/{_PLAN}")


def compact(spark: SparkSession, path: str, date: str, target: int = TARGET_BYTES, order: tuple[str, ...] = ("vehicle_id", "event_time_ms")) -> int:
    """Joins small files of a date to files of about ``target`` bytes, each sorted; returns the number of files that were joined.

    Sizes come from the listing, and only the small files are read; others stay. Every new file is one task's, of ``target``
    bytes. New files are written aside with the list of what they replace; a run that finds such a list ends it first.
    """
    folder = f"{path}/date={date}"
    if exists(spark, f"{folder}/{_PLAN}"):
        _finish(spark, folder)
    packed = bins(_files(spark, folder), target)
    if not packed:
        return 0
    names = [(n, i) for i, b in enumerate(packed) for n in b]
    place = spark.createDataFrame(names, "_file string, _bin int")  # a row a file
    rows = spark.read.option("basePath", path).parquet(*[f"{folder}/{n}" for n, _ in names]).drop("date")
    keys = [c for c in order if c in rows.columns]
    dealt = rows.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(F.broadcast(place), "_file").drop("_file")
    dealt.repartitionById(len(packed), "_bin").sortWithinPartitions("_bin", *keys).drop("_bin").write.option("maxRecordsPerFile", 0).parquet(f"{folder}/{_PLAN}/made")
    place.select(F.col("_file").alias("file")).coalesce(1).write.json(f"{folder}/{_PLAN}/read")
    _finish(spark, folder)
    return len(names)


#: Actions of the maintenance job, by layer.
ACTIONS = {"bronze": ("retention", "compaction"), "silver": ("retention", "compaction"), "gold": ("retention", "compaction"), "warehouse": ("retention",)}


def maintain(spark: SparkSession, root: str, base_date: str, layers: dict[str, list[str]], only: tuple[str, ...] | None = None, **options) -> dict[str, dict[str, list[str]]]:
    """The actions of each layer's tables (``only``: those alone): dates that each was applied to.

    Retention drops expired dates, compaction joins the base date's small files.
    """
    days, done = dict(DEFAULT.retention_days), {}
    for layer, names in layers.items():
        for t in names:
            path, own = f"{root}/{layer}/{t}", {}
            for action in ACTIONS[layer]:
                if only is not None and action not in only:
                    continue
                if action == "retention":
                    own[action] = apply_retention(spark, path, days[layer], base_date)
                elif action == "compaction":
                    own[action] = [base_date] if compact(spark, path, base_date, **options) else []
            done[f"{layer}/{t}"] = own
    return done


def materialise(df: DataFrame, name: str, as_view: bool = False) -> None:
    df.createOrReplaceTempView(name.split(".")[-1]) if as_view else df.write.mode("overwrite").saveAsTable(name)
