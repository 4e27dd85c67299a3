"""Scans: Kafka, files as a stream, JDBC, CSV seeds and date-partitioned tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingSource(Exception):
    """A table that a job needs isn't there or has no rows."""


def kafka_options(servers: str, topic: str, group: str | None = None) -> dict[str, str]:
    """``group`` names the consumers; where they are is kept in the stream's checkpoint."""
    own = {"kafka.group.id": group} if group else {}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false", **own}


def kafka_stream(spark: SparkSession, servers: str, topic: str, group: str | None = None) -> DataFrame:
    """value, topic, partition, offset, timestamp of a topic (needs Spark's Kafka connector on the class path)."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, group)).load()


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """The same envelope, or any schema, from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def decode(envelope: DataFrame, schema: str) -> DataFrame:
    """JSON values flattened by a declared schema, with the envelope; undecodable rows come out null."""
    rows = envelope.select(F.from_json(F.col("value").cast("string"), schema).alias("data"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"))
    return rows.select("data.*", "kafka_partition", "kafka_offset", "kafka_timestamp", F.current_timestamp().alias("ingestion_time"), F.to_date("kafka_timestamp").alias("date"))


def jdbc_options(url: str, table: str, user: str, password: str, driver: str = "org.postgresql.Driver") -> dict[str, str]:
    return {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver}


def jdbc_table(spark: SparkSession, *, column: str | None = None, parts: int = 8, predicates: list[str] | None = None, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database's table, read by several tasks: by ranges of a numeric, date or timestamp ``column`` between its least and largest value
    (one small query; an empty table is read at once), or by conditions of which each row meets one.  Rows with a null in ``column`` are the first task's.
    """
    conf = jdbc_options(**options) | {"fetchsize": str(fetch)}
    if predicates:
        url, table = conf.pop("url"), conf.pop("dbtable")
        return spark.read.jdbc(url, table, predicates=predicates, properties=conf)
    if column:
        name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(conf["url"]).quoteIdentifier(column)
        ends = spark.read.format("jdbc").options(**conf | {"dbtable": f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {conf['dbtable']}) ends"}).load().first()
        low, high = tuple(ends)
        if low is not None:
            conf |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**conf).load()


def csv_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def table_on(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """A date-partitioned table, pruned to one date; MissingSource if it isn't there."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingSource(path) from e
    return df if date is None else df.where(F.col("date") == F.lit(date).cast("date"))


def not_empty(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise MissingSource(f"{name} has no rows")
    return df


def register(sources: dict[str, DataFrame]) -> None:
    for name, df in sources.items():
        df.createOrReplaceTempView(name)


def sample_between(df: DataFrame, ts: str, start: str, end: str, n: int = 50_000) -> DataFrame:
    """At most n rows of a time range."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).limit(n)
