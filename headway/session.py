"""Session settings that the jobs rely on, and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a drained stream with a state time-to-live would else run empty batches for ever
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def session(master: str | None = None, app: str = "headway", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder; a local one only where none is set and Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
