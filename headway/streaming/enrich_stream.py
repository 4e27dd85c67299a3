"""The keyed state operator on streams, and its sinks."""

from __future__ import annotations

import time as clocks
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from headway.config import DEFAULT, Config
from headway.functions.columns import EARTH_M
from headway.operators.enrich import arrivals
from headway.operators.batches import merge_batch, put_online
from headway.operators.features import online_latest

_ROW = "vehicle_id string, event_time_ms long, latitude double, longitude double, speed_ms double, heading int, delay_seconds int, door_status int, line_id string, direction_id int, operator_id int, next_stop_id string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, ingestion_time timestamp, date date"
OUTPUT = f"{_ROW}, delay_trend double, speed_trend double, distance_since_last_m double, time_since_last_ms long, is_stopped boolean, is_arrival boolean, stopped_duration_ms long, door_open_duration_ms long, processing_time timestamp"
_STATE = "delays array<int>, time long, latitude double, longitude double, speed double, stop string, stopped_since long, opened_since long"


def _metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle metres; 0 where a coordinate is missing."""
    a1, o1, a2, o2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return np.nan_to_num(2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a)))


def _none(x: float) -> float | None:
    return None if np.isnan(x) else x


def _before(x: np.ndarray, first) -> np.ndarray:
    """Each row's value of the row before; ``first`` (null: NaN) for the first row."""
    return np.concatenate(([np.nan if first is None else first], x[:-1]))


def _since(begins: np.ndarray, ends: np.ndarray, at: np.ndarray, carried) -> tuple[np.ndarray, object]:
    """(milliseconds since the island that a row finds open began, 0 without one; when the one open at last began).

    An island opens at the first of ``begins`` after one of ``ends``; ``carried``: when the one from before began.
    """
    n, rows = len(at), np.arange(len(at) + 1)
    last_end = np.maximum.accumulate(np.concatenate(([-1], np.where(ends, rows[:-1], -1))))  # before each row, and at last
    opening = np.append(np.where(begins, rows[:-1], n), n)
    opening = np.minimum.accumulate(opening[::-1])[::-1][last_end + 1]  # the first begin after that end
    start = np.where(opening < rows, np.append(at, 0)[np.minimum(opening, n)], -1.0)
    if carried is not None:
        start = np.where(last_end < 0, float(carried), start)
    known = start >= 0
    return np.where(known[:-1], at - start[:-1], 0).astype(np.int64), int(start[-1]) if known[-1] else None


def wall_ms() -> int:
    return int(clocks.time() * 1000)


class VehicleState(StatefulProcessor):
    """Trends, distance, stop duration and stop arrivals of a vehicle, in order of arrival."""

    def __init__(self, c: Config = DEFAULT, clock: Callable[[], int] = wall_ms) -> None:
        self.c, self.clock = c, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("vehicle", _STATE, ttlDurationMs=self.c.state_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key's rows come in several pieces: order them as a whole; all features are array operations
        df = pd.concat(list(rows)).sort_values("kafka_offset", kind="stable", ignore_index=True)
        kept = self.state.get() if self.state.exists() else None
        past, time, lat, lon, speed, stop, since, opened = (list(kept[0] or []), *kept[1:]) if kept else ([], *[None] * 7)
        num = lambda c: df[c].fillna(0).to_numpy(np.float64)
        v, at, y, x, doors = num("speed_ms"), df["event_time_ms"].to_numpy(np.int64), df["latitude"].to_numpy(np.float64), df["longitude"].to_numpy(np.float64), num("door_status")
        delays = np.concatenate((past, num("delay_seconds")))
        sums, upto = np.concatenate(([0.0], np.cumsum(delays))), np.arange(len(past), len(delays))
        low = np.maximum(0, upto - self.c.history)
        nxt = df["next_stop_id"].astype(object).where(df["next_stop_id"].notna(), None)
        was = [stop, *nxt[:-1]]
        stopped = v < self.c.stop_speed_ms
        stopped_ms, since = _since(stopped, ~stopped, at, since)
        door_ms, opened = _since(doors == 1, doors == 0, at, opened)
        out = {
            "delay_trend": delays[len(past) :] - (sums[upto] - sums[low]) / np.maximum(upto - low, 1),
            "speed_trend": np.nan_to_num(v - _before(v, speed)),
            "distance_since_last_m": _metres(_before(y, lat), _before(x, lon), y, x),
            "time_since_last_ms": np.nan_to_num(at - _before(at.astype(np.float64), time)).astype(np.int64),
            "is_stopped": stopped,
            "is_arrival": [a is not None and b is not None and a != b for a, b in zip(was, nxt, strict=True)],
            "stopped_duration_ms": stopped_ms,
            "door_open_duration_ms": door_ms,
        }
        self.state.update(([int(d) for d in delays[-self.c.history :]], int(at[-1]), _none(float(y[-1])), _none(float(x[-1])), float(v[-1]), nxt.iloc[-1], since, opened))
        zero = {c: df[c].fillna(0) for c in ("speed_ms", "delay_seconds", "door_status", "heading")}
        yield df.assign(**zero, **out, processing_time=pd.Timestamp(self.clock(), unit="ms"))

    def close(self) -> None:
        pass


def enrich_stream(rows: DataFrame, c: Config = DEFAULT, clock: Callable[[], int] = wall_ms) -> DataFrame:
    """A stream of telemetry with its features; late rows are kept, malformed ones (no vehicle or time) go."""
    clean = rows.where("vehicle_id is not null and event_time_ms is not null")
    return clean.groupBy("vehicle_id").transformWithStateInPandas(VehicleState(c, clock), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def _sinks(root: str, clock: Callable[[], int], c: Config):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.persist()
        try:
            merge_batch(spark, batch, f"{root}/enriched", ["vehicle_id", "date", "event_time_ms"], batch_id)
            merge_batch(spark, arrivals(batch), f"{root}/stop_events", ["vehicle_id", "date", "arrival_time"], batch_id, "arrival_time")
            put_online(spark, online_latest(batch), f"{root}/online", batch_id, clock(), c)
        finally:
            batch.unpersist()

    return write


def run(rows: DataFrame, root: str, checkpoint: str, once: bool = True, c: Config = DEFAULT, clock: Callable[[], int] = wall_ms) -> StreamingQuery:
    """Enriched rows, stop arrivals and online features from one stream; each sink can repeat a batch.

    ``clock`` gives the milliseconds now: the time of processing, and what online features expire by.
    """
    writer = enrich_stream(rows, c, clock).writeStream.foreachBatch(_sinks(root, clock, c)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def bronze_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], once: bool = True) -> StreamingQuery:
    """Decoded rows merged into a bronze table; null keys go.  One key is the event's time in milliseconds."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, batch, path, keys, batch_id, next(k for k in keys if k.endswith(("_ms", "_time"))))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def json_sink(rows: DataFrame, key: str) -> DataFrame:
    """(key, value) for a topic; the key keeps a vehicle's rows in one partition."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_topic(rows: DataFrame, key: str, target: dict[str, str], checkpoint: str, form: str = "kafka", once: bool = True) -> StreamingQuery:
    """A stream's rows as (key, value), dealt by key so that a vehicle's rows keep their order.

    ``form`` is ``kafka`` (target: servers and topic), or a file format (target: path).
    """
    out = json_sink(rows, key).repartition("key")
    writer = out.writeStream.format(form).options(**target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def active_vehicles(rows: DataFrame) -> DataFrame:
    """Distinct vehicles of the last 60 seconds, every 10 seconds; ``event_time`` has the same for streams."""
    return rows.groupBy(F.window("kafka_timestamp", "60 seconds", "10 seconds").alias("w")).agg(F.count_distinct("vehicle_id").alias("active_vehicles")).select(F.col("w.start").alias("window_start"), "active_vehicles")
