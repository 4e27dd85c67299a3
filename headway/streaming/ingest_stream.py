"""Ingest as one stream: raw messages to telemetry, dead letters and counters, each message classified once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from headway.operators import validate
from headway.operators.batches import write_batch

#: Counters, as ``validate.counters`` names them.
REASONS = ("valid", "corrupt_json", "missing_vp_wrapper", "filtered", "contract_violation", "gps_dropout", "runtime_error")
NAME = "ingest"


def envelope(rows: DataFrame) -> DataFrame:
    """(value, topic, kafka_partition, kafka_offset, received_at) of a topic's rows; a value that is no UTF-8 is no JSON either.

    ``received_at`` is the row's own time if it has one, else the batch's, which stays the same when a batch is repeated.
    """
    has = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(F.col("value").cast("string").alias("value"), has("topic", "string").alias("topic"), has("partition", "int").alias("kafka_partition"), has("offset", "long").alias("kafka_offset"), F.coalesce(has("timestamp", "timestamp"), F.current_timestamp()).alias("received_at"))


def observed(classified: DataFrame) -> DataFrame:
    """Counts every message that passes; late is the number of messages received after their event."""
    reason = F.coalesce("reason", F.lit("valid"))
    late = (F.unix_micros("received_at") - F.unix_micros("timestamp")) / 1e6
    known = F.col("reason").isNull() & (late > 0)
    return classified.observe(NAME, F.count("*").alias("received"), *[F.count_if(reason == r).alias(r) for r in REASONS], *[F.count_if(known & (late <= b)).alias(f"latency_le_{b}") for b in validate.LATENCY_BUCKETS], F.count_if(known).alias("latency_count"))


class IngestCounters(StreamingQueryListener):
    """Sums of what the streams' batches observed; a repeated batch counts once.

    Holds one row a stream.  ``publish`` gets the sums after each batch: a gauge, a log, a table.
    """

    def __init__(self, publish: Callable[[dict[str, int]], None] | None = None) -> None:
        self.publish, self.before, self.last = publish, {}, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if NAME not in p.observedMetrics:
            return
        now, key = p.observedMetrics[NAME].asDict(), str(p.id)
        batch, counts = self.last.get(key, (None, {}))
        if batch is not None and batch != p.batchId:
            self.before[key] = {c: self.before.get(key, {}).get(c, 0) + n for c, n in counts.items()}
        self.last[key] = (p.batchId, now)
        if self.publish:
            self.publish(self.totals())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in [*self.before.values(), *(c for _, c in self.last.values())]:
            for name, n in counts.items():
                out[name] = out.get(name, 0) + n
        return out


def _sinks(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            good, letters = validate.split(kept)
            write_batch(good.withColumn("date", F.to_date("timestamp")), f"{root}/telemetry", batch_id)
            write_batch(letters.withColumn("date", F.to_date("received_at")), f"{root}/dead_letters", batch_id)
            write_batch(validate.counters(kept), f"{root}/counters", batch_id, ())
        finally:
            kept.unpersist()

    return write


def ingest(rows: DataFrame, root: str, checkpoint: str, line: str | None = None, once: bool = True) -> StreamingQuery:
    """Telemetry, dead letters and counters by batch below ``root``; a batch that is repeated after a failure replaces what it wrote.

    ``rows`` has ``value`` and, if known, topic, partition, offset and timestamp.  ``line`` keeps one line's messages alone.
    """
    stream = observed(validate.classify(envelope(rows), line))
    writer = stream.writeStream.queryName(NAME).foreachBatch(_sinks(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
