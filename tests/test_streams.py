"""Ingest, merges, online features and event time as streams: replays, restarts, late rows, and how much is read and written."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from headway.operators import batches, tables, validate
from headway.session import scratch
from headway.sources import connectors
from headway.streaming import event_time, ingest_stream

ENVELOPE = "value string, topic string, partition int, offset long, timestamp timestamp"
AT = datetime.datetime(2026, 1, 22, 10, 0, 5)


def message(**over):
    vp = {"veh": 1, "tst": "2026-01-22T10:00:00Z", "tsi": 1, "desi": "M1", "dir": "1", "oper": 2, "spd": 5.5, "hdg": 10, "lat": 60.1, "long": 24.9, "dl": 3, "drst": 0, "line": 7}
    return json.dumps({"VP": vp | over})


def test_typing_is_lenient_for_numbers_and_strict_for_texts(spark):
    cases = [
        (message(veh="12"), None, {"vehicle_id": "12"}), (message(veh=12.0), None, {"vehicle_id": "12"}), (message(veh=" 1_000 "), None, {"vehicle_id": "1000"}), (message(veh="12.00"), None, {"vehicle_id": "12"}), (message(veh=True), None, {"vehicle_id": "1"}),
        (message(veh="true"), "veh", {}), (message(veh="1e3"), "veh", {}), (message(veh=12.5), "veh", {}), (message(veh=""), "veh", {}), (message(veh=[1]), "veh", {}), (message(veh={"a": 1}), "veh", {}), (message(veh="1__0"), "veh", {}), (message(veh="_1"), "veh", {}),
        (message(lat="60.1"), None, {"latitude": 60.1}), (message(lat="6.01e1"), None, {"latitude": 60.1}), (message(spd="fast"), "spd", {}), (message(spd="3.5f"), "spd", {}), (message(spd=True), None, {"speed_ms": 1.0}),
        (message(dl=1.0), None, {"delay_seconds": 1}), (message(dl="+7"), None, {"delay_seconds": 7}), (message(dl=1.5), "dl", {}), (message(dl=10**12), "dl", {}), (message(hdg=None), None, {"heading": None}),
        (message(desi=7), "desi", {}), (message(tst=5), "tst", {}), (message(dir=2), "dir", {}), (message(start=False), "start", {}), (message(tsi=None), "tsi", {}), (message(route={"a": 1}), "route", {}),
        (message(dir="0"), "direction_id", {}), (message(dir="-1"), "direction_id", {}), (message(dir="3"), "direction_id", {}), (message(dir=" 2 "), None, {"direction_id": 2}), (message(dir=""), None, {"direction_id": 1}), (message(tst="yesterday"), "timestamp", {}),
    ]
    reasons = [('{"VP":[]}', "missing_vp_wrapper"), ('{"VP":""}', "missing_vp_wrapper"), ('{"VP":0}', "missing_vp_wrapper"), ('{"VP":false}', "missing_vp_wrapper"), ('{"VP":null}', "missing_vp_wrapper"), ('{"VP":{}}', "missing_vp_wrapper"), ('{"VP":[1]}', "contract_violation"), ('{"VP":{"x":1}}', "contract_violation"), ('{"VP":"x"}', "contract_violation"), ("null", "runtime_error"), ('"x"', "runtime_error"), ("", "corrupt_json"), (None, "corrupt_json"), (message(dir="1.0"), "runtime_error"), (message(dir="x", lat=None), "gps_dropout")]
    rows = [(i, v, "t") for i, v in enumerate([v for v, *_ in cases] + [v for v, _ in reasons])]
    out = validate.classify(spark.createDataFrame(rows, "i int, value string, topic string")).orderBy("i").collect()
    for r, (v, field, values) in zip(out, cases):
        assert (r.reason, r.error_field) == (("contract_violation", field) if field else (None, None)), v
        assert {k: r[k] for k in values} == values, v
    assert [r.reason for r in out[len(cases) :]] == [x for _, x in reasons]
    filtered = validate.classify(spark.createDataFrame(rows, "i int, value string, topic string"), "M1").orderBy("i").collect()
    assert filtered[len(cases) + 6].reason == "runtime_error" and filtered[-1].reason == "gps_dropout"  # a wrapper that is no object has no line


def land(spark, path, rows, schema=ENVELOPE):
    """One file a call; a stream takes files in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def counts_of(rows):
    return {r.reason: r["count"] for r in rows.collect()}


def test_ingest_stream_restarts_and_repeats(spark, monkeypatch):
    landing, root, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    texts = [[message(), message(veh="7"), "{broken", '{"X":1}'], [message(lat=None), message(dir="0"), message(dir="x"), "x" * 6000], [message(tst="2026-01-23T00:00:00Z")]]
    heard = []
    counters = ingest_stream.IngestCounters(heard.append)
    spark.streams.addListener(counters)

    def drain():
        stream = connectors.file_stream(spark, landing, ENVELOPE, 1)
        return ingest_stream.ingest(stream, root, checkpoint).awaitTermination(120)

    try:
        land(spark, landing, [(v, "t", 0, i, AT) for i, v in enumerate(texts[0])])
        assert drain()
        done, tried = batches.write_batch, []

        def breaks(df, path, batch, by=("date",)):
            tried.append(path)
            if len(tried) == 2:  # telemetry of the batch is written, its dead letters aren't
                raise OSError("lost")
            done(df, path, batch, by)

        land(spark, landing, [(v, "t", 0, 10 + i, AT) for i, v in enumerate(texts[1])])
        monkeypatch.setattr(ingest_stream, "write_batch", breaks)
        with pytest.raises(Exception, match="lost"):
            drain()
        monkeypatch.setattr(ingest_stream, "write_batch", done)
        land(spark, landing, [(v, "t", 1, 20 + i, AT) for i, v in enumerate(texts[2])])
        assert drain() and drain()
        for _ in range(100):
            if counters.totals().get("received") == 9:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    every = spark.createDataFrame([(v, "t") for part in texts for v in part], "value string, topic string")
    want = counts_of(validate.counters(validate.classify(every)))
    assert {k: n for k, n in counters.totals().items() if k in ingest_stream.REASONS and n} == want and counters.totals()["received"] == 9 == heard[-1]["received"]
    assert counters.totals()["latency_count"] == 2 and counters.totals()["latency_le_10"] == 2 and counters.totals()["latency_le_2"] == 0  # received five seconds later
    assert counts_of(tables.read(spark, f"{root}/counters").groupBy("reason").agg(F.sum("count").alias("count"))) == want
    telemetry, letters = tables.read(spark, f"{root}/telemetry"), tables.read(spark, f"{root}/dead_letters")
    assert sorted(r.vehicle_id for r in telemetry.collect()) == ["1", "1", "7"] and {str(r.date) for r in telemetry.collect()} == {"2026-01-22", "2026-01-23"}
    assert sorted(r.error_message for r in letters.collect()) == ["contract_violation", "corrupt_json", "corrupt_json", "gps_dropout", "runtime_error"]
    assert max(len(r.raw_payload) for r in letters.collect()) == 5000 and {r.received_at for r in letters.collect()} == {AT}


KEYED = "vehicle_id string, date date, event_time_ms long, kafka_offset long"


def keyed(spark, rows):
    return spark.createDataFrame([(v, datetime.date(2026, 1, 1), at, i) for v, at, i in rows], KEYED)


def test_merge_opens_only_batches_that_hold_a_key(spark):
    path, keys, hour = scratch(spark), ["vehicle_id", "date", "event_time_ms"], 3_600_000
    merge = lambda rows, batch: batches.merge_batch(spark, keyed(spark, rows), path, keys, batch)
    for b in range(6):
        assert merge([(f"v{i}", b * hour + i, b * 100 + i) for i in range(20)], b) == []  # new keys: no file of the table is opened
    held = merge([("v3", 2 * hour + 3, 900), ("v3", 2 * hour + 3, 901), ("w", 2 * hour + 3, 902), (None, 1, 903)], 6)
    assert [h.removeprefix(f"{path}/") for h in held] == ["date=2026-01-01/batch=2"]
    rows = tables.read(spark, path)
    assert rows.count() == 121 and sorted(r.kafka_offset for r in rows.where("batch = 6").collect()) == [902]
    again = merge([("v3", 2 * hour + 3, 900), ("v3", 2 * hour + 3, 901), ("w", 2 * hour + 3, 902)], 6)  # as after a failure
    assert again == held and tables.read(spark, path).count() == 121
    assert merge([("w", 2 * hour + 3, 950)], 7) == [f"{path}/date=2026-01-01/batch=6"] and tables.read(spark, path).count() == 121
    assert merge([], 8) == []
    assert batches.retain(spark, path, 0, "2026-01-01") == [] and batches.retain(spark, path, 0, "2026-01-02") == ["2026-01-01"]
    assert merge([("v3", 2 * hour + 3, 1)], 9) == [] and tables.read(spark, path).count() == 1


def test_merge_matches_the_merge_that_reads_a_day(spark):
    one, two, keys = scratch(spark), scratch(spark), ["vehicle_id", "date", "event_time_ms"]
    for b in range(4):
        rows = keyed(spark, [(f"v{(i * 7 + b) % 11}", (i * (b + 1)) % 17 * 1000, b * 1000 + i) for i in range(60)])
        tables.insert_only_merge(spark, rows, one, keys)
        batches.merge_batch(spark, rows, two, keys, b)
    a, b = (sorted((r.vehicle_id, r.event_time_ms, r.kafka_offset) for r in tables.read(spark, p).collect()) for p in (one, two))
    assert a == b and len({x[:2] for x in a}) == len(a)


@pytest.mark.parametrize("lost", [None, "before the list", "half way", "keys"])
def test_batches_are_folded(spark, monkeypatch, lost):
    path, keys, day = scratch(spark), ["vehicle_id", "date", "event_time_ms"], "2026-01-01"
    merge = lambda rows, batch: batches.merge_batch(spark, keyed(spark, rows), path, keys, batch)
    for b in range(5):
        merge([(f"v{i}", b * 1000 + i, b * 100 + i) for i in range(20)], b)
    rows = lambda: sorted((r.vehicle_id, r.event_time_ms, r.kafka_offset) for r in tables.read(spark, path).collect())
    before, finish, drop = rows(), batches._finish_fold, batches.drop
    if lost:

        def breaks(spark, folder):
            if lost == "before the list":
                drop(spark, f"{folder}/_folding/read")
            elif lost == "half way":
                drop(spark, f"{folder}/batch=0")
                tables.move(spark, f"{folder}/_folding/made", f"{folder}/batch=-4")
            else:
                finish(spark, folder)
            raise OSError("lost")

        monkeypatch.setattr(batches, "_finish_fold", breaks)
        with pytest.raises(OSError, match="lost"):
            batches.fold(spark, path, day, 4)
        monkeypatch.setattr(batches, "_finish_fold", finish)
        if lost == "before the list":
            assert merge([("v1", 1, 999)], 4) == [f"{path}/date={day}/batch=0"]  # the keys still lead to the batch that is there
            merge([(f"v{i}", 4000 + i, 400 + i) for i in range(20)], 4)
    assert batches.fold(spark, path, day, 4) == (4 if lost in (None, "before the list") else 0)
    assert rows() == before and sorted(tables.folders(spark, f"{path}/date={day}")) == ["batch=-4", "batch=4"]
    assert {b for s in tables.folders(spark, f"{path}_keys/date={day}") for b in tables.folders(spark, f"{path}_keys/date={day}/{s}")} == {"batch=-4", "batch=4"}
    assert batches.fold(spark, path, day, 4) == 0  # nothing is left to do
    assert merge([("v3", 2003, 999), ("new", 2003, 1000)], 5) == [f"{path}/date={day}/batch=-4"] and len(rows()) == len(before) + 1
    assert batches.fold(spark, path, day, 6) == 3 and len(rows()) == len(before) + 1 and tables.folders(spark, f"{path}/date={day}") == ["batch=-6"]
    assert merge([("v3", 2003, 999), ("new", 2003, 1000)], 6) == [f"{path}/date={day}/batch=-6"]
    assert batches.fold(spark, path, "2030-01-01", 9) == 0


def size(path):
    import pathlib

    return sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_online_features_are_written_by_batch(spark):
    path = scratch(spark)
    row = lambda i, n, at: (f"v{i}", n, at)
    put = lambda rows, batch, now: batches.put_online(spark, spark.createDataFrame(rows, "vehicle_id string, current_delay int, updated_at long"), path, batch, now)
    put([row(i, 0, 1000 + i) for i in range(20_000)], 0, 30_000)
    put([row(5, 1, 40_000)], 1, 40_000)
    put([row(5, 1, 40_000)], 1, 40_000)  # again, as after a failure
    assert size(f"{path}/batch=1") < size(f"{path}/batch=0") / 20  # what a batch writes follows the batch
    now = batches.online(spark, path, 50_000)
    assert now.count() == 20_000 and now.where("vehicle_id = 'v5'").first().current_delay == 1
    put([row(6, 2, 330_000)], 2, 330_000)  # the first batch has expired as a whole
    assert sorted(tables.folders(spark, path)) == ["batch=1", "batch=2"]
    assert sorted(r.vehicle_id for r in batches.online(spark, path, 330_000).collect()) == ["v5", "v6"]
    assert [r.vehicle_id for r in batches.online(spark, path, 341_000).collect()] == ["v6"]  # v5 is not alive any more
    put([], 3, 330_000)
    assert batches.online(spark, scratch(spark), 0) is None


# ---- event time ----

EVENTS = "vehicle_id string, kafka_timestamp timestamp, n int"


def at(seconds):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def drained(spark, make, landing, out, checkpoint):
    query = event_time.to_table(make(connectors.file_stream(spark, landing, EVENTS, 1)), out, checkpoint)
    assert query.awaitTermination(120)
    return query


def test_duplicates_are_known_until_the_watermark_passes(spark):
    landing, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    make = lambda rows: event_time.deduplicated(rows, ["vehicle_id", "n"])
    land(spark, landing, [("a", at(0), 1), ("a", at(1), 1), ("b", at(2), 1), (None, at(2), 1)], EVENTS)
    land(spark, landing, [("a", at(9), 1), ("c", at(9), 1)], EVENTS)
    drained(spark, make, landing, out, checkpoint)
    values = lambda: sorted((r.vehicle_id, r.n) for r in spark.read.parquet(out).collect())
    assert values() == [("a", 1), ("b", 1), ("c", 1)]
    land(spark, landing, [("a", at(9), 1)], EVENTS)  # after a restart the key is known still
    land(spark, landing, [("d", at(100), 1)], EVENTS)
    land(spark, landing, [("d", at(101), 2)], EVENTS)
    query = drained(spark, make, landing, out, checkpoint)
    assert values() == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 2)]
    assert event_time.state_rows(query) <= 2  # the keys of the first minutes are forgotten
    land(spark, landing, [("a", at(5), 1), ("e", at(102), 1)], EVENTS)
    query = drained(spark, make, landing, out, checkpoint)
    assert event_time.late_rows(query) == 1 and values()[-1] == ("e", 1) and len(values()) == 6


def test_windows_close_behind_the_watermark(spark):
    landing, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    # watermarks after the batches: 65, 120, 290; a batch's late rows are told by the watermark of the one before the last
    batch = [[("a", at(61), 1), ("a", at(62), 2), ("b", at(75), 1)], [("c", at(72), 1), ("a", at(130), 3)], [("d", at(70), 1), ("a", at(300), 4)], [("a", at(301), 5), ("late", at(60), 1)]]
    for rows in batch[:2]:
        land(spark, landing, rows, EVENTS)
    drained(spark, event_time.active_vehicles, landing, out, checkpoint)
    for rows in batch[2:]:
        land(spark, landing, rows, EVENTS)
    query = drained(spark, event_time.active_vehicles, landing, out, checkpoint)
    got = {(r.window_start - at(0)).total_seconds(): r.active_vehicles for r in spark.read.parquet(out).collect()}
    on_time = [r for rows in batch for r in rows if r[0] != "late"]
    want = {s: len({v for v, t, _ in on_time if at(s) <= t < at(s + 60)}) for s in range(0, 300, 10)}
    assert got == {s: n for s, n in want.items() if n and s + 60 <= 290} and event_time.late_rows(query) > 0
    assert event_time.state_rows(query) <= 14 and spark.read.parquet(out).count() == len(got)


def test_message_rate(spark):
    landing, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    land(spark, landing, [("a", at(i / 2), i) for i in range(40)], EVENTS)
    land(spark, landing, [("a", at(100), 1)], EVENTS)
    land(spark, landing, [("a", at(200), 1)], EVENTS)
    drained(spark, event_time.message_rate, landing, out, checkpoint)
    assert sorted((r.n, r.per_second) for r in spark.read.parquet(out).collect()) == [(20, 2.0), (20, 2.0)]  # the others are open
