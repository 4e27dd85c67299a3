"""Ingest validation: raw messages to telemetry, or to the dead letters with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import cumulative_histogram, epoch_ms, let

#: Fields of a message with their types; the first three must be there.
FIELDS = {"veh": "bigint", "tst": "string", "tsi": "bigint", "desi": "string", "dir": "string", "oper": "int", "spd": "double", "hdg": "int", "lat": "double", "long": "double", "dl": "int", "drst": "int", "odo": "bigint", "line": "int", "start": "string", "stop": "int", "route": "string"}
REQUIRED = ("veh", "tst", "tsi")
#: Inclusive ranges of telemetry, in the order of checking.
RANGES = {"latitude": (59, 61), "longitude": (23, 26), "speed_ms": (0, 40), "heading": (0, 360), "delay_seconds": (-600, 7200), "door_status": (0, 1), "direction_id": (1, 2)}
#: Bounds in seconds of the ingest latency histogram.
LATENCY_BUCKETS = [0.1, 0.5, 1, 2, 5, 10, 30]
TELEMETRY = ["vehicle_id", "timestamp", "latitude", "longitude", "speed_ms", "heading", "delay_seconds", "door_status", "odometer", "next_stop_id", "route_id", "line_id", "direction_id", "operator_id", "journey_start", "event_time_ms"]
#: JSON texts of a wrapper that counts as missing.
_NOTHING = ("null", "{}", "[]", '""', "0", "0.0", "false")
_WRAPPER = {kind: "struct<" + ", ".join(f"{f}: {kind}" for f in FIELDS) + ">" for kind in ("string", "variant")}
_WHOLE = [f for f, t in FIELDS.items() if t in ("bigint", "int")]
_REAL = [f for f, t in FIELDS.items() if t == "double"]
_TEXT = [f for f, t in FIELDS.items() if t == "string"]


def _whole(p: Column) -> Column:
    """An integer: a number without a fraction, the same as text (blanks around, a sign, single underscores), or a boolean.

    p has a field's text, and itself: its JSON type is only looked at where the text doesn't decide.
    """
    t, kind = p["t"], F.schema_of_variant(p["x"])
    double = t.try_cast("double")
    return F.coalesce(
        t.try_cast("bigint"), F.when(t.isin("true", "false") & (kind == "BOOLEAN"), (t == "true").cast("bigint")),
        F.when(t.rlike(r"^\s*[+-]?\d+(_\d+)*(\.0+)?\s*$"), F.regexp_replace(F.trim(t), r"_|\.0+$", "").try_cast("bigint")), F.when(t.rlike("[eE]") & (kind != "STRING") & (double == F.floor(double)), double.try_cast("bigint")),
    )


def _real(p: Column) -> Column:
    """A number, the same as text, or a boolean."""
    t = p["t"]
    number = F.when(~F.right(F.trim(t), F.lit(1)).isin("d", "f", "D", "F"), t.try_cast("double"))
    return F.coalesce(number, F.when(t.isin("true", "false") & (F.schema_of_variant(p["x"]) == "BOOLEAN"), (t == "true").cast("double")))


def _text(p: Column) -> Column:
    return F.when(F.schema_of_variant(p["x"]) == "STRING", p["t"])


def classify(raw: DataFrame, line: str | None = None) -> DataFrame:
    """Every message with ``reason`` (null if valid), ``error_field`` and the telemetry columns; first failing check wins.

    Numbers may come as text and integers as whole floats or booleans; texts have to be texts.  Integers beyond
    a column's range violate the contract.  A message is parsed once and its wrapper read once.
    """
    groups = {"whole": (_WHOLE, _whole), "real": (_REAL, _real), "text": (_TEXT, _text)}
    place = {f: (name, i) for name, (fields, _) in groups.items() for i, f in enumerate(fields)}

    def wrapper(s: Column) -> dict[str, Column]:
        return {"vp": F.try_variant_get(s["v"], "$.VP", _WRAPPER["variant"]), "said": F.try_variant_get(s["v"], "$.VP", _WRAPPER["string"])}

    def parsed(s: Column) -> dict[str, Column]:
        # one array a kind, so that a field costs a call and no code of its own
        both = lambda f: F.struct(s["said"][f].alias("t"), s["vp"][f].alias("x"))
        return {name: F.transform(F.array(*map(both, fields)), parse) for name, (fields, parse) in groups.items()}

    def typed(s: Column) -> dict[str, Column]:
        return {f: F.get(s[place[f][0]], F.lit(place[f][1])).try_cast(t) for f, t in FIELDS.items()}

    def named(s: Column) -> dict[str, Column]:
        bad = {f: (s[f].isNull() if f in REQUIRED else s[f].isNull() & s["said"][f].isNotNull()) for f in FIELDS}
        odd = s["vp"].isNull() | s["veh"].isNull()  # only then the wrapper itself may be at fault
        ts, way = F.try_to_timestamp(s["tst"]), F.nullif(s["dir"], F.lit(""))
        number = F.regexp_replace(way, "(?<=[0-9])_(?=[0-9])", "").try_cast("int")
        return {
            "no_object": F.when(odd, F.coalesce(~F.schema_of_variant(s["v"]).startswith("OBJECT"), F.lit(True))).otherwise(F.lit(False)),
            "missing": F.when(odd, F.coalesce(F.to_json(F.try_variant_get(s["v"], "$.VP", "variant")).isin(*_NOTHING), F.lit(True))).otherwise(F.lit(False)),
            "wrong": F.coalesce(*[F.when(bad[f], F.lit(f)) for f in FIELDS]), "bad_dir": way.isNotNull() & number.isNull(),
            "vehicle_id": s["veh"].cast("string"), "timestamp": ts, "event_time_ms": epoch_ms(ts), "latitude": s["lat"], "longitude": s["long"], "speed_ms": s["spd"], "heading": s["hdg"], "delay_seconds": s["dl"], "door_status": s["drst"], "odometer": s["odo"],
            "next_stop_id": s["stop"].cast("string"), "route_id": s["route"], "line_id": F.coalesce(F.nullif(s["desi"], F.lit("")), s["line"].cast("string"), F.lit("unknown")),
            "direction_id": F.coalesce(number, F.lit(1)), "operator_id": F.coalesce(s["oper"], F.lit(0)), "journey_start": s["start"],
        }

    def judged(s: Column) -> dict[str, Column]:
        off = F.coalesce(*[F.when(s[c].isNotNull() & ~s[c].between(*b), F.lit(c)) for c, b in RANGES.items()], F.when(s["timestamp"].isNull(), F.lit("timestamp")))
        reason = F.when(s["v"].isNull(), "corrupt_json").when(s["no_object"], "runtime_error").when(s["missing"], "missing_vp_wrapper")
        if line is not None:
            reason = reason.when(s["vp"].isNull(), "runtime_error").when(~s["said"]["desi"].eqNullSafe(F.lit(line)), "filtered")
        reason = reason.when(s["wrong"].isNotNull(), "contract_violation").when(s["lat"].isNull() | s["long"].isNull(), "gps_dropout").when(F.coalesce(s["bad_dir"], F.lit(False)), "runtime_error").when(off.isNotNull(), "contract_violation")
        return {"reason": reason, "off": off}

    found = raw.withColumn("_m", let({"v": F.try_parse_json(F.col("value"))}, wrapper, parsed, typed, named, judged))
    m = F.col("_m")
    return found.select(*raw.columns, *[m[c].alias(c) for c in TELEMETRY], m["reason"].alias("reason"), F.when(m["reason"] == "contract_violation", F.coalesce(m["wrong"], m["off"])).alias("error_field"))


def split(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(telemetry, dead letters); a missing wrapper and a filtered line are counted, not kept."""
    dead = classified.where("reason is not null and reason not in ('missing_vp_wrapper', 'filtered')")
    received = F.col("received_at") if "received_at" in classified.columns else F.current_timestamp()
    letters = dead.select(F.substring("value", 1, 5000).alias("raw_payload"), F.col("reason").alias("error_message"), "error_field", received.alias("received_at"), "topic")
    return classified.where("reason is null").select(*TELEMETRY), letters


def route(classified: DataFrame, root: str) -> None:
    """Appends telemetry and dead letters to their tables; the messages are classified once."""
    kept = classified.persist()
    try:
        good, letters = split(kept)
        good.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(f"{root}/telemetry")
        letters.withColumn("date", F.to_date("received_at")).write.mode("append").partitionBy("date").parquet(f"{root}/dead_letters")
    finally:
        kept.unpersist()


def ingest_latency(rows: DataFrame, received: str = "received_at", event: str = "timestamp") -> DataFrame:
    """Histogram of the seconds from event to receipt, where receipt is later."""
    late = (F.unix_micros(received) - F.unix_micros(event)) / 1e6
    hist = rows.select(late.alias("s")).where("s > 0").agg(cumulative_histogram(F.col("s"), LATENCY_BUCKETS).alias("h"))
    return hist.select(F.explode("h").alias("b")).select(F.col("b.le").cast("string").alias("le"), F.col("b.n").alias("n"))


def counters(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).count()


def conforms(rows: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON values against a declared schema: valid, and the first field in error."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    v = rows.withColumn("v", F.try_parse_json("value"))
    wrong = F.coalesce(*[F.when((F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).isNull()) & ((F.lit(f.name in required)) | F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{f.name}", "variant")) != "VOID", F.lit(False))), F.lit(f.name)) for f in kinds])
    return v.withColumn("error_field", F.when(F.col("v").isNotNull(), wrong)).withColumn("valid", F.col("v").isNotNull() & F.col("error_field").isNull()).drop("v")
