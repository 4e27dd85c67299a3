"""Column functions, all from built-ins, so that Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.config import DEFAULT, Config

EARTH_M = 6_371_000.0
NULL_TOKEN = "_dbt_utils_surrogate_key_null_"  # fixed value: the public package's token


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def kmh(speed_ms: Column) -> Column:
    return speed_ms * 3.6


def local_time(ts: Column, zone: str = DEFAULT.local_zone) -> Column:
    return F.from_utc_timestamp(ts, zone)


def in_helsinki_area(lat: Column, lon: Column) -> Column:
    return lat.between(59.9, 60.5) & lon.between(24.0, 25.5)


def in_geofence(lat: Column, lon: Column) -> Column:
    return lat.between(59.9, 60.4) & lon.between(24.5, 25.2)


def delay_category_gold(delay: Column, c: Config = DEFAULT) -> Column:
    """A null delay is a major delay; an early vehicle is on time."""
    return F.when(delay <= c.on_time_seconds, "on_time").when(delay <= c.late_seconds, "minor_delay").otherwise("major_delay")


def delay_category_mart(delay: Column, c: Config = DEFAULT) -> Column:
    return F.when(delay <= c.on_time_seconds, "ON_TIME").when(delay <= c.late_seconds, "LATE").otherwise("VERY_LATE")


def delay_category_signed(delay: Column, c: Config = DEFAULT) -> Column:
    return F.when(F.abs(delay) <= c.on_time_seconds, "on_time").when(delay > c.late_seconds, "delayed").when(delay < -c.late_seconds, "early").otherwise("slight_delay")


def surrogate_key(*cols: Column) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)) for c in cols]))


def clean_id(c: Column) -> Column:
    return F.trim(c.cast("string"))


def parse_bool(c: Column) -> Column:
    return F.lower(c.cast("string")) == "true"


def four_decimals(c: Column) -> Column:
    return F.format_string("%.4f", c.cast("double"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cumulative_histogram(x: Column, bounds: list[float]) -> Column:
    """Aggregate: array of (le, n), counts cumulative, the last bound infinite."""
    each = [F.struct(F.lit(float(b)).alias("le"), F.count_if(x <= b).alias("n")) for b in bounds]
    return F.array(*each, F.struct(F.lit(float("inf")).alias("le"), F.count(x).alias("n")))


def let(first: dict[str, Column], *steps) -> Column:
    """A struct of the first fields and what each step, from the struct so far, adds.

    Every field is computed once, whatever uses it: a step is bound by a lambda, where projections would be merged into the
    filters above them, once for each use.
    """

    def applied(step):
        def add(s: Column) -> Column:
            out = s
            for name, value in step(s).items():
                out = out.withField(name, value)
            return out

        return add

    one = F.array(F.struct(*[c.alias(n) for n, c in first.items()]))
    for step in steps:
        one = F.transform(one, applied(step))
    return F.element_at(one, 1)
