"""Column expressions over weather reports, readings and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions.geo import ascii_upper, col
from skylattice.functions.timecols import seconds


def parse_visibility(visib="visib") -> Column:
    """Whole statute miles 0..10 by the text's leading integer, else 10.

    JSON numbers are rounded when they are read (:func:`rounded_number`); text is not.
    """
    text = F.trim(col(visib).cast("string"))
    leading = F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("decimal(38,0)")
    parsed = F.coalesce(leading, F.lit(C.MAX_VISIBILITY_SM))
    return F.least(F.greatest(parsed, F.lit(0)), F.lit(C.MAX_VISIBILITY_SM)).cast("int")


def rounded_number(token: Column) -> Column:
    """A JSON value as text: an unquoted number rounded half up, anything else without its quotes."""
    quoted = token.rlike(r'^\s*"')
    number = F.floor(token.try_cast("double") + 0.5).cast("string")
    return F.when(quoted, F.regexp_extract(token, r'(?s)^\s*"(.*)"\s*$', 1)).otherwise(F.coalesce(number, token))


def wind_value(value) -> Column:
    """Integer winds only; 'VRB', fractions and absent values are 0."""
    return F.coalesce(F.regexp_extract(col(value).cast("string"), r"^\s*(-?\d+)\s*$", 1).try_cast("int"), F.lit(0))


def ceiling_ft(clouds="clouds") -> Column:
    """Lowest known base among the ceiling-forming layers of array<struct<cover,base>>; NULL if none."""
    layers = F.filter(col(clouds), lambda layer: ascii_upper(layer["cover"]).isin(list(C.CEILING_COVERS)))
    return F.array_min(F.transform(layers, lambda layer: layer["base"]))


def flight_category(ceiling, visibility) -> Column:
    """Worse of the ceiling and the visibility bucket."""
    ceiling, visibility = col(ceiling), col(visibility)
    by_ceiling = (
        F.when(ceiling < 500, 3).when(ceiling < 1000, 2).when(ceiling <= 3000, 1).otherwise(0)
    )
    by_visibility = (
        F.when(visibility < 1, 3).when(visibility < 3, 2).when(visibility <= 5, 1).otherwise(0)
    )
    worst = F.greatest(by_ceiling, by_visibility)
    return F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]), worst + 1)


def valid_metar(icao="icao", lat="lat", lon="lon") -> Column:
    lat, lon = col(lat), col(lon)
    named = F.coalesce(col(icao) != "", F.lit(False))
    return named & lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def hpa_to_inhg(hpa) -> Column:
    return col(hpa) / C.HPA_PER_INHG


def f_to_c(temp_f) -> Column:
    return (col(temp_f) - 32.0) * 5.0 / 9.0


def c_to_f(temp_c) -> Column:
    return col(temp_c) * 9.0 / 5.0 + 32.0


def wind_going_to_deg(wind_deg_from) -> Column:
    return F.pmod(col(wind_deg_from) + 180.0, F.lit(360.0))


def parse_hhmm(text) -> Column:
    """'H:MM' to the integer HHMM; -1 when it is not a time of day."""
    pattern = r"^[ \t]*(\d{1,2}):(\d{1,2})"
    hours = F.regexp_extract(col(text), pattern, 1).try_cast("int")
    minutes = F.regexp_extract(col(text), pattern, 2).try_cast("int")
    return F.coalesce(F.when((hours <= 23) & (minutes <= 59), hours * 100 + minutes), F.lit(-1))


def valid_hhmm(hhmm) -> Column:
    hhmm = col(hhmm)
    return F.coalesce((hhmm >= 0) & (F.floor(hhmm / 100) <= 23) & (hhmm % 100 <= 59), F.lit(False))


def format_hhmm(hhmm) -> Column:
    hhmm = col(hhmm)
    text = F.format_string("%02d:%02d", F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int"))
    return F.when(valid_hhmm(hhmm), text).otherwise(F.lit(""))


def local_time(ts, utc_offset_sec) -> Column:
    """Wall-clock time of a site from a UTC timestamp and the site's offset."""
    return F.timestamp_add("SECOND", col(utc_offset_sec).cast("int"), col(ts))


def hhmm_of(ts) -> Column:
    return F.hour(col(ts)) * 100 + F.minute(col(ts))


def zulu_label(ts) -> Column:
    return F.concat(F.date_format(col(ts), "HH:mm"), F.lit("Z"))


def in_quiet_hours(local_ts, sleep_hhmm, wake_hhmm, wake_until=None) -> Column:
    """Is the local time inside [sleep, wake)?

    Overnight windows wrap; equal or unset ends never match; a clock before 2024 is not trusted;
    a ``wake_until`` deadline keeps the device awake until it has passed.
    """
    ts, sleep, wake = col(local_ts), col(sleep_hhmm), col(wake_hhmm)
    now = hhmm_of(ts)
    inside = F.when(sleep < wake, (now >= sleep) & (now < wake)).when(sleep > wake, (now >= sleep) | (now < wake))
    usable = valid_hhmm(sleep) & valid_hhmm(wake) & (seconds(ts) >= C.MIN_PLAUSIBLE_EPOCH)
    if wake_until is not None:
        usable = usable & F.coalesce(ts >= col(wake_until), F.lit(True))
    return F.coalesce(usable & inside, F.lit(False))


def freshness_minutes(now, last_success) -> Column:
    """Whole minutes since the last success, never negative; NULL without one."""
    age = seconds(now) - seconds(last_success)
    return F.when(col(last_success).isNotNull(), F.greatest(F.floor(age / 60.0), F.lit(0)).cast("int"))
