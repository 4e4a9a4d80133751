"""Column expressions over raw and clean tracks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions.geo import ascii_upper, col


def _first_present(*values, default: float = 0.0) -> Column:
    return F.coalesce(*[col(v) for v in values], F.lit(default))


def nose_heading(true_heading="true_heading", mag_heading="mag_heading", track="track", dir="dir") -> Column:
    return _first_present(true_heading, mag_heading, track, dir)


def track_heading(track="track", true_heading="true_heading", mag_heading="mag_heading", dir="dir") -> Column:
    return _first_present(track, true_heading, mag_heading, dir)


def ground_speed(gs="gs", tas="tas", ias="ias") -> Column:
    return _first_present(gs, tas, ias)


def vertical_rate(baro_rate="baro_rate", geom_rate="geom_rate") -> Column:
    return _first_present(baro_rate, geom_rate)


def is_reported_ground(alt_baro="alt_baro") -> Column:
    """The receiver says so: the altitude field holds the word instead of a number."""
    return F.coalesce(col(alt_baro) == "ground", F.lit(False))


def altitude_ft(alt_baro="alt_baro", alt_geom="alt_geom") -> Column:
    """Feet rounded half away from zero; NULL on the ground or when unknown."""
    number = F.coalesce(col(alt_baro).try_cast("double"), col(alt_geom))
    return F.when(~is_reported_ground(alt_baro), F.round(number).cast("int"))


def squawk_code(squawk="squawk") -> Column:
    return F.coalesce(F.regexp_extract(col(squawk), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))


def _text(value) -> Column:
    return F.trim(F.coalesce(col(value), F.lit("")))


def callsign(flight="flight", registration="r") -> Column:
    """Dispatch callsign, else the registration, else ''. Never the transponder address."""
    return F.coalesce(F.nullif(_text(flight), F.lit("")), _text(registration))


def reg(registration="r") -> Column:
    return _text(registration)


def actype(type_code="t") -> Column:
    return _text(type_code)


def source_tier(source="type") -> Column:
    """Confidence 3 (direct) .. 0 (anything not listed)."""
    source, tier = col(source), F.lit(0)
    for value in sorted(set(C.SOURCE_TIERS.values())):
        names = [name for name, t in C.SOURCE_TIERS.items() if t == value]
        tier = F.when(source.isin(names), F.lit(value)).otherwise(tier)
    return tier.cast("tinyint")


def source_name(source="type") -> Column:
    source = col(source)
    return F.when(source.isin(list(C.KNOWN_SOURCES)), source).otherwise(F.lit("unknown"))


def normalize_ident(ident) -> Column:
    """Identity key: upper case, one leading '~' ignored; '' never matches anything."""
    text = F.coalesce(col(ident), F.lit(""))
    return ascii_upper(F.trim(F.when(text.startswith("~"), F.substr(text, F.lit(2))).otherwise(text)))


def is_on_ground(alt_ft="alt_ft", gs_kt="gs_kt") -> Column:
    """Unknown altitude, or low and slow."""
    alt = col(alt_ft)
    return alt.isNull() | ((alt < C.GROUND_MAX_ALT_FT) & (col(gs_kt) < C.GROUND_MAX_SPEED_KT))


def is_emergency(squawk="squawk") -> Column:
    return col(squawk).isin(list(C.EMERGENCY_SQUAWKS))


def altitude_label(alt_ft="alt_ft") -> Column:
    """Hundreds of feet as three digits, or GND without an altitude."""
    hundreds = F.floor(col(alt_ft) / 100.0 + 0.5).cast("string")
    padded = F.when(F.length(hundreds) >= 3, hundreds).otherwise(F.lpad(hundreds, 3, "0"))
    return F.coalesce(padded, F.lit("GND"))


def trend(alt_ft="alt_ft", vs_fpm="vs_fpm") -> Column:
    rate = col(vs_fpm)
    return (
        F.when(col(alt_ft).isNull(), "unknown")
        .when(rate >= C.TREND_FPM, "climb")
        .when(rate <= -C.TREND_FPM, "descent")
        .otherwise("level")
    )


def clarity_score(alt_ft="alt_ft", gs_kt="gs_kt", vs_fpm="vs_fpm", squawk="squawk", callsign="callsign") -> Column:
    """How interesting a track is: height, speed, climb; emergencies far above; no callsign below all."""
    base = F.coalesce(col(alt_ft), F.lit(0)) + col(gs_kt) * 20.0 + F.abs(col(vs_fpm)) / 5.0
    return (
        F.when(is_emergency(squawk), base + C.EMERGENCY_BONUS)
        .when(col(callsign) == "", F.lit(float("-inf")))
        .otherwise(base)
    )


def tag_eligible(callsign="callsign", actype="actype", alt_ft="alt_ft", squawk="squawk") -> Column:
    """Worth a label: identified or in distress, and with at least something to say."""
    named = col(callsign) != ""
    return (named | is_emergency(squawk)) & (named | (col(actype) != "") | col(alt_ft).isNotNull())
