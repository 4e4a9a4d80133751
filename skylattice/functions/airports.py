"""Column expressions over airport, runway and navaid rows (all strings, parsed leniently)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions.geo import ascii_upper, col


def clean_ident(value) -> Column:
    return ascii_upper(F.trim(F.coalesce(col(value), F.lit(""))))


def is_h_designator(value) -> Column:
    """'H', 'H' with digits only, or 'H' followed by a dash or underscore."""
    return clean_ident(value).rlike("^H([-_].*|[0-9]*)$")


def is_helipad(le_ident="le_ident", he_ident="he_ident", length_ft="length_ft") -> Column:
    length = F.coalesce(F.trim(col(length_ft).cast("string")).try_cast("int"), F.lit(0))
    low, high = is_h_designator(le_ident), is_h_designator(he_ident)
    return (low & high) | ((low | high) & (length < C.HELIPAD_MAX_FT))


def parse_coord(value, kind: str) -> Column:
    """Degrees within range for ``kind`` 'lat' or 'lon', else NULL (NaN included)."""
    limit = {"lat": 90.0, "lon": 180.0}[kind]
    number = F.trim(col(value).cast("string")).try_cast("double")
    return F.when(number.between(-limit, limit) & ~F.isnan(number), number)


def airport_tier(kind="type") -> Column:
    kind, tier = col(kind), F.lit(0)
    for name, value in C.AIRPORT_TIERS.items():
        tier = F.when(kind == name, F.lit(value)).otherwise(tier)
    return tier


def valid_icao(ident) -> Column:
    return col(ident).rlike("^[A-Za-z0-9]{4}$")


def is_lighted_open(lighted="lighted", closed="closed") -> Column:
    lit_up = F.trim(F.coalesce(col(lighted), F.lit(""))) == "1"
    return lit_up & (F.trim(F.coalesce(col(closed), F.lit(""))) != "1")


def keep_airport(tier, scheduled_service, approach) -> Column:
    """Large and medium fields always; small ones with scheduled service or an approach; nothing else."""
    scheduled = F.lower(F.trim(F.coalesce(col(scheduled_service), F.lit("")))) == "yes"
    return (col(tier) >= 2) | ((col(tier) == 1) & (scheduled | col(approach)))


def keep_index_airport(tier, scheduled_service) -> Column:
    return (col(tier) >= 2) | ((col(tier) == 1) & F.coalesce(col(scheduled_service) == "yes", F.lit(False)))


def airport_flags(tier, approach, has_runways) -> Column:
    """Bits 0-1 tier, bit 2 instrument approach, bit 3 has runways."""
    bits = col(tier).cast("int").bitwiseAND(F.lit(3))
    bits = bits.bitwiseOR(F.when(col(approach), 4).otherwise(0))
    return bits.bitwiseOR(F.when(col(has_runways), 8).otherwise(0))


def flags_tier(flags) -> Column:
    return col(flags).bitwiseAND(F.lit(3))


def flags_approach(flags) -> Column:
    return col(flags).bitwiseAND(F.lit(4)) != 0


def flags_has_runways(flags) -> Column:
    return col(flags).bitwiseAND(F.lit(8)) != 0


def search_score(query, icao="icao", iata="iata", city="city", name="name") -> Column:
    """Exact code 1000, code prefix 500, name prefix 200, code part 100, name part 50, else 0."""
    query = col(query)
    codes = [F.lower(F.coalesce(col(c), F.lit(""))) for c in (icao, iata)]
    names = [F.lower(F.coalesce(col(c), F.lit(""))) for c in (city, name)]

    def either(pair, test) -> Column:
        return test(pair[0]) | test(pair[1])

    return (
        F.when(either(codes, lambda c: c == query), 1000)
        .when(either(codes, lambda c: c.startswith(query)), 500)
        .when(either(names, lambda c: c.startswith(query)), 200)
        .when(either(codes, lambda c: c.contains(query)), 100)
        .when(either(names, lambda c: c.contains(query)), 50)
        .otherwise(0)
    )


def infer_default_range(iata="iata") -> Column:
    """Fields with an airline code start at the 10 nm preset, others at 5 nm."""
    return F.when(F.coalesce(col(iata), F.lit("")) != "", 1).otherwise(0)
