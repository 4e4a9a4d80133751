"""Equirectangular tile pyramid: 2^z by 2^z tiles, row 0 at the north edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions.geo import col


def tiles_per_side(z) -> Column | float:
    """2^z; a plain number for a plain zoom, which keeps expressions small."""
    return float(1 << z) if isinstance(z, int) else F.pow(F.lit(2.0), col(z))


def _last_index(z) -> Column:
    return F.lit((1 << z) - 1) if isinstance(z, int) else tiles_per_side(z).cast("long") - 1


def _span(degrees: float, z) -> Column | float:
    n = tiles_per_side(z)
    return degrees / n if isinstance(z, int) else F.lit(degrees) / n


def _clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, col(high)), col(low))


def _column_at(z, lon: Column) -> Column:
    return _clamp(F.floor((lon + 180.0) / _span(360.0, z)), F.lit(0), _last_index(z)).cast("int")


def _row_at(z, lat: Column) -> Column:
    return _clamp(F.floor((F.lit(90.0) - lat) / _span(180.0, z)), F.lit(0), _last_index(z)).cast("int")


def tile_x(z, lon) -> Column:
    """Tile column of a longitude; longitudes wrap at the antimeridian."""
    return _column_at(z, F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0)


def tile_y(z, lat) -> Column:
    """Tile row of a latitude; the poles belong to the edge rows."""
    return _row_at(z, _clamp(col(lat), F.lit(-90.0 + 1e-9), F.lit(90.0 - 1e-9)))


def tile_of(z, lat, lon) -> Column:
    return F.struct(tile_x(z, lon).alias("x"), tile_y(z, lat).alias("y"))


def tile_bounds(z, x, y) -> Column:
    """struct(min_lat, min_lon, max_lat, max_lon); a key outside the pyramid is an error."""
    n = tiles_per_side(z)
    x, y = col(x), col(y)
    west = x * _span(360.0, z) - 180.0
    north = F.lit(90.0) - y * _span(180.0, z)
    inside = (x >= 0) & (y >= 0) & (x < n) & (y < n) & (col(z) >= 0)
    box = F.struct(
        (north - _span(180.0, z)).alias("min_lat"),
        west.alias("min_lon"),
        north.alias("max_lat"),
        (west + _span(360.0, z)).alias("max_lon"),
    )
    return F.when(inside, box).otherwise(
        F.raise_error(F.format_string("tile (%s, %s, %s) is outside the pyramid", col(z), x, y))
    )


def column_span(z, min_lon, max_lon) -> Column:
    """array<int> of tile columns a longitude interval touches (clamped, no wrap)."""
    return F.sequence(_column_at(z, col(min_lon)), _column_at(z, F.least(col(max_lon), F.lit(180.0 - 1e-9))))


def row_span(z, min_lat, max_lat) -> Column:
    return F.sequence(_row_at(z, col(max_lat)), _row_at(z, col(min_lat)))


def disc_columns(z, lat, lon, radius_km) -> Column:
    """array<int> of tile columns under a disc, split in two where it crosses the antimeridian."""
    lon = col(lon)
    half = col(radius_km) / (F.greatest(F.cos(F.radians(col(lat))), F.lit(0.05)) * C.KM_PER_DEG)
    west, east = lon - half, lon + half

    def span(low: Column, high: Column) -> Column:
        # A disc so wide that its wrapped part is inverted contributes nothing, as in a plain loop.
        first, last = tile_x(z, low), tile_x(z, F.least(high, F.lit(180.0 - 1e-9)))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(
        F.when(west < -180.0, F.concat(span(west + 360.0, F.lit(180.0)), span(F.lit(-180.0), east)))
        .when(east > 180.0, F.concat(span(west, F.lit(180.0)), span(F.lit(-180.0), east - 360.0)))
        .otherwise(span(west, east))
    )


def disc_rows(z, lat, radius_km) -> Column:
    lat, half = col(lat), col(radius_km) / C.KM_PER_DEG
    return F.sequence(
        tile_y(z, F.least(lat + half, F.lit(89.999))), tile_y(z, F.greatest(lat - half, F.lit(-89.999)))
    )


def corner_tiles(z, lat, lon, radius_km) -> Column:
    """Distinct tiles under the four corners of a viewport: array<struct<x,y>>."""
    lat, lon = col(lat), col(lon)
    up = col(radius_km) / C.KM_PER_DEG
    cos_lat = F.cos(F.radians(lat))
    side = F.when(cos_lat > 1.0e-4, col(radius_km) / (cos_lat * C.KM_PER_DEG)).otherwise(F.lit(0.0))
    return F.array_distinct(
        F.array(*[tile_of(z, lat + up * v, lon + side * h) for v in (1, -1) for h in (-1, 1)])
    )


def deg_to_e7(deg) -> Column:
    """Fixed point: ten-millionths of a degree, halves to even."""
    return F.rint(col(deg) * C.E7).cast("int")


def e7_to_deg(value) -> Column:
    return col(value) / C.E7


def _spread_bits(value: Column) -> Column:
    """A zero bit before each of the low 24 bits."""
    spread = value.cast("long").bitwiseAND(F.lit(0xFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        spread = spread.bitwiseOR(F.shiftleft(spread, shift)).bitwiseAND(F.lit(mask))
    return spread


def place_on_curve(x, y) -> Column:
    """The tile's place on a space-filling curve: the bits of column and row in turn, so near tiles mostly have near places."""
    return _spread_bits(col(x)).bitwiseOR(F.shiftleft(_spread_bits(col(y)), 1))
