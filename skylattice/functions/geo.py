"""Geodesy as Column expressions. All angles are degrees; no UDFs."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice import constants as C


def col(value) -> Column:
    """Column names, numbers and Columns alike become Columns."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def ascii_upper(text: Column) -> Column:
    """Upper case of a-z only: codes and callsigns are ASCII, and full case mapping is far slower per row."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance_nm(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance scaled at the FIRST latitude, so argument order is (center, point)."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dlat = (lat2 - lat1) * C.NM_PER_DEG
    dlon = (lon2 - lon1) * C.NM_PER_DEG * F.cos(F.radians(lat1))
    return _length(dlon, dlat)


def approx_dist_m(lat1, lon1, lat2, lon2) -> Column:
    """Mid-latitude equirectangular distance in metres."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    mid = F.radians((lat1 + lat2) * 0.5)
    return _length((lon2 - lon1) * C.M_PER_DEG * F.cos(mid), (lat2 - lat1) * C.M_PER_DEG)


def offset_x_km(center_lat, center_lon, lon) -> Column:
    return (col(lon) - col(center_lon)) * C.KM_PER_DEG * F.cos(F.radians(col(center_lat)))


def offset_y_km(center_lat, lat) -> Column:
    return (col(lat) - col(center_lat)) * C.KM_PER_DEG


def offset_km(center_lat, center_lon, lat, lon) -> Column:
    """struct(dx, dy, dist): kilometres east and north of the centre, and the distance."""
    dx = offset_x_km(center_lat, center_lon, lon)
    dy = offset_y_km(center_lat, lat)
    return F.struct(dx.alias("dx"), dy.alias("dy"), _length(dx, dy).alias("dist"))


def distance_km(center_lat, center_lon, lat, lon) -> Column:
    return _length(offset_x_km(center_lat, center_lon, lon), offset_y_km(center_lat, lat))


def make_bbox(center_lat, center_lon, radius_nm, inflate: float = C.BBOX_INFLATE) -> Column:
    """struct(min_lat, min_lon, max_lat, max_lon); no longitude widening within ~0.6 deg of a pole."""
    lat, lon = col(center_lat), col(center_lon)
    pad = col(radius_nm) * inflate / C.NM_PER_DEG
    cos_lat = F.cos(F.radians(lat))
    pad_lon = F.when(cos_lat > 0.01, pad / cos_lat).otherwise(pad)
    return F.struct(
        (lat - pad).alias("min_lat"),
        (lon - pad_lon).alias("min_lon"),
        (lat + pad).alias("max_lat"),
        (lon + pad_lon).alias("max_lon"),
    )


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle initial bearing in [0, 360)."""
    phi1, phi2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlon = F.radians(col(lon2) - col(lon1))
    east = F.sin(dlon) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def magnetic_declination(lat, lon) -> Column:
    """Bearing to the geomagnetic pole (tilted dipole), signed degrees."""
    phi = F.radians(col(lat))
    dlam = F.radians(F.lit(C.GEOMAGNETIC_POLE_LON) - col(lon))
    north = F.cos(phi) * F.tan(F.radians(F.lit(C.GEOMAGNETIC_POLE_LAT))) - F.sin(phi) * F.cos(dlam)
    return F.degrees(F.atan2(F.sin(dlam), north))


def magnetic_bearing(true_bearing, declination) -> Column:
    return F.pmod(col(true_bearing) - col(declination), F.lit(360.0))


def compass8(bearing) -> Column:
    """Name of the nearest of eight compass points."""
    octant = F.floor(F.pmod(col(bearing), F.lit(360.0)) / 45.0 + 0.5).cast("int") % 8
    return F.element_at(F.array(*[F.lit(p) for p in C.COMPASS_POINTS]), octant + 1)


def predict_position(lat, lon, track_deg, gs_kt, seconds: float = C.PREDICT_SECONDS) -> Column:
    """Dead reckoning along the track: struct(lat, lon). Tracks without speed stay where they are."""
    lat, lon = col(lat), col(lon)
    moved_km = F.greatest(col(gs_kt), F.lit(0.0)) * (C.KM_PER_NM / 3600.0 * seconds)
    heading = F.radians(col(track_deg))
    # Within a hundredth of a degree of a pole a longitude has no useful scale.
    cos_lat = F.greatest(F.cos(F.radians(lat)), F.lit(1.0e-4))
    return F.struct(
        (lat + moved_km * F.cos(heading) / C.KM_PER_DEG).alias("lat"),
        (lon + moved_km * F.sin(heading) / (cos_lat * C.KM_PER_DEG)).alias("lon"),
    )


def grid_bin(center_lat, center_lon, outer_km, lat, lon) -> Column:
    """struct(px, py): cell of the 240x240 density grid whose ring of radius 107 is ``outer_km``."""
    scale = F.lit(float(C.RASTER_RADIUS)) / col(outer_km)
    px = F.lit(C.RASTER_CENTER) + F.round(offset_x_km(center_lat, center_lon, lon) * scale).cast("int")
    py = F.lit(C.RASTER_CENTER) - F.round(offset_y_km(center_lat, lat) * scale).cast("int")
    return F.struct(px.alias("px"), py.alias("py"))


def _disc_crossing(x0, y0, x1, y1, radius):
    x0, y0, x1, y1, radius = map(col, (x0, y0, x1, y1, radius))
    dx, dy = x1 - x0, y1 - y0
    a = dx * dx + dy * dy
    b = (x0 * dx + y0 * dy) * 2.0
    c = x0 * x0 + y0 * y0 - radius * radius
    disc = b * b - a * c * 4.0
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    crosses = (a > 0.0) & (disc >= 0.0)
    twice_a = F.when(a > 0.0, a * 2.0)
    return dx, dy, crosses, (-b - root) / twice_a, (-b + root) / twice_a


def _inside(x, y, radius) -> Column:
    x, y, radius = col(x), col(y), col(radius)
    return x * x + y * y <= radius * radius


def segment_intersects_disc(x0, y0, x1, y1, radius) -> Column:
    """Does the segment touch the disc around the origin?"""
    _, _, crosses, t0, t1 = _disc_crossing(x0, y0, x1, y1, radius)
    on_segment = t0.between(0.0, 1.0) | t1.between(0.0, 1.0)
    return _inside(x0, y0, radius) | _inside(x1, y1, radius) | F.coalesce(crosses & on_segment, F.lit(False))


def clip_segment_to_disc(x0, y0, x1, y1, radius) -> Column:
    """struct(x0, y0, x1, y1) of the part inside the disc around the origin, or NULL."""
    dx, dy, crosses, t0, t1 = _disc_crossing(x0, y0, x1, y1, radius)
    first_in, last_in = _inside(x0, y0, radius), _inside(x1, y1, radius)
    start = F.greatest(F.when(first_in, F.lit(0.0)).otherwise(t0), F.lit(0.0))
    end = F.least(F.when(last_in, F.lit(1.0)).otherwise(t1), F.lit(1.0))
    x0, y0 = col(x0), col(y0)
    whole = F.struct(x0.alias("x0"), y0.alias("y0"), col(x1).alias("x1"), col(y1).alias("y1"))
    part = F.struct(
        (x0 + dx * start).alias("x0"),
        (y0 + dy * start).alias("y0"),
        (x0 + dx * end).alias("x1"),
        (y0 + dy * end).alias("y1"),
    )
    return F.when(first_in & last_in, whole).when(crosses & (start <= end), part)


def polyline_bbox(points) -> Column:
    """Bounding box of an array<struct<lon,lat>>."""
    points = col(points)
    lats, lons = points["lat"], points["lon"]
    return F.struct(
        F.array_min(lats).alias("min_lat"),
        F.array_min(lons).alias("min_lon"),
        F.array_max(lats).alias("max_lat"),
        F.array_max(lons).alias("max_lon"),
    )


def bboxes_overlap(a, b) -> Column:
    """Boxes that only touch overlap too."""
    a, b = col(a), col(b)
    return (
        (a["max_lat"] >= b["min_lat"])
        & (a["min_lat"] <= b["max_lat"])
        & (a["max_lon"] >= b["min_lon"])
        & (a["min_lon"] <= b["max_lon"])
    )


def ring_signed_area2(points) -> Column:
    """Twice the signed area of a ring (positive counter-clockwise), open or closed."""
    points = col(points)
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    products = F.zip_with(points, following, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return F.aggregate(products, F.lit(0.0), lambda total, item: total + item)


def valid_lat_lon(lat, lon) -> Column:
    """Finite and within range; NULL counts as invalid."""
    lat, lon = col(lat), col(lon)
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def valid_view(lat, lon, radius_nm) -> Column:
    return valid_lat_lon(lat, lon) & F.coalesce((col(radius_nm) > 0) & ~F.isnan(col(radius_nm).cast("double")), F.lit(False))
