"""Tracks: cleaning, ghost removal, range classification, label ranking, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import geo, tilemath
from skylattice.functions import tracks as T
from skylattice.operators import quadtree
from skylattice.operators.skew import DEFAULT_HOT_ROWS, hot_keys, split_hot_join
from skylattice.operators.timeline import with_previous
from skylattice.session import materialize

SNAPSHOT, POS = "snapshot_id", "feed_pos"


def range_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(C.RANGE_PRESETS), "range_idx int, nm int, outer_km double, tag_budget int"
    )


def clean_tracks(raw: DataFrame, *, show_ground: bool = False) -> DataFrame:
    """Raw feed rows to tracks; rows without a numeric position, and reported ground rows, go.

    Columns of ``raw`` that are not feed fields (snapshot_id, feed_pos, timestamps) pass through.
    """
    grounded = T.is_reported_ground("alt_baro")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    kept = raw.filter(located) if show_ground else raw.filter(located & ~grounded)
    feed_fields = {
        "hex", "flight", "r", "t", "type", "lat", "lon", "alt_geom", "gs", "tas", "ias", "track",
        "true_heading", "mag_heading", "dir", "baro_rate", "geom_rate", "alt_baro", "squawk",
    }
    passed = [c for c in raw.columns if c not in feed_fields]
    return kept.select(
        *passed,
        "hex",
        T.callsign().alias("callsign"),
        T.reg().alias("reg"),
        T.actype().alias("actype"),
        "lat",
        "lon",
        T.nose_heading().alias("nose_deg"),
        T.track_heading().alias("track_deg"),
        T.ground_speed().alias("gs_kt"),
        T.vertical_rate().alias("vs_fpm"),
        T.altitude_ft().alias("alt_ft"),
        T.squawk_code().alias("squawk"),
        T.source_name().alias("source"),
        T.source_tier().alias("tier"),
        grounded.alias("on_ground"),
    )


def airborne_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.filter(~T.is_on_ground())


def source_mix(tracks: DataFrame) -> DataFrame:
    """Tracks per source and tier."""
    return tracks.groupBy("source", "tier").agg(F.count(F.lit(1)).alias("tracks"))


# --- ghosts ---------------------------------------------------------------------------------

_CELL = 4.0  # grid cells are this many match distances wide, so a match disc meets 1.5 per axis on average
_LOWEST_BAND, _HIGHEST_BAND, _UNKNOWN_BAND = -2, 60, 99


def _ghost_cells(tracks: DataFrame, max_m: float, max_alt_ft: float, by: str, pos: str):
    """Both sides of the ghost join with their cell keys; see :func:`ghost_edges`."""
    # A hair wider than the limit so that rounding never separates a pair from its cell.
    reach = max_m / C.M_PER_DEG * (1.0 + 1e-6)
    band_deg = reach * _CELL
    alt_step = max(max_alt_ft, 1.0) * _CELL

    def band_reach(band: Column) -> Column:
        """Widest longitude gap a matching pair can have when one end lies in ``band``; NULL at the poles."""
        edge = F.greatest(F.abs(band), F.abs(band + 1)) * band_deg + reach
        return F.when(edge < 89.0, F.lit(reach) / F.cos(F.radians(edge)))

    def lon_cell(lon: Column, width: Column) -> Column:
        return F.coalesce(F.floor(lon / (width * _CELL)), F.lit(0)).cast("long")

    def alt_band(alt: Column) -> Column:
        level = F.greatest(F.least(F.floor(alt / alt_step), F.lit(_HIGHEST_BAND)), F.lit(_LOWEST_BAND))
        return F.when(alt.isNotNull(), level.cast("int"))

    facts = tracks.select(
        F.col(by).alias("_by"),
        F.col(pos).alias("_pos"),
        F.col("tier").alias("_tier"),
        F.col("lat").alias("_lat"),
        F.col("lon").alias("_lon"),
        F.col("alt_ft").alias("_alt"),
        F.col("track_deg").alias("_track"),
        F.col("gs_kt").alias("_gs"),
        T.normalize_ident("callsign").alias("_call"),
        T.normalize_ident("reg").alias("_reg"),
        ((F.col("callsign") == "") & (F.col("reg") == "")).alias("_anon"),
    )
    described = ["_pos", "_tier", "_lat", "_lon", "_alt", "_track", "_gs", "_call", "_reg"]

    def named(prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in described]

    by_call = F.when(F.col("_call") != "", F.concat(F.lit("c"), F.col("_call")))
    by_reg = F.when(F.col("_reg") != "", F.concat(F.lit("r"), F.col("_reg")))
    anyone = F.lit("*")
    known = F.array_compact(F.array(by_call, by_reg))
    lat, lon, alt = F.col("_lat"), F.col("_lon"), F.col("_alt")

    bands = F.sequence(F.floor((lat - reach) / band_deg), F.floor((lat + reach) / band_deg))
    gap = F.coalesce("_width", F.lit(0.0))
    cells = F.sequence(lon_cell(lon - gap, F.col("_width")), lon_cell(lon + gap, F.col("_width")))
    all_levels = F.sequence(F.lit(_LOWEST_BAND), F.lit(_HIGHEST_BAND))
    levels = F.coalesce(F.sequence(alt_band(alt - max_alt_ft), alt_band(alt + max_alt_ft)), all_levels)
    keys = ["_by", "_band", "_cell", "_level", "_id"]

    low = (
        facts.filter(F.col("_tier") < 3)
        .select("*", F.explode(bands).alias("_band"))
        .select("*", band_reach(F.col("_band")).alias("_width"))
        .select("*", F.explode(cells).alias("_cell"))
        .select("*", F.explode(F.concat(levels, F.array(F.lit(_UNKNOWN_BAND)))).alias("_level"))
        .select("*", F.explode(F.when(F.col("_anon"), F.array(anyone)).otherwise(known)).alias("_id"))
        .select(*keys, *named("low"))
    )
    placed = facts.select("*", F.floor(lat / band_deg).alias("_band")).select(
        "*",
        lon_cell(lon, band_reach(F.col("_band"))).alias("_cell"),
        F.coalesce(alt_band(alt), F.lit(_UNKNOWN_BAND)).alias("_level"),
    )
    high = (
        placed.filter(F.col("_tier") > 0)
        .select("*", F.explode(F.concat(F.array(anyone), known)).alias("_id"))
        .select(*keys, *named("high"))
    )
    return low, high, placed, keys


def ghost_edges(
    tracks: DataFrame,
    *,
    max_m: float = C.GHOST_MAX_M,
    max_alt_ft: float = C.GHOST_MAX_ALT_FT,
    max_track_deg: float = C.GHOST_MAX_TRACK_DEG,
    max_speed_ratio: float = C.GHOST_MAX_SPEED_RATIO,
    by: str = SNAPSHOT,
    pos: str = POS,
    hot_rows: int = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Pairs of one snapshot where the lower-tier track looks like a ghost of the higher-tier one.

    A spatial self-join as an equi-join: the key is (snapshot, latitude band, longitude cell,
    altitude level, identity). The lower-tier side is repeated over the one or two cells per axis
    its match distance reaches; the higher-tier side lies in exactly one. Identity is part of the
    key because a lower-tier track WITH an identity only matches the same callsign or registration;
    only anonymous ones ('*') meet everybody in their cell. Longitude cells get wider towards the
    poles; beyond 89 degrees a band is one cell. Altitudes outside the numbered levels share the
    end levels. Hot keys are cut into blocks.
    """
    low, high, placed, keys = _ghost_cells(tracks, max_m, max_alt_ft, by, pos)
    cell = ["_by", "_band", "_cell", "_level"]
    hot = hot_keys(placed.select(*cell), cell, hot_rows)
    pairs = split_hot_join(low, high, keys, hot=hot, hot_on=cell, left_id="low_pos", right_id="high_pos")

    def field(name: str):
        return F.col("low" + name), F.col("high" + name)

    low_alt, high_alt = field("_alt")
    low_track, high_track = field("_track")
    low_gs, high_gs = field("_gs")
    low_call, high_call = field("_call")
    turn = F.abs(low_track - high_track)
    turn = F.when(turn > 180.0, F.lit(360.0) - turn).otherwise(turn)
    faster = F.greatest(low_gs, high_gs)
    same_call = (low_call != "") & (low_call == high_call)
    # A pair that agrees on callsign AND registration meets under both identities; keep one.
    first_meeting = ~(F.col("_id").startswith("r") & same_call)
    matches = (
        (F.col("low_tier") < F.col("high_tier"))
        & first_meeting
        & (low_alt.isNull() | high_alt.isNull() | (F.abs(low_alt - high_alt) <= max_alt_ft))
        & (~((low_track > 0) & (high_track > 0)) | (turn <= max_track_deg))
        & (~((low_gs > 0) & (high_gs > 0)) | (F.try_divide(F.abs(low_gs - high_gs), faster) <= max_speed_ratio))
        & (geo.approx_dist_m("low_lat", "low_lon", "high_lat", "high_lon") <= max_m)
    )
    return pairs.filter(matches).select(
        F.col("_by").alias(by),
        F.col("low_pos"),
        F.col("high_pos"),
        F.col("low_tier"),
        F.col("high_tier"),
    )


def ghost_drops(edges: DataFrame, *, by: str = SNAPSHOT, mode: str = "feed_order") -> DataFrame:
    """(snapshot, dropped position) decided from the ghost pairs; may repeat a position.

    ``feed_order`` gives the outcome of visiting the pairs (i < j) in feed order, skipping pairs
    with a dropped end and dropping the lower tier. It needs no sequential pass: a track is dropped
    by its FIRST pair with a higher-tier track that is still there at that moment, and only tracks
    of yet higher tiers can have removed that one. So the moment each track goes is known tier by
    tier from the top, with one minimum per track: tier 2 from pairs with tier 3, then tier 1 from
    pairs with 3 and surviving 2, then tier 0.

    ``stratified`` ignores order: dropped if any surviving higher-tier neighbour matches.
    """
    if mode not in ("feed_order", "stratified"):
        raise ValueError(f"unknown mode {mode!r}")
    moment = F.struct(
        F.least("low_pos", "high_pos").alias("first"), F.greatest("low_pos", "high_pos").alias("second")
    )
    edges = edges.select(by, "low_pos", "high_pos", "low_tier", "high_tier", moment.alias("moment"))

    def first_moment(acting: DataFrame) -> DataFrame:
        return acting.groupBy(by, "low_pos", "low_tier").agg(F.min("moment").alias("removed_at"))

    def acting(pairs: DataFrame, removed: DataFrame, tier: int) -> DataFrame:
        """Pairs whose higher-tier end is still there; ``removed`` tells when tracks of ``tier`` go."""
        gone = removed.filter(F.col("low_tier") == tier).select(by, F.col("low_pos").alias("high_pos"), "removed_at")
        still_there = F.col("removed_at").isNull()
        if mode == "feed_order":
            still_there = still_there | (F.col("moment") < F.col("removed_at"))
        return pairs.join(gone, [by, "high_pos"], "left").filter(still_there).drop("removed_at")

    by_top = first_moment(edges.filter(F.col("high_tier") == 3))
    by_upper = first_moment(acting(edges.filter(F.col("high_tier") >= 2), by_top, 2))
    by_lowest = acting(edges.filter(F.col("high_tier") == 1), by_upper, 1)
    return by_upper.select(by, "low_pos").unionByName(by_lowest.select(by, "low_pos"))


def ghost_dedup(
    tracks: DataFrame,
    *,
    by: str = SNAPSHOT,
    pos: str = POS,
    mode: str = "feed_order",
    **limits,
) -> DataFrame:
    """Tracks without ghosts. ``pos`` must be the feed position, unique within ``by``."""
    # The pair list feeds three small aggregates; compute the spatial join once.
    edges = materialize(ghost_edges(tracks, by=by, pos=pos, **limits))
    drops = ghost_drops(edges, by=by, mode=mode).withColumnRenamed("low_pos", pos)
    return tracks.join(drops, [by, pos], "left_anti")


# --- views ----------------------------------------------------------------------------------


def focus_views(focus: DataFrame, ranges: DataFrame) -> DataFrame:
    """Focus points with the preset their ``range_idx`` names."""
    return focus.join(ranges, "range_idx")


def tracks_in_radius(
    tracks: DataFrame, centers: DataFrame, *, scale: float = C.FETCH_SCALE, hot_rows: int | None = None
) -> DataFrame:
    """Each center's tracks within ``outer_km * scale``; centers have slot, lat, lon, outer_km.

    Tracks and centers meet on cells whose size follows the radius (:mod:`quadtree`), and the distance is
    checked on what meets. Adds dx_km, dy_km, dist_km and the center's other columns.
    """
    radius = F.col("outer_km") * scale
    placed = centers.withColumnsRenamed({"lat": "center_lat", "lon": "center_lon"})
    box, touches = quadtree.disc_box("center_lat", "center_lon", radius, C.KM_PER_DEG)
    met = quadtree.meet(tracks, placed, box, touches=touches, hot_rows=hot_rows)
    measured = met.withColumn("_o", geo.offset_km("center_lat", "center_lon", "lat", "lon"))
    return (
        measured.filter(F.col("_o.dist") <= radius)
        .withColumns({"dx_km": F.col("_o.dx"), "dy_km": F.col("_o.dy"), "dist_km": F.col("_o.dist")})
        .drop("_o")
    )


def range_class(near: DataFrame, *, inset_frac: float = 1.0) -> DataFrame:
    """Classify rows of :func:`tracks_in_radius`: inside the ring, a rim dot beyond it, or at the centre."""
    ring = F.col("outer_km") * inset_frac
    return near.withColumn(
        "range_class",
        F.when(F.col("dist_km") <= ring, "inside").when(F.col("dist_km") < 0.01, "centre").otherwise("rim"),
    )


def tag_ranking(
    ranged: DataFrame,
    *,
    budget_col: str = "tag_budget",
    max_budget: int = C.MAX_TAG_BUDGET,
) -> DataFrame:
    """Tracks that get a label per (snapshot, slot, range).

    All emergencies do, outside the budget, with ``tag_rank`` 0. Of the others the best by score
    (then farther first, then feed order) are ranked from 1 to the view's budget. ``max_budget`` (the
    largest preset) lets Spark cut each view to that many rows before the shuffle; a view asking for
    more is an error, never a silent cut. Every emergency is a ranking of its own, so none is cut.
    """
    checked = F.when(F.col(budget_col) <= max_budget, F.col(budget_col)).otherwise(
        F.raise_error(F.lit("tag budget above max_budget")).cast("int")
    )
    eligible = ranged.filter((F.col("range_class") == "inside") & T.tag_eligible()).withColumn(
        "score", T.clarity_score()
    )
    alone = F.when(T.is_emergency(), F.col(POS))
    view = Window.partitionBy(SNAPSHOT, "slot", "range_idx", alone).orderBy(
        F.desc("score"), F.desc("dist_km"), F.col(POS)
    )
    ranked = eligible.withColumn("tag_rank", F.row_number().over(view)).filter(F.col("tag_rank") <= max_budget)
    kept = ranked.filter(T.is_emergency() | (F.col("tag_rank") <= checked))
    return kept.withColumn("tag_rank", F.when(T.is_emergency(), 0).otherwise(F.col("tag_rank")))


def traffic_density(near: DataFrame) -> DataFrame:
    """Tracks per grid cell of each view, over all snapshots; only cells on the raster."""
    binned = near.withColumn("_b", geo.grid_bin("center_lat", "center_lon", "outer_km", "lat", "lon"))
    on_raster = F.col("_b.px").between(0, C.RASTER_SIZE - 1) & F.col("_b.py").between(0, C.RASTER_SIZE - 1)
    return (
        binned.filter(on_raster)
        .groupBy("slot", "range_idx", F.col("_b.px").alias("px"), F.col("_b.py").alias("py"))
        .agg(F.count(F.lit(1)).alias("tracks"))
    )


def tile_transitions(
    points: DataFrame,
    *,
    z: int = C.RENDER_ZOOM,
    key: str,
    ts: str,
    tie: str = POS,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Rows where an entity enters another tile than its previous row's (its first row included)."""
    placed = points.withColumn("z", F.lit(z).cast("tinyint")).withColumns(
        {"x": tilemath.tile_x(z, "lon"), "y": tilemath.tile_y(z, "lat")}
    )
    linked = with_previous(
        placed, keys=[key], order=[ts, tie], values=["x", "y"], ts=ts, chunk_seconds=chunk_seconds, name="_prev"
    )
    moved = (F.col("_prev.x") != F.col("x")) | (F.col("_prev.y") != F.col("y"))
    return linked.filter(F.col("_prev").isNull() | moved).drop("_prev")
