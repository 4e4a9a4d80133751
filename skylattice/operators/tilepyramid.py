"""Map features to a clipped, simplified, size-capped tile pyramid.

Shapes stay flat: one row per piece of a feature in a tile (see ``SHAPE_SCHEMA``). A tile, which
may hold any share of all shapes, is only put together as one row after it has been capped.
Layers are ``coast`` (lines, rivers included), ``land`` and ``water`` (rings).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import geo, tilemath
from skylattice.operators import geometry_kernels as K
from skylattice.operators.airports import top_hubs
from skylattice.operators.skew import fan_out_join
from skylattice.session import materialize, ship_package

TILE = ["z", "x", "y"]
_SHAPE_ID = ["feature_id", "part", "run"]
_LARGEST_TILE_TABLE = 200_000


def filter_by_area(features: DataFrame, *, min_km2: float = C.MIN_AREA_KM2) -> DataFrame:
    """Drop tiny features before any geometry work; the predicate reaches a Parquet scan."""
    return features.filter(F.col("area") >= min_km2)


def rings_to_lines(features: DataFrame) -> DataFrame:
    """Outer rings as coastline features of at least two points."""
    return features.withColumn("layer", F.lit("coast")).filter(F.size("points") >= 2)


def features_to_tiles(features: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES) -> DataFrame:
    """Candidate tiles per feature and zoom, by bounding box: feature_id, layer, part, z, x, y.

    Points are not carried along, so the fan-out costs keys only.
    """
    boxed = features.select(
        "feature_id", "layer", "part", geo.polyline_bbox("points").alias("_b"), F.explode(F.array(*[F.lit(z) for z in zooms])).alias("z")
    )
    columns = tilemath.column_span("z", F.col("_b.min_lon"), F.col("_b.max_lon"))
    rows = tilemath.row_span("z", F.col("_b.min_lat"), F.col("_b.max_lat"))
    return boxed.select("*", F.explode(columns).alias("x")).select(
        "feature_id", "layer", "part", F.col("z").cast("tinyint").alias("z"), "x", F.explode(rows).alias("y")
    )


def _geometry(features: DataFrame) -> DataFrame:
    return features.select("feature_id", "layer", "part", "points")


def clip_polylines(
    lines: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES, simplified: bool = False
) -> DataFrame:
    """Lines to their inside runs per tile, two or more vertices each, optionally simplified. No shuffle."""
    ship_package(lines.sparkSession)
    return _geometry(lines).mapInArrow(K.cutter(K.cut_lines, dict(zooms), 2, simplified), K.SHAPE_SCHEMA)


def clip_polygons(
    rings: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES, simplified: bool = False
) -> DataFrame:
    """Rings cut to the tiles they touch, three or more vertices each, optionally simplified. No shuffle."""
    ship_package(rings.sparkSession)
    return _geometry(rings).mapInArrow(K.cutter(K.cut_rings, dict(zooms), 3, simplified), K.SHAPE_SCHEMA)


def simplify(shapes: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES) -> DataFrame:
    """Douglas-Peucker at the zoom's tolerance; shapes that collapse go."""
    ship_package(shapes.sparkSession)
    return shapes.mapInArrow(K.simplifier(dict(zooms)), K.SHAPE_SCHEMA)


def build_shapes(features: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES) -> DataFrame:
    """Every shape of the pyramid: lines and rings clipped and simplified in one pass over the features."""
    is_line = F.col("layer") == "coast"
    lines = clip_polylines(features.filter(is_line), zooms=zooms, simplified=True)
    return lines.unionByName(clip_polygons(features.filter(~is_line), zooms=zooms, simplified=True))


def airport_tiles(airports: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES) -> DataFrame:
    """Each airport in its one tile per zoom."""
    at_zoom = airports.select("*", F.explode(F.array(*[F.lit(z).cast("tinyint") for z in zooms])).alias("z"))
    return at_zoom.withColumns({"x": tilemath.tile_x("z", "lon"), "y": tilemath.tile_y("z", "lat")})


# --- sizes ----------------------------------------------------------------------------------


def _class_bytes(vertices: Column) -> Column:
    return vertices * C.POINT_BYTES + C.SHAPE_HEAD_BYTES


def _shape_bytes() -> Column:
    return _class_bytes(F.size("points"))


_SECTION_BYTES = C.INDEX_ENTRY_BYTES + C.SECTION_COUNT_BYTES


def _section_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of each key's non-empty sections, without the file header, and their shape count."""
    per_section = rows.groupBy(*keys, "layer").agg(
        F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_n")
    )
    return per_section.groupBy(*keys).agg(
        F.sum(F.col("_bytes") + _SECTION_BYTES).alias("section_bytes"), F.sum("_n").alias("items")
    )


def _shape_rows(shapes: DataFrame) -> DataFrame:
    return shapes.select(*TILE, "layer", _shape_bytes().cast("long").alias("_bytes"))


def _airport_rows(placed_airports: DataFrame) -> DataFrame:
    size = F.col("runway_count") * C.RUNWAY_BYTES + C.AIRPORT_HEAD_BYTES
    return placed_airports.select(*TILE, F.lit("airports").alias("layer"), size.cast("long").alias("_bytes"))


def tile_sizes(shapes: DataFrame, placed_airports: DataFrame) -> DataFrame:
    """Encoded bytes per tile without encoding: one aggregate over the key union of all layers."""
    rows = _shape_rows(shapes).unionByName(_airport_rows(placed_airports))
    return _section_sums(rows, TILE).select(
        *TILE, (F.col("section_bytes") + C.HEADER_BYTES).alias("bytes"), "items"
    )


def _small_tile_table(df: DataFrame, zooms: Mapping[int, float]) -> DataFrame:
    """Broadcast a one-row-per-tile table only where the pyramid itself bounds its size."""
    return F.broadcast(df) if sum(4**z for z in zooms) <= _LARGEST_TILE_TABLE else df


def simplify_rounds(
    zooms: Mapping[int, float] = C.ZOOM_TOLERANCES, max_tol: float = C.MAX_SIMPLIFY_TOL
) -> dict[int, list[float]]:
    """Per zoom the tolerances tried on an oversized tile: double the base, doubled again up to ``max_tol``."""
    rounds = {}
    for z in zooms:
        base = C.ZOOM_TOLERANCES.get(z, 0.001)
        rounds[z] = [t for i in range(1, 64) if (t := base * 2.0**i) <= max_tol]
    return rounds


def cap_tile_size(
    shapes: DataFrame,
    placed_airports: DataFrame,
    *,
    cap: int = C.TILE_CAP_BYTES,
    max_tol: float = C.MAX_SIMPLIFY_TOL,
    zooms: Mapping[int, float] = C.ZOOM_TOLERANCES,
) -> tuple[DataFrame, DataFrame]:
    """(shapes that stay, one row per tile with its action and bytes).

    Tiles above ``cap`` are re-simplified at growing tolerances, the first that fits wins
    (``simplify:<tol>``); else shapes go, fewest vertices first, water before coast before land
    (``drop``); tiles whose airports alone are too large end ``oversized``, without shapes.

    Only oversized tiles are touched, and none is collected: all tolerances are tried row by row in
    one pass that leaves counts only, of shapes by tile, layer, tolerance and vertices. Sizes and what is dropped
    follow from these; shapes are then made once, at their tile's tolerance.
    """
    rounds = simplify_rounds(zooms, max_tol)
    columns = shapes.columns
    # Shapes go through several passes below; the clipping kernel should run once. Sizes are read without the points.
    stored = materialize(shapes.withColumn("_vertices", F.size("points")))
    shapes = stored.select(*columns)
    counted = stored.select(*TILE, "layer", _class_bytes(F.col("_vertices")).cast("long").alias("_bytes"))
    sections = _section_sums(counted.unionByName(_airport_rows(placed_airports)), TILE)
    fixed = _section_sums(_airport_rows(placed_airports), TILE).select(
        *TILE, F.col("section_bytes").alias("_fixed")
    )
    sized = sections.join(fixed, TILE, "left").select(
        *TILE,
        (F.col("section_bytes") + C.HEADER_BYTES).alias("bytes"),
        (F.coalesce("_fixed", F.lit(0)) + C.HEADER_BYTES).alias("_base"),
    )
    sized = materialize(sized)
    fine = sized.filter(F.col("bytes") <= cap).select(*TILE, F.lit("ok").alias("action"), "bytes")
    over = sized.filter(F.col("bytes") > cap).select(*TILE, "_base")
    over_keys = _small_tile_table(over, zooms)

    found = shapes.join(over_keys.select(*TILE), TILE, "left_semi").select(*columns).mapInArrow(K.classifier(rounds), K.CLASS_SCHEMA)
    classes = materialize(found.groupBy(*TILE, "layer", "round", "vertices").agg(F.sum("n").alias("n")))
    of_class = classes.select(*TILE, "round", "layer", (F.col("n") * _class_bytes(F.col("vertices"))).alias("_bytes"))
    sums = _section_sums(of_class, [*TILE, "round"])
    last_round = F.coalesce(
        *[F.when(F.col("z") == z, F.lit(len(tols))) for z, tols in rounds.items()]
    )
    tried = over.filter(last_round > 0).select("*", F.explode(F.sequence(F.lit(1), last_round)).alias("round"))
    tried = tried.join(sums, [*TILE, "round"], "left").withColumn(
        "bytes", F.col("_base") + F.coalesce("section_bytes", F.lit(0))
    )
    fitted = (
        tried.filter(F.col("bytes") <= cap)
        .groupBy(*TILE)
        .agg(F.min_by(F.struct("round", "bytes"), "round").alias("_r"))
        .select(*TILE, F.col("_r.round").alias("round"), F.col("_r.bytes").alias("bytes"))
    )
    tolerance = F.coalesce(
        *[F.when(F.col("z") == z, F.get(F.array(*[F.lit(t) for t in tols]), F.col("round") - 1)) for z, tols in rounds.items() if tols],
        F.lit(0.0),
    )
    fitted = fitted.select(*TILE, "round", F.format_string("simplify:%.5f", tolerance).alias("action"), "bytes")
    fitted = materialize(fitted)

    rest = over.join(fitted, TILE, "left_anti")
    hopeless = rest.filter(F.col("_base") > cap)
    dropping = rest.filter(F.col("_base") <= cap)
    final_round = classes.filter(F.col("round") == last_round)
    limits = materialize(_size_limits(final_round, _small_tile_table(dropping, zooms), cap))
    thinned = lambda rows: rows.mapInArrow(K.coarsener(rounds), rows.schema)
    kept = _keep_largest(shapes.withColumn("round", last_round), _small_tile_table(limits, zooms), cap, thinned)

    keep_columns = [*columns, "action"]
    whole = shapes.join(over_keys.select(*TILE), TILE, "left_anti").withColumn("action", F.lit("ok"))
    fitting = shapes.join(_small_tile_table(fitted.select(*TILE, "round", "action"), zooms), TILE)
    thinner = thinned(fitting.select(*keep_columns, "round", F.lit(0).alias("_least")))
    stays = (
        whole.select(*keep_columns)
        .unionByName(thinner.select(*keep_columns))
        .unionByName(kept.withColumn("action", F.lit("drop")).select(*keep_columns))
    )
    dropped = dropping.join(limits, TILE, "left")
    tiles = (
        fine.unionByName(fitted.select(*TILE, "action", "bytes"))
        .unionByName(dropped.select(*TILE, F.lit("drop").alias("action"), F.coalesce("_size", "_base").alias("bytes")))
        .unionByName(hopeless.select(*TILE, F.lit("oversized").alias("action"), F.col("_base").alias("bytes")))
    )
    return stays, tiles


def _keep_rank() -> Column:
    """Shapes stay in this order: land, coast, water."""
    return F.when(F.col("layer") == "land", 0).when(F.col("layer") == "coast", 1).otherwise(2)


def _size_limits(classes: DataFrame, tiles: DataFrame, cap: int) -> DataFrame:
    """Where each tile's shapes end, in keep order: ``_layer``, ``_points``, ``_room`` and the bytes ``_size`` of what stays.

    Keep order is the reverse of the drop order: land, coast, water; most vertices first; later
    shapes before earlier ones at equal vertex counts. Shapes of one layer and vertex count take equal
    bytes, so the counts of these classes tell, by sums over a tile's few classes, in which of them
    the cap falls, and that ``_room`` shapes of it still fit. Where all shapes fit, ``_layer`` is null.
    """
    classes = (
        classes.join(tiles, TILE)
        .groupBy(*TILE, "_base", _keep_rank().alias("_layer"), F.col("vertices").alias("_points"))
        .agg(F.sum("n").alias("_n"))
    )
    order = Window.partitionBy(*TILE).orderBy("_layer", F.desc("_points"))
    opens = F.coalesce((F.lag("_layer").over(order) != F.col("_layer")).cast("int"), F.lit(1)) * _SECTION_BYTES
    one = _class_bytes(F.col("_points"))
    sized = classes.withColumns({"_one": one, "_opens": opens}).withColumn("_all", F.col("_n") * F.col("_one") + F.col("_opens"))
    sized = sized.withColumn("_upto", F.col("_base") + F.sum("_all").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_upto") - F.col("_all")
    room = F.greatest(F.floor((cap - before - F.col("_opens")) / F.col("_one")), F.lit(0))
    edge = F.struct(
        "_layer", (-F.col("_points")).alias("_less"), room.alias("_room"), (before + F.when(room > 0, room * F.col("_one") + F.col("_opens")).otherwise(0)).alias("_size")
    )
    # The first class that does not fit; its fields say what of it does.
    found = sized.groupBy(*TILE).agg(F.min(F.when(F.col("_upto") > cap, edge)).alias("_edge"), F.max("_upto").alias("_whole"))
    return found.select(
        *TILE,
        F.col("_edge._layer").alias("_layer"),
        (-F.col("_edge._less")).alias("_points"),
        F.col("_edge._room").alias("_room"),
        F.coalesce("_edge._size", "_whole").alias("_size"),
    )


def _keep_largest(shapes: DataFrame, limits: DataFrame, cap: int, thinned: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The shapes before each tile's limit, and as many of the class at the limit as have room.

    Thinning adds no vertices, so shapes with too few of them are not ``thinned`` at all (a kernel that leaves those
    with ``_least`` vertices). Only shapes of the class at the limit are ranked. A shape takes at least 34 bytes, so
    no more than cap / 34 of them can stay, and Spark cuts each tile to that many rows before the shuffle.
    """
    smallest = C.SHAPE_HEAD_BYTES + 2 * C.POINT_BYTES
    placed = shapes.withColumn("_rank", _keep_rank()).join(limits.drop("_size"), TILE)
    same_layer = F.coalesce(F.col("_rank") == F.col("_layer"), F.lit(False))
    enough = F.size("points") >= F.col("_least")
    before = placed.filter(F.col("_layer").isNull() | (F.col("_rank") <= F.col("_layer")))
    whole = thinned(before.withColumn("_least", F.when(same_layer, F.col("_points") + 1).otherwise(0)).filter(enough))
    at_limit = thinned(placed.filter(same_layer).withColumn("_least", F.col("_points")).filter(enough))
    order = Window.partitionBy(*TILE).orderBy(*[F.desc(c) for c in _SHAPE_ID])
    ranked = at_limit.filter(F.size("points") == F.col("_points")).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap // smallest)
    return whole.select(*shapes.columns).unionByName(ranked.filter(F.col("_rn") <= F.col("_room")).select(*shapes.columns))


def cap_actions(tiles: DataFrame) -> DataFrame:
    """How many tiles needed what, and their total bytes."""
    return tiles.groupBy(F.element_at(F.split("action", ":"), 1).alias("action")).agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes")
    )


# --- tiles ----------------------------------------------------------------------------------


def merge_layers(capped: DataFrame, placed_airports: DataFrame) -> DataFrame:
    """Capped shapes and airports (with nested ``runways``) to one row per tile: z, x, y, coast, land, water, airports.

    A key union by tagging, with one shuffle and no outer joins. Give it the shapes that
    :func:`cap_tile_size` kept, so every list is bounded by the cap. Shapes keep feature order; in
    tiles where shapes were dropped they stand smallest first.
    """
    dropped_order = F.when(F.col("action") == "drop", F.size("points")).otherwise(0)
    item = F.struct(
        dropped_order.alias("o"), F.col("feature_id").alias("a"), F.col("part").alias("b"), F.col("run").alias("c"), "points"
    )
    tagged = capped.select(*TILE, "layer", item.alias("shape"))
    airport = F.struct(
        (-F.col("tier")).alias("o"), "ident", "lat", "lon", "tier", "instrument_approach", "runways"
    )
    located = placed_airports.select(*TILE, F.lit("airports").alias("layer"), airport.alias("airport"))
    rows = tagged.unionByName(located, allowMissingColumns=True)

    def pieces(layer: str) -> Column:
        collected = F.sort_array(F.collect_list(F.when(F.col("layer") == layer, F.col("shape"))))
        return F.transform(collected, lambda s: s["points"]).alias(layer)

    airports = F.sort_array(F.collect_list("airport"))
    return rows.groupBy(*TILE).agg(
        pieces("coast"),
        pieces("land"),
        pieces("water"),
        F.transform(airports, lambda a: a.dropFields("o")).alias("airports"),
    )


def build_tile_pyramid(
    features: DataFrame, airports: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES, cap: int = C.TILE_CAP_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Features and airports to (capped shapes, tile table); empty tiles never appear."""
    return cap_tile_size(build_shapes(features, zooms=zooms), airport_tiles(airports, zooms=zooms), cap=cap, zooms=zooms)


def world_overview(
    land: DataFrame, airports: DataFrame, *, tol: float = C.OVERVIEW_TOLERANCE, n: int = C.OVERVIEW_HUBS
) -> tuple[DataFrame, DataFrame]:
    """(land shapes, airports) of the single tile at zoom 0: coarse land and the first ``n`` large airports."""
    zooms = {0: tol}
    return clip_polygons(land, zooms=zooms, simplified=True), airport_tiles(top_hubs(airports, n=n), zooms=zooms)


def pyramid_quality(shapes: DataFrame, *, canary: tuple[int, int, int] | None = None) -> DataFrame:
    """Per zoom: tiles, shapes and points, and whether the canary tile is there."""
    hit = F.lit(False)
    if canary:
        z, x, y = canary
        hit = (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)
    per_tile = shapes.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("_shapes"), F.sum(F.size("points")).alias("_points"), F.max(hit.cast("int")).alias("_hit")
    )
    return per_tile.groupBy("z").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum("_shapes").alias("shapes"),
        F.sum("_points").alias("points"),
        F.max("_hit").alias("canary"),
    )


#: What a whole pyramid has at least.
LEAST_TILES = 3000


def pyramid_verdicts(
    quality: DataFrame, *, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES, least_tiles: int = LEAST_TILES, canary: bool = False
) -> DataFrame:
    """verdict, passed: enough tiles, all zooms, each coarser zoom smaller than the next, and the canary tile if asked for.

    ``quality`` is what :func:`pyramid_quality` gives, a row for each zoom.
    """
    finer = F.lead("points").over(Window.partitionBy(F.lit(0)).orderBy("z"))  # one row for each zoom
    sums = quality.withColumn("_finer", finer).agg(
        F.coalesce(F.sum("tiles"), F.lit(0)).alias("tiles"),
        F.collect_set(F.col("z").cast("int")).alias("zooms"),
        F.coalesce(F.bool_and(F.col("_finer").isNull() | (F.col("points") < F.col("_finer"))), F.lit(False)).alias("smaller"),
        F.coalesce(F.max("canary"), F.lit(0)).alias("canary"),
    )
    asked = F.array(*[F.lit(z) for z in zooms])
    verdicts = {
        "enough tiles": F.col("tiles") >= least_tiles,
        "all zooms": F.size(F.array_except(asked, F.col("zooms"))) == 0,
        "coarser is smaller": F.col("smaller"),
    } | ({"canary tile": F.col("canary") > 0} if canary else {})
    rows = F.array(*[F.struct(F.lit(name).alias("verdict"), passed.alias("passed")) for name, passed in verdicts.items()])
    return sums.select(F.inline(rows))


class PyramidFailed(Exception):
    """A pyramid that must not be published; the message names the verdicts."""


def watched(shapes: DataFrame, zooms: Mapping[int, float] = C.ZOOM_TOLERANCES) -> tuple[DataFrame, Observation]:
    """``shapes``, counted by zoom in whatever pass writes them: n_{z} and points_{z}."""
    seen = Observation("pyramid")
    at = lambda z, value: F.coalesce(F.sum(F.when(F.col("z") == z, value)), F.lit(0))
    metrics = [m for z in zooms for m in (at(z, F.lit(1)).alias(f"n_{z}"), at(z, F.size("points")).alias(f"points_{z}"))]
    return shapes.observe(seen, *metrics), seen


def require_whole(counts: Mapping[str, int], tiles: int, zooms: Mapping[int, float], least_tiles: int) -> None:
    """Fail unless the counts of :func:`watched` and the number of tiles are those of a whole pyramid."""
    points = [counts[f"points_{z}"] for z in sorted(zooms)]
    failed = [
        name
        for name, passed in (
            ("enough tiles", tiles >= least_tiles),
            ("all zooms", all(counts[f"n_{z}"] for z in zooms)),
            ("coarser is smaller", all(a < b for a, b in zip(points, points[1:], strict=False))),
        )
        if not passed
    ]
    if failed:
        raise PyramidFailed(", ".join(failed))


def map_layers_for_view(
    views: DataFrame, shapes: DataFrame, *, zoom: int = C.RENDER_ZOOM, hot_rows: int | None = None
) -> DataFrame:
    """Shapes of all tiles covering each view (view_id, center_lat, center_lon, radius_km).

    The filter on ``z`` prunes partitions of a stored pyramid; tiles that do not exist are just absent.
    """
    columns = tilemath.disc_columns(zoom, "center_lat", "center_lon", "radius_km")
    rows = tilemath.disc_rows(zoom, "center_lat", "radius_km")
    wanted = views.select("*", F.explode(columns).alias("x")).select("*", F.explode(rows).alias("y"))
    return fan_out_join(shapes.filter(F.col("z") == zoom), wanted, ["x", "y"], spread_by=_SHAPE_ID, hot_rows=hot_rows)


def segments_in_disc(shapes_in_view: DataFrame) -> DataFrame:
    """Line segments of the shapes in a view, cut to its disc, as km offsets: one row per visible segment."""
    pairs = F.zip_with(
        F.slice("points", 1, F.size("points") - 1),
        F.slice("points", 2, F.size("points") - 1),
        lambda p, q: F.struct(p.alias("p0"), q.alias("p1")),
    )
    segments = shapes_in_view.filter(F.size("points") >= 2).select(
        "view_id", "center_lat", "center_lon", "radius_km", "layer", *_SHAPE_ID, "x", "y", F.posexplode(pairs).alias("segment", "_s")
    )
    ends = {}
    for end in ("0", "1"):
        point = F.col("_s")["p" + end]
        ends["_x" + end] = geo.offset_x_km("center_lat", "center_lon", point["lon"])
        ends["_y" + end] = geo.offset_y_km("center_lat", point["lat"])
    visible = geo.clip_segment_to_disc("_x0", "_y0", "_x1", "_y1", "radius_km")
    cut = segments.withColumns(ends).select(
        "view_id", "layer", *_SHAPE_ID, "x", "y", "segment", F.inline(F.array_compact(F.array(visible)))
    )
    return cut.withColumnsRenamed({c: c + "_km" for c in ("x0", "y0", "x1", "y1")})
