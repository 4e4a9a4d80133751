"""Tile pyramid queries and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from drivercheck.airport_queries import AIRPORT_CTE, built
from drivercheck.track_queries import r6
from drivercheck.views import OCTAGON, cte, table, view
from skylattice import constants as C
from skylattice.functions import geo
from skylattice.operators import airports as A
from skylattice.operators import tilepyramid as P
from skylattice.session import materialize
from skylattice.sources import tile_blobs


def _rings(spark, sf_dir):
    """Closed octagons; the corner list is built inside the row."""
    corners = OCTAGON + OCTAGON[:1]
    points = F.array(
        *[
            F.struct(
                (F.col("mid_lon") + dx * F.col("radius")).alias("lon"), (F.col("mid_lat") + dy * F.col("radius")).alias("lat")
            )
            for dx, dy in corners
        ]
    )
    rings = view(spark, sf_dir, "rings").select("feature_id", "layer", F.lit(0).alias("part"), "area", points.alias("points"))
    return P.filter_by_area(rings)


def _lines(spark, sf_dir):
    """Coast lines, closed as their rings are."""
    return P.rings_to_lines(_rings(spark, sf_dir).filter(F.col("layer") == "land"))


def _features(spark, sf_dir):
    return _rings(spark, sf_dir).unionByName(_lines(spark, sf_dir))


def _summary(shapes):
    """Comparable scalars of every shape: corner count and coordinate sums."""
    def total(axis):
        return F.aggregate(F.col("points")[axis], F.lit(0.0), lambda a, b: a + b)

    return shapes.select(
        "feature_id", "layer", F.col("z").cast("int").alias("z"), "x", "y", "run", F.size("points").alias("n"),
        F.round(total("lon"), 6).alias("lon_sum"), F.round(total("lat"), 6).alias("lat_sum"),
    )


def q_features_to_tiles(spark, sf_dir):
    tiles = P.features_to_tiles(_rings(spark, sf_dir))
    return tiles.select("feature_id", F.col("z").cast("int").alias("z"), "x", "y")


def q_polyline_runs(spark, sf_dir):
    return _summary(P.clip_polylines(_lines(spark, sf_dir)))


def q_clip_polygons(spark, sf_dir):
    return _summary(P.clip_polygons(_rings(spark, sf_dir))).drop("run")


def q_simplified_lines(spark, sf_dir):
    """At tolerances coarse enough to thin the octagons."""
    zooms = {3: 1.5, 5: 0.6, 7: 0.2}
    return _summary(P.simplify(P.clip_polylines(_lines(spark, sf_dir), zooms=zooms), zooms=zooms))


def q_simplified_rings(spark, sf_dir):
    zooms = {3: 1.5, 5: 0.6, 7: 0.2}
    return _summary(P.clip_polygons(_rings(spark, sf_dir), zooms=zooms, simplified=True)).drop("run")


def _placed(spark, sf_dir):
    return P.airport_tiles(built(spark, sf_dir))


def q_tile_sizes(spark, sf_dir):
    sizes = P.tile_sizes(P.build_shapes(_features(spark, sf_dir)), _placed(spark, sf_dir))
    return sizes.withColumn("z", F.col("z").cast("int"))


def q_tile_point_counts(spark, sf_dir):
    return P.pyramid_quality(P.build_shapes(_features(spark, sf_dir)), canary=(7, 20, 37)).withColumn("z", F.col("z").cast("int"))


def q_airport_tiles(spark, sf_dir):
    return (
        _placed(spark, sf_dir)
        .groupBy(F.col("z").cast("int").alias("z"), "x", "y")
        .agg(F.count(F.lit(1)).alias("airports"), F.sum("tier").alias("tier_sum"), F.sum("runway_count").alias("runways"))
    )


#: Small enough for every kind of action to occur.
_CAP = 200


def _capped(spark, sf_dir):
    return P.build_tile_pyramid(_features(spark, sf_dir), built(spark, sf_dir), cap=_CAP)


def q_tile_cap_actions(spark, sf_dir):
    _, tiles = _capped(spark, sf_dir)
    return tiles.withColumn("z", F.col("z").cast("int"))


def q_cap_histogram(spark, sf_dir):
    _, tiles = _capped(spark, sf_dir)
    return P.cap_actions(tiles)


def q_capped_shapes(spark, sf_dir):
    """What stays of every shape."""
    shapes, _ = _capped(spark, sf_dir)
    return _summary(shapes).drop("run")


def _payloads(spark, sf_dir):
    """Capped shapes, and airports with their runways, as tile payloads."""
    shapes, _ = _capped(spark, sf_dir)
    nested = A.nest_runways(built(spark, sf_dir), A.airport_runways(view(spark, sf_dir, "runways")), most=None)
    return materialize(tile_blobs.encode_tiles(shapes, P.airport_tiles(nested)))


def q_tile_payloads(spark, sf_dir):
    return _payloads(spark, sf_dir).select(F.col("z").cast("int").alias("z"), "x", "y", "bytes", "reason")


def _decoded(spark, sf_dir):
    return tile_blobs.decode_tiles(_payloads(spark, sf_dir).filter(F.col("payload").isNotNull()).withColumn("path", F.lit("")))


def q_decoded_tiles(spark, sf_dir):
    """Payloads read back: shapes and points per layer and zoom; an airport's points are its own and its runways' ends."""
    rows = _decoded(spark, sf_dir)
    return rows.groupBy("layer", "z").agg(F.count(F.lit(1)).alias("shapes"), F.sum(F.size("lons")).alias("points"))


def content(decoded):
    """The fixed-point coordinates of each tile's layers, summed up, and the airports' flags."""
    e7 = lambda axis: F.aggregate(axis, F.lit(0).cast("long"), lambda total, v: total + F.rint(v * C.E7).cast("long"))
    rows = decoded.select("z", "x", "y", "layer", "ident", "flags", e7("lons").alias("lon"), e7("lats").alias("lat"))
    return rows.groupBy("z", "x", "y", "layer").agg(
        F.count(F.lit(1)).alias("items"), F.sum("lon").alias("lon_e7"), F.sum("lat").alias("lat_e7"),
        F.coalesce(F.sum("flags"), F.lit(0)).alias("flags"), F.min("ident").alias("first_ident"),
    )


def q_payload_content(spark, sf_dir):
    """Payloads read back."""
    return content(_decoded(spark, sf_dir))


def q_merged_tiles(spark, sf_dir):
    """One row per tile: how many pieces of each layer, rivers among the coast, and their points."""
    water = _rings(spark, sf_dir).filter(F.col("layer") == "water")
    rivers = water.withColumns({"layer": F.lit("coast"), "points": F.slice("points", 1, 5)})
    nested = A.nest_runways(built(spark, sf_dir), A.airport_runways(view(spark, sf_dir, "runways")), most=None)
    # No tile is above this cap, so all shapes stay.
    shapes, _ = P.build_tile_pyramid(_features(spark, sf_dir).unionByName(rivers), nested, cap=1 << 30)
    merged = P.merge_layers(shapes, P.airport_tiles(nested))
    points = lambda layer: F.aggregate(layer, F.lit(0), lambda total, piece: total + F.size(piece))
    return merged.select(
        F.col("z").cast("int").alias("z"), "x", "y", *[F.size(c).alias(c) for c in ("coast", "land", "water", "airports")],
        *[points(c).alias(f"{c}_points") for c in ("coast", "land", "water")],
        F.aggregate("airports", F.lit(0), lambda total, a: total + F.size(a["runways"])).alias("runways"),
    )


def q_pyramid_verdicts(spark, sf_dir):
    """At a bound that the tiles of the small tables miss."""
    quality = P.pyramid_quality(P.build_shapes(_features(spark, sf_dir)), canary=(7, 20, 37))
    return P.pyramid_verdicts(quality, canary=True)


def q_world_overview(spark, sf_dir):
    land, hubs = P.world_overview(_rings(spark, sf_dir).filter(F.col("layer") == "land"), built(spark, sf_dir))
    return _summary(land).select("feature_id", "n", "lon_sum", "lat_sum").unionByName(
        hubs.select(F.lit(-1).cast("long").alias("feature_id"), F.lit(1).alias("n"), F.round("lon", 6).alias("lon_sum"), F.round("lat", 6).alias("lat_sum"))
    )


def _map_views(spark, sf_dir):
    """One view per supplier, spread over the map."""
    number = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        number.alias("view_id"),
        (((number * 7919) % 1301) / 10.0 - 70.0).alias("center_lat"),
        (((number * 104729) % 3301) / 10.0 - 170.0).alias("center_lon"),
        F.lit(120.0).alias("radius_km"),
    )


def q_map_layers_for_view(spark, sf_dir):
    shown = P.map_layers_for_view(_map_views(spark, sf_dir), P.clip_polylines(_lines(spark, sf_dir)))
    return shown.select("view_id", "feature_id", "x", "y", "run", F.size("points").alias("n"))


def q_segments_in_disc(spark, sf_dir):
    shown = P.map_layers_for_view(_map_views(spark, sf_dir), P.clip_polylines(_lines(spark, sf_dir)))
    cut = P.segments_in_disc(shown)
    return cut.select("view_id", "feature_id", "x", "y", "run", "segment", *[r6(F.round(c, 4), c) for c in ("x0_km", "y0_km", "x1_km", "y1_km")])


def q_ring_area(spark, sf_dir):
    return _rings(spark, sf_dir).select("feature_id", r6(geo.ring_signed_area2("points"), "area2"))


QUERIES = {
    "features_to_tiles": q_features_to_tiles,
    "polyline_runs": q_polyline_runs,
    "clip_polygons": q_clip_polygons,
    "simplified_lines": q_simplified_lines,
    "simplified_rings": q_simplified_rings,
    "tile_sizes": q_tile_sizes,
    "tile_point_counts": q_tile_point_counts,
    "airport_tiles": q_airport_tiles,
    "tile_cap_actions": q_tile_cap_actions,
    "cap_histogram": q_cap_histogram,
    "capped_shapes": q_capped_shapes,
    "payload_content": q_payload_content,
    "merged_tiles": q_merged_tiles,
    "pyramid_verdicts": q_pyramid_verdicts,
    "tile_payloads": q_tile_payloads,
    "decoded_tiles": q_decoded_tiles,
    "world_overview": q_world_overview,
    "map_layers_for_view": q_map_layers_for_view,
    "segments_in_disc": q_segments_in_disc,
    "ring_area": q_ring_area,
}


# --- SQL --------------------------------------------------------------------------------------

_ZOOMS = {3: 0.02, 5: 0.005, 7: 0.0005}
_COARSE = {3: 1.5, 5: 0.6, 7: 0.2}


def _candidates(zooms, layers: str) -> str:
    """Corners of the wanted features times their candidate tiles and tile bounds."""
    values = ", ".join(f"({z}, {tol!r}e0)" for z, tol in zooms.items())
    return f"""{cte("vertices")},
corner AS (SELECT * FROM vertices WHERE area >= 0.5e0 AND {layers}),
span AS (
  SELECT feature_id, layer, z, tol, pow(2, z) AS n, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS nn
  FROM corner CROSS JOIN (VALUES {values}) AS t(z, tol) GROUP BY ALL
),
cols AS (SELECT *, unnest(range(CAST(floor((w + 180e0)/(360e0/n)) AS INT), CAST(floor((e + 180e0)/(360e0/n)) AS INT) + 1)) AS x FROM span),
cand AS (SELECT *, unnest(range(CAST(floor((90e0 - nn)/(180e0/n)) AS INT), CAST(floor((90e0 - s)/(180e0/n)) AS INT) + 1)) AS y FROM cols),
box AS (SELECT feature_id, layer, z, tol, x, y, -180e0 + x*360e0/n AS west, -180e0 + (x + 1)*360e0/n AS east,
               90e0 - y*180e0/n AS north, 90e0 - (y + 1)*180e0/n AS south FROM cand)"""


def _half_plane(name: str, source: str, axis: str, limit: str, keep: str) -> str:
    other = "lat" if axis == "lon" else "lon"
    window = "PARTITION BY feature_id, layer, z, x, y ORDER BY i"
    whole = window + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f"""{name}_p AS (
  SELECT *, coalesce(lag({axis}) OVER ({window}), last_value({axis}) OVER ({whole})) AS pu,
            coalesce(lag({other}) OVER ({window}), last_value({other}) OVER ({whole})) AS pv FROM {source}),
{name}_f AS (SELECT *, {axis} {keep} {limit} AS inn, pu {keep} {limit} AS pin FROM {name}_p),
{name} AS (
  SELECT feature_id, layer, z, tol, x, y, west, east, south, north, i*2 AS i,
         pu + ({axis} - pu)*(({limit} - pu)/({axis} - pu)) AS {axis}, pv + ({other} - pv)*(({limit} - pu)/({axis} - pu)) AS {other}
  FROM {name}_f WHERE inn <> pin
  UNION ALL
  SELECT feature_id, layer, z, tol, x, y, west, east, south, north, i*2 + 1, {axis}, {other} FROM {name}_f WHERE inn)"""


def _rings_sql(zooms, layers: str = "true") -> str:
    """``ring_pieces``: the clipped rings as lists."""
    passes = [
        ("west_cut", "start_", "lon", "west", ">="),
        ("east_cut", "west_cut", "lon", "east", "<="),
        ("south_cut", "east_cut", "lat", "south", ">="),
        ("north_cut", "south_cut", "lat", "north", "<="),
    ]
    steps = ",\n".join(_half_plane(*p) for p in passes)
    return f"""{_candidates(zooms, layers)},
start_ AS (SELECT b.*, CAST(v AS BIGINT) AS i, lon, lat FROM box b JOIN corner c ON b.feature_id = c.feature_id AND b.layer = c.layer),
{steps},
ring_pieces AS (
  SELECT feature_id, layer, z, tol, x, y, 0 AS run, list(lon ORDER BY i) AS lons, list(lat ORDER BY i) AS lats, count(*) AS n
  FROM north_cut GROUP BY ALL HAVING count(*) >= 3)"""


def _lines_sql(zooms) -> str:
    """``line_pieces``: the inside runs of closed coast lines as lists."""
    candidates = _candidates(zooms, "layer = 'land'")
    # The ninth vertex is the first one again.
    open_corners = "corner AS (SELECT * FROM vertices WHERE area >= 0.5e0 AND layer = 'land')"
    closing = " UNION ALL SELECT * REPLACE (v + 8 AS v) FROM vertices WHERE area >= 0.5e0 AND layer = 'land' AND v = 0)"
    return f"""{candidates.replace(open_corners, open_corners[:-1] + closing)},
inside AS (
  SELECT b.*, v, lon, lat, v - row_number() OVER (PARTITION BY b.feature_id, z, x, y ORDER BY v) AS island
  FROM box b JOIN corner c ON b.feature_id = c.feature_id
  WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north),
line_pieces AS (
  SELECT feature_id, 'coast' AS layer, z, tol, x, y, min(v) AS run, list(lon ORDER BY v) AS lons, list(lat ORDER BY v) AS lats, count(*) AS n
  FROM inside GROUP BY feature_id, z, tol, x, y, island HAVING count(*) >= 2)"""


def _thin_kept_sql(name: str, source: str) -> str:
    """``{name}_kept``: the corners k that Douglas-Peucker keeps of every shape of ``source``."""
    den = "sqrt(pow(lats[hi] - lats[lo], 2) + pow(lons[hi] - lons[lo], 2))"
    dist = (
        f"CASE WHEN {den} = 0 THEN sqrt(pow(lats[i] - lats[lo], 2) + pow(lons[i] - lons[lo], 2)) ELSE "
        f"abs((lats[hi] - lats[lo])*lons[i] - (lons[hi] - lons[lo])*lats[i] + lons[hi]*lats[lo] - lats[hi]*lons[lo])/{den} END"
    )
    key = "feature_id, layer, z, tol, x, y, run, lons, lats"
    return f"""{name}_seg AS (
  SELECT {key}, CAST(1 AS BIGINT) AS lo, CAST(len(lons) AS BIGINT) AS hi FROM {source}
  UNION ALL
  SELECT {key}, CASE side WHEN 0 THEN lo ELSE lo + list_position(ds, dmax) END, CASE side WHEN 0 THEN lo + list_position(ds, dmax) ELSE hi END
  FROM (SELECT *, list_max(ds) AS dmax FROM (
          SELECT *, list_transform(range(lo + 1, hi), lambda i: {dist}) AS ds FROM {name}_seg WHERE hi - lo >= 2))
  CROSS JOIN (VALUES (0), (1)) AS t(side) WHERE dmax > tol),
{name}_kept AS (SELECT DISTINCT {key}, unnest([lo, hi]) AS k FROM {name}_seg)"""


def _thin_sql(name: str, source: str, least: int) -> str:
    """``name``: shapes of ``source`` after Douglas-Peucker, as summaries."""
    return f"""{_thin_kept_sql(name, source)},
{name} AS (SELECT feature_id, layer, z, x, y, run, count(*) AS n, sum(lons[k]) AS lon_sum, sum(lats[k]) AS lat_sum
           FROM {name}_kept GROUP BY feature_id, layer, z, x, y, run HAVING count(*) >= {least})"""


def _thin_lists_sql(name: str, source: str, least: int) -> str:
    """``name``: shapes of ``source`` after Douglas-Peucker, as lists."""
    return f"""{_thin_kept_sql(name, source)},
{name} AS (SELECT feature_id, layer, z, x, y, run, list(lons[k] ORDER BY k) AS lons, list(lats[k] ORDER BY k) AS lats, count(*) AS n
           FROM {name}_kept GROUP BY feature_id, layer, z, x, y, run HAVING count(*) >= {least})"""


def _round_sql(number: int, tolerances: dict[int, float]) -> str:
    """``r{number}``: the shapes of round ``number`` - 1 at the next tolerance; rings are thinned as closed ones."""
    name, tol = f"r{number}", "CASE z " + " ".join(f"WHEN {z} THEN {t!r}e0" for z, t in tolerances.items()) + " END"
    closed = "layer <> 'coast' AND (lons[1] <> lons[-1] OR lats[1] <> lats[-1])"
    lists = ", ".join(f"CASE WHEN {closed} THEN list_append({c}, {c}[1]) ELSE {c} END AS {c}" for c in ("lons", "lats"))
    wanted = ", ".join(map(str, tolerances))
    return f"""{name}_in AS (SELECT feature_id, layer, z, x, y, run, {tol} AS tol, {lists} FROM r{number - 1} WHERE z IN ({wanted})),
{_thin_kept_sql(name, name + "_in")},
{name}_out AS (SELECT feature_id, layer, z, x, y, run, list(lons[k] ORDER BY k) AS lons, list(lats[k] ORDER BY k) AS lats FROM {name}_kept GROUP BY ALL),
{name} AS (
  SELECT *, len(lons) AS n FROM (
    SELECT feature_id, layer, z, x, y, run, CASE layer WHEN 'coast' THEN lons ELSE lons[1:len(lons) - 1] END AS lons,
           CASE layer WHEN 'coast' THEN lats ELSE lats[1:len(lats) - 1] END AS lats FROM {name}_out)
  WHERE len(lons) >= CASE layer WHEN 'coast' THEN 2 ELSE 3 END)"""


_SUMMARY = "n, round(list_sum(lons), 6)+0e0 AS lon_sum, round(list_sum(lats), 6)+0e0 AS lat_sum"
_THIN_SUMMARY = "n, round(lon_sum, 6)+0e0 AS lon_sum, round(lat_sum, 6)+0e0 AS lat_sum"


def _rename(sql: str, *names: str) -> str:
    for n in names:
        sql = sql.replace(f" {n} ", f" l_{n} ").replace(f"{n} AS (", f"l_{n} AS (", 1)
    return sql


# Lines and rings in one statement: the line CTEs get their own names.
def _both_sql(thin=_thin_sql) -> str:
    lines = _lines_sql(_ZOOMS)[len(cte("vertices")) + 2 :]
    lines = _rename(lines, "corner", "span", "cols", "cand", "box", "inside").replace("FROM cols)", "FROM l_cols)").replace("FROM cand)", "FROM l_cand)").replace("FROM span)", "FROM l_span)")
    return f"{_rings_sql(_ZOOMS)},\n{lines},\n{thin('rings_thin', 'ring_pieces', 3)},\n{thin('lines_thin', 'line_pieces', 2)},\nshapes AS (SELECT * FROM rings_thin UNION ALL SELECT * FROM lines_thin)"


_PLACED = """placed AS (
  SELECT b.*, z, CAST(floor((lon + 180e0)/(360e0/pow(2, z))) AS INT) AS x, CAST(floor((90e0 - lat)/(180e0/pow(2, z))) AS INT) AS y
  FROM built b CROSS JOIN (VALUES (3), (5), (7)) AS t(z))"""

_MAP_VIEWS = """mapview AS (SELECT s_suppkey AS view_id, (s_suppkey*7919) % 1301/10e0 - 70e0 AS clat, (s_suppkey*104729) % 3301/10e0 - 170e0 AS clon FROM supplier),
mv AS (SELECT *, 120e0/111e0 AS dlat, 120e0/(111e0*greatest(0.05e0, cos(radians(clat)))) AS dlon FROM mapview),
shown AS (
  SELECT view_id, clat, clon, p.* FROM line_pieces p JOIN mv ON z = 7
   AND x BETWEEN floor((clon - dlon + 180e0)/2.8125e0) AND floor((clon + dlon + 180e0)/2.8125e0)
   AND y BETWEEN floor((90e0 - clat - dlat)/1.40625e0) AND floor((90e0 - clat + dlat)/1.40625e0))"""



def _rivers_sql() -> str:
    """``rivers_thin``: the first five corners of every lake, as a line."""
    lines = _lines_sql(_ZOOMS)[len(cte("vertices")) + 2 :]
    start, rest = lines.index("span AS ("), "corner AS (SELECT * FROM vertices WHERE area >= 0.5e0 AND layer = 'water' AND v < 5),\n"
    names = ("corner", "span", "cols", "cand", "box", "inside")
    sql = rest + lines[start:]
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 v_{n}", sql)
        sql = re.sub(rf"(^|\n){n} AS \(", rf"\1v_{n} AS (", sql)
    sql = sql.replace("line_pieces AS (", "river_pieces AS (")
    return f"{sql},\n{_thin_lists_sql('rivers_thin', 'river_pieces', 2)}"


def _capped_sql() -> str:
    """``tiles``: every tile's action and bytes; ``stays``: the shapes that stay. One step for each round of tolerances."""
    ladder = P.simplify_rounds()
    steps = [{z: tols[k] for z, tols in ladder.items() if k < len(tols)} for k in range(max(map(len, ladder.values())))]
    tols = ", ".join(f"({z}, {k}, {t!r}e0)" for k, step in enumerate(steps, 1) for z, t in step.items())
    numbers = range(1, len(steps) + 1)
    every = " UNION ALL ".join(f"SELECT {k} AS round, * FROM r{k}" for k in numbers)
    rounds = ",\n".join(_round_sql(k, step) for k, step in zip(numbers, steps, strict=True))
    return f"""{_both_sql(_thin_lists_sql)},
{AIRPORT_CTE},
{_PLACED},
fixed AS (SELECT z, x, y, sum(18 + 16*runway_count) + 14 AS b FROM placed GROUP BY 1, 2, 3),
sections AS (SELECT z, x, y, layer, sum(18 + 8*n) + 14 AS b FROM shapes GROUP BY 1, 2, 3, 4 UNION ALL SELECT z, x, y, 'airports', b FROM fixed),
sizes AS (SELECT z, x, y, 12 + sum(b) AS bytes FROM sections GROUP BY 1, 2, 3),
over AS (SELECT z, x, y, 12 + coalesce(b, 0) AS base FROM sizes LEFT JOIN fixed USING (z, x, y) WHERE bytes > {_CAP}),
r0 AS (SELECT * FROM shapes SEMI JOIN over USING (z, x, y)),
{rounds},
tols(z, round, tol) AS (VALUES {tols}),
every AS ({every}),
sums AS (SELECT z, x, y, round, sum(b) AS b FROM (SELECT z, x, y, round, layer, sum(18 + 8*n) + 14 AS b FROM every GROUP BY ALL) GROUP BY ALL),
tried AS (SELECT o.z, o.x, o.y, t.round, t.tol, base + coalesce(s.b, 0) AS bytes
  FROM over o JOIN tols t USING (z) LEFT JOIN sums s ON s.z = o.z AND s.x = o.x AND s.y = o.y AND s.round = t.round),
fitted AS (SELECT * FROM tried WHERE bytes <= {_CAP} QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY round) = 1),
rest AS (SELECT * FROM over ANTI JOIN fitted USING (z, x, y)),
coarsest AS (SELECT e.*, base FROM every e JOIN rest USING (z, x, y)
  WHERE base <= {_CAP} AND round = (SELECT max(round) FROM tols t WHERE t.z = e.z)),
ranks AS (SELECT *, CASE layer WHEN 'land' THEN 0 WHEN 'coast' THEN 1 ELSE 2 END AS rank FROM coarsest),
opened AS (SELECT *, 18 + 8*n + CASE WHEN lag(rank) OVER w IS DISTINCT FROM rank THEN 14 ELSE 0 END AS b
  FROM ranks WINDOW w AS (PARTITION BY z, x, y ORDER BY rank, n DESC, feature_id DESC, run DESC)),
grown AS (SELECT *, base + sum(b) OVER (PARTITION BY z, x, y ORDER BY rank, n DESC, feature_id DESC, run DESC ROWS UNBOUNDED PRECEDING) AS size FROM opened),
tiles AS (
  SELECT z, x, y, 'ok' AS action, bytes FROM sizes WHERE bytes <= {_CAP}
  UNION ALL SELECT z, x, y, format('simplify:{{:.5f}}', tol), bytes FROM fitted
  UNION ALL SELECT z, x, y, CASE WHEN base > {_CAP} THEN 'oversized' ELSE 'drop' END,
    coalesce((SELECT max(size) FROM grown g WHERE g.z = r.z AND g.x = r.x AND g.y = r.y AND size <= {_CAP}), base) FROM rest r),
stays AS (
  SELECT feature_id, layer, z, x, y, lons, lats, n FROM shapes ANTI JOIN over USING (z, x, y)
  UNION ALL SELECT feature_id, layer, z, x, y, lons, lats, n FROM every SEMI JOIN fitted USING (z, x, y, round)
  UNION ALL SELECT feature_id, layer, z, x, y, lons, lats, n FROM grown WHERE size <= {_CAP})"""


ORACLES = {
    "features_to_tiles": f"WITH {_candidates(_ZOOMS, 'true')} SELECT feature_id, z, x, y FROM box",
    "polyline_runs": f"WITH {_lines_sql(_ZOOMS)} SELECT feature_id, layer, z, x, y, run, {_SUMMARY} FROM line_pieces",
    "clip_polygons": f"WITH {_rings_sql(_ZOOMS)} SELECT feature_id, layer, z, x, y, {_SUMMARY} FROM ring_pieces",
    "simplified_lines": f"""WITH RECURSIVE {_lines_sql(_COARSE)},
{_thin_sql("thinned", "line_pieces", 2)} SELECT feature_id, layer, z, x, y, run, {_THIN_SUMMARY} FROM thinned""",
    "simplified_rings": f"""WITH RECURSIVE {_rings_sql(_COARSE)},
{_thin_sql("thinned", "ring_pieces", 3)} SELECT feature_id, layer, z, x, y, {_THIN_SUMMARY} FROM thinned""",
    "tile_sizes": f"""WITH RECURSIVE {_both_sql()},
{AIRPORT_CTE},
{_PLACED},
entries AS (SELECT z, x, y, layer, 18 + 8*n AS b FROM shapes UNION ALL SELECT z, x, y, 'airports', 18 + 16*runway_count FROM placed),
sections AS (SELECT z, x, y, layer, sum(b) + 14 AS b, count(*) AS n FROM entries GROUP BY 1, 2, 3, 4)
SELECT z, x, y, CAST(12 + sum(b) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS items FROM sections GROUP BY 1, 2, 3""",
    "tile_cap_actions": f"WITH RECURSIVE {_capped_sql()} SELECT z, x, y, action, CAST(bytes AS BIGINT) AS bytes FROM tiles",
    "cap_histogram": f"""WITH RECURSIVE {_capped_sql()}
SELECT string_split(action, ':')[1] AS action, count(*) AS tiles, CAST(sum(bytes) AS BIGINT) AS bytes FROM tiles GROUP BY 1""",
    "capped_shapes": f"WITH RECURSIVE {_capped_sql()} SELECT feature_id, layer, z, x, y, {_SUMMARY} FROM stays",
    "tile_payloads": f"""WITH RECURSIVE {_capped_sql()},
entries AS (SELECT z, x, y, layer, 18 + 8*n AS b FROM stays UNION ALL SELECT z, x, y, 'airports', 18 + 16*runway_count FROM placed),
filled AS (SELECT z, x, y, layer, sum(b) + 14 AS b FROM entries GROUP BY 1, 2, 3, 4)
SELECT z, x, y, CAST(12 + sum(b) AS INT) AS bytes, CAST(NULL AS VARCHAR) AS reason FROM filled GROUP BY 1, 2, 3""",
    "decoded_tiles": f"""WITH RECURSIVE {_capped_sql()},
entries AS (SELECT z, layer, n FROM stays UNION ALL SELECT z, 'airports', 1 + 2*runway_count FROM placed)
SELECT layer, z, count(*) AS shapes, CAST(sum(n) AS BIGINT) AS points FROM entries GROUP BY 1, 2""",
    "payload_content": f"""WITH RECURSIVE {_capped_sql()},
ends AS (SELECT ident, CAST(sum(round_even(lon1*1e7, 0) + round_even(lon2*1e7, 0)) AS BIGINT) AS lon, CAST(sum(round_even(lat1*1e7, 0) + round_even(lat2*1e7, 0)) AS BIGINT) AS lat
  FROM strips GROUP BY ident),
entries AS (
  SELECT z, x, y, layer, list_sum(list_transform(lons, lambda v: CAST(round_even(v*1e7, 0) AS BIGINT))) AS lon,
         list_sum(list_transform(lats, lambda v: CAST(round_even(v*1e7, 0) AS BIGINT))) AS lat, 0 AS flags, CAST(NULL AS VARCHAR) AS ident FROM stays
  UNION ALL
  SELECT z, x, y, 'airports', CAST(round_even(p.lon*1e7, 0) AS BIGINT) + coalesce(e.lon, 0), CAST(round_even(p.lat*1e7, 0) AS BIGINT) + coalesce(e.lat, 0),
         tier + CASE WHEN approach THEN 4 ELSE 0 END + CASE WHEN runway_count > 0 THEN 8 ELSE 0 END, p.ident FROM placed p LEFT JOIN ends e ON e.ident = p.ident)
SELECT z, x, y, layer, count(*) AS items, CAST(sum(lon) AS BIGINT) AS lon_e7, CAST(sum(lat) AS BIGINT) AS lat_e7, CAST(sum(flags) AS BIGINT) AS flags,
       min(ident) AS first_ident FROM entries GROUP BY 1, 2, 3, 4""",
    "merged_tiles": f"""WITH RECURSIVE {_both_sql(_thin_lists_sql)},
{_rivers_sql()},
{AIRPORT_CTE},
{_PLACED},
entries AS (
  SELECT z, x, y, layer, n, 0 AS r FROM shapes UNION ALL SELECT z, x, y, 'coast', n, 0 FROM rivers_thin
  UNION ALL SELECT z, x, y, 'airports', 0, runway_count FROM placed)
SELECT z, x, y, CAST(count(*) FILTER (layer = 'coast') AS INT) AS coast, CAST(count(*) FILTER (layer = 'land') AS INT) AS land,
       CAST(count(*) FILTER (layer = 'water') AS INT) AS water, CAST(count(*) FILTER (layer = 'airports') AS INT) AS airports,
       CAST(coalesce(sum(n) FILTER (layer = 'coast'), 0) AS INT) AS coast_points, CAST(coalesce(sum(n) FILTER (layer = 'land'), 0) AS INT) AS land_points,
       CAST(coalesce(sum(n) FILTER (layer = 'water'), 0) AS INT) AS water_points, CAST(sum(r) AS INT) AS runways FROM entries GROUP BY 1, 2, 3""",
    "pyramid_verdicts": f"""WITH RECURSIVE {_both_sql()},
q AS (SELECT z, count(DISTINCT (x, y)) AS tiles, sum(n) AS points, max(CASE WHEN z = 7 AND x = 20 AND y = 37 THEN 1 ELSE 0 END) AS canary FROM shapes GROUP BY 1),
f AS (SELECT *, lead(points) OVER (ORDER BY z) AS finer FROM q)
SELECT 'enough tiles' AS verdict, sum(tiles) >= 3000 AS passed FROM f
UNION ALL SELECT 'all zooms', count(*) FILTER (z IN (3, 5, 7)) = 3 FROM f
UNION ALL SELECT 'coarser is smaller', bool_and(finer IS NULL OR points < finer) FROM f
UNION ALL SELECT 'canary tile', max(canary) > 0 FROM f""",
    "tile_point_counts": f"""WITH RECURSIVE {_both_sql()}
SELECT z, count(DISTINCT (x, y)) AS tiles, count(*) AS shapes, CAST(sum(n) AS BIGINT) AS points, max(CASE WHEN z = 7 AND x = 20 AND y = 37 THEN 1 ELSE 0 END) AS canary
FROM shapes GROUP BY 1""",
    "airport_tiles": f"""WITH {AIRPORT_CTE},
{_PLACED}
SELECT z, x, y, count(*) AS airports, CAST(sum(tier) AS BIGINT) AS tier_sum, CAST(sum(runway_count) AS BIGINT) AS runways FROM placed GROUP BY 1, 2, 3""",
    "world_overview": f"""WITH RECURSIVE {_rings_sql({0: 1.0}, "layer = 'land'")},
{_thin_sql("thinned", "ring_pieces", 3)},
{AIRPORT_CTE},
hubs AS (SELECT * FROM built WHERE tier >= 3 ORDER BY tier DESC, ident LIMIT 150)
SELECT feature_id, {_THIN_SUMMARY} FROM thinned
UNION ALL SELECT -1, 1, round(lon, 6)+0e0, round(lat, 6)+0e0 FROM hubs""",
    "map_layers_for_view": f"""WITH {_lines_sql(_ZOOMS)},
{_MAP_VIEWS}
SELECT view_id, feature_id, x, y, run, n FROM shown""",
    "segments_in_disc": f"""WITH {_lines_sql(_ZOOMS)},
{_MAP_VIEWS},
seg AS (SELECT *, unnest(range(1, len(lons))) AS k FROM shown),
flat AS (
  SELECT view_id, feature_id, x, y, run, k - 1 AS segment, 120e0 AS r,
         (lons[k] - clon)*111e0*cos(radians(clat)) AS x0, (lats[k] - clat)*111e0 AS y0,
         (lons[k+1] - clon)*111e0*cos(radians(clat)) AS x1, (lats[k+1] - clat)*111e0 AS y1 FROM seg),
q AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) AS a, 2*(x0*(x1-x0) + y0*(y1-y0)) AS b, x0*x0 + y0*y0 - r*r AS c,
             x0*x0 + y0*y0 <= r*r AS in0, x1*x1 + y1*y1 <= r*r AS in1 FROM flat),
d AS (SELECT *, b*b - 4*a*c AS disc FROM q),
t AS (SELECT *, CASE WHEN in0 THEN 0e0 ELSE greatest(0e0, (-b - sqrt(greatest(disc, 0e0)))/(2*a)) END AS ta,
                CASE WHEN in1 THEN 1e0 ELSE least(1e0, (-b + sqrt(greatest(disc, 0e0)))/(2*a)) END AS tb FROM d)
SELECT view_id, feature_id, x, y, run, segment,
       round(CASE WHEN in0 AND in1 THEN x0 ELSE x0 + dx*ta END, 4)+0e0 AS x0_km, round(CASE WHEN in0 AND in1 THEN y0 ELSE y0 + dy*ta END, 4)+0e0 AS y0_km,
       round(CASE WHEN in0 AND in1 THEN x1 ELSE x0 + dx*tb END, 4)+0e0 AS x1_km, round(CASE WHEN in0 AND in1 THEN y1 ELSE y0 + dy*tb END, 4)+0e0 AS y1_km
FROM t WHERE (in0 AND in1) OR (a > 0 AND disc >= 0 AND ta <= tb)""",
    "ring_area": f"""WITH {cte("vertices")},
n AS (SELECT *, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2
      FROM vertices WHERE area >= 0.5e0 WINDOW w AS (PARTITION BY feature_id ORDER BY v))
SELECT feature_id, round(sum(lon*lat2 - lon2*lat), 6)+0e0 AS area2 FROM n GROUP BY 1""",
}
