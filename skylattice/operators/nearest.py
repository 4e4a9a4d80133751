"""Nearest points for any number of sites, exact over the whole map, without copying the sites.

Points are counted in a pyramid of cells. A cell with more than ``CROWDED`` points is split, so the unsplit cells are
small where points are dense. Every unsplit cell that a site lies in gets a list of the points that can be the
nearest to any place in it:

1. The smallest cell above it that holds a point gives one real candidate, and the candidate's largest
   distance from the cell bounds all others.
2. One lookup in the cells within that distance finds the points that can come closer, and the smallest
   of their largest distances cuts the list.

Which cells sites lie in is known from their half degree squares, of which the map has 259 200; only in split
squares are finer cells looked at. The list of its cell is cut once more for each square, and sites meet
the list of their square, once.

With ``apart`` only points with the site's own value of that number count. Each value has a map of its own: the maps
are stacked, so a cell's row at level n is 2**n times the value plus its row in the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.operators.quadtree import CELL, WORLD, index_at
from skylattice.session import materialize

#: The level of half degree squares, and the finest.
SQUARE, FINEST = 10, 18
CROWDED = 16
#: For ``k`` nearest points a cell with this many times ``k`` is split, and places are told apart this many levels below it.
_ENOUGH, _BELOW = 4, 3

_HALF = WORLD / 2
#: The number of the map that a row belongs to.
_MAP = "_map"
# Expressions as text: a Column is a call into the JVM for each of its parts.
_STEP = f"{WORLD}D / pow(2D, level) AS b_step"
_IN_MAP = "pmod(row, cast(pow(2D, level) as bigint))"
_EDGES = [f"{_IN_MAP} * b_step - {_HALF}D AS b_south", f"({_IN_MAP} + 1) * b_step - {_HALF}D AS b_north", f"col * b_step - {_HALF}D AS b_west", f"(col + 1) * b_step - {_HALF}D AS b_east"]
_SQUEEZE = [
    "greatest(cos(radians(least(greatest(abs(b_south), abs(b_north)), 90D))), 0D) AS b_narrow",
    "if(b_south <= 0 AND b_north >= 0, 1D, greatest(cos(radians(least(abs(b_south), abs(b_north), 90D))), 0D)) AS b_wide",
]
_BOX = ["b_step", "b_south", "b_north", "b_west", "b_east", "b_narrow", "b_wide"]


def _boxed(cells: DataFrame) -> DataFrame:
    """Cells (level, row, col) with their edges, and the least and largest share of a degree of longitude in them."""
    return cells.selectExpr("*", _STEP).selectExpr("*", *_EDGES).selectExpr("*", *_SQUEEZE)


def _least(lat: str, lon: str) -> str:
    """The least distance in nm of a point from the places of a cell, each measured at its own latitude."""
    up, across = f"greatest(b_south - {lat}, {lat} - b_north, 0D)", f"greatest(b_west - {lon}, {lon} - b_east, 0D)"
    return f"hypot({up}, {across} * b_narrow) * {C.NM_PER_DEG * (1 - 1e-9)!r}D"


def _most(lat: str, lon: str) -> str:
    """The largest one."""
    up, across = f"greatest(abs(b_south - {lat}), abs(b_north - {lat}))", f"greatest(abs(b_west - {lon}), abs(b_east - {lon}))"
    return f"hypot({up}, {across} * b_wide) * {C.NM_PER_DEG * (1 + 1e-9)!r}D"


def _levels(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def _cells_at(df: DataFrame, lat: str, lon: str, level: Column) -> DataFrame:
    placed = df.withColumn("_level", level)
    row = index_at(F.col("_level"), F.col(lat)) + F.col(_MAP) * F.pow(F.lit(2.0), F.col("_level")).cast("long")
    return placed.withColumns({"_row": row, "_col": index_at(F.col("_level"), F.col(lon))})


def _ancestors(cells: DataFrame, first: int, last: str) -> DataFrame:
    """Cells (level, row, col) with one row for each cell above them from ``first`` to ``last``, as CELL."""
    up = "cast(floor({0} / pow(2D, level - _level)) as bigint) AS _{0}"
    return cells.selectExpr("*", f"explode(sequence({first}, {last})) AS _level").selectExpr("*", up.format("row"), up.format("col"))


def _unsplit(cells: DataFrame, crowded: DataFrame, first: int, last: int) -> DataFrame:
    """``cells`` (level, row, col) with the level of the unsplit cell they lie in, at most ``last`` + 1."""
    split = _ancestors(cells, first, str(last)).join(crowded, CELL, "left_semi").groupBy("level", "row", "col")
    deepest = split.agg((F.max("_level") + 1).alias("_leaf"))
    return cells.join(deepest, ["level", "row", "col"], "left").withColumn("_leaf", F.coalesce("_leaf", F.lit(first)))


def candidate_lists(leaves: DataFrame, spots: DataFrame, pyramid: DataFrame) -> DataFrame:
    """(level, row, col, near): for cells the points that can be the nearest to a place in them, as (id, lat, lon)."""
    known = _ancestors(leaves, 0, "level").join(pyramid.select(*CELL, "one"), CELL)
    bounded = _boxed(known.groupBy("level", "row", "col").agg(F.max_by("one", "_level").alias("one"))).selectExpr(
        "level", "row", "col", *_BOX, f"{_most('one.lat', 'one.lon')} AS bound"
    )
    # A box around the cell that holds all places within the bound, and cells a third of its longer side or larger.
    reached = bounded.selectExpr("*", f"bound / {C.NM_PER_DEG}D AS up").selectExpr(
        "*", "least(up / greatest(b_narrow, 1e-9D), 720D) AS across"
    )
    rows = "cast(pow(2D, _level) as bigint)"
    side = "greatest(b_north - b_south + 2 * up, b_east - b_west + 2 * across)"
    looking = (
        reached.selectExpr("*", f"cast(greatest(least(floor(log2({3 * WORLD}D / greatest({side}, 1e-9D))), {FINEST}), 0) as int) AS _level")
        .selectExpr("*", f"pow(2D, _level) / {WORLD}D AS per")
        .selectExpr("*", f"greatest(floor((b_south - up + {_HALF}D) * per), 0L) AS lowest", f"least(floor((b_north + up + {_HALF}D) * per), {rows} - 1) AS highest")
        .selectExpr("*", f"cast(floor(row / pow(2D, level)) as bigint) * {rows} AS above")
        .selectExpr("*", "explode(sequence(above + lowest, above + highest)) AS _row")
        .selectExpr("*", f"explode(sequence(floor((b_west - across + {_HALF}D) * per), floor((b_east + across + {_HALF}D) * per))) AS _col")
    )
    listed = _cells_at(spots, "lat", "lon", _levels(0, FINEST))
    met = looking.join(listed, CELL).filter(f"{_least('lat', 'lon')} <= bound")
    gathered = met.groupBy("level", "row", "col").agg(F.collect_list(F.struct("id", "lat", "lon")).alias("near"))
    return _closest(gathered)


def _closest(lists: DataFrame) -> DataFrame:
    """``lists`` (level, row, col, near) with only those points that can be the nearest to a place in the cell."""
    reach = f"transform(near, p -> struct(p AS p, {_least('p.lat', 'p.lon')} AS least, {_most('p.lat', 'p.lon')} AS most))"
    # Exploding one value has it worked out once a row; inside the filter it would be for every point.
    known = _boxed(lists).selectExpr("level", "row", "col", f"explode(array({reach})) AS reach").selectExpr("*", "explode(array(array_min(reach.most))) AS bound")
    return known.selectExpr("level", "row", "col", "transform(filter(reach, r -> r.least <= bound), r -> r.p) AS near")


def near_lists(
    sites: DataFrame, points: DataFrame, *, lat: str = "lat", lon: str = "lon", apart: str | None = None
) -> DataFrame:
    """``sites`` with ``near``, the points (id, lat, lon) one of which is the nearest. Sites without a place go.

    ``apart`` names a number from 0 on that both sides have; sites without a point of their own number go too.
    """
    which = F.lit(0).cast("long") if apart is None else F.col(apart).cast("long")
    sites, points = sites.withColumn(_MAP, which), points.withColumn(_MAP, which)
    spots = materialize(points.groupBy(_MAP, "lat", "lon").agg(F.min("id").alias("id")))
    counted = _cells_at(spots, "lat", "lon", _levels(0, FINEST)).groupBy(*CELL)
    pyramid = materialize(counted.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "lat", "lon")).alias("one")))
    crowded = pyramid.filter(F.col("n") > CROWDED).select(*CELL)

    squares = lambda df: _cells_at(df, lat, lon, F.lit(SQUARE))
    placed = squares(sites.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)))
    flat = lambda df: df.select(*CELL).distinct().toDF("level", "row", "col")
    homes = _unsplit(flat(placed), crowded, 0, SQUARE)
    if deep := bool(crowded.filter(F.col("_level") == SQUARE).head(1)):
        # In crowded squares sites are told apart by their finest cells.
        inner = crowded.filter(F.col("_level") == SQUARE).withColumn("_deep", F.lit(True))
        exact = F.when(F.col("_deep"), F.lit(FINEST)).otherwise(F.lit(SQUARE))
        placed = _cells_at(placed.join(inner, CELL, "left").withColumn("_exact", exact), lat, lon, F.col("_exact")).drop("_exact", "_deep")
        fine = _unsplit(flat(placed.filter(F.col("_level") == FINEST)), crowded, SQUARE, FINEST - 1)
        homes = homes.filter(F.col("_leaf") <= SQUARE).unionByName(fine)
    homes = materialize(homes) if deep else homes
    above = "cast(floor({0} / pow(2D, level - _leaf)) as bigint) AS up_{0}"
    homes = homes.selectExpr("*", above.format("row"), above.format("col"))
    lists = candidate_lists(homes.selectExpr("_leaf AS level", "up_row AS row", "up_col AS col").distinct(), spots, pyramid)
    of_leaf = lists.withColumnsRenamed({"level": "_leaf", "row": "up_row", "col": "up_col"})
    # A square is smaller than the unsplit cell it lies in, so its list is too.
    cut = _closest(homes.join(of_leaf, ["_leaf", "up_row", "up_col"]).select("level", "row", "col", "near"))
    by_home = cut.withColumnsRenamed(dict(zip(("level", "row", "col"), CELL, strict=True)))
    return placed.join(by_home, CELL).drop(*CELL, _MAP)


def nearest(
    sites: DataFrame, points: DataFrame, *, lat: str = "lat", lon: str = "lon", apart: str | None = None
) -> DataFrame:
    """``sites`` with ``_best``: (dist_nm, id, lat, lon) of the nearest point; of equally near ones the smallest id."""
    across = f"(p.lon - `{lon}`) * {C.NM_PER_DEG}D * cos(radians(`{lat}`))"
    up = f"(p.lat - `{lat}`) * {C.NM_PER_DEG}D"
    far = f"array_min(transform(near, p -> struct(sqrt({across} * {across} + {up} * {up}) AS dist_nm, p.id AS id, p.lat AS lat, p.lon AS lon)))"
    return near_lists(sites, points, lat=lat, lon=lon, apart=apart).withColumn("_best", F.expr(far)).drop("near")


def with_reach(sites: DataFrame, points: DataFrame, k: int, *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``sites`` with ``_reach``: so many nm around a site hold ``k`` points or more. NULL where no cell holds enough points.

    The finest cell around a site that has ``_ENOUGH * k`` points is cut into cells ``_BELOW`` levels finer; the k-th
    smallest distance of its points from the middle of the site's own one, and the way there, are the reach. A point
    meets at most ``4**_BELOW`` middles, however many sites there are, and sites meet one row.
    """
    on_map = F.col("lat").between(-_HALF, _HALF) & F.col("lon").between(-_HALF, _HALF)
    listed = points.filter(on_map).select("lat", "lon", _levels(0, FINEST).alias("_level")).withColumns(
        {"_row": index_at(F.col("_level"), F.col("lat")), "_col": index_at(F.col("_level"), F.col("lon"))}
    )
    crowded = materialize(listed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= _ENOUGH * k).select(*CELL))
    deepest = crowded.agg(F.max("_level")).first()[0]
    if deepest is None:
        return sites.withColumn("_reach", F.lit(None).cast("double"))
    fine = deepest + _BELOW
    placed = sites.withColumns({"_fine_row": index_at(fine, F.col(lat)), "_fine_col": index_at(fine, F.col(lon))})
    spot, home = ["_fine_row", "_fine_col"], ["_leaf", "_home_row", "_home_col"]
    up = "shiftright({0}, {1}) AS {2}"
    above = placed.select(*spot).distinct().selectExpr("*", f"explode(sequence(0, {deepest})) AS _level").selectExpr(
        "*", up.format("_fine_row", f"{fine} - _level", "_row"), up.format("_fine_col", f"{fine} - _level", "_col")
    )
    leaves = above.join(crowded, CELL, "left_semi").groupBy(*spot).agg(F.max("_level").alias("_leaf"))
    back = f"{fine - _BELOW} - _leaf"
    homes = materialize(leaves.selectExpr("*", up.format("_fine_row", back, "_home_row"), up.format("_fine_col", back, "_home_col")))
    middles = (
        homes.select(*home).distinct()
        .selectExpr("*", f"{WORLD}D / pow(2D, _leaf + {_BELOW}) AS _wide")
        .selectExpr("*", f"_home_row * _wide - {_HALF}D AS _south", f"(_home_row + 1) * _wide - {_HALF}D AS _north", f"(_home_col + 0.5D) * _wide - {_HALF}D AS _mid_lon")
        .selectExpr(
            *home, "_leaf AS _level", f"shiftright(_home_row, {_BELOW}) AS _row", f"shiftright(_home_col, {_BELOW}) AS _col",
            "(_south + _north) / 2 AS _mid_lat", "_mid_lon",
            # The largest share of a degree of longitude in the cell: distances from the middle are never below a site's own.
            "if((_south <= 0 AND _north >= 0) OR greatest(abs(_south), abs(_north)) > 90, 1D, cos(radians(least(abs(_south), abs(_north))))) AS _squeeze",
        )
    )
    from_middle = lambda a, b: f"{C.NM_PER_DEG * (1 + 1e-9)!r}D * hypot({a} - _mid_lat, ({b} - _mid_lon) * _squeeze)"
    met = middles.join(listed.filter(F.col("_level") <= deepest), CELL).selectExpr(*home, "_mid_lat", "_mid_lon", "_squeeze", f"{from_middle('lat', 'lon')} AS _far")
    nearest_first = met.withColumn("_nth", F.row_number().over(Window.partitionBy(*home).orderBy("_far"))).filter(F.col("_nth") <= k)
    known = homes.join(nearest_first.filter(F.col("_nth") == k).drop("_nth"), home).drop(*home)
    return placed.join(known, spot, "left").selectExpr(
        *[f"`{c}`" for c in sites.columns], f"_far + {from_middle(f'`{lat}`', f'`{lon}`')} AS _reach"
    )
