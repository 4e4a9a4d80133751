"""Joins of points with areas on square cells whose size follows the areas and the points.

Cells at level n are 512 / 2**n degrees wide and counted from -256, so one cell holds the map and those of one
level lie inside those of the level above. An area
is listed under the cells it touches, at the level where its longer side spans four to eight cells; most of what
meets it there is inside it, whatever its size. A point is listed once for every level in use, at most
``LEVELS`` of them.

Large tables are not moved in that many copies. Levels in use are gathered to tiers, and each tier has regions, cells of
several times the width of its widest areas: a point is sent to one region of each tier, an area to the one to three it touches,
and both are listed under their cells there, within a task. Points and cells of areas are counted first. Regions that
hold many are sent as smaller ones, down to the cells of the widest areas; what is still too many, such as points on one
spot, is cut by hash, and its other side repeated for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.skew import listed_side, may_be_hot
from skylattice.session import materialize

WORLD = 512.0
LEVELS = 25
#: A region with more points and cells of areas, as they are listed in it, is refined, and then cut.
HOT_ROWS = 500_000
#: Listed rows to a task on average: what two sorts of them hold in memory.
TASK_ROWS = 250_000
#: Regions for each core at least, so that tasks are of like size.
_REGIONS = 8
#: Regions lie so many levels above the first of the levels gathered in a tier.
_ABOVE, _GATHERED = 3, 6
#: Hot regions up to this many are sent to all tasks; more of them are joined.
_INLINE_CELLS = 10_000
CELL = ["_level", "_row", "_col"]
REGION = ["_tier", "_region", "_row", "_col"]
Box = tuple[Column, Column, Column, Column]


def step(level) -> Column:
    """The width of a cell in degrees."""
    level = level if isinstance(level, Column) else F.lit(level)
    return F.lit(WORLD) / F.pow(F.lit(2.0), level)


def index_at(level, degrees: Column) -> Column:
    return F.floor((degrees + WORLD / 2) / step(level))


def level_for(side: Column, cells: int) -> Column:
    """The finest level where ``side`` degrees span at most ``cells`` cells."""
    fitting = F.floor(F.log2(F.lit(WORLD * cells) / F.greatest(side, F.lit(1e-9))))
    return F.greatest(F.least(fitting, F.lit(LEVELS - 1)), F.lit(0)).cast("int")


def cell_box(level="_level", row="_row", col="_col") -> Box:
    """(min_lat, max_lat, min_lon, max_lon) of a cell."""
    wide = step(F.col(level))
    edge = lambda index, more: (F.col(index) + more) * wide - WORLD / 2
    return edge(row, 0), edge(row, 1), edge(col, 0), edge(col, 1)


def _sized(areas: DataFrame, box: Box, cells: int) -> DataFrame:
    """Areas that have a box, with their ``_level``."""
    south, north, west, east = box
    return areas.filter((north - south).isNotNull() & (east - west).isNotNull()).withColumn(
        "_level", level_for(F.greatest(north - south, east - west), cells)
    )


def _levels(sized: DataFrame) -> list[int]:
    return sorted(r[0] for r in sized.select("_level").distinct().collect())


def _listed(areas: DataFrame, box: Box, level: str, touches: Callable[[Box], Column] | None, within: str | None = None) -> DataFrame:
    """One row per area and cell of ``level`` that ``touches`` accepts; of rows per cell of level ``within``, the cells inside it."""
    south, north, west, east = box

    def span(low: Column, high: Column, index: str) -> Column:
        first, last = index_at(F.col(level), low), index_at(F.col(level), high)
        if within is not None:
            parts = F.pow(F.lit(2.0), F.col(level) - F.col(within)).cast("long")
            first, last = F.greatest(F.col(index) * parts, first), F.least((F.col(index) + 1) * parts - 1, last)
        return F.sequence(first, last)

    kept = [c for c in areas.columns if c not in ("_row", "_col")]
    listed = areas.select(*kept, span(west, east, "_col").alias("_cols"), F.explode(span(south, north, "_row")).alias("_row"))
    listed = listed.select(*kept, "_row", F.explode("_cols").alias("_col"))
    return listed if touches is None else listed.filter(touches(cell_box(level)))


def _each(name: str, values: list[int]) -> Column:
    """A row for each of the values."""
    return (F.lit(values[0]) if len(values) == 1 else F.explode(F.array(*[F.lit(v) for v in values]))).alias(name)


def meet(
    points: DataFrame,
    areas: DataFrame,
    box: Box,
    *,
    lat: str = "lat",
    lon: str = "lon",
    cells: int = 8,
    touches: Callable[[Box], Column] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every pair of a point and an area whose box holds it, among few others. The caller filters exactly.

    ``box`` is made of columns of ``areas``. Points without a place meet nothing. Tables that the planner sizes as
    large, or any with a given ``hot_rows``, meet by regions. Columns ``_level``, ``_row``, ``_col``, ``_cell``, ``_tier``,
    ``_region``, ``_down``, ``_parts``, ``_shares``, ``_cut`` and ``_task`` are taken for the work.
    """
    sized = _sized(areas, box, cells)
    levels = _levels(sized) or [0]
    located = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if hot_rows is not None or may_be_hot(points) or may_be_hot(areas):
        return _meet_by_regions(located, sized, box, levels, lat, lon, touches, hot_rows)
    placed = located.select("*", _each("_level", levels)).withColumns(_place("_level", lat, lon))
    return placed.join(listed_side(_listed(sized, box, "_level", touches)), CELL).drop(*CELL)


def _place(level: str, lat: str, lon: str) -> dict[str, Column]:
    return {"_row": index_at(F.col(level), F.col(lat)), "_col": index_at(F.col(level), F.col(lon))}


def _tiers(levels: list[int]) -> dict[int, list[int]]:
    """The levels in use by the level of the regions that they share."""
    tiers: dict[int, list[int]] = {}
    for level in levels:
        if not tiers or level >= gathered[0] + _GATHERED:
            gathered = tiers.setdefault(max(level - _ABOVE, 0), [])
        gathered.append(level)
    return tiers


def _of_tier(values: Mapping[int, Column]) -> Column:
    tiers = [F.when(F.col("_tier") == tier, value) for tier, value in values.items()]
    return F.coalesce(*tiers) if len(values) > 1 else next(iter(values.values()))


def _meet_by_regions(points: DataFrame, areas: DataFrame, box: Box, levels: list[int], lat: str, lon: str, touches, hot_rows: int | None) -> DataFrame:
    tiers = _tiers(levels)
    of_level = F.create_map(*[F.lit(n) for tier, own in tiers.items() for level in own for n in (level, tier)])
    placed = points.select("*", _each("_tier", list(tiers)))
    sized = areas.withColumn("_tier", of_level[F.col("_level")])
    held = _held(placed, sized, box, tiers, lat, lon)
    rows = held.agg(F.sum(F.col("_points") + F.col("_areas"))).first()[0] or 0
    spark = points.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    if hot_rows is None:
        hot_rows = max(1, min(HOT_ROWS, rows // (_REGIONS * cores)))
    hot = _inlined(_refined(held, tiers, hot_rows))
    crowded = _inlined(_crowded(held, hot, tiers, hot_rows))

    def sent(rows: DataFrame, own: str, other: str) -> DataFrame:
        """To the task of their region, or of their part of it."""
        part = [F.lit(0).alias("_cut")]
        if crowded is not None:
            rows = rows.join(crowded, REGION, "left").fillna(1, ["_parts", "_shares"])
            mine = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.col(own)).cast("int")
            rows = rows.withColumn("_mine", mine).withColumn("_theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            first, second = ("_mine", "_theirs") if own == "_parts" else ("_theirs", "_mine")
            part = [(F.col(first) * F.col("_shares") + F.col(second)).alias("_cut")]
        dealt = rows.select("*", *part).withColumn("_task", F.pmod(F.xxhash64(*REGION, "_cut"), F.lit(tasks)).cast("int"))
        return dealt.drop("_parts", "_shares", "_mine", "_theirs").repartitionById(tasks, "_task")

    first = {tier: F.array(*[F.lit(n) for n in own]) for tier, own in tiers.items()}
    near = _in_region(placed.withColumn("_region", F.col("_tier")).withColumns(_place("_region", lat, lon)), hot)
    near = sent(near.withColumns(_place("_region", lat, lon)), "_parts", "_shares")
    near = near.select("*", F.explode(_of_tier(first)).alias("_level")).withColumns(_place("_level", lat, lon))
    spread = _listed(sized.withColumn("_region", F.col("_tier")), box, "_region", touches)
    if hot is not None:
        spread = _listed(_in_region(spread, hot), box, "_region", touches, within="_tier")
    spread = _listed(sent(spread, "_shares", "_parts"), box, "_level", touches, within="_region")
    # Rows are sorted by the number first, which tells most cells apart; those of one area and level differ in it.
    cell = F.shiftleft("_row", 32).bitwiseXOR(F.col("_col"))
    keys = ["_cell", "_level", "_cut", "_task"]
    near = near.withColumn("_cell", cell).select(*points.columns, *keys)
    spread = spread.withColumn("_cell", cell).select(*[c for c in areas.columns if c != "_level"], *keys)
    return near.join(listed_side(spread), keys).drop(*keys)


def _held(placed: DataFrame, sized: DataFrame, box: Box, tiers: dict[int, list[int]], lat: str, lon: str) -> DataFrame:
    """Points, as often as they are listed, and cells of areas, by the middle of the area; for each cell of a tier's first level."""
    south, north, west, east = box
    level = _of_tier({tier: F.lit(own[0]) for tier, own in tiers.items()})
    many = lambda low, high: index_at(F.col("_level"), high) - index_at(F.col("_level"), low) + 1

    def counted(rows: DataFrame, lat: Column, lon: Column, points: Column, areas: Column) -> DataFrame:
        at = (index_at(level, lat).alias("_row"), index_at(level, lon).alias("_col"))
        return rows.select("_tier", *at, points.cast("long").alias("_points"), areas.cast("long").alias("_areas"))

    listed = _of_tier({tier: F.lit(len(own)) for tier, own in tiers.items()})
    one = counted(placed, F.col(lat), F.col(lon), listed, F.lit(0))
    other = counted(sized, (south + north) / 2, (west + east) / 2, F.lit(0), many(south, north) * many(west, east))
    sums = [F.sum(c).alias(c) for c in ("_points", "_areas")]
    return materialize(one.unionByName(other).groupBy("_tier", "_row", "_col").agg(*sums))


def _above(levels: Column) -> list[Column]:
    """Row and column of the cell that holds this one, so many levels above."""
    return [F.floor(F.col(c) / F.pow(F.lit(2.0), levels)).alias(c) for c in ("_row", "_col")]


def _depth(tiers: dict[int, list[int]]) -> Column:
    return _of_tier({tier: F.lit(own[0] - tier) for tier, own in tiers.items()})


def _refined(held: DataFrame, tiers: dict[int, list[int]], hot_rows: int) -> DataFrame:
    """Regions that are sent as smaller ones and the levels to go down."""
    regions = held.select("_tier", *_above(_depth(tiers)), (F.col("_points") + F.col("_areas")).alias("_n"))
    sums = regions.groupBy("_tier", "_row", "_col").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > hot_rows)
    down = F.least(F.ceil(F.log2(F.col("_n") / F.lit(float(hot_rows))) / 2.0), _depth(tiers)).cast("int")
    return sums.select(F.col("_tier"), "_row", "_col", down.alias("_down")).filter(F.col("_down") > 0)


def _in_region(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows of a cell of level ``_tier``, with the level of the regions that it is sent as."""
    if hot is None:
        return rows.withColumn("_region", F.col("_tier"))
    return rows.join(hot, ["_tier", "_row", "_col"], "left").withColumn("_region", F.col("_tier") + F.coalesce("_down", F.lit(0))).drop("_down")


def _crowded(held: DataFrame, hot: DataFrame | None, tiers: dict[int, list[int]], hot_rows: int) -> DataFrame:
    """Regions that are still too large, and the number of parts to cut their points and their areas into."""
    depth = _depth(tiers)
    counts = held.withColumnsRenamed({"_row": "_own_row", "_col": "_own_col"})
    inside = counts.select("*", *[F.floor(F.col(f"_own{c}") / F.pow(F.lit(2.0), depth)).alias(c) for c in ("_row", "_col")])
    placed = _in_region(inside, hot).select("_tier", "_region", "_points", "_areas", F.col("_own_row").alias("_row"), F.col("_own_col").alias("_col"))
    regions = placed.select("_tier", "_region", "_points", "_areas", *_above(F.col("_tier") + depth - F.col("_region")))
    parts = [F.greatest(F.ceil(F.sum(c) / hot_rows), F.lit(1)).cast("int").alias(name) for c, name in (("_points", "_parts"), ("_areas", "_shares"))]
    return regions.groupBy(*REGION).agg(*parts).filter((F.col("_parts") > 1) | (F.col("_shares") > 1))


def _inlined(regions: DataFrame) -> DataFrame | None:
    """None without any, a broadcast table of known size of some, or a distributed one of very many."""
    found = regions.limit(_INLINE_CELLS + 1).collect()
    if not found:
        return None
    if len(found) <= _INLINE_CELLS:
        return F.broadcast(regions.sparkSession.createDataFrame(found, regions.schema))
    return regions


def disc_touches(center_lat: str, center_lon: str, reach_lat: Column, km_per_deg_lon: Column, km_per_deg: float) -> Callable[[Box], Column]:
    """Does a cell come within ``reach_lat`` degrees of a centre, in flat kilometres around it?"""

    def touches(cell: Box) -> Column:
        south, north, west, east = cell
        up = F.greatest(south - F.col(center_lat), F.col(center_lat) - north, F.lit(0.0)) * km_per_deg
        across = F.greatest(west - F.col(center_lon), F.col(center_lon) - east, F.lit(0.0)) * km_per_deg_lon
        radius = reach_lat * km_per_deg
        return up * up + across * across <= radius * radius * (1 + 1e-9)

    return touches


def disc_box(lat: str, lon: str, radius_km: Column, km_per_deg: float) -> tuple[Box, Callable[[Box], Column]]:
    """Bounding box and cell test of a disc, measured flat at the centre's latitude."""
    squeeze = F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-6))
    up = radius_km / km_per_deg * (1 + 1e-9)
    across = F.least(up / squeeze, F.lit(720.0))
    box = (F.col(lat) - up, F.col(lat) + up, F.col(lon) - across, F.col(lon) + across)
    return box, disc_touches(lat, lon, up, F.lit(km_per_deg) * F.cos(F.radians(F.col(lat))), km_per_deg)
