"""Arrow kernels for geometry that has no built-in expression: cutting and simplifying shapes.

Each works on one Arrow batch of shapes at a time, for ``mapInArrow``: whole columns as NumPy
arrays, no loop over rows or points. Spark decides which rows meet in a batch; no kernel looks
beyond it. Large batches are taken in slices of bounded vertex count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE_VERTICES = 1_000_000
_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])

SHAPE_SCHEMA = (
    "feature_id long, layer string, part int, run int, z tinyint, x int, y int, "
    "points array<struct<lon:double,lat:double>>"
)


class Rings:
    """Ragged arrays of points: ``lon``/``lat`` concatenated, ``lens`` points per item."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, lens: np.ndarray):
        self.lon, self.lat, self.lens = lon, lat, lens.astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    @classmethod
    def from_arrow(cls, points: pa.ListArray) -> Rings:
        if isinstance(points, pa.ChunkedArray):
            points = points.combine_chunks()
        offsets = points.offsets.to_numpy().astype(np.int64)
        lon, lat = (f.to_numpy(zero_copy_only=False) for f in points.values.flatten())
        span = slice(offsets[0], offsets[-1])
        return cls(lon[span], lat[span], np.diff(offsets))

    def to_arrow(self) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(self.lon), pa.array(self.lat)], fields=list(_POINT))
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    def take(self, items: np.ndarray) -> Rings:
        """The chosen items, repeated and reordered as asked."""
        lens = self.lens[items]
        at = np.repeat(self.starts[items] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return Rings(self.lon[at], self.lat[at], lens)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.lens.size), self.lens)

    def per_item(self, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
        return reduce.reduceat(values, self.starts)  # items must not be empty


def _slices(weights: np.ndarray) -> Iterator[np.ndarray]:
    """Item numbers in order, cut so that each slice's weights stay near the vertex budget."""
    if weights.size:
        cut = np.flatnonzero(np.diff((np.cumsum(weights) - weights) // _SLICE_VERTICES)) + 1
        yield from np.split(np.arange(weights.size), cut)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (item, value) with low <= value <= high."""
    counts = np.maximum(high - low + 1, 0)
    item = np.repeat(np.arange(low.size), counts)
    value = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    return item, value


def _tile_ranges(rings: Rings, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last tile column and row of every item's bounding box."""
    n = 1 << z
    edge = np.minimum(rings.per_item(np.maximum, rings.lon), 180.0 - 1e-9)

    def tile(values: np.ndarray, span: float) -> np.ndarray:
        return np.clip(np.floor(values / span), 0, n - 1).astype(np.int64)

    return (
        tile(rings.per_item(np.minimum, rings.lon) + 180.0, 360.0 / n),
        tile(edge + 180.0, 360.0 / n),
        tile(90.0 - rings.per_item(np.maximum, rings.lat), 180.0 / n),
        tile(90.0 - rings.per_item(np.minimum, rings.lat), 180.0 / n),
    )


Cut = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rings]  # item, x, y, run, shape


def cut_lines(lines: Rings, z: int) -> Iterator[Cut]:
    """Maximal runs of two or more consecutive vertices inside a tile's closed box.

    Every vertex is placed in its own tile, and in the neighbour when it lies on their border, so
    the work is proportional to the vertices and not to vertices times tiles. ``run`` is the
    position of the run's first vertex.
    """
    usable = np.flatnonzero(lines.lens >= 2)
    for part in _slices(lines.lens[usable]):
        items = usable[part]
        some = lines.take(items)
        owner, n = some.owner(), 1 << z
        x_low, x_high, y_low, y_high = (r[owner] for r in _tile_ranges(some, z))
        lon_span, lat_span = 360.0 / n, 180.0 / n
        x_own = np.clip(np.floor((some.lon + 180.0) / lon_span), 0, n - 1).astype(np.int64)
        y_own = np.clip(np.floor((90.0 - some.lat) / lat_span), 0, n - 1).astype(np.int64)
        placed = []
        for dx in (0, -1, 1):
            x = x_own + dx
            west = -180.0 + x * lon_span
            in_column = (x >= x_low) & (x <= x_high) & (some.lon >= west) & (some.lon <= west + lon_span)
            for dy in (0, -1, 1):
                y = y_own + dy
                north = 90.0 - y * lat_span
                inside = in_column & (y >= y_low) & (y <= y_high) & (some.lat <= north) & (some.lat >= north - lat_span)
                at = np.flatnonzero(inside)
                placed.append(np.stack([owner[at], x[at], y[at], at]))
        table = np.concatenate(placed, axis=1)
        table = table[:, np.lexsort(table[::-1])]
        item, x, y, at = table
        if at.size == 0:
            continue
        fresh = np.ones(at.size, dtype=bool)
        fresh[1:] = (np.diff(table[:3], axis=1) != 0).any(axis=0) | (np.diff(at) != 1)
        first = np.flatnonzero(fresh)
        lens = np.diff(np.append(first, at.size))
        runs = Rings(some.lon[at], some.lat[at], lens)
        keep = np.flatnonzero(lens >= 2)
        head = first[keep]
        yield items[item[head]], x[head], y[head], at[head] - some.starts[item[head]], runs.take(keep)


def _keep_side(u: np.ndarray, v: np.ndarray, rings: Rings, limit: np.ndarray, below: bool):
    """One half-plane cut of every ring: keep u <= limit (``below``) or u >= limit."""
    owner = rings.owner()
    before = np.arange(u.size) - 1
    filled = rings.lens > 0
    before[rings.starts[filled]] = (rings.starts + rings.lens - 1)[filled]
    bound = limit[owner]
    inside = u <= bound if below else u >= bound
    crossing = inside != inside[before]
    emitted = inside.astype(np.int64) + crossing
    slot = np.cumsum(emitted) - emitted
    out_u, out_v = np.empty(emitted.sum()), np.empty(emitted.sum())
    to = np.flatnonzero(crossing)
    frm = before[to]
    du = u[to] - u[frm]
    t = np.divide(bound[to] - u[frm], du, out=np.zeros(du.size), where=du != 0)
    out_u[slot[to]] = u[frm] + du * t
    out_v[slot[to]] = v[frm] + (v[to] - v[frm]) * t
    kept = np.flatnonzero(inside)
    out_u[slot[kept] + crossing[kept]] = u[kept]
    out_v[slot[kept] + crossing[kept]] = v[kept]
    lens = np.bincount(owner, weights=emitted, minlength=rings.lens.size).astype(np.int64)
    return out_u, out_v, lens


def _keep_columns(rings: Rings, west: np.ndarray, east: np.ndarray) -> Rings:
    lon, lat, lens = _keep_side(rings.lon, rings.lat, rings, west, below=False)
    rings = Rings(lon, lat, lens)
    return Rings(*_keep_side(rings.lon, rings.lat, rings, east, below=True))


def _keep_rows(rings: Rings, south: np.ndarray, north: np.ndarray) -> Rings:
    lat, lon, lens = _keep_side(rings.lat, rings.lon, rings, south, below=False)
    rings = Rings(lon, lat, lens)
    lat, lon, lens = _keep_side(rings.lat, rings.lon, rings, north, below=True)
    return Rings(lon, lat, lens)


def cut_rings(rings: Rings, z: int) -> Iterator[Cut]:
    """Rings cut to every tile their box touches: west, east, south, north half-plane in turn.

    The west and east cuts do not depend on the tile's row, so they are made once per tile column
    and only what is left of the ring goes through the rows: a ring over c columns and r rows costs
    about its vertices times (c + r) instead of times c * r. Results are open rings.
    """
    usable = np.flatnonzero(rings.lens >= 3)
    last = rings.starts + rings.lens - 1
    n, lon_span, lat_span = 1 << z, 360.0 / (1 << z), 180.0 / (1 << z)
    for part in _slices(rings.lens[usable]):
        items = usable[part]
        some = rings.take(items)
        x_low, x_high, y_low, y_high = _tile_ranges(some, z)
        closed = (rings.lon[rings.starts[items]] == rings.lon[last[items]]) & (
            rings.lat[rings.starts[items]] == rings.lat[last[items]]
        )
        keep = np.ones(some.lon.size, dtype=bool)
        keep[(some.starts + some.lens - 1)[closed]] = False
        some = Rings(some.lon[keep], some.lat[keep], some.lens - closed)
        ring, x_all = _spread(x_low, x_high)
        for strip_part in _slices(some.lens[ring]):
            owner, x = ring[strip_part], x_all[strip_part]
            west = -180.0 + x * lon_span
            strips = _keep_columns(some.take(owner), west, west + lon_span)
            strip, y_all = _spread(np.where(strips.lens >= 3, y_low[owner], 1), np.where(strips.lens >= 3, y_high[owner], 0))
            for tile_part in _slices(strips.lens[strip]):
                chosen, y = strip[tile_part], y_all[tile_part]
                north = 90.0 - y * lat_span
                tiles = _keep_rows(strips.take(chosen), north - lat_span, north)
                full = np.flatnonzero(tiles.lens >= 3)
                if full.size:
                    at = chosen[full]
                    yield items[owner[at]], x[at], y[full], np.zeros(full.size, dtype=np.int64), tiles.take(full)


def _length(up: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Root of the sum of squares as it is written; ``hypot`` rounds otherwise, and picks another of equally far corners."""
    return np.sqrt(up * up + across * across)


def thin(shapes: Rings, tolerance: np.ndarray) -> Rings:
    """Douglas-Peucker for every shape at its own tolerance, all open intervals of a level at once.

    Endpoints stay; an interval splits at its first farthest vertex if that is farther than the
    tolerance from the line through its ends (from the end itself when both ends coincide).
    """
    keep = np.zeros(shapes.lon.size, dtype=bool)
    filled = shapes.lens > 0
    low, high = shapes.starts[filled], (shapes.starts + shapes.lens - 1)[filled]
    limit = np.broadcast_to(tolerance, shapes.lens.shape)[filled]
    keep[low], keep[high] = True, True
    while True:
        wide = high - low >= 2
        low, high, limit = low[wide], high[wide], limit[wide]
        if low.size == 0:
            break
        interval, at = _spread(low + 1, high - 1)
        counts = high - low - 1
        starts = np.cumsum(counts) - counts
        ax, ay = shapes.lon[low][interval], shapes.lat[low][interval]
        bx, by = shapes.lon[high][interval], shapes.lat[high][interval]
        px, py = shapes.lon[at], shapes.lat[at]
        base = _length(by - ay, bx - ax)
        off_line = np.abs((by - ay) * px - (bx - ax) * py + bx * ay - by * ax)
        dist = np.where(base == 0, _length(py - ay, px - ax), off_line / np.where(base == 0, 1.0, base))
        farthest = np.maximum.reduceat(dist, starts)
        is_top = dist == farthest[interval]
        first = np.minimum.reduceat(np.where(is_top, at, shapes.lon.size), starts)
        split = farthest > limit
        keep[first[split]] = True
        low, high, limit = (
            np.concatenate([low[split], first[split]]),
            np.concatenate([first[split], high[split]]),
            np.concatenate([limit[split], limit[split]]),
        )
    lens = np.bincount(shapes.owner(), weights=keep, minlength=shapes.lens.size).astype(np.int64)
    return Rings(shapes.lon[keep], shapes.lat[keep], lens)


def thin_rings(rings: Rings, tolerance: np.ndarray) -> Rings:
    """Thin open rings as closed ones; rings left with fewer than three corners become empty."""
    ring_ok = rings.lens >= 3
    first, last = rings.starts[ring_ok], (rings.starts + rings.lens - 1)[ring_ok]
    is_open = np.zeros(rings.lens.size, dtype=bool)
    is_open[ring_ok] = (rings.lon[first] != rings.lon[last]) | (rings.lat[first] != rings.lat[last])
    ends = (rings.starts + rings.lens)[is_open]
    closed = Rings(
        np.insert(rings.lon, ends, rings.lon[rings.starts[is_open]]),
        np.insert(rings.lat, ends, rings.lat[rings.starts[is_open]]),
        rings.lens + is_open,
    )
    done = thin(closed, tolerance)
    drop_last = np.ones(done.lon.size, dtype=bool)
    drop_last[(done.starts + done.lens - 1)[done.lens > 0]] = False
    lens = np.maximum(done.lens - 1, 0)
    result = Rings(done.lon[drop_last], done.lat[drop_last], lens)
    alive = np.repeat(ring_ok & (lens >= 3), lens)
    return Rings(result.lon[alive], result.lat[alive], np.where(ring_ok & (lens >= 3), lens, 0))


def _shape_batch(batch: pa.RecordBatch, item, run, z, x, y, points: Rings, names: list[str]) -> pa.RecordBatch:
    taken = pa.array(item)
    columns = {
        "feature_id": batch.column("feature_id").take(taken),
        "layer": batch.column("layer").take(taken),
        "part": batch.column("part").take(taken),
        "run": pa.array(run.astype(np.int32)),
        "z": pa.array(z.astype(np.int8)),
        "x": pa.array(x.astype(np.int32)),
        "y": pa.array(y.astype(np.int32)),
        "points": points.to_arrow(),
    }
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


_SHAPE_NAMES = ["feature_id", "layer", "part", "run", "z", "x", "y", "points"]


def cutter(cut: Callable[[Rings, int], Iterator[Cut]], zooms: dict[int, float], min_points: int, simplified: bool):
    """A ``mapInArrow`` function: features to their shapes per tile, simplified if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = Rings.from_arrow(batch.column("points"))
            for z, tolerance in zooms.items():
                for item, x, y, first, points in cut(shapes, z):
                    if simplified:
                        points = thin(points, np.float64(tolerance))
                        full = np.flatnonzero(points.lens >= min_points)
                        item, x, y, first, points = item[full], x[full], y[full], first[full], points.take(full)
                    yield _shape_batch(batch, item, first, np.full(item.size, z), x, y, points, _SHAPE_NAMES)

    return run


def simplifier(zooms: dict[int, float]):
    """A ``mapInArrow`` function: shapes thinned at their zoom's tolerance; rings need 3 points, lines 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = Rings.from_arrow(batch.column("points"))
            zoom = batch.column("z").to_numpy()
            known = np.array(sorted(zooms))
            thinned = thin(shapes, np.array([zooms[z] for z in known])[np.searchsorted(known, zoom)])
            least = np.where(_is_line(batch), 2, 3)
            full = np.flatnonzero(thinned.lens >= least)
            columns = [c.take(pa.array(full)) for c in batch.columns[:-1]] + [thinned.take(full).to_arrow()]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _is_line(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.equal(batch.column("layer"), "coast"), False).to_numpy(zero_copy_only=False)


def _coarser(batch: pa.RecordBatch, rounds: dict[int, list[float]]) -> Iterator[tuple[int, np.ndarray, Rings]]:
    """(round, rows of the batch, their shapes) at each coarser tolerance of a zoom, cumulatively.

    Round r starts from round r - 1. Lines need two points and rings three to go on. A zoom without
    rounds gives the shapes themselves as round 0.
    """
    zoom = batch.column("z").to_numpy()
    line = _is_line(batch)
    everything = Rings.from_arrow(batch.column("points"))
    for z in np.unique(zoom):
        for is_line in (True, False):
            alive = np.flatnonzero((zoom == z) & (line == is_line))
            shapes = everything.take(alive)
            for number, tolerance in enumerate(rounds[int(z)] or [None], start=1):
                if tolerance is None:
                    number = 0
                else:
                    thinner = thin if is_line else thin_rings
                    shapes = thinner(shapes, np.float64(tolerance))
                full = np.flatnonzero(shapes.lens >= (2 if is_line else 3))
                alive, shapes = alive[full], shapes.take(full)
                if alive.size == 0:
                    break
                yield number, alive, shapes


CLASS_SCHEMA = "layer string, z tinyint, x int, y int, round int, vertices int, n long"
_CLASS = ["layer", "z", "x", "y", "round", "vertices"]
_CLASS_ROWS = 1_000_000


def classifier(rounds: dict[int, list[float]]):
    """A ``mapInArrow`` function: how many shapes of how many vertices each tile's layers hold at each round.

    Rows of one class may come out several times; a task holds at most about ``_CLASS_ROWS`` of them.
    """

    def counted(waiting: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(waiting).group_by(_CLASS, use_threads=False).aggregate([("n", "sum")])
        return sums.select([*_CLASS, "n_sum"]).rename_columns([*_CLASS, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            for number, at, shapes in _coarser(batch, rounds):
                tile = [batch.column(c).take(pa.array(at)) for c in _CLASS[:4]]
                more = [np.full(at.size, number, np.int32), shapes.lens.astype(np.int32), np.ones(at.size, np.int64)]
                waiting.append(pa.table([*tile, *map(pa.array, more)], names=[*_CLASS, "n"]))
            if sum(t.num_rows for t in waiting) > _CLASS_ROWS:
                waiting = [counted(waiting)]
                if waiting[0].num_rows > _CLASS_ROWS // 2:
                    yield from waiting.pop().to_batches(max_chunksize=10_000)
        if waiting:
            yield from counted(waiting).to_batches(max_chunksize=10_000)

    return run


def coarsener(rounds: dict[int, list[float]]):
    """A ``mapInArrow`` function: every shape at the round its row asks for, if it has ``_least`` vertices there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            wanted, least = batch.column("round").to_numpy(), batch.column("_least").to_numpy()
            for number, at, shapes in _coarser(batch, rounds):
                full = np.flatnonzero((wanted[at] == number) & (shapes.lens >= least[at]))
                if full.size:
                    taken = pa.array(at[full])
                    columns = {n: batch.column(n).take(taken) for n in names if n != "points"} | {"points": shapes.take(full).to_arrow()}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run
