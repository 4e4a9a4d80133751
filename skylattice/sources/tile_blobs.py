"""Binary tile payloads: a small header, a section index, then shape and airport sections.

All numbers are little-endian. Shapes are encoded column-wise in an Arrow kernel. Items sorted by tile lie
side by side in a batch, so a section is one slice of its bytes and a payload takes time in its length.
Reading finds the items of a section by their counts and takes all its coordinates at once.

Version 1 counts the runways of an airport in one byte and the items of a section in two. A tile that has more is
of version 2, which takes no more bytes: a section's index entry holds the third byte of its item count after its
kind, and an airport of more than 255 runways has ``WIDE_FLAG`` set and the upper bytes of the count in the
last three of its ident's eight. Readers of version 1 refuse such a tile. All others stay version 1.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import airports as A
from skylattice.functions import tilemath
from skylattice.operators.geometry_kernels import Rings
from skylattice.operators.tilepyramid import TILE
from skylattice.session import materialize, ship_package

MAX_ITEMS = 0xFFFFFF
#: Largest tile number and most points of a shape.
MAX_SHORT = 0xFFFF
#: Largest payload that is put together; the format would address 4 GiB.
MAX_BYTES = 256 << 20
IDENT_CHARS = 8
#: Of an airport with more than ``NARROW_RUNWAYS``.
WIDE_IDENT_CHARS = 5
NARROW_RUNWAYS = 0xFF


def little_endian(value: Column, width: int) -> Column:
    """The low ``width`` bytes of an integer column, lowest first."""
    number = value.cast("long")
    parts = [
        F.unhex(F.lpad(F.hex(F.shiftright(number, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(width)
    ]
    return F.concat(*parts)


def _hex4(value: Column) -> Column:
    """The four bytes of an integer column as hex digits, lowest first."""
    digits = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])


def _encode_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``points`` by the shape's bytes: point count, bounding box, points."""
    for batch in batches:
        shapes = Rings.from_arrow(batch.column("points"))

        def e7(values: np.ndarray) -> np.ndarray:
            return np.rint(values * C.E7).astype("<i4")

        size = C.SHAPE_HEAD_BYTES + C.POINT_BYTES * shapes.lens
        start = np.cumsum(size) - size
        data = np.empty(size.sum(), dtype=np.uint8)
        if batch.num_rows:
            box = [
                e7(shapes.per_item(reduce, values))
                for reduce in (np.minimum, np.maximum)
                for values in (shapes.lat, shapes.lon)
            ]
            head = np.concatenate(
                [shapes.lens.astype("<u2").view(np.uint8).reshape(-1, 2), np.stack(box, axis=1).view(np.uint8).reshape(-1, 16)],
                axis=1,
            )
            data[start[:, None] + np.arange(C.SHAPE_HEAD_BYTES)] = head
            owner = shapes.owner()
            within = np.arange(owner.size) - shapes.starts[owner]
            at = start[owner] + C.SHAPE_HEAD_BYTES + C.POINT_BYTES * within
            pairs = np.stack([e7(shapes.lat), e7(shapes.lon)], axis=1).view(np.uint8).reshape(-1, C.POINT_BYTES)
            data[at[:, None] + np.arange(C.POINT_BYTES)] = pairs
        offsets = np.append(start, size.sum()).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], payload], names=[*batch.schema.names[:-1], "payload"])


def _payload(tile: tuple[int, int, int], sections: list[list]) -> bytes:
    """Header, index and sections; each section is [kind, number of items, pieces of its bytes, has an airport of wide count]."""
    z, x, y = tile
    wide = any(n > MAX_SHORT or flagged for _, n, _, flagged in sections)
    version = C.TILE_VERSION_WIDE if wide else C.TILE_VERSION
    head = [struct.pack("<4sBBHHBx", C.TILE_MAGIC, version, z, x, y, len(sections))]
    at, body = C.HEADER_BYTES + len(sections) * C.INDEX_ENTRY_BYTES, []
    for kind, n, pieces, _ in sections:
        size = C.SECTION_COUNT_BYTES + sum(map(len, pieces))
        head.append(struct.pack("<BB2xII", kind, n >> 16, at, size))
        body += [struct.pack("<H", n & MAX_SHORT), *pieces]
        at += size
    return b"".join(head + body)


#: Where an airport's flags stand, after its place.
_FLAGS_AT = C.POINT_BYTES


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items in order of tile and section to one payload per tile; only one unfinished tile is held."""
    names, kinds = ["z", "x", "y", "payload", "bytes"], [pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    tile, sections = None, []

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[(*key, data, len(data)) for key, data in done], strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        done: list[tuple] = []
        keys = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:4]], axis=1)
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        payload = batch.column(4)
        offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + batch.num_rows + 1]
        data = memoryview(payload.buffers()[2] or b"")
        for first, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            *key, kind = keys[first].tolist()
            if tuple(key) != tile:
                if tile is not None:
                    done.append((tile, _payload(tile, sections)))
                tile, sections = tuple(key), []
            if not sections or sections[-1][0] != kind:
                sections.append([kind, 0, [], False])
            sections[-1][1] += end - first
            sections[-1][2].append(bytes(data[offsets[first] : offsets[end]]))
            if kind == C.SECTION_KINDS["airports"]:
                flags = np.frombuffer(data, np.uint8)[offsets[first:end] + _FLAGS_AT]
                sections[-1][3] |= bool((flags & C.WIDE_FLAG).any())
        yield rows(done)
    if tile is not None:
        yield rows([(tile, _payload(tile, sections))])


def _airport_payload() -> Column:
    count = F.size("runways")
    wide = count > NARROW_RUNWAYS
    place = [little_endian(tilemath.deg_to_e7(c), 4) for c in ("lat", "lon")]
    flags = A.airport_flags("tier", "instrument_approach", count > 0).bitwiseOR(F.when(wide, C.WIDE_FLAG).otherwise(0))
    ident = F.when(
        wide, F.concat(F.rpad("ident", WIDE_IDENT_CHARS, "\0").cast("binary"), little_endian(F.shiftright(count, 8), 3))
    ).otherwise(F.rpad("ident", IDENT_CHARS, "\0").cast("binary"))
    # Joined at once, in time that follows their number.
    strips = F.transform(
        "runways", lambda r: F.concat(*[_hex4(tilemath.deg_to_e7(r[c])) for c in ("lat1", "lon1", "lat2", "lon2")])
    )
    return F.concat(*place, little_endian(flags, 1), ident, little_endian(count, 1), F.unhex(F.array_join(strips, "")))


def encode_tiles(capped: DataFrame, placed_airports: DataFrame) -> DataFrame:
    """Capped shapes and airports (with ``runways``) to z, x, y, payload, bytes, reason.

    The format counts the points of a shape and the tile's place in two bytes each, the items of a section in
    three, and holds idents of eight characters, or five with more than 255 runways. A tile beyond any of that, or of
    more than ``MAX_BYTES``, has no payload but a ``reason``; its rows are counted, never gathered. Items of equal
    order stand in order of their bytes, so a tile always has the same payload.
    """
    ship_package(capped.sparkSession)
    order = F.when(F.col("action") == "drop", F.size("points")).otherwise(0)
    rows = capped.select(F.col("z").cast("tinyint").alias("z"), "x", "y", "layer", order.alias("o1"), F.col("feature_id").alias("o2"), "part", "run", "points")
    shapes = rows.mapInArrow(
        _encode_shapes,
        "z tinyint, x int, y int, layer string, o1 int, o2 long, part int, run int, payload binary",
    ).withColumn("o2a", F.lit(""))
    airports = placed_airports.select(
        *TILE, F.lit("airports").alias("layer"), (-F.col("tier")).cast("int").alias("o1"), F.lit(0).cast("long").alias("o2"),
        F.lit(0).alias("part"), F.lit(0).alias("run"), _airport_payload().alias("payload"), F.col("ident").alias("o2a"),
    )
    kind = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in C.SECTION_KINDS.items()])
    # Encoded once: the items are counted, and then put together.
    items = materialize(shapes.unionByName(airports).withColumn("kind", kind).drop("layer"))
    counts = items.groupBy(*TILE, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("_bytes"))

    def because(rows: DataFrame, condition: Column, reason: str) -> DataFrame:
        return rows.filter(condition).select(*TILE, F.lit(reason).alias("reason"))

    far = (F.col("x") > MAX_SHORT) | (F.col("y") > MAX_SHORT)
    longest = F.when(F.size("runways") > NARROW_RUNWAYS, WIDE_IDENT_CHARS).otherwise(IDENT_CHARS)
    unfit = (
        because(counts, F.col("n") > MAX_ITEMS, "more items in a section than the format counts")
        .unionByName(because(counts, far, "tile beyond the places the format counts"))
        .unionByName(because(counts.groupBy(*TILE).agg(F.sum("_bytes").alias("_bytes")), F.col("_bytes") > MAX_BYTES, "more bytes than a payload may have"))
        .unionByName(because(capped, F.size("points") > MAX_SHORT, "more points in a shape than the format counts"))
        .unionByName(because(placed_airports, F.length("ident") > longest, "ident longer than the format holds"))
    )
    refused = unfit.groupBy(*TILE).agg(F.min("reason").alias("reason"))
    order = [*TILE, "kind", "o1", "o2a", "o2", "part", "run"]
    fitting = items.join(refused, TILE, "left_anti").select(*order, "payload")
    sorted_items = fitting.repartition(*TILE).sortWithinPartitions(*order, "payload").select(*TILE, "kind", "payload")
    encoded = sorted_items.mapInArrow(_assemble, "z tinyint, x int, y int, payload binary, bytes int").withColumn(
        "reason", F.lit(None).cast("string")
    )
    rejected = refused.select(
        *TILE, F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("int").alias("bytes"), "reason"
    )
    return encoded.unionByName(rejected)


# --- decoding -------------------------------------------------------------------------------

_DECODED = (
    "path string, z int, x int, y int, layer string, item int, lons array<double>, lats array<double>, "
    "ident string, flags int, reason string"
)
_KIND_NAMES = {kind: name for name, kind in C.SECTION_KINDS.items()}


class _Refused(Exception):
    """The file cannot be read; the message is the reason."""


def _section(data: np.ndarray, kind: int, start: int, end: int, more: int, wide: int) -> tuple:
    """(number of points of every item, all points, idents, flags) of a section, by arrays.

    ``more`` is the third byte of its item count, ``wide`` the flag of airports with a wide count, 0 in version 1.
    """
    if start + C.SECTION_COUNT_BYTES > end:
        raise _Refused("damaged section")
    raw = data[start:end].tobytes()
    airports = _KIND_NAMES[kind] == "airports"
    head = C.AIRPORT_HEAD_BYTES if airports else C.SHAPE_HEAD_BYTES
    heads, counts, at = [], [], C.SECTION_COUNT_BYTES
    for _ in range(raw[0] | raw[1] << 8 | more << 16):
        if at + head > len(raw):
            raise _Refused("damaged section")
        if not airports:
            n = raw[at] | raw[at + 1] << 8
        elif raw[at + _FLAGS_AT] & wide:
            n = 2 * (raw[at + head - 1] | int.from_bytes(raw[at + head - 4 : at + head - 1], "little") << 8)
        else:
            n = 2 * raw[at + head - 1]
        heads.append(at)
        counts.append(n)
        at += head + n * C.POINT_BYTES
    if at > len(raw):
        raise _Refused("damaged section")
    heads, counts = np.array(heads, np.int64), np.array(counts, np.int64)
    # What is left without the heads are coordinates; an airport's head begins with its own place.
    skip = C.POINT_BYTES if airports else 0
    plain = np.ones(at, bool)
    plain[: C.SECTION_COUNT_BYTES] = False
    plain[(heads[:, None] + np.arange(skip, head)).reshape(-1)] = False
    bytes_ = np.frombuffer(raw, np.uint8, at)
    points = bytes_[plain].view("<i4").reshape(-1, 2) / C.E7
    if not airports:
        return counts, points, [None] * len(heads), [None] * len(heads)
    flags = bytes_[heads + _FLAGS_AT]
    chars = np.where(flags & wide, WIDE_IDENT_CHARS, IDENT_CHARS).tolist()
    idents = [raw[p + 9 : p + 9 + n].rstrip(b"\0").decode("ascii", "replace") for p, n in zip(heads.tolist(), chars, strict=True)]
    return counts + 1, points, idents, (flags & ~np.uint8(wide)).tolist()


def _sections(data: bytes) -> Iterator[tuple]:
    """(z, x, y, layer, and what _section gives) of a file's known sections."""
    if len(data) < C.HEADER_BYTES:
        raise _Refused("shorter than the header")
    magic, version, z, x, y, sections = struct.unpack_from("<4sBBHHB", data)
    if magic != C.TILE_MAGIC:
        raise _Refused("bad magic")
    if version not in (C.TILE_VERSION, C.TILE_VERSION_WIDE):
        raise _Refused("unsupported version")
    first = C.HEADER_BYTES + sections * C.INDEX_ENTRY_BYTES
    if len(data) < first:
        raise _Refused("shorter than the section index")
    numbers = np.frombuffer(data, np.uint8)
    wide = C.WIDE_FLAG if version == C.TILE_VERSION_WIDE else 0
    for kind, more, start, length in struct.iter_unpack("<BB2xII", data[C.HEADER_BYTES : first]):
        if start + length > len(data):
            raise _Refused("section beyond the end")
        if kind in _KIND_NAMES:
            yield z, x, y, _KIND_NAMES[kind], *_section(numbers, kind, start, start + length, more if wide else 0, wide)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DECODED.split(", ")]
    lists, ints, text = pa.list_(pa.float64()), pa.int32(), pa.string()
    kinds = [text, ints, ints, ints, text, ints, lists, lists, text, ints, text]
    for batch in batches:
        for path, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                found = list(_sections(bytes(blob.as_buffer()) if blob.is_valid else b""))
            except _Refused as refused:
                columns = [pa.array([path if n == "path" else str(refused) if n == "reason" else None], k) for n, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            for z, x, y, layer, counts, points, idents, flags in found:
                n = len(counts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                same = lambda value, kind: pa.array([value] * n, kind)  # noqa: E731, B023
                columns = [
                    same(path, text), same(z, ints), same(x, ints), same(y, ints), same(layer, text), pa.array(np.arange(n, dtype=np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(points[:, 1]))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(points[:, 0]))),
                    pa.array(idents, text), pa.array(flags, ints), same(None, text),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def decode_tiles(blobs: DataFrame) -> DataFrame:
    """(path, payload) to one row per shape or airport; refused files give one row with a ``reason``.

    Airports carry their own position first, then two points per runway, in ``lons``/``lats``.
    Unknown section kinds are skipped.
    """
    ship_package(blobs.sparkSession)
    return blobs.select("path", "payload").mapInArrow(_decode, _DECODED)


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(folder)
    return decode_tiles(files.select("path", F.col("content").alias("payload")))
