"""Tile payloads as files, through Spark's Python data source interface.

Every task writes below a folder of its own attempt. Only when all tasks have ended does the driver move what
they report to its place; tasks that failed, were repeated or ran twice leave nothing, and an aborted
write leaves the old files as they were. Tiles of one column (z, x) must come to one task: what is moved is the
column's folder, so the moves are bounded by the width of the map, not by the number of tiles.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "z int, x int, y int, payload binary"
MANIFEST = "tiles/manifest.json"


def store_of(folder: str):
    """pyarrow file system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder, and by column (z, x) the number and bytes of its tiles."""

    staged: str = ""
    columns: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)


class TileFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"_staging/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.folder)
        own = f"{self.staging}/{uuid.uuid4().hex}"
        tiles, sizes = Counter(), Counter()
        for batch in iterator:
            for z, x, y, payload in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "payload")), strict=True):
                if (z, x) not in tiles:
                    store.create_dir(f"{root}/{own}/{z}/{x}", recursive=True)
                with store.open_output_stream(f"{root}/{own}/{z}/{x}/{y}.bin") as out:
                    out.write(payload)
                tiles[z, x] += 1
                sizes[z, x] += len(payload)
        return Written(staged=own, columns={column: (tiles[column], sizes[column]) for column in tiles})

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.folder)
        done = [m for m in messages if m is not None]
        owners = Counter(column for m in done for column in m.columns)
        if twice := [column for column, n in owners.items() if n > 1]:
            self.abort(messages)
            raise ValueError(f"tiles of one column came to several tasks: {twice[:3]}")
        if self.overwrite and _there(store, f"{root}/tiles"):
            store.delete_dir(f"{root}/tiles")
        zooms: dict[int, list[int]] = {}
        for message in done:
            for (z, x), (n, size) in message.columns.items():
                self._move(store, f"{root}/{message.staged}/{z}/{x}", f"{root}/tiles/{z}/{x}")
                counts = zooms.setdefault(z, [0, 0])
                counts[0] += n
                counts[1] += size
        store.create_dir(f"{root}/tiles", recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([[z, *zooms[z]] for z in sorted(zooms)]).encode())
        self._clean(store, root)

    def _move(self, store, source: str, target: str) -> None:
        from pyarrow import fs

        if not _there(store, target):
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            store.move(source, target)
            return
        # The column has other tiles already: files take their places one by one.
        for info in store.get_file_info(fs.FileSelector(source)):
            store.move(info.path, f"{target}/{info.base_name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*store_of(self.folder))

    def _clean(self, store, root: str) -> None:
        if _there(store, f"{root}/{self.staging}"):
            store.delete_dir(f"{root}/{self.staging}")


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type == fs.FileType.Directory


class TileFiles(DataSource):
    """``format("tile_files")`` with the option ``path``; rows have z, x, y and payload."""

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TileFilesWriter:
        return TileFilesWriter(self.options["path"], overwrite)
