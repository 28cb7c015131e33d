"""GeoParquet: a source and sink of its own, as Spark's Parquet writer can't add the format's
footer entry.

``spark.dataSource.register(GeoParquet)`` makes it known; then

    df.write.format("geoparquet").mode("overwrite").save(path)
    spark.read.format("geoparquet").option("bbox", "139.7,35.6,139.8,35.7").load(path)

Written rows have a geometry as well-known binary and its box as xmin, ymin, xmax, ymax (doubles),
from which the writer makes the covering column ``bbox``. With ``bbox`` (west, south, east, north)
the reader gives rows whose box meets that, and reads only row groups whose statistics do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..functions.wkb import KINDS

#: Fixed values of the format.
FORMAT_VERSION = "1.1.0"
BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it: a local path, or a URI of a store that pyarrow knows."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _files(path: str) -> list[str]:
    store, inside = _store(path)
    found = store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    if not found and store.get_file_info(inside).is_file:
        return [inside]
    hidden = lambda p: any(part[:1] in "._" for part in p[len(inside) :].split("/") if part)
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not hidden(f.path))


def geo_entry(kinds: list[str], box: list[float] | None, geometry: str = "geometry") -> dict:
    """The footer entry: where the geometry is, what kinds it has, its box, and its covering column."""
    covering = {"bbox": {b: ["bbox", b] for b in BOUNDS}}
    column = {"encoding": "WKB", "geometry_types": kinds, "covering": covering}
    if box is not None:
        column["bbox"] = box
    return {"version": FORMAT_VERSION, "primary_column": geometry, "columns": {geometry: column}}


def _kinds(geometry: pa.Array) -> set[str]:
    """The kinds of geometry, from the byte of order and the number after it."""
    heads = {bytes(v[:5]) for v in geometry.to_pylist() if v}
    return {KINDS.get(int.from_bytes(h[1:], "little" if h[0] == 1 else "big"), "Geometry") for h in heads}


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Tasks write files into a folder beside the table; when all are done the driver moves them in."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        missing = [c for c in ("geometry", *BOUNDS) if c not in schema.names]
        if missing:
            raise ValueError(f"geoparquet needs the columns {missing}")
        self.path, self.overwrite = options["path"], overwrite
        self.rows = int(options.get("rowgrouprows", 50_000))
        self.staging = f"{self.path.rstrip('/')}/_writing-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.staging)
        name, rows, kinds, held, size, file = f"part-{uuid.uuid4().hex}.parquet", 0, set(), [], 0, None
        box = [np.inf, np.inf, -np.inf, -np.inf]
        store.create_dir(folder, recursive=True)

        def flush() -> None:
            nonlocal held, size, file
            table = pa.Table.from_batches(held)
            if file is None:
                file = pq.ParquetWriter(f"{folder}/{name}", table.schema, filesystem=store, compression="snappy")
            file.write_table(table, row_group_size=self.rows)
            held, size = [], 0

        for batch in iterator:
            bounds = [batch.column(b) for b in BOUNDS]
            covering = pa.StructArray.from_arrays(bounds, BOUNDS, mask=pc.is_null(bounds[0]))
            rest = [c for c in batch.schema.names if c not in BOUNDS]
            batch = pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), covering], [*rest, "bbox"])
            kinds |= _kinds(batch.column("geometry"))
            for k, (b, least) in enumerate(zip(bounds, (pc.min, pc.min, pc.max, pc.max), strict=True)):
                v = least(b).as_py()
                box[k] = box[k] if v is None else min(box[k], v) if k < 2 else max(box[k], v)
            rows += batch.num_rows
            while batch.num_rows:  # row groups of exactly so many rows, but for the last
                part = batch.slice(0, self.rows - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == self.rows:
                    flush()
        if held:
            flush()
        if file is None:
            return _Written("", 0)
        entry = geo_entry(sorted(kinds), None if box[0] == np.inf else box)
        file.add_key_value_metadata({"geo": json.dumps(entry)})
        file.close()
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        _, staging = _store(self.staging)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                store.move(f"{staging}/{m.name}", f"{folder}/{m.name}")
        for name in old:
            store.delete_file(name)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


@dataclass
class _Groups(InputPartition):
    file: str
    groups: list[int]


class _Reader(DataSourceReader):
    """A task for each file's row groups that meet the box; footers alone are read to choose them."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        text = options.get("bbox")
        self.box = tuple(map(float, text.split(","))) if text else None
        if self.box is not None and len(self.box) != 4:
            raise ValueError("bbox is west,south,east,north")
        self.groups = int(options.get("groupsperpartition", 8))

    def partitions(self) -> list[_Groups]:
        store, _ = _store(self.path)
        out = []
        for name in _files(self.path):
            with store.open_input_file(name) as file:
                found = groups_meeting(pq.read_metadata(file), self.box)
            out += [_Groups(name, found[k : k + self.groups]) for k in range(0, len(found), self.groups)]
        return out or [_Groups("", [])]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as source:
            file = pq.ParquetFile(source)
            for group in partition.groups:
                for batch in file.iter_batches(row_groups=[group], batch_size=10_000):
                    if self.box is not None:
                        west, south, east, north = self.box
                        bound = lambda b, batch=batch: pc.struct_field(batch.column("bbox"), b)
                        meets = [pc.less_equal(bound("xmin"), east), pc.greater_equal(bound("xmax"), west),
                                 pc.less_equal(bound("ymin"), north), pc.greater_equal(bound("ymax"), south)]
                        batch = batch.filter(pc.and_(pc.and_(meets[0], meets[1]), pc.and_(meets[2], meets[3])))
                    if batch.num_rows:
                        yield batch.select(self.names)


def groups_meeting(meta: pq.FileMetaData, box: tuple[float, ...] | None) -> list[int]:
    """Row groups whose statistics of the covering column meet a box; those without any do."""
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns))}
        bound = lambda b, least, stats=stats: (
            getattr(s, "min" if least else "max") if (s := stats.get(f"bbox.{b}")) is not None and s.has_min_max else None
        )
        if box is not None:
            west, south, east, north = box
            apart = [(bound("xmin", True), east), (west, bound("xmax", False)), (bound("ymin", True), north), (south, bound("ymax", False))]
            if any(a is not None and b is not None and a > b for a, b in apart):
                continue
        out.append(g)
    return out


class GeoParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self) -> StructType:
        found = _files(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no GeoParquet file below {self.options['path']}")
        store, _ = _store(self.options["path"])
        with store.open_input_file(found[0]) as file:
            return from_arrow_schema(pq.read_schema(file).remove_metadata())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)
