"""One large GeoJSON collection read by many tasks.

A file is cut into ranges of bytes wherever they fall, also inside a string. Each range is first
scanned for both cases, as if it began inside a string and as if it didn't: quotes switch between
the cases, and brackets count for the one that is outside. Running sums over the ranges then
say in which case, and how deep, each really begins. With that, a task finds the features
that begin in its range, and reads on past its end for the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

#: What changes the state of a scan: a quote, a bracket, or a sign after a backslash (skipped).
_MARK = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
#: The depth at which features begin: inside the collection and its list.
_FEATURES = 2


def _open(name: str):
    store, inside = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and "://" not in name else name)
    return store.open_input_file(inside)


def _begin(file, start: int) -> int:
    """Bytes at the start of a range to skip: 1 where a backslash before it speaks for its first sign."""
    back = start
    while back and file.read_at(1, back - 1) == b"\\":
        back -= 1
    return (start - back) % 2


def summary(data: bytes) -> tuple[int, int, int]:
    """Whether the range has an odd number of quotes, and how much deeper it ends than it begins: if
    it begins outside a string, and if inside."""
    odd, deeper = 0, [0, 0]
    for m in _MARK.finditer(data):
        sign = m[0]
        if sign == b'"':
            odd ^= 1
        elif len(sign) == 1:
            deeper[odd] += 1 if sign in b"{[" else -1
    return odd, deeper[0], deeper[1]


def _features(file, start: int, end: int, inside: bool, depth: int, step: int) -> Iterator[bytes]:
    """The objects that begin in a range at the depth of features, whole."""
    at, held, first, size = start + _begin(file, start), b"", None, file.size()
    while at < size and (at < end or first is not None):
        data = file.read_at(min(step, size - at), at)
        if (len(data) - len(data.rstrip(b"\\"))) % 2 and at + len(data) < size:  # a backslash and its sign stay together
            data += file.read_at(1, at + len(data))
        for m in _MARK.finditer(data):
            sign = m[0]
            if sign == b'"':
                inside = not inside
            elif inside or len(sign) > 1:
                continue
            elif sign in b"{[":
                if depth == _FEATURES and sign == b"{" and at + m.start() < end:
                    first, held = m.start(), b""
                depth += 1
            else:
                depth -= 1
                if depth == _FEATURES and first is not None:
                    yield held + data[first : m.end()]
                    first, held = None, b""
                    if at + m.end() >= end:
                        return
        if first is not None:
            held, first = held + data[first:], 0
        at += len(data)


def read_collection(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Features of GeoJSON collections, however large: properties as a map, the geometry's type and box.

    Files are read twice, a range a task. As many rows as there are ranges are shuffled for
    the running sums. A feature takes its own size in memory. Of other objects at the depth of
    features (parts of a reference system, say) none is a feature, as they don't say so.
    """
    cut = [(name, k, at, min(at + range_bytes, size)) for name, size, _ in files.listed(spark, path)
           if not name.rsplit("/", 1)[-1].startswith(("_", ".")) for k, at in enumerate(range(0, size, range_bytes))]
    if not cut:
        cut = [("", 0, 0, 0)]
    ranges = spark.createDataFrame(cut, "file string, k long, start long, end long").repartition(len(cut))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = (0, 0, 0)
                if r["file"]:
                    with _open(r["file"]) as file:
                        start = r["start"] + _begin(file, r["start"])
                        data = file.read_at(r["end"] - start, start) if r["end"] > start else b""
                        found = summary(data)
                rows.append(r | dict(zip(("odd", "outside", "inside"), found, strict=True)))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    numbers = ("k", "start", "end", "odd", "outside", "inside")
    schema = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in numbers)])
    scanned = ranges.mapInArrow(scan, f"file string, {', '.join(f'`{n}` long' for n in numbers)}")
    before = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    begun = scanned.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begun = begun.withColumn("deeper", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    begun = begun.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["file"]:
                    continue
                with _open(r["file"]) as file:
                    held, size = [], 0
                    for feature in _features(file, r["start"], r["end"], bool(r["in_string"]), r["depth"], 1 << 20):
                        held.append(feature.decode("utf-8"))
                        size += len(feature)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    dealt = begun.select("file", "start", "end", "in_string", "depth").repartition(len(cut), "file", "start")
    texts = dealt.mapInArrow(read, "value string")
    kind = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    rows = texts.select(F.from_json("value", kind).alias("f")).where(F.col("f.type") == "Feature")
    return rows.select("f.properties", "f.geometry.type", *files.coordinate_box(F.col("f.geometry.coordinates")))
