"""Geometries as well-known binary, for GeoParquet files: points, boxes, and the box of any."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: little-endian mark, kinds of geometry.
LITTLE, POINT, LINE, POLYGON = 1, 1, 2, 3
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


@F.pandas_udf(T.BinaryType())
def _points(lon: pd.Series, lat: pd.Series) -> pd.Series:
    rows = np.empty(len(lon), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    rows["order"], rows["kind"], rows["x"], rows["y"] = LITTLE, POINT, lon, lat
    made = pd.Series([r.tobytes() for r in rows], dtype=object)
    return made.where((lon.notna() & lat.notna()).to_numpy(), None)


def point_wkb(lon: str | Column, lat: str | Column) -> Column:
    """A point; null if a coordinate is."""
    return _points(lon, lat)


@F.pandas_udf(T.BinaryType())
def _boxes(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    head = struct.pack("<BIII", LITTLE, POLYGON, 1, 5)
    ring = np.stack([xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax, xmin, ymin], axis=1).astype("<f8")
    made = pd.Series([head + r.tobytes() for r in ring], dtype=object)
    return made.where(~np.isnan(ring).any(axis=1), None)


def box_wkb(xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> Column:
    """A rectangle as a polygon of one closed ring; null if a bound is."""
    return _boxes(xmin, ymin, xmax, ymax)


def positions(data: bytes, at: int = 0) -> tuple[list[np.ndarray], int]:
    """The coordinates (n x 2) of each part of a geometry of two dimensions, and where it ends."""
    order = "<" if data[at] == LITTLE else ">"
    kind, at = struct.unpack_from(f"{order}I", data, at + 1)[0], at + 5
    number = lambda a: struct.unpack_from(f"{order}I", data, a)[0]

    def run(n: int, a: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(data, f"{order}f8", 2 * n, a).reshape(n, 2), a + 16 * n

    if kind == POINT:
        part, at = run(1, at)
        return [part], at
    if kind == LINE:
        part, at = run(number(at), at + 4)
        return [part], at
    if kind > 7:
        raise ValueError(f"geometry of kind {kind} is not one of two dimensions")
    parts, n = [], number(at)
    at += 4
    for _ in range(n):  # rings of a polygon; members of a collection are geometries themselves
        if kind == POLYGON:
            part, at = run(number(at), at + 4)
            parts.append(part)
        else:
            more, at = positions(data, at)
            parts += more
    return parts, at


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]))
def _box_of(geometry: pd.Series) -> pd.DataFrame:
    rows = np.full((len(geometry), 4), np.nan)
    for k, data in enumerate(geometry):
        found = [p for p in (positions(bytes(data))[0] if data else []) if len(p)]
        if found:
            flat = np.concatenate(found)
            rows[k] = [*flat.min(axis=0), *flat.max(axis=0)]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"])


def wkb_box(geometry: str | Column) -> Column:
    """The box of a geometry as a struct of xmin .. ymax; of an empty or null one all are null."""
    return _box_of(geometry)
