"""The stored tables that lookups read: written once in an order whose row-group statistics
prune, then scanned with pushed filters."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import heights, hexgrid, keys
from ..operators import cover
from ..sources import files
from . import fixtures as fx


@dataclass(frozen=True)
class Layout:
    """How a table is made from which input, which column has a folder a value, and in which order rows lie.

    Where an input row makes about ``cells`` rows, ``build`` makes them from rows that were dealt
    by place before, so that only the input's rows are shuffled; tasks then sort what they made, by
    ``number`` where that is one number in order of ``by``. ``derived`` are columns that others of
    the table give, which are not stored.
    """

    build: Callable[[SparkSession, str], DataFrame]
    by: list[str]
    parts: list[str]
    source: str = "orders"
    cells: int = 0
    derived: Callable[[DataFrame], DataFrame] = lambda df: df
    number: Callable[[], Column] | None = None


#: Rows that a task makes of those dealt to it, and from how many on the work is dealt to all cores.
TASK_ROWS, LEAST_ROWS = 2_000_000, 100_000


def dealt(df: DataFrame, spark: SparkSession, sf_dir: str, source: str, cells: int, lon: str, lat: str) -> DataFrame:
    """Rows in ranges of the Morton key of their place, as many as their ``cells`` rows each make
    tasks. The number of rows is read from the footers."""
    made = spark.read.parquet(f"{sf_dir}/{source}.parquet").count() * cells
    tasks = max(1, -(-made // TASK_ROWS), min(spark.sparkContext.defaultParallelism, made // LEAST_ROWS))
    z = fx.XY_ZOOM + 4
    return df.withColumn("_place", keys.morton2d(keys.tile_x(lon, z), keys.tile_y(lat, z))).repartitionByRange(tasks, "_place").drop("_place")


def obstacles(spark: SparkSession, sf_dir: str, buildings: DataFrame | None = None) -> DataFrame:
    df = heights.estimate_heights(fx.buildings(spark, sf_dir) if buildings is None else buildings)
    return df.select(
        "osm_id", "xmin", "ymin", "xmax", "ymax", "max_height_m", "min_height_m", "height_source", "levels", "min_level"
    )


def origin_of(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Two numbers of one aggregate row; they become constants of plans."""
    row = cover.morton_origin(fx.buildings(spark, sf_dir), fx.XY_ZOOM).first()
    return (row["x_origin"], row["y_origin"]) if row["x_origin"] is not None else (0, 0)


def occupancy(spark: SparkSession, sf_dir: str, scheme: str, df: DataFrame | None = None) -> DataFrame:
    df = obstacles(spark, sf_dir) if df is None else df
    if scheme == "zfxy":
        return cover.occupancy_zfxy(df, fx.ZFXY_ZOOMS)
    if scheme == "zxy_heightbin":
        return cover.occupancy_bins(df, fx.XY_ZOOM, fx.BINS_M)
    return cover.occupancy_morton3d(df, fx.XY_ZOOM, fx.BINS_M, origin_of(spark, sf_dir))


#: Rows that an obstacle or building makes, about: for the number of tasks alone.
OCCUPANCY_CELLS = {"zfxy": 18, "zxy_heightbin": 11, "morton3d": 11}
BOX_CELLS = {"hex": 5, "geohash": 20, "quadkey": 6, "morton2d": 4}


def _occupancy(scheme: str, by: list[str], part: str) -> Layout:
    kept = ["osm_id", "x", "y", *(["f"] if scheme == "zfxy" else ["hbin"]), *(["key_u64"] if scheme == "morton3d" else []), part]

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(fx.buildings(spark, sf_dir), spark, sf_dir, "orders", OCCUPANCY_CELLS[scheme], "xmin", "ymin")
        sized = heights.estimate_heights(rows).select("osm_id", "xmin", "ymin", "xmax", "ymax", "max_height_m", "min_height_m")
        if scheme == "morton3d":
            return cover.occupancy_morton3d(sized, fx.XY_ZOOM, fx.BINS_M, stored_origin(spark, sf_dir)).select(*kept)
        return occupancy(spark, sf_dir, scheme, sized).select(*kept)

    number = lambda: F.col("key_u64") if scheme == "morton3d" else keys.packed(*by)
    return Layout(build, by, [part], "orders", OCCUPANCY_CELLS[scheme], lambda df: cover.with_derived(df, scheme, fx.XY_ZOOM), number)


def _large(part: str, sized: Callable[[DataFrame], DataFrame]) -> Layout:
    """Cell boxes of the obstacles that have no cells in the occupancy table, as they are over a cap. They
    are few, so that they have no folders."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(fx.buildings(spark, sf_dir), spark, sf_dir, "orders", 1, "xmin", "ymin")
        df = heights.estimate_heights(rows).select("osm_id", "xmin", "ymin", "xmax", "ymax", "max_height_m", "min_height_m")
        return cover.large_boxes(sized(df), part)

    return Layout(build, [part, "x0", "y0"], [], cells=1)


def _along_curve(df: DataFrame) -> DataFrame:
    """With the Morton key of the box's corner, so that neighbours lie together."""
    z = fx.XY_ZOOM
    return df.withColumn("key", keys.morton2d(keys.tile_x("xmin", z), keys.tile_y("ymin", z)))


def _cells(scheme: str, kind: str) -> Layout:
    source, n = ("events", len(fx.RESOLUTIONS[scheme])) if kind == "points" else ("orders", BOX_CELLS[scheme])

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, at = (fx.points, ("lon", "lat")) if kind == "points" else (fx.buildings, ("xmin", "ymin"))
        rows = dealt(rows(spark, sf_dir), spark, sf_dir, source, n, *at)
        if scheme == "hex":
            return cover.hex_cells(rows, fx.RESOLUTIONS[scheme], boxes=kind == "poly", name=False)
        if scheme == "geohash" and kind == "poly":
            placed = cover.lattice_box_places(rows, scheme, fx.RESOLUTIONS[scheme])
            return placed.select("osm_id", "resolution", cover.geohash_number().alias("key"))
        return (cover.point_cells if kind == "points" else cover.box_cells)(rows, scheme, fx.RESOLUTIONS[scheme])

    if scheme == "geohash" and kind == "poly":  # by number, which makes and sorts in less time than text
        text = lambda df: df.withColumn("cell", cover.geohash_text(F.col("key"), F.col("resolution")))
        return Layout(build, ["key"], ["resolution"], source, n, text, lambda: F.col("key"))
    by = "key" if scheme == "hex" else "cell"
    return Layout(build, [by], ["resolution"], source, n, number=(lambda: F.col(by)) if scheme in ("hex", "morton2d") else None)


def _obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights are read from tags after the buildings were dealt: not once to find the ranges and once more."""
    rows = dealt(fx.buildings(spark, sf_dir), spark, sf_dir, "orders", 1, "xmin", "ymin")
    return _along_curve(obstacles(spark, sf_dir, rows))


LAYOUTS = {f"cells_{s}_{k}": _cells(s, k) for s in fx.RESOLUTIONS for k in ("points", "poly")} | {
    "points_bbox": Layout(lambda spark, sf_dir: _along_curve(files.with_point_box(fx.points(spark, sf_dir))), ["key"], [], "events"),
    "poly_bbox": Layout(lambda spark, sf_dir: _along_curve(fx.buildings(spark, sf_dir)), ["key"], []),
    "obstacles": Layout(_obstacles, ["key"], [], cells=1, number=lambda: F.col("key")),
    "occupancy_zfxy": _occupancy("zfxy", ["f", "x", "y"], "zfxy_z"),
    "occupancy_zxy_heightbin": _occupancy("zxy_heightbin", ["hbin", "x", "y"], "vertical_bin_m"),
    "occupancy_morton3d": _occupancy("morton3d", ["key_u64"], "vertical_bin_m"),
    "large_zfxy": _large("zfxy_z", lambda df: cover.sized_zfxy(df, fx.ZFXY_ZOOMS).withColumnRenamed("z", "zfxy_z")),
    "large_zxy_heightbin": _large("vertical_bin_m", lambda df: cover.sized_bins(df, fx.XY_ZOOM, fx.BINS_M)),
}

#: Changes when what is written by the same names changes.
VERSION = 5

#: Tables that this driver reads: (application, folder) to table, and folder to origin.
_TABLES: dict[tuple[str, str], DataFrame] = {}
_ORIGINS: dict[str, tuple[int, int]] = {}


def root(spark: SparkSession) -> str:
    """Where stored tables lie: the folder that ``spark.cellarium.layouts.dir`` names, else one in
    the folder that all executors share. The next application finds them there."""
    named = spark.conf.get("spark.cellarium.layouts.dir", None)
    return named.rstrip("/") if named else f"{files.shared_folder(spark)}/cellarium-layouts"


def _digest(about: object) -> str:
    return hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()[:24]


def input_state(spark: SparkSession, sf_dir: str, source: str) -> str:
    """A digest of an input table's files: their names, sizes and times of change."""
    return _digest(files.listed(spark, f"{sf_dir}/{source}.parquet"))


def place(spark: SparkSession, sf_dir: str, name: str, rows: int) -> tuple[str, str]:
    """The folder of a table's versions, and that of the version for the input as it is now."""
    layout = LAYOUTS[name]
    version = _digest([VERSION, layout.by, layout.parts, rows, input_state(spark, sf_dir, layout.source)])
    above = f"{root(spark)}/{_digest(sf_dir)}/{name}-{rows}"
    return above, f"{above}/{version}"


def stored(spark: SparkSession, sf_dir: str, name: str, rows: int = files.ROW_GROUP_ROWS) -> DataFrame:
    """The stored table for the input as it is now.

    It is written where it isn't there yet, under a name of its own, and moved to its place when
    whole: who looks finds a whole version or none, and of two that write the same one, the
    first stays. A version belongs to the files of its input and to the layout; when either
    changes, the next call writes another, and versions of this table that are neither this
    nor the one before it are removed (the last one may still be read).
    """
    above, path = place(spark, sf_dir, name, rows)
    known = (spark.sparkContext.applicationId, path)
    if known not in _TABLES:
        if not files.exists(spark, path):
            layout, before = LAYOUTS[name], versions(spark, above)
            number = layout.number() if layout.number else None
            fresh = f"{above}/_writing-{uuid.uuid4().hex[:12]}"
            files.write_sorted(layout.build(spark, sf_dir), fresh, layout.by, layout.parts, rows, None, layout.cells > 0, number)
            if not files.renamed(spark, fresh, path):
                files.removed(spark, fresh)
            for old in [*before[:-1], *_left_over(spark, above)]:
                files.removed(spark, f"{above}/{old}")
        _TABLES[known] = LAYOUTS[name].derived(_read(spark, sf_dir, name, path))
    return _TABLES[known]


def _read(spark: SparkSession, sf_dir: str, name: str, path: str) -> DataFrame:
    """A version's rows. One in folders that holds no row has no file that could tell its columns: they are those of the build."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], LAYOUTS[name].build(spark, sf_dir).schema)


def _left_over(spark: SparkSession, above: str, seconds: float = 86_400) -> list[str]:
    """What writers that were lost have left: unfinished folders in which nothing has changed for a day."""
    last = lambda name: max((f[2] for f in files.listed(spark, f"{above}/{name}")), default=0)
    return [n for n in files.folders(spark, above) if n.startswith("_writing-") and last(n) < (time.time() - seconds) * 1000]


def versions(spark: SparkSession, above: str) -> list[str]:
    """The whole versions of a table, the oldest first."""
    names = [v for v in files.folders(spark, above) if not v.startswith("_")]
    return sorted(names, key=lambda v: max(f[2] for f in files.listed(spark, f"{above}/{v}")))


def stored_origin(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The origin of Morton keys from the file beside the layouts, written at first."""
    _, version = place(spark, sf_dir, "occupancy_morton3d", 0)
    path = f"{version}-meta"
    if path not in _ORIGINS:
        if not files.exists(spark, f"{path}/_SUCCESS"):
            x, y = origin_of(spark, sf_dir)
            files.write_metadata(spark, path, {"xy_z": fx.XY_ZOOM, "x_origin": x, "y_origin": y})
        _ORIGINS[path] = read_origin(spark, path)
    return _ORIGINS[path]


def read_origin(spark: SparkSession, path: str) -> tuple[int, int]:
    """The origin that a file names, (0, 0) where there is none."""
    from pyspark.errors import AnalysisException

    try:
        about = files.read_metadata(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, 0
    return about.get("x_origin", 0), about.get("y_origin", 0)
