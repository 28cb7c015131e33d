"""Covers: from points and boxes to cell tables, at several resolutions in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hexgrid, keys
from . import ranges

#: A box over more tiles, or of more cells in all, gets no cells.
XY_CAP, CELL_CAP = 200, 1000

OCCUPANCY = ["osm_id", "scheme", "xy_z", "zfxy_z", "vertical_bin_m", "x", "y", "f", "hbin", "key_text", "key_u64", "blocked"]


def each(df: DataFrame, name: str, values: list[int]) -> DataFrame:
    """A row for each value, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def tile_box(df: DataFrame, z: Column) -> DataFrame:
    """x0 <= x1, y0 <= y1: the tiles under xmin .. ymax; y runs south."""
    return tile_sides(df, keys.tile_x("xmin", z), keys.tile_x("xmax", z), keys.tile_y("ymax", z), keys.tile_y("ymin", z))


def tile_sides(df: DataFrame, xa: Column, xb: Column, ya: Column, yb: Column) -> DataFrame:
    return df.withColumns(
        {"x0": F.least(xa, xb), "x1": F.greatest(xa, xb), "y0": F.least(ya, yb), "y1": F.greatest(ya, yb)}
    )


def _sized(df: DataFrame, xy_cap: int, cell_cap: int) -> DataFrame:
    tiles = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    over = (tiles > xy_cap) | (tiles * (F.col("v1") - F.col("v0") + 1) > cell_cap)
    return df.withColumn("over", F.coalesce(over, F.lit(True)))


def sized_zfxy(obstacles: DataFrame, zooms: list[int], xy_cap: int = XY_CAP, cell_cap: int = CELL_CAP) -> DataFrame:
    """Obstacles at each zoom with their cell box and whether it is over a cap. What no zoom changes is
    computed before there is a row a zoom, where the optimizer can't write it out for each use,
    and each zoom comes with its power of two."""
    shares = {"_xa": keys.share_x("xmin"), "_xb": keys.share_x("xmax"), "_ya": keys.share_y("ymax"), "_yb": keys.share_y("ymin")}
    rows = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(float(2**z)).alias("_n")) for z in zooms])
    df = obstacles.withColumns(shares).select("*", F.inline(rows))
    n = F.col("_n")
    df = tile_sides(df, *[keys.column_of(c, n) for c in ("_xa", "_xb")], *[keys.row_of(c, n) for c in ("_ya", "_yb")])
    df = df.withColumns({"v0": keys.level_of("min_height_m", n), "v1": keys.level_of("max_height_m", n)}).drop("_n", *shares)
    return _sized(df, xy_cap, cell_cap)


def sized_bins(
    obstacles: DataFrame, xy_z: int, bins: list[int], xy_cap: int = XY_CAP, cell_cap: int = CELL_CAP
) -> DataFrame:
    df = tile_box(obstacles, F.lit(xy_z))
    df = each(df, "vertical_bin_m", bins).withColumns(
        {
            "v0": keys.height_bin("min_height_m", F.col("vertical_bin_m")),
            "v1": keys.height_bin("max_height_m", F.col("vertical_bin_m")),
        }
    )
    return _sized(df, xy_cap, cell_cap)


def _cells(sized: DataFrame) -> DataFrame:
    """x, y, v of all cells. Caps and reversed heights are dealt with before any row is
    made; the rows of an obstacle come from arrays of at most the cap."""
    fine = sized.where(~F.col("over") & (F.col("v0") <= F.col("v1")))
    for v in ("v", "x", "y"):
        fine = fine.withColumn(v, F.explode(F.sequence(f"{v}0", f"{v}1")))
    return fine


def large_boxes(sized: DataFrame, by: str) -> DataFrame:
    """The cell boxes of obstacles over a cap, which have no cells, for each value of ``by``: a row each,
    however large. Those without a place or with reversed heights meet nothing."""
    places = [F.col(f"{c}{k}").isNotNull() for c in ("x", "y") for k in (0, 1)]
    own = sized.where(reduce(lambda a, b: a & b, [F.col("over"), F.col("v0") <= F.col("v1"), *places]))
    return own.select("osm_id", by, "x0", "x1", "y0", "y1", "v0", "v1")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def occupancy_zfxy(obstacles: DataFrame, zooms: list[int]) -> DataFrame:
    """Cells of tile and level, both at each zoom."""
    df = _cells(sized_zfxy(obstacles, zooms))
    return df.select(
        "osm_id",
        F.lit("zfxy").alias("scheme"),
        F.col("z").alias("xy_z"),
        F.col("z").alias("zfxy_z"),
        _none("int").alias("vertical_bin_m"),
        "x",
        "y",
        F.col("v").alias("f"),
        _none("bigint").alias("hbin"),
        keys.path_key("z", "v", "x", "y").alias("key_text"),
        _none("bigint").alias("key_u64"),
        F.lit(True).alias("blocked"),
    )


def occupancy_bins(obstacles: DataFrame, xy_z: int, bins: list[int]) -> DataFrame:
    """Cells of tile and height bin, which are chosen apart."""
    df = _cells(sized_bins(obstacles, xy_z, bins))
    return df.select(
        "osm_id",
        F.lit("zxy_heightbin").alias("scheme"),
        F.lit(xy_z).alias("xy_z"),
        _none("int").alias("zfxy_z"),
        "vertical_bin_m",
        "x",
        "y",
        _none("bigint").alias("f"),
        F.col("v").alias("hbin"),
        keys.path_key(F.lit(xy_z), "x", "y", "vertical_bin_m", "v").alias("key_text"),
        _none("bigint").alias("key_u64"),
        F.lit(True).alias("blocked"),
    )


def morton_origin(obstacles: DataFrame, xy_z: int) -> DataFrame:
    """One row: the tile before the least x and y, so that local tile 0 holds nothing."""
    return obstacles.agg(F.min("xmin").alias("west"), F.max("ymax").alias("north")).select(
        F.lit(xy_z).alias("xy_z"),
        (keys.tile_x("west", xy_z) - 1).alias("x_origin"),
        (keys.tile_y("north", xy_z) - 1).alias("y_origin"),
    )


def occupancy_morton3d(obstacles: DataFrame, xy_z: int, bins: list[int], origin: tuple[int, int]) -> DataFrame:
    """Cells under one key of local tile and height bin."""
    df = _cells(sized_bins(obstacles, xy_z, bins))
    ox, oy = (F.lit(v).cast("bigint") for v in origin)
    lx, ly = F.col("x") - ox, F.col("y") - oy
    return df.select(
        "osm_id",
        F.lit("morton3d").alias("scheme"),
        F.lit(xy_z).alias("xy_z"),
        _none("int").alias("zfxy_z"),
        "vertical_bin_m",
        "x",
        "y",
        _none("bigint").alias("f"),
        F.col("v").alias("hbin"),
        keys.path_key("morton3d", lx, ly, "v").alias("key_text"),
        keys.morton3d(lx, ly, "v").alias("key_u64"),
        F.lit(True).alias("blocked"),
        ox.alias("x_origin"),
        oy.alias("y_origin"),
    )


def with_derived(cells: DataFrame, scheme: str, xy_z: int) -> DataFrame:
    """Stored cells with the columns of occupancy that follow from the others."""
    zfxy = scheme == "zfxy"
    have = set(cells.columns)
    z, v = (F.col("zfxy_z"), F.col("f")) if zfxy else (F.lit(xy_z), F.col("hbin"))
    more = {
        "scheme": F.lit(scheme), "xy_z": z, "zfxy_z": _none("int"), "vertical_bin_m": _none("int"), "f": _none("bigint"), "hbin": _none("bigint"),
        "key_text": keys.path_key(z, v, "x", "y") if zfxy else keys.path_key(z, "x", "y", "vertical_bin_m", v),
        "key_u64": _none("bigint"), "blocked": F.lit(True),
    }
    if scheme == "morton3d":  # its text has local tiles, whose bits the key holds
        lx, ly, _ = keys.morton3d_xyh("key_u64")
        more["key_text"] = keys.path_key("morton3d", lx, ly, v)
        more |= {"x_origin": F.col("x") - lx, "y_origin": F.col("y") - ly}
    return cells.select("*", *[c.alias(n) for n, c in more.items() if n not in have])


def skipped(sized: DataFrame, by: str) -> DataFrame:
    """How many obstacles are over a cap, for each value of ``by``."""
    return sized.groupBy(by).agg(F.count_if("over").alias("skipped"))


def point_cells(points: DataFrame, scheme: str, resolutions: list[int]) -> DataFrame:
    """A row for each point and resolution: geohash, quadkey, morton2d or hex.

    The places of all resolutions come from one scan; keys are made from them one level up,
    so that no expression holds a place many times over.
    """
    if scheme == "hex":
        return _hex_point_cells(points, resolutions)
    rows = F.array(*[F.struct(F.lit(r).alias("resolution"), *_place(scheme, r)) for r in resolutions])
    placed = points.select("osm_id", F.explode(rows).alias("c")).select("osm_id", "c.*")
    return placed.select("osm_id", "resolution", *lattice_key(scheme))


def _place(scheme: str, r: int) -> list[Column]:
    if scheme == "geohash":
        i, j = keys.geohash_ij("lat", "lon", r)
    else:
        i, j = keys.tile_x("lon", r), keys.tile_y("lat", r)
        if scheme == "quadkey":
            i, j = keys.clamp_tile(i, r), keys.clamp_tile(j, r)
    return [i.alias("i"), j.alias("j")]


def lattice_key(scheme: str) -> list[Column]:
    """The cell's key from the columns i, j and resolution."""
    i, j, r = F.col("i"), F.col("j"), F.col("resolution")
    if scheme == "morton2d":
        return [i.alias("local_x"), j.alias("local_y"), keys.morton2d(i, j).alias("cell")]
    if scheme == "quadkey":
        return [F.lpad(F.conv(keys.morton2d(i, j).cast("string"), 10, 4), r, F.lit("0")).alias("cell")]
    return [geohash_text(geohash_number(), r).alias("cell")]


def geohash_number() -> Column:
    """The number of a geohash cell from the columns i, j and resolution: of an even number of digits the first bit is of the other axis."""
    i, j = F.col("i"), F.col("j")
    return F.when(F.col("resolution") % 2 == 0, keys.morton2d(j, i)).otherwise(keys.morton2d(i, j))


def geohash_text(key: Column, r: Column) -> Column:
    code = F.lpad(F.conv(key.cast("string"), 10, 32), r, F.lit("0"))
    return F.translate(code, keys.BASE32_DIGITS, keys.GEOHASH_DIGITS)


def _on_face(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """p0, p1, p2 and face of a place, kept as columns for all that is built on them."""
    p = hexgrid.sphere(lat, lon)
    df = df.withColumns({f"p{k}": c for k, c in enumerate(p)})
    df = df.withColumn("_dots", hexgrid.face_products(tuple(F.col(f"p{k}") for k in range(3))))
    return df.withColumn("face", hexgrid.nearest_face("_dots")).drop("_dots")


def _in_lattice(df: DataFrame, r: int) -> DataFrame:
    """q and s of the cell of p0, p1, p2 on its face."""
    q, s = hexgrid.plane(tuple(F.col(f"p{k}") for k in range(3)), F.col("face"), r)
    df = df.withColumns({"_q": q, "_s": s})
    q, s = hexgrid.to_cell(F.col("_q"), F.col("_s"))
    return df.withColumns({"q": q, "s": s})


def _hex_point_cells(points: DataFrame, resolutions: list[int]) -> DataFrame:
    placed = _on_face(points, F.col("lat"), F.col("lon"))
    out = None
    for r in resolutions:
        part = _in_lattice(placed, r)
        part = hexgrid.named(part, r).select("osm_id", F.lit(r).alias("resolution"), "cell")
        out = part if out is None else out.unionByName(part)
    return out


def box_ranges(scheme: str, r: int) -> tuple[Column, Column, Column, Column]:
    """First and last column and row of the cells that cover xmin .. ymax."""
    if scheme == "geohash":  # cells that only touch the box count
        nx, ny = keys.geohash_bits(r)
        u = lambda c: (F.col(c) + 180) / 360.0 * float(2**nx)
        v = lambda c: (F.col(c) + 90) / 180.0 * float(2**ny)
        clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(2**n - 1))
        return (
            clamp(F.ceil(u("xmin")) - 1, nx), clamp(F.floor(u("xmax")), nx),
            clamp(F.ceil(v("ymin")) - 1, ny), clamp(F.floor(v("ymax")), ny),
        )
    edge = 1e-11 if scheme == "quadkey" else 0.0  # a box ending on a border stays on its side
    x0, x1 = keys.tile_x("xmin", r), keys.tile_x(F.col("xmax") - edge, r)
    y0, y1 = keys.tile_y("ymax", r), keys.tile_y(F.col("ymin") + edge, r)
    if scheme == "quadkey":
        x0, x1, y0, y1 = (keys.clamp_tile(c, r) for c in (x0, x1, y0, y1))
    return F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)


def box_ranges_at(scheme: str, r: int, box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """The same for a constant box (west, south, east, north): i0, i1, j0, j1."""
    west, south, east, north = box
    if scheme == "geohash":
        nx, ny = keys.geohash_bits(r)
        u = lambda v: (v + 180) / 360.0 * float(2**nx)
        v = lambda v: (v + 90) / 180.0 * float(2**ny)
        clamp = lambda c, n: min(max(c, 0), 2**n - 1)
        return (
            clamp(math.ceil(u(west)) - 1, nx), clamp(math.floor(u(east)), nx),
            clamp(math.ceil(v(south)) - 1, ny), clamp(math.floor(v(north)), ny),
        )
    edge = 1e-11 if scheme == "quadkey" else 0.0
    (x0, y0), (x1, y1) = keys.tile_at(west, north, r), keys.tile_at(east - edge, south + edge, r)
    if scheme == "quadkey":
        x0, x1, y0, y1 = (min(max(c, 0), 2**r - 1) for c in (x0, x1, y0, y1))
    return min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)


def cover_ranges(scheme: str, r: int, box: tuple[float, float, float, float]) -> list[tuple[int, int]]:
    """The cells over a constant box as ranges of their keys, as numbers: geohash, quadkey or
    morton2d. There are as many as the box has cells along its outline, not inside."""
    i0, i1, j0, j1 = box_ranges_at(scheme, r, box)
    if scheme == "geohash" and r % 2 == 0:  # its first bit is of the other axis then
        i0, i1, j0, j1 = j0, j1, i0, i1
    return ranges.box_ranges((i0, j0), (i1, j1))


def box_cells(boxes: DataFrame, scheme: str, resolutions: list[int], id_col: str = "osm_id") -> DataFrame:
    """A row for each box, resolution and covering cell."""
    if scheme == "hex":
        return hex_cells(boxes, resolutions, id_col, boxes=True)
    return lattice_box_places(boxes, scheme, resolutions, id_col).select(id_col, "resolution", *lattice_key(scheme))


def lattice_box_places(boxes: DataFrame, scheme: str, resolutions: list[int], id_col: str = "osm_id") -> DataFrame:
    """The column i and row j of the cells of each box, all resolutions from one scan."""
    sides = lambda r: [c.alias(n) for c, n in zip(box_ranges(scheme, r), ("x0", "x1", "y0", "y1"), strict=True)]
    rows = F.array(*[F.struct(F.lit(r).alias("resolution"), *sides(r)) for r in resolutions])
    df = boxes.select(id_col, F.explode(rows).alias("c")).select(id_col, "c.*")
    df = df.withColumn("i", F.explode(F.sequence("x0", "x1"))).withColumn("j", F.explode(F.sequence("y0", "y1")))
    return df.select(id_col, "resolution", "i", "j")


def hex_cells(df: DataFrame, resolutions: list[int], id_col: str = "osm_id", boxes: bool = False, name: bool = True) -> DataFrame:
    """``id_col``, resolution and ``cell`` (its name), or else ``key``, of points (lat, lon) or ``boxes``
    (xmin .. ymax), an Arrow batch at a time, all resolutions in one pass.

    Of a box the cells whose middle lies in it; if there is none, the cell of the box's middle. It
    is taken to lie on the face of its middle, as boxes of up to some degrees away from a face's
    edge do. Rows without a place have no cells.
    """
    places = ["xmin", "ymin", "xmax", "ymax"] if boxes else ["lat", "lon"]
    df = df.select(F.col(id_col), *[F.col(c).cast("double").alias(c) for c in places])
    # Not null, and neither NaN nor infinite, of which the difference from itself isn't 0
    df = df.where(reduce(lambda a, b: a & b, (F.col(c) - F.col(c) == 0 for c in places)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=-1)
            for r in resolutions if len(ids) else []:
                found = hexgrid.in_boxes(values, r) if boxes else [(None, *hexgrid.around(values[:, 0], values[:, 1], r))]
                for row, face, cell in found:
                    if not len(face):
                        continue
                    own, at = hexgrid.cells_of(face, cell, r, name)
                    out = [ids if row is None else ids.take(pa.array(row)), pa.array(np.full(len(face), r, np.int32)), pa.array(own).take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(out, ["id", "resolution", "cell"])

    kind = T.StructType([
        T.StructField(id_col, df.schema[0].dataType), T.StructField("resolution", T.IntegerType()),
        T.StructField("cell", T.StringType()) if name else T.StructField("key", T.LongType()),
    ])
    return df.mapInArrow(run, kind)


def _hex_candidates(boxes: DataFrame, r: int, ids: list[str]) -> DataFrame:
    """Cells of the face of a box's middle over the box and a little more, with the places of their middles."""
    df = boxes.select(*ids, "xmin", "ymin", "xmax", "ymax")
    df = _in_lattice(_on_face(df, (F.col("ymin") + F.col("ymax")) / 2, (F.col("xmin") + F.col("xmax")) / 2), r)
    corners = [
        hexgrid.plane(hexgrid.sphere(F.col(b), F.col(a)), F.col("face"), r) for a in ("xmin", "xmax") for b in ("ymin", "ymax")
    ]
    bound = lambda f, k, d: (F.floor(f(*[c[k] for c in corners])) + d).cast("long")
    df = df.select(
        *ids, "xmin", "ymin", "xmax", "ymax", "face", F.col("q").alias("mq"), F.col("s").alias("ms"),
        bound(F.least, 0, -1).alias("q0"), bound(F.greatest, 0, 2).alias("q1"),
        bound(F.least, 1, -1).alias("s0"), bound(F.greatest, 1, 2).alias("s1"),
    )
    df = df.withColumn("q", F.explode(F.sequence("q0", "q1"))).withColumn("s", F.explode(F.sequence("s0", "s1")))
    df = df.withColumns({f"p{k}": c for k, c in enumerate(hexgrid.centre(F.col("face"), F.col("q"), F.col("s"), r))})
    lat, lon = hexgrid.lat_lon(tuple(F.col(f"p{k}") for k in range(3)))
    return df.withColumns({"lat": lat, "lon": lon})


def polygon_edges(coordinates: Column) -> Column:
    """The edges (x1, y1, x2, y2) of all rings of a polygon's coordinates, as GeoJSON text has them."""
    rings = F.from_json(coordinates, "array<array<array<double>>>")
    at = lambda ring, k, axis: F.get(F.get(ring, k), F.lit(axis))
    edges = F.transform(
        rings,
        lambda ring: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(ring), F.lit(1))), lambda k: k < F.size(ring)),
            lambda k: F.struct(
                at(ring, k - 1, 0).alias("x1"), at(ring, k - 1, 1).alias("y1"), at(ring, k, 0).alias("x2"), at(ring, k, 1).alias("y2")
            ),
        ),
    )
    return F.flatten(edges)


def hex_polygon_cells(polygons: DataFrame, r: int, id_col: str = "osm_id", coordinates: str = "coordinates", band: float = 0.01, few: int = 4096) -> DataFrame:
    """Cells whose middle lies inside a polygon with holes (GeoJSON text of its coordinates), once each.

    A middle is inside if a ray to the east crosses an odd number of edges, of all rings. Polygons
    of up to ``few`` characters are done where they are, an Arrow batch at a time. Of larger ones
    middles and edges meet by the polygon and by bands of latitude, ``band`` degrees high, so that
    a polygon of many edges is no one group; they are shuffled, as their number isn't known
    beforehand. A polygon without a middle inside has no cells, as has one without coordinates.
    """
    keyed = polygons.select(F.col(id_col).alias("_id"), F.col(coordinates).alias("_rings"))
    small, large = (keyed.where(c) for c in (F.length("_rings") <= few, F.length("_rings") > few))
    out = _cells_of_small_polygons(small, r).unionByName(_cells_of_large_polygons(large, r, band))
    return out.select(F.col("_id").alias(id_col), F.lit(r).alias("resolution"), "cell").distinct()


def _cells_of_small_polygons(polygons: DataFrame, r: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy()
            ids, n = ids.filter(pa.array(n > 0)), n[n > 0]
            if not len(n):
                continue
            edges = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in lists.flatten().flatten()], axis=-1)
            at = np.cumsum(n) - n
            low, high = np.fmin.reduceat(edges[:, :2], at), np.fmax.reduceat(edges[:, :2], at)
            # A position without two numbers has no edge that is crossed, and an edge along a parallel is none.
            own = np.repeat(np.arange(len(n)), n)
            box = np.concatenate([low, high], axis=1)
            known = np.isfinite(box).all(axis=1)
            crossed = np.isfinite(edges).all(axis=1) & (edges[:, 1] != edges[:, 3]) & known[own]
            left = np.bincount(own[crossed], minlength=len(n))[known]
            ids, box = ids.filter(pa.array(known)), box[known]
            for row, face, cell in hexgrid.in_polygons(box, left, edges[crossed], r):
                names, back = hexgrid.cells_of(face, cell, r, name=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(back))], ["_id", "cell"])

    kind = T.StructType([T.StructField("_id", polygons.schema[0].dataType), T.StructField("cell", T.StringType())])
    return polygons.select("_id", polygon_edges(F.col("_rings")).alias("edges")).mapInArrow(run, kind)


def _cells_of_large_polygons(keyed: DataFrame, r: int, band: float) -> DataFrame:
    keyed = keyed.withColumn("_hash", F.xxhash64("_rings")).dropDuplicates(["_id", "_hash"]).withColumn("edges", polygon_edges(F.col("_rings")))
    bound = lambda f, c: f(F.transform("edges", lambda e: e[c]))
    boxes = keyed.where(F.size("edges") > 0).select(
        "_id", "_hash", bound(F.array_min, "x1").alias("xmin"), bound(F.array_min, "y1").alias("ymin"),
        bound(F.array_max, "x1").alias("xmax"), bound(F.array_max, "y1").alias("ymax"),
    )
    near = _hex_candidates(boxes, r, ["_id", "_hash"])
    near = near.where(F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax")))
    near = near.select("_id", "_hash", "face", "q", "s", "lat", "lon", F.floor(F.col("lat") / band).alias("_band"))
    edges = keyed.select("_id", "_hash", F.inline("edges")).where(F.col("y1") != F.col("y2"))
    low, high = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    edges = edges.withColumn("_band", F.explode(F.sequence(low, high)))
    a, e = near.alias("a"), edges.alias("e")
    lat, lon = F.col("a.lat"), F.col("a.lon")
    crosses = ((F.col("e.y1") > lat) != (F.col("e.y2") > lat)) & (
        lon < (F.col("e.x2") - F.col("e.x1")) * (lat - F.col("e.y1")) / (F.col("e.y2") - F.col("e.y1")) + F.col("e.x1")
    )
    same = F.col("a._id").eqNullSafe(F.col("e._id")) & (F.col("a._hash") == F.col("e._hash")) & (F.col("a._band") == F.col("e._band"))
    crossed = a.join(e.hint("merge"), same & crosses).select("a._id", "a._hash", "a.face", "a.q", "a.s")
    inside = crossed.groupBy("_id", "_hash", "face", "q", "s").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1)
    return hexgrid.named(inside, r).select("_id", "cell")


def hex_disk(points: DataFrame, r: int, k: int, id_col: str = "osm_id") -> DataFrame:
    """The 3k(k + 1) + 1 cells up to k steps from each point's cell."""
    df = _in_lattice(_on_face(points.select(id_col, "lat", "lon"), F.col("lat"), F.col("lon")), r)
    side = F.sequence(F.lit(-k), F.lit(k))
    df = df.select(id_col, "face", "q", "s", F.explode(side).alias("a")).withColumn("b", F.explode(side))
    df = df.where(F.abs(F.col("a") + F.col("b")) <= k)
    df = df.select(id_col, "face", (F.col("q") + F.col("a")).alias("q"), (F.col("s") + F.col("b")).alias("s"))
    return hexgrid.named(df, r).select(id_col, F.lit(r).alias("resolution"), "cell")
