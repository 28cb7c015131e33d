"""The spatial queries by name, each over whole tables, and the SQL each must equal."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import heights, hexgrid, keys, wkb
from ..operators import cover, lookup, ranges, report, route
from ..sources import files, geojson, geoparquet
from . import fixtures as fx
from . import hexsql, layouts, templates
from . import oracle as sql
from .layouts import obstacles, occupancy, origin_of, stored, stored_origin

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
Z = fx.XY_ZOOM


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


# Keys


@query("tile_xy", f"WITH {sql.POINTS} SELECT osm_id, {sql.x('lon', Z)} AS x, {sql.y('lat', Z)} AS y FROM points")
def tile_xy(spark, sf_dir):
    return fx.points(spark, sf_dir).select("osm_id", keys.tile_x("lon", Z).alias("x"), keys.tile_y("lat", Z).alias("y"))


@query(
    "zfxy_keys",
    f"""WITH {sql.OBSTACLES}, k AS (SELECT osm_id, z, {sql.level('max_height_m', 'z')} AS f, {sql.x('xmin', 'z')} AS x,
      {sql.y('ymin', 'z')} AS y FROM obstacles, (VALUES (19), (20), (21), (22)) t(z))
    SELECT *, z || '/' || f || '/' || x || '/' || y AS key_text FROM k""",
)
def zfxy_keys(spark, sf_dir):
    df = cover.each(obstacles(spark, sf_dir), "z", fx.ZFXY_ZOOMS)
    z = F.col("z")
    df = df.select(
        "osm_id", "z", keys.level("max_height_m", z).alias("f"), keys.tile_x("xmin", z).alias("x"), keys.tile_y("ymin", z).alias("y")
    )
    return df.withColumn("key_text", keys.path_key("z", "f", "x", "y"))


@query(
    "zxy_keys",
    f"""WITH {sql.OBSTACLES}, k AS (SELECT osm_id, {sql.x('xmin', Z)} AS x, {sql.y('ymin', Z)} AS y,
      {sql.hbin('max_height_m', 4)} AS hbin FROM obstacles)
    SELECT *, '19/' || x || '/' || y || '/4/' || hbin AS key_text FROM k""",
)
def zxy_keys(spark, sf_dir):
    df = obstacles(spark, sf_dir).select(
        "osm_id", keys.tile_x("xmin", Z).alias("x"), keys.tile_y("ymin", Z).alias("y"), keys.height_bin("max_height_m", 4).alias("hbin")
    )
    return df.withColumn("key_text", keys.path_key(F.lit(Z), "x", "y", F.lit(4), "hbin"))


@query(
    "morton2d_keys",
    f"WITH {sql.POINTS}, t AS (SELECT osm_id, {sql.x('lon', Z)} AS x, {sql.y('lat', Z)} AS y FROM points) "
    f"SELECT *, {sql.morton2('x', 'y')} AS key FROM t",
)
def morton2d_keys(spark, sf_dir):
    df = fx.points(spark, sf_dir).select("osm_id", keys.tile_x("lon", Z).alias("x"), keys.tile_y("lat", Z).alias("y"))
    return df.withColumn("key", keys.morton2d("x", "y"))


ORIGIN_SQL = f"SELECT {sql.x('min(xmin)', Z)} - 1 AS x_origin, {sql.y('max(ymax)', Z)} - 1 AS y_origin FROM buildings"


@query("morton_origin", f"WITH {sql.BUILDINGS} SELECT 19 AS xy_z, * FROM ({ORIGIN_SQL}) o")
def morton_origin(spark, sf_dir):
    return cover.morton_origin(fx.buildings(spark, sf_dir), Z)


@query(
    "morton3d_keys",
    f"""WITH {sql.OBSTACLES}, o AS ({ORIGIN_SQL}), t AS (SELECT osm_id, {sql.x('xmin', Z)} - x_origin AS local_x,
      {sql.y('ymin', Z)} - y_origin AS local_y, {sql.hbin('max_height_m', 4)} AS hbin FROM obstacles, o)
    SELECT *, {sql.morton3('local_x', 'local_y', 'hbin')} AS key FROM t""",
)
def morton3d_keys(spark, sf_dir):
    df = obstacles(spark, sf_dir)
    ox, oy = origin_of(spark, sf_dir)
    df = df.select(
        "osm_id", (keys.tile_x("xmin", Z) - ox).alias("local_x"), (keys.tile_y("ymin", Z) - oy).alias("local_y"),
        keys.height_bin("max_height_m", 4).alias("hbin"),
    )
    return df.withColumn("key", keys.morton3d("local_x", "local_y", "hbin"))


def point_key_sql(scheme: str, r: int) -> str:
    if scheme == "geohash":
        ij = f"SELECT osm_id, {sql.geohash_i('lon', r)} AS i, {sql.geohash_j('lat', r)} AS j FROM points"
        return f"SELECT osm_id, {r} AS resolution, {sql.geohash('i', 'j', r)} AS cell FROM ({ij}) p"
    if scheme == "quadkey":
        ij = f"SELECT osm_id, {sql.quadkey_x('lon', r)} AS i, {sql.quadkey_y('lat', r)} AS j FROM points"
        return f"SELECT osm_id, {r} AS resolution, {sql.quadkey('i', 'j', r)} AS cell FROM ({ij}) p"
    ij = f"SELECT osm_id, {sql.x('lon', r)} AS i, {sql.y('lat', r)} AS j FROM points"
    return f"SELECT osm_id, {r} AS resolution, i AS local_x, j AS local_y, {sql.morton2('i', 'j')} AS cell FROM ({ij}) p"


def box_key_sql(scheme: str, r: int, source: str = "buildings", id_col: str = "osm_id") -> str:
    if scheme == "geohash":
        i0, i1 = sql.geohash_i("xmin", r), sql.geohash_i("xmax", r, last=True)
        j0, j1 = sql.geohash_j("ymin", r), sql.geohash_j("ymax", r, last=True)
        key = sql.geohash("i", "j", r)
    elif scheme == "quadkey":  # a box that ends on a border stays on its side
        i0, i1 = sql.quadkey_x("xmin", r), sql.quadkey_x("(xmax - 1e-11)", r)
        j0, j1 = sql.quadkey_y("ymax", r), sql.quadkey_y("(ymin + 1e-11)", r)
        key = sql.quadkey("i", "j", r)
    else:
        i0, i1, j0, j1 = sql.x("xmin", r), sql.x("xmax", r), sql.y("ymax", r), sql.y("ymin", r)
        key = sql.morton2("i", "j")
    more = "i AS local_x, j AS local_y, " if scheme == "morton2d" else ""
    return f"""SELECT {id_col}, {r} AS resolution, {more}{key} AS cell
      FROM (SELECT {id_col}, {i0} AS i0, {i1} AS i1, {j0} AS j0, {j1} AS j1 FROM {source}) s,
        LATERAL (SELECT unnest(range(i0, i1 + 1)) AS i) a, LATERAL (SELECT unnest(range(j0, j1 + 1)) AS j) b"""


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def _point_query(scheme: str, r: int):
    @query(f"{scheme}_points_{r}", f"WITH {sql.POINTS} SELECT osm_id, cell FROM ({point_key_sql(scheme, r)}) k")
    def run(spark, sf_dir):
        return cover.point_cells(fx.points(spark, sf_dir), scheme, [r]).select("osm_id", "cell")


for _r in fx.RESOLUTIONS["geohash"]:
    _point_query("geohash", _r)
for _r in fx.RESOLUTIONS["quadkey"]:
    _point_query("quadkey", _r)


@query(
    "morton2d_points",
    f"WITH {sql.POINTS} {point_key_sql('morton2d', Z)}",
)
def morton2d_points(spark, sf_dir):
    return cover.point_cells(fx.points(spark, sf_dir), "morton2d", [Z])


def _poly_query(scheme: str):
    parts = _union([box_key_sql(scheme, r) for r in fx.RESOLUTIONS[scheme]])

    @query(f"poly_cells_{scheme}", f"WITH {sql.BUILDINGS} {parts}")
    def run(spark, sf_dir):
        return cover.box_cells(fx.buildings(spark, sf_dir), scheme, fx.RESOLUTIONS[scheme])


for _s in ("geohash", "quadkey", "morton2d"):
    _poly_query(_s)

# Heights


@query("height_parse", f"WITH {sql.BUILDINGS} SELECT osm_id, height, {sql.height('height')} AS height_m FROM buildings")
def height_parse(spark, sf_dir):
    return fx.buildings(spark, sf_dir).select("osm_id", "height", heights.parse_height_m(F.col("height")).alias("height_m"))


@query(
    "levels_parse",
    f"WITH {sql.BUILDINGS} SELECT osm_id, building_levels, {sql.levels('building_levels')} AS levels FROM buildings",
)
def levels_parse(spark, sf_dir):
    return fx.buildings(spark, sf_dir).select("osm_id", "building_levels", heights.parse_levels("building_levels").alias("levels"))


@query(
    "height_estimate",
    f"WITH {sql.OBSTACLES} SELECT osm_id, max_height_m, min_height_m, height_source, levels, min_level FROM obstacles",
)
def height_estimate(spark, sf_dir):
    return obstacles(spark, sf_dir).select("osm_id", "max_height_m", "min_height_m", "height_source", "levels", "min_level")


@query(
    "height_source_stats",
    f"""WITH {sql.OBSTACLES} SELECT count(*) AS total, count(*) FILTER (height_source = 'height') AS from_height,
      count(*) FILTER (height_source = 'building:levels_estimated') AS from_levels,
      count(*) FILTER (height_source = 'default_15m') AS from_default, min(max_height_m) AS min_max_height,
      max(max_height_m) AS max_max_height, median(max_height_m) AS median_max_height FROM obstacles""",
)
def height_source_stats(spark, sf_dir):
    return heights.height_quality(obstacles(spark, sf_dir))


@query(
    "obstacles_bbox",
    f"WITH {sql.OBSTACLES} SELECT osm_id, xmin, ymin, xmax, ymax, min_height_m AS zmin, max_height_m AS zmax FROM obstacles",
)
def obstacles_bbox(spark, sf_dir):
    return obstacles(spark, sf_dir).select(
        "osm_id", "xmin", "ymin", "xmax", "ymax", F.col("min_height_m").alias("zmin"), F.col("max_height_m").alias("zmax")
    )


@query(
    "envelope_points",
    f"WITH {sql.POINTS} SELECT * FROM points WHERE lon > 139.76 AND lon < 139.82 AND lat > 35.69 AND lat < 35.74",
)
def envelope_points(spark, sf_dir):
    return files.within_envelope(fx.points(spark, sf_dir), (139.76, 35.69, 139.82, 35.74))


# Occupancy


def _occupancy_sql(scheme: str) -> str:
    if scheme == "zfxy":
        head = f"WITH {sql.OBSTACLES}, {sql.sized_zfxy(fx.ZFXY_ZOOMS)}"
        return f"""{head} SELECT osm_id, 'zfxy' AS scheme, z AS xy_z, z AS zfxy_z, CAST(NULL AS INT) AS vertical_bin_m, x, y,
          h AS f, CAST(NULL AS BIGINT) AS hbin, z || '/' || h || '/' || x || '/' || y AS key_text,
          CAST(NULL AS BIGINT) AS key_u64, true AS blocked FROM cells"""
    head = f"WITH {sql.OBSTACLES}, {sql.sized_bins(Z, fx.BINS_M)}"
    base = """osm_id, '{s}' AS scheme, 19 AS xy_z, CAST(NULL AS INT) AS zfxy_z, v AS vertical_bin_m, x, y,
      CAST(NULL AS BIGINT) AS f, h AS hbin"""
    if scheme == "zxy_heightbin":
        return f"""{head} SELECT {base.format(s=scheme)}, '19/' || x || '/' || y || '/' || v || '/' || h AS key_text,
          CAST(NULL AS BIGINT) AS key_u64, true AS blocked FROM cells"""
    return f"""{head}, o AS ({ORIGIN_SQL}) SELECT {base.format(s=scheme)},
      'morton3d/' || (x - x_origin) || '/' || (y - y_origin) || '/' || h AS key_text,
      {sql.morton3('(x - x_origin)', '(y - y_origin)', 'h')} AS key_u64, true AS blocked, x_origin, y_origin FROM cells, o"""


SCHEMES = ["zfxy", "zxy_heightbin", "morton3d"]


def _occupancy_query(scheme: str):
    @query(f"occupancy_{scheme}", _occupancy_sql(scheme))
    def run(spark, sf_dir):
        return occupancy(spark, sf_dir, scheme)


for _s in SCHEMES:
    _occupancy_query(_s)


@query(
    "occupancy_skipped",
    f"""SELECT 'zfxy' AS scheme, * FROM (WITH {sql.OBSTACLES}, {sql.sized_zfxy(fx.ZFXY_ZOOMS)}
      SELECT z AS resolution, count(*) FILTER (over) AS skipped FROM sized GROUP BY z) a
    UNION ALL SELECT 'zxy_heightbin', * FROM (WITH {sql.OBSTACLES}, {sql.sized_bins(Z, fx.BINS_M)}
      SELECT v, count(*) FILTER (over) FROM sized GROUP BY v) b""",
)
def occupancy_skipped(spark, sf_dir):
    df = obstacles(spark, sf_dir)
    named = lambda d, by, s: cover.skipped(d, by).select(F.lit(s).alias("scheme"), F.col(by).alias("resolution"), "skipped")
    return named(cover.sized_zfxy(df, fx.ZFXY_ZOOMS), "z", "zfxy").unionByName(
        named(cover.sized_bins(df, Z, fx.BINS_M), "vertical_bin_m", "zxy_heightbin")
    )


@query(
    "multi_resolution_union",
    f"""SELECT scheme, coalesce(zfxy_z, vertical_bin_m) AS resolution, count(*) AS cells, count(DISTINCT osm_id) AS buildings
    FROM ((SELECT scheme, zfxy_z, vertical_bin_m, osm_id FROM ({_occupancy_sql('zfxy')}) a)
      UNION ALL (SELECT scheme, zfxy_z, vertical_bin_m, osm_id FROM ({_occupancy_sql('zxy_heightbin')}) b)
      UNION ALL (SELECT scheme, zfxy_z, vertical_bin_m, osm_id FROM ({_occupancy_sql('morton3d')}) c)) u
    GROUP BY ALL""",
)
def multi_resolution_union(spark, sf_dir):
    parts = [occupancy(spark, sf_dir, s) for s in SCHEMES]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return both.groupBy("scheme", F.coalesce("zfxy_z", "vertical_bin_m").alias("resolution")).agg(
        F.count("*").alias("cells"), F.count_distinct("osm_id").alias("buildings")
    )


# Viewports


def box_frame(spark: SparkSession, side: float) -> DataFrame:
    w, s, e, n = fx.viewport(side)
    return spark.range(1).select(
        F.lit("box").alias("case"), F.lit(w).alias("xmin"), F.lit(s).alias("ymin"), F.lit(e).alias("xmax"), F.lit(n).alias("ymax")
    )


def _viewport_sql(scheme: str, kind: str, side: float) -> str:
    w, s, e, n = fx.viewport(side)
    box = f"box AS (SELECT 'box' AS \"case\", {w!r}::DOUBLE AS xmin, {s!r}::DOUBLE AS ymin, {e!r}::DOUBLE AS xmax, {n!r}::DOUBLE AS ymax)"
    head = f"WITH {sql.POINTS if kind == 'points' else sql.BUILDINGS}, {box}"
    if scheme == "bbox":
        if kind == "points":
            return f"{head} SELECT osm_id FROM points, box WHERE lon >= xmin AND lon <= xmax AND lat >= ymin AND lat <= ymax"
        return f"""{head} SELECT b.osm_id FROM buildings b, box v
          WHERE NOT (b.xmax < v.xmin OR b.xmin > v.xmax OR b.ymax < v.ymin OR b.ymin > v.ymax)"""
    found = []
    if scheme == "hex":
        head = f"{head}, {hexsql.FACES}"
    for r in fx.RESOLUTIONS[scheme]:
        if scheme == "hex":
            table = hexsql.point_cells("points", r) if kind == "points" else hexsql.box_cells("buildings", r)
            cells = hexsql.box_cells("box", r, '"case"')
            found.append(f"SELECT DISTINCT {r} AS resolution, osm_id FROM ({table}) t WHERE cell IN (SELECT cell FROM ({cells}) c)")
            continue
        table = point_key_sql(scheme, r) if kind == "points" else box_key_sql(scheme, r)
        cells = box_key_sql(scheme, r, "box", '"case"')
        if scheme == "morton2d":
            near = sql.merged(f"(SELECT \"case\", cell AS key FROM ({cells}) c)", '"case"', 4)
            found.append(
                f"SELECT DISTINCT {r} AS resolution, osm_id FROM ({table}) t JOIN ({near}) m ON t.cell BETWEEN m.lo AND m.hi"
            )
        else:
            found.append(f"SELECT DISTINCT {r} AS resolution, osm_id FROM ({table}) t WHERE cell IN (SELECT cell FROM ({cells}) c)")
    return f"{head} {_union(found)}"


def key_hits(table: DataFrame, key: str, found: list[tuple[int, int]]) -> DataFrame:
    """resolution and osm_id of rows whose key lies in constant ranges, a few of which, wide
    enough for all, are pushed to the scan."""
    near = ranges.constants(table.sparkSession, found, "lo long, hi long")
    table = table.where(ranges.within(key, ranges.outer(found)))
    hits = ranges.in_ranges(table, near, key, [], few=len(found) <= ranges.BROADCAST_RANGES, shift=ranges.block_shift(found))
    return hits.select("resolution", "osm_id")


def cell_hits(spark, sf_dir, scheme: str, kind: str, side: float, r: int) -> DataFrame:
    """resolution and osm_id of the stored cells over the viewport: one scan of a folder, with
    ranges that hold the cover pushed down."""
    table = stored(spark, sf_dir, f"cells_{scheme}_{kind}").where(F.col("resolution") == r)
    if scheme == "morton2d":
        return key_hits(table, "cell", viewport_ranges(r, side))
    if scheme == "hex":
        return key_hits(table, "key", ranges.merged(hexgrid.box_keys(fx.viewport(side), r)))
    if scheme == "geohash" and kind == "poly":
        return key_hits(table, "key", cover.cover_ranges(scheme, r, fx.viewport(side)))
    found, base = cover.cover_ranges(scheme, r, fx.viewport(side)), 32 if scheme == "geohash" else 4
    near = [(keys.text_of(lo, base, r), keys.text_of(hi, base, r)) for lo, hi in ranges.outer(found)]
    hits = ranges.in_text_ranges(table.where(ranges.within("cell", near)), found, "cell", base, r)
    return hits.select("resolution", "osm_id")


def viewport_by_cells(spark, sf_dir, scheme: str, kind: str, side: float) -> DataFrame:
    """resolution and osm_id, once each, at all resolutions of the scheme."""
    parts = [cell_hits(spark, sf_dir, scheme, kind, side, r) for r in fx.RESOLUTIONS[scheme]]
    hits = reduce(DataFrame.unionByName, parts)
    return hits if kind == "points" else hits.distinct()  # a point has one cell a resolution, and its id is unique


def viewport_ranges(z: int, side: float) -> list[tuple[int, int]]:
    x0, x1, y0, y1 = cover.box_ranges_at("morton2d", z, fx.viewport(side))
    return ranges.box_ranges((x0, y0), (x1, y1), 4)


def _viewport_query(scheme: str, kind: str, name: str, side: float):
    @query(f"viewport_{'h3' if scheme == 'hex' else scheme}_{kind}_{name}", _viewport_sql(scheme, kind, side))
    def run(spark, sf_dir):
        if scheme == "bbox" and kind == "points":
            return lookup.points_in_box(stored(spark, sf_dir, "points_bbox"), fx.viewport(side))
        if scheme == "bbox":
            return lookup.boxes_meeting(stored(spark, sf_dir, "poly_bbox"), fx.viewport(side))
        return viewport_by_cells(spark, sf_dir, scheme, kind, side)


for _s in ("geohash", "quadkey", "morton2d", "bbox", "hex"):
    for _k in ("points", "poly"):
        for _n, _side in fx.SIDES.items():
            _viewport_query(_s, _k, _n, _side)


@query("h3_points", f"WITH {sql.POINTS}, {hexsql.FACES} " + _union([hexsql.point_cells("points", r) for r in fx.RESOLUTIONS["hex"]]))
def h3_points(spark, sf_dir):
    return cover.point_cells(fx.points(spark, sf_dir), "hex", fx.RESOLUTIONS["hex"])


@query("h3_poly", f"WITH {sql.BUILDINGS}, {hexsql.FACES} " + _union([hexsql.box_cells("buildings", r) for r in fx.RESOLUTIONS["hex"]]))
def h3_poly(spark, sf_dir):
    return cover.box_cells(fx.buildings(spark, sf_dir), "hex", fx.RESOLUTIONS["hex"])


#: A polygon with a hole around each building's corner: a rhombus of two thousandths of a degree without a small square.
_OUTER = [(0.0, -0.002), (0.002, 0.0), (0.0, 0.002), (-0.002, 0.0), (0.0, -0.002)]
_HOLE = [(-0.0005, -0.0005), (-0.0005, 0.0005), (0.0005, 0.0005), (0.0005, -0.0005), (-0.0005, -0.0005)]


def _polygon_sql() -> str:
    edges = ", ".join(str((*a, *b)) for ring in (_OUTER, _HOLE) for a, b in zip(ring, ring[1:], strict=False))
    return f"""WITH {sql.BUILDINGS}, {hexsql.FACES},
      edges AS (SELECT osm_id, xmin + a AS x1, ymin + b AS y1, xmin + c AS x2, ymin + d AS y2
        FROM buildings, (SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM (VALUES {edges}) v(a, b, c, d)) v),
      polygons AS (SELECT osm_id, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM edges GROUP BY osm_id)
      SELECT DISTINCT * FROM ({hexsql.polygon_cells('polygons', 'edges', 10)}) p"""


@query("h3_polygon_cells", _polygon_sql())
def h3_polygon_cells(spark, sf_dir):
    """Hexagons of resolution 10 whose middle is inside a polygon with a hole around each building's corner."""
    point = lambda p: F.array(F.col("xmin") + p[0], F.col("ymin") + p[1])
    rings = F.array(*[F.array(*[point(p) for p in ring]) for ring in (_OUTER, _HOLE)])
    polygons = fx.buildings(spark, sf_dir).select("osm_id", F.to_json(rings).alias("coordinates"))
    return cover.hex_polygon_cells(polygons, 10)


def _radius_sql() -> str:
    middle = f"centre AS (SELECT 'c' AS \"case\", {fx.CENTRE_LON!r}::DOUBLE AS lon, {fx.CENTRE_LAT!r}::DOUBLE AS lat)"
    parts = []
    edges = {7: 1220, 8: 461, 9: 174, 10: 65}  # fixed values, written out again so that k has a count of its own
    for r in fx.RESOLUTIONS["hex"]:
        for radius in fx.RADII_M:
            k = max(1, -(-radius // edges[r]))
            disk = hexsql.disk_cells("centre", r, k, '"case"')
            parts.append(
                f"SELECT {radius} AS radius_m, {r} AS resolution, CAST(greatest(1, ceil({radius} / {edges[r]}.0)) AS INT) AS k, osm_id FROM ({hexsql.point_cells('points', r)}) t "
                f"WHERE cell IN (SELECT cell FROM ({disk}) d)"
            )
    return f"WITH {sql.POINTS}, {middle}, {hexsql.FACES} {_union(parts)}"


@query("h3_radius", _radius_sql())
def h3_radius(spark, sf_dir):
    """Points in the disks around the centre, for each radius and resolution."""
    parts = [radius_hits(stored(spark, sf_dir, "cells_hex_points"), r) for r in fx.RESOLUTIONS["hex"]]
    return reduce(DataFrame.unionByName, parts)  # a point has one cell, and a disk each cell once


def radius_hits(table: DataFrame, r: int, radii: list[int] = fx.RADII_M) -> DataFrame:
    """Points in the disks around the centre: one scan for all radii, with ranges of the widest pushed to it."""
    rows, widest = [], []
    for radius in radii:
        k = hexgrid.disk_steps(radius, r)
        found = ranges.merged(hexgrid.disk_keys(fx.CENTRE_LAT, fx.CENTRE_LON, r, k))
        rows += [(radius, k, lo, hi) for lo, hi in found]
        widest += found
    widest = ranges.merged_ranges(widest)
    disks = ranges.constants(table.sparkSession, rows, "radius_m int, k int, lo long, hi long")
    near = table.where((F.col("resolution") == r) & ranges.within("key", ranges.outer(widest)))
    few = len(rows) <= ranges.BROADCAST_RANGES
    hits = ranges.in_ranges(near, disks, "key", [], few=few, shift=ranges.block_shift(widest))
    return hits.select("radius_m", "resolution", "k", "osm_id")


# Morton ranges


#: The bounds of the buildings of each tile of zoom 15, as boxes to be looked up.
TILE_BOXES_SQL = f"""tiles AS (SELECT {sql.x('xmin', 15)} || '/' || {sql.y('ymin', 15)} AS "case", min(xmin) AS xmin,
  min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM buildings GROUP BY ALL)"""


@query(
    "morton2d_ranges",
    f"WITH {sql.BUILDINGS}, {TILE_BOXES_SQL}, cells AS (SELECT \"case\", cell AS key FROM ("
    + box_key_sql("morton2d", Z, "tiles", '"case"')
    + ") c) "
    + sql.merged("cells", '"case"', 4),
)
def morton2d_ranges(spark, sf_dir):
    case = F.concat_ws("/", keys.tile_x("xmin", 15).cast("string"), keys.tile_y("ymin", 15).cast("string"))
    bounds = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    boxes = cover.tile_box(fx.buildings(spark, sf_dir).groupBy(case.alias("case")).agg(*bounds), F.lit(Z))
    return ranges.ranges_of_boxes(boxes.select("case", "x0", "y0", "x1", "y1"), ["x0", "y0"], ["x1", "y1"], 4).select("case", "lo", "hi")


CASES_3D = [(f"{v}@{a}", v, a) for v in fx.BINS_M for a in fx.ALTITUDES_M]
W, S, E, N = fx.CORRIDOR
CASES_3D_SQL = f"""cases AS (SELECT * FROM ({sql.values(CASES_3D)}) t("case", v, alt)), keyed AS (
  SELECT "case", v, alt, {sql.morton3('(a.x - x_origin)', '(b.y - y_origin)', 'c.h')} AS key FROM cases, o,
    LATERAL (SELECT unnest(range({sql.x(repr(W), Z)}, {sql.x(repr(E), Z)} + 1)) AS x) a,
    LATERAL (SELECT unnest(range({sql.y(repr(N), Z)}, {sql.y(repr(S), Z)} + 1)) AS y) b,
    LATERAL (SELECT unnest(range({sql.hbin('alt - 5', 'v')}, {sql.hbin('alt + 5', 'v')} + 1)) AS h) c)"""


def corridor_boxes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', {v}, {a - fx.CLEARANCE_M}.0D, {a + fx.CLEARANCE_M}.0D)" for c, v, a in CASES_3D)
    return spark.sql(
        f"SELECT *, {W}D AS xmin, {S}D AS ymin, {E}D AS xmax, {N}D AS ymax FROM VALUES {rows} AS t(case, vertical_bin_m, low, high)"
    )


def corridor_ranges(origin: tuple[int, int]) -> list[tuple[str, int, int, int]]:
    """(case, bin, lo, hi) of the corridor's keys, which are constants of the query."""
    (x0, y0), (x1, y1) = keys.tile_at(W, N, Z), keys.tile_at(E, S, Z)
    clip = lambda v: min(max(v, 0), 2**keys.MORTON3D_BITS - 1)
    out = []
    for case, v, alt in CASES_3D:
        low = (x0 - origin[0], y0 - origin[1], int((alt - fx.CLEARANCE_M) // v))
        high = (x1 - origin[0], y1 - origin[1], int((alt + fx.CLEARANCE_M) // v))
        found = ranges.box_ranges(tuple(map(clip, low)), tuple(map(clip, high)), 4)
        out += [(case, v, lo, hi) for lo, hi in found]
    return out


@query(
    "morton3d_ranges",
    f"""WITH {sql.BUILDINGS}, o AS ({ORIGIN_SQL}), {CASES_3D_SQL}
    SELECT "case", lo, hi FROM ({sql.merged('keyed', '"case"', 4)}) m""",
)
def morton3d_ranges(spark, sf_dir):
    boxes = cover.tile_box(corridor_boxes(spark), F.lit(Z))
    ox, oy = origin_of(spark, sf_dir)
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(2**keys.MORTON3D_BITS - 1))
    boxes = boxes.select(
        "case",
        *[clip(F.col(f"x{k}") - ox).alias(f"x{k}") for k in (0, 1)],
        *[clip(F.col(f"y{k}") - oy).alias(f"y{k}") for k in (0, 1)],
        *[clip(keys.height_bin(c, F.col("vertical_bin_m"))).alias(n) for n, c in (("h0", "low"), ("h1", "high"))],
    )
    return ranges.ranges_of_boxes(boxes, ["x0", "y0", "h0"], ["x1", "y1", "h1"], 4).select("case", "lo", "hi")


# Corridors


def corridor_cases(scheme: str, box: tuple | None = None, only: list[int] | None = None) -> list[dict]:
    """Cell boxes of the corridor (or another tile box by zoom) at each resolution and altitude."""
    out = []
    for r in only or (fx.ZFXY_ZOOMS if scheme == "zfxy" else fx.BINS_M):
        z = r if scheme == "zfxy" else Z
        (x0, y0), (x1, y1) = (keys.tile_at(W, N, z), keys.tile_at(E, S, z)) if box is None else box(z)
        for alt in fx.ALTITUDES_M:
            low, high = alt - fx.CLEARANCE_M, alt + fx.CLEARANCE_M
            v = (keys.level_at(low, z), keys.level_at(high, z)) if scheme == "zfxy" else (int(low // r), int(high // r))
            same = {"zfxy_z": r} if scheme == "zfxy" else {"xy_z": Z, "vertical_bin_m": r}
            out.append({"case": f"{r}@{alt}", "altitude_m": alt, "x0": x0, "x1": x1, "y0": y0, "y1": y1, "v0": v[0], "v1": v[1], **same})
    return out


PART = {"zfxy": "zfxy_z", "zxy_heightbin": "vertical_bin_m", "morton3d": "vertical_bin_m"}
HEIGHT = {"zfxy": "f", "zxy_heightbin": "hbin"}


def corridor_hits(spark, sf_dir, scheme: str) -> tuple[DataFrame, list[str]]:
    """(case, osm_id) of stored occupancy cells in the corridor, and the names of the cases."""
    table = stored(spark, sf_dir, f"occupancy_{scheme}")
    if scheme != "morton3d":
        cases = corridor_cases(scheme)
        hits = lookup.in_cell_boxes(
            table, cases, PART[scheme], {"x": ("x0", "x1"), "y": ("y0", "y1"), HEIGHT[scheme]: ("v0", "v1")}
        )
        return hits.select("case", "osm_id"), [c["case"] for c in cases]
    found, out = corridor_ranges(stored_origin(spark, sf_dir)), None
    for v in fx.BINS_M:
        own = [(case, lo, hi) for case, bin_m, lo, hi in found if bin_m == v]
        pushed = ranges.outer(ranges.merged_ranges([(lo, hi) for _, lo, hi in own]))
        rows = table.where((F.col("vertical_bin_m") == v) & ranges.within("key_u64", pushed))
        near = ranges.constants(spark, own, "case string, lo long, hi long")
        few = len(own) <= ranges.BROADCAST_RANGES
        hits = ranges.in_ranges(rows, near, "key_u64", [], few=few).select("case", "osm_id")
        out = hits if out is None else out.unionByName(hits)
    return out, [case for case, _, _ in CASES_3D]


def _hits_sql(scheme: str) -> str:
    alts = ", ".join(f"({a})" for a in fx.ALTITUDES_M)
    if scheme == "zfxy":
        return f"""WITH {sql.OBSTACLES}, {sql.sized_zfxy(fx.ZFXY_ZOOMS)}, alts(alt) AS (VALUES {alts}),
          cases AS (SELECT DISTINCT z || '@' || alt AS "case" FROM cells, alts),
          hits AS (SELECT z || '@' || alt AS "case", osm_id, x, y FROM cells, alts
            WHERE x BETWEEN {sql.x(repr(W), 'z')} AND {sql.x(repr(E), 'z')} AND y BETWEEN {sql.y(repr(N), 'z')} AND {sql.y(repr(S), 'z')}
              AND h BETWEEN {sql.level('alt - 5', 'z')} AND {sql.level('alt + 5', 'z')})"""
    if scheme == "zxy_heightbin":
        return f"""WITH {sql.OBSTACLES}, {sql.sized_bins(Z, fx.BINS_M)}, alts(alt) AS (VALUES {alts}),
          cases AS (SELECT DISTINCT v || '@' || alt AS "case" FROM cells, alts),
          hits AS (SELECT v || '@' || alt AS "case", osm_id, x, y FROM cells, alts
            WHERE x BETWEEN {sql.x(repr(W), Z)} AND {sql.x(repr(E), Z)} AND y BETWEEN {sql.y(repr(N), Z)} AND {sql.y(repr(S), Z)}
              AND h BETWEEN {sql.hbin('alt - 5', 'v')} AND {sql.hbin('alt + 5', 'v')})"""
    near = sql.merged("keyed", '"case", v', 4)
    return f"""WITH {sql.OBSTACLES}, {sql.sized_bins(Z, fx.BINS_M)}, o AS ({ORIGIN_SQL}), {CASES_3D_SQL},
      placed AS (SELECT osm_id, v, {sql.morton3('(x - x_origin)', '(y - y_origin)', 'h')} AS key FROM cells, o),
      near AS ({near}),
      hits AS (SELECT n."case", p.osm_id FROM placed p JOIN near n ON p.v = n.v AND p.key BETWEEN n.lo AND n.hi)"""


def _corridor_query(scheme: str):
    @query(
        f"corridor_{scheme}",
        f"""{_hits_sql(scheme)} SELECT c."case", count(h.osm_id) AS candidate_cells, count(DISTINCT h.osm_id) AS candidate_buildings
        FROM cases c LEFT JOIN hits h ON c."case" = h."case" GROUP BY c."case" """,
    )
    def run(spark, sf_dir):
        return lookup.candidates(*corridor_hits(spark, sf_dir, scheme))

    @query(f"corridor_distinct_{scheme}", f'{_hits_sql(scheme)} SELECT DISTINCT "case", osm_id FROM hits')
    def run_distinct(spark, sf_dir):
        return corridor_hits(spark, sf_dir, scheme)[0].distinct()


for _s in SCHEMES:
    _corridor_query(_s)

ACTUAL_SQL = f"""SELECT alt AS altitude_m, count(*) FILTER (xmin <= {E} AND xmax >= {W} AND ymin <= {N} AND ymax >= {S}
  AND max_height_m >= alt - 5 AND min_height_m <= alt + 5) AS actual FROM obstacles, alts GROUP BY alt"""


def actual_counts(spark, sf_dir) -> DataFrame:
    df = stored(spark, sf_dir, "obstacles")
    # What every altitude asks for goes to the scan; the counts then tell them apart.
    low, high = min(fx.ALTITUDES_M) - fx.CLEARANCE_M, max(fx.ALTITUDES_M) + fx.CLEARANCE_M
    df = df.where(lookup.blocking(df, fx.CORRIDOR, F.lit(float(low)), F.lit(float(high))))
    row = F.array(
        *[
            F.struct(
                F.lit(a).alias("altitude_m"),
                F.count_if(lookup.blocking(df, fx.CORRIDOR, F.lit(a - fx.CLEARANCE_M), F.lit(a + fx.CLEARANCE_M))).alias("actual"),
            )
            for a in fx.ALTITUDES_M
        ]
    )
    return df.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("actual_blocking", f"WITH {sql.OBSTACLES}, alts(alt) AS (VALUES (5), (30), (45), (60)) {ACTUAL_SQL}")
def actual_blocking(spark, sf_dir):
    return actual_counts(spark, sf_dir)


@query(
    "false_positive_rate",
    f"""{_hits_sql('zxy_heightbin')}, actual AS ({ACTUAL_SQL}), counted AS (
      SELECT c."case", count(DISTINCT h.osm_id) AS candidate_buildings FROM cases c LEFT JOIN hits h ON c."case" = h."case" GROUP BY c."case")
    SELECT "case", candidate_buildings, actual, CASE WHEN candidate_buildings > 0
      THEN round((candidate_buildings - actual) / candidate_buildings * 100, 1) END AS false_positive_pct
    FROM counted JOIN actual ON altitude_m = CAST(string_split("case", '@')[2] AS INT)""",
)
def false_positive_rate(spark, sf_dir):
    counted = lookup.candidates(*corridor_hits(spark, sf_dir, "zxy_heightbin")).withColumn("altitude_m", F.split_part("case", F.lit("@"), F.lit(2)).cast("int"))
    joined = counted.join(F.broadcast(actual_counts(spark, sf_dir)), "altitude_m")  # a row an altitude
    rate = lookup.false_positive_rate(F.col("candidate_buildings"), F.col("actual"))
    return joined.select("case", "candidate_buildings", "actual", rate.alias("false_positive_pct"))


# The same lookups as SQL templates, a case each


def _template_sql(scheme: str, case: str, what: str = "osm_id") -> str:
    return f"{_hits_sql(scheme)} SELECT DISTINCT {what} FROM hits WHERE \"case\" = '{case}'"


@query("template_corridor_zfxy", _template_sql("zfxy", "21@30"))
def template_corridor_zfxy(spark, sf_dir):
    return templates.run(spark, sf_dir, "corridor_zfxy", z=21, altitude=30.0)


@query("template_corridor_zxy_heightbin", _template_sql("zxy_heightbin", "4@30"))
def template_corridor_zxy_heightbin(spark, sf_dir):
    return templates.run(spark, sf_dir, "corridor_zxy_heightbin", bin_m=4, altitude=30.0)


@query("template_corridor_morton3d", _template_sql("morton3d", "4@30"))
def template_corridor_morton3d(spark, sf_dir):
    found = [(lo, hi) for case, _, lo, hi in corridor_ranges(stored_origin(spark, sf_dir)) if case == "4@30"]
    firsts, lasts = map(list, zip(*found, strict=True))
    return templates.run(spark, sf_dir, "corridor_morton3d", bin_m=4, firsts=firsts, lasts=lasts)


@query("template_lookup_cells", _template_sql("zxy_heightbin", "4@45", "x, y"))
def template_lookup_cells(spark, sf_dir):
    return templates.run(spark, sf_dir, "lookup_cells", bin_m=4, altitude=45.0)


# Blocked cells and routes


def route_ends(z: int) -> tuple[tuple[int, int], tuple[int, int]]:
    return keys.tile_at(fx.CORRIDOR_LON, fx.SOUTH, z), keys.tile_at(fx.CORRIDOR_LON, fx.NORTH, z)


def blocked_cells(spark, sf_dir, scheme: str, only: list[int] | None = None, whole: bool = False) -> DataFrame:
    """Cells of the routes' boxes that obstacles are in. Those over a cap have no stored cells; with ``whole``
    theirs come from their stored boxes."""

    def box(z: int):
        c = route.route_case("", *route_ends(z))
        return (c["x0"], c["y0"]), (c["x1"], c["y1"])

    cases = corridor_cases(scheme, box, only)
    hits = lookup.in_cell_boxes(
        stored(spark, sf_dir, f"occupancy_{scheme}"), cases, PART[scheme],
        {"x": ("x0", "x1"), "y": ("y0", "y1"), HEIGHT[scheme]: ("v0", "v1")},
    ).select("case", "x", "y")
    if whole:
        hits = hits.unionByName(lookup.cells_of_boxes(stored(spark, sf_dir, f"large_{scheme}"), cases, PART[scheme]))
    return hits.distinct()


def routes(spark, sf_dir, scheme: str, only: list[int] | None = None, whole: bool = False) -> DataFrame:
    cases = [route.route_case(c["case"], *route_ends(c.get("zfxy_z", Z))) for c in corridor_cases(scheme, None, only)]
    fields = "case string, " + ", ".join(f"{k} long" for k in list(cases[0])[1:])
    table = ranges.constants(spark, [tuple(c.values()) for c in cases], fields)
    return route.find_routes(table, blocked_cells(spark, sf_dir, scheme, only, whole))


def _blocked_sql(scheme: str, only: list[int] | None = None) -> str:
    zooms, bins = only or fx.ZFXY_ZOOMS, only or fx.BINS_M
    alts = ", ".join(f"({a})" for a in fx.ALTITUDES_M)
    z, by = ("z", "z") if scheme == "zfxy" else (str(Z), "v")
    sized = sql.sized_zfxy(zooms) if scheme == "zfxy" else sql.sized_bins(Z, bins)
    h = lambda e: sql.level(e, "z") if scheme == "zfxy" else sql.hbin(e, "v")
    lon, south, north = (repr(v) for v in (fx.CORRIDOR_LON, fx.SOUTH, fx.NORTH))
    return f"""{sql.OBSTACLES}, {sized}, alts(alt) AS (VALUES {alts}),
      blocked AS (SELECT DISTINCT {by} || '@' || alt AS "case", x, y FROM cells, alts
        WHERE x BETWEEN {sql.x(lon, z)} - 2 AND {sql.x(lon, z)} + 2 AND y BETWEEN {sql.y(north, z)} - 2 AND {sql.y(south, z)} + 2
          AND h BETWEEN {h('alt - 5')} AND {h('alt + 5')})"""


def _route_sql(scheme: str, only: list[int]) -> str:
    """Breadth-first search that keeps each cell once, with the steps that first reached it."""
    lon, south, north = (repr(v) for v in (fx.CORRIDOR_LON, fx.SOUTH, fx.NORTH))
    names = ", ".join(f"('{r}@{a}', {r if scheme == 'zfxy' else Z})" for r in only for a in fx.ALTITUDES_M)
    return f"""WITH RECURSIVE {_blocked_sql(scheme, only)}, names("case", z) AS (VALUES {names}), cases AS (
        SELECT "case", {sql.x(lon, 'z')} AS sx, {sql.y(south, 'z')} AS sy, {sql.y(north, 'z')} AS gy FROM names),
      walk("case", x, y, d) USING KEY ("case", x, y) AS (
        SELECT "case", sx, sy, 0 FROM cases
        UNION SELECT w."case", w.x + s.dx, w.y + s.dy, w.d + 1 FROM walk w JOIN cases c ON w."case" = c."case",
          (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)
        WHERE w.x + s.dx BETWEEN c.sx - 2 AND c.sx + 2 AND w.y + s.dy BETWEEN c.gy - 2 AND c.sy + 2
          AND NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r."case" = w."case" AND r.x = w.x + s.dx AND r.y = w.y + s.dy)
          AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b."case" = w."case" AND b.x = w.x + s.dx AND b.y = w.y + s.dy))
    SELECT c."case", min(w.d) IS NOT NULL AS route_found, min(w.d) + 1 AS length,
      (SELECT count(*) FROM blocked b WHERE b."case" = c."case") AS lookup_count
    FROM cases c LEFT JOIN walk w ON w."case" = c."case" AND w.x = c.sx AND w.y = c.gy GROUP BY c."case" """


@query("blocked_zfxy", f"WITH {_blocked_sql('zfxy')} SELECT * FROM blocked")
def blocked_zfxy(spark, sf_dir):
    return blocked_cells(spark, sf_dir, "zfxy")


@query("blocked_zxy_heightbin", f"WITH {_blocked_sql('zxy_heightbin')} SELECT * FROM blocked")
def blocked_zxy_heightbin(spark, sf_dir):
    return blocked_cells(spark, sf_dir, "zxy_heightbin")


@query("route_zfxy", _route_sql("zfxy", [19]))
def route_zfxy(spark, sf_dir):
    return routes(spark, sf_dir, "zfxy", [19], whole=True)


@query("route_zfxy_fine", _route_sql("zfxy", [20, 21, 22]))
def route_zfxy_fine(spark, sf_dir):
    return routes(spark, sf_dir, "zfxy", [20, 21, 22])


@query("route_zxy_heightbin", _route_sql("zxy_heightbin", fx.BINS_M))
def route_zxy_heightbin(spark, sf_dir):
    return routes(spark, sf_dir, "zxy_heightbin", whole=True)


# Records of the benchmark: a row for each scheme, resolution and query


def _records(scheme: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, size, resolution, n_cells, n_ranges) of all queries of a scheme: constants."""
    out = []
    for kind in ("points", "poly"):
        for name, side in fx.SIDES.items():
            for r in fx.RESOLUTIONS.get(scheme, [0]):
                n, ranged = 0, 0
                if scheme == "hex":
                    n = len(hexgrid.box_names(fx.viewport(side), r))
                elif scheme != "bbox":
                    i0, i1, j0, j1 = cover.box_ranges_at(scheme, r, fx.viewport(side))
                    n, ranged = (i1 - i0 + 1) * (j1 - j0 + 1), len(viewport_ranges(r, side)) if scheme == "morton2d" else 0
                out.append((kind, name, r, n, ranged))
    if scheme == "hex":
        steps = [(m, r, hexgrid.disk_steps(m, r)) for m in fx.RADII_M for r in fx.RESOLUTIONS["hex"]]
        out += [("radius", str(m), r, 3 * k * (k + 1) + 1, 0) for m, r, k in steps]
    return out


def _matrix_sql(scheme: str) -> str:
    """Cells and ranges of each query are counted from its cover, its rows from its hits."""
    parts, covers = [], []
    for name, side in fx.SIDES.items():
        w, s, e, n = fx.viewport(side)
        box = f"(SELECT 'box' AS \"case\", {w!r}::DOUBLE AS xmin, {s!r}::DOUBLE AS ymin, {e!r}::DOUBLE AS xmax, {n!r}::DOUBLE AS ymax)"
        for r in fx.RESOLUTIONS.get(scheme, [0]):
            n_cells, n_ranges = "0", "0"
            if scheme != "bbox":
                cells = box_key_sql(scheme, r, box, '"case"')
                n_cells = f"(SELECT count(*) FROM ({cells}) c)"
                if scheme == "morton2d":
                    merged = sql.merged(f'(SELECT "case", cell AS key FROM ({cells}) c)', '"case"', 4)
                    n_ranges = f"(SELECT count(*) FROM ({merged}) m)"
            covers.append(f"SELECT '{name}' AS size, {r} AS resolution, {n_cells} AS n_cells, {n_ranges} AS n_ranges")
        for kind in ("points", "poly"):
            parts.append(
                f"SELECT '{kind}' AS kind, '{name}' AS size, {'0' if scheme == 'bbox' else 'resolution'} AS resolution, count(*) AS n "
                f"FROM ({_viewport_sql(scheme, kind, side)}) h GROUP BY ALL"
            )
    return f"""SELECT kind, size, resolution, n_cells, n_ranges, coalesce(n, 0) AS n_rows
      FROM (VALUES ('points'), ('poly')) k(kind) CROSS JOIN ({_union(covers)}) r LEFT JOIN ({_union(parts)}) c USING (kind, size, resolution)"""


def _matrix_query(scheme: str):
    # The hexagons' records repeat whole queries that have SQL of their own; theirs would take minutes.
    @query(f"matrix_{'h3' if scheme == 'hex' else scheme}", None if scheme == "hex" else _matrix_sql(scheme))
    def run(spark, sf_dir):
        # Counts a record: points have one cell a resolution, boxes several, so that only theirs
        # are made distinct, by a number of the record and the id.
        numbers, once, several = {}, [], []
        for n, record in enumerate(_records(scheme)):
            kind, size, r, *_ = record
            if kind == "radius":
                numbers[int(size), r] = n
                continue
            if scheme == "bbox":
                hits = QUERIES[f"viewport_bbox_{kind}_{size}"](spark, sf_dir)
            else:
                hits = cell_hits(spark, sf_dir, scheme, kind, fx.SIDES[size], r)
            hits = hits.select(F.lit(n).alias("record"), "osm_id")
            (once if kind == "points" or scheme == "bbox" else several).append(hits)
        if numbers:
            of = F.coalesce(*[F.when((F.col("radius_m") == m) & (F.col("resolution") == r), n) for (m, r), n in numbers.items()])
            once.append(h3_radius(spark, sf_dir).select(of.alias("record"), "osm_id"))
        if several:
            once.append(reduce(DataFrame.unionByName, several).distinct())
        rows = [(n, *record) for n, record in enumerate(_records(scheme))]
        records = ranges.constants(spark, rows, "record int, kind string, size string, resolution int, n_cells int, n_ranges int")
        counts = report.counted(reduce(DataFrame.unionByName, once), ["record"], records, False)
        return records.join(F.broadcast(counts), "record").drop("record")  # a row a record


for _s in ("geohash", "quadkey", "morton2d", "bbox", "hex"):
    _matrix_query(_s)


def _corridor_matrix_sql() -> str:
    parts = []
    for scheme in SCHEMES:
        n = "0"
        if scheme == "morton3d":
            near = sql.merged("keyed", '"case"', 4)
            n = f"""(SELECT count(*) FROM (WITH {sql.BUILDINGS}, o AS ({ORIGIN_SQL}), {CASES_3D_SQL} {near}) m WHERE m."case" = k."case")"""
        parts.append(
            f"""SELECT '{scheme}' AS scheme, k.*, {n} AS n_ranges FROM ({ORACLE_SQL[f'corridor_{scheme}']}) k"""
        )
    return f"""SELECT scheme, "case", candidate_cells, candidate_buildings, n_ranges, actual, CASE WHEN candidate_buildings > 0
        THEN round((candidate_buildings - actual) / candidate_buildings * 100, 1) END AS false_positive_pct
      FROM ({_union(parts)}) u JOIN ({ORACLE_SQL['actual_blocking']}) a ON altitude_m = CAST(string_split("case", '@')[2] AS INT)"""


@query("corridor_matrix", _corridor_matrix_sql())
def corridor_matrix(spark, sf_dir):
    parts = []
    for scheme in SCHEMES:
        counts: dict[str, int] = {}
        if scheme == "morton3d":
            for case, *_ in corridor_ranges(stored_origin(spark, sf_dir)):
                counts[case] = counts.get(case, 0) + 1
        n = F.coalesce(*[F.when(F.col("case") == c, k) for c, k in counts.items()], F.lit(0))
        found = lookup.candidates(*corridor_hits(spark, sf_dir, scheme))
        parts.append(found.select(F.lit(scheme).alias("scheme"), "*", n.alias("n_ranges")))
    all_cases = reduce(DataFrame.unionByName, parts)
    all_cases = all_cases.withColumn("altitude_m", F.split_part("case", F.lit("@"), F.lit(2)).cast("int"))
    joined = all_cases.join(F.broadcast(actual_counts(spark, sf_dir)), "altitude_m")  # a row an altitude
    rate = lookup.false_positive_rate(F.col("candidate_buildings"), F.col("actual"))
    names = ["scheme", "case", "candidate_cells", "candidate_buildings", "n_ranges", "actual"]
    return joined.select(*names, rate.alias("false_positive_pct"))


@query("lookup_figures")
def lookup_figures(spark, sf_dir):
    """A record a viewport of 0.05 degrees and a corridor scheme: rows of the result and of the
    table, rows, files and bytes that the scans read, and times."""
    runs = {}
    for scheme, layout in (("bbox", "points_bbox"), *((s, f"cells_{s}_points") for s in fx.RESOLUTIONS)):
        name = f"viewport_{'h3' if scheme == 'hex' else scheme}_points_05"
        runs[name] = (QUERIES[name](spark, sf_dir), stored(spark, sf_dir, layout).count())
    for scheme in SCHEMES:
        runs[f"corridor_{scheme}"] = (QUERIES[f"corridor_{scheme}"](spark, sf_dir), stored(spark, sf_dir, f"occupancy_{scheme}").count())
    return report.figures_table(runs)


SWEEP_ROWS = [100, 500, 2_000]
#: Rows a file of the sweep: files, not strips, are what tasks sort and write.
SWEEP_FILE_ROWS = 500_000


def _sweep_sql() -> str:
    """Row groups that the corridor meets, from the data: each strip in order, cut every so many rows."""
    alts = ", ".join(f"({a})" for a in fx.ALTITUDES_M)
    sizes = ", ".join(f"({n})" for n in SWEEP_ROWS)
    return f"""WITH {sql.OBSTACLES}, {sql.sized_bins(Z, [4])}, alts(alt) AS (VALUES {alts}), sizes(n) AS (VALUES {sizes}),
      numbered AS (SELECT x, y, h, row_number() OVER (PARTITION BY h, x >> 3 ORDER BY x, y, osm_id) - 1 AS k FROM cells),
      groups AS (SELECT n, h, x >> 3 AS strip, k // n AS g, count(*) AS rows, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb, min(h) AS ha, max(h) AS hb
        FROM numbered, sizes GROUP BY ALL)
      SELECT n AS row_group_rows, alt AS altitude_m, count(g.rows) AS row_groups, coalesce(sum(g.rows), 0)::BIGINT AS rows
      FROM (SELECT * FROM sizes, alts) c LEFT JOIN groups g USING (n)
      WHERE g.rows IS NULL OR (xa <= {sql.x(repr(E), Z)} AND xb >= {sql.x(repr(W), Z)} AND ya <= {sql.y(repr(S), Z)} AND yb >= {sql.y(repr(N), Z)}
        AND ha <= {sql.hbin('alt + 5', 4)} AND hb >= {sql.hbin('alt - 5', 4)}) GROUP BY ALL"""


@query("row_group_sweep", _sweep_sql())
def row_group_sweep(spark, sf_dir):
    """Row groups, and their rows, that the corridor meets at each altitude, for three sizes of row
    groups: read from the footers of files of one bin and strip of eight tiles each, in order of x and y."""
    cases = [(str(c["altitude_m"]), c["x0"], c["x1"], c["y0"], c["y1"], c["v0"], c["v1"]) for c in corridor_cases("zxy_heightbin", None, [4])]
    boxes = ranges.constants(spark, cases, "case string, x0 long, x1 long, y0 long, y1 long, v0 long, v1 long")
    cells = stored(spark, sf_dir, "occupancy_zxy_heightbin").where("vertical_bin_m = 4").select("osm_id", "x", "y", "hbin")
    out = None
    for rows, path in sweep_files(spark, sf_dir, cells, SWEEP_ROWS).items():
        bounds = report.group_bounds(spark, path, ["x", "y", "hbin"])
        met = report.groups_met(bounds, boxes, [("x", "x0", "x1"), ("y", "y0", "y1"), ("hbin", "v0", "v1")])
        met = met.select(F.lit(rows).alias("row_group_rows"), F.col("case").cast("int").alias("altitude_m"), "row_groups", "rows")
        out = met if out is None else out.unionByName(met)
    return out


def sweep_files(spark, sf_dir, cells: DataFrame, sizes: list[int], most: int = SWEEP_FILE_ROWS) -> dict[int, str]:
    """Folders of the cells with row groups of each size, written once for the input as it is: a strip of a bin in
    order, in sorted files of ``most`` rows, a multiple of every size. Rows are shuffled and sorted once for all sizes."""
    paths = {n: f"{layouts.place(spark, sf_dir, 'occupancy_zxy_heightbin', n)[1]}-sweep" for n in sizes}
    missing = {n: path for n, path in paths.items() if not files.exists(spark, f"{path}/_SUCCESS")}
    if missing:
        order = ["hbin", "strip", "file", "x", "y", "osm_id"]
        ready = strip_files(cells, most).repartition(*order[:3]).sortWithinPartitions(*order).persist(StorageLevel.DISK_ONLY)
        for n, path in missing.items():
            writer = ready.write.mode("overwrite").partitionBy("hbin", "strip", "file")
            writer.option("parquet.block.row.count.limit", str(n)).parquet(path)
        ready.unpersist()
    return paths


def strip_files(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` with the strip (of a bin) of each and the number of its file, which holds ``most`` rows of the strip in order
    of x, y and id. Tiles are counted and their counts added up along strips; a tile lies in one file
    or is cut, and only the rows of those that are cut are numbered."""
    cells = cells.withColumn("strip", F.shiftright("x", 3))
    tiles = cells.groupBy("hbin", "strip", "x", "y").agg(F.count("*").alias("n"))
    along = Window.partitionBy("hbin", "strip").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tiles = tiles.withColumn("before", F.sum("n").over(along) - F.col("n"))
    first, last = (F.floor(c / most).cast("int") for c in (F.col("before"), F.col("before") + F.col("n") - 1))
    placed = cells.join(tiles.select("hbin", "x", "y", "before", first.alias("file"), last.alias("last")), ["hbin", "x", "y"])
    whole = placed.where("file = last").select(*cells.columns, "file")
    nth = F.row_number().over(Window.partitionBy("hbin", "x", "y").orderBy("osm_id")) - 1
    cut = placed.where("file < last").withColumn("file", F.floor((F.col("before") + nth) / most).cast("int"))
    return whole.unionByName(cut.select(*cells.columns, "file"))


ROUTES = {"zfxy": ("route_zfxy", "route_zfxy_fine"), "zxy_heightbin": ("route_zxy_heightbin",)}


@query(
    "route_matrix", _union([f"SELECT '{s}' AS scheme, * FROM ({ORACLE_SQL[n]}) r" for s, names in ROUTES.items() for n in names])
)
def route_matrix(spark, sf_dir):
    parts = [QUERIES[n](spark, sf_dir).withColumn("scheme", F.lit(s)) for s, names in ROUTES.items() for n in names]
    return reduce(DataFrame.unionByName, parts)


@query(
    "tagged_buildings",
    f"""WITH {sql.BUILDINGS}, tagged AS (SELECT *, CASE WHEN osm_id % 3 = 0 THEN 'yes' END AS building, osm_id % 4 = 0 AS has FROM buildings)
    SELECT osm_id, building, height, building_levels FROM tagged WHERE building IS NOT NULL OR has""",
)
def tagged_buildings(spark, sf_dir):
    """Buildings by column or tag, their tags read from a map as a database extract has them."""
    df = fx.buildings(spark, sf_dir).withColumn("building", F.when(F.col("osm_id") % 3 == 0, "yes"))
    pairs = F.array(
        F.struct(F.lit("height").alias("k"), F.col("height").alias("v")),
        F.struct(F.lit("building:levels").alias("k"), F.col("building_levels").alias("v")),
        F.when(F.col("osm_id") % 4 == 0, F.struct(F.lit("building").alias("k"), F.lit("yes").alias("v"))),
    )
    df = df.select("osm_id", "building", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"))
    return files.tagged_buildings(df, ["height", "building:levels"])


# The same buildings through other formats


def other_form(spark, sf_dir, form: str, write) -> str:
    """A folder with the buildings in another format, written once for the input as it is."""
    _, version = layouts.place(spark, sf_dir, "poly_bbox", 0)
    path = f"{version}-{form}"
    if not files.exists(spark, path):
        fresh = f"{path}-{uuid.uuid4().hex[:12]}"
        write(fresh)
        files.renamed(spark, fresh, path)
    return path


@query("geoparquet_viewport_05", ORACLE_SQL["viewport_bbox_poly_05"])
def geoparquet_viewport_05(spark, sf_dir):
    """Buildings in the viewport from GeoParquet files, whose row groups are left out by their boxes."""
    spark.dataSource.register(geoparquet.GeoParquet)

    def write(path: str) -> None:
        table = stored(spark, sf_dir, "poly_bbox").select("osm_id", "height", "xmin", "ymin", "xmax", "ymax")
        table.withColumn("geometry", wkb.box_wkb()).write.format("geoparquet").mode("overwrite").save(path)

    path = other_form(spark, sf_dir, "geoparquet", write)
    box = ",".join(repr(v) for v in fx.viewport(0.05))
    return spark.read.format("geoparquet").option("bbox", box).load(path).select("osm_id")


@query("geojson_buildings", f"WITH {sql.BUILDINGS} SELECT osm_id, xmin, ymin, xmax, ymax FROM buildings")
def geojson_buildings(spark, sf_dir):
    """Buildings written as GeoJSON collections and read back by ranges of bytes."""
    path = other_form(
        spark, sf_dir, "geojson", lambda at: files.write_features(fx.buildings(spark, sf_dir), at, ["osm_id"], files.box_geometry())
    )
    found = geojson.read_collection(spark, path, 4 << 20)
    return found.select(F.element_at("properties", "osm_id").cast("long").alias("osm_id"), "xmin", "ymin", "xmax", "ymax")


# Reports


@query(
    "summary_union",
    f"""SELECT 'zxy' AS source, altitude_m, actual, CAST(NULL AS BIGINT) AS total FROM
      (WITH {sql.OBSTACLES}, alts(alt) AS (VALUES (5), (30), (45), (60)) {ACTUAL_SQL}) a
    UNION ALL SELECT 'heights', NULL, NULL, count(*) FROM orders""",
)
def summary_union(spark, sf_dir):
    return files.union_summaries(
        {"zxy": actual_counts(spark, sf_dir), "heights": heights.height_quality(obstacles(spark, sf_dir)).select("total")}
    )


@query("parquet_stats")
def parquet_stats(spark, sf_dir):
    return files.parquet_stats(spark, f"{sf_dir}/orders.parquet")
