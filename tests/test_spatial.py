import math
import random
import re
import struct
import time

import numpy as np
import pytest
from oracle import SF, same_rows
from pyspark.sql import functions as F

from cellarium.functions import heights, hexgrid, keys, sqlnames, wkb
from cellarium.operators import cover, lookup, ranges, report, route
from cellarium.plans import fixtures as fx
from cellarium.plans import layouts, spatial, templates
from cellarium.sources import files

QUICK = [
    "tile_xy", "zfxy_keys", "zxy_keys", "morton2d_keys", "morton3d_keys", "morton_origin", "geohash_points_7", "quadkey_points_17",
    "poly_cells_morton2d", "height_parse", "levels_parse", "height_estimate", "height_source_stats", "occupancy_zxy_heightbin",
    "occupancy_skipped", "viewport_bbox_points_01", "viewport_bbox_poly_05", "viewport_quadkey_poly_01", "viewport_morton2d_points_05",
    "morton3d_ranges", "corridor_zxy_heightbin", "corridor_morton3d", "false_positive_rate", "blocked_zxy_heightbin",
    "route_zxy_heightbin", "summary_union",
]


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    same_rows(spatial.QUERIES[name](spark, SF), spatial.ORACLE_SQL[name])


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_known_keys(spark):
    got = one(
        spark,
        keys.geohash(F.lit(57.64911), F.lit(10.40744), 11),
        keys.quadkey_of_tile(F.lit(3), F.lit(5), 3),
        keys.tile_x(F.lit(139.784450), 19),
        keys.tile_y(F.lit(35.731), 19),
    )
    assert got == ("u4pruydqqvj", "213", 465719, 206363)
    assert keys.metres_per_level(19) == 64 and keys.metres_per_level(22) == 8


def test_codes_come_back(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2**21), rng.randrange(2**21)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x long, y long")
    x, y = keys.morton2d_xy(keys.morton2d("x", "y"))
    assert df.where((x != F.col("x")) | (y != F.col("y"))).count() == 0
    x, y = keys.quadkey_tile(keys.quadkey_of_tile("x", "y", 21))
    assert df.where((x != F.col("x")) | (y != F.col("y"))).count() == 0
    lat, lon = keys.geohash_centre(F.lit("u4pruydqqvj"), 11)
    got = one(spark, lat, lon)
    assert abs(got[0] - 57.64911) < 1e-5 and abs(got[1] - 10.40744) < 1e-5
    assert sorted(one(spark, keys.geohash_neighbours(F.lit("ezs42"), 5))[0]) == sorted(
        ["ezefp", "ezs40", "ezs41", "ezefr", "ezs43", "ezefx", "ezs48", "ezs49"]
    )


@pytest.mark.parametrize(
    ("side", "scheme", "r", "cells"),
    [
        ("01", "geohash", 6, 3), ("01", "geohash", 7, 72), ("05", "geohash", 6, 50), ("05", "geohash", 7, 1369),
        ("10", "geohash", 6, 209), ("01", "quadkey", 17, 24), ("01", "quadkey", 19, 285), ("05", "quadkey", 15, 35),
        ("05", "quadkey", 17, 456), ("10", "quadkey", 15, 132), ("01", "hex", 8, 2), ("01", "hex", 9, 10),
        ("05", "hex", 9, 261), ("10", "hex", 8, 148),
    ],
)
def test_published_cover_sizes(spark, side, scheme, r, cells):
    assert cover.box_cells(spatial.box_frame(spark, fx.SIDES[side]), scheme, [r], "case").count() == cells


def test_published_ranges_and_disks(spark):
    assert [len(spatial.viewport_ranges(19, side)) for side in fx.SIDES.values()] == [8, 104, 252]
    assert [hexgrid.disk_steps(m, 9) for m in (500, 1000)] == [3, 6]
    centre = spark.sql("SELECT 'c' AS case, 139.785D AS lon, 35.713D AS lat")
    assert cover.hex_disk(centre, 9, 3, "case").select("cell").distinct().count() == 37


def test_hexagons_are_even_and_named_once(spark):
    axes = hexgrid.CENTRES @ hexgrid.CENTRES.T
    assert abs(math.degrees(math.acos(sorted(axes[0])[-2])) - 41.81) < 0.01
    rng = random.Random(2)
    rows = [(k, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for k in range(300)]
    points = spark.createDataFrame(rows, "osm_id long, lat double, lon double")
    near = cover.hex_disk(points, 5, 1).groupBy("osm_id").agg(F.collect_set("cell").alias("around"))
    own = cover.point_cells(points, "hex", [5])
    # each cell is among its own neighbourhood, under the same name from every face
    assert own.join(near, "osm_id").where(~F.array_contains("around", F.col("cell"))).count() == 0


def test_height_tags(spark):
    tags = ["12", "12 m", "12.5", "30 ft", "10;12", "unknown", None, "", " 45 Metres ", "-3", "9999", "12d", "1_000", "nan", "6.25 feet",
            "12\t", "\n12 m", "\t30 ft\r\n", "12\u00a0m", "\u00a012", "30\u00a0ft", "\u300012\u2009m\u00a0", "12\x1f"]
    df = spark.createDataFrame([(t,) for t in tags], "t string").select(heights.parse_height_m(F.col("t")).alias("h"))
    want = [12.0, 12.0, 12.5, 9.14, 10.0, None, None, None, 45.0, None, None, None, 1000.0, None, 1.91, 12.0, 12.0, 9.14,
            12.0, 12.0, 9.14, 12.0, 12.0]
    assert [r["h"] for r in df.collect()] == want


def test_caps_and_reversed_heights_give_no_cells(spark):
    rows = [(1, 0.0, 0.0, 0.0001, 0.0001, 3.0, 20.0), (2, 0.0, 0.0, 0.0001, 0.0001, 20.0, 3.0), (3, 0.0, 0.0, 1.0, 1.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "osm_id long, xmin double, ymin double, xmax double, ymax double, min_height_m double, max_height_m double")
    assert {r["osm_id"] for r in cover.occupancy_bins(df, 19, [4]).collect()} == {1}
    assert cover.skipped(cover.sized_bins(df, 19, [4]), "vertical_bin_m").first()["skipped"] == 1


def test_ranges_hold_their_keys_and_no_gap_means_no_more(spark):
    box = spatial.box_frame(spark, 0.01)
    cells = ranges.box_keys_2d(box, 19)
    exact = ranges.key_ranges(cells, 1, ["case"])
    covered = exact.select(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0]
    assert covered == cells.select("key").distinct().count()
    inside = ranges.in_ranges(cells, ranges.key_ranges(cells, 4, ["case"]), "key", ["case"])
    assert inside.count() == cells.count()


def test_routes():
    box = (0, 0, 6, 6)
    assert len(route.a_star((0, 0), (6, 6), set(), box)) == 13
    wall = {(3, y) for y in range(7)}
    assert route.a_star((0, 0), (6, 6), wall, box) is None
    assert len(route.a_star((0, 0), (6, 6), wall - {(3, 0)}, box)) == 13
    assert route.a_star((0, 0), (6, 6), {(6, 6)}, box) is None
    assert len(route.a_star((0, 0), (1, 0), {(0, 0)}, box)) == 2
    assert len(route.a_star((0, 0), (6, 6), set(), box, diagonal=True)) == 7


def test_unobstructed_route_lengths(spark):
    for z, nodes in ((19, 66), (20, 130), (21, 259), (22, 518)):
        (sx, sy), (gx, gy) = spatial.route_ends(z)
        assert abs(sx - gx) + abs(sy - gy) + 1 == nodes


def test_sorted_files_and_features(spark, tmp_path):
    df = spark.range(0, 120_000).withColumn("v", F.col("id") % 100)
    files.write_sorted(df, str(tmp_path / "t"), ["v", "id"], files=1)
    stats = files.parquet_stats(spark, str(tmp_path / "t")).first()
    assert (stats["row_count"], stats["row_groups"], stats["column_chunks"]) == (120_000, 3, 6)
    points = spark.createDataFrame([(1, "a", 1.5, 2.5)], "osm_id long, name string, lon double, lat double")
    (tmp_path / "f.json").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"osm_id":"7"},'
        '"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,2.5],[3,-4],[1,2]]]}}]}'
    )
    row = files.read_features(spark, str(tmp_path / "f.json")).first()
    assert (row["xmin"], row["ymin"], row["xmax"], row["ymax"]) == (1.0, -4.0, 3.0, 2.5)
    runs = spark.createDataFrame([("a", "2026-01", 1), ("a", "2026-02", 2), ("2d", "2d", 3)], "benchmark string, run string, v int")
    assert {r["v"] for r in files.latest(runs).collect()} == {2, 3}
    assert files.to_markdown(runs.limit(1)).startswith("| benchmark | run | v |")
    assert files.to_markdown(spark.range(2500)).count("\n") == 2501


def test_features_come_back(spark, tmp_path):
    rows = [(k, f"n{k}", k * 1.5, -k / 4) for k in range(50)]
    points = spark.createDataFrame(rows, "osm_id long, name string, lon double, lat double").repartition(3)
    files.write_features(points, str(tmp_path / "points"), ["osm_id", "name"])
    got = files.read_features(spark, str(tmp_path / "points")).collect()
    assert {(int(r["properties"]["osm_id"]), r["xmin"], r["ymax"]) for r in got} == {(k, x, y) for k, _, x, y in rows}
    boxes = points.selectExpr("osm_id", "lon AS xmin", "lat AS ymin", "lon + 1 AS xmax", "lat + 2 AS ymax")
    files.write_features(boxes, str(tmp_path / "boxes"), ["osm_id"], files.box_geometry())
    got = files.read_features(spark, str(tmp_path / "boxes")).collect()
    assert {(r["type"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in got} == {
        ("Polygon", x, y, x + 1, y + 2) for _, _, x, y in rows
    }
    files.write_features(points.limit(0), str(tmp_path / "none"), ["osm_id"])
    assert files.read_features(spark, str(tmp_path / "none")).count() == 0
    one = '{"type":"Feature","properties":{"a":"b"},"geometry":{"type":"LineString","coordinates":[[1,2,100],[3,4,200]]}}'
    (tmp_path / "one.json").write_text(one)
    (tmp_path / "lines.json").write_text(f"{one}\n{one}\n" + '{"type":"Feature","properties":{},"geometry":null}')
    row = files.read_features(spark, str(tmp_path / "one.json")).first()
    assert (row["xmin"], row["ymin"], row["xmax"], row["ymax"]) == (1.0, 2.0, 3.0, 4.0)  # heights don't count
    lines = files.read_features(spark, str(tmp_path / "lines.json"), lines=True).collect()
    assert [r["xmax"] for r in lines] == [3.0, 3.0, None]


def test_geometries_as_binary(spark, tmp_path):
    rows = [(1, 1.0, 2.0, 3.0, 4.5), (2, -1.0, 0.0, 1.0, 0.5), (3, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "osm_id long, xmin double, ymin double, xmax double, ymax double")
    df = df.select("*", wkb.box_wkb().alias("geometry"), wkb.point_wkb("xmin", "ymin").alias("corner"))
    df.write.parquet(str(tmp_path / "g"))
    got = spark.read.parquet(str(tmp_path / "g")).select("osm_id", wkb.wkb_box("geometry").alias("b"), wkb.wkb_box("corner").alias("p"))
    got = {r["osm_id"]: r for r in got.collect()}
    assert tuple(got[1]["b"]) == rows[0][1:] and tuple(got[2]["b"]) == rows[1][1:] and got[3]["b"]["xmin"] is None
    assert tuple(got[1]["p"]) == (1.0, 2.0, 1.0, 2.0)
    point = struct.pack("<BIdd", 1, 1, 5.0, 6.0)
    line = struct.pack(">BIIdddd", 0, 2, 2, 0.0, 1.0, 2.0, 3.0)
    parts, _ = wkb.positions(struct.pack("<BII", 1, 7, 2) + point + line)
    assert [p.tolist() for p in parts] == [[[5.0, 6.0]], [[0.0, 1.0], [2.0, 3.0]]]


def test_statistics_of_a_bad_file(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "bad.parquet").write_bytes(b"PAR1 not a table")
    got = {r["file"][:3]: r for r in files.parquet_stats(spark, str(tmp_path / "t")).collect()}
    assert got["par"]["row_count"] == 10 and (got["bad"]["row_count"], got["bad"]["row_groups"]) == (0, None)


def test_summaries_metadata_and_origin(spark, tmp_path):
    root = tmp_path / "results" / "x" / "results"
    files.write_summary(spark.range(2).withColumn("a", F.lit("x")), str(root / "2d" / "summary.csv"))
    files.write_summary(spark.range(1).withColumn("b", F.lit("y")), str(root / "corridor" / "2026-01" / "summary.csv"))
    got = files.read_summaries(spark, str(root)).collect()
    assert sorted((r["source"], r["a"], r["b"]) for r in got if r["a"]) == [("2d/summary.csv", "x", None)] * 2
    assert [(r["source"], r["b"]) for r in got if r["b"]] == [("corridor/2026-01/summary.csv", "y")]
    files.write_metadata(spark, str(tmp_path / "meta"), {"x_origin": 5, "y_origin": 7})
    assert layouts.read_origin(spark, str(tmp_path / "meta")) == (5, 7)
    assert layouts.read_origin(spark, str(tmp_path / "nowhere")) == (0, 0)


def test_stored_tables_outlive_a_session_and_follow_their_input(spark, tmp_path):
    sf = str(tmp_path / "in")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(100).write.parquet(f"{sf}/events.parquet")
    look = lambda: spatial.QUERIES["viewport_bbox_points_10"](spark, sf)
    assert look().count() == 100
    above, first = layouts.place(spark, sf, "points_bbox", files.ROW_GROUP_ROWS)
    written = files.listed(spark, first)
    layouts._TABLES.clear()  # as another driver, which knows of no table
    assert look().count() == 100 and files.listed(spark, first) == written and len(files.folders(spark, above)) == 1
    for n in (300, 500, 700):  # in the same session
        time.sleep(0.01)
        events.limit(n).write.mode("overwrite").parquet(f"{sf}/events.parquet")
        assert look().count() == n
    assert len(layouts.versions(spark, above)) == 2  # this one and the one before
    assert not files.exists(spark, first)
    assert not [v for v in files.folders(spark, above) if v.startswith("_")]


def test_a_write_that_fails_leaves_no_table(spark, tmp_path, monkeypatch):
    sf = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").limit(10).write.parquet(f"{sf}/events.parquet")
    whole = files.write_sorted

    def broken(df, path, *more):
        whole(df, path, *more)
        raise RuntimeError("lost")

    monkeypatch.setattr(files, "write_sorted", broken)
    with pytest.raises(RuntimeError):
        layouts.stored(spark, sf, "points_bbox")
    monkeypatch.undo()
    above, path = layouts.place(spark, sf, "points_bbox", files.ROW_GROUP_ROWS)
    assert not files.exists(spark, path) and layouts.versions(spark, above) == []
    assert len(layouts._left_over(spark, above, -60)) == 1 and layouts._left_over(spark, above) == []
    assert layouts.stored(spark, sf, "points_bbox").count() == 10


def test_tags(spark):
    text = '"building"=>"yes", "height"=>"12 m", "name"=>"a \\"b\\" c", "roof:levels"=>NULL'
    rows = [(1, None, text), (2, "house", ""), (3, None, '"height"=>"3"'), (4, None, None), (5, "x", None)]
    df = spark.createDataFrame(rows, "osm_id long, building string, t string").withColumn("tags", files.tags_of(F.col("t")))
    got = {r["osm_id"]: r for r in files.tagged_buildings(df, ["height", "name", "roof:levels"]).collect()}
    assert set(got) == {1, 2, 5} and (got[1]["height"], got[1]["name"]) == ("12 m", 'a "b" c')
    assert got[2]["height"] is None and got[1]["roof_levels"] is None
    odd = spark.createDataFrame([('"a"=>"NULL", "b"=>"", "c"=>NULL, "d"=>"x\\\\y"',)], "t string")
    assert odd.select(files.tags_of(F.col("t")).alias("m")).first()["m"] == {"a": "NULL", "b": "", "c": None, "d": "x\\y"}


def scanned(spark, df):
    """Rows that the plan's scans of files gave, after row groups were left out, and the filters pushed to them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        df = df.select("*")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        found = [leaves.apply(k) for k in range(leaves.size())]
        scans = [leaf for leaf in found if leaf.nodeName().startswith("Scan parquet")]
        return sum(leaf.metrics().apply("numOutputRows").value() for leaf in scans), " ".join(leaf.toString() for leaf in scans)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_lookups_read_few_row_groups(spark):
    sf = SF
    for name, rows in (("points_bbox", 100), ("cells_quadkey_points", 100), ("occupancy_zxy_heightbin", 500)):
        layouts.stored(spark, sf, name, rows)
    table = layouts.stored(spark, sf, "points_bbox", 100)
    n, filters = scanned(spark, lookup.points_in_box(table, fx.viewport(0.005)))
    assert 0 < n < table.count() and "GreaterThanOrEqual(xmin" in filters
    table = layouts.stored(spark, sf, "cells_quadkey_points", 100)
    found = cover.cover_ranges("quadkey", 17, fx.viewport(0.005))
    near = [(keys.text_of(lo, 4, 17), keys.text_of(hi, 4, 17)) for lo, hi in ranges.outer(found)]
    hits = ranges.in_text_ranges(table.where((F.col("resolution") == 17) & ranges.within("cell", near)), found, "cell", 4, 17)
    n, filters = scanned(spark, hits)
    assert 0 < n < table.where("resolution = 17").count() / 2 and "GreaterThanOrEqual(cell" in filters and "resolution" in filters
    table = layouts.stored(spark, sf, "occupancy_zxy_heightbin", 500)
    cases = [c for c in spatial.corridor_cases("zxy_heightbin", None, [4]) if c["altitude_m"] == 45]
    hits = lookup.in_cell_boxes(table, cases, "vertical_bin_m", {"x": ("x0", "x1"), "y": ("y0", "y1"), "hbin": ("v0", "v1")})
    n, filters = scanned(spark, hits)
    assert n < table.where("vertical_bin_m = 4").count() / 2 and "LessThanOrEqual(hbin" in filters


def test_hexagons_few_row_groups(spark):
    table = layouts.stored(spark, SF, "cells_hex_points", 50)
    own = table.where("resolution = 10").count()
    found = ranges.merged(hexgrid.box_keys(fx.viewport(0.01), 10))
    n, filters = scanned(spark, spatial.key_hits(table.where("resolution = 10"), "key", found))
    assert 0 < n < own / 2 and "GreaterThanOrEqual(key" in filters
    n, filters = scanned(spark, spatial.radius_hits(table, 10, [200]))
    assert 0 < n < own / 2 and "GreaterThanOrEqual(key" in filters
    table = layouts.stored(spark, SF, "obstacles", 100)
    few = table.where(lookup.blocking(table, fx.CORRIDOR, F.lit(0.0), F.lit(65.0)))
    n, filters = scanned(spark, few)
    assert 0 < n < table.count() and "LessThanOrEqual(xmin" in filters


def test_hexagon_keys_go_from_coarse_to_fine(spark):
    rng = random.Random(6)
    rows = [(k, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for k in range(400)]
    points = spark.createDataFrame(rows, "osm_id long, lat double, lon double")
    cells = cover.point_cells(points, "hex", [0, 1, 4, 5, 10]).withColumn("key", hexgrid.key_of_name("cell"))
    pairs = cells.select("resolution", "cell", "key").distinct()
    assert pairs.count() == pairs.select("resolution", "cell").distinct().count() == pairs.select("resolution", "key").distinct().count()
    # A cell's descendants lie around it: of most cells the key at a coarser resolution is the parent's.
    by = {(r["osm_id"], r["resolution"]): r["key"] for r in cells.collect()}
    same = sum(by[k, 10] // 7**5 == by[k, 5] for k, *_ in rows)
    assert same > 0.8 * len(rows)
    assert hexgrid.child_range(by[0, 5], 5)[0] <= by[0, 5] * 7**5 <= hexgrid.child_range(by[0, 5], 5)[1]
    up = cells.where("resolution = 10").select("key", hexgrid.parent_key("key", 5).alias("p")).collect()
    assert all(r["p"] == r["key"] // 7**5 for r in up)
    names, numbers = hexgrid.box_names(fx.viewport(0.1), 10), hexgrid.box_keys(fx.viewport(0.1), 10)
    assert len(set(numbers)) == len(names) == 7253 and len(ranges.merged(numbers)) < len(numbers) / 4
    # The seven children of each cell are its own
    for r in (1, 2):
        places = np.array([(q, s) for q in range(-9, 10) for s in range(-9, 10)])
        got = hexgrid.place_keys(np.zeros(len(places)), places, r)
        assert len(set(got.tolist())) == len(places)


@pytest.mark.parametrize("name", ["corridor_zfxy", "corridor_zxy_heightbin", "corridor_morton3d", "lookup_cells"])
def test_templates(spark, name):
    query = f"template_{name}"
    same_rows(spatial.QUERIES[query](spark, SF), spatial.ORACLE_SQL[query])
    _, filters = scanned(spark, spatial.QUERIES[query](spark, SF))
    wanted = {
        "corridor_zfxy": ["zfxy_z#", "GreaterThanOrEqual(x,", "LessThanOrEqual(y,", "GreaterThanOrEqual(f,"],
        "corridor_morton3d": ["vertical_bin_m#", "GreaterThanOrEqual(key_u64,", "LessThanOrEqual(key_u64,"],
    }.get(name, ["vertical_bin_m#", "GreaterThanOrEqual(x,", "LessThanOrEqual(y,", "LessThanOrEqual(hbin,"])
    assert all(w in filters for w in wanted), filters


def test_functions_of_sql_equal_the_column_functions(spark):
    sqlnames.register(spark)
    rng = random.Random(8)
    rows = [(rng.uniform(-180, 180), rng.uniform(-80, 80), rng.uniform(-5, 300), rng.randrange(2**21), rng.randrange(2**21)) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None)], "lon double, lat double, h double, x long, y long")
    df = df.withColumns({
        "x1": keys.tile_x("lon", 19), "y1": keys.tile_y("lat", 19), "f1": keys.level("h", 22), "b1": keys.height_bin("h", 4),
        "m1": keys.morton2d("x", "y"), "q1": keys.quadkey_of_tile("x", "y", 21), "c1": keys.morton3d("x", F.col("y") - 1_000_000, "x"),
    })
    df = df.selectExpr(
        "*", "tile_x(lon, 19) x2", "tile_y(lat, 19) y2", "height_level(h, 22) f2", "height_bin(h, 4) b2", "morton2d(x, y) m2",
        "quadkey(x, y, 21) q2", "morton3d(x, y - 1000000, x) c2",
    )
    for r in df.collect():
        assert all(r[f"{c}1"] == r[f"{c}2"] for c in ("x", "y", "f", "b", "m", "q", "c") if r["lon"] is not None), r


def test_figures_of_runs(spark):
    got = {r["query"]: r for r in spatial.QUERIES["lookup_figures"](spark, SF).collect()}
    assert len(got) == 8
    for name, r in got.items():
        assert r["rows_scanned"] > 0 and r["files_read"] > 0 and r["bytes_read"] > 0 and r["ms"] > 0 and r["scans"] > 0, name
        assert r["n_rows"] == spatial.QUERIES[name](spark, SF).count()
    table = layouts.stored(spark, SF, "cells_quadkey_points", 100)
    few = report.run_figures(spatial.key_hits(layouts.stored(spark, SF, "cells_morton2d_points", 100), "cell", spatial.viewport_ranges(19, 0.01)))
    assert 0 < few.rows <= few.rows_scanned < table.where("resolution = 19").count()
    adaptive = report.run_figures(table.groupBy("cell").count())
    assert adaptive.rows == table.select("cell").distinct().count() and adaptive.rows_shuffled >= adaptive.rows
    assert "Scan parquet" in report.explain_text(table) and "Scan parquet" in few.plan


def test_row_group_sweep(spark, tmp_path):
    same_rows(spatial.QUERIES["row_group_sweep"](spark, SF), spatial.ORACLE_SQL["row_group_sweep"])
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    got = {r["row_group_rows"]: r for r in report.row_group_sweep(df, str(tmp_path), ["id"], [100, 500]).collect()}
    assert got[100]["row_count"] == got[500]["row_count"] == 1000 and got[100]["row_groups"] > got[500]["row_groups"]


def test_cells_inside_polygons(spark):
    same_rows(spatial.QUERIES["h3_polygon_cells"](spark, SF), spatial.ORACLE_SQL["h3_polygon_cells"])
    west, south, east, north = fx.viewport(0.02)
    ring = [[west, south], [east, south], [east, north], [west, north], [west, south]]
    hole = [[139.783, 35.711], [139.783, 35.715], [139.787, 35.715], [139.787, 35.711], [139.783, 35.711]]
    rows = [(1, str([ring])), (1, str([ring])), (2, str([ring, hole])), (3, None), (4, "[]"), (None, str([ring])), (5, str([[[0, 0], [1, 1]]]))]
    polygons = spark.createDataFrame(rows, "osm_id long, coordinates string")
    got = {}
    for r in cover.hex_polygon_cells(polygons, 10).collect():
        got.setdefault(r["osm_id"], set()).add(r["cell"])
    box = set(hexgrid.box_names(fx.viewport(0.02), 10))
    inner = set(hexgrid.box_names((139.783, 35.711, 139.787, 35.715), 10))
    assert got == {1: box, 2: box - inner, None: box} and inner


@pytest.mark.parametrize(("scheme", "r"), [("geohash", 5), ("geohash", 6), ("quadkey", 9), ("quadkey", 13)])
def test_values_on_borders(spark, scheme, r):
    step_x = 360 / 2 ** (keys.geohash_bits(r)[0] if scheme == "geohash" else r)
    step_y = 180 / 2 ** keys.geohash_bits(r)[1]  # borders of geohashes; of tiles the equator is one
    at = [(-180 + 7 * step_x, 0.0), (-180 + 8 * step_x, 3 * step_y), (0.0, -5 * step_y), (180.0, 80.0), (-180.0, -80.0), (1.5, 2.5)]
    spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "osm_id long, lon double, lat double").createOrReplaceTempView("border_points")
    boxes = [(k, x, y, x + a * step_x, y + b * step_y) for k, ((x, y), a, b) in enumerate((p, a, b) for p in at[:3] for a in (0.5, 1, 2) for b in (0.25, 1, 3))]
    own = cover.point_cells(spark.table("border_points"), scheme, [r])
    values = ", ".join(str((k, *p)) for k, p in enumerate(at))
    cast = lambda names: ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
    points = f"points AS (SELECT osm_id, {cast(['lon', 'lat'])} FROM (VALUES {values}) v(osm_id, lon, lat))"
    same_rows(own, f"WITH {points} SELECT * FROM ({spatial.point_key_sql(scheme, r)}) k")
    table = spark.createDataFrame(boxes, "osm_id long, xmin double, ymin double, xmax double, ymax double")
    names = ["xmin", "ymin", "xmax", "ymax"]
    source = f"buildings AS (SELECT osm_id, {cast(names)} FROM (VALUES {', '.join(map(str, boxes))}) v(osm_id, {', '.join(names)}))"
    same_rows(cover.box_cells(table, scheme, [r]), f"WITH {source} SELECT * FROM ({spatial.box_key_sql(scheme, r)}) k")
    for _, *box in boxes:  # the constants of a plan follow the same rule
        found = {k for lo, hi in cover.cover_ranges(scheme, r, tuple(box)) for k in range(lo, hi + 1)}
        one = spark.createDataFrame([(0, *box)], "osm_id long, xmin double, ymin double, xmax double, ymax double")
        base = 32 if scheme == "geohash" else 4
        assert {keys.text_of(k, base, r) for k in found} == {c["cell"] for c in cover.box_cells(one, scheme, [r]).collect()}
        break


def test_cover_ranges_hold_the_cells_of_the_box(spark):
    for scheme, r in (("geohash", 5), ("geohash", 6), ("quadkey", 17), ("morton2d", 19)):
        for side in fx.SIDES.values():
            found = cover.cover_ranges(scheme, r, fx.viewport(side))
            own = {c["cell"] for c in cover.box_cells(spatial.box_frame(spark, side), scheme, [r], "case").collect()}
            base = 32 if scheme == "geohash" else 4
            text = (lambda k: k) if scheme == "morton2d" else lambda k, base=base, r=r: keys.text_of(k, base, r)
            assert {text(k) for lo, hi in found for k in range(lo, hi + 1)} == own
            assert len(ranges.outer(found)) <= 16
    for r in (8, 9):
        own = cover.box_cells(spatial.box_frame(spark, 0.01), "hex", [r], "case")
        assert set(hexgrid.box_names(fx.viewport(0.01), r)) == {c["cell"] for c in own.collect()}
    one = ranges.outer([(1, 2), (4, 5), (100, 110), (112, 120)], 2)
    assert one == [(1, 5), (100, 120)] and ranges.merged([5, 1, 2, 2, 9], 3) == [(1, 5), (9, 9)]


def test_descent_finds_the_ranges_of_listed_cells():
    rng = random.Random(4)
    for gap in (1, 4):
        for _ in range(60):
            low = [rng.randrange(40) for _ in range(3)]
            high = [v + rng.randrange(12) for v in low]
            flat = ranges.merged((keys.morton2d_at(x, y) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)), gap)
            assert ranges.box_ranges(tuple(low[:2]), tuple(high[:2]), gap) == flat
            solid = ranges.merged((keys.morton3d_at(x, y, h) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)
                                   for h in range(low[2], high[2] + 1)), gap)
            assert ranges.box_ranges(tuple(low), tuple(high), gap) == solid
    for side in fx.SIDES.values():
        x0, x1, y0, y1 = cover.box_ranges_at("morton2d", 19, fx.viewport(side))
        listed = ranges.merged((keys.morton2d_at(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)), 4)
        assert spatial.viewport_ranges(19, side) == listed
    with pytest.raises(ValueError, match="box"):
        ranges.box_ranges((3, 3), (2, 5))


def test_descent_of_a_large_box_is_quick():
    x0, x1, y0, y1 = cover.box_ranges_at("morton2d", 19, (134.8, 30.7, 144.8, 40.7))
    began = time.perf_counter()
    found = ranges.box_ranges((x0, y0), (x1, y1))
    assert time.perf_counter() - began < 1
    assert sum(hi - lo + 1 for lo, hi in found) == (x1 - x0 + 1) * (y1 - y0 + 1) > 2 * 10**8


def test_ranges_of_boxes_that_are_none(spark):
    rows = [(1, 0, 0, 3, 1), (2, 5, 5, 4, 9), (3, None, 0, 1, 1)]
    boxes = spark.createDataFrame(rows, "case long, x0 long, y0 long, x1 long, y1 long")
    found = ranges.ranges_of_boxes(boxes, ["x0", "y0"], ["x1", "y1"]).collect()
    assert [(r["case"], r["lo"], r["hi"]) for r in found] == [(1, 0, 7)]


def test_boxes_with_equal_ids_keep_their_cells(spark):
    rows = [(1, 139.70, 35.60, 139.70001, 35.60001), (1, 139.90, 35.80, 139.90001, 35.80001)]
    df = spark.createDataFrame(rows, "osm_id long, xmin double, ymin double, xmax double, ymax double")
    assert cover.box_cells(df, "hex", [9]).select("cell").distinct().count() == 2


def test_bounds_of_tiles_and_codes(spark):
    west, south, east, north = one(spark, *keys.tile_bounds(F.lit(3), F.lit(5), 3))
    assert (west, east) == (-45.0, 0.0) and abs(north + 40.9798981) < 1e-6 and abs(south + 66.5132604) < 1e-6
    back = one(spark, keys.tile_x(F.lit((west + east) / 2), 3), keys.tile_y(F.lit((south + north) / 2), 3))
    assert back == (3, 5)


def test_polygons_are_cut_the_same_in_a_batch_and_by_bands(spark):
    """Polygons are shuffled by bands only beyond a length, and nothing of them is broadcast, whose size isn't known."""
    rng, rows = random.Random(3), []
    for k in range(40):
        lon, lat = rng.uniform(-170, 170), rng.uniform(-60, 60)
        ring = [[lon + 0.01 * rng.uniform(0.2, 1) * math.cos(a / 2), lat + 0.01 * rng.uniform(0.2, 1) * math.sin(a / 2)] for a in range(12)]
        rows.append((k, str([[*ring, ring[0]]])))
    rows += [(40, "[[[0.0, 0.0], [null, 1.0], [0.01, 0.02], [0.0, 0.0]]]"), (41, "[]"), (42, "no"), (43, None)]
    polygons = spark.createDataFrame(rows, "osm_id long, coordinates string")
    found = [cover.hex_polygon_cells(polygons, 9, few=few) for few in (0, 300, 100_000)]
    one, *others = [sorted(map(tuple, f.collect())) for f in found]
    assert len(one) > 200 and all(o == one for o in others)
    assert "BroadcastHashJoin" not in report.explain_text(cover.hex_polygon_cells(polygons, 9, few=0), "simple")


def test_boxes_of_all_sizes_hold_the_middles_of_all_near_cells(spark):
    rng, rows = random.Random(5), []
    for k in range(120):
        side, lon, lat = 10 ** rng.uniform(-5, -0.5), rng.uniform(-179, 178), rng.uniform(-80, 79)
        rows.append((k, lon, lat, lon + side, lat + side * rng.uniform(0.2, 1)))
    rows += [(120, 1.0, 1.0, 0.9, 0.9), (121, None, 1.0, 2.0, 2.0)]
    boxes = spark.createDataFrame(rows, "osm_id long, xmin double, ymin double, xmax double, ymax double")
    got = {}
    for c in cover.box_cells(boxes, "hex", [6]).collect():
        got.setdefault(c["osm_id"], []).append(c["cell"])
    assert "SortMergeJoin" not in report.explain_text(cover.box_cells(boxes, "hex", [6]), "simple")
    for k, *box in rows[:-1]:  # against the cells listed for one box with a step around it
        assert sorted(got[k]) == sorted(hexgrid.box_names(tuple(box), 6)), k
    assert 121 not in got and max(map(len, got.values())) > 10


def test_stored_cells_shuffle_only_the_rows_they_are_made_of(spark):
    for scheme in spatial.SCHEMES:
        whole = layouts.occupancy(spark, SF, scheme)
        table = layouts.stored(spark, SF, f"occupancy_{scheme}")
        assert set(table.columns) == set(whole.columns)  # what isn't stored follows from what is
        names = sorted(whole.columns)
        assert sorted(map(str, table.select(names).collect())) == sorted(map(str, whole.select(names).collect()))
        stored = spark.read.parquet(layouts.place(spark, SF, f"occupancy_{scheme}", files.ROW_GROUP_ROWS)[1])
        assert "key_text" not in stored.columns and "blocked" not in stored.columns
    for name in ("occupancy_zfxy", "cells_hex_poly", "cells_geohash_poly", "cells_hex_points"):
        plan = report.explain_text(layouts.LAYOUTS[name].build(spark, SF), "simple")
        assert any(w in plan.split("Exchange")[0] for w in ("Generate explode", "MapInArrow")), plan
        assert layouts.stored(spark, SF, name).count() > 0
    points = layouts.stored(spark, SF, "cells_hex_points").select("osm_id", "resolution", "key")
    named = cover.point_cells(fx.points(spark, SF), "hex", fx.RESOLUTIONS["hex"]).select("osm_id", "resolution", hexgrid.key_of_name("cell").alias("key"))
    assert points.exceptAll(named).count() == named.exceptAll(points).count() == 0


@pytest.mark.parametrize("scheme", ["bbox", "quadkey", "morton2d"])
def test_records_equal_sql(spark, scheme):
    same_rows(spatial.QUERIES[f"matrix_{scheme}"](spark, SF), spatial.ORACLE_SQL[f"matrix_{scheme}"])


def test_records_of_hexagons_count_their_queries(spark):
    found = spatial.QUERIES["matrix_h3"](spark, SF)
    keys_shuffled = report.explain_text(found, "simple").split("hashpartitioning(")[1:]
    assert not any(k.startswith("kind") for k in keys_shuffled)  # texts of records don't go with every hit
    got = {(r["kind"], r["size"], r["resolution"]): r["n_rows"] for r in found.collect()}
    for kind, size in (("points", "05"), ("poly", "01")):
        own = spatial.QUERIES[f"viewport_h3_{kind}_{size}"](spark, SF).groupBy("resolution").count().collect()
        assert {r["resolution"]: r["count"] for r in own} == {r: n for (k, s, r), n in got.items() if (k, s) == (kind, size) and n}
    own = spatial.h3_radius(spark, SF).groupBy("radius_m", "resolution").count().collect()
    assert {(str(r["radius_m"]), r["resolution"]): r["count"] for r in own} == {(s, r): n for (k, s, r), n in got.items() if k == "radius" and n}


def test_templates_write_only_the_tables_they_name(spark, tmp_path):
    sf = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/orders.parquet").limit(50).write.parquet(f"{sf}/orders.parquet")
    spatial.QUERIES["template_corridor_zfxy"](spark, sf).collect()
    there = [n for n in templates.TABLES if layouts.versions(spark, layouts.place(spark, sf, n, files.ROW_GROUP_ROWS)[0])]
    assert there == ["occupancy_zfxy"]


def test_a_strip_of_a_sweep_is_cut_into_files(spark):
    rows = [(k, 8 + k % 3, k % 2, 0) for k in range(100)] + [(k, 17, 0, 1) for k in range(5)]
    cells = spark.createDataFrame(rows, "osm_id long, x long, y long, hbin long")
    got = sorted((r["hbin"], r["x"], r["y"], r["osm_id"], r["file"]) for r in spatial.strip_files(cells, 40).collect())
    assert [r[4] for r in got if r[0] == 0] == [k // 40 for k in range(100)] and [r[4] for r in got if r[0] == 1] == [0] * 5
    # Neither a strip nor the number of sizes makes a task or a shuffle of its own
    plan = report.explain_text(spatial.strip_files(cells, 40), "simple")
    assert "hashpartitioning(hbin, strip, 2" not in plan


def test_geohash_covers_are_stored_by_number_in_one_pass(spark):
    plan = report.explain_text(layouts.LAYOUTS["cells_geohash_poly"].build(spark, SF), "simple")
    assert plan.count("Exchange ") == 1 and plan.count("FileScan parquet") == 1
    table = layouts.stored(spark, SF, "cells_geohash_poly").select("osm_id", "resolution", "cell")
    whole = cover.box_cells(fx.buildings(spark, SF), "geohash", fx.RESOLUTIONS["geohash"]).select("osm_id", "resolution", "cell")
    assert table.exceptAll(whole).count() == whole.exceptAll(table).count() == 0
    _, filters = scanned(spark, spatial.cell_hits(spark, SF, "geohash", "poly", 0.01, 8))
    assert "GreaterThanOrEqual(key," in filters


@pytest.mark.parametrize("name", ["occupancy_zfxy", "occupancy_zxy_heightbin", "occupancy_morton3d", "obstacles"])
def test_code_of_builds_is_short_enough_to_be_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = report.explain_text(layouts.LAYOUTS[name].build(spark, SF), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer methods for ever


def test_steps_of_heights_equal_the_expression(spark):
    tags = ["12", " 12 m ", "1_000", "30 ft", "10;12", "-3", "9999", "9998.5", "12d", ".5", "", ";", "feet", None, " 30 ft", "1e2 metres", "600"]
    df = spark.createDataFrame([(t, u) for t in tags for u in tags], "height string, building_levels string")
    df = df.withColumns({"min_height": F.col("building_levels"), "building_min_level": F.col("height")})
    got = heights.estimate_heights(df)
    assert set(got.columns) - set(df.columns) == {"max_height_m", "min_height_m", "height_source", "levels", "min_level"}
    levels, low = heights.parse_levels("building_levels"), heights.parse_levels("building_min_level")
    high = F.coalesce(heights.parse_height_m("height"), levels * 3.0, F.lit(15.0))
    bottom = F.coalesce(heights.parse_height_m("min_height"), low * 3.0, F.lit(0.0))
    same = got.select(high.eqNullSafe(F.col("max_height_m")) & bottom.eqNullSafe(F.col("min_height_m")) & levels.eqNullSafe(F.col("levels")))
    assert all(r[0] for r in same.collect())


def test_heights_are_read_once_after_buildings_were_dealt(spark):
    plan = report.explain_text(layouts.LAYOUTS["obstacles"].build(spark, SF), "simple")
    assert plan.count("Exchange ") == 1 and "regexp_replace" not in plan.split("Exchange ")[1]


def test_one_number_sorts_the_files_of_all_folders(spark, tmp_path):
    rows = [(k * 7 % 5, k * 11 % 13, k * 17 % 19, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "f long, x long, y long, part int").coalesce(1)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    files.write_sorted(df, str(tmp_path / "t"), ["f", "x", "y"], ["part"], 100, None, True, keys.packed("f", "x", "y"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    for part in range(3):
        found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / f"part={part}")).select("f", "x", "y").collect()]
        assert found == sorted(r[:3] for r in rows if r[3] == part)
    most = one(spark, keys.packed(F.lit(2**40), F.lit(2**22 - 1), F.lit(5)), keys.packed(F.lit(2**18 - 1), F.lit(2**22 - 1), F.lit(5)))
    assert most[0] == most[1] > 0
    for name, layout in layouts.LAYOUTS.items():
        if name.startswith(("occupancy", "cells_hex", "obstacles")):
            assert layout.number is not None
            own = [layout.number().alias("n"), *layout.by]
            got = [tuple(r) for r in layout.build(spark, SF).select(*own).distinct().collect()]
            assert [r[1:] for r in sorted(got)] == sorted(r[1:] for r in got), name


#: The cut that the SQL of occupancy has: what is over it gets no cells.
CAPS = "(x1-x0+1)*(y1-y0+1) > 200 OR (x1-x0+1)*(y1-y0+1)*(v1-v0+1) > 1000 AS over"


@pytest.mark.parametrize(("name", "case"), [("route_zfxy", "19@30"), ("route_zxy_heightbin", "4@30")])
def test_routes_go_around_buildings_over_a_cap(spark, tmp_path, name, case):
    whole = spatial.ORACLE_SQL[name].replace(CAPS, "x0 + x1 + y0 + y1 IS NULL AS over")
    found = {}
    # 35000 covers the start's column and what lies east of it; 38000 all columns
    for keys_of in ([1, 2], [1, 2, 35_000], [35_000, 38_000, 500, None]):
        sf = str(tmp_path / f"in{len(found)}")
        spark.createDataFrame([(k,) for k in keys_of], "o_orderkey long").write.parquet(f"{sf}/orders.parquet")
        same_rows(spatial.QUERIES[name](spark, sf), whole, sf)
        row = spatial.QUERIES[name](spark, sf).where(F.col("case") == case).first()
        found[len(found)] = (row["route_found"], row["length"], row["lookup_count"] > 0)
    assert list(found.values()) == [(True, 66, False), (True, 68, True), (False, None, True)]


def test_cells_of_large_boxes_are_bounded_by_the_case(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        x0, y0, v0 = (rng.randrange(-20, 20) for _ in range(3))
        rows.append((k, 1 + k % 2, x0, x0 + rng.randrange(30), y0, y0 + rng.randrange(30), v0, v0 + rng.randrange(-2, 10)))
    rows += [(k, 1, -(2**40), 2**40, -(2**40), 2**40, 40, 50) for k in range(300, 310)]  # no array could hold their cells
    sized = spark.createDataFrame(rows, "osm_id long, part int, x0 long, x1 long, y0 long, y1 long, v0 long, v1 long").withColumn("over", F.lit(True))
    sized = sized.unionByName(sized.limit(1).withColumn("x1", F.lit(None).cast("long")))
    cases = [{"case": "a", "part": 1, "x0": 0, "x1": 4, "y0": -3, "y1": 9, "v0": 2, "v1": 3},
             {"case": "b", "part": 1, "x0": 2, "x1": 9, "y0": 5, "y1": 20, "v0": 45, "v1": 45},
             {"case": "c", "part": 2, "x0": -40, "x1": -5, "y0": 0, "y1": 0, "v0": 9, "v1": 9}]
    got = [tuple(r) for r in lookup.cells_of_boxes(cover.large_boxes(sized, "part"), cases, "part").collect()]
    want = {
        (c["case"], x, y) for c in cases for x in range(c["x0"], c["x1"] + 1) for y in range(c["y0"], c["y1"] + 1)
        if any(p == c["part"] and a <= x <= b and d <= y <= e and v <= w and v <= c["v1"] and w >= c["v0"] for _, p, a, b, d, e, v, w in rows)
    }
    assert set(got) == want and len({r[0] for r in got}) == 3
    assert len(got) <= sum((c["x1"] - c["x0"] + 1) * (c["y1"] - c["y0"] + 1) ** 2 for c in cases)


@pytest.mark.parametrize("name", ["large_zfxy", "large_zxy_heightbin"])
def test_boxes_over_a_cap_are_stored(spark, tmp_path, name):
    spark.createDataFrame([(k,) for k in (1, 2, 500, 35_000)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    table = layouts.stored(spark, str(tmp_path), name)
    assert {r["osm_id"] for r in table.select("osm_id").distinct().collect()} == {500, 35_000}
    few = lookup.cells_of_boxes(table, spatial.corridor_cases(name[6:]), spatial.PART[name[6:]])
    _, filters = scanned(spark, few)
    assert "LessThanOrEqual(x0" in filters and "GreaterThanOrEqual(v1" in filters
    plan = report.explain_text(layouts.LAYOUTS[name].build(spark, SF), "simple")
    assert plan.count("Exchange ") == 1 and "regexp_replace" not in plan.split("Exchange ")[1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = report.explain_text(layouts.LAYOUTS[name].build(spark, SF), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000
