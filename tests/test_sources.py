"""Databases, GeoParquet and GeoJSON."""

import json
import random

import pyarrow.parquet as pq
import pytest
from oracle import SF
from pyspark.sql import functions as F

from cellarium.functions import wkb
from cellarium.plans import fixtures as fx
from cellarium.sources import files, geojson, geoparquet

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    """A database in memory with points and buildings, as an extract of a map has them."""
    url = "jdbc:derby:memory:maps;create=true"
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
    points = spark.range(1000).selectExpr("id * 3 + 7 AS osm_id", "concat('n', id) AS name", "139.76D + id / 20000D AS lon", "35.69D + id / 25000D AS lat")
    points.withColumn("geometry", point).write.format("jdbc").options(url=url, dbtable="points", **DERBY).mode("overwrite").save()
    rows = [(k, "yes" if k % 3 == 0 else None, f'"height"=>"{k} m", "name"=>NULL' + (', "building"=>"x"' if k % 4 == 0 else "")) for k in range(200)]
    rows.append((None, "yes", None))
    buildings = spark.createDataFrame(rows, "osm_id long, building string, tags string")
    buildings.write.format("jdbc").options(url=url, dbtable="buildings", **DERBY).mode("overwrite").save()
    return url


def test_database_rows_over_several_parts(spark, database):
    query = 'SELECT "osm_id", "name", "lon", "lat", "geometry" FROM points'
    whole = files.read_table(spark, database, query, **DERBY)
    split = files.read_table(spark, database, query, split="osm_id", part_rows=300, **DERBY)
    assert (whole.rdd.getNumPartitions(), split.rdd.getNumPartitions()) == (1, 4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and whole.count() == 1000
    sizes = split.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 300
    inside = files.within_envelope(files.points_of(split.drop("lon", "lat")), (139.76, 35.69, 139.78, 35.70))
    assert inside.count() == whole.where("lon > 139.76 AND lon < 139.78 AND lat > 35.69 AND lat < 35.70").count() > 0
    few = split.where("lon > 139.8").select("osm_id")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(lon,139.8)" in plan and "name" not in plan.split("ReadSchema")[-1]
    assert few.count() == whole.where("lon > 139.8").count()


def test_database_buildings_by_column_or_tag(spark, database):
    rows = files.read_table(spark, database, 'SELECT "osm_id", "building", "tags" FROM buildings', split="osm_id", parts=3, **DERBY)
    assert rows.count() == 201  # the one without an id comes once
    got = files.tagged_buildings(rows.withColumn("tags", files.tags_of(F.col("tags"))), ["height", "name"]).collect()
    assert {r["osm_id"] for r in got} == {None, *(k for k in range(200) if k % 3 == 0 or k % 4 == 0)}
    assert all(r["height"] == f"{r['osm_id']} m" and r["name"] is None for r in got if r["osm_id"] is not None)


def test_an_empty_table_of_a_database(spark, database):
    none = files.read_table(spark, database, 'SELECT "osm_id", "name" FROM points WHERE "osm_id" < 0', split="osm_id", **DERBY)
    assert none.count() == 0 and none.columns == ["osm_id", "name"]


def test_the_extract_of_points_is_the_published_one():
    text = files.points_query((139.76, 35.69, 139.82, 35.74))
    assert "ST_Within(way, ST_MakeEnvelope(139.76, 35.69, 139.82, 35.74, 4326))" in text and text.count('"') == 16


# GeoParquet


@pytest.fixture(scope="module")
def buildings(spark):
    spark.dataSource.register(geoparquet.GeoParquet)
    rows = fx.buildings(spark, SF).select("osm_id", "height", "xmin", "ymin", "xmax", "ymax")
    return rows.withColumn("geometry", wkb.box_wkb()).repartitionByRange(3, "xmin").sortWithinPartitions("xmin")


def test_geoparquet_comes_back_with_its_footer(spark, buildings, tmp_path):
    path = str(tmp_path / "b")
    buildings.write.format("geoparquet").option("rowGroupRows", 100).mode("overwrite").save(path)
    names = geoparquet._files(path)
    assert len(names) == 3 and not list((tmp_path / "b").glob("_*"))
    for name in names:
        meta = pq.read_metadata(name)
        geo = json.loads(meta.metadata[b"geo"])
        column = geo["columns"][geo["primary_column"]]
        assert (geo["version"], column["encoding"], column["geometry_types"]) == ("1.1.0", "WKB", ["Polygon"])
        bounds = pq.read_table(name)["bbox"].combine_chunks()
        want = [min(bounds.field("xmin").to_pylist()), min(bounds.field("ymin").to_pylist()), max(bounds.field("xmax").to_pylist())]
        assert column["bbox"][:3] == want and column["covering"]["bbox"]["ymax"] == ["bbox", "ymax"]
        assert {meta.row_group(g).num_rows for g in range(meta.num_row_groups - 1)} <= {100}
    got = spark.read.format("geoparquet").load(path)
    assert sorted(got.columns) == ["bbox", "geometry", "height", "osm_id"]
    own = buildings.select("osm_id", "height", "geometry", "xmin", "ymin", "xmax", "ymax")
    back = got.select("osm_id", "height", "geometry", "bbox.*")
    assert sorted(map(str, own.collect())) == sorted(map(str, back.collect()))
    assert got.select(wkb.wkb_box("geometry").alias("b"), "bbox").where("b != bbox").count() == 0


def test_geoparquet_leaves_row_groups_out(spark, buildings, tmp_path):
    path = str(tmp_path / "b")
    buildings.write.format("geoparquet").option("rowGroupRows", 50).mode("overwrite").save(path)
    box = (139.780, 35.70, 139.784, 35.71)
    metas = [pq.read_metadata(f) for f in geoparquet._files(path)]
    met, all_ = (sum(len(geoparquet.groups_meeting(m, b)) for m in metas) for b in (box, None))
    assert 0 < met < all_ / 2
    got = spark.read.format("geoparquet").option("bbox", ",".join(map(str, box))).load(path)
    west, south, east, north = box
    want = buildings.where((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))
    assert {r["osm_id"] for r in got.collect()} == {r["osm_id"] for r in want.collect()} and got.count() == want.count() > 0
    nothing = spark.read.format("geoparquet").option("bbox", "0,0,1,1").load(path)
    assert nothing.count() == 0


def test_geoparquet_appends_overwrites_and_keeps_nulls(spark, buildings, tmp_path):
    path = str(tmp_path / "b")
    few = buildings.limit(10)
    few.write.format("geoparquet").mode("overwrite").save(path)
    few.write.format("geoparquet").mode("append").save(path)
    assert spark.read.format("geoparquet").load(path).count() == 20
    odd = spark.createDataFrame([(1, None, None, None, None, None)], "osm_id long, geometry binary, xmin double, ymin double, xmax double, ymax double")
    odd.write.format("geoparquet").mode("overwrite").save(path)
    row = spark.read.format("geoparquet").load(path).first()
    assert (row["osm_id"], row["geometry"], row["bbox"]) == (1, None, None)
    with pytest.raises(Exception, match="geoparquet needs"):
        spark.range(1).write.format("geoparquet").mode("append").save(path)
    fails = few.withColumn("osm_id", F.when(F.col("osm_id") > 0, F.raise_error(F.lit("broken"))).otherwise(0))
    with pytest.raises(Exception, match="broken"):
        fails.write.format("geoparquet").mode("overwrite").save(path)
    assert spark.read.format("geoparquet").load(path).count() == 1 and not list((tmp_path / "b").glob("_*"))


# GeoJSON


ODD = ["plain", "a { b", "}]}", 'said \\"{\\" twice', "back\\\\", '"type":"Feature"', "[[[", "\u00e9\u3042", "", "x" * 300, "\\", '{"type":"Feature"}']


def collection(rng, n):
    features = []
    for k in range(n):
        ring = [[rng.uniform(-180, 180), rng.uniform(-80, 80)] for _ in range(rng.randint(3, 6))]
        geometry = rng.choice([None, {"type": "Point", "coordinates": ring[0]}, {"type": "Polygon", "coordinates": [ring]}])
        keys = [("type", "Feature"), ("properties", {"id": k, "name": rng.choice(ODD), "other": rng.choice(ODD)}), ("geometry", geometry)]
        rng.shuffle(keys)
        features.append(dict(keys))
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84", "more": {"type": "x"}}}
    return {"type": "FeatureCollection", "crs": crs, "features": features, "bbox": [0, 0, 1, 1]}


def rows_of(df):
    columns = ["properties", "type", "xmin", "ymin", "xmax", "ymax"]
    return sorted(str([sorted(v.items()) if isinstance(v, dict) else v for v in (r[c] for c in columns)]) for r in df.collect())


@pytest.mark.parametrize(("size", "indent"), [(7, None), (64, 2), (1000, None), (1 << 20, 1)])
def test_one_collection_by_many_tasks(spark, tmp_path, size, indent):
    rng = random.Random(size)
    path = tmp_path / "c.json"
    path.write_text(json.dumps(collection(rng, 12 if size == 7 else 60), indent=indent, ensure_ascii=size == 64), encoding="utf-8")
    want = rows_of(files.read_features(spark, str(path)))
    if size == 7:  # some thousand ranges: by the plain functions, without a task each
        with geojson._open(f"file:{path}") as file:
            inside, depth, found = 0, 0, []
            for at in range(0, file.size(), size):
                end = min(at + size, file.size())
                found += geojson._features(file, at, end, bool(inside), depth, 16)
                start = at + geojson._begin(file, at)
                odd, outside, inner = geojson.summary(file.read_at(end - start, start) if end > start else b"")
                depth += inner if inside else outside
                inside ^= odd
        assert (inside, depth) == (0, 0)
        whole = json.loads(path.read_text(encoding="utf-8"))
        assert [f for f in map(json.loads, found) if f.get("type") == "Feature"] == whole["features"]
        return
    got = geojson.read_collection(spark, str(path), size)
    assert rows_of(got) == want and len(want) == 60


def test_collections_of_a_folder_and_none(spark, tmp_path):
    rng = random.Random(3)
    for k in range(3):
        (tmp_path / f"c{k}.json").write_text(json.dumps(collection(rng, 9 * k)))
    assert rows_of(geojson.read_collection(spark, str(tmp_path), 500)) == rows_of(files.read_features(spark, str(tmp_path)))
    (tmp_path / "none").mkdir()
    assert geojson.read_collection(spark, str(tmp_path / "none")).count() == 0
