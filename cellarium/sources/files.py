"""Sorted Parquet tables, GeoJSON, database extracts, file statistics, and result summaries."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: the one ``spark.checkpoint.dir`` names. Where that is
    unset, a local session uses a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="cellarium-")


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change of each file below a path, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()) if store.exists(at) else []


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder to a name that isn't taken; False if it is."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    store = a.getFileSystem(spark._jsc.hadoopConfiguration())
    return not store.exists(b) and store.rename(a, b)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_sorted(
    df: DataFrame, path: str, by: list[str], parts: list[str] | None = None, rows: int = ROW_GROUP_ROWS, files: int | None = None, dealt: bool = False,
    number: Column | None = None,
) -> None:
    """Write in order of ``by``: ranges of it in files, sorted inside, in row groups of at
    most ``rows`` rows, so that the groups' least and greatest values prune well. Each value
    of ``parts`` has a folder of its own. Without ``files`` the sizes at run time set their
    number. Rows that are ``dealt`` already stay in their tasks, each of which sorts its own. With
    ``number``, one number of a row that is in order of ``by``, they are sorted by it alone, and a
    task has a file open for each of ``parts``, of which there are few then."""
    order = [*(parts or []), *by]
    if not dealt:
        df = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    df = df.sortWithinPartitions(*order) if number is None else df.sortWithinPartitions(number)
    with files_at_once(df.sparkSession, 0 if number is None else MOST_PARTS):
        writer = df.write.mode("overwrite").option("compression", "snappy")
        writer = writer.partitionBy(*parts) if parts else writer
        writer.option("parquet.block.row.count.limit", str(rows)).parquet(path)


#: Folders that a task writes to at once, at most.
MOST_PARTS = 8


@contextmanager
def files_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it a task writes to up to ``most`` folders at once; with 0 to one after the other, for which rows are sorted by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def with_point_box(points: DataFrame) -> DataFrame:
    return points.withColumns({"xmin": F.col("lon"), "ymin": F.col("lat"), "xmax": F.col("lon"), "ymax": F.col("lat")})


# GeoJSON


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON files: properties as a map, the geometry's type and box.

    A file is a collection or one feature; with ``lines`` each line is one. A feature
    without geometry has nulls.
    """
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    kind = f"type string, features array<{feature}>, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    whole = spark.read.schema(kind).option("multiLine", not lines).json(path)
    own = F.array(F.struct("properties", "geometry"))
    rows = whole.select(F.explode(F.when(F.col("type") == "Feature", own).otherwise(F.col("features"))).alias("f"))
    rows = rows.select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    return rows.select("properties", "type", *coordinate_box(F.col("coordinates")))


def coordinate_box(coordinates: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of coordinates as JSON text, nested to any depth. Of each
    position the first two numbers count; null and empty coordinates give nulls."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    position = rf"\[\s*{number}\s*,\s*{number}"
    of = lambda k: F.transform(
        F.regexp_extract_all(coordinates, F.lit(position), F.lit(k)), lambda v: v.cast("double")
    )
    names = [("xmin", F.array_min, 1), ("ymin", F.array_min, 2), ("xmax", F.array_max, 1), ("ymax", F.array_max, 2)]
    return [f(of(k)).alias(n) for n, f, k in names]


def point_geometry(lon: str = "lon", lat: str = "lat") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def box_geometry() -> Column:
    """The rectangle xmin .. ymax as a polygon of one closed ring."""
    ring = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(x, y) for x, y in ring])).alias("coordinates"))


def write_features(df: DataFrame, path: str, properties: list[str], geometry: Column | None = None) -> None:
    """GeoJSON: each file of the folder is a collection, with a feature a line. The geometry
    is a point (lon, lat) unless given."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        (point_geometry() if geometry is None else geometry).alias("geometry"),
    )

    def collection(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = '{"type":"FeatureCollection","features":['
        for batch in batches:
            if len(batch):
                first, rest = batch["value"].iloc[:1], batch["value"].iloc[1:]
                yield pd.DataFrame({"value": [*(before + first), *("," + rest)]})
                before = ","
        yield pd.DataFrame({"value": ["]}" if before == "," else before + "]}"]})

    df.select(F.to_json(feature).alias("value")).mapInPandas(collection, "value string").write.mode("overwrite").text(path)


# Database extracts


def read_table(
    spark: SparkSession, url: str, query: str, split: str | None = None, parts: int | None = None, part_rows: int = 500_000, **options: str
) -> DataFrame:
    """A query of a database, for extracts of map data; geometries and tags come as text.

    With ``split``, a column of whole numbers in the result, the rows are read in ``parts`` by
    ranges of it between its least and greatest value (rows without a value come with the first),
    each by a task with a connection of its own; without ``parts`` in as many as make
    about ``part_rows`` rows each. Columns and comparisons that a plan needs of the result are sent to the
    database with the query. Names are put in double quotes.
    """
    source = spark.read.format("jdbc").options(url=url, **options)
    if split is None:
        return source.option("dbtable", f"({query}) q").load()
    about = f'(SELECT MIN("{split}") AS "lo", MAX("{split}") AS "hi", COUNT(*) AS "n" FROM ({query}) q) b'
    lo, hi, n = source.option("dbtable", about).load().first()
    whole = source.option("dbtable", f"({query}) q")
    if lo is None:
        return whole.load()
    parts = parts or max(1, -(-n // part_rows))
    return whole.options(partitionColumn=split, lowerBound=str(int(lo)), upperBound=str(int(hi) + 1), numPartitions=str(parts)).load()


def points_query(box: tuple[float, float, float, float], table: str = "planet_osm_point") -> str:
    """The extract of named points inside a box from a map database with geometry functions."""
    tags = ", ".join(f'"{t}"' for t in ("name", "amenity", "shop", "tourism", "historic", "leisure"))
    envelope = ", ".join(repr(float(v)) for v in box)
    return (
        f'SELECT "osm_id", {tags}, ST_AsGeoJSON(way) AS "geometry" FROM {table} WHERE ST_Within(way, ST_MakeEnvelope({envelope}, 4326))'
    )


def points_of(rows: DataFrame) -> DataFrame:
    """Extracted points with lon and lat in place of the text of their geometry."""
    at = F.from_json("geometry", "struct<type:string,coordinates:array<double>>")
    rows = rows.withColumn("_at", at).withColumns({"lon": F.get("_at.coordinates", F.lit(0)), "lat": F.get("_at.coordinates", F.lit(1))})
    return rows.drop("_at", "geometry")


def tags_of(text: Column) -> Column:
    """A map from key-value text as databases print it: "key"=>"value", parted by commas. A value
    is NULL without quotes where there is none; an empty text in quotes is a value."""
    pair = r'"((?:[^"\\]|\\.)*)"\s*=>\s*("(?:[^"\\]|\\.)*"|NULL)'
    plain = lambda v: F.regexp_replace(v, r"\\(.)", "$1")
    values = F.transform(
        F.regexp_extract_all(text, F.lit(pair), F.lit(2)), lambda v: F.when(v != "NULL", plain(F.substr(v, F.lit(2), F.length(v) - 2)))
    )
    return F.map_from_arrays(F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), plain), values)


def tagged_buildings(rows: DataFrame, tags: list[str]) -> DataFrame:
    """Rows that are buildings by their column ``building`` or by a tag of that name, with the
    given tags of the map ``tags`` as columns; missing tags are null."""
    kept = rows.where(F.col("building").isNotNull() | F.map_contains_key("tags", "building"))
    return kept.select("osm_id", "building", *[F.try_element_at("tags", F.lit(t)).alias(t.replace(":", "_")) for t in tags])


def within_envelope(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside the box, its border left out."""
    west, south, east, north = box
    return points.where((F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north))


# Statistics and summaries


def parquet_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: bytes, rows, row groups and column chunks (both, as reports mix them up).

    Tasks read footers only, through a handle that seeks. A file that can't be read as
    Parquet, or lies in a store that only Spark knows, has 0 rows and null groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, groups, chunks = 0, None, None
                try:
                    store, inside = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if "://" not in name else name)
                    with store.open_input_file(inside) as file:
                        meta = pq.read_metadata(file)
                    rows, groups, chunks = meta.num_rows, meta.num_row_groups, meta.num_row_groups * meta.num_columns
                except (OSError, ValueError):  # pyarrow's errors are kinds of these
                    pass
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rsplit("/", 1)[-1]]), *(pa.array([v], pa.int64()) for v in (size, rows, groups, chunks))],
                    ["file", "file_size_bytes", "row_count", "row_groups", "column_chunks"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").mapInArrow(
        run, "file string, file_size_bytes long, row_count long, row_groups long, column_chunks long"
    )


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_markdown(df: DataFrame) -> str:
    """A result as a Markdown table: all its rows, a partition at a time."""
    rows = [df.columns, ["---"] * len(df.columns), *df.toLocalIterator()]
    return "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)


def write_metadata(spark: SparkSession, path: str, about: dict) -> None:
    """A JSON object of one run, beside its results."""
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The object that ``write_metadata`` wrote."""
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def union_summaries(frames: dict[str, DataFrame]) -> DataFrame:
    """Result tables with differing columns, one below the other, with their ``source``."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """All CSV summaries below ``root``, each with its own columns, as text, and its ``source``,
    the path from ``root`` to its folder. There are as many as runs were made, so their
    paths, not their rows, come to the driver."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(root)
    folders = sorted(r["folder"] for r in found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect())
    if not folders:
        raise FileNotFoundError(f"no CSV summary below {root}")
    top = spark._jvm.org.apache.hadoop.fs.Path(root)  # as the listing names it, whatever its scheme
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    plain = lambda path: path.replace("file:///", "file:/", 1).rstrip("/")
    name = lambda folder: plain(folder)[len(plain(top)) + 1 :]
    return union_summaries({name(f): spark.read.option("header", True).csv(f) for f in folders})


def latest(results: DataFrame, run: str = "run") -> DataFrame:
    """The rows of the greatest run key of each benchmark, not of the last folder by name."""
    last = results.groupBy("benchmark").agg(F.max(run).alias(run))
    return results.join(F.broadcast(last), ["benchmark", run], "left_semi")  # a row a benchmark
