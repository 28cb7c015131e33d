"""Timings, plans and records of benchmark runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import mean

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


def time_query(make: Callable[[], DataFrame], warm: int = 2, runs: int = 5) -> float:
    """Mean milliseconds of ``runs`` runs after ``warm`` ones, planning included; all rows are
    made, none is kept."""

    def once() -> float:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - began) * 1000

    return mean([once() for _ in range(warm + runs)][warm:])


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text, to be kept beside a result."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def counted(hits: DataFrame | None, by: list[str], records: DataFrame, distinct: bool = True) -> DataFrame:
    """``n_rows`` of each record: the osm_ids of its hits, each once if ``distinct``. ``records``
    has all of them, so that those without hits count 0."""
    rows = records.select(*by, F.lit(None).cast("long").alias("osm_id"))
    rows = rows if hits is None else rows.unionByName(hits.select(*by, "osm_id"))
    n = F.count_distinct("osm_id") if distinct else F.count("osm_id")
    return rows.groupBy(*by).agg(n.alias("n_rows"))


def row_group_sweep(df: DataFrame, path: str, by: list[str], sizes: list[int], parts: list[str] | None = None) -> DataFrame:
    """The table written with each size of row groups, and what its files then hold."""
    spark, out = df.sparkSession, None
    for rows in sizes:
        files.write_sorted(df, f"{path}/{rows}", by, parts, rows)
        stats = files.parquet_stats(spark, f"{path}/{rows}").agg(
            *[F.sum(c).alias(c) for c in ("file_size_bytes", "row_count", "row_groups", "column_chunks")]
        )
        stats = stats.select(F.lit(rows).alias("row_group_rows"), "*")
        out = stats if out is None else out.unionByName(stats)
    return out


# Figures of a run


def _metrics(node) -> dict[str, int]:
    """A plan node's metrics by name."""
    found, out = node.metrics(), {}
    names = found.keysIterator()
    while names.hasNext():
        name = names.next()
        out[name] = found.apply(name).value()
    return out


def _nodes(node) -> Iterator:
    """All nodes of a physical plan that has run: what adaptive execution made of it, with the
    stages that it split it into."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(node.plan())
    elif kind == "ReusedExchangeExec":
        return  # counted where it was made
    else:
        yield node
        children = node.children()
        for k in range(children.size()):
            yield from _nodes(children.apply(k))


@dataclass(frozen=True)
class Figures:
    """What a run did: its rows, and over all scans of files their rows, files, partitions and bytes; times in
    milliseconds, those of scans added up over tasks. ``plan`` is the plan that ran."""

    rows: int
    scans: int
    rows_scanned: int
    files_read: int
    bytes_read: int
    scan_ms: int
    rows_shuffled: int
    ms: float
    plan: str


def run_figures(df: DataFrame) -> Figures:
    """Run a query to its end and read the metrics of the plan that ran. No rows come to the driver."""
    df = df.select("*")  # a plan of its own, whose metrics begin at 0
    run = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = run.toRdd().count()
    took = (time.perf_counter() - began) * 1000
    sums = dict.fromkeys(("scans", "numOutputRows", "numFiles", "filesSize", "scanTime", "recordsRead"), 0)
    for node in _nodes(run.executedPlan()):
        kind, metrics = node.getClass().getSimpleName(), None
        if kind in ("FileSourceScanExec", "BatchScanExec"):
            metrics = _metrics(node)
            sums["scans"] += 1
            for name in ("numOutputRows", "numFiles", "filesSize", "scanTime"):
                sums[name] += metrics.get(name, 0)
        elif kind == "ShuffleExchangeExec":
            sums["recordsRead"] += _metrics(node).get("recordsRead", 0)
    return Figures(
        rows, sums["scans"], sums["numOutputRows"], sums["numFiles"], sums["filesSize"], sums["scanTime"], sums["recordsRead"],
        took, run.executedPlan().toString(),
    )


def figures_table(runs: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """A record of each named run: its figures, and how many rows the tables have that it could
    have scanned, which the second of each pair says."""
    spark, out = next(iter(runs.values()))[0].sparkSession, []
    for name, (df, table_rows) in runs.items():
        f = run_figures(df)
        out.append((name, f.rows, table_rows, f.rows_scanned, f.scans, f.files_read, f.bytes_read, f.scan_ms, f.rows_shuffled, round(f.ms, 1)))
    names = "query string, n_rows long, table_rows long, rows_scanned long, scans int, files_read long, bytes_read long"
    return spark.createDataFrame(out, f"{names}, scan_ms long, rows_shuffled long, ms double")


# Row groups that lookups meet


def group_bounds(spark, path: str, columns: list[str]) -> DataFrame:
    """Least and greatest value of number columns in each row group of the Parquet files below a path, from
    their footers alone: file, row group, rows, and ``<column>_min`` and ``<column>_max`` (null
    where a footer has none). A column that is a folder's name has its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inside = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if "://" not in name else name)
                with store.open_input_file(inside) as file:
                    meta = pq.read_metadata(file)
                folder = dict(p.split("=", 1) for p in name.split("/") if "=" in p)
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    bounds = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns))}
                    row = {"file": name, "row_group": g, "rows": group.num_rows}
                    for c in columns:
                        s = bounds.get(c)
                        known = s is not None and s.has_min_max
                        row[f"{c}_min"] = float(folder[c]) if c in folder else float(s.min) if known else None
                        row[f"{c}_max"] = float(folder[c]) if c in folder else float(s.max) if known else None
                    rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    numbers = [f"{c}_{end}" for c in columns for end in ("min", "max")]
    schema = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("rows", pa.int64()), *((n, pa.float64()) for n in numbers)])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return found.select("path").mapInArrow(run, f"file string, row_group int, rows long, {', '.join(f'`{n}` double' for n in numbers)}")


def groups_met(bounds: DataFrame, boxes: DataFrame, by: list[tuple[str, str, str]]) -> DataFrame:
    """For each ``case`` of query boxes the row groups, and their rows, whose bounds it overlaps:
    what a scan with pushed comparisons reads at least. ``by`` lists (column, low, high): a
    table's column and the box's bounds for it. Groups without bounds count as met. The boxes
    are a few rows and are sent to the groups."""
    meets = reduce(
        lambda a, b: a & b,
        (F.coalesce((F.col(f"{c}_min") <= F.col(high)) & (F.col(f"{c}_max") >= F.col(low)), F.lit(True)) for c, low, high in by),
    )
    met = bounds.join(F.broadcast(boxes), meets)
    return met.groupBy("case").agg(F.count("*").alias("row_groups"), F.sum("rows").alias("rows"))
