"""Viewport, radius, corridor and blocked-cell lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most cells of a query cover that are broadcast; beyond, the join shuffles.
BROADCAST_CELLS = 250_000


def by_cells(table: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """resolution and osm_id of rows whose cell is among ``cells``."""
    wanted = cells.select("resolution", "cell")
    wanted = F.broadcast(wanted) if n_cells <= BROADCAST_CELLS else wanted
    return table.join(wanted, ["resolution", "cell"], "left_semi").select("resolution", "osm_id")


def points_in_box(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Point boxes that lie in the box; on stored boxes the comparisons are pushed down."""
    west, south, east, north = box
    return points.where(
        (F.col("xmin") >= west) & (F.col("xmax") <= east) & (F.col("ymin") >= south) & (F.col("ymax") <= north)
    ).select("osm_id")


def boxes_meeting(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = box
    apart = (F.col("xmax") < west) | (F.col("xmin") > east) | (F.col("ymax") < south) | (F.col("ymin") > north)
    return boxes.where(~apart).select("osm_id")


def in_cell_boxes(stored: DataFrame, cases: list[dict], part: str, within: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with the ``case`` whose box holds them, once a case.

    ``cases`` are a few dicts of constants; the column ``part`` must be equal, ``within``
    columns lie between two fields. Each value of ``part`` is one scan, to which the least
    and greatest bounds of its cases go as plain comparisons; which cases a row is in is an
    expression, so that there is no join.
    """
    out = None
    for value in sorted({c[part] for c in cases}):
        own = [c for c in cases if c[part] == value]
        bounds = [F.col(c).between(min(k[lo] for k in own), max(k[hi] for k in own)) for c, (lo, hi) in within.items()]
        both = lambda a, b: a & b
        fits = lambda k: reduce(both, (F.col(c).between(k[lo], k[hi]) for c, (lo, hi) in within.items()))  # noqa: E731, B023
        found = F.array_compact(F.array(*[F.when(fits(k), F.lit(k["case"])) for k in own]))
        rows = stored.where(reduce(both, [F.col(part) == value, *bounds])).select("*", F.explode(found).alias("case"))
        out = rows if out is None else out.unionByName(rows)
    return out


def cells_of_boxes(stored: DataFrame, cases: list[dict], part: str) -> DataFrame:
    """``case``, x and y of the cells that stored cell boxes (x0 .. x1, y0 .. y1, v0 .. v1) have in the box of a case.

    Scans are as those of ``in_cell_boxes``. A box is cut to the case's before any row is made of it, then a row a
    column; of those of a column that begin in the same row the longest stays. So at most a cell of the case's
    box times its height is made, however many boxes there are and however large they are. A cell may come more than once.
    """
    out = None
    for value in sorted({c[part] for c in cases}):
        own = [c for c in cases if c[part] == value]
        meets = lambda k: reduce(lambda a, b: a & b, ((F.col(f"{c}0") <= k[f"{c}1"]) & (F.col(f"{c}1") >= k[f"{c}0"]) for c in "xyv"))
        widest = {f"{c}{n}": f(k[f"{c}{n}"] for k in own) for c in "xyv" for n, f in ((0, min), (1, max))}
        cut = lambda k: F.struct(F.lit(k["case"]).alias("case"), *[
            f(F.col(n), F.lit(k[n])).alias(n) for n, f in (("x0", F.greatest), ("x1", F.least), ("y0", F.greatest), ("y1", F.least))
        ])
        found = F.array_compact(F.array(*[F.when(meets(k), cut(k)) for k in own]))
        rows = stored.where((F.col(part) == value) & meets(widest)).select(F.inline(found))
        out = rows if out is None else out.unionByName(rows)
    columns = out.select("case", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").groupBy("case", "x", "y0").agg(F.max("y1").alias("y1"))
    return columns.select("case", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def candidates(hits: DataFrame, names: list[str]) -> DataFrame:
    """Cells and distinct buildings of each case; cases without any count 0."""
    none = hits.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("case"), F.lit(None).cast(hits.schema["osm_id"].dataType).alias("osm_id")
    )
    return hits.select("case", "osm_id").unionByName(none).groupBy("case").agg(
        F.count("osm_id").alias("candidate_cells"), F.count_distinct("osm_id").alias("candidate_buildings")
    )


def blocking(obstacles: DataFrame, box: tuple[float, float, float, float], low: Column, high: Column) -> Column:
    """Whether an obstacle's box and height range meet the corridor."""
    west, south, east, north = box
    return (
        (F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south)
        & (F.col("max_height_m") >= low) & (F.col("min_height_m") <= high)
    )


def false_positive_rate(candidates: Column, actual: Column) -> Column:
    """Per cent of candidates that are none, to one place; null without candidates."""
    return F.when(candidates > 0, F.round((candidates - actual) / candidates * 100, 1))
