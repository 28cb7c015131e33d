"""Ranges of Morton keys for query boxes, and joins against them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys


def key_ranges(cells: DataFrame, gap: int, case: list[str], key: str = "key") -> DataFrame:
    """Ranges (lo, hi) of the keys of each case; keys up to ``gap`` apart share one.

    A gap over 1 lets keys in that are not of the box.
    """
    order = Window.partitionBy(*case).orderBy(key)
    marked = cells.select(*case, key).distinct().withColumn(
        "fresh", F.coalesce((F.col(key) - F.lag(key).over(order) > gap).cast("int"), F.lit(1))
    )
    runs = marked.withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy(*case, "run").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).drop("run")


def merged(found: Iterable[int], gap: int = 1) -> list[tuple[int, int]]:
    """The same for the keys of one query box, which are constants of a plan."""
    out: list[tuple[int, int]] = []
    for key in sorted(set(found)):
        if out and key - out[-1][1] <= gap:
            out[-1] = (out[-1][0], key)
        else:
            out.append((key, key))
    return out


def merged_ranges(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that may overlap as ones that don't."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def constants(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A few constant rows as a table that is part of the plan."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")))


def box_ranges(low: tuple[int, ...], high: tuple[int, ...], gap: int = 1) -> list[tuple[int, int]]:
    """Ranges of the Morton keys of a box of places, both ends in, in two or three dimensions.

    The tree of squares (or cubes) over the box is descended from the top: one that lies inside
    is a range as a whole, one that lies outside is left, and only those on the outline are cut
    up. So the work grows with the outline, not with the places inside. Ranges up to ``gap``
    apart are one.
    """
    lo, hi = np.array(low, np.int64), np.array(high, np.int64)
    if (lo > hi).any() or (lo < 0).any():
        raise ValueError("a box begins at 0 or later and ends at its begin or later")
    d = len(low)
    halves = np.stack(np.meshgrid(*[[0, 1]] * d, indexing="ij"), axis=-1).reshape(-1, d)
    at, firsts, lasts = np.zeros((1, d), np.int64), [], []
    for k in range(int(hi.max()).bit_length(), -1, -1):
        first, last = at << k, (at + 1 << k) - 1
        meets = ((first <= hi) & (last >= lo)).all(axis=1)
        inside = meets & ((first >= lo) & (last <= hi)).all(axis=1)
        found = keys.interleaved(at[inside]) << d * k
        firsts.append(found)
        lasts.append(found + (1 << d * k) - 1)
        at = (at[meets & ~inside][:, None] * 2 + halves).reshape(-1, d)
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(first)
    first, last = first[order], last[order]
    fresh = np.append(True, first[1:] - last[:-1] > gap)
    ends = np.append(fresh[1:], True)
    return list(zip(first[fresh].tolist(), last[ends].tolist(), strict=True))


def ranges_of_boxes(boxes: DataFrame, low: list[str], high: list[str], gap: int = 1) -> DataFrame:
    """``boxes`` with a row for each key range (``lo``, ``hi``) of the box that the columns
    ``low`` and ``high`` bound, many boxes an Arrow batch. A box with a null bound, or one that
    ends before it begins, has no ranges."""

    @F.pandas_udf("array<struct<lo:long,hi:long>>")
    def found(*bounds: pd.Series) -> pd.Series:
        d = len(bounds) // 2
        rows = zip(*bounds, strict=True)
        return pd.Series([
            [{"lo": a, "hi": b} for a, b in box_ranges(tuple(map(int, r[:d])), tuple(map(int, r[d:])), gap)] for r in rows
        ], dtype=object)

    fine = boxes.where(reduce(lambda a, b: a & b, (F.col(a) <= F.col(b) for a, b in zip(low, high, strict=True))))
    return fine.withColumn("_ranges", found(*low, *high)).select(*boxes.columns, F.inline("_ranges"))


def outer(found: list[tuple[int, int]], most: int = 16) -> list[tuple[int, int]]:
    """The ranges, with the narrowest gaps closed until there are ``most``."""
    gaps = sorted(range(1, len(found)), key=lambda k: found[k - 1][1] - found[k][0])[: most - 1]
    edges = [0, *sorted(gaps), len(found)]
    return [(found[a][0], found[b - 1][1]) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def within(key: str, found: list[tuple]) -> Column:
    """Whether a column lies in one of a few constant ranges."""
    out = F.lit(False)
    for k, (lo, hi) in enumerate(found):
        one = F.col(key).between(lo, hi)
        out = out | one if k else one
    return out


def box_keys_2d(boxes: DataFrame, z: int) -> DataFrame:
    """Keys of all tiles of query boxes (case, xmin .. ymax)."""
    from .cover import box_cells

    return box_cells(boxes, "morton2d", [z], "case").select("case", F.col("cell").alias("key"))


def box_keys_3d(boxes: DataFrame, xy_z: int, origin: tuple[int, int]) -> DataFrame:
    """Keys of all cells of query boxes (case, vertical_bin_m, xmin .. ymax, low, high)."""
    from .cover import tile_box

    df = tile_box(boxes, F.lit(xy_z)).withColumns(
        {"h0": keys.height_bin("low", F.col("vertical_bin_m")), "h1": keys.height_bin("high", F.col("vertical_bin_m"))}
    )
    for name, a, b in (("x", "x0", "x1"), ("y", "y0", "y1"), ("h", "h0", "h1")):
        df = df.withColumn(name, F.explode(F.sequence(a, b)))
    return df.select(
        "case", "vertical_bin_m", keys.morton3d(F.col("x") - origin[0], F.col("y") - origin[1], "h").alias("key")
    )


def block_shift(found: list[tuple[int, int]], unit: int = 1) -> int:
    """Bits by which keys are cut to blocks, a multiple of ``unit``: the fewest at which
    constant ranges meet about four blocks each."""
    shift = unit
    while sum((hi >> shift) - (lo >> shift) + 1 for lo, hi in found) > 4 * len(found) + 64:
        shift += unit
    return shift


def in_text_ranges(table: DataFrame, found: list[tuple[int, int]], key: str, base: int, digits: int) -> DataFrame:
    """Rows whose key of ``digits`` digits (text of ``base`` 4 or 32, as quadkeys and geohashes
    are) lies in one of the constant ranges, which are apart. Rows meet ranges by the head of
    their key; ranges grow with the outline of a box, so they are broadcast up to a size."""
    bits = 2 if base == 4 else 5
    shift = min(block_shift(found, bits), bits * digits)
    at = [(k, lo, hi) for lo, hi in found for k in range(lo >> shift, (hi >> shift) + 1)]
    head = digits - shift // bits
    rows = [(keys.text_of(k, base, head), keys.text_of(lo, base, digits), keys.text_of(hi, base, digits)) for k, lo, hi in at]
    blocks = constants(table.sparkSession, rows, "_block string, lo string, hi string")
    blocks = F.broadcast(blocks) if len(rows) <= BROADCAST_RANGES else blocks
    joined = table.withColumn("_block", F.substring(key, 1, head)).join(blocks, "_block")
    return joined.where(F.col(key).between(F.col("lo"), F.col("hi"))).drop("_block", "lo", "hi")


#: Most constant ranges that are broadcast; beyond, the join shuffles.
BROADCAST_RANGES = 250_000


def in_ranges(table: DataFrame, ranges: DataFrame, key: str, on: list[str], shift: int = 8, few: bool = False) -> DataFrame:
    """Inner join of rows with the ranges that hold their key, by an equi-join.

    A range is dealt to the blocks of 2^shift keys that it meets; rows join by block and
    are then compared. Ranges of a case don't overlap, so a row comes once a case. The
    ranges of a box grow with its outline, not with the table; where they are ``few``
    constants they are broadcast.
    """
    blocks = ranges.withColumn(
        "_block", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift)))
    )
    placed = table.withColumn("_block", F.shiftright(F.col(key), shift))
    joined = placed.join(F.broadcast(blocks) if few else blocks, [*on, "_block"])
    return joined.where(F.col(key).between(F.col("lo"), F.col("hi"))).drop("_block", "lo", "hi")
