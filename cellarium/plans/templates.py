"""Lookups as SQL with named parameters, over stored tables.

A user's own query may name the tables and functions likewise: ``prepare`` makes both known to
the session.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import sqlnames
from . import fixtures as fx
from . import layouts

TABLES = ("occupancy_zfxy", "occupancy_zxy_heightbin", "occupancy_morton3d", "obstacles")

_BOX = """x BETWEEN tile_x(:west, {z}) AND tile_x(:east, {z}) AND y BETWEEN tile_y(:north, {z}) AND tile_y(:south, {z})"""

TEMPLATES = {
    "corridor_zfxy": f"""
SELECT DISTINCT osm_id FROM occupancy_zfxy
WHERE zfxy_z = :z AND {_BOX.format(z=':z')}
  AND f BETWEEN height_level(:altitude - :clearance, :z) AND height_level(:altitude + :clearance, :z)""",
    "corridor_zxy_heightbin": f"""
SELECT DISTINCT osm_id FROM occupancy_zxy_heightbin
WHERE xy_z = :z AND vertical_bin_m = :bin_m AND {_BOX.format(z=':z')}
  AND hbin BETWEEN height_bin(:altitude - :clearance, :bin_m) AND height_bin(:altitude + :clearance, :bin_m)""",
    "corridor_morton3d": """
SELECT DISTINCT osm_id FROM occupancy_morton3d
WHERE xy_z = :z AND vertical_bin_m = :bin_m
  AND key_u64 BETWEEN array_min(:firsts) AND array_max(:lasts)
  AND exists(sequence(0, size(:firsts) - 1), k -> key_u64 BETWEEN get(:firsts, k) AND get(:lasts, k))""",
    "lookup_cells": f"""
SELECT DISTINCT x, y FROM occupancy_zxy_heightbin
WHERE xy_z = :z AND vertical_bin_m = :bin_m AND {_BOX.format(z=':z')}
  AND hbin BETWEEN height_bin(:altitude - :clearance, :bin_m) AND height_bin(:altitude + :clearance, :bin_m)""",
}


def prepare(spark: SparkSession, sf_dir: str, tables: Sequence[str] = TABLES) -> None:
    """The key functions, and stored tables as views, by their names. A table that isn't there
    yet is written, so that who needs some names them."""
    sqlnames.register(spark)
    for name in tables:
        layouts.stored(spark, sf_dir, name).createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, template: str, **parameters) -> DataFrame:
    """A template over the stored tables of a folder. Parameters are values, never text of the
    query: numbers, or arrays as lists. Corridors take the study area where none is given."""
    west, south, east, north = fx.CORRIDOR
    known = {"west": west, "south": south, "east": east, "north": north, "clearance": float(fx.CLEARANCE_M), "z": fx.XY_ZOOM}
    prepare(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", TEMPLATES[template])])
    return spark.sql(TEMPLATES[template], args=known | parameters)
