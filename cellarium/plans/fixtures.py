"""Points and buildings derived from the star-schema tables by integer arithmetic, so that
any engine computes the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS_SQL = """
SELECT event_id AS osm_id,
       CAST(139.76 AS DOUBLE) + ((event_id*7919)%60000)/CAST(1000000 AS DOUBLE) AS lon,
       CAST(35.69 AS DOUBLE) + ((event_id*104729)%50000)/CAST(1000000 AS DOUBLE) AS lat
FROM {events}
"""

#: Every 500th building is over a cap; tags take in turn what the height model must parse,
#: now and then with white space around.
BUILDINGS_SQL = """
SELECT osm_id, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax,
       height, building_levels, min_height, building_min_level
FROM (SELECT o_orderkey AS osm_id,
  CAST(139.76 AS DOUBLE) + ((o_orderkey*7919)%60000)/CAST(1000000 AS DOUBLE) AS xmin,
  CAST(35.69 AS DOUBLE) + ((o_orderkey*104729)%50000)/CAST(1000000 AS DOUBLE) AS ymin,
  CASE WHEN o_orderkey%500=0 THEN CAST(0.02 AS DOUBLE)
       ELSE (20+(o_orderkey%13)*10)/CAST(1000000 AS DOUBLE) END AS w,
  CASE WHEN o_orderkey%500=0 THEN CAST(0.02 AS DOUBLE)
       ELSE (20+(o_orderkey%17)*10)/CAST(1000000 AS DOUBLE) END AS h,
  CASE WHEN o_orderkey%240=0 THEN '12' || chr(160) || 'm' WHEN o_orderkey%240=180 THEN chr(160) || '30' || chr(160) || 'ft'
    WHEN o_orderkey%120=0 THEN '12' || chr(9) WHEN o_orderkey%120=60 THEN chr(10) || '12 m ' || chr(13)
    ELSE CASE o_orderkey%12 WHEN 0 THEN '12' WHEN 1 THEN '12 m' WHEN 2 THEN '12.5' WHEN 3 THEN '30 ft'
    WHEN 4 THEN '10;12' WHEN 5 THEN 'unknown' WHEN 7 THEN ' 45 Metres ' WHEN 8 THEN '100 feet'
    WHEN 9 THEN '-3' WHEN 10 THEN '9999' WHEN 11 THEN '12d' END END AS height,
  CASE WHEN o_orderkey%70=0 THEN chr(9) || '5' || chr(10) ELSE CASE o_orderkey%7 WHEN 0 THEN '5' WHEN 1 THEN '0' WHEN 2 THEN '2.5' WHEN 4 THEN 'abc'
    WHEN 5 THEN '12' WHEN 6 THEN '600' END END AS building_levels,
  CASE WHEN o_orderkey%11=0 THEN '20' END AS min_height,
  CASE WHEN o_orderkey%13=0 THEN '3' END AS building_min_level
 FROM {orders}) q
"""

#: Fixed values of the study area: corridor, viewport centre, and query sizes.
CORRIDOR = (139.784450, 35.695, 139.785550, 35.731)  # west, south, east, north
CORRIDOR_LON, SOUTH, NORTH = 139.785, 35.695, 35.731
CLEARANCE_M = 5
CENTRE_LON, CENTRE_LAT = 139.785, 35.713
SIDES = {"01": 0.01, "05": 0.05, "10": 0.1}
RADII_M = [500, 1000, 2000]
ZFXY_ZOOMS, XY_ZOOM, BINS_M = [19, 20, 21, 22], 19, [4, 8, 16]
RESOLUTIONS = {"hex": [7, 8, 9, 10], "geohash": [5, 6, 7, 8], "quadkey": [15, 17, 19], "morton2d": [19]}

#: The tallest derived building has 45 m, so these give many, some, few and no hits.
ALTITUDES_M = [5, 30, 45, 60]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BUILDINGS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))


def viewport(side: float) -> tuple[float, float, float, float]:
    half = side / 2
    return CENTRE_LON - half, CENTRE_LAT - half, CENTRE_LON + half, CENTRE_LAT + half
