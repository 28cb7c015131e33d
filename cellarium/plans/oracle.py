"""The same key formulas in another engine's SQL, written bit by bit, to hold results against."""

from __future__ import annotations

from ..functions.keys import GEOHASH_DIGITS, geohash_bits
from .fixtures import BUILDINGS_SQL, POINTS_SQL


def x(lon: str, z: int | str) -> str:
    return f"CAST(floor(pow(2.0::DOUBLE, {z}) * (({lon} + 180) / 360)) AS BIGINT)"


def y(lat: str, z: int | str) -> str:
    phi = f"radians({lat})"
    return f"CAST(floor(pow(2.0::DOUBLE, {z}) * (1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2) AS BIGINT)"


def level(h: str, z: int | str) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, {h}) * pow(2.0::DOUBLE, {z}) / 33554432.0::DOUBLE) AS BIGINT)"


def hbin(h: str, v: int | str) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, {h}) / {v}) AS BIGINT)"


def morton2(a: str, b: str) -> str:
    bits = f"((({a} >> b) & 1) << (2 * b)) + ((({b} >> b) & 1) << (2 * b + 1))"
    return f"CAST(list_sum(list_transform(range(31), lambda b: {bits})) AS BIGINT)"


def morton3(a: str, b: str, c: str) -> str:
    clip = lambda v: f"least(greatest({v}, 0), 2097151)"
    bits = " + ".join(f"((({clip(v)} >> b) & 1) << (3 * b + {k}))" for k, v in enumerate((a, b, c)))
    return f"CAST(list_sum(list_transform(range(21), lambda b: {bits})) AS BIGINT)"


def quadkey(a: str, b: str, z: int) -> str:
    return f"array_to_string(list_transform(range({z - 1}, -1, -1), lambda b: (({a} >> b) & 1) + 2 * (({b} >> b) & 1)), '')"


def geohash(i: str, j: str, p: int) -> str:
    nx, ny = geohash_bits(p)
    bit = lambda k: (
        f"(CASE WHEN (5*c+{k}) % 2 = 0 THEN {i} >> CAST({nx - 1} - (5*c+{k})//2 AS BIGINT)"
        f" ELSE {j} >> CAST({ny - 1} - (5*c+{k}-1)//2 AS BIGINT) END & 1)"
    )
    value = " + ".join(f"{2 ** (4 - k)} * {bit(k)}" for k in range(5))
    return f"array_to_string(list_transform(range({p}), lambda c: substr('{GEOHASH_DIGITS}', CAST(1 + {value} AS BIGINT), 1)), '')"


def _within(cell: str, bits: int) -> str:
    return f"CAST(least(greatest({cell}, 0), {2**bits - 1}) AS BIGINT)"


def geohash_i(lon: str, p: int, last: bool = False) -> str:
    """A value on a border belongs to the cell before it; the last cell of a box is the one after."""
    place, bits = f"({lon} + 180) / 360.0::DOUBLE * {2 ** geohash_bits(p)[0]}", geohash_bits(p)[0]
    return _within(f"floor({place})" if last else f"ceil({place}) - 1", bits)


def geohash_j(lat: str, p: int, last: bool = False) -> str:
    place, bits = f"({lat} + 90) / 180.0::DOUBLE * {2 ** geohash_bits(p)[1]}", geohash_bits(p)[1]
    return _within(f"floor({place})" if last else f"ceil({place}) - 1", bits)


def quadkey_x(lon: str, z: int) -> str:
    return _within(x(lon, z), z)


def quadkey_y(lat: str, z: int) -> str:
    return _within(y(lat, z), z)


NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


#: White space, of ASCII or not.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({stripped(text)}, '{NUMBER}') THEN try_cast({stripped(text)} AS DOUBLE) END"


def height(tag: str) -> str:
    first = stripped(f"string_split({stripped(tag)}, ';')[1]")
    feet = f"regexp_matches({first}, '(?i)(ft|feet|foot)$')"
    value = number(f"regexp_replace({first}, '(?i){SPACE}*(ft|feet|foot|m|meters?|metres?)$', '')")
    metres = f"(CASE WHEN {feet} THEN ({value}) * 0.3048::DOUBLE ELSE {value} END)"
    return f"CASE WHEN {metres} > 0 AND {metres} < 9999 THEN CASE WHEN {feet} THEN round({metres}, 2) ELSE {metres} END END"


def levels(tag: str) -> str:
    value = f"({number(tag)})"
    return f"CASE WHEN {value} > 0 AND {value} < 500 THEN {value} END"


POINTS = f"points AS ({POINTS_SQL.format(events='events')})"
BUILDINGS = f"buildings AS ({BUILDINGS_SQL.format(orders='orders')})"
OBSTACLES = f"""{BUILDINGS}, parsed AS (
  SELECT *, {height('height')} AS hm, {levels('building_levels')} AS lv, {height('min_height')} AS lo,
         {levels('building_min_level')} AS ml FROM buildings
), obstacles AS (
  SELECT osm_id, xmin, ymin, xmax, ymax, coalesce(hm, lv * 3.0, 15.0)::DOUBLE AS max_height_m,
         coalesce(lo, ml * 3.0, 0.0)::DOUBLE AS min_height_m,
         CASE WHEN hm IS NOT NULL THEN 'height' WHEN lv IS NOT NULL THEN 'building:levels_estimated'
              ELSE 'default_15m' END AS height_source, lv AS levels, ml AS min_level
  FROM parsed
)"""


def tile_box(source: str, z: str, more: str = "") -> str:
    """Tile boxes of a table with xmin .. ymax; the derived boxes have xmin < xmax."""
    return f"""SELECT *, {x('xmin', z)} AS x0, {x('xmax', z)} AS x1, {y('ymax', z)} AS y0, {y('ymin', z)} AS y1{more}
  FROM {source}"""


def sized_zfxy(zooms: list[int]) -> str:
    zs = ", ".join(f"({z})" for z in zooms)
    more = f", {level('min_height_m', 'z')} AS v0, {level('max_height_m', 'z')} AS v1"
    return _sized(tile_box(f"(SELECT * FROM obstacles, (VALUES {zs}) t(z))", "z", more))


def sized_bins(z: int, bins: list[int]) -> str:
    vs = ", ".join(f"({v})" for v in bins)
    more = f", {hbin('min_height_m', 'v')} AS v0, {hbin('max_height_m', 'v')} AS v1"
    return _sized(tile_box(f"(SELECT * FROM obstacles, (VALUES {vs}) t(v))", str(z), more))


def _sized(boxed: str) -> str:
    return f"""boxed AS ({boxed}), sized AS (
  SELECT *, (x1-x0+1)*(y1-y0+1) > 200 OR (x1-x0+1)*(y1-y0+1)*(v1-v0+1) > 1000 AS over FROM boxed
), cells AS (
  SELECT s.*, a.x, b.y, c.h FROM (SELECT * FROM sized WHERE NOT over AND v0 <= v1) s,
    LATERAL (SELECT unnest(range(s.x0, s.x1 + 1)) AS x) a, LATERAL (SELECT unnest(range(s.y0, s.y1 + 1)) AS y) b,
    LATERAL (SELECT unnest(range(s.v0, s.v1 + 1)) AS h) c
)"""


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


def merged(cells: str, case: str, gap: int) -> str:
    """Ranges of keys of each case, from a table with the case and key columns."""
    return f"""SELECT {case}, min(key) AS lo, max(key) AS hi FROM (
    SELECT {case}, key, sum(fresh) OVER (PARTITION BY {case} ORDER BY key) AS run FROM (
      SELECT {case}, key, CASE WHEN key - lag(key) OVER (PARTITION BY {case} ORDER BY key) <= {gap} THEN 0 ELSE 1 END AS fresh
      FROM (SELECT DISTINCT {case}, key FROM {cells}) d) m) r GROUP BY {case}, run"""
