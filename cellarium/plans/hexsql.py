"""The hexagon formulas in another engine's SQL, to hold results against."""

from __future__ import annotations

import math

from ..functions import hexgrid as hx

_ROWS = ", ".join(
    f"({k}, " + ", ".join(f"{float(v)!r}::DOUBLE" for row in (hx.CENTRES, hx.AXES, hx.LEFTS) for v in row[k]) + ")" for k in range(20)
)
FACES = f"faces(k, c0, c1, c2, a0, a1, a2, l0, l1, l2) AS (VALUES {_ROWS})"


def _dot(p: str, axis: str) -> str:
    return f"({p}0 * f.{axis}0 + {p}1 * f.{axis}1 + {p}2 * f.{axis}2)"


def _turned(x: str, y: str, r: int, back: bool = False) -> tuple[str, str]:
    if r % 2 == 0:
        return x, y
    c, s = repr(math.cos(hx.TURN)), repr(math.sin(hx.TURN))
    if back:
        return f"({x} * {c} - {y} * {s})", f"({x} * {s} + {y} * {c})"
    return f"({x} * {c} + {y} * {s})", f"({y} * {c} - {x} * {s})"


def _scale(r: int) -> str:
    return f"{math.sqrt(7) ** r / hx.UNIT_RESOLUTION_0!r}::DOUBLE"


def sphere(lat: str, lon: str, p: str = "p") -> str:
    return (
        f"cos(radians({lat})) * cos(radians({lon})) AS {p}0, cos(radians({lat})) * sin(radians({lon})) AS {p}1, sin(radians({lat})) AS {p}2"
    )


def on_face(source: str, p: str = "p", face: str = "face") -> str:
    return f"(SELECT t.*, (SELECT arg_max(f.k, {_dot('t.' + p, 'c')}) FROM faces f) AS {face} FROM {source} t)"


def plane(source: str, r: int, p: str, face: str, q: str, s: str) -> str:
    """Fractional lattice place of p on the face."""
    away = _dot("t." + p, "c")
    x, y = (f"({_dot('t.' + p, axis)} / {away} * {_scale(r)})" for axis in "al")
    x, y = _turned(x, y, r)
    return f"""(SELECT * EXCLUDE (_x, _y), _x - (_y * (2 / sqrt(3))) / 2 AS {q}, _y * (2 / sqrt(3)) AS {s}
      FROM (SELECT t.*, {x} AS _x, {y} AS _y FROM {source} t JOIN faces f ON f.k = t.{face}) u)"""


def lattice(source: str, r: int, p: str = "p", face: str = "face", q: str = "q", s: str = "s") -> str:
    dq, ds, dt = "abs(round(_q) - _q)", "abs(round(_s) - _s)", "abs(round(-_q - _s) - (-_q - _s))"
    worst = f"{dq} > {ds} AND {dq} > {dt}"
    return f"""(SELECT * EXCLUDE (_q, _s),
      CAST(CASE WHEN {worst} THEN -round(_s) - round(-_q - _s) ELSE round(_q) END AS BIGINT) AS {q},
      CAST(CASE WHEN {worst} THEN round(_s) WHEN {ds} > {dt} THEN -round(_q) - round(-_q - _s) ELSE round(_s) END AS BIGINT) AS {s}
      FROM {plane(source, r, p, face, '_q', '_s')} v)"""


def centred(source: str, r: int) -> str:
    """m0, m1, m2: the middle of the cell face, q, s."""
    x, y = _turned("(t.q + t.s * 0.5)", f"(t.s * {math.sqrt(3) / 2!r})", r, back=True)
    x, y = f"({x} / {_scale(r)})", f"({y} / {_scale(r)})"
    middle = ", ".join(f"f.c{k} + {x} * f.a{k} + {y} * f.l{k} AS m{k}" for k in range(3))
    return f"(SELECT t.*, {middle} FROM {source} t JOIN faces f ON f.k = t.face)"


def named(source: str, r: int, ids: str) -> str:
    found = lattice(on_face(centred(source, r), "m", "home"), r, "m", "home", "hq", "hs")
    return f"SELECT {ids}, {r} AS resolution, 'hex{r}/' || home || '/' || hq || '/' || hs AS cell FROM {found} n"


def point_cells(source: str, r: int, id_col: str = "osm_id", lat: str = "lat", lon: str = "lon") -> str:
    placed = f"(SELECT {id_col}, {sphere(lat, lon)} FROM {source})"
    return named(lattice(on_face(placed), r), r, id_col)


def disk_cells(source: str, r: int, k: int, ids: str) -> str:
    placed = lattice(on_face(f"(SELECT {ids}, {sphere('lat', 'lon')} FROM {source})"), r)
    around = f"""(SELECT {ids}, face, q + a AS q, s + b AS s FROM {placed} d, (SELECT unnest(range({-k}, {k + 1})) AS a) x,
      (SELECT unnest(range({-k}, {k + 1})) AS b) y WHERE abs(a + b) <= {k})"""
    return named(around, r, ids)


def box_cells(source: str, r: int, id_col: str = "osm_id") -> str:
    box = f"{id_col}, xmin, ymin, xmax, ymax"
    numbered = f"(SELECT row_number() OVER () AS n, {box}, {sphere('(ymin + ymax) / 2', '(xmin + xmax) / 2')} FROM {source})"
    middle = f"(SELECT n, {box}, face, q AS mq, s AS ms FROM {lattice(on_face(numbered), r)} z)"
    corners = middle
    for k, (a, b) in enumerate((a, b) for a in ("xmin", "xmax") for b in ("ymin", "ymax")):
        corners = plane(f"(SELECT *, {sphere(b, a, f'k{k}_')} FROM {corners} c{k})", r, f"k{k}_", "face", f"u{k}", f"v{k}")
    least = lambda f, v: f"CAST(floor({f}({', '.join(f'{v}{k}' for k in range(4))})) AS BIGINT)"
    cells = f"""(SELECT n, {box}, face, mq, ms, x.q, y.s FROM {corners} b,
      LATERAL (SELECT unnest(range({least('least', 'u')} - 1, {least('greatest', 'u')} + 3)) AS q) x,
      LATERAL (SELECT unnest(range({least('least', 'v')} - 1, {least('greatest', 'v')} + 3)) AS s) y)"""
    lat, lon = "degrees(atan2(m2, sqrt(m0 * m0 + m1 * m1)))", "degrees(atan2(m1, m0))"
    seen = f"(SELECT *, {lon} BETWEEN xmin AND xmax AND {lat} BETWEEN ymin AND ymax AS inside FROM {centred(cells, r)} e)"
    kept = f"""(SELECT {id_col}, face, q, s FROM (SELECT *, bool_or(inside) OVER (PARTITION BY n) AS filled FROM {seen} g) h
      WHERE inside OR (NOT filled AND q = mq AND s = ms))"""
    return named(kept, r, id_col)


def polygon_cells(polygons: str, edges: str, r: int, id_col: str = "osm_id") -> str:
    """Cells whose middle is inside a polygon: ``polygons`` has the id and box, ``edges`` the id and x1, y1, x2, y2."""
    box = f"{id_col}, xmin, ymin, xmax, ymax"
    placed = f"(SELECT {box}, {sphere('(ymin + ymax) / 2', '(xmin + xmax) / 2')} FROM {polygons})"
    corners = f"(SELECT {box}, face FROM {on_face(placed)} z)"
    for k, (a, b) in enumerate((a, b) for a in ("xmin", "xmax") for b in ("ymin", "ymax")):
        corners = plane(f"(SELECT *, {sphere(b, a, f'k{k}_')} FROM {corners} c{k})", r, f"k{k}_", "face", f"u{k}", f"v{k}")
    least = lambda f, v: f"CAST(floor({f}({', '.join(f'{v}{k}' for k in range(4))})) AS BIGINT)"
    cells = f"""(SELECT {box}, face, x.q, y.s FROM {corners} b,
      LATERAL (SELECT unnest(range({least('least', 'u')} - 1, {least('greatest', 'u')} + 3)) AS q) x,
      LATERAL (SELECT unnest(range({least('least', 'v')} - 1, {least('greatest', 'v')} + 3)) AS s) y)"""
    lat, lon = "degrees(atan2(m2, sqrt(m0 * m0 + m1 * m1)))", "degrees(atan2(m1, m0))"
    seen = f"(SELECT *, {lon} AS lon, {lat} AS lat FROM {centred(cells, r)} g)"
    crossed = f"""(SELECT c.{id_col}, face, q, s FROM {seen} c JOIN {edges} e ON c.{id_col} = e.{id_col}
      AND (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / (e.y2 - e.y1) + e.x1
      GROUP BY ALL HAVING count(*) % 2 = 1)"""
    return named(crossed, r, id_col)
