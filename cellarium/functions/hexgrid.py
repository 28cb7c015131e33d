"""A hierarchy of hexagonal cells on an icosahedron, as column expressions.

The geometry is that of the public H3 grid: gnomonic projection of each face, a hexagon
lattice that shrinks by the square root of 7 a resolution and turns at odd ones. Cells are
named by resolution, face and lattice place, not by that grid's index numbers; stored tables
sort them by numbers of their own that go from coarse to fine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latitude and longitude of one face's centre and the azimuth from it to
#: one of its corners, in radians; lattice unit of resolution 0 in the plane of a face.
FACE_LAT, FACE_LON, FACE_AZIMUTH = 0.803582649718989942, 1.248397419617396099, 5.619958268523939882
UNIT_RESOLUTION_0 = 0.38196601125010500003
TURN = math.asin(math.sqrt(3 / 28))

#: Mean edge lengths in metres by which disk sizes are chosen.
EDGE_M = {7: 1220, 8: 461, 9: 174, 10: 65}
OTHER_EDGE_M = 100


def _faces() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the 20 faces and two axes in the plane of each: to a corner, and a quarter
    turn to the left of it. Built from one face by the rule of the icosahedron."""
    lat, lon, az = FACE_LAT, FACE_LON, FACE_AZIMUTH
    centre = np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
    east = np.array([-math.sin(lon), math.cos(lon), 0.0])
    north = np.cross(centre, east)
    axis = math.cos(az) * north + math.sin(az) * east
    tilt = math.acos(math.sqrt((5 + 2 * math.sqrt(5)) / 15))  # from a face's centre to its corners
    corners = []
    for k in range(3):
        a = 2 * math.pi * k / 3
        corners.append(math.cos(tilt) * centre + math.sin(tilt) * (math.cos(a) * axis + math.sin(a) * np.cross(centre, axis)))
    points = [*corners]
    apart = 1 / math.sqrt(5)  # cosine between neighbouring corners
    while len(points) < 12:  # mirror a corner over the plane through two neighbours and the middle
        for a in list(points):
            for b in list(points):
                for c in list(points):
                    if all(abs(p @ q - apart) < 1e-6 for p, q in ((a, b), (b, c), (a, c))):
                        normal = np.cross(a, b)
                        normal /= np.linalg.norm(normal)
                        d = c - 2 * (c @ normal) * normal
                        if all(np.linalg.norm(d - p) > 1e-6 for p in points):
                            points.append(d)
    centres, axes = [], []
    for i in range(12):
        for j in range(i + 1, 12):
            for k in range(j + 1, 12):
                a, b, c = points[i], points[j], points[k]
                if all(abs(p @ q - apart) < 1e-6 for p, q in ((a, b), (b, c), (a, c))):
                    m = a + b + c
                    m /= np.linalg.norm(m)
                    u = a - (a @ m) * m
                    centres.append(m)
                    axes.append(u / np.linalg.norm(u))
    order = sorted(range(20), key=lambda k: (round(-centres[k][2], 9), round(math.atan2(centres[k][1], centres[k][0]), 9)))
    c, u = np.array(centres)[order], np.array(axes)[order]
    return c, u, np.cross(c, u)


CENTRES, AXES, LEFTS = _faces()


def _array(values: np.ndarray) -> Column:
    """A constant array, folded once; not an array built for each row."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def _dot(rows: np.ndarray, face: Column | None, p: tuple[Column, Column, Column]) -> Column:
    """Products of a point with the rows: of one face, or an array of all."""
    if face is not None:
        return sum((F.get(_array(rows[:, k]), face) * p[k] for k in range(3)), F.lit(0.0))
    return F.array(*[sum((F.lit(float(r[k])) * p[k] for k in range(3)), F.lit(0.0)) for r in rows])


def sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, theta = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)


def face_products(p: tuple[Column, Column, Column]) -> Column:
    """How near a point is to the middle of each face."""
    return _dot(CENTRES, None, p)


def nearest_face(products: str) -> Column:
    """The face from a column of ``face_products``, kept so that it is made once."""
    return (F.array_position(products, F.array_max(products)) - 1).cast("int")


def _scale(res: int) -> float:
    return math.sqrt(7) ** res / UNIT_RESOLUTION_0


def plane(p: tuple[Column, Column, Column], face: Column, res: int) -> tuple[Column, Column]:
    """Place of a point in the lattice of a face, in lattice steps (fractions)."""
    away = _dot(CENTRES, face, p)
    x, y = _dot(AXES, face, p) / away * _scale(res), _dot(LEFTS, face, p) / away * _scale(res)
    if res % 2:
        x, y = x * math.cos(TURN) + y * math.sin(TURN), y * math.cos(TURN) - x * math.sin(TURN)
    s = y * (2 / math.sqrt(3))
    return x - s / 2, s


def to_cell(q: Column, s: Column) -> tuple[Column, Column]:
    """The nearest lattice place."""
    t = -q - s
    rq, rs, rt = (F.round(v) for v in (q, s, t))
    dq, ds, dt = F.abs(rq - q), F.abs(rs - s), F.abs(rt - t)
    cq = F.when((dq > ds) & (dq > dt), -rs - rt).otherwise(rq)
    cs = F.when((dq > ds) & (dq > dt), rs).when(ds > dt, -rq - rt).otherwise(rs)
    return cq.cast("long"), cs.cast("long")


def centre(face: Column, q: Column, s: Column, res: int) -> tuple[Column, Column, Column]:
    """The point of the sphere (not of length 1) in the middle of a cell."""
    x, y = q + s * 0.5, s * (math.sqrt(3) / 2)
    if res % 2:
        x, y = x * math.cos(TURN) - y * math.sin(TURN), x * math.sin(TURN) + y * math.cos(TURN)
    x, y = x / _scale(res), y / _scale(res)
    at = lambda rows, k: F.get(_array(rows[:, k]), face)
    return tuple(at(CENTRES, k) + x * at(AXES, k) + y * at(LEFTS, k) for k in range(3))


def lat_lon(p: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    return F.degrees(F.atan2(p[2], F.sqrt(p[0] * p[0] + p[1] * p[1]))), F.degrees(F.atan2(p[1], p[0]))


def named(df: DataFrame, res: int) -> DataFrame:
    """``df`` with ``cell``, the name of the cell in its columns face, q and s.

    Where a cell's middle lies on another face, that face names it; so every cell has one
    name, from whichever face it was reached.
    """
    df = df.withColumns({f"_c{k}": c for k, c in enumerate(centre(F.col("face"), F.col("q"), F.col("s"), res))})
    p = tuple(F.col(f"_c{k}") for k in range(3))
    df = df.withColumn("_dots", face_products(p)).withColumn("_home", nearest_face("_dots"))
    hq, hs = plane(p, F.col("_home"), res)
    df = df.withColumns({"_hq": hq, "_hs": hs})
    hq, hs = to_cell(F.col("_hq"), F.col("_hs"))
    name = F.concat_ws("/", F.lit(f"hex{res}"), F.col("_home").cast("string"), hq.cast("string"), hs.cast("string"))
    # A generator: rules that trace a join key down to the scan stop here, where they would
    # otherwise write the whole chain of formulas out in full.
    return df.withColumn("cell", F.explode(F.array(name))).drop("_c0", "_c1", "_c2", "_dots", "_home", "_hq", "_hs")


# The same for constants of a query, whose cells are few: on the driver.


def _points(lat, lon) -> np.ndarray:
    phi, theta = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)], axis=-1)


def _places(p: np.ndarray, face: np.ndarray, res: int) -> np.ndarray:
    away = (CENTRES[face] * p).sum(axis=-1)
    x, y = ((rows[face] * p).sum(axis=-1) / away * _scale(res) for rows in (AXES, LEFTS))
    if res % 2:
        x, y = x * math.cos(TURN) + y * math.sin(TURN), y * math.cos(TURN) - x * math.sin(TURN)
    s = y * (2 / math.sqrt(3))
    return np.stack([x - s / 2, s], axis=-1)


def _nearest(place: np.ndarray) -> np.ndarray:
    whole = np.append(place, -place.sum(axis=-1, keepdims=True), axis=-1)
    near = np.round(whole)
    worst = np.abs(near - whole).argmax(axis=-1)[..., None]
    others = near.sum(axis=-1, keepdims=True) - np.take_along_axis(near, worst, axis=-1)
    np.put_along_axis(near, worst, -others, axis=-1)
    return near[..., :2].astype(np.int64)


def _middles(face: np.ndarray, cell: np.ndarray, res: int) -> np.ndarray:
    q, s = cell[..., 0], cell[..., 1]
    x, y = q + s * 0.5, s * (math.sqrt(3) / 2)
    if res % 2:
        x, y = x * math.cos(TURN) - y * math.sin(TURN), x * math.sin(TURN) + y * math.cos(TURN)
    x, y = (v[..., None] / _scale(res) for v in (x, y))
    return CENTRES[face] + x * AXES[face] + y * LEFTS[face]


def _homes(face: np.ndarray, cell: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """The faces that name cells, and the cells' places there."""
    middle = _middles(face, cell, res)
    home = (middle @ CENTRES.T).argmax(axis=-1)
    return home, _nearest(_places(middle, home, res))


def _names(face: np.ndarray, cell: np.ndarray, res: int) -> list[str]:
    home, place = _homes(face, cell, res)
    return [f"hex{res}/{f}/{q}/{s}" for f, (q, s) in zip(home.tolist(), place.tolist(), strict=True)]


def around(lat, lon, res: int) -> tuple[np.ndarray, np.ndarray]:
    """The face and the cell of a place, or of each of many."""
    p = _points(lat, lon)
    face = (p @ CENTRES.T).argmax(axis=-1)
    return face, _nearest(_places(p, face, res))


def _disk(lat: float, lon: float, res: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    face, own = around(lat, lon, res)
    steps = np.array([(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a + b) <= k])
    return np.full(len(steps), face), own + steps


def disk_names(lat: float, lon: float, res: int, k: int) -> list[str]:
    """The cells up to k steps from a constant place's cell."""
    return _names(*_disk(lat, lon, res, k), res)


def disk_keys(lat: float, lon: float, res: int, k: int) -> list[int]:
    """The same by their keys."""
    return place_keys(*_homes(*_disk(lat, lon, res, k), res), res).tolist()


def box_names(box: tuple[float, float, float, float], res: int) -> list[str]:
    """The cells whose middle lies in a constant box (west, south, east, north), or the cell of
    the box's middle if there is none."""
    return _names(*_in_box(box, res), res)


def box_keys(box: tuple[float, float, float, float], res: int) -> list[int]:
    """The same by their keys."""
    return place_keys(*_homes(*_in_box(box, res), res), res).tolist()


def _in_box(box: tuple[float, float, float, float], res: int) -> tuple[np.ndarray, np.ndarray]:
    west, south, east, north = box
    face, own = around((south + north) / 2, (west + east) / 2, res)
    corners = _places(_points(np.array([south, north, south, north]), np.array([west, west, east, east])), face, res)
    (q0, s0), (q1, s1) = np.floor(corners.min(axis=0)).astype(int) - 1, np.floor(corners.max(axis=0)).astype(int) + 2
    cells = np.stack(np.meshgrid(np.arange(q0, q1 + 1), np.arange(s0, s1 + 1), indexing="ij"), axis=-1).reshape(-1, 2)
    p = _middles(np.full(len(cells), face), cells, res)
    lat, lon = np.degrees(np.arctan2(p[:, 2], np.hypot(p[:, 0], p[:, 1]))), np.degrees(np.arctan2(p[:, 1], p[:, 0]))
    inside = cells[(lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)]
    inside = inside if len(inside) else own[None]
    return np.full(len(inside), face), inside


# Many places and boxes of a batch at once.


def _once(face: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different cells of a batch, and for each row which of them it has."""
    wide = 1 << 28
    packed = (face.astype(np.int64) * wide + cell[:, 0] + wide // 2) * wide + cell[:, 1] + wide // 2
    _, first, back = np.unique(packed, return_index=True, return_inverse=True)
    return face[first], cell[first], back


def cells_of(face: np.ndarray, cell: np.ndarray, res: int, name: bool) -> tuple[np.ndarray | list[str], np.ndarray]:
    """Names, or else keys, of the different cells of a batch, and for each row which of them it has."""
    face, cell, back = _once(face, cell)
    return (_names(face, cell, res) if name else place_keys(*_homes(face, cell, res), res)), back


def _middles_inside(box: np.ndarray, face: np.ndarray, res: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, cell, and latitude and longitude of its middle, of the cells of a face whose middle lies in
    each of many boxes, from at most ``most`` candidates at once.

    Meridians are straight in the plane of a face and parallels are bent, so the places of a box's
    corners bound those inside but for the bend, which grows with the square of the width. Most
    small boxes thus have no candidate at all.
    """
    west, south, east, north = box.T
    corners = np.stack([_places(_points(b, a), face, res) for a in (west, east) for b in (south, north)])
    low, high = corners.min(axis=0), corners.max(axis=0)
    bend = (4 * np.radians(east - west) ** 2 * _scale(res) + 1e-6)[:, None]
    first = np.maximum(np.floor(low) - 1, np.ceil(low - bend)).astype(np.int64)
    last = np.minimum(np.floor(high) + 2, np.floor(high + bend)).astype(np.int64)
    sides = np.maximum(last - first + 1, 0)
    n = sides.prod(axis=1)
    ends = np.cumsum(n)
    for begin in range(0, int(n.sum()), most):
        k = np.arange(begin, min(begin + most, int(ends[-1])))
        row = np.searchsorted(ends, k, side="right")
        at = k - (ends[row] - n[row])
        cell = first[row] + np.stack([at // sides[row, 1], at % sides[row, 1]], axis=-1)
        p = _middles(face[row], cell, res)
        lat, lon = np.degrees(np.arctan2(p[:, 2], np.hypot(p[:, 0], p[:, 1]))), np.degrees(np.arctan2(p[:, 1], p[:, 0]))
        inside = (lon >= west[row]) & (lon <= east[row]) & (lat >= south[row]) & (lat <= north[row])
        yield row[inside], cell[inside], lat[inside], lon[inside]


def in_boxes(box: np.ndarray, res: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, face and cell of the cells whose middle lies in each of many boxes (rows of west, south,
    east, north), or of the cell of the box's middle if there is none."""
    face, own = around((box[:, 1] + box[:, 3]) / 2, (box[:, 0] + box[:, 2]) / 2, res)
    filled = np.zeros(len(box), bool)
    for row, cell, *_ in _middles_inside(box, face, res, 1 << 19):
        filled[row] = True
        yield row, face[row], cell
    alone = np.flatnonzero(~filled)
    yield alone, face[alone], own[alone]


def in_polygons(box: np.ndarray, n_edges: np.ndarray, edges: np.ndarray, res: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, face and cell of the cells whose middle lies in each of many polygons: a ray to the east
    crosses an odd number of edges. ``edges`` has those of all, as rows of x1, y1, x2, y2, polygon
    after polygon; ``box`` their bounds."""
    face, _ = around((box[:, 1] + box[:, 3]) / 2, (box[:, 0] + box[:, 2]) / 2, res)
    starts, (x1, y1, x2, y2) = np.cumsum(n_edges) - n_edges, edges.T
    for row, cell, lat, lon in _middles_inside(box, face, res, max(1, (1 << 21) // max(1, int(n_edges.max(initial=1))))):
        n = n_edges[row]
        k = np.repeat(np.arange(len(row)), n)  # of each pair of a middle and an edge
        e = starts[row][k] + np.arange(len(k)) - (np.cumsum(n) - n)[k]
        over = (y1[e] > lat[k]) != (y2[e] > lat[k])
        k, e = k[over], e[over]
        hit = lon[k] < (x2[e] - x1[e]) * (lat[k] - y1[e]) / (y2[e] - y1[e]) + x1[e]
        odd = np.bincount(k[hit], minlength=len(row)) % 2 == 1
        yield row[odd], face[row[odd]], cell[odd]


# Keys that sort by place: the face, the place at resolution 0, and a digit a resolution.


def _basis(res: int) -> np.ndarray:
    """The two steps of a lattice in the plane of a face, as columns."""
    turn = TURN if res % 2 else 0.0
    steps = np.array([[1.0, 0.5], [0.0, math.sqrt(3) / 2]])
    return np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]]) @ steps / _scale(res)


#: From a cell's place to the place of its middle child, for children of even and odd resolutions.
_CHILD = [np.rint(np.linalg.solve(_basis(r), _basis(r - 1))).astype(np.int64) for r in (2, 1)]
#: A cell's seven children, by their place from the middle one: digits 0 to 6.
_STEPS = [(0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]
_DIGIT = np.full((3, 3), -1, np.int64)
for _k, (_q, _s) in enumerate(_STEPS):
    _DIGIT[_q + 1, _s + 1] = _k
#: Places at resolution 0 lie within _REACH steps of a face's middle.
_REACH = 8
_SIDE = 2 * _REACH + 1
FINEST = 15


def place_keys(face: np.ndarray, place: np.ndarray, res: int) -> np.ndarray:
    """Numbers of cells, from coarse to fine in base 7, so that a cell's children follow each
    other: those of key k are 7 k to 7 k + 6 one resolution on, and cells that lie together
    mostly sort together. A parent is the nearest cell of the lattice of the same face."""
    if not 0 <= res <= FINEST:
        raise ValueError(f"no resolution {res}")
    key, unit, place = np.zeros(len(place), np.int64), 1, np.asarray(place, np.int64)
    for r in range(res, 0, -1):
        down = _CHILD[r % 2]
        above = _nearest(place @ np.linalg.inv(down).T)
        step = place - above @ down.T
        key += _DIGIT[step[:, 0] + 1, step[:, 1] + 1] * unit
        unit, place = unit * 7, above
    root = (np.asarray(face, np.int64) * _SIDE + place[:, 0] + _REACH) * _SIDE + place[:, 1] + _REACH
    return key + root * unit


@F.pandas_udf(T.LongType())
def _keys_of_names(face: pd.Series, q: pd.Series, s: pd.Series, res: pd.Series) -> pd.Series:
    out = np.zeros(len(face), np.int64)
    for r in res.unique().tolist():
        own = (res == r).to_numpy()
        out[own] = place_keys(face[own].to_numpy(), np.stack([q[own], s[own]], axis=-1), r)
    return pd.Series(out)


def key_of_name(cell: str) -> Column:
    """The key of a cell from its name."""
    part = lambda k: F.split_part(F.col(cell), F.lit("/"), F.lit(k))
    return _keys_of_names(*[part(k).cast("long") for k in (2, 3, 4)], F.substring(part(1), 4, 2).cast("int"))


def parent_key(key: str | Column, up: int = 1) -> Column:
    """The key of the cell ``up`` resolutions coarser."""
    column = F.col(key) if isinstance(key, str) else key
    return F.call_function("div", column, F.lit(7**up).cast("long"))


def child_range(key: int, down: int = 1) -> tuple[int, int]:
    """The first and last key of a cell's descendants ``down`` resolutions finer."""
    return key * 7**down, (key + 1) * 7**down - 1


def disk_steps(radius_m: float, res: int) -> int:
    """How many rings a disk needs for a radius; it covers more than the circle."""
    return max(1, math.ceil(radius_m / EDGE_M.get(res, OTHER_EDGE_M)))
