"""Cell keys as column expressions, so that they stay in generated code.

Tiles are Web-Mercator tiles. All keys are longs or strings; inputs are doubles in degrees
and metres. A null input gives a null key.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A level of the vertical axis at zoom z is 2^25 / 2^z metres.
VERTICAL_EXPONENT = 25
MORTON3D_BITS = 21

#: Steps that spread bits for two and three dimensions: shift, then keep the mask.
SPREAD_2 = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
SPREAD_3 = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]

#: Digits of base 32, and those of geohashes.
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(c: str | Column | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _power(z: int | Column) -> Column:
    """2^z as a double; z may be a column, so that one plan serves many zooms."""
    return F.lit(float(2**z)) if isinstance(z, int) else F.pow(F.lit(2.0), z)


def share_x(lon) -> Column:
    """What of a tile's column no zoom changes."""
    return (_col(lon) + 180) / 360


def share_y(lat) -> Column:
    """What of a tile's row no zoom changes: twice the share of the map's height."""
    phi = F.radians(_col(lat))
    return 1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / F.pi()


def column_of(share, n: Column) -> Column:
    """The tile's column where the map is ``n``, a power of two, tiles wide."""
    return F.floor(n * _col(share))


def row_of(share, n: Column) -> Column:
    return F.floor(n * _col(share) / 2)


def tile_x(lon, z) -> Column:
    return column_of(share_x(lon), _power(z))


def tile_y(lat, z) -> Column:
    return row_of(share_y(lat), _power(z))


def tile_at(lon: float, lat: float, z: int) -> tuple[int, int]:
    """The tile of a constant place, for the constants of a plan."""
    phi = math.radians(lat)
    y = 2.0**z * (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2
    return math.floor(2.0**z * ((lon + 180) / 360)), math.floor(y)


def level_at(height: float, z: int) -> int:
    return math.floor(max(0.0, height) * 2.0**z / 2.0**VERTICAL_EXPONENT)


def level(height, z) -> Column:
    """Vertical cell of a height at zoom z; heights below 0 count as 0."""
    return level_of(height, _power(z))


def level_of(height, n: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), _col(height)) * n / float(2**VERTICAL_EXPONENT))


def metres_per_level(z: int) -> float:
    return 2.0**VERTICAL_EXPONENT / 2.0**z


def height_bin(height, size) -> Column:
    return F.floor(F.greatest(F.lit(0.0), _col(height)) / size)


def path_key(*parts) -> Column:
    """Parts joined by slashes."""
    return F.concat_ws("/", *[(F.lit(p) if isinstance(p, str) and p == "morton3d" else _col(p)).cast("string") for p in parts])


def _spread(v: Column, steps: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, s: a.bitwiseOR(F.shiftleft(a, s[0])).bitwiseAND(F.lit(s[1])), steps, v)


def _compact(v: Column) -> Column:
    """Every other bit, from bit 0 on: the inverse of spreading for two dimensions."""
    v = v.bitwiseAND(F.lit(SPREAD_2[-1][1]))
    masks = [m for _, m in SPREAD_2[::-1]][1:] + [0xFFFFFFFF]
    for (shift, _), mask in zip(SPREAD_2[::-1], masks, strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton2d(x, y) -> Column:
    """x on even, y on odd bits; for tiles below 2^31."""
    low = lambda v: _col(v).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return _spread(low(x), SPREAD_2).bitwiseOR(F.shiftleft(_spread(low(y), SPREAD_2), 1))


def packed(high, x, y) -> Column:
    """One number in order of three: of a height's level or bin (up to 2^18 - 1, larger ones count as that) and
    a tile at up to zoom 22. To sort by it is to sort by one column, which needs no comparisons."""
    high, x, y = (_col(c).cast("long") for c in (high, x, y))
    return F.shiftleft(F.least(F.greatest(high, F.lit(0)), F.lit(2**18 - 1)), 44) + F.shiftleft(x, 22) + y


def morton2d_at(x: int, y: int) -> int:
    spread = lambda v: reduce(lambda a, s: (a | a << s[0]) & s[1], SPREAD_2, v & 0xFFFFFFFF)
    return spread(x) | spread(y) << 1


def morton3d_at(x: int, y: int, h: int) -> int:
    spread = lambda v: reduce(lambda a, s: (a | a << s[0]) & s[1], SPREAD_3, min(max(v, 0), 2**MORTON3D_BITS - 1))
    return spread(x) | spread(y) << 1 | spread(h) << 2


def interleaved(places: np.ndarray) -> np.ndarray:
    """Morton keys of an array of places (n x 2 or n x 3, none negative): constants of a plan."""
    steps = SPREAD_2 if places.shape[1] == 2 else SPREAD_3
    axes = (reduce(lambda a, s: (a | a << s[0]) & s[1], steps, places[:, k]) << k for k in range(places.shape[1]))
    return reduce(lambda a, b: a | b, axes)


def morton2d_xy(key) -> tuple[Column, Column]:
    return _compact(_col(key)), _compact(F.shiftright(_col(key), 1))


def morton3d(x, y, h) -> Column:
    """x, y, h on every third bit from 0, 1, 2; each is clipped to 0 .. 2^21 - 1."""
    clip = lambda v: F.least(F.greatest(_col(v).cast("long"), F.lit(0)), F.lit(2**MORTON3D_BITS - 1))
    a, b, c = (_spread(clip(v), SPREAD_3) for v in (x, y, h))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def _compact3(v: Column) -> Column:
    """Every third bit, from bit 0 on."""
    v = v.bitwiseAND(F.lit(SPREAD_3[-1][1]))
    masks = [m for _, m in SPREAD_3[::-1]][1:] + [2**MORTON3D_BITS - 1]
    for (shift, _), mask in zip(SPREAD_3[::-1], masks, strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton3d_xyh(key) -> tuple[Column, Column, Column]:
    """The places of a key, as they were after clipping."""
    return _compact3(_col(key)), _compact3(F.shiftright(_col(key), 1)), _compact3(F.shiftright(_col(key), 2))


def quadkey_of_tile(x, y, z: int) -> Column:
    """The Morton key in base 4, padded to z digits."""
    return F.lpad(F.conv(morton2d(x, y).cast("string"), 10, 4), z, "0") if z else F.lit("")


def clamp_tile(t: Column, z: int) -> Column:
    return F.least(F.greatest(t, F.lit(0)), F.lit(2**z - 1))


def quadkey(lat, lon, z: int) -> Column:
    return quadkey_of_tile(clamp_tile(tile_x(lon, z), z), clamp_tile(tile_y(lat, z), z), z)


def quadkey_tile(key) -> tuple[Column, Column]:
    return morton2d_xy(F.conv(_col(key), 4, 10).cast("long"))


def tile_bounds(x, y, z: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile."""
    n = float(2**z)
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * v / n))))
    return lon(_col(x)), lat(_col(y) + 1), lon(_col(x) + 1), lat(_col(y))


def geohash_bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude."""
    bits = 5 * precision
    return (bits + 1) // 2, bits // 2


def geohash_ij(lat, lon, precision: int) -> tuple[Column, Column]:
    """Column and row of the cell. A value exactly on a border goes to the lower cell."""
    nx, ny = geohash_bits(precision)

    def place(v: Column, low: float, span: float, bits: int) -> Column:
        cells = 2**bits
        return F.least(F.greatest(F.ceil((v - low) / span * float(cells)) - 1, F.lit(0)), F.lit(cells - 1))

    return place(_col(lon), -180.0, 360.0, nx), place(_col(lat), -90.0, 180.0, ny)


def text_of(key: int, base: int, digits: int) -> str:
    """A constant key as text, as quadkeys (base 4) and geohashes (base 32) write it."""
    out = ""
    for _ in range(digits):
        key, d = divmod(key, base)
        out = GEOHASH_DIGITS[d] + out
    return out


def geohash_of_ij(i, j, precision: int) -> Column:
    nx, ny = geohash_bits(precision)
    # Longitude has the first bit: of an even number of bits it lies on odd places, else on even ones.
    key = morton2d(j, i) if nx == ny else morton2d(i, j)
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 32), precision, "0"), BASE32_DIGITS, GEOHASH_DIGITS)


def geohash(lat, lon, precision: int) -> Column:
    """Up to 12 letters."""
    return geohash_of_ij(*geohash_ij(lat, lon, precision), precision)


def geohash_cell(code, precision: int) -> tuple[Column, Column]:
    """Column and row of a code."""
    nx, ny = geohash_bits(precision)
    key = F.conv(F.translate(_col(code), GEOHASH_DIGITS, BASE32_DIGITS), 32, 10).cast("long")
    first, second = morton2d_xy(key)
    return (second, first) if nx == ny else (first, second)


def geohash_centre(code, precision: int) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a cell, not rounded."""
    nx, ny = geohash_bits(precision)
    i, j = geohash_cell(code, precision)
    return (j + 0.5) * 180 / float(2**ny) - 90, (i + 0.5) * 360 / float(2**nx) - 180


def geohash_neighbours(code, precision: int) -> Column:
    """The up to eight cells around a cell; those beyond a pole are left out."""
    nx, ny = geohash_bits(precision)
    i, j = geohash_cell(code, precision)
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    cells = [
        F.when(
            (j + b).between(0, 2**ny - 1), geohash_of_ij(F.pmod(i + a, F.lit(2**nx)), j + b, precision)
        )
        for a, b in around
    ]
    return F.array_compact(F.array(*cells))
