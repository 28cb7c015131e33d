"""The key functions under names of their own in SQL.

They are SQL functions: Spark writes their bodies out where they are called, so calls with
constants are folded while a query is planned and reach the scan as plain comparisons.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .keys import MORTON3D_BITS, SPREAD_2, SPREAD_3, VERTICAL_EXPONENT


def _spread(value: str, dims: int) -> str:
    """``value`` with its bits apart: a function a step, so that no text is written twice over."""
    for k in range(len(SPREAD_2)):
        value = f"cellarium_spread{dims}_{k}({value})"
    return value


def _steps(dims: int, steps: list[tuple[int, int]]) -> list[tuple[str, str, str, str]]:
    return [
        (f"cellarium_spread{dims}_{k}", "v BIGINT", "BIGINT", f"(v | shiftleft(v, {shift})) & {mask}L") for k, (shift, mask) in enumerate(steps)
    ]


_CLIPPED = f"least(greatest({{}}, 0L), {2**MORTON3D_BITS - 1}L)"

#: Name, parameters, result and body.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    *_steps(2, SPREAD_2),
    *_steps(3, SPREAD_3),
    ("tile_x", "lon DOUBLE, z INT", "BIGINT", "floor(pow(2.0D, z) * ((lon + 180) / 360))"),
    ("tile_y", "lat DOUBLE, z INT", "BIGINT", "floor(pow(2.0D, z) * (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2)"),
    ("height_level", "metres DOUBLE, z INT", "BIGINT", f"floor(greatest(0.0D, metres) * pow(2.0D, z) / {2.0**VERTICAL_EXPONENT}D)"),
    ("height_bin", "metres DOUBLE, size INT", "BIGINT", "floor(greatest(0.0D, metres) / size)"),
    ("morton2d", "x BIGINT, y BIGINT", "BIGINT", f"{_spread('x & 4294967295L', 2)} | shiftleft({_spread('y & 4294967295L', 2)}, 1)"),
    (
        "morton3d", "x BIGINT, y BIGINT, h BIGINT", "BIGINT",
        f"{_spread(_CLIPPED.format('x'), 3)} | shiftleft({_spread(_CLIPPED.format('y'), 3)}, 1) "
        f"| shiftleft({_spread(_CLIPPED.format('h'), 3)}, 2)",
    ),
    ("quadkey", "x BIGINT, y BIGINT, z INT", "STRING", "lpad(conv(cast(morton2d(x, y) AS STRING), 10, 4), z, '0')"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, in place of older ones of the same names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
