"""Heights of buildings from free-text tags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the height model.
DEFAULT_HEIGHT_M = 15.0
FLOOR_HEIGHT_M = 3.0
METRES_PER_FOOT = 0.3048
MOST_HEIGHT, MOST_LEVELS = 9999, 500

#: White space, of ASCII or not, with the separators that count as it in Unicode text.
SPACE = r"(?U:[\s\x1c-\x1f])"

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends, no-break spaces included."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def number(text: Column) -> Column:
    """A plain decimal number, else null; an underscore between digits is ignored. Spellings
    that only some engines take for numbers, like a trailing letter d, are not numbers."""
    return _number(_without_marks(text))


def _without_marks(text: Column) -> Column:
    return F.regexp_replace(stripped(text), "(?<=[0-9])_(?=[0-9])", "")


def _number(plain: Column) -> Column:
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def _first(tag: Column) -> Column:
    return stripped(F.split(stripped(tag), ";")[0])


def _in_feet(first: Column) -> Column:
    return first.rlike(rf"(?i)(ft|feet|foot){SPACE}*$")


def _without_unit(first: Column) -> Column:
    return F.regexp_replace(first, rf"(?i){SPACE}*(ft|feet|foot|m|meters?|metres?){SPACE}*$", "")


def _metres(value: Column, feet: Column) -> Column:
    value = F.when(feet, value * METRES_PER_FOOT).otherwise(value)
    return F.when((value > 0) & (value < MOST_HEIGHT), F.when(feet, F.round(value, 2)).otherwise(value))


def _levels(value: Column) -> Column:
    return F.when((value > 0) & (value < MOST_LEVELS), value)


def parse_height_m(tag: str | Column) -> Column:
    """Metres from a height tag: the first of a list, in feet or metres; null if there is
    no number above 0 and below 9999. Feet are rounded to centimetres."""
    first = _first(F.col(tag) if isinstance(tag, str) else tag)
    return _metres(number(_without_unit(first)), _in_feet(first))


def parse_levels(tag: str | Column) -> Column:
    return _levels(number(F.col(tag) if isinstance(tag, str) else tag))


def _parsed(df: DataFrame, heights: dict[str, str], levels: dict[str, str]) -> DataFrame:
    """``df`` with new columns of metres and of levels, each from a tag. Done in steps, each a column
    that the next ones use several times: in one expression each use is written out again, and
    the code for it is then too long for the JVM to compile, so that it would run interpreted."""
    df = df.withColumns({f"{n}_text": _first(F.col(tag)) for n, tag in heights.items()})
    df = df.withColumns({f"{n}_feet": _in_feet(F.col(f"{n}_text")) for n in heights})
    plain = {n: _without_unit(F.col(f"{n}_text")) for n in heights} | {n: F.col(tag) for n, tag in levels.items()}
    df = df.withColumns({f"{n}_plain": _without_marks(text) for n, text in plain.items()})
    df = df.withColumns({f"{n}_value": _number(F.col(f"{n}_plain")) for n in plain})
    metres = {n: _metres(F.col(f"{n}_value"), F.col(f"{n}_feet")) for n in heights}
    df = df.withColumns(metres | {n: _levels(F.col(f"{n}_value")) for n in levels})
    return df.drop(*[f"{n}_{step}" for n in plain for step in ("text", "feet", "plain", "value")])


def estimate_heights(df: DataFrame, default: float = DEFAULT_HEIGHT_M, floor: float = FLOOR_HEIGHT_M) -> DataFrame:
    """Add max_height_m, height_source, min_height_m, levels and min_level from the tags
    height, building_levels, min_height and building_min_level."""
    parsed = _parsed(
        df, {"_height": "height", "_low": "min_height"}, {"levels": "building_levels", "min_level": "building_min_level"}
    )
    source = (
        F.when(F.col("_height").isNotNull(), "height")
        .when(F.col("levels").isNotNull(), "building:levels_estimated")
        .otherwise("default_15m")
    )
    return parsed.withColumns(
        {
            "max_height_m": F.coalesce("_height", F.col("levels") * floor, F.lit(float(default))),
            "min_height_m": F.coalesce("_low", F.col("min_level") * floor, F.lit(0.0)),
            "height_source": source,
        }
    ).drop("_height", "_low")


def height_quality(obstacles: DataFrame) -> DataFrame:
    """One row: how many heights came from where, and their range and median."""
    of = lambda name: F.count_if(F.col("height_source") == name)
    return obstacles.agg(
        F.count("*").alias("total"),
        of("height").alias("from_height"),
        of("building:levels_estimated").alias("from_levels"),
        of("default_15m").alias("from_default"),
        F.min("max_height_m").alias("min_max_height"),
        F.max("max_height_m").alias("max_max_height"),
        F.median("max_height_m").alias("median_max_height"),
    )
