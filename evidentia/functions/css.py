"""CSS values as Column expressions; what can't be resolved is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LENGTH = r"(?i)^(-?\d*\.?\d+)\s*(px|rem|em|pt|cm|mm|in|q)?$"
# Pixels in a unit; rem and em are sixteen unless told otherwise.
PIXELS = {"px": 1.0, "": 1.0, "rem": 16.0, "pt": 96 / 72, "cm": 96 / 2.54, "mm": 96 / 25.4, "in": 96.0, "q": 96 / 101.6}


def length_px(value: Column, font_px: Column | float = 16.0) -> Column:
    """An absolute length in pixels; null for other units."""
    v = F.trim(value)
    number, unit = F.regexp_extract(v, _LENGTH, 1).try_cast("double"), F.lower(F.regexp_extract(v, _LENGTH, 2))
    scale = F.when(unit == "em", F.lit(font_px) if isinstance(font_px, float) else font_px)
    for name, px in PIXELS.items():
        scale = F.when(unit == name, F.lit(px)).otherwise(scale)
    return number * scale


def lengths(value: Column) -> Column:
    """All lengths of a value in order."""
    found = F.regexp_extract_all(value, F.lit(r"(-?\d*\.?\d+(?:px|rem|em|pt)?)"), 1)
    return F.filter(F.transform(found, lambda x: length_px(x)), lambda x: x.isNotNull())


def split_args(value: Column) -> Column:
    """Arguments at commas outside parentheses, one level of nesting deep."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"((?:[^,()]|\((?:[^()]|\([^()]*\))*\))+)"), 1), lambda x: F.trim(x))


def clamp_bounds(value: Column) -> Column:
    """(low, high) of a clamp() of three arguments."""
    body = F.regexp_extract(F.trim(value), r"(?is)^clamp\((.*)\)\s*$", 1)
    args = split_args(body)
    three = F.size(args) == 3
    return F.struct(F.when(three, length_px(F.get(args, 0))).alias("low"), F.when(three, length_px(F.get(args, 2))).alias("high"))


def specificity(selector: Column) -> Column:
    return F.struct(
        F.regexp_count(selector, F.lit("#[A-Za-z0-9_-]+")).alias("ids"), F.regexp_count(selector, F.lit(r"[.:\[][A-Za-z0-9_-]+")).alias("classes"),
        F.regexp_count(selector, F.lit(r"(?:^|[\s>+~])[a-zA-Z][a-zA-Z0-9-]*")).alias("tags"),
    )
