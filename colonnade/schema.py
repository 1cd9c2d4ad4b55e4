"""The eight base types, column metadata, names, and coercion of parameters."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base types and the words that stand for booleans.
BASE_TYPES = {
    "BOOLEAN": T.BooleanType(),
    "STRING": T.StringType(),
    "LONG": T.LongType(),
    "INTEGER": T.IntegerType(),
    "SHORT": T.ShortType(),
    "BYTE": T.ByteType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
}
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")

INTEGRAL, REAL = ("LONG", "INTEGER", "SHORT", "BYTE"), ("DOUBLE", "FLOAT")
METADATA = ("label", "row_id", "sorted", "description", "factor", "resolution")
NAME = re.compile(r"[a-zA-Z_][a-zA-Z_0-9]+")


def base_type(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    for name, spark_type in BASE_TYPES.items():
        if kind == spark_type:
            return name
    raise TypeError(f"{column} is {kind.simpleString()}, not one of the base types")


def is_real(df: DataFrame, column: str) -> bool:
    return base_type(df, column) in REAL


def is_integral(df: DataFrame, column: str) -> bool:
    return base_type(df, column) in INTEGRAL


def metadata(df: DataFrame, column: str) -> dict[str, Any]:
    return dict(df.schema[column].metadata or {})


def annotate(df: DataFrame, column: str, **values: Any) -> DataFrame:
    """Sets metadata of a column: label, row_id, sorted, description, factor, resolution. None removes a value."""
    if unknown := set(values) - set(METADATA):
        raise ValueError(f"unknown metadata: {sorted(unknown)}")
    merged = {k: v for k, v in (metadata(df, column) | values).items() if v is not None}
    return df.withMetadata(column, merged)


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no variable name: two or more letters, digits and underscores, no digit first")
    return name


def infer(values: list) -> T.DataType:
    """Type of a list's first element, as builders without a declared type take it."""
    if not values:
        raise ValueError("an empty list has no type")
    first = values[0]
    if isinstance(first, bool):
        return T.BooleanType()
    if isinstance(first, int):
        return T.LongType()
    if isinstance(first, float):
        return T.DoubleType()
    if isinstance(first, str):
        return T.StringType()
    raise TypeError(f"{type(first).__name__} is no base type")


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def coerce(value: Any, kind: str) -> Any:
    """A parameter's value as a base type: text loses its commas, reals round half up to integrals, the rest must fit."""
    if value is None:
        raise ValueError("a parameter can't be null")
    if kind == "BOOLEAN":
        if isinstance(value, bool):
            return value
        word = str(value).strip().lower()
        if word in TRUE_WORDS or word in FALSE_WORDS:
            return word in TRUE_WORDS
        raise ValueError(f"{value!r} is no boolean")
    if kind == "STRING":
        if isinstance(value, bool) or not isinstance(value, (str, int)):
            raise TypeError(f"{value!r} is no text")
        return str(value)
    if isinstance(value, bool):
        raise TypeError("a boolean is no number")
    if isinstance(value, str):
        value = float(value.replace(",", "")) if kind in REAL or not re.fullmatch(r"\s*[-+]?[\d,]+\s*", value) else int(value.replace(",", ""))
    if kind in INTEGRAL:
        return value if isinstance(value, int) else half_up(value)
    return float(value)


def parse_long(text: Column) -> Column:
    """Text to a long, commas removed; what is no number raises."""
    return F.regexp_replace(text, ",", "").cast("long")


def parse_double(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").cast("double")


def is_integral_number(df: DataFrame, column: str) -> bool:
    """Whether numbers of a column compare as 64-bit integers: longs, integers and shorts do."""
    return base_type(df, column) in ("LONG", "INTEGER", "SHORT")


def equals_as_long(df: DataFrame, column: str, value: Any) -> Column:
    """Whether an integral column holds a number, a real one cut to its integer; false on nulls and for what is no number."""
    if not is_integral_number(df, column):
        raise TypeError(f"{column} isn't integral, it can't be compared as such")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return F.lit(False)
    v = F.col(f"`{column}`")
    return v.isNotNull() & (v.cast("long") == F.lit(math.trunc(value)))


def logical_to_number(flag: Column) -> Column:
    return flag.cast("int")


def convert(column: Column, kind: str) -> Column:
    """Typed conversion of a column to a base type; out of range raises, as ANSI casts do."""
    return column.cast(BASE_TYPES[kind])
