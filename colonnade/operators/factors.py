"""Categorical columns: values with integer codes in an explicit order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade import schema
from colonnade.operators.stats import UNIQUE_CAP, sorted_unique
from colonnade.runtime import join_dimension


def factor(df: DataFrame, column: str, most: int = UNIQUE_CAP) -> DataFrame:
    """Codes from 0 of the sorted distinct values: (value, code). At most ``most`` values, so one task numbers them."""
    values = sorted_unique(df, column, most=most).select(F.col(column).alias("value"))
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("code"))


def factor_of(spark: SparkSession, values: Iterable | Mapping) -> DataFrame:
    """Codes by the order given, of a mapping by its codes, of a set sorted. Duplicates and nothing at all raise."""
    if isinstance(values, Mapping):
        pairs = [(v, c) for v, c in values.items()]
        if len({c for _, c in pairs}) < len(pairs):
            raise ValueError("codes repeat")
    else:
        listed = sorted(values) if isinstance(values, (set, frozenset)) else list(values)
        if len(set(listed)) < len(listed):
            raise ValueError("values repeat")
        pairs = list(zip(listed, range(len(listed))))
    if not pairs:
        raise ValueError("a factor needs values")
    kind = schema.infer([v for v, _ in pairs]).simpleString()
    return spark.createDataFrame(pairs, f"value {kind}, code int")


def values_in_order(codes: DataFrame) -> DataFrame:
    return codes.orderBy("code").select("value")


def encode(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Adds the code of each value; null where it is none of the factor's."""
    table = codes.select(F.col("value").alias(column), F.col("code").alias(name))
    out = join_dimension(df, table, [column], "left").select(*df.columns, name)
    return schema.annotate(out, column, factor=f"{column} factor")


def decode(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    """Adds the value of each code; null where it is none of the factor's."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    table = codes.select(F.col("code").alias(code), F.col("value").alias(name))
    return join_dimension(df, table, [code], "left").select(*df.columns, name)


def clone_and_rename(codes: DataFrame, names: Mapping) -> DataFrame:
    """The same factor with other values for some of its codes, those of ``names`` (value to new value); a value that isn't there, or two that become the same, raise."""
    held = {r["value"]: r["code"] for r in codes.collect()}  # a factor has at most UNIQUE_CAP values
    if unknown := set(names) - set(held):
        raise ValueError(f"no such values: {sorted(unknown)}")
    renamed = {names.get(v, v): c for v, c in held.items()}
    if len(renamed) < len(held):
        raise ValueError("values repeat")
    return factor_of(codes.sparkSession, renamed)


def is_valid(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    return encode(df, column, codes, "__code").withColumn("valid", F.col("__code").isNotNull()).drop("__code")


def sort_by(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Rows by the order of the factor, unknown values last."""
    return encode(df, column, codes, "__code").orderBy(F.col("__code").asc_nulls_last()).drop("__code")


def same_factor(df: DataFrame, a: str, b: str) -> bool:
    """Whether two columns may be compared: only values of one factor are."""
    x, y = (schema.metadata(df, c).get("factor") for c in (a, b))
    if x != y:
        raise ValueError(f"{a} and {b} are of different factors")
    return x is not None
