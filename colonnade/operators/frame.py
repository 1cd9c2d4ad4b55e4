"""Selections, projections, positional binding and concatenation of frames. Row order is an explicit key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import schema
from colonnade.operators.positions import ranked


def subset(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(where)


def cardinality(df: DataFrame, where: Column) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("cardinality"), F.count("*").alias("size"))


def positions_of(df: DataFrame, where: Column, row: str) -> DataFrame:
    return subset(df, where).select(row)


def as_logical(df: DataFrame, where: Column, name: str) -> DataFrame:
    """A selection as a boolean column, false where it doesn't hold."""
    return df.withColumn(name, F.coalesce(where, F.lit(False)))


def column_at(df: DataFrame, i: int) -> DataFrame:
    return df.select(F.col(f"`{df.columns[i]}`"))


def row_at(df: DataFrame, row: str, k: int, columns: list[str] | None = None) -> DataFrame:
    return df.filter(F.col(f"`{row}`") == k).select(*(columns or df.columns))


def id_column(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds row numbers from 0 under ``order`` by a range-partitioned sort, not by one task."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    numbered = ranked(df.withColumn("__all", F.lit(0)), ["__all"], [(order, False)], "__at")
    return schema.annotate(numbered.drop("__all").withColumn(name, F.col("__at") - 1).drop("__at"), name, row_id=True)


def cbind(frame: DataFrame, name: str, vector: DataFrame, value: str, row: str, label: bool = False) -> DataFrame:
    """Binds a vector by row number. The name must be new and both sides must hold the same rows, each once, else it raises.

    Both sides are folded by row number in one shuffle, which shows rows that one side lacks or that repeat; a missing row
    number raises too. Numbers of rows are compared at once, the rows themselves when the frame is read.
    """
    if name in frame.columns:
        raise ValueError(f"there is a column {name}")
    n, m = frame.count(), vector.count()
    if n != m:
        raise ValueError(f"a vector of {m} rows can't be bound to a frame of {n}")
    left = frame.select(F.col(f"`{row}`").alias("__row"), F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("__left"), F.lit(None).cast(T.StructType([T.StructField("v", vector.schema[value].dataType)])).alias("__right"))
    right = vector.select(F.col(f"`{row}`").cast(frame.schema[row].dataType).alias("__row"), F.lit(None).cast(left.schema["__left"].dataType).alias("__left"), F.struct(F.col(f"`{value}`").alias("v")).alias("__right"))
    both = left.unionByName(right).groupBy("__row").agg(F.count("__left").alias("__n"), F.count("__right").alias("__m"), F.first("__left", True).alias("__left"), F.first("__right", True).alias("__right"))
    whole = F.col("__row").isNotNull() & (F.col("__n") == 1) & (F.col("__m") == 1)
    message = F.concat(F.lit("row "), F.coalesce(F.col("__row").cast("string"), F.lit("null")), F.lit(" stands "), F.col("__n").cast("string"), F.lit(" times in the frame and "), F.col("__m").cast("string"), F.lit(" times in the vector"))
    bound = both.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    columns = [F.col("__left").getField(c).alias(c, metadata=frame.schema[c].metadata or {}) for c in frame.columns]
    return schema.annotate(bound.select(*columns, F.col("__right.v").alias(name, metadata=vector.schema[value].metadata or {})), name, label=label or None)


def append(first: DataFrame, second: DataFrame, row: str) -> DataFrame:
    """Rows of the second behind those of the first, numbered on: types of the first, into which the second is cast (a value that doesn't fit raises)."""
    n = first.agg(F.coalesce(F.max(row) + 1, F.lit(0)).cast("long")).first()[0]
    cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in first.schema if f.name != row]
    moved = second.select((F.col(row).cast("long") + F.lit(n)).alias(row), *cast)
    return first.withColumn(row, F.col(row).cast("long")).unionByName(moved)


def set_row_id(df: DataFrame, name: str) -> DataFrame:
    """Names the row-id column; the one before loses the mark."""
    for c in df.columns:
        if schema.metadata(df, c).get("row_id"):
            df = schema.annotate(df, c, row_id=None)
    return schema.annotate(df, name, row_id=True)


def row_id(df: DataFrame) -> str | None:
    return next((c for c in df.columns if schema.metadata(df, c).get("row_id")), None)


def labels(df: DataFrame) -> list[str]:
    return [c for c in df.columns if schema.metadata(df, c).get("label")]


def sorted_columns(df: DataFrame) -> list[str]:
    """Columns marked as sorted: a note, never verified."""
    return [c for c in df.columns if schema.metadata(df, c).get("sorted")]


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
