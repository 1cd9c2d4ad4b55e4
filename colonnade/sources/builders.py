"""Vectors and scalars from Python values: frames of a row number ``rid`` and a value ``v``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import schema


def vector(spark: SparkSession, values: list, kind: str | None = None, name: str = "v", resolution: float | None = None) -> DataFrame:
    """A vector of a list (or array), its type the declared base type or that of the first element; an empty list needs one."""
    listed = values.tolist() if hasattr(values, "tolist") else list(values)
    spark_type = schema.BASE_TYPES[kind] if kind else schema.infer(listed)
    if isinstance(spark_type, (T.FloatType, T.DoubleType)):
        listed = [None if x is None else float(x) for x in listed]
    df = spark.createDataFrame(list(enumerate(listed)), T.StructType([T.StructField("rid", T.LongType(), False), T.StructField(name, spark_type)]))
    return schema.annotate(df, name, resolution=resolution) if resolution is not None else df


def counter(spark: SparkSession, first: int, last: int, kind: str = "LONG", name: str = "v") -> DataFrame:
    """first, first + 1, ... last, made by the executors; a bound beyond the type raises."""
    if kind not in schema.INTEGRAL:
        raise TypeError("counters are integral")
    return spark.range(0, max(last - first + 1, 0)).select(F.col("id").alias("rid"), (F.col("id") + F.lit(first).cast("long")).cast(schema.BASE_TYPES[kind]).alias(name))


def constant(spark: SparkSession, value, times: int, kind: str | None = None, name: str = "v") -> DataFrame:
    spark_type = schema.BASE_TYPES[kind] if kind else schema.infer([value])
    return spark.range(times).select(F.col("id").alias("rid"), F.lit(value).cast(spark_type).alias(name))


def scalar(spark: SparkSession, value, name: str = "v") -> DataFrame:
    return spark.createDataFrame([(value,)], T.StructType([T.StructField(name, schema.infer([value]))]))


class VectorBuilder:
    """Buffers values until it is sealed into a vector; then it takes no more."""

    def __init__(self, spark: SparkSession, kind: str, name: str = "v", resolution: float | None = None):
        self.spark, self.kind, self.name, self.resolution, self._values, self._sealed = spark, kind, name, resolution, [], None

    def append(self, values, times: int = 1) -> VectorBuilder:
        if self._sealed is not None:
            raise RuntimeError("the vector is sealed")
        items = list(values) if isinstance(values, (list, tuple)) or hasattr(values, "tolist") else [values]
        self._values += [schema.coerce(x, self.kind) for x in items] * times
        return self

    def seal(self) -> DataFrame:
        if self._sealed is None:
            self._sealed = vector(self.spark, self._values, self.kind, self.name, self.resolution)
        return self._sealed


def rows(df: DataFrame, order: str, columns: list[str] | None = None):
    """Iterates over rows in order, a partition at a time."""
    return df.orderBy(order).select(*(columns or df.columns)).toLocalIterator()


def values(df: DataFrame, column: str, order: str) -> list:
    """All values as a list: for what fits the driver by the caller's own judgement."""
    return [r[0] for r in df.orderBy(order).select(column).toLocalIterator()]


def as_doubles(df: DataFrame, column: str, order: str):
    """Values as a NumPy array of doubles, over Arrow: for what fits the driver by the caller's own judgement."""
    return df.orderBy(order).select(F.col(f"`{column}`").cast("double").alias("v")).toPandas()["v"].to_numpy()


def for_each(df: DataFrame, action) -> None:
    """Runs an action over the rows of each partition, on the executors."""
    df.foreachPartition(action)
