"""Histograms: top and bottom N values, unique values, equal-width ranges with optional statistics per bin."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import schema
from colonnade.operators.stats import bucket, resolution_of, selected, usable

VALUE_CAP = 10_000
#: most bins that are chosen automatically, and the fewest of a real column
AUTO_BINS, FEW_BINS = 21, 5


def _value_bins(df: DataFrame, column: str, row: str | None, where: Column | None, resolution: float | None) -> DataFrame:
    """One row for each bucket: its key, its count, and the value of its last row under ``row``."""
    r = resolution_of(df, column, resolution)
    v = F.col(f"`{column}`")
    rows = usable(selected(df, where), column)
    label = F.max_by(v, F.col(f"`{row}`")) if row else F.max(v)
    return rows.groupBy(bucket(v, r).alias("key")).agg(F.count("*").alias("binCount"), label.alias("value"))


def _numbered(bins: DataFrame) -> DataFrame:
    """At most VALUE_CAP rows, so one task numbers them."""
    w = Window.orderBy("key")
    return bins.select((F.row_number().over(w) - 1).cast("long").alias("binNumber"), F.col("value").cast("string").alias("name"), F.col("value").alias("binMin"), F.col("value").alias("binMax"), "binCount")


def top_values(df: DataFrame, column: str, n: int, top: bool = True, row: str | None = None, where: Column | None = None, resolution: float | None = None) -> DataFrame:
    """The n highest (lowest) distinct values with their counts, ascending. ``row`` orders rows; the last value names a real bucket."""
    if not 1 <= n <= VALUE_CAP:
        raise ValueError(f"n lies between 1 and {VALUE_CAP}")
    if schema.base_type(df, column) == "BOOLEAN":
        raise TypeError("no top values of booleans")
    bins = _value_bins(df, column, row, where, resolution)
    return _numbered(bins.orderBy(F.col("key").desc() if top else F.col("key").asc()).limit(n))


def top_rows(df: DataFrame, column: str, n: int, top: bool = True, where: Column | None = None, resolution: float | None = None) -> DataFrame:
    """All rows whose value is among the n highest (lowest): a semi-join on at most VALUE_CAP buckets."""
    r = resolution_of(df, column, resolution)
    key = bucket(F.col(f"`{column}`"), r)
    rows = usable(selected(df, where), column).withColumn("__key", key)
    keys = rows.groupBy("__key").agg(F.lit(1).alias("one")).orderBy(F.col("__key").desc() if top else F.col("__key").asc()).limit(n).select("__key")
    return rows.join(F.broadcast(keys), "__key", "left_semi").drop("__key")


def unique_values(df: DataFrame, column: str, row: str | None = None, where: Column | None = None, resolution: float | None = None) -> DataFrame:
    """Every distinct value with its count, ascending; more than VALUE_CAP raises, whatever the type."""
    bins = _value_bins(df, column, row, where, resolution)
    if bins.limit(VALUE_CAP + 1).count() > VALUE_CAP:
        raise ValueError(f"{column} has more than {VALUE_CAP} distinct values")
    return _numbered(bins)


@dataclass(frozen=True)
class Bins:
    """Equal-width bins: how many, where they begin, how wide, and whether values outside are left out."""

    low: Any
    high: Any
    many: int
    width: Any
    clip: bool
    real: bool
    resolution: float

    @classmethod
    def of(cls, df: DataFrame, column: str, k: int | None, low: Any, high: Any, resolution: float | None) -> Bins | None:
        """Bounds not given are those of the whole column, any selection aside; None for an empty column."""
        real, v = schema.is_real(df, column), F.col(f"`{column}`")
        lo, hi, n = usable(df, column).agg(F.min(v), F.max(v), F.count(v)).first()
        if lo is None:
            return None
        clip = low is not None or high is not None
        lo, hi = (lo if low is None else low), (hi if high is None else high)
        if not hi > lo:
            raise ValueError(f"no range from {lo} to {hi}")
        if k is not None and k < 1:
            raise ValueError("a histogram has at least one bin")
        r = (resolution_of(df, column, resolution) or 0.0) if real else 0.0
        if real:
            lo, hi = float(lo), float(hi)
            if k is None:
                most = min(schema.half_up((hi - lo) / r), n) if r else n
                k = FEW_BINS if most <= FEW_BINS else min(AUTO_BINS, most)
            return cls(lo, hi, k, (hi - lo) / k, clip, True, r)
        lo, hi = int(lo), int(hi)
        values = hi - lo + 1
        most = min(values, n)
        if most <= FEW_BINS:
            k = most
        elif k is None:
            k = min(AUTO_BINS, most)
        elif values < k:
            k = min(AUTO_BINS, most, k)
        return cls(lo, hi, k, max(1, (hi - lo) // k), clip, False, 0.0)

    def number(self, v: Column) -> Column:
        """The bin of a value, by truncation toward zero; null where it is left out."""
        if self.real:
            at = ((v.cast("double") - F.lit(self.low)) / F.lit(self.width)).cast("long")
            beyond = (at > self.many - 1) & (F.abs(v.cast("double") - F.lit(self.high)) > F.lit(self.resolution))
        else:
            off, w = v.cast("long") - F.lit(self.low).cast("long"), F.lit(self.width).cast("long")
            at = ((off - off % w) / w).cast("long")  # % has the sign of the dividend
            beyond = at > self.many - 1
        inside = F.least(at, F.lit(self.many - 1).cast("long"))
        return F.when((at < 0) | beyond, F.lit(None)).otherwise(inside) if self.clip else F.greatest(inside, F.lit(0).cast("long"))

    def edges(self) -> list[tuple[int, str, Any, Any]]:
        out = []
        for i in range(self.many):
            last = i == self.many - 1
            a = self.low + i * self.width
            if self.real:
                z = self.high if last else self.low + (i + 1) * self.width
                name = f"[{a:.2f}-{z:.2f}{']' if last else ')'}"
            else:
                z = self.high if last else self.low + (i + 1) * self.width - 1
                name = f"{a}" if a == z else f"{a}-{z}"
            out.append((i, name, a, z))
        return out


def range_bins(df: DataFrame, column: str, k: int | None = None, low: Any = None, high: Any = None, stats: bool = False, where: Column | None = None, resolution: float | None = None) -> DataFrame:
    """Counts in equal-width bins, every bin present: k bins, or a number chosen from the data, over the given range (values outside
    are left out) or that of the column. With ``stats`` also min, max, mean and population stdev in each bin, null where it is empty.

    An empty column or selection gives an empty frame. The bins, at most a few, are a literal table.
    """
    kind = df.schema[column].dataType
    if not (schema.is_real(df, column) or schema.is_integral(df, column)):
        raise TypeError(f"no range histogram of {kind.simpleString()}")
    spark = df.sparkSession
    fields = [T.StructField("binNumber", T.LongType()), T.StructField("name", T.StringType()), T.StructField("binMin", kind), T.StructField("binMax", kind)]
    bins = Bins.of(df, column, k, low, high, resolution)
    v = F.col(f"`{column}`")
    rows = usable(selected(df, where), column)
    if bins is None or rows.limit(1).count() == 0:
        more = [T.StructField(c, T.DoubleType()) for c in ("binStatsMin", "binStatsMax", "binStatsMean", "binStatsStdev")] if stats else []
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("binCount", T.LongType()), *more]))
    d = v.cast("double")
    wide = "double" if bins.real else "long"
    aggregates = [F.count("*").alias("c")] + ([F.min(v).cast(wide).alias("binStatsMin"), F.max(v).cast(wide).alias("binStatsMax"), F.avg(d).alias("binStatsMean"), F.stddev_pop(d).alias("binStatsStdev")] if stats else [])
    counted = rows.groupBy(bins.number(v).alias("binNumber")).agg(*aggregates)
    dimension = spark.createDataFrame(bins.edges(), T.StructType(fields))
    out = dimension.join(F.broadcast(counted), "binNumber", "left")
    return out.select("binNumber", "name", "binMin", "binMax", F.coalesce("c", F.lit(0)).alias("binCount"), *[c for c in counted.columns if c.startswith("binStats")])
