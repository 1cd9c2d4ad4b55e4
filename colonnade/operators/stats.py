"""Descriptive statistics, resolution, quantiles, distinct values."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import schema
from colonnade.runtime import materialize, partitions

#: parts that the range of a column is divided into for its automatic resolution
GRAIN_PARTS = 10_000
UNIQUE_CAP = 100_000
SECOND_MOMENT = 2**31 - 1
PERCENTILES = tuple(range(0, 101, 5))


def selected(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither null nor NaN: neither can occur in a sealed vector."""
    v = F.col(f"`{column}`")
    return df.filter(v.isNotNull() & ~F.isnan(v)) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else df.filter(v.isNotNull())


def auto_resolution(df: DataFrame, column: str) -> float | None:
    """10^round(log10((max - min) / 10000)); 0 for a constant column, None for an empty one. One aggregate row."""
    v = F.col(f"`{column}`").cast("double")
    lo, hi = usable(df, column).agg(F.min(v), F.max(v)).first()
    if lo is None:
        return None
    grain = (hi - lo) / GRAIN_PARTS
    return 0.0 if grain <= 0 else 10.0 ** schema.half_up(math.log10(grain))


def resolution_of(df: DataFrame, column: str, resolution: float | None = None) -> float | None:
    """The resolution given, else that in the column's metadata, else the automatic one; None if not real or empty."""
    if not schema.is_real(df, column):
        return None
    if resolution is not None:
        return float(resolution)
    stored = schema.metadata(df, column).get("resolution")
    return float(stored) if stored is not None else auto_resolution(df, column)


def bucket(column: Column, r: float | None) -> Column:
    """Key under which values are the same: the value, or its number of resolutions, rounded half up."""
    return F.floor(column.cast("double") / F.lit(r) + 0.5) if r else column


def unbucket(key: Column, r: float | None) -> Column:
    return key * F.lit(r) if r else key


def describe(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """min, max, count, and of numbers sum, mean, sumSquares, variance and stdev (population), and whether the second moment is beyond exact range."""
    kind, v = schema.base_type(df, column), F.col(f"`{column}`")
    rows = usable(selected(df, where), column)
    base = [F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count")]
    if kind in ("STRING", "BOOLEAN"):
        if where is not None:
            raise TypeError(f"statistics under a selection are for numbers, {column} is {kind}")
        return rows.agg(*base)
    d = v.cast("double")
    return rows.agg(
        *base,
        F.sum(d).alias("sum"),
        F.avg(d).alias("mean"),
        F.sum(d * d).alias("sumSquares"),
        F.var_pop(d).alias("variance"),
        F.stddev_pop(d).alias("stdev"),
        (F.coalesce(F.sum(d * d), F.lit(0.0)) > SECOND_MOMENT).alias("momentOverflow"),
    )


def true_stats(df: DataFrame, column: str) -> DataFrame:
    """trueCount and trueRatio of a boolean column; an empty one raises."""
    if schema.base_type(df, column) != "BOOLEAN":
        raise TypeError(f"{column} is no boolean column")
    v = F.col(f"`{column}`")
    out = usable(df, column).agg(F.count_if(v).alias("trueCount"), F.avg(v.cast("double")).alias("trueRatio"))
    return out.select("trueCount", F.coalesce("trueRatio", F.raise_error(F.lit("an empty column has no ratio")).cast("double")).alias("trueRatio"))


def quantile_ranks(n: int) -> dict[int, list[int]]:
    """Ranks from 0 whose values make each percentile: their mean where there are two. Others aren't computed."""
    if n < 1:
        return {}
    middle = [n // 2] if n % 2 else [n // 2 - 1, n // 2]
    if n <= 5:
        return {0: [0], 50: middle, 100: [n - 1]}
    if n <= 20:
        return {0: [0], 25: [n // 4], 50: middle, 75: [3 * n // 4], 100: [n - 1]}
    return {p: [min(max(schema.half_up(n * (p // 5) / 20 - 1), 0), n - 1)] for p in PERCENTILES}


def quantiles(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """p0, p5 ... p100, exact at any size, the 21 ranks picked from the counts of equal values. Null where not computed.

    Equal values are counted before the shuffle, and only (value, count) pairs are range-partitioned and sorted; their sums a
    partition, one number each, say where every partition begins.
    """
    v = F.col(f"`{column}`").cast("double")
    counted = usable(selected(df, where), column).groupBy(v.alias("v")).agg(F.count("*").alias("c"))
    parts = counted.repartitionByRange(partitions(df), "v").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "counts")
    sums = parts.groupBy("part").agg(F.sum("c").alias("c")).orderBy("part").collect()  # one row for each partition
    ranks = quantile_ranks(sum(r["c"] for r in sums))
    wanted = sorted({r for rs in ranks.values() for r in rs})
    begins = list(itertools.accumulate((r["c"] for r in sums), initial=0))
    held = [(r["part"], a) for r, a, z in zip(sums, begins, begins[1:]) if any(a <= w < z for w in wanted)]
    first = df.sparkSession.createDataFrame(held, "part int, before long")
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    here = parts.join(F.broadcast(first), "part").withColumn("to", F.col("before") + F.sum("c").over(w))
    within = F.array(*[F.lit(r).cast("long") for r in wanted]) if wanted else F.array().cast("array<long>")
    hit = here.withColumn("at", F.explode(F.filter(within, lambda r: (r < F.col("to")) & (r >= F.col("to") - F.col("c"))))).withColumn("at", F.col("at") + 1)
    at = hit.select("v", "at")
    picks = [F.avg(F.when(F.col("at").isin([r + 1 for r in ranks[p]]), F.col("v"))).alias(f"p{p}") if p in ranks else F.lit(None).cast("double").alias(f"p{p}") for p in PERCENTILES]
    return at.agg(*picks)


def approximate_quantiles(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """All 21 percentiles in one pass, without a sort, within n / accuracy ranks."""
    v = F.col(f"`{column}`").cast("double")
    return usable(df, column).agg(*[F.percentile_approx(v, p / 100, accuracy).alias(f"p{p}") for p in PERCENTILES])


def percentile(quantile_row: DataFrame, p: int) -> DataFrame:
    if p not in PERCENTILES:
        raise ValueError("percentiles are multiples of 5 from 0 to 100")
    return quantile_row.select(f"p{p}")


def sorted_unique(df: DataFrame, column: str, where: Column | None = None, resolution: float | None = None, most: int = UNIQUE_CAP) -> DataFrame:
    """Distinct values ascending, reals as multiples of the resolution; more than ``most`` raises."""
    r = resolution_of(df, column, resolution)
    key = bucket(F.col(f"`{column}`"), r)
    values = usable(selected(df, where), column).select(key.alias("__key")).distinct()
    if values.limit(most + 1).count() > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return values.select(unbucket(F.col("__key"), r).alias(column)).orderBy(column)


def count_unique(df: DataFrame, column: str, where: Column | None = None, resolution: float | None = None, approximate: bool = False) -> DataFrame:
    r = resolution_of(df, column, resolution)
    key = bucket(F.col(f"`{column}`"), r)
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return usable(selected(df, where), column).agg(count.alias("uniqueCount"))


def has_more_than_one(df: DataFrame, column: str, resolution: float | None = None) -> DataFrame:
    v = F.col(f"`{column}`")
    rows = usable(df, column)
    if schema.is_real(df, column):
        r = resolution_of(df, column, resolution) or 0.0
        different = F.max(v).cast("double") - F.min(v).cast("double") > F.lit(r)
    else:
        different = F.min(v) != F.max(v)
    return rows.agg(F.coalesce(different, F.lit(False)).alias("hasMoreThanOneValue"))
