"""Open, low, high, close summaries of every N rows, and re-barring per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.positions import ranked
from colonnade.operators.stats import selected, usable
from colonnade.runtime import join_dimension

SUMMARIES = ("binOpen", "binClose", "binMean", "binStdev", "sum", "sumSquares")
BAR_COLUMNS = ("second", "symbol", "binOpen", "binMin", "binMax", "binClose", "binVolume")


def _binned(df: DataFrame, groups: list[str], order: list[str], size: int) -> DataFrame:
    """Adds __bin: bins of ``size`` consecutive rows of a group, from positions of a range-partitioned sort, however large the group."""
    if size < 1:
        raise ValueError("a bin holds at least one row")
    at = ranked(df, groups, [(c, False) for c in order], "__at")
    return at.withColumn("__bin", F.floor((F.col("__at") - 1) / F.lit(size)))


def running_bars(df: DataFrame, column: str, row: str, size: int, where: Column | None = None, summaries: tuple[str, ...] = SUMMARIES) -> DataFrame:
    """A bar for every ``size`` (selected) rows under ``row``, a shorter last one included: count, low, high and the summaries asked for.

    ``name`` is the number of rows up to the bar's end; open and close are floats; stdev is of the population.
    """
    if unknown := set(summaries) - set(SUMMARIES):
        raise ValueError(f"unknown summaries: {sorted(unknown)}")
    rows = usable(selected(df, where), column).select(F.lit(0).alias("__all"), F.col(f"`{row}`").alias("__row"), F.col(f"`{column}`").cast("double").alias("v"))
    v = F.col("v")
    every = {
        "binOpen": F.min_by(v, "__row").cast("float"),
        "binClose": F.max_by(v, "__row").cast("float"),
        "binMean": F.avg(v),
        "binStdev": F.stddev_pop(v),
        "sum": F.sum(v),
        "sumSquares": F.sum(v * v),
    }
    out = _binned(rows, ["__all"], ["__row"], size).groupBy("__bin").agg(F.max("__at").cast("string").alias("name"), F.min(v).alias("binMin"), F.max(v).alias("binMax"), F.count("*").alias("binCount"), *[every[s].alias(s) for s in SUMMARIES if s in summaries])
    return out.withColumn("binNumber", F.col("__bin")).select("binNumber", "name", "binMin", "binMax", "binCount", *[s for s in SUMMARIES if s in summaries])


def rebin_bars(bars: DataFrame, row: str, size: int) -> DataFrame:
    """Bars of ``size`` bars: open of the first, lowest low, highest high, close of the last."""
    if missing := {"binOpen", "binMin", "binMax", "binClose"} - set(bars.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = bars.select(F.lit(0).alias("__all"), F.col(f"`{row}`").alias("__row"), "binOpen", "binMin", "binMax", "binClose")
    out = _binned(rows, ["__all"], ["__row"], size).groupBy("__bin").agg(
        F.max("__at").cast("string").alias("name"),
        F.min_by("binOpen", "__row").cast("float").alias("binOpen"),
        F.min("binMin").cast("float").alias("binMin"),
        F.max("binMax").cast("float").alias("binMax"),
        F.max_by("binClose", "__row").cast("float").alias("binClose"),
        F.count("*").alias("binCount"),
    )
    return out.select(F.col("__bin").alias("binNumber"), "name", "binMin", "binMax", "binCount", "binOpen", "binClose")


def rebar_symbols(bars: DataFrame, order: list[str], size: int, openings: DataFrame) -> DataFrame:
    """Per symbol an opening row (second 0, volume 0, all prices the opening one), then a bar for every ``size`` bars in order:
    first open, lowest low, highest high, last close, sum of the volumes, greatest second.

    ``openings`` (symbol, openingPrice) says which symbols come; one without a price has null prices in its opening row, one
    without bars only that row. Bars without a symbol belong to none. Volumes are 64-bit sums.
    """
    if missing := set(BAR_COLUMNS) - set(bars.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    price = F.col("openingPrice").cast("float")
    first = openings.filter("symbol is not null").select("symbol", *[price.alias(c) for c in ("binOpen", "binMin", "binMax", "binClose")], F.lit(0).cast("long").alias("binVolume"), F.lit(0).alias("second"), F.lit(-1).cast("long").alias("__bin"))
    keys = openings.select("symbol").distinct()
    rows = join_dimension(bars.filter("symbol is not null"), keys, ["symbol"], "inner").select(*BAR_COLUMNS, *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)])
    place = F.col("__at")
    later = _binned(rows, ["symbol"], [f"__o{i}" for i in range(len(order))], size).groupBy("symbol", "__bin").agg(
        F.min_by("binOpen", place).cast("float").alias("binOpen"),
        F.min("binMin").cast("float").alias("binMin"),
        F.max("binMax").cast("float").alias("binMax"),
        F.max_by("binClose", place).cast("float").alias("binClose"),
        F.coalesce(F.sum("binVolume"), F.lit(0)).cast("long").alias("binVolume"),
        F.max("second").cast("int").alias("second"),
    )
    return first.unionByName(later).select("symbol", F.col("__bin").alias("bar"), "binOpen", "binMin", "binMax", "binClose", "binVolume", "second")


def as_bars(df: DataFrame, row: str) -> DataFrame:
    """A frame that holds the columns of running bars, checked and ordered; others are dropped."""
    needed = ["binNumber", "name", "binMin", "binMax", "binCount", "binOpen", "binClose"]
    if missing := set(needed) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select(*dict.fromkeys([row, *needed, *[c for c in SUMMARIES if c in df.columns]]))


def bar_frame(spark, seconds, symbols, opens, lows, highs, closes, volumes) -> DataFrame:
    """A frame of stock bars from lists of equal length, with row numbers ``rid``."""
    lists = (seconds, symbols, opens, lows, highs, closes, volumes)
    if len({len(x) for x in lists}) > 1:
        raise ValueError("the lists differ in length")
    kinds = (T.IntegerType(), T.StringType(), *[T.FloatType()] * 4, T.LongType())
    real = lambda x: None if x is None else float(x)
    rows = [(i, a, b, *map(real, prices), n) for i, (a, b, *prices, n) in enumerate(zip(*lists))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("rid", T.LongType()), *[T.StructField(c, k) for c, k in zip(BAR_COLUMNS, kinds)]]))
