"""Irregular readings onto a regular grid, by differences of consecutive readings shared out over the periods they span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("level", "counter")


def regular_grid(readings: DataFrame, source: str, segment: str, time: str, value: str, step: str, tie: str, kind: str = "level") -> DataFrame:
    """One row for each source, segment (such as a day) and period between the first and the last reading.

    ``time`` is an integer from 1, period k holds the times (k - 1) step < t <= k step. Consecutive readings (at t0 and t1)
    are differenced, and the difference is shared out over the periods between in proportion to the overlap with (t0, t1]:

    * ``level``: the increments add up to the value at the end of each period, the last reading of a period that holds one
      and the straight line between the neighbours of one that doesn't;
    * ``counter``: a reading below the one before it is a reset, whose increment is the reading itself; ``increment`` has
      the growth within the period.

    Columns: source, segment, period (int), n_readings, value, increment, resets, covered. ``covered`` is false for the
    periods without a reading, whose values are filled.

    Rows that lack source, segment, time, value or a step above 0, or whose value is NaN, are no readings, nor are infinite
    values of counters. Infinite levels are, but nothing is drawn from them: periods filled beside one have a null value. Of
    several readings at the same time the one with the highest ``tie`` holds. A segment is a bounded stretch of time, and
    readings of one time are folded before any ordering, so that no task holds more than a segment's length of times. A
    source with one reading in a segment has one row there. An empty table gives no rows.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if not isinstance(readings.schema[tie].dataType, T.NumericType):
        raise ValueError("tie must be a numeric column")
    c = lambda name: F.col(f"`{name}`")
    v = c(value).cast("double")
    usable = c(source).isNotNull() & c(segment).isNotNull() & c(time).isNotNull() & v.isNotNull() & ~F.isnan(v) & (c(step) > 0) & (c(time) > 0)
    finite = lambda x: F.abs(x) < F.lit(float("inf"))
    if kind == "counter":
        usable &= finite(v)
    slim = readings.filter(usable).select(c(source).alias("s"), c(segment).alias("g"), c(time).cast("long").alias("t"), v.alias("v"), c(step).cast("long").alias("step"), c(tie).alias("tie"))
    slim = slim.withColumn("period", F.expr("int((t + step - 1) div step)"))
    order = F.struct("t", "tie")
    w = Window.partitionBy("s", "g").orderBy("period")
    if kind == "level":
        # only the last reading of a period and the first one matter, so periods are folded before the shuffle
        cells = slim.groupBy("s", "g", "period").agg(
            F.count("*").alias("n"), F.max("step").alias("step"), F.min(F.struct("t", (-F.col("tie")).alias("tie"), "v")).alias("a"), F.max(F.struct("t", "tie", "v")).alias("z")
        )
        cells = cells.select("s", "g", "period", "n", "step", F.col("a.t").alias("t1"), F.col("a.v").alias("v1"), F.col("z.t").alias("tz"), F.col("z.v").alias("vz"), F.lit(0).cast("long").alias("resets"))
        cells = cells.withColumns({"p0": F.lag("period").over(w), "t0": F.lag("tz").over(w), "v0": F.lag("vz").over(w), "t2": F.lead("t1").over(w), "v2": F.lead("v1").over(w)})
        slope = F.when(finite(F.col("v0")) & finite(F.col("v1")), (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0")))
        lead_in = slope * (F.col("t1") - F.greatest((F.col("period") - 1) * F.col("step"), F.col("t0")))
        lead_out = F.when(finite(F.col("v2")) & finite(F.col("vz")), (F.col("v2") - F.col("vz")) / (F.col("t2") - F.col("tz"))) * (F.least(F.col("period") * F.col("step"), F.col("t2")) - F.col("tz"))
        # each period with a reading brings those without one before it; one evaluation of the window for both
        every = cells.withColumnRenamed("period", "p").withColumn("period", F.explode(F.expr("sequence(coalesce(p0 + 1, p), p)")))
        covered = F.col("period") == F.col("p")
        end, begin = F.col("period") * F.col("step"), F.greatest((F.col("period") - 1) * F.col("step"), F.col("t0"))
        inside = F.when(finite(F.col("vz")) & finite(F.col("v1")), F.col("vz") - F.col("v1")).otherwise(F.lit(0.0)) + F.coalesce(lead_in, F.lit(0.0)) + F.coalesce(lead_out, F.lit(0.0))
        cells = every.select(
            "s",
            "g",
            "period",
            F.when(covered, F.col("n")).otherwise(F.lit(0)).alias("n"),
            F.when(covered, F.col("vz")).otherwise(F.col("v0") + slope * (end - F.col("t0"))).alias("value"),
            F.when(covered, inside).otherwise(slope * (end - begin)).alias("increment"),
            "resets",
            covered.alias("covered"),
        )
    else:
        times = slim.groupBy("s", "g", "t").agg(F.count("*").alias("n"), F.max("step").alias("step"), F.max(F.struct("tie", "v")).alias("z"))
        times = times.select("s", "g", "t", "n", "step", F.col("z.v").alias("v"))
        wt = Window.partitionBy("s", "g").orderBy("t")
        times = times.withColumns({"t0": F.lag("t").over(wt), "v0": F.lag("v").over(wt)})
        reset = F.col("v") < F.col("v0")
        times = times.withColumn("grown", F.when(F.col("v0").isNull(), F.lit(0.0)).when(reset, F.col("v")).otherwise(F.col("v") - F.col("v0")))
        times = times.withColumn("reset", F.coalesce(reset.cast("long"), F.lit(0)))
        times = times.withColumn("p1", F.expr("int((t + step - 1) div step)")).withColumn("pa", F.coalesce(F.expr("int(t0 div step) + 1"), F.col("p1")))
        spread = times.withColumn("period", F.explode(F.sequence("pa", "p1")))
        begin, end = F.greatest((F.col("period") - 1) * F.col("step"), F.col("t0")), F.least(F.col("period") * F.col("step"), F.col("t"))
        part = F.when(F.col("t0").isNull(), F.lit(0.0)).otherwise(F.col("grown") * (end - begin) / (F.col("t") - F.col("t0")))
        last = F.col("period") == F.col("p1")
        cells = spread.groupBy("s", "g", "period").agg(
            F.sum(F.when(last, F.col("n")).otherwise(0)).alias("n"),
            F.max_by(F.when(last, F.col("v")), F.when(last, F.col("t"))).alias("value"),
            F.sum(part).alias("increment"),
            F.sum(F.when(last, F.col("reset")).otherwise(0)).alias("resets"),
        )
        cells = cells.withColumn("covered", F.col("n") > 0)
        level = F.last("value", ignorenulls=True).over(w)
        since = F.sum("increment").over(w.rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("__since", since).withColumn("value", F.coalesce("value", level + F.col("__since") - F.last(F.when(F.col("covered"), F.col("__since")), ignorenulls=True).over(w))).drop("__since")
    return cells.select(F.col("s").alias(source), F.col("g").alias(segment), "period", F.col("n").alias("n_readings"), "value", "increment", "resets", "covered")


def missing_periods(grid: DataFrame) -> DataFrame:
    """The periods that hold no reading."""
    return grid.filter(~F.col("covered"))
