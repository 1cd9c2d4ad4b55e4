"""Queries of the operators on stock bars: implausible readings, regular grid, heavy symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.operators.balanced import heavy_keys, per_key_summary
from colonnade.operators.grid import missing_periods, regular_grid
from colonnade.operators.implausible import implausible
from colonnade.runtime import join_dimension
from colonnade.sources.tables import table

SESSION = 23_400
HEAVY = 0.025
WRAP = 100_000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "stock_quotes")
    return implausible(bars, "symbol", "trade_day", "second", "rid", ["binClose", "binOpen"], "binVolume").select("rid")


def grid(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "stock_quotes").select("rid", "trade_day", "second", "symbol", "binClose").filter(F.col("symbol").isNotNull() & F.col("second").between(1, SESSION))
    steps = table(spark, folder, "symbols").select("symbol", "grid_seconds")
    return regular_grid(join_dimension(bars, steps, ["symbol"], "inner"), "symbol", "trade_day", "second", "binClose", "grid_seconds", "rid")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return missing_periods(grid(spark, folder)).select("trade_day", "symbol", "period")


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid(spark, folder).select("trade_day", "symbol", "period", F.col("n_readings"), F.round("value", 4).alias("value"), F.round("increment", 3).alias("increment"), "covered")


def p4_counter(spark: SparkSession, folder: str) -> DataFrame:
    """A meter of each symbol's volume that begins anew every day and at every multiple of WRAP, on the regular grid."""
    bars = table(spark, folder, "stock_quotes").select("rid", "trade_day", "second", "symbol", "binVolume")
    bars = bars.filter(F.col("symbol").isNotNull() & F.col("second").between(1, SESSION) & (F.col("binVolume") >= 0))
    # a symbol's day is a bounded stretch of time; what each bar adds is wrapped first, as sums of 64-bit volumes may overflow
    so_far = F.sum(F.col("binVolume") % WRAP).over(Window.partitionBy("symbol", "trade_day").orderBy("second", "rid").rowsBetween(Window.unboundedPreceding, 0))
    steps = table(spark, folder, "symbols").select("symbol", "grid_seconds")
    meter = join_dimension(bars.withColumn("meter", so_far % WRAP), steps, ["symbol"], "inner")
    cells = regular_grid(meter, "symbol", "trade_day", "second", "meter", "grid_seconds", "rid", kind="counter")
    return cells.select("trade_day", "symbol", "period", "n_readings", F.round("value", 3).alias("value"), F.round("increment", 3).alias("increment"), "resets", "covered")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "stock_quotes").select("symbol", "trade_day", "second", "rid", "binVolume", "binClose")
    return per_key_summary(bars, "symbol", ["trade_day", "second", "rid"], "binVolume", "binClose")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(summary(spark, folder), HEAVY).select(F.col("key").alias("symbol"))


def p5_summary(spark: SparkSession, folder: str) -> DataFrame:
    """``volume`` is text: a sum of 64-bit values may need more digits than a number column of every engine holds."""
    s = summary(spark, folder).filter("key is not null")
    return s.select(F.col("key").alias("symbol"), "n_rows", "n_known", F.col("total").cast("string").alias("volume"), F.col("first").alias("first_close"), F.col("last").alias("last_close"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_grid, p4_counter, p5_found, p5_summary)}

_READINGS = f"""
  SELECT q.trade_day, q.symbol, q."second" AS t, q.rid, CAST(q."binClose" AS DOUBLE) AS v, CAST(s.grid_seconds AS BIGINT) AS step,
         CAST((q."second" + s.grid_seconds - 1) // s.grid_seconds AS INTEGER) AS period
  FROM stock_quotes q JOIN symbols s ON q.symbol = s.symbol
  WHERE q."second" BETWEEN 1 AND {SESSION} AND q."binClose" IS NOT NULL AND NOT isnan(q."binClose") AND s.grid_seconds > 0
"""

ORACLES = {
    "p4_found": f"""
  WITH r AS ({_READINGS}), b AS (SELECT trade_day, symbol, min(period) AS a, max(period) AS z FROM r GROUP BY ALL),
  every AS (SELECT trade_day, symbol, unnest(generate_series(a, z)) AS period FROM b)
  SELECT trade_day, symbol, CAST(period AS INTEGER) AS period FROM every
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.trade_day = every.trade_day AND r.symbol = every.symbol AND r.period = every.period)
""",
    "p4_grid": f"""
  WITH r AS ({_READINGS}),
  cell AS (SELECT trade_day, symbol, period, max(step) AS step, count(*) AS n,
             arg_min(v, (t, -rid)) AS v1, min(t) AS t1, arg_max(v, (t, rid)) AS vz, max(t) AS tz FROM r GROUP BY ALL),
  n AS (SELECT *, lag(period) OVER w AS p0, lag(tz) OVER w AS t0, lag(vz) OVER w AS v0, lead(t1) OVER w AS t2, lead(v1) OVER w AS v2 FROM cell WINDOW w AS (PARTITION BY symbol, trade_day ORDER BY period)),
  l AS (SELECT *, CASE WHEN NOT isinf(v0) AND NOT isinf(v1) THEN (v1 - v0) / (t1 - t0) END AS slope, CASE WHEN NOT isinf(v2) AND NOT isinf(vz) THEN (v2 - vz) / (t2 - tz) END AS ahead FROM n),
  g AS (SELECT *, unnest(generate_series(p0 + 1, period - 1)) AS p FROM l WHERE period > p0 + 1)
  SELECT trade_day, symbol, period, CAST(n AS BIGINT) AS n_readings, round(vz, 4) AS value,
    round(CASE WHEN NOT isinf(vz) AND NOT isinf(v1) THEN vz - v1 ELSE 0 END + coalesce(slope * (t1 - greatest((period - 1) * step, t0)), 0) + coalesce(ahead * (least(period * step, t2) - tz), 0), 3) + 0.0::DOUBLE AS increment, true AS covered FROM l
  UNION ALL
  SELECT trade_day, symbol, CAST(p AS INTEGER), CAST(0 AS BIGINT), CASE WHEN NOT isinf(v0) AND NOT isinf(v1) THEN round(v0 + (v1 - v0) / (t1 - t0) * (p * step - t0), 4) END, round(slope * (p * step - greatest((p - 1) * step, t0)), 3) + 0.0::DOUBLE, false FROM g
""",
    "p4_counter": f"""
  WITH m AS (SELECT q.trade_day, q.symbol, q."second" AS t, q.rid, CAST(s.grid_seconds AS BIGINT) AS step,
      CAST(CAST(sum(q."binVolume" % {WRAP}) OVER (PARTITION BY q.symbol, q.trade_day ORDER BY q."second", q.rid) AS BIGINT) % {WRAP} AS DOUBLE) AS v
    FROM stock_quotes q JOIN symbols s ON q.symbol = s.symbol WHERE q."second" BETWEEN 1 AND {SESSION} AND q."binVolume" >= 0 AND s.grid_seconds > 0),
  i AS (SELECT trade_day, symbol, t, count(*) AS n, max(step) AS step, arg_max(v, rid) AS v FROM m GROUP BY ALL),
  l AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM i WINDOW w AS (PARTITION BY symbol, trade_day ORDER BY t)),
  g AS (SELECT *, CASE WHEN v0 IS NULL THEN 0 WHEN v < v0 THEN v ELSE v - v0 END AS grown, (t + step - 1) // step AS p1, coalesce(t0 // step + 1, (t + step - 1) // step) AS pa FROM l),
  e AS (SELECT *, unnest(generate_series(pa, p1)) AS period FROM g),
  c AS (SELECT trade_day, symbol, period, CAST(sum(CASE WHEN period = p1 THEN n ELSE 0 END) AS BIGINT) AS n, arg_max(v, t) FILTER (WHERE period = p1) AS v,
      sum(CASE WHEN t0 IS NULL THEN 0 ELSE grown * (least(period * step, t) - greatest((period - 1) * step, t0)) / (t - t0)::DOUBLE END) AS increment,
      CAST(sum(CASE WHEN period = p1 AND v < v0 THEN 1 ELSE 0 END) AS BIGINT) AS resets FROM e GROUP BY ALL),
  x AS (SELECT *, sum(increment) OVER (PARTITION BY symbol, trade_day ORDER BY period) AS since FROM c),
  y AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS level, last_value(CASE WHEN n > 0 THEN since END IGNORE NULLS) OVER w AS base FROM x WINDOW w AS (PARTITION BY symbol, trade_day ORDER BY period))
  SELECT trade_day, symbol, CAST(period AS INTEGER) AS period, n AS n_readings, round(coalesce(v, level + since - base), 3) AS value, round(increment, 3) AS increment, resets, n > 0 AS covered FROM y
""",
    "p5_found": f"""
  SELECT symbol FROM stock_quotes WHERE symbol IS NOT NULL GROUP BY symbol
  HAVING count(*) >= {HEAVY} * (SELECT count(*) FROM stock_quotes)
""",
    "p5_summary": """
  SELECT symbol, count(*) AS n_rows, count("binVolume") AS n_known, CAST(sum(CAST("binVolume" AS HUGEINT)) AS VARCHAR) AS volume,
    first("binClose" ORDER BY trade_day NULLS FIRST, "second" NULLS FIRST, rid) FILTER (WHERE "binClose" IS NOT NULL AND NOT isnan("binClose")) AS first_close,
    last("binClose" ORDER BY trade_day NULLS FIRST, "second" NULLS FIRST, rid) FILTER (WHERE "binClose" IS NOT NULL AND NOT isnan("binClose")) AS last_close
  FROM stock_quotes WHERE symbol IS NOT NULL GROUP BY symbol
""",
}
