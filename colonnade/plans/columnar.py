"""Queries of the columnar operators, each with the SQL it is held against."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade import schema
from colonnade.operators import bars, factors, frame, histograms, predicates, stats
from colonnade.operators.predicates import Between, Compare, Equals, Flag, In, Range
from colonnade.runtime import shared_dir
from colonnade.sources import builders, export
from colonnade.sources.tables import table
from colonnade.storage import Files
from colonnade.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def scratch(s: SparkSession, label: str) -> str:
    """A new folder in the one that the executors share."""
    return f"{shared_dir(s)}/colonnade/{label}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{n}`", digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def part(s, d):
    return table(s, d, "part")


def orders(s, d):
    return table(s, d, "orders")


def lineitem(s, d):
    return table(s, d, "lineitem")


def events(s, d):
    return table(s, d, "events")


def flagged(s, d):
    return lineitem(s, d).withColumn("returned", F.col("l_returnflag") == "R")


def _filter(name: str, source: Callable, term: predicates.Predicate, columns: list[str], sql: str) -> None:
    """Registers a predicate's query: the rows that meet it."""
    query(sql, name)(lambda s, d: frame.subset(df := source(s, d), term.column(df)).select(*columns))


R = 0.001
_filter("eq_int", part, Equals("p_size", 15), ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size = 15")
_filter("eq_string", orders, Equals("o_orderstatus", "F"), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_filter("eq_bool", flagged, Equals("returned", "yes"), ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
_filter("eq_double_resolution", lineitem, Equals("l_discount", 0.05, R), ["l_orderkey", "l_discount"], f"SELECT l_orderkey, l_discount FROM lineitem WHERE abs(l_discount - 0.05::DOUBLE) <= {R}::DOUBLE")
_filter("range_int_closed", part, Between("p_size", 10, 20), ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
_filter("range_int_open", part, Between("p_size", 10, 20, False, False), ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20")
_filter("range_double_right_open", orders, Between("o_totalprice", 10_000.0, 20_000.0, resolution=0.01), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE (o_totalprice > 10000 OR abs(o_totalprice - 10000) <= 0.01::DOUBLE) AND o_totalprice < 20000")
_filter("range_double_closed_resolution", orders, Between("o_totalprice", 10_000.0, 20_000.0, True, True, 50.0), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE (o_totalprice > 10000 OR abs(o_totalprice - 10000) <= 50) AND (o_totalprice < 20000 OR abs(o_totalprice - 20000) <= 50)")
_filter("in_int", part, In("p_size", [2, 3, 5, 13, 9]), ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size IN (2, 3, 5, 13, 9)")
_filter("in_string", lambda s, d: table(s, d, "customer"), In("c_mktsegment", ["BUILDING", "MACHINERY"]), ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _filter(f"cmp_{_name}_int", part, Compare("p_size", _op, 25), ["p_partkey"], f"SELECT p_partkey FROM part WHERE p_size {_op} 25")
    _near = f"abs(o_totalprice - 250000) <= 100"
    _filter(f"cmp_{_name}_double", orders, Compare("o_totalprice", _op, 250_000.0, 100.0), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE o_totalprice {_op} 250000 " + (f"OR {_near}" if "=" in _op else f"AND NOT {_near}"))
_filter("le_helper", orders, predicates.at_most("o_totalprice", 20_000.0, 50.0), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_totalprice < 20000 OR abs(o_totalprice - 20000) <= 50")
_filter("ge_helper", orders, predicates.at_least("o_orderkey", 5_000), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderkey >= 5000")
_filter("column_in_range", orders, Between("o_custkey", 100, 200), ["o_orderkey", "o_custkey"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
_filter("column_equals", orders, Equals("o_orderpriority", "1-URGENT") & Compare("o_custkey", "<", 300), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey < 300")
_filter("bitmap_or", orders, Equals("o_orderstatus", "F") | Compare("o_custkey", "<", 50), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey < 50")
_filter("bitmap_not", orders, ~Equals("o_orderstatus", "F"), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'")
_filter("logical_as_bitmap", flagged, Flag("returned"), ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")


@query("""SELECT l_orderkey, l_discount FROM lineitem WHERE (l_discount > 0.05::DOUBLE OR abs(l_discount - 0.05::DOUBLE) <= 0.001::DOUBLE) AND l_discount < 0.07::DOUBLE
  AND l_linenumber BETWEEN 1 AND 3""")
def and_set(s, d):
    return predicates.select(lineitem(s, d), Between("l_discount", 0.05, 0.07, resolution=R), Between("l_linenumber", 1, 3)).select("l_orderkey", "l_discount")


@query("SELECT 'l_discount in [0.05..0.07) AND l_linenumber in [1..3] AND l_returnflag = ''R''' AS text")
def predicate_text(s, d):
    term = Between("l_discount", 0.05, 0.07) & Between("l_linenumber", 1, 3) & Equals("l_returnflag", "R")
    return builders.scalar(s, term.text(lineitem(s, d)), "text")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37 ORDER BY o_orderkey LIMIT 1")
def single_row(s, d):
    return predicates.single_row(orders(s, d), "o_custkey", 37, "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_large_set(s, d):
    wanted = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return predicates.member_of(orders(s, d), "o_custkey", wanted, "c_custkey").select("o_orderkey")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS cardinality, count(*) AS size FROM orders")
def bitmap_cardinality(s, d):
    return frame.cardinality(df := orders(s, d), Equals("o_orderstatus", "F").column(df))


@query("SELECT event_id FROM events WHERE value >= 100")
def bitmap_positions(s, d):
    return frame.positions_of(df := events(s, d), Compare("value", ">=", 100.0, 0.0).column(df), "event_id")


@query("SELECT event_id, value >= 100 AS flag FROM events")
def bitmap_to_logical(s, d):
    return frame.as_logical(df := events(s, d), Compare("value", ">=", 100.0, 0.0).column(df), "flag").select("event_id", "flag")


# statistics and distinct values
_AUTO = "(SELECT pow(10, floor(log10((max({v}) - min({v})) / 10000) + 0.5)) FROM {t})"


@query(f"SELECT round({_AUTO.format(v='o_totalprice', t='orders')}, 9) AS resolution")
def auto_resolution(s, d):
    return builders.scalar(s, round(stats.auto_resolution(orders(s, d), "o_totalprice"), 9), "resolution")


@query(f"SELECT max(value) - min(value) > {_AUTO.format(v='value', t='events')} AS \"hasMoreThanOneValue\" FROM events")
def has_more_than_one(s, d):
    return stats.has_more_than_one(events(s, d), "value")


@query("SELECT DISTINCT p_brand FROM part")
def distinct_sorted(s, d):
    return stats.sorted_unique(part(s, d), "p_brand")


@query("SELECT round(k * 10.0::DOUBLE, 6) AS value FROM (SELECT DISTINCT floor(value / 10.0::DOUBLE + 0.5) AS k FROM events)")
def distinct_resolution(s, d):
    return rounded(stats.sorted_unique(events(s, d), "value", resolution=10.0))


@query("SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#12'")
def distinct_filtered(s, d):
    return stats.sorted_unique(df := part(s, d), "p_size", Equals("p_brand", "Brand#12").column(df))


@query("SELECT count(DISTINCT floor(value / 0.5::DOUBLE + 0.5)) AS \"uniqueCount\" FROM events WHERE event_type <> 'purchase'")
def count_unique_filtered(s, d):
    return stats.count_unique(df := events(s, d), "value", (~Equals("event_type", "purchase")).column(df), 0.5)


def _describe_sql(v: str, t: str, where: str = "TRUE", wide: bool = True) -> str:
    x = f"CAST({v} AS DOUBLE)"
    numbers = f""", round(sum({x}), 4) AS sum, round(avg({x}), 4) AS mean, round(sum({x} * {x}), 4) AS "sumSquares", round(var_pop({x}), 4) AS variance,
    round(stddev_pop({x}), 4) AS stdev, sum({x} * {x}) > 2147483647 AS "momentOverflow\""""
    return f'SELECT min({v}) AS min, max({v}) AS max, count({v}) AS count{numbers if wide else ""} FROM {t} WHERE {where}'


@query(_describe_sql("p_size", "part"))
def describe_int(s, d):
    return rounded(stats.describe(part(s, d), "p_size"), 4)


@query(_describe_sql("l_discount", "lineitem"))
def describe_double(s, d):
    return rounded(stats.describe(lineitem(s, d), "l_discount"), 4)


@query(_describe_sql("o_orderpriority", "orders", wide=False))
def describe_string(s, d):
    return stats.describe(orders(s, d), "o_orderpriority")


@query(_describe_sql("value", "events", "event_type = 'purchase'"))
def describe_filtered(s, d):
    return rounded(stats.describe(df := events(s, d), "value", Equals("event_type", "purchase").column(df)), 4)


@query('SELECT count(*) FILTER (WHERE l_returnflag = \'R\') AS "trueCount", round(avg((l_returnflag = \'R\')::INT), 6) AS "trueRatio" FROM lineitem')
def true_count_ratio(s, d):
    return rounded(stats.true_stats(flagged(s, d), "returned"))


@query("SELECT sum(CAST(p_size AS DOUBLE) * p_size) > 2147483647 AS overflow FROM part")
def moment_flag(s, d):
    return stats.describe(part(s, d), "p_size").select(F.col("momentOverflow").alias("overflow"))


def _quantile_sql(v: str, t: str, ranks: str) -> str:
    picks = ", ".join(f"avg(v) FILTER (WHERE list_contains({ranks.format(p=p)}, k)) AS p{p}" for p in range(0, 101, 5))
    return f"WITH x AS (SELECT CAST({v} AS DOUBLE) AS v, row_number() OVER (ORDER BY {v}) - 1 AS k, count(*) OVER () AS n FROM {t}) SELECT {picks} FROM x"


_FULL = "[greatest(CAST(floor(n * ({p} / 5) / 20.0::DOUBLE - 1 + 0.5) AS BIGINT), 0)]"
_FEW = "(CASE {p} WHEN 0 THEN [0] WHEN 50 THEN [(n - 1) // 2, n // 2] WHEN 100 THEN [n - 1] ELSE CAST([] AS BIGINT[]) END)"
_SOME = "(CASE {p} WHEN 0 THEN [0] WHEN 25 THEN [n // 4] WHEN 50 THEN [(n - 1) // 2, n // 2] WHEN 75 THEN [3 * n // 4] WHEN 100 THEN [n - 1] ELSE CAST([] AS BIGINT[]) END)"


@query(_quantile_sql("value", "events", _FULL))
def quantiles_21(s, d):
    return stats.quantiles(events(s, d), "value")


@query(_quantile_sql("n_nationkey", "(SELECT * FROM nation WHERE n_nationkey < 15)", _SOME))
def quantiles_four(s, d):
    return stats.quantiles(df := table(s, d, "nation"), "n_nationkey", F.col("n_nationkey") < 15)


@query(_quantile_sql("r_regionkey", "region", _FEW))
def quantiles_median(s, d):
    return stats.quantiles(table(s, d, "region"), "r_regionkey")


# histograms
def _top_sql(v: str, t: str, n: int, desc: str, row: str | None = None, r: float | None = None, where: str = "TRUE") -> str:
    key = f"floor({v} / {r}::DOUBLE + 0.5)" if r else v
    label = f"arg_max({v}, {row})" if row else f"max({v})"
    return f"""WITH b AS (SELECT {key} AS k, {label} AS x, count(*) AS c FROM {t} WHERE {where} GROUP BY {key} ORDER BY k {desc} LIMIT {n})
    SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS "binNumber", CAST(x AS VARCHAR) AS name, x AS "binMin", x AS "binMax", c AS "binCount" FROM b"""


@query(_top_sql("o_totalprice", "orders", 12, "DESC", "o_orderkey", 10.0))
def topn_double(s, d):
    return histograms.top_values(orders(s, d), "o_totalprice", 12, True, "o_orderkey", resolution=10.0)


@query(_top_sql("o_totalprice", "orders", 12, "ASC", "o_orderkey", 10.0))
def bottomn_double(s, d):
    return histograms.top_values(orders(s, d), "o_totalprice", 12, False, "o_orderkey", resolution=10.0)


@query(_top_sql("p_size", "part", 12, "DESC"))
def topn_int(s, d):
    return histograms.top_values(part(s, d), "p_size", 12)


@query(_top_sql("p_type", "part", 7, "DESC"))
def topn_string(s, d):
    return histograms.top_values(part(s, d), "p_type", 7)


@query(_top_sql("p_size", "part", 12, "DESC", where="p_brand = 'Brand#12'"))
def topn_filtered(s, d):
    return histograms.top_values(df := part(s, d), "p_size", 12, where=Equals("p_brand", "Brand#12").column(df))


@query("""WITH k AS (SELECT DISTINCT floor(value / 1.0::DOUBLE + 0.5) AS k FROM events ORDER BY k DESC LIMIT 10)
  SELECT event_id, value FROM events WHERE floor(value / 1.0::DOUBLE + 0.5) IN (SELECT k FROM k)""")
def topn_rows(s, d):
    return histograms.top_rows(events(s, d), "value", 10, resolution=1.0).select("event_id", "value")


@query(_top_sql("l_linestatus", "lineitem", 10_000, "ASC"))
def unique_hist_string(s, d):
    return histograms.unique_values(lineitem(s, d), "l_linestatus")


@query(_top_sql("p_size", "part", 10_000, "ASC"))
def unique_hist_int(s, d):
    return histograms.unique_values(part(s, d), "p_size")


@query(_top_sql("value", "events", 10_000, "ASC", "event_id", 1.0))
def unique_hist_double(s, d):
    return histograms.unique_values(events(s, d), "value", "event_id", resolution=1.0)


@query(_top_sql("returned", "(SELECT l_returnflag = 'R' AS returned FROM lineitem)", 10_000, "ASC"))
def unique_hist_bool(s, d):
    return histograms.unique_values(flagged(s, d), "returned")


@query(_top_sql("p_size", "part", 10_000, "ASC", where="p_retailprice < 1200"))
def unique_hist_filtered(s, d):
    return histograms.unique_values(df := part(s, d), "p_size", where=Compare("p_retailprice", "<", 1200.0, 0.0).column(df))


def _int_hist_sql(v: str, t: str, k: str, lo: str, hi: str, clip: bool, where: str = "TRUE", more: str = "") -> str:
    keep = "b BETWEEN 0 AND k - 1" if clip else "TRUE"
    return f"""WITH c AS (SELECT CAST({lo} AS BIGINT) AS lo, CAST({hi} AS BIGINT) AS hi, count(*) AS n FROM {t}),
    p AS (SELECT *, CAST({k} AS BIGINT) AS k FROM c), w AS (SELECT *, greatest((hi - lo) // k, 1) AS w FROM p),
    x AS (SELECT {v} AS v, CAST(trunc(({v} - lo) / w.w::DOUBLE) AS BIGINT) AS b, w.k FROM {t}, w WHERE {where}),
    y AS (SELECT least(b, k - 1) AS b, v FROM x WHERE {keep}),
    g AS (SELECT b, count(*) AS n, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS sd FROM y GROUP BY b),
    e AS (SELECT i, lo + i * w AS a, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * w - 1 END AS z FROM w, unnest(generate_series(0, k - 1)) AS s(i))
    SELECT CAST(i AS BIGINT) AS "binNumber", CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE CONCAT(a, '-', z) END AS name,
      CAST(a AS INTEGER) AS "binMin", CAST(z AS INTEGER) AS "binMax", CAST(coalesce(n, 0) AS BIGINT) AS "binCount"{more} FROM e LEFT JOIN g ON g.b = e.i"""


def _real_hist_sql(v: str, t: str, k: str, lo: str, hi: str, r: str, clip: bool, where: str = "TRUE", more: str = "") -> str:
    keep = f"b >= 0 AND NOT (b > k - 1 AND abs(v - hi) > {r})" if clip else "TRUE"
    return f"""WITH c AS (SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, count(*) AS n FROM {t}),
    p AS (SELECT *, CAST({k} AS BIGINT) AS k FROM c), w AS (SELECT *, (hi - lo) / k AS w FROM p),
    x AS (SELECT {v} AS v, CAST(trunc(({v} - lo) / w.w) AS BIGINT) AS b, w.k, w.hi FROM {t}, w WHERE {where}),
    y AS (SELECT least(b, k - 1) AS b, v FROM x WHERE {keep}),
    g AS (SELECT b, count(*) AS n, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS sd FROM y GROUP BY b),
    e AS (SELECT i, k, lo + i * w AS a, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * w END AS z FROM w, unnest(generate_series(0, k - 1)) AS s(i))
    SELECT CAST(i AS BIGINT) AS "binNumber", printf('[%.2f-%.2f%s', a, z, CASE WHEN i = k - 1 THEN ']' ELSE ')' END) AS name,
      round(a, 6) AS "binMin", round(z, 6) AS "binMax", CAST(coalesce(n, 0) AS BIGINT) AS "binCount"{more} FROM e LEFT JOIN g ON g.b = e.i"""


_INT_AUTO = "CASE WHEN least(hi - lo + 1, n) <= 5 THEN least(hi - lo + 1, n) ELSE least(21, least(hi - lo + 1, n)) END"


@query(_int_hist_sql("p_size", "part", _INT_AUTO, "min(p_size)", "max(p_size)", False))
def range_hist_auto_int(s, d):
    return histograms.range_bins(part(s, d), "p_size")


@query(_real_hist_sql("value", "events", "21", "min(value)", "max(value)", "0.01", False))
def range_hist_auto_double(s, d):
    return rounded(histograms.range_bins(events(s, d), "value", resolution=0.01))


@query(_int_hist_sql("p_size", "part", "10", "min(p_size)", "max(p_size)", False))
def range_hist_k_int(s, d):
    return histograms.range_bins(part(s, d), "p_size", 10)


@query(_real_hist_sql("l_quantity", "lineitem", "10", "min(l_quantity)", "max(l_quantity)", "0.001", False))
def range_hist_k_double(s, d):
    return rounded(histograms.range_bins(lineitem(s, d), "l_quantity", 10, resolution=0.001))


@query(_int_hist_sql("p_size", "part", "5", "12", "33", True))
def range_hist_clip_int(s, d):
    return histograms.range_bins(part(s, d), "p_size", 5, 12, 33)


@query(_real_hist_sql("value", "events", "8", "50", "300", "0.01", True))
def range_hist_clip_double(s, d):
    return rounded(histograms.range_bins(events(s, d), "value", 8, 50.0, 300.0, resolution=0.01))


@query(_real_hist_sql("value", "events", "10", "min(value)", "max(value)", "0.01", False, "event_type = 'purchase'"))
def range_hist_filtered(s, d):
    return rounded(histograms.range_bins(df := events(s, d), "value", 10, where=Equals("event_type", "purchase").column(df), resolution=0.01))


@query(_int_hist_sql("p_size", "part", "10", "min(p_size)", "max(p_size)", False, "p_brand = 'Brand#12'", ', CAST(mn AS BIGINT) AS "binStatsMin", CAST(mx AS BIGINT) AS "binStatsMax", round(mean, 6) AS "binStatsMean", round(sd, 6) AS "binStatsStdev"'))
def range_hist_stats(s, d):
    return rounded(histograms.range_bins(df := part(s, d), "p_size", 10, stats=True, where=Equals("p_brand", "Brand#12").column(df)))


# bars
def _olhc_sql(size: int, where: str = "TRUE") -> str:
    return f"""WITH x AS (SELECT event_id, value AS v, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE {where})
    SELECT CAST((k - 1) // {size} AS BIGINT) AS "binNumber", CAST(max(k) AS VARCHAR) AS name, round(min(v), 6) AS "binMin", round(max(v), 6) AS "binMax", count(*) AS "binCount",
      round(arg_min(v, event_id), 3) AS "binOpen", round(arg_max(v, event_id), 3) AS "binClose", round(avg(v), 6) AS "binMean", round(stddev_pop(v), 6) AS "binStdev",
      round(sum(v), 4) AS sum, round(sum(v * v), 3) AS "sumSquares" FROM x GROUP BY (k - 1) // {size}"""


def _olhc(df: DataFrame) -> DataFrame:
    digits = {"binOpen": 3, "binClose": 3, "sum": 4, "sumSquares": 3}
    return df.select(*[F.round(F.col(n).cast("double"), digits.get(n, 6)).alias(n) if t in ("double", "float") else n for n, t in df.dtypes])


@query(_olhc_sql(100))
def olhc_running(s, d):
    return _olhc(bars.running_bars(events(s, d), "value", "event_id", 100))


@query(_olhc_sql(75, "event_type = 'purchase'"))
def olhc_filtered(s, d):
    return _olhc(bars.running_bars(df := events(s, d), "value", "event_id", 75, Equals("event_type", "purchase").column(df)))


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY rid) AS k FROM olhc_bars)
  SELECT CAST((k - 1) // 50 AS BIGINT) AS "binNumber", CAST(max(k) AS VARCHAR) AS name, CAST(min("binMin") AS FLOAT) AS "binMin", CAST(max("binMax") AS FLOAT) AS "binMax", count(*) AS "binCount",
    arg_min_null("binOpen", rid) AS "binOpen", arg_max_null("binClose", rid) AS "binClose" FROM x GROUP BY (k - 1) // 50""")
def olhc_rebin(s, d):
    return bars.rebin_bars(table(s, d, "olhc_bars"), "rid", 50)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_day, "second", rid) AS k FROM rebarred_quotes)
  SELECT symbol, CAST(-1 AS BIGINT) AS bar, "openingPrice" AS "binOpen", "openingPrice" AS "binMin", "openingPrice" AS "binMax", "openingPrice" AS "binClose", CAST(0 AS BIGINT) AS "binVolume", 0 AS "second" FROM symbols
  UNION ALL
  SELECT symbol, (k - 1) // 10, arg_min_null("binOpen", k), min("binMin"), max("binMax"), arg_max_null("binClose", k), CAST(coalesce(sum(CAST("binVolume" AS BIGINT)), 0) AS BIGINT), max("second")
  FROM k GROUP BY symbol, (k - 1) // 10""")
def ohlcv_by_symbol(s, d):
    return bars.rebar_symbols(table(s, d, "rebarred_quotes"), ["trade_day", "second", "rid"], 10, table(s, d, "symbols"))


# factors
_CODES = "(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer))"


@query(f"SELECT v AS value, code FROM {_CODES}")
def factor_codes(s, d):
    return factors.factor(table(s, d, "customer"), "c_mktsegment")


@query(f"SELECT c_custkey, code FROM customer JOIN {_CODES} ON v = c_mktsegment")
def factor_lookup(s, d):
    customers = table(s, d, "customer")
    return factors.encode(customers, "c_mktsegment", factors.factor(customers, "c_mktsegment"), "code").select("c_custkey", "code")


@query("""SELECT o_orderkey, o_orderstatus, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS INTEGER) AS code FROM orders""")
def factor_sort(s, d):
    codes = factors.factor_of(s, ["P", "O", "F"])
    return factors.sort_by(factors.encode(orders(s, d), "o_orderstatus", codes, "code"), "o_orderstatus", codes).select("o_orderkey", "o_orderstatus", "code")


# frames
@query("SELECT o_orderkey, o_totalprice, o_totalprice AS price2 FROM orders")
def cbind(s, d):
    o = orders(s, d).select("o_orderkey", "o_totalprice")
    return frame.cbind(o, "price2", o, "o_totalprice", "o_orderkey")


@query("SELECT * FROM events WHERE value >= 250")
def subset_frame(s, d):
    return frame.subset(df := events(s, d), Compare("value", ">=", 250.0, 0.0).column(df))


@query("SELECT c_name, c_nationkey FROM customer")
def project(s, d):
    return table(s, d, "customer").select("c_name", "c_nationkey")


@query("SELECT event_id, event_type FROM events WHERE event_id = 17")
def row_access(s, d):
    return frame.row_at(events(s, d), "event_id", 17, ["event_id", "event_type"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number FROM orders")
def id_column(s, d):
    return frame.id_column(orders(s, d).select("o_orderkey"), "row_number", "o_orderkey")


@query("""SELECT event_id, value FROM events
  UNION ALL SELECT o_orderkey + (SELECT max(event_id) + 1 FROM events), o_totalprice FROM orders""")
def append_union(s, d):
    return frame.append(events(s, d).select("event_id", "value"), orders(s, d).select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value")), "event_id")


@query("""SELECT p_partkey, p_size FROM part UNION ALL SELECT o_orderkey + (SELECT max(p_partkey) + 1 FROM part), CAST(trunc(o_totalprice) AS INTEGER) FROM orders""")
def append_downcast(s, d):
    return frame.append(part(s, d).select("p_partkey", "p_size"), orders(s, d).select(F.col("o_orderkey").alias("p_partkey"), F.col("o_totalprice").alias("p_size")), "p_partkey")


# builders, conversions, ranges
@query("SELECT CAST(range AS BIGINT) AS rid, CAST(range - 5 AS SMALLINT) AS v FROM range(0, 106)")
def counter_vector(s, d):
    return builders.counter(s, -5, 100, "SHORT")


@query("SELECT CAST(range AS BIGINT) AS rid, 'x' AS v FROM range(0, 1000)")
def constant_run(s, d):
    return builders.constant(s, "x", 1000)


@query("SELECT CAST(range AS BIGINT) AS rid, range * 1.5::DOUBLE AS v FROM range(0, 20)")
def built_vector(s, d):
    return builders.VectorBuilder(s, "DOUBLE").append([i * 1.5 for i in range(10)]).append([f"{i * 1.5:,}" for i in range(10, 20)]).seal()


@query("SELECT o_orderkey, CAST(o_custkey * 1000 AS BIGINT) AS parsed FROM orders")
def text_parse(s, d):
    written = F.format_number(F.col("o_custkey") * 1000, 0)
    return orders(s, d).select("o_orderkey", schema.parse_long(written).alias("parsed"))


@query("SELECT l_orderkey, CAST(l_returnflag = 'R' AS INTEGER) AS number FROM lineitem")
def logical_to_number(s, d):
    return flagged(s, d).select("l_orderkey", schema.logical_to_number(F.col("returned")).alias("number"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS as_double, CAST(p_size AS SMALLINT) AS as_short, CAST(p_size AS VARCHAR) AS as_string FROM part")
def typed_conversion(s, d):
    v = F.col("p_size")
    return part(s, d).select("p_partkey", schema.convert(v, "DOUBLE").alias("as_double"), schema.convert(v, "SHORT").alias("as_short"), schema.convert(v, "STRING").alias("as_string"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 35 THEN 2 ELSE 3 END AS INTEGER) AS tile FROM part")
def range_tiles(s, d):
    return part(s, d).select("p_partkey", predicates.tile_number(F.col("p_size"), predicates.tile([10, 20, 35], tails=True)).alias("tile"))


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def range_unbounded(s, d):
    return frame.subset(df := part(s, d), Range(40, None, False, False).on("p_size").column(df)).select("p_partkey")


# workspace and sinks
@query("SELECT n_nationkey, n_name FROM nation")
def namespace_roundtrip(s, d):
    """Assigned to the temporary tier, moved to the persistent one, read again after the workspace was reopened."""
    folder = scratch(s, "space")
    with Workspace(s, folder) as space:
        kept = space.assign("nations", table(s, d, "nation").select("n_nationkey", "n_name"))
        space.assign("persistent.nations", kept)
    with Workspace(s, folder, read_only=True) as space:
        return space.get("persistent.nations")


@query("SELECT p_partkey, p_name FROM part")
def csv_export_roundtrip(s, d):
    folder = scratch(s, "csv")
    export.export_frame(part(s, d).select("p_partkey", "p_name"), f"{folder}/part.csv")
    read = s.read.schema("p_name string, p_partkey long").option("escape", '"').csv(f"{folder}/part.csv/part-*")
    return read.select("p_partkey", "p_name")


@query(_describe_sql("l_discount", "lineitem", "(l_discount > 0.05::DOUBLE OR abs(l_discount - 0.05::DOUBLE) <= 0.001::DOUBLE) AND l_discount < 0.07::DOUBLE AND l_linenumber BETWEEN 1 AND 3"))
def filtered_stats(s, d):
    df = lineitem(s, d)
    terms = [Between("l_discount", 0.05, 0.07, resolution=R), Between("l_linenumber", 1, 3)]
    return rounded(stats.describe(df, "l_discount", reduce(lambda a, b: a & b, [t.column(df) for t in terms])), 4)


@query('SELECT rid, "binNumber", name, "binMin", "binMax", "binCount", "binOpen", "binClose", "binMean", "binStdev", sum, "sumSquares" FROM olhc_bars')
def bars_checked(s, d):
    return bars.as_bars(table(s, d, "olhc_bars"), "rid")


@query("SELECT CAST(i AS BIGINT) AS rid, CAST(i * 60 AS INTEGER) AS \"second\", 'X' AS symbol, i::FLOAT AS \"binOpen\", i::FLOAT AS \"binMin\", (i + 1)::FLOAT AS \"binMax\", (i + 1)::FLOAT AS \"binClose\", CAST(100 * i AS BIGINT) AS \"binVolume\" FROM range(0, 50) AS r(i)")
def bar_frame(s, d):
    n = range(50)
    return bars.bar_frame(s, [60 * i for i in n], ["X"] * 50, n, n, [i + 1 for i in n], [i + 1 for i in n], [100 * i for i in n])


@query("WITH x AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events) SELECT avg(v) AS p85 FROM x WHERE k = CAST(floor(n * 17 / 20.0::DOUBLE - 1 + 0.5) AS BIGINT)")
def percentile_lookup(s, d):
    return stats.percentile(stats.quantiles(events(s, d), "value"), 85)


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid FROM customer")
def factor_valid(s, d):
    codes = factors.factor_of(s, ["BUILDING", "MACHINERY"])
    return factors.is_valid(table(s, d, "customer"), "c_mktsegment", codes).select("c_custkey", "valid")


@query("SELECT n_name FROM nation")
def column_at(s, d):
    return frame.column_at(table(s, d, "nation").select("n_nationkey", "n_name"), 1)


@query("""WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id NULLS LAST, value NULLS LAST) AS k FROM events),
  x AS (SELECT *, lag(event_id) OVER (ORDER BY k) AS before FROM r)
  SELECT count(*) AS n_rows, count(event_id) AS n_ids, count(*) FILTER (WHERE event_id < before) AS descents,
    first(event_id ORDER BY k) AS first_id, last(event_id ORDER BY k) AS last_id, first(value ORDER BY k) AS first_value, last(value ORDER BY k) AS last_value,
    CAST(coalesce(sum((k % 1009) * (event_id % 1000003)), 0) AS BIGINT) AS id_sum,
    CAST(coalesce(sum((k % 1009) * CASE WHEN isfinite(value) THEN CAST(floor(value * 100) AS BIGINT) END), 0) AS BIGINT) AS value_sum FROM x""")
def row_iteration(s, d):
    """Every row read in order through the iterator, with the ids that it gives: counts, descents, ends, and sums weighted by the position."""
    return s.createDataFrame([iterated(builders.rows(events(s, d), [F.col("event_id").asc_nulls_last(), F.col("value").asc_nulls_last()], ["event_id", "value"]))], _ITERATED)


_ITERATED = "n_rows long, n_ids long, descents long, first_id long, last_id long, first_value double, last_value double, id_sum long, value_sum long"


def iterated(rows) -> tuple:
    """What the iterated rows (event_id, value) come to, one row held at a time."""
    n = ids = descents = id_sum = value_sum = 0
    first, last = (None, None), (None, None)
    for n, (i, v) in enumerate(rows, 1):
        first = (i, v) if n == 1 else first
        if i is not None:
            ids += 1
            descents += last[0] is not None and i < last[0]
            id_sum += n % 1009 * int(math.fmod(i, 1000003))
        if v is not None and math.isfinite(v):
            value_sum += n % 1009 * math.floor(v * 100)
        last = (i, v)
    return n, ids, descents, first[0], last[0], first[1], last[1], id_sum, value_sum


@query("SELECT p_name FROM part")
def csv_vector_roundtrip(s, d):
    folder = scratch(s, "csv")
    export.export_vector(part(s, d).select("p_name"), "p_name", f"{folder}/names.csv")
    return s.read.schema("p_name string").option("escape", '"').csv(f"{folder}/names.csv")


@query("""SELECT 'customers.dataFrame.csv' AS file, CONCAT(c_custkey, ',', coalesce('"' || replace(c_name, '"', '""') || '"', ''), ',', c_nationkey) AS line FROM customer
  UNION ALL SELECT 'names.vector.csv', coalesce('"' || replace(c_name, '"', '""') || '"', '') FROM customer UNION ALL SELECT 'scalars.csv', '"one",1'""")
def namespace_csv(s, d):
    """Every line of the exported files, without the frame's header and notes."""
    folder = scratch(s, "csv")
    with Workspace(s, f"{folder}/space") as space:
        customers = table(s, d, "customer")
        space.spaces["temp"].assign_all({"customers": customers.select("c_custkey", "c_name", "c_nationkey"), "names": customers.select(F.col("c_custkey").alias("rid"), "c_name"), "one": builders.scalar(s, 1)})
        written = export.export_namespace(space.spaces["temp"], f"{folder}/out")
    lines = [s.read.text(f"{folder}/out/{w}" + ("" if w == "scalars.csv" else "/part-*")).select(F.lit(w).alias("file"), F.col("value").alias("line")) for w in written]
    return reduce(DataFrame.unionByName, lines)


@query("SELECT 'nations: frame' AS line, CAST(0 AS BIGINT) AS samples UNION ALL " + " UNION ALL ".join(f"SELECT CONCAT('  {c} {t}, ', count(*), ' rows, ', min({c}), ' to ', max({c})), least(count(*), 10) FROM nation" for c, t in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))))
def store_report(s, d):
    """The report's line on each column, with the number of its samples."""
    folder = scratch(s, "space")
    with Workspace(s, folder) as space:
        space.assign("persistent.nations", table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
        lines = space.report().splitlines()
    parts = [line.partition(": ") if "rows" in line else (line, "", "") for line in lines]
    return s.createDataFrame([(a, len(b.split(", ")) if b else 0) for a, _, b in parts], "line string, samples long")


# operators that one value or one verdict shows
@query("SELECT CAST(i AS BIGINT) AS rid, CAST(i * 3 AS INTEGER) AS v FROM range(0, 40) AS r(i)")
def array_vector(s, d):
    return builders.vector(s, np.arange(40) * 3, "INTEGER")


@query("SELECT CAST(i AS BIGINT) AS rid, i * 0.5::DOUBLE AS v FROM range(0, 40) AS r(i)")
def numeric_vector(s, d):
    """A list of numbers is a vector of its first one's type."""
    return builders.vector(s, [i * 0.5 for i in range(40)])


@query("SELECT count(*) AS n, sum(CAST(n_nationkey AS DOUBLE)) AS total, count(DISTINCT n_nationkey) AS different FROM nation")
def values_as_list(s, d):
    """A whole column on the driver, which the caller knows to fit: of a small table."""
    listed, doubles = builders.values(table(s, d, "nation"), "n_nationkey", "n_nationkey"), builders.as_doubles(table(s, d, "nation"), "n_nationkey", "n_nationkey")
    return s.createDataFrame([(len(listed), float(doubles.sum()), len(set(listed)))], "n long, total double, different long")


@query("SELECT count(*) AS n FROM orders")
def rows_acted_on(s, d):
    """An action on the executors, for each row of every partition."""
    seen = s.sparkContext.accumulator(0)

    def count(rows):
        for _ in rows:
            seen.add(1)

    builders.for_each(orders(s, d), count)
    return s.createDataFrame([(seen.value,)], "n long")


@query("SELECT 'p_partkey' AS row_id, 'p_name' AS labels, 'p_size' AS sorted, true AS estimated")
def frame_notes(s, d):
    df = frame.set_row_id(schema.annotate(schema.annotate(part(s, d), "p_name", label=True), "p_size", sorted=True), "p_partkey")
    return s.createDataFrame([(frame.row_id(df), ",".join(frame.labels(df)), ",".join(frame.sorted_columns(df)), frame.estimated_bytes(df) > 0)], "row_id string, labels string, sorted string, estimated boolean")


@query("SELECT c_custkey, 'c_mktsegment factor' AS factor FROM customer")
def factor_mark(s, d):
    customers = table(s, d, "customer")
    marked = factors.encode(customers, "c_mktsegment", factors.factor(customers, "c_mktsegment"), "code")
    return marked.select("c_custkey", F.lit(schema.metadata(marked, "c_mktsegment")["factor"]).alias("factor"))


@query(f"SELECT c_custkey, c_mktsegment AS segment FROM customer JOIN {_CODES} ON v = c_mktsegment")
def factor_decode(s, d):
    customers = table(s, d, "customer")
    codes = factors.factor(customers, "c_mktsegment")
    return factors.decode(factors.encode(customers, "c_mktsegment", codes, "code"), "code", codes, "segment").select("c_custkey", "segment")


@query("SELECT CASE v WHEN 'BUILDING' THEN 'HOUSES' ELSE v END AS value, code FROM " + _CODES)
def factor_renamed(s, d):
    return factors.clone_and_rename(factors.factor(table(s, d, "customer"), "c_mktsegment"), {"BUILDING": "HOUSES"})


@query("SELECT true AS within")
def quantiles_estimated(s, d):
    """Whether all 21 estimated percentiles lie within a hundredth of the ranks of the exact ones."""
    df = events(s, d)
    estimated, n = stats.approximate_quantiles(df, "value").first(), df.count()
    ranks = df.agg(*[F.count_if(F.col("value") < estimated[f"p{p}"]).alias(f"a{p}") for p in stats.PERCENTILES], *[F.count_if(F.col("value") <= estimated[f"p{p}"]).alias(f"z{p}") for p in stats.PERCENTILES]).first()
    within = all(ranks[f"a{p}"] - 0.01 * n <= p / 100 * n <= ranks[f"z{p}"] + 0.01 * n + 1 for p in stats.PERCENTILES)
    return s.createDataFrame([(within,)], "within boolean")


@query("SELECT p_partkey, p_size = 15 AS same FROM part")
def equal_as_long(s, d):
    return (df := part(s, d)).select("p_partkey", schema.equals_as_long(df, "p_size", 15.7).alias("same"))


@query(f"""WITH x AS (SELECT event_id, value AS v, row_number() OVER (ORDER BY event_id) AS k FROM events)
  SELECT (k - 1) // 100 AS "binNumber", CAST(max(k) AS VARCHAR) AS name, round(min(v), 6) AS "binMin", round(max(v), 6) AS "binMax", count(*) AS "binCount", round(avg(v), 6) AS "binMean" FROM x GROUP BY (k - 1) // 100""")
def olhc_summaries(s, d):
    return rounded(bars.running_bars(events(s, d), "value", "event_id", 100, summaries=("binMean",)))


@query("SELECT p_partkey, p_size BETWEEN 10 AND 20 AS whole, p_retailprice >= 1000 AND p_retailprice < 1200 AS real FROM part")
def made_ranges(s, d):
    whole, real = predicates.make_range(10, 20), predicates.make_range(1000.0, 1200.0)
    return part(s, d).select("p_partkey", whole.contains(F.col("p_size")).alias("whole"), real.contains(F.col("p_retailprice")).alias("real"))


@query("SELECT * FROM (VALUES ('range of text'), ('range of booleans'), ('range downwards'), ('membership of reals'), ('membership of booleans'), ('comparison of text'), ('too many values'), ('other rows bound'), ('short name')) AS t(rejected)")
def rejections(s, d):
    """The cases that raise, of those that must."""
    df, lines = part(s, d), flagged(s, d)
    cases = {
        "range of text": lambda: Between("p_name", "a", "b").column(df),
        "range of booleans": lambda: Between("returned", 0, 1).column(lines),
        "range downwards": lambda: Between("p_size", 20, 10).column(df),
        "membership of reals": lambda: In("p_retailprice", [1.0]).column(df),
        "membership of booleans": lambda: In("returned", [True]).column(lines),
        "comparison of text": lambda: Compare("p_name", "<", "b").column(df),
        "too many values": lambda: stats.sorted_unique(df, "p_partkey", most=5),
        "other rows bound": lambda: frame.cbind(df.select("p_partkey"), "w", df.select((F.col("p_partkey") + 1).alias("p_partkey"), "p_size"), "p_size", "p_partkey").collect(),
        "short name": lambda: schema.check_name("x"),
    }
    raised = []
    for name, case in cases.items():
        try:
            case()
        except Exception:
            raised.append((name,))
    return s.createDataFrame(raised, "rejected string")


@query("SELECT * FROM (VALUES ('anonymous name', '__Frame_1'), ('copied rows', '25'), ('deleted', 'True'), ('garbage', 'persistent/lost'), ('other workspace', 'refused'), ('second writer', 'refused'), ('used when closed', 'refused'), ('wiped', '0')) AS t(case_, result)")
def workspace_rules(s, d):
    nations, out = table(s, d, "nation"), {}

    def refused(action) -> str:
        try:
            action()
        except Exception:
            return "refused"
        return "allowed"

    here, there = scratch(s, "space"), scratch(s, "space")
    with Workspace(s, here) as a, Workspace(s, there) as b:
        out["anonymous name"] = a.spaces["temp"].add(nations)
        kept = a.assign("persistent.nations", nations)
        out["other workspace"] = refused(lambda: b.assign("nations", kept))
        out["copied rows"] = str(a.copy_to("persistent.nations", b).count())
        out["second writer"] = refused(lambda: Workspace(s, here))
        nations.write.parquet(f"{here}/persistent/lost")
        out["garbage"] = ",".join(a.collect_garbage())
        a.wipe()
        out["wiped"] = str(sum(len(a.spaces[t].names()) for t in a.spaces))
    out["used when closed"] = refused(lambda: a.get("persistent.nations"))
    Workspace(s, here).delete()
    out["deleted"] = str(not Files(s).exists(here))
    return s.createDataFrame(sorted(out.items()), "case_ string, result string")
