"""Binding by row number, wide counts, quantiles of repeated values, and other operators of frames at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from colonnade.operators import bars, frame, histograms, stats


def vector(spark, ids, name="v"):
    return spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], f"rid long, {name} double")


def test_binding_by_row_number(spark):
    bound = frame.cbind(vector(spark, [2, 0, 1]).repartition(3), "w", vector(spark, [0, 1, 2]), "v", "rid").orderBy("rid").collect()
    assert [tuple(r) for r in bound] == [(0, 1.0, 0.0), (1, 2.0, 1.0), (2, 0.0, 2.0)]
    assert frame.cbind(vector(spark, []), "w", vector(spark, []), "v", "rid").count() == 0
    nulls = spark.createDataFrame([(0, None), (1, 2.0)], "rid long, v double")
    assert [r["w"] for r in frame.cbind(nulls, "w", nulls, "v", "rid").orderBy("rid").collect()] == [None, 2.0]


@pytest.mark.parametrize("left, right", [([0, 1], [1, 2]), ([0, 1], [1, 1]), ([0, 0, 1], [0, 1]), ([0, 1], [0]), ([0], [0, 1]), ([0, None], [0, None])])
def test_rows_that_do_not_match_raise(spark, left, right):
    with pytest.raises(Exception, match="stands|bound"):
        frame.cbind(vector(spark, left), "w", vector(spark, right), "v", "rid").collect()


def test_more_bars_than_a_short_holds(spark):
    df = spark.range(40_000).select("id", F.col("id").cast("double").alias("v"))
    out = bars.running_bars(df, "v", "id", 1)
    assert out.agg(F.max("binNumber")).first()[0] == 39_999 and dict(out.dtypes)["binNumber"] == "bigint"
    small = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0) for i in range(3)], "rid long, binOpen double, binMin double, binMax double, binClose double")
    assert dict(bars.rebin_bars(small, "rid", 1).dtypes)["binCount"] == "bigint"


def test_counts_and_sums_are_wide(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"))
    assert dict(stats.describe(df, "v").dtypes)["count"] == "bigint"
    assert dict(histograms.range_bins(df, "v", 2).dtypes)["binCount"] == "bigint" == dict(histograms.unique_values(df, "id").dtypes)["binCount"]
    assert dict(frame.id_column(df, "n", "id").dtypes)["n"] == "bigint"
    quotes = spark.createDataFrame([("A", i, 1.0, 1.0, 1.0, 1.0, 2**31 - 1) for i in range(4)], "symbol string, second int, binOpen float, binMin float, binMax float, binClose float, binVolume int")
    rows = bars.rebar_symbols(quotes, ["second"], 10, spark.createDataFrame([("A", 1.0)], "symbol string, openingPrice double"))
    assert rows.filter("bar = 0").first()["binVolume"] == 4 * (2**31 - 1)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 20, 21, 333])
def test_quantiles_against_brute_force(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.5, 2.5, rng.uniform(-9, 9)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    row = stats.quantiles(df, "v").first()
    ordered = sorted(values)
    for p in stats.PERCENTILES:
        ranks = stats.quantile_ranks(n).get(p)
        assert row[f"p{p}"] == (pytest.approx(sum(ordered[r] for r in ranks) / len(ranks)) if ranks else None)
