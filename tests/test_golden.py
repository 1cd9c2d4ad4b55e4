"""Expected results of the columnar operators on small arrays."""

import pytest
from pyspark.sql import functions as F

from colonnade import schema
from colonnade.operators import bars, factors, frame, histograms, predicates, stats
from colonnade.operators.predicates import Between, Compare, Equals, Flag, In, Range, make_range, tile
from colonnade.sources import builders

TOP = [*range(1, 10), *range(1, 6), *range(10, 17), *range(12, 17), 2, 3, 4]
MIX = [*range(1, 6), *range(10, 17), *range(1, 10), *range(12, 17), 2, 3, 4]
SHORT = [1, 2, 3, 4, 5, 2, 3, 4]
WIDE43 = [*range(1, 6), *range(10, 17), 41, 42, 43, *range(4, 10), *range(12, 17), 2, 3, 4]
WIDE45 = [*range(1, 6), *range(10, 17), 41, 42, 43, 4, 45, 6, 7, 8, 9, *range(12, 17), 2, 3, 4]
FOUR = [1, 2, 3, 4]
SELMIX = [*range(1, 6), 5, 5, 5, 5, *range(10, 17), 15, 15, 15, 15, *range(1, 10), *range(12, 17), 7, 7, 7, 7, 2, 3, 4]
SELECTED = [1] * 5 + [0] * 4 + [1] * 7 + [0] * 4 + [1] * 9 + [1] * 5 + [0] * 4 + [1] * 3
OLHC50 = [float(i) for i in list(range(7)) * 7 + [10]]
OLHCSEL = [1, 4, 6, 9, 11, 14, 16, 17, 21, 23, 27, 31, 32, 33, 36, 37, 39, 41, 43, 45]


@pytest.fixture(scope="module")
def make(spark):
    def build(values, kind="DOUBLE", **more):
        return builders.vector(spark, values, kind, **more)

    return build


def column(df, name, order="binNumber"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_predicates(make):
    d = make([float(i) for i in range(1, 33)])
    n = make(list(range(1, 33)), "LONG")
    s = make([f"{i:02d}" for i in range(1, 33)], "STRING")
    hits = lambda df, p: sorted(r["v"] for r in frame.subset(df, p.column(df)).collect())
    assert hits(d, Between("v", 19, 23)) == [19, 20, 21, 22]
    odd = make([*[float(i) for i in range(1, 33)], 18.9999999999], resolution=0.01)
    assert hits(odd, Between("v", 19, 23)) == [18.9999999999, 19, 20, 21, 22]
    assert hits(n, In("v", [2, 3, 5, 13, 9])) == [2, 3, 5, 9, 13]
    assert hits(s, In("v", ["2", "3", "5", "13", "9"])) == ["13"]
    for op, count in ((">", 1), (">=", 2), ("<", 2), ("<=", 3)):
        assert len(hits(d, Compare("v", op, 31.0 if ">" in op else 3.0, 0.001))) == count
    flags = make([i % 2 == 0 for i in range(32)], "BOOLEAN")
    assert len(hits(flags, Equals("v", "yes"))) == len(hits(flags, Flag("v"))) == 16
    assert len(hits(flags, ~Flag("v"))) == 16
    both = d.withColumnRenamed("v", "doubleColumn").join(n.withColumnRenamed("v", "longColumn"), "rid")
    term = Between("doubleColumn", 19, 23) & Between("longColumn", 18, 20)
    assert term.text(both) == "doubleColumn in [19.00..23.00) AND longColumn in [18..20]"
    assert frame.subset(both, term.column(both)).count() == 2


def test_predicates_reject_what_has_no_meaning(make):
    d, s = make([1.0]), make(["a"], "STRING")
    for bad, df in ((Between("v", "a", "b"), s), (In("v", [1.0]), d), (Compare("v", "<", "a"), s), (Compare("v", "!", 1), d), (Flag("v"), d)):
        with pytest.raises((TypeError, ValueError)):
            bad.column(df)
    with pytest.raises(ValueError):
        Between("v", 3, 2).column(d)


def test_nulls_and_nan_match_nothing_and_not_is_total(make):
    d = make([1.0, None, float("nan"), 5.0])
    for p in (Equals("v", 1.0), Between("v", 0, 9), Compare("v", ">", 0.0), Compare("v", "<=", 9.0)):
        yes, no = p.column(d), (~p).column(d)
        assert d.filter(yes).count() + d.filter(no).count() == 4
        assert d.filter(yes).filter(F.col("v").isNull() | F.isnan("v")).count() == 0
    assert predicates.select(d).count() == 0


def test_predicates_reach_the_scan(spark, make, tmp_path):
    make([float(i) for i in range(32)]).withColumn("n", F.col("rid").cast("int")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for p, pushed in ((Between("v", 3, 5, resolution=0.1), "GreaterThanOrEqual(v"), (Equals("v", 3, 0.1), "LessThanOrEqual(v"), (Between("n", 3, 5), "GreaterThanOrEqual(n,3)"), (In("n", [1, 2]), "In(n"), (Equals("n", 1) | Compare("n", "<", 3), "Or(")):
        plan = frame.subset(df, p.column(df)).select("rid")._jdf.queryExecution().explainString(mode)
        assert pushed in plan.split("PushedFilters")[1].split("\n")[0], plan


def test_ranges_and_tiles(spark, make):
    assert make_range(1, 2) == Range(1, 2, True, True) and make_range(1.0, 2.0).right_closed is False
    assert [t.right_closed for t in tile([1, 5, 9])] == [False, True]
    assert len(tile([1, 5], tails=True)) == 3 and tile([1]) == []
    with pytest.raises(ValueError):
        tile([2, 1])
    n = make([0, 1, 4, 5, 9, 10, None], "INTEGER")
    assert [r[0] for r in n.orderBy("rid").select(predicates.tile_number(F.col("v"), tile([1, 5, 9]))).collect()] == [None, 0, 0, 1, 1, None, None]


@pytest.mark.parametrize("kind", ["DOUBLE", "FLOAT", "INTEGER"])
def test_top_and_bottom(make, kind):
    top = histograms.top_values(make(TOP, kind), "v", 12, True, "rid")
    assert column(top, "binCount") == [2, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and column(top, "binMin") == list(range(5, 17))
    low = histograms.top_values(make(MIX, kind), "v", 12, False, "rid")
    assert column(low, "binCount") == [2, 3, 3, 3, 2, 1, 1, 1, 1, 1, 1, 2]
    assert column(histograms.top_values(make(SHORT, kind), "v", 12, True, "rid"), "binCount") == [1, 2, 2, 2, 1]


def test_top_text_and_limits(make):
    t = histograms.top_values(make([str(i) for i in TOP], "STRING"), "v", 12)
    assert column(t, "name") == "13 14 15 16 2 3 4 5 6 7 8 9".split() and column(t, "binCount") == [2, 2, 2, 2, 3, 3, 3, 2, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        histograms.top_values(make(TOP), "v", 10_001)
    with pytest.raises(TypeError):
        histograms.top_values(make([True], "BOOLEAN"), "v", 1)


@pytest.mark.parametrize("kind", ["DOUBLE", "INTEGER"])
def test_unique(make, kind):
    df = make(SELMIX, kind).withColumn("on", F.element_at(F.array(*[F.lit(bool(x)) for x in SELECTED]), (F.col("rid") + 1).cast("int")))
    expected = [2, 3, 3, 3, 2, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert column(histograms.unique_values(make(MIX, kind), "v"), "binCount") == expected
    assert column(histograms.unique_values(df, "v", where=F.col("on")), "binCount") == expected


@pytest.mark.parametrize(
    "values, kind, k, low, high, counts",
    [
        (MIX, "DOUBLE", None, None, None, [2, 3, 3, 0, 3, 2, 0, 1, 1, 1, 0, 1, 1, 0, 1, 2, 2, 0, 2, 2, 2]),
        (MIX, "DOUBLE", 10, 2.0, 8.0, [3, 3, 0, 3, 0, 2, 1, 0, 1, 1]),
        (MIX, "DOUBLE", 10, None, None, [5, 3, 5, 1, 2, 1, 2, 2, 4, 4]),
        (FOUR, "DOUBLE", None, None, None, [1, 1, 0, 1, 1]),
        (MIX, "INTEGER", None, None, None, [2, 3, 3, 3, 2, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2]),
        (WIDE43, "INTEGER", None, None, None, [3, 5, 3, 2, 2, 3, 4, 4, *[0] * 12, 3]),
        (MIX, "INTEGER", 10, 2, 8, [3, 3, 3, 2, 1, 1, 1]),
        (WIDE45, "INTEGER", 10, 2, 80, [12, 11, 2, 0, 0, 3, 1, 0, 0, 0]),
        (MIX, "INTEGER", 5, None, None, [8, 6, 3, 4, 8]),
        (FOUR, "INTEGER", None, None, None, [1, 1, 1, 1]),
    ],
)
def test_range_histograms(make, values, kind, k, low, high, counts):
    assert column(histograms.range_bins(make(values, kind), "v", k, low, high), "binCount") == counts


def test_range_histogram_names_stats_and_empty(make):
    assert column(histograms.range_bins(make(MIX, "INTEGER"), "v", 5), "name") == ["1-3", "4-6", "7-9", "10-12", "13-16"]
    assert column(histograms.range_bins(make(WIDE45, "INTEGER"), "v", 10, 2, 80), "name")[::9] == ["2-8", "65-80"]
    df = make(SELMIX, "LONG").withColumn("on", F.element_at(F.array(*[F.lit(bool(x)) for x in SELECTED]), (F.col("rid") + 1).cast("int")))
    h = histograms.range_bins(df, "v", 10, stats=True, where=F.col("on"))
    assert column(h, "binCount") == [2, 3, 3, 3, 2, 1, 1, 1, 1, 12]
    assert column(h, "binStatsMean")[-1] == pytest.approx(13.4166666) and column(h, "binStatsStdev")[-1] == pytest.approx(1.8465433)
    assert column(h, "name") == [*map(str, range(1, 10)), "10-16"]
    empty = histograms.range_bins(df, "v", 10, where=F.lit(False))
    assert empty.count() == 0 and empty.columns[:5] == ["binNumber", "name", "binMin", "binMax", "binCount"]
    with pytest.raises(ValueError):
        histograms.range_bins(make([2.0, 2.0]), "v")


def test_running_bars(make):
    df = make(OLHC50, "FLOAT")
    h = bars.running_bars(df, "v", "rid", 10)
    assert column(h, "name") == ["10", "20", "30", "40", "50"] and column(h, "binCount") == [10] * 5
    assert column(h, "binMin") == [0] * 5 and column(h, "binMax") == [6, 6, 6, 6, 10]
    assert column(h, "binOpen") == [0, 3, 6, 2, 5] and column(h, "binClose") == [2, 5, 1, 4, 10]
    assert column(h, "binMean") == pytest.approx([2.4, 3.3, 2.8, 3.0, 4.2])
    assert column(h, "binStdev") == pytest.approx([1.95959, 1.79165, 2.22711, 1.73205, 2.74955], abs=1e-5)
    sel = bars.running_bars(df, "v", "rid", 10, F.col("rid").isin(OLHCSEL), ("binOpen", "binClose", "binMean"))
    assert column(sel, "binOpen") == [1, 6] and column(sel, "binClose") == [2, 3] and column(sel, "binMean") == pytest.approx([2.4, 3.5])
    assert "binStdev" not in sel.columns
    with pytest.raises(ValueError):
        bars.running_bars(df, "v", "rid", 0)


def test_rebar_symbols(spark):
    df = bars.bar_frame(spark, [10, 20, 30, 5], ["A", "A", "A", "B"], [1.0, 2, 3, 9], [0.5, 1, 2, 8], [2.0, 3, 4, 9], [1.5, 2.5, 3.5, 8.5], [100, 200, 300, 7])
    openings = spark.createDataFrame([("A", 1.25), ("B", None), ("C", 4.0)], "symbol string, openingPrice float")
    rows = bars.rebar_symbols(df, ["second", "rid"], 2, openings).orderBy("symbol", "bar").collect()
    assert [tuple(r) for r in rows] == [
        ("A", -1, 1.25, 1.25, 1.25, 1.25, 0, 0),
        ("A", 0, 1.0, 0.5, 3.0, 2.5, 300, 20),
        ("A", 1, 3.0, 2.0, 4.0, 3.5, 300, 30),
        ("B", -1, None, None, None, None, 0, 0),
        ("B", 0, 9.0, 8.0, 9.0, 8.5, 7, 5),
        ("C", -1, 4.0, 4.0, 4.0, 4.0, 0, 0),
    ]


def test_statistics(make):
    row = stats.describe(make(list(range(1, 23)), "LONG"), "v").first()
    assert (row["sum"], row["mean"], row["variance"]) == (253, 11.5, 40.25) and row["stdev"] == pytest.approx(6.34428877)
    assert stats.describe(make([1]), "v").first()["momentOverflow"] is False
    empty = stats.describe(make([], "LONG"), "v").first()
    assert empty["count"] == 0 and empty["min"] is None
    assert stats.true_stats(make([True, True, False, False], "BOOLEAN"), "v").first()["trueRatio"] == 0.5
    with pytest.raises(Exception, match="no ratio"):
        stats.true_stats(make([], "BOOLEAN"), "v").collect()


@pytest.mark.parametrize("n, expected", [(5, {0: 1, 50: 3, 100: 5}), (15, {0: 1, 25: 4, 50: 8, 75: 12, 100: 15}), (150, {0: 1, 5: 8, 25: 38, 50: 75, 75: 113, 95: 143, 100: 150})])
def test_quantiles(make, n, expected):
    row = stats.quantiles(make([float(i) for i in range(1, n + 1)], "FLOAT"), "v").first()
    assert {p: row[f"p{p}"] for p in expected} == expected
    if n < 21:
        assert all(row[f"p{p}"] is None for p in range(0, 101, 5) if p not in expected)


def test_distinct(make):
    assert [r[0] for r in stats.sorted_unique(make(["2", "1", "11", "1", "2"], "STRING"), "v").collect()] == ["1", "11", "2"]
    near = make([i + 0.5 + j / 1000 for i in range(1, 11) for j in range(10)])
    assert stats.sorted_unique(near, "v", resolution=0.1).count() == 10
    assert stats.count_unique(near, "v", resolution=0.1).first()[0] == 10
    with pytest.raises(ValueError):
        stats.sorted_unique(near, "v", resolution=0.0, most=5)
    assert stats.has_more_than_one(make([1.0, 1.0]), "v").first()[0] is False
    assert stats.auto_resolution(make([1.0, 1.0]), "v") == 0.0 and stats.auto_resolution(make([], "DOUBLE"), "v") is None
    assert stats.auto_resolution(make([1.0, 16.0]), "v") == pytest.approx(0.001)


def test_factors(spark, make):
    codes = factors.factor_of(spark, ["low", "mid", "high"])
    df = make(["high", "low", "none", None], "STRING")
    assert [r["code"] for r in factors.encode(df, "v", codes, "code").orderBy("rid").collect()] == [2, 0, None, None]
    assert [r["v"] for r in factors.sort_by(df, "v", codes).collect()][:2] == ["low", "high"]
    assert [tuple(r) for r in factors.factor(make(["b", "a", "b"], "STRING"), "v").orderBy("code").collect()] == [("a", 0), ("b", 1)]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            factors.factor_of(spark, bad)


def test_frames(make):
    a, b = make([1.0, 2.0]), make([3.0, 4.0])
    assert [tuple(r) for r in frame.cbind(a, "w", b, "v", "rid").orderBy("rid").collect()] == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    with pytest.raises(ValueError):
        frame.cbind(a, "v", b, "v", "rid")
    with pytest.raises(ValueError):
        frame.cbind(a, "w", make([1.0]), "v", "rid")
    assert [r["v"] for r in frame.append(make(["1"], "STRING"), make(["6", "7"], "STRING"), "rid").orderBy("rid").collect()] == ["1", "6", "7"]
    numbered = frame.id_column(make([5.0, 3.0, 9.0]), "n", "v")
    assert {(r["v"], r["n"]) for r in numbered.collect()} == {(3.0, 0), (5.0, 1), (9.0, 2)} and frame.row_id(numbered) == "n"


def test_coercion(spark):
    assert schema.coerce("1,234", "LONG") == 1234 and schema.coerce("1,234.5", "DOUBLE") == 1234.5 and schema.coerce(2.5, "INTEGER") == 3
    assert schema.coerce(7, "STRING") == "7" and schema.coerce(1, "BOOLEAN") is True and schema.coerce("n", "BOOLEAN") is False
    for value, kind in (("x", "LONG"), (True, "LONG"), (1.5, "STRING"), ("maybe", "BOOLEAN"), (None, "LONG")):
        with pytest.raises((TypeError, ValueError)):
            schema.coerce(value, kind)
    with pytest.raises(ValueError):
        builders.vector(spark, [])
    b = builders.VectorBuilder(spark, "LONG").append([1, 2]).append(5, times=3)
    assert [r["v"] for r in b.seal().orderBy("rid").collect()] == [1, 2, 5, 5, 5]
    with pytest.raises(RuntimeError):
        b.append(1)
