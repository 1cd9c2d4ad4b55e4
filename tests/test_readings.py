"""Operators on readings against brute force, and on nulls, ties, repeated rows, empty tables, hot keys and clashing names."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators.balanced import heavy_keys, per_key_summary
from colonnade.operators.grid import missing_periods, regular_grid
from colonnade import runtime
from colonnade.operators.implausible import Limits, deviate_limit, esd_critical, implausible
from colonnade.operators.positions import ranked
from colonnade.runtime import join_dimension

BARS = "rid long, trade_day int, second int, symbol string, binOpen float, binClose float, binVolume long"


# positions
def test_ranks_of_one_group_over_many_tasks(spark):
    df = spark.range(5000).select(F.lit(0).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    assert ranked(df, ["g"], [("v", True)]).filter("position + v != 5000").count() == 0


# regular grid
def readings(spark, rows):
    return spark.createDataFrame(rows, "src string, day int, t int, v double, step int, rid long, period string")


def test_grid_of_levels(spark):
    rows = [("a", 1, 3, 10.0, 5, 0, "x"), ("a", 1, 4, 12.0, 5, 1, "x"), ("a", 1, 18, 26.0, 5, 2, "x"), ("a", 1, 18, 40.0, 5, 3, "x"), ("a", 2, 7, 1.0, 5, 4, "x")]
    rows += [("a", 1, None, 1.0, 5, 5, ""), (None, 1, 1, 1.0, 5, 6, ""), ("a", 1, 9, None, 5, 7, ""), ("a", 1, 9, float("nan"), 5, 8, ""), ("z", 1, 3, 1.0, 0, 9, ""), ("z", 1, 3, 1.0, None, 10, "")]
    g = regular_grid(readings(spark, rows), "src", "day", "t", "v", "step", "rid").orderBy("day", "period").collect()
    got = [(r["day"], r["period"], r["n_readings"], r["value"], r["covered"]) for r in g]
    assert got == [(1, 1, 2, 12.0, True), (1, 2, 0, 24.0, False), (1, 3, 0, 34.0, False), (1, 4, 2, 40.0, True), (2, 2, 1, 1.0, True)]
    assert sum(r["increment"] for r in g if r["day"] == 1) == pytest.approx(30.0)
    assert missing_periods(regular_grid(readings(spark, rows), "src", "day", "t", "v", "step", "rid")).count() == 2
    assert regular_grid(readings(spark, []), "src", "day", "t", "v", "step", "rid").count() == 0


def test_an_infinite_level_is_a_reading_from_which_nothing_is_drawn(spark):
    rows = [("a", 1, 1, 1.0, 1, 0, ""), ("a", 1, 3, float("inf"), 1, 1, ""), ("a", 1, 5, 5.0, 1, 2, ""), ("a", 1, 7, 7.0, 1, 3, "")]
    g = regular_grid(readings(spark, rows), "src", "day", "t", "v", "step", "rid").orderBy("period").collect()
    assert [r["value"] for r in g] == [1.0, None, float("inf"), None, 5.0, 6.0, 7.0] and [r["period"] for r in g if not r["covered"]] == [2, 4, 6]
    counted = regular_grid(readings(spark, rows), "src", "day", "t", "v", "step", "rid", kind="counter")
    assert counted.filter("period = 3").first()["covered"] is False


def test_grid_of_counters_against_brute_force(spark):
    rng = random.Random(3)
    rows, total = [], 0.0
    times = sorted(rng.sample(range(1, 400), 40))
    for i, t in enumerate(times):
        total = rng.uniform(0, 3) if rng.random() < 0.15 else total + rng.uniform(0, 9)
        rows.append(("a", 1, t, total, 10, i, ""))
    share, resets = defaultdict(float), 0
    for (_, _, t0, v0, *_), (_, _, t1, v1, *_) in zip(rows, rows[1:]):
        grown = v1 if v1 < v0 else v1 - v0
        resets += v1 < v0
        for second in range(t0 + 1, t1 + 1):
            share[-(-second // 10)] += grown / (t1 - t0)
    g = regular_grid(readings(spark, rows), "src", "day", "t", "v", "step", "rid", kind="counter").orderBy("period").collect()
    assert [r["period"] for r in g] == list(range(-(-times[0] // 10), -(-times[-1] // 10) + 1))
    for r in g:
        assert r["increment"] == pytest.approx(share[r["period"]]) and r["covered"] == any(-(-t // 10) == r["period"] for t in times)
    assert sum(r["resets"] for r in g) == resets
    with pytest.raises(ValueError):
        regular_grid(readings(spark, rows), "src", "day", "t", "v", "step", "rid", kind="other")


# heavy keys
def test_summary_of_heavy_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, i]), i, rng.choice([None, -3, 2**62, 5]), rng.choice([None, float("nan"), float(i)])) for i in range(2000)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "symbol string, t long, rid long, v long, c double").withColumn("part", F.lit("x"))
    got = {r["key"]: r for r in per_key_summary(df, "symbol", ["t", "rid"], "v", "c").collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(got) == set(groups)
    for k, rs in groups.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        usable = [r[4] for r in rs if r[4] is not None and r[4] == r[4]]
        volumes = [r[3] for r in rs if r[3] is not None]
        assert (got[k]["n_rows"], got[k]["n_known"], int(got[k]["total"])) == (len(rs), len(volumes), sum(volumes))
        assert (got[k]["first"], got[k]["last"]) == (usable[0], usable[-1])
    assert got["hot"]["parts"] > 1
    assert [r["key"] for r in heavy_keys(per_key_summary(df, "symbol", ["t", "rid"], "v", "c"), 0.3).collect()] == ["hot"]
    assert per_key_summary(df.limit(0), "symbol", ["t", "rid"], "v", "c").count() == 0


def test_join_to_a_large_dimension_is_split_and_whole(spark):
    facts = spark.range(1000).select(F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 9, None).otherwise(F.col("id")).cast("long").alias("k"), "id")
    dim = spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("left", "inner"):
        a = sorted(map(tuple, join_dimension(facts, dim, ["k"], how).select("id", "x").collect()))
        b = sorted(map(tuple, join_dimension(facts, dim, ["k"], how, most=10).select("id", "x").collect()))
        assert a == b and (how == "inner" or len(a) == 1000)


# implausible readings
def day(symbol, first, rng, n=300, price=100.0, volume=1000, day_=1):
    rows, p = [], price
    for i in range(n):
        o = p
        p *= math.exp(rng.gauss(0, 0.0005))
        rows.append([first + i, day_, (i + 1) * 60, symbol, float(np.float32(o)), float(np.float32(p)), int(volume * math.exp(rng.gauss(0, 0.5)))])
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([tuple(r) for r in rows], BARS)
    return {r["rid"] for r in implausible(df, "symbol", "trade_day", "second", "rid", ["binClose", "binOpen"], "binVolume", **more).collect()}


@pytest.fixture(scope="module")
def quiet_market():
    rng = random.Random(5)
    rows = []
    for i, s in enumerate("ABCDEF"):
        rows += day(s, 1000 * i, rng, price=20.0 * (i + 1), volume=500 * (i + 1))
    return rows


def test_plain_readings_are_left_alone(spark, quiet_market):
    rows = [list(r) for r in quiet_market]
    for r in rows[150:300]:
        r[4] *= 1.2  # a lasting move
        r[5] *= 1.2
    idle = [[9000 + i, 1, 60 * (i + 1), "Q", 7.0, 7.0, 0 if i % 3 else 10] for i in range(120)]
    few = [[9900, 1, 5, "N", 1.0, 9.0, 3], [9901, 1, 9, "N", None, None, None]]
    null = [[9910, 1, 9, None, -1.0, -1.0, -5], [9911, 1, 99_999, "A", -1.0, 1.0, 1], [9912, 1, None, "A", -1.0, 1.0, 1], [9913, None, 7, "A", -1.0, 1.0, 1]]
    assert found(spark, rows + idle + few + null) == set()


def test_each_kind_of_case(spark, quiet_market):
    rows = [list(r) for r in quiet_market]
    cases = set()

    def case(k):
        cases.add(rows[k][0])
        return rows[k]

    for k, (at, value) in zip((20, 40, 60, 80, 100), ((4, 0.0), (5, float("nan")), (4, float("inf")), (6, -1), (5, -3.0))):
        case(k)[at] = value
    for k in (330, 331):
        case(k)[5] *= 1.1  # two bars off, then back
    case(350)[4] *= 0.5
    case(700)[6] = 2_000_000
    for k in range(900, 920):
        case(k)[5] = rows[900][5]
    for k in range(1300, 1320):
        case(k)[6] = 777
    again = list(rows[330])
    again[0] = 50_000
    cases.add(50_000)  # sent again
    assert found(spark, [*rows, again]) == cases


def test_verdicts_do_not_depend_on_partitions(spark, quiet_market):
    rows = [tuple(r) for r in quiet_market]
    rows[330] = (*rows[330][:5], rows[330][5] * 1.2, rows[330][6])
    df = spark.createDataFrame(rows, BARS)
    want = {rows[330][0]}
    for parts, shuffle in ((1, "1"), (9, "3")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            got = implausible(df.repartition(parts), "symbol", "trade_day", "second", "rid", ["binClose", "binOpen"], "binVolume")
            assert {r["rid"] for r in got.collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_rows_and_all_null_rows(spark):
    assert found(spark, []) == set()
    assert found(spark, [[1, 1, 5, "A", None, None, None], [None, 1, 6, "A", None, None, None]]) == set()


def test_critical_values():
    # values of the two-sided test at 5 percent
    assert esd_critical(54, 0.05) == pytest.approx(3.158, abs=0.01) and esd_critical(50, 0.05) == pytest.approx(3.128, abs=0.01)


def test_a_symbol_has_its_own_season(spark):
    rng = random.Random(11)
    rows = [r for i, s in enumerate("ABC") for d in range(30) for r in day(s, 100_000 * i + 300 * d, rng, day_=d)]
    own = [r for d in range(60) for r in day("S", 900_000 + 300 * d, rng, day_=d)]
    for r in own:  # busy in the second half of the day, when the others aren't
        r[6] *= 80 if r[2] > 9000 else 1
    spikes = {own[50][0], own[910][0]}
    for k in (50, 910):
        own[k][6] = 150_000  # high for the quiet half, usual in the busy one
    assert found(spark, rows + own) == spikes


def test_another_price_of_the_same_second_is_judged_by_itself(spark, quiet_market):
    rows = [list(r) for r in quiet_market]
    spike = [60_000, *rows[400][1:]]
    spike[5] *= 1.3  # a spike beside an ordinary reading
    plain = [60_001, *rows[700][1:]]
    rows[700][5] *= 0.7  # an ordinary reading beside a spike
    for k in range(900, 920):
        rows[k][5] = rows[900][5]
    stuck = [60_002, *rows[910][1:]]
    rows[910][5] *= 1.0001  # parts the run in two, which the other reading joins
    want = {60_000, rows[700][0], 60_002, *(rows[k][0] for k in (*range(900, 910), *range(911, 920)))}
    got = found(spark, [*rows, spike, plain, stuck])
    assert {60_000, 60_002, rows[700][0]} <= got and 60_001 not in got and got <= want


def test_the_limits_are_those_of_student():
    # quantiles of tables: 2.228 for 10 degrees of freedom and 2.5 percent, 3.169 for 0.5 percent, 6.314 for 1 and 5 percent
    assert deviate_limit(12, 0.6) == pytest.approx(2.228, abs=1e-3) and deviate_limit(12, 0.12) == pytest.approx(3.169, abs=1e-3)
    assert deviate_limit(3, 0.3) == pytest.approx(6.314, abs=1e-3)
    # the internal form of the same test
    t, m = deviate_limit(50, 0.05), 50
    assert (m - 1) * t / math.sqrt((m - 2 + t * t) * m) == pytest.approx(esd_critical(50, 0.05), abs=1e-3)


def test_the_deviate_test_decides(spark, quiet_market):
    rows = [list(r) for r in quiet_market]
    rows[350][5] *= 1.006  # some six scales off
    rows[700][6] = 20_000
    loose, strict = (found(spark, rows, limits=Limits(level_alpha=a, amount_alpha=a)) for a in (0.05, 1e-40))
    assert {rows[350][0], rows[700][0]} <= loose and strict == set()


def test_readings_sent_again_by_the_thousand_are_folded(spark, quiet_market):
    rows = [tuple(r) for r in quiet_market]
    spike = (*rows[350][:5], rows[350][5] * 1.5, rows[350][6])
    rows[350] = spike
    again = [(100_000 + i, *spike[1:]) for i in range(3000)] + [(200_000 + i, *rows[20][1:]) for i in range(3000)]
    assert found(spark, [*rows, *again]) == {spike[0], *range(100_000, 103_000)}


def test_partitions_grow_with_the_input(spark, monkeypatch, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runtime.partitions(df) == least == runtime.partitions(spark.createDataFrame([(1,)], "a int"))
    monkeypatch.setattr(runtime, "PART_BYTES", 20_000)
    assert runtime.partitions(df) == -(-runtime.input_bytes(df) // 20_000) > least
