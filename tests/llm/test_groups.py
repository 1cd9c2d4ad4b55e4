"""Top rows of groups and percentile sketches against brute force, and on nulls, ties, repeated rows, empty tables and clashing names."""

import math
import os
import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from colonnade.llm import catalog, sketch
from colonnade.llm.streaming import append_sketches
from colonnade.llm.topn import top_n_per_group
from colonnade.operators.positions import ranked

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# top N
def test_top_n_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 5, 5, 7, rng.randrange(100)]), i) for i in range(3000)]
    rows += rows[:50]  # repeated rows are items of their own
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, s long, id long").repartition(parts)
        got = sorted((r["g"], r["s"], r["id"], r["position"]) for r in top_n_per_group(df, "g", "s", "id", 4).collect())
        groups = defaultdict(list)
        for g, s, i in rows:
            if g is not None and s is not None:
                groups[g].append((g, s, i))
        want = sorted((*x, k + 1) for v in groups.values() for k, x in enumerate(sorted(v, key=lambda x: (-x[1], x[2]))[:4]))
        assert got == want


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], "g string, s double, id long")
    assert top_n_per_group(empty, "g", "s", "id", 5).count() == 0
    clash = spark.createDataFrame([("a", 1.0, 1, 9, 8, None), ("a", float("nan"), 2, 9, 8, None)], "g string, s double, id long, position int, __pos int, __part string")
    rows = top_n_per_group(clash, "g", "s", "id", 5).collect()
    assert len(rows) == 1 and rows[0]["position"] == 9 and rows[0]["position_"] == 1
    with pytest.raises(ValueError):
        top_n_per_group(empty, "g", "s", "id", 0)


def test_ranks_of_one_group_over_many_tasks(spark):
    df = spark.range(5000).select(F.lit(0).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    assert ranked(df, ["g"], [("v", True)]).filter("position + v != 5000").count() == 0


# percentiles
def test_percentiles_within_the_error_and_mergeable(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * math.exp(rng.uniform(-8, 12)) for _ in range(2000)] + [0.0] * 100 + [1e-300, 1e300]
    rows = [("a", i % 5, v) for i, v in enumerate(values)] + [("a", 0, None), ("a", 1, float("nan")), ("a", 1, float("inf")), (None, 0, 3.0), ("one", 2, -4.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double").withColumn("n", F.lit(1))
    at = (0, 5, 25, 50, 75, 95, 99, 100)
    parts = sketch.sketch(df.filter("day < 2"), ["k"], ["v"]).unionByName(sketch.sketch(df.filter("day >= 2"), ["k"], ["v"]))
    found = {r["k"]: r for r in sketch.percentiles(sketch.merge(parts, ["k"]), ["k"], at).collect()}
    whole = {r["k"]: r for r in sketch.percentiles(sketch.sketch(df, ["k"], ["v"]), ["k"], at).collect()}
    assert found == whole
    ordered = sorted(values)
    for p in at:
        true = ordered[math.floor(p / 100 * (len(ordered) - 1))]
        assert abs(found["a"][f"p{p}"] - true) <= 0.010001 * abs(true)
    assert found["a"]["n"] == len(values) and found[None]["p50"] == pytest.approx(3, rel=0.01) and found["one"]["p99"] == pytest.approx(-4, rel=0.01)
    assert sketch.percentiles(sketch.sketch(df.limit(0), ["k"], ["v"]), ["k"], at).count() == 0
    with pytest.raises(ValueError):
        sketch.sketch(df, ["k"], ["v"], error=1.5)


def test_sketches_of_a_stream_are_those_of_the_whole(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") - 500).cast("double").alias("v"))
    df.repartition(4).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    append_sketches(stream, ["k"], ["v"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    merged = sketch.merge(spark.read.parquet(str(tmp_path / "out")), ["k"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, sketch.sketch(df, ["k"], ["v"]).collect()))
    assert df.select(sketch.bucket_of(F.lit(1.0))).first()[0] == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    ours = catalog.QUERIES[name](spark, DATA)
    columns = sorted(ours.columns)
    theirs = c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({catalog.ORACLES[name]})")
    plain = lambda x: repr(float(x)) if isinstance(x, float) else str(x)
    assert sorted(tuple(plain(r[x]) for x in columns) for r in ours.collect()) == sorted(tuple(map(plain, r)) for r in theirs.fetchall())
