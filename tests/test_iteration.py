"""Row iteration over tables whose ids don't begin at 0, go beyond a million and are missing."""

import duckdb

from colonnade.plans import columnar


def test_every_row_is_iterated(spark, tmp_path):
    rows = [(1_000_000 + i * 7 % 400, i / 4) for i in range(400)] + [(None, 3.5), (-5, None), (999_999, float("nan"))]
    spark.createDataFrame(rows, "event_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = columnar.QUERIES["row_iteration"](spark, str(tmp_path))
    assert [repr(tuple(r)) for r in got.collect()] == [repr(r) for r in duck.sql(f"SELECT {', '.join(got.columns)} FROM ({columnar.ORACLES['row_iteration']})").fetchall()]
    r = got.first()
    assert (r["n_rows"], r["n_ids"], r["descents"], r["first_id"], r["last_id"]) == (403, 402, 0, -5, None)


def test_unordered_rows_show():
    assert columnar.iterated([(3, 1.0), (2, 1.0), (4, 1.0)])[2] == 1
    assert columnar.iterated([(1, 1.0), (2, 2.0)])[-2:] != columnar.iterated([(1, 2.0), (2, 1.0)])[-2:]
