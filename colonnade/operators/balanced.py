"""Per-key results when a handful of keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colonnade.operators.positions import run_starts
from colonnade.runtime import materialize, partitions


def _part_states(key: str, total: str, edge: str, schema: pa.Schema):
    """One partial state for each run of a key in a sorted partition; a run goes on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict | None = None

        def emit(states: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(states, schema=schema)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys, value, usable = b.column(key), b.column(total), b.column(edge)
            starts = run_starts([keys])
            ends = np.append(starts[1:], n)
            rows = np.diff(np.append(starts, n))
            known = np.add.reduceat(value.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts)
            # sums in two halves, as 64 bits may overflow; nulls add nothing
            v = value.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            low, high = np.add.reduceat(v & 0xFFFFFFFF, starts), np.add.reduceat(v >> 32, starts)
            there = np.flatnonzero(usable.is_valid().to_numpy(zero_copy_only=False))
            a, z = np.searchsorted(there, starts), np.searchsorted(there, ends) - 1
            # no usable edge within the run: the place is masked, and what is taken there is null
            none = a > z
            first = usable.take(pa.array(there[np.minimum(a, len(there) - 1)] if len(there) else np.zeros(len(starts), np.int64), mask=none))
            last = usable.take(pa.array(there[np.maximum(z, 0)] if len(there) else np.zeros(len(starts), np.int64), mask=none))
            names = keys.take(pa.array(starts))
            # only the last run may go on; those before it leave as columns
            done = pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([names, pa.array(np.full(len(starts), part)), *[pa.array(x) for x in (rows, known, low, high)], first, last], schema)], schema=schema)
            states = [done.slice(0, 1).to_pylist()[0]]
            if held is not None:
                if held["key"] == states[0]["key"]:
                    s = states[0]
                    for k in ("rows", "known", "low", "high"):
                        s[k] += held[k]
                    s["first"] = held["first"] if held["first"] is not None else s["first"]
                    s["last"] = s["last"] if s["last"] is not None else held["last"]
                else:
                    yield emit([held])
            if len(starts) > 1:
                yield emit(states)
                if len(starts) > 2:
                    yield done.slice(1, len(starts) - 2)
                held = done.slice(len(starts) - 1, 1).to_pylist()[0]
            else:
                held = states[0]
        if held is not None:
            yield emit([held])

    return run


def per_key_summary(df: DataFrame, key: str, order: list[str], total: str, edge: str) -> DataFrame:
    """Per key: rows, rows with a ``total``, its sum, and the first and last usable ``edge`` under ``order``.

    Rows are range-partitioned on (key, order) with sampled quantiles, so that a heavy key is split over several tasks of
    about equal size. Each task sorts its range and folds every run of a key into one partial state; a key that crosses a
    boundary has one state in each part, at most one for each partition, and these are stitched in order of the parts.

    ``total`` is an integer column, its sum a decimal (it can't overflow); ``edge`` is numeric, null and NaN are passed over.
    A null key is a key of its own (its rows are part of the whole); an empty table gives no rows. Columns: key, n_rows,
    n_known, total, first, last, share, parts. ``share`` is the key's part of all rows, ``parts`` the tasks that held it.
    """
    kind = df.schema[edge].dataType
    value = F.col(f"`{edge}`")
    usable = F.when(~F.isnan(value), value) if isinstance(kind, (T.FloatType, T.DoubleType)) else value
    order_columns = [F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)]
    slim = df.select(F.col(f"`{key}`").alias("__k"), *order_columns, F.col(f"`{total}`").cast("long").alias("__t"), usable.alias("__e"))
    by = ["__k", *[f"__o{i}" for i in range(len(order))]]
    schema = T.StructType(
        [T.StructField("key", df.schema[key].dataType), T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("rows", "known", "low", "high")], T.StructField("first", kind), T.StructField("last", kind)]
    )
    states = (
        slim.repartitionByRange(partitions(df), *by)
        .sortWithinPartitions(*by)
        .select("__k", "__t", "__e")
        .mapInArrow(_part_states("__k", "__t", "__e", to_arrow_schema(schema)), schema)
    )
    whole = states.groupBy("key").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("known").alias("n_known"),
        F.when(F.sum("known") > 0, F.sum(F.col("low").cast("decimal(38,0)")) + F.sum(F.col("high").cast("decimal(28,0)")) * F.lit(1 << 32).cast("decimal(10,0)")).cast("decimal(38,0)").alias("total"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("part"))).alias("first"),
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("part"))).alias("last"),
        F.count("*").alias("parts"),
    )
    whole = materialize(whole, "summary")  # one row for each key
    everything = max(whole.agg(F.sum("n_rows")).first()[0] or 0, 1)
    return whole.withColumn("share", F.col("n_rows") / F.lit(everything)).select("key", "n_rows", "n_known", "total", "first", "last", "share", "parts")


def heavy_keys(summary: DataFrame, share: float) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows: at most 1 / share of them."""
    return summary.filter(F.col("key").isNotNull() & (F.col("share") >= F.lit(share)))
