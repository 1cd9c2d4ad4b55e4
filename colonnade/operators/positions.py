"""Global order without a single task: range-partitioned sort, counts per partition, prefix sums.

``ranked`` gives exact positions within each group, and on request only the first N of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colonnade.runtime import materialize, partitions

PART, POS, COUNT = "__part", "__pos", "__count"


def run_starts(columns: list[pa.Array]) -> np.ndarray:
    """Indices at which any of the columns differs from the row before; nulls equal nulls."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        codes = c.dictionary_encode().indices if not pa.types.is_integer(c.type) else c
        valid = codes.is_valid().to_numpy(zero_copy_only=False)
        v = codes.fill_null(0).to_numpy(zero_copy_only=False)
        new[1:] |= (v[1:] != v[:-1]) | (valid[1:] != valid[:-1])
    return np.flatnonzero(new)


def _local_positions(groups: list[str], keep: int | None, schema: pa.Schema):
    """Streams a sorted partition: rows with their position in the partition's part of the group, and one count row a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        seen = 0
        template: pa.RecordBatch | None = None

        def counted(row: pa.RecordBatch, n: int) -> pa.RecordBatch:
            arrays = []
            for f in schema:
                if f.name == PART:
                    arrays.append(pa.array([part], pa.int32()))
                elif f.name == POS:
                    arrays.append(pa.array([0], pa.int64()))
                elif f.name == COUNT:
                    arrays.append(pa.array([n], pa.int64()))
                elif f.name in groups:
                    arrays.append(row.column(f.name).cast(f.type))
                else:
                    arrays.append(pa.nulls(1, f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            starts = run_starts([b.column(g) for g in groups])
            key = tuple(b.column(g)[0].as_py() for g in groups)
            goes_on = last is not None and key == last
            if last is not None and not goes_on:
                yield counted(template, seen)
            lengths = np.diff(np.append(starts, n))
            pos = np.arange(n) - np.repeat(starts, lengths) + 1
            if goes_on:
                pos[: lengths[0]] += seen
            ends = pos[np.append(starts[1:], n) - 1]
            ok = pos <= keep if keep is not None else np.ones(n, bool)
            # counts of the groups that end inside this batch
            done = np.append(starts[1:], n)[:-1] - 1
            rows = np.concatenate([np.flatnonzero(ok), done])
            if len(rows):
                took = b.take(pa.array(rows))
                k, d = int(ok.sum()), len(done)
                extra = {
                    PART: pa.array(np.full(k + d, part, np.int32)),
                    POS: pa.array(np.concatenate([pos[ok], np.zeros(d, np.int64)])),
                    COUNT: pa.array(np.concatenate([np.zeros(k, np.int64), ends[:-1]])),
                }
                yield pa.RecordBatch.from_arrays([extra[f.name] if f.name in extra else took.column(f.name).cast(f.type) for f in schema], schema=schema)
            last, seen = tuple(b.column(g)[n - 1].as_py() for g in groups), int(ends[-1])
            template = b.slice(n - 1, 1)
        if last is not None:
            yield counted(template, seen)

    return run


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it as long as there is such a column."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def ranked(df: DataFrame, groups: list[str], order: list[tuple[str, bool]], position: str = "position", keep: int | None = None) -> DataFrame:
    """Adds the exact position (from 1) of each row in its group under ``order``; with ``keep`` only positions up to it.

    ``order`` is a list of (column, descending). One range-partitioned sort on (groups, order) splits even a group that holds
    most rows over many tasks. Each task counts its part of every group; a prefix sum of these counts, at most partitions x
    (keep or 1) rows a group, turns positions in the part into positions in the group. ``order`` must be total for a
    repeatable result. Nulls come first ascending, last descending. Null group keys form one group. An empty input gives an
    empty result. Group keys can't be floating. A clash of ``position`` with a column adds underscores to it.
    """
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    if any(isinstance(df.schema[g].dataType, (T.FloatType, T.DoubleType)) for g in groups):
        raise ValueError("group keys can't be floating")
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()])
    keys = [place[g] for g in groups]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in inner.schema], T.StructField(PART, T.IntegerType()), T.StructField(POS, T.LongType()), T.StructField(COUNT, T.LongType())])
    by = [*[F.col(k) for k in keys], *[F.col(place[c]).desc() if down else F.col(place[c]).asc() for c, down in order]]
    local = inner.repartitionByRange(partitions(df), *by).sortWithinPartitions(*by).mapInArrow(_local_positions(keys, keep, to_arrow_schema(schema)), schema)
    back = [F.col(n).alias(c, metadata=df.schema[c].metadata) if df.schema[c].metadata else F.col(n).alias(c) for c, n in place.items()]
    name = free_name(position, df.columns)
    if keep is None:  # rows stay where they are; only the counts move
        local = materialize(local, "positions")
        counts = local.filter(F.col(POS) == 0).select(*keys, PART, COUNT)
        w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        # only groups that go on in a later part need an offset: at most one for each boundary between parts, hence broadcast
        before = counts.withColumn("before", F.coalesce(F.sum(COUNT).over(w), F.lit(0))).filter("before > 0")
        renamed = before.select(*[F.col(k).alias(f"g{i}") for i, k in enumerate(keys)], F.col(PART).alias("p"), "before")
        on = F.col(PART) == F.col("p")
        for i, k in enumerate(keys):
            on &= F.col(k).eqNullSafe(F.col(f"g{i}"))
        out = local.filter(F.col(POS) > 0).join(F.broadcast(renamed), on, "left")
        return out.select(*back, (F.col(POS) + F.coalesce("before", F.lit(0))).alias(name))
    w = Window.partitionBy(*keys).orderBy(PART).rangeBetween(Window.unboundedPreceding, -1)
    out = local.withColumn("before", F.coalesce(F.sum(COUNT).over(w), F.lit(0)))
    at = F.col(POS) + F.col("before")
    return out.filter((F.col(POS) > 0) & (at <= keep)).select(*back, at.alias(name))
