"""Texts into containers of a fixed number of tokens, by matching of large items and best fit of small ones.

Sizes are whole numbers up to the capacity, so a plan needs only how many items there are of each size: at most capacity
numbers, whatever the corpus. Large items (above a third of the capacity, at most two fit a container) are matched greedily,
the largest with the largest partner that still fits; the small ones fill the remaining gaps by best fit, largest first.
The plan gives ranges of ranks within a size to ranges of containers, and every item finds its container by its rank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.positions import ranked
from colonnade.runtime import materialize, spread

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank, first container, items of that size per container), ranks from 1, containers from 0.

    A container gets its items of one size by consecutive ranks. Sizes lie between 1 and the capacity.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError("sizes lie between 1 and the capacity")
    out: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining room -> ranges (first container, how many)
    made = 0

    def place(size: int, items: int, first: int, per: int = 1) -> None:
        a = ranks[size] + 1
        ranks[size] += items
        out.append((size, a, ranks[size], first, per))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left.get(s, 0):
            mates = [m for m in large if m <= min(s, capacity - s) and left.get(m, 0) - (m == s) > 0]
            m = mates[0] if mates else 0  # large is descending
            if not m:
                n = left[s]
                place(s, n, made)
            elif m == s:
                n = left[s] // 2
                place(s, 2 * n, made, 2)
                left[s] -= n
            else:
                n = min(left[s], left[m])
                place(s, n, made)
                place(m, n, made)
                left[m] -= n
            left[s] -= n
            open_[capacity - s - m].append((made, n))
            made += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        for room in sorted(r for r in open_ if r >= s and open_[r]):
            per = room // s
            while n and open_[room]:
                first, many = open_[room].pop()
                full = min(many, n // per)
                if full:
                    place(s, full * per, first, per)
                    n -= full * per
                    open_[room - per * s].append((first, full))
                if full < many:
                    if n:  # fewer than a container takes
                        place(s, n, first + full, n)
                        open_[room - n * s].append((first + full, 1))
                        n, full = 0, full + 1
                    if full < many:
                        open_[room].append((first + full, many - full))
            if not n:
                break
        if n:
            per = capacity // s
            full = n // per
            if full:
                place(s, full * per, made, per)
                open_[capacity - per * s].append((made, full))
                made, n = made + full, n - full * per
            if n:
                place(s, n, made, n)
                open_[capacity - n * s].append((made, 1))
                made += 1
    return out


def _sizes(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return run


#: fixed value: the pattern that divides a text before byte pairs are merged, as the public rank files were made with it
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(path: str, pattern: str = PATTERN):
    """A function that counts the tokens of a text under the byte-level vocabulary of ranks at ``path``, whose own splitting pattern may be given."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_counts(documents: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, tokens): null and empty texts have 0."""
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("tokens", T.LongType())])
    return spread(documents.select(doc_id, text)).mapInArrow(_sizes(tokenizer), schema)


def pack(sized: DataFrame, doc_id: str, tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """The container of every item: (doc_id, piece, first_token, tokens, container).

    Only an item above the capacity is split: into full pieces and the rest, which is an item like others. Items of 0 or null
    tokens take no room and stand in container 0. Every row is an item, rows that repeat included. Equal sizes go by doc_id.
    An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    c = F.lit(capacity)
    rows = sized.select(F.col(f"`{doc_id}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / c) - 1, F.lit(0)).cast("int"))))
    items = pieces.select("id", "piece", (F.col("piece").cast("long") * c).alias("first_token"), F.least(F.col("n") - F.col("piece").cast("long") * c, c).cast("int").alias("size"))
    placed = ranked(items, ["size"], [("id", False), ("piece", False)], "rank")
    placed = materialize(placed, "items")
    counts = {r["size"]: r["c"] for r in placed.filter("size > 0").groupBy("size").agg(F.count("*").alias("c")).collect()}  # at most capacity rows
    steps = plan(counts, capacity)
    spark = sized.sparkSession
    table = spark.createDataFrame(steps or [(0, 0, 0, 0, 1)], "size int, a long, z long, first long, per long")
    # a few steps for each size: the table is bounded by the capacity, not by the items
    found = placed.join(F.broadcast(table), (placed["size"] == table["size"]) & (F.col("rank") >= F.col("a")) & (F.col("rank") <= F.col("z")), "left").drop(table["size"])
    container = F.coalesce(F.col("first") + F.expr("(rank - a) div per"), F.lit(0))
    return found.select(F.col("id").alias("doc_id"), "piece", "first_token", F.col("size").cast("long").alias("tokens"), container.alias("container"))
