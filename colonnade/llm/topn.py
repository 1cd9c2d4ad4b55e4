"""The N best rows of every group, by exact positions in one global order.

Rows are range-partitioned and sorted on (group, score, identifier); counts of every group in every partition are
prefix-summed into exact positions, of which those up to N stay. A group of any size is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.positions import ranked


def top_n_per_group(df: DataFrame, group: str, score: str, identifier: str, n: int, position: str = "position") -> DataFrame:
    """The ``n`` rows of each group with the highest score; equal scores go by the smaller identifier.

    Rows with a null group or a null score take no part; NaN counts as null. A group of fewer rows comes whole. Rows that
    repeat are items of their own (with equal identifiers they are interchangeable). ``n`` < 1 raises. Columns: all of ``df``, and ``position``.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(f"`{score}`")
    usable = F.col(f"`{group}`").isNotNull() & s.isNotNull()
    if isinstance(df.schema[score].dataType, (T.FloatType, T.DoubleType)):
        usable &= ~F.isnan(s)
    return ranked(df.filter(usable), [group], [(score, True), (identifier, False)], position, keep=n)
