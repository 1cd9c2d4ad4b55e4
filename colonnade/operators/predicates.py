"""Typed, tolerance-aware predicates that compose with and, or, not into row selections.

A predicate is bound to a DataFrame (``column``), where its parameters are coerced to the column's type and reals get their
resolution. It is false, never null, on nulls, and reals are never matched by NaN, so that ``not`` is total.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import schema
from colonnade.operators.stats import resolution_of
from colonnade.runtime import small


def _guarded(df: DataFrame, name: str, p: Column) -> Column:
    """False on nulls, as false AND null is false: plain conjuncts, which a scan can take over, where coalesce would stop it."""
    v = F.col(f"`{name}`")
    return v.isNotNull() & p & ~F.isnan(v) if schema.is_real(df, name) else v.isNotNull() & p


def _number(x: Any, real: bool) -> str:
    return f"{x:.2f}" if real else str(x)


class Predicate:
    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def text(self, df: DataFrame) -> str:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Both(Predicate):
    left: Predicate
    right: Predicate

    def column(self, df):
        return self.left.column(df) & self.right.column(df)

    def text(self, df):
        return f"{self.left.text(df)} AND {self.right.text(df)}"


@dataclass(frozen=True)
class Either(Predicate):
    left: Predicate
    right: Predicate

    def column(self, df):
        return self.left.column(df) | self.right.column(df)

    def text(self, df):
        return f"({self.left.text(df)} OR {self.right.text(df)})"


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def column(self, df):
        return ~self.inner.column(df)

    def text(self, df):
        return f"NOT ({self.inner.text(df)})"


@dataclass(frozen=True)
class Equals(Predicate):
    """Equality; of reals within the resolution. The bounds beside it are what a Parquet scan can prune by."""

    name: str
    value: Any
    resolution: float | None = None

    def column(self, df):
        v, x = F.col(f"`{self.name}`"), schema.coerce(self.value, schema.base_type(df, self.name))
        if not schema.is_real(df, self.name):
            return _guarded(df, self.name, v == F.lit(x))
        r = resolution_of(df, self.name, self.resolution) or 0.0
        return _guarded(df, self.name, _sargable(v, x - r, x + r, r) & (F.abs(v.cast("double") - F.lit(x)) <= F.lit(r)))

    def text(self, df):
        kind = schema.base_type(df, self.name)
        x = schema.coerce(self.value, kind)
        return f"{self.name} = " + (f"'{x}'" if kind == "STRING" else str(x).lower() if kind == "BOOLEAN" else _number(x, kind in schema.REAL))


def _sargable(v: Column, lo: float, hi: float, r: float) -> Column:
    """Bounds a little wider than needed, in a form that is pushed to the scan."""
    slack = max(abs(lo), abs(hi), 1.0) * 1e-6 + r * 1e-3
    return (v >= F.lit(lo - slack)) & (v <= F.lit(hi + slack))


@dataclass(frozen=True)
class Between(Predicate):
    """A range. None is an open end. Integrals are closed by default, reals right-open; closed ends of reals widen by the resolution."""

    name: str
    low: Any
    high: Any
    left_closed: bool = True
    right_closed: bool | None = None
    resolution: float | None = None

    def _bounds(self, df):
        kind = schema.base_type(df, self.name)
        if kind in ("STRING", "BOOLEAN"):
            raise TypeError(f"no ranges of {kind}")
        lo, hi = (None if x is None else schema.coerce(x, kind) for x in (self.low, self.high))
        if lo is not None and hi is not None and lo > hi:
            raise ValueError(f"the range goes from {lo} down to {hi}")
        real = kind in schema.REAL
        return lo, hi, real, (not real if self.right_closed is None else self.right_closed)

    def column(self, df):
        lo, hi, real, right = self._bounds(df)
        v = F.col(f"`{self.name}`")
        r = (resolution_of(df, self.name, self.resolution) or 0.0) if real else 0
        parts = [F.lit(True)]
        for bound, closed, strict, loose in ((lo, self.left_closed, v.__gt__, v.__ge__), (hi, right, v.__lt__, v.__le__)):
            if bound is not None:
                x = F.lit(bound)
                near = strict(x) | (F.abs(v.cast("double") - x) <= F.lit(r)) if real else loose(x)
                parts.append(near if closed else strict(x))
        if real and lo is not None and hi is not None:
            parts.append(_sargable(v, lo - r, hi + r, r))
        return _guarded(df, self.name, reduce(Column.__and__, parts))

    def text(self, df):
        lo, hi, real, right = self._bounds(df)
        show = lambda x: "?" if x is None else _number(x, real)
        return f"{self.name} in {'[' if self.left_closed else '('}{show(lo)}..{show(hi)}{']' if right else ')'}"


@dataclass(frozen=True)
class In(Predicate):
    """Membership of integrals or text."""

    name: str
    values: tuple

    def __init__(self, name: str, values: Iterable):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "values", tuple(values))

    def _values(self, df):
        kind = schema.base_type(df, self.name)
        if kind in (*schema.REAL, "BOOLEAN"):
            raise TypeError(f"no membership of {kind}")
        return kind, [schema.coerce(x, kind) for x in self.values]

    def column(self, df):
        return _guarded(df, self.name, F.col(f"`{self.name}`").isin(self._values(df)[1]))

    def text(self, df):
        kind, values = self._values(df)
        return f"{self.name} in [" + ", ".join(f"'{x}'" if kind == "STRING" else str(x) for x in values) + "]"


@dataclass(frozen=True)
class Compare(Predicate):
    """<, <=, >, >= of numbers. Within the resolution reals are equal, so < and > leave that band out."""

    name: str
    operator: str
    value: Any
    resolution: float | None = None

    def column(self, df):
        kind = schema.base_type(df, self.name)
        if kind in ("STRING", "BOOLEAN"):
            raise TypeError(f"no comparison of {kind}")
        v, x = F.col(f"`{self.name}`"), schema.coerce(self.value, kind)
        one = {"<": v < x, "<=": v <= x, ">": v > x, ">=": v >= x}
        if self.operator not in one:
            raise ValueError(f"operator {self.operator!r}")
        p = one[self.operator]
        if kind in schema.REAL:
            near = F.abs(v.cast("double") - F.lit(x)) <= F.lit(resolution_of(df, self.name, self.resolution) or 0.0)
            p = p | near if "=" in self.operator else p & ~near
        return _guarded(df, self.name, p)

    def text(self, df):
        return f"{self.name} {self.operator} {schema.coerce(self.value, schema.base_type(df, self.name))}"


class Flag(Predicate):
    """A boolean column as a selection."""

    def __init__(self, name: str):
        self.name = name

    def column(self, df):
        if schema.base_type(df, self.name) != "BOOLEAN":
            raise TypeError(f"{self.name} is no boolean column")
        return _guarded(df, self.name, F.col(f"`{self.name}`"))

    def text(self, df):
        return f"{self.name} = true"


@dataclass(frozen=True)
class Range:
    """An interval; None is an open end."""

    low: Any
    high: Any
    left_closed: bool = True
    right_closed: bool = True

    def on(self, name: str, resolution: float | None = None) -> Between:
        return Between(name, self.low, self.high, self.left_closed, self.right_closed, resolution)

    def contains(self, v: Column) -> Column:
        p = F.lit(True)
        if self.low is not None:
            p &= v >= self.low if self.left_closed else v > self.low
        if self.high is not None:
            p &= v <= self.high if self.right_closed else v < self.high
        return F.coalesce(p & v.isNotNull(), F.lit(False))


def make_range(low: Any, high: Any) -> Range:
    """Integrals closed, reals right-open."""
    return Range(low, high, True, not any(isinstance(x, float) for x in (low, high)))


def tile(boundaries: list, tails: bool = False) -> list[Range]:
    """Consecutive ranges between increasing boundaries, which never overlap: right-open but for a closed last one; with tails both outer ends are open."""
    if any(a >= b for a, b in zip(boundaries, boundaries[1:])):
        raise ValueError("boundaries must increase")
    tiles = [Range(a, b, True, False) for a, b in zip(boundaries, boundaries[1:])]
    if tails and boundaries:
        return [Range(None, boundaries[0], False, False), *tiles, Range(boundaries[-1], None, True, False)]
    return [*tiles[:-1], Range(tiles[-1].low, tiles[-1].high, True, True)] if tiles else []


def tile_number(v: Column, tiles: list[Range]) -> Column:
    """Number of the tile that holds a value; null outside of all."""
    out = F.lit(None).cast("int")
    for i in range(len(tiles) - 1, -1, -1):
        out = F.when(tiles[i].contains(v), F.lit(i)).otherwise(out)
    return out


def select(df: DataFrame, *terms: Predicate) -> DataFrame:
    """Rows that meet all terms, as one filter; none when there are no terms, whose selection is undefined."""
    return df.filter(reduce(Column.__and__, [t.column(df) for t in terms]) if terms else F.lit(False))


def member_of(df: DataFrame, name: str, values: DataFrame, column: str) -> DataFrame:
    """Membership in a set too large for literals: a semi-join, with the set broadcast only up to a counted size."""
    keys = values.select(F.col(f"`{column}`").alias(name)).distinct()
    return df.join(F.broadcast(keys) if small(keys) else keys, name, "left_semi")


def at_most(name: str, limit: Any, resolution: float | None = None) -> Predicate:
    """v <= limit as a range from the column's least value: empty below it."""
    return Between(name, None, limit, True, True, resolution)


def at_least(name: str, limit: Any, resolution: float | None = None) -> Predicate:
    return Between(name, limit, None, True, True, resolution)


def single_row(df: DataFrame, id_column: str, value: Any, order: str, columns: list[str]) -> DataFrame:
    """The first row under ``order`` with that id, or none."""
    return df.filter(Equals(id_column, value).column(df)).orderBy(order).limit(1).select(*columns)
