"""Implausible readings: spikes, stuck values and impossible values, judged by the normal behaviour of their own source.

Each source's readings are split into trend, season and residual by robust statistics (medians):

* levels (prices): trend is the median of the neighbours before and that of the neighbours after a bar; the residual of a
  bar is its distance, in logarithms, from the nearer of the two, and 0 if it lies between them. A lasting move has its
  neighbours on one side and no residual; only what is soon gone again has one. So short a trend follows any season.
* amounts (volumes): trend is the source's median, moved towards that of the segment as far as its bars allow, season the
  source's own median profile over the time of day, both of logarithms.

Where a source has few bars its scale, season and tail lean on those of all sources, each source counting once. A residual
counts in units of its source's robust scale and is flagged beyond the limit of the generalised extreme studentised deviate
test for its rank. That limit comes from the normal distribution; how much heavier the residuals' tails are is read off their
own quantiles. Constant runs and impossible values are separate checks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colonnade.operators.positions import run_starts
from colonnade.runtime import join_dimension, materialize, partitions


@dataclass(frozen=True)
class Limits:
    """Parameters. The alphas are the levels of the deviate test: the chance that a source of plain readings has any flagged."""

    level_alpha: float = 1e-7
    amount_alpha: float = 1e-4
    #: neighbours on each side that make the trend
    neighbours: int = 5
    #: least number of bars in a stuck run, and its least multiple of the source's usual longest run
    stuck_bars: int = 8
    stuck_times: float = 2.0
    #: a source that repeats its value in a larger part of its steps, or whose amount is 0 in a larger part of its bars,
    #: hardly moves; its runs are quiet spells
    stuck_repeats: float = 0.35
    idle: float = 0.1
    #: moves and amounts of a source that weigh as much as the pooled scale, season and tail of all sources; bars of a
    #: segment that weigh as much as the source's median
    level_prior: float = 4.0
    amount_prior: float = 120.0
    tail_prior: float = 500.0
    trend_prior: float = 200.0
    #: periods of the day that the season has, and the length of the day
    seasons: int = 26
    day: int = 23_400
    #: relative width of the buckets in which ranks are counted
    width: float = 0.02


def _feature_schema(source: str, segment: str, time: str, row: str, df: DataFrame, levels: list[str], amount: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("source", df.schema[source].dataType),
            T.StructField("rid", df.schema[row].dataType),
            T.StructField("bin", T.ByteType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("impossible", T.BooleanType()),
            *[x for i in range(len(levels)) for x in (T.StructField(f"gap{i}", T.FloatType()), T.StructField(f"move{i}", T.FloatType()), T.StructField(f"run{i}", T.IntegerType()), T.StructField(f"own{i}", T.BooleanType()))],
            T.StructField("amount", T.FloatType()),
            T.StructField("local", T.FloatType()),
            T.StructField("locals", T.IntegerType()),
            T.StructField("idle", T.BooleanType()),
            T.StructField("arun", T.IntegerType()),
            *[T.StructField(f"__{i}", df.schema[x].dataType) for i, x in enumerate([segment, time, *levels, amount])],  # as they came
        ]
    )


def _side_medians(x: np.ndarray, group: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the up to w values before and after each value within its group; NaN where there is none."""
    n = len(x)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    shift = np.zeros(n, np.int64)
    shift[starts] = w
    at = np.arange(n) + np.cumsum(shift)  # each group gets w empty places in front
    padded = np.full(int(at[-1]) + 1 + w if n else w, np.nan)
    padded[at] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, w)

    def middle(rows: np.ndarray) -> np.ndarray:
        s = np.sort(rows, axis=1)  # NaN last
        k = w - np.isnan(s).sum(axis=1)
        i = np.arange(len(s))
        lo, hi = s[i, np.maximum((k - 1) // 2, 0)], s[i, np.minimum(k // 2, w - 1)]
        return np.where(k > 0, np.where(k % 2 == 1, lo, (lo + hi) / 2), np.nan)

    out = (np.empty(n), np.empty(n))
    for a in range(0, n, 1 << 18):  # in blocks, to hold little memory
        z = slice(a, min(a + (1 << 18), n))
        out[0][z] = middle(view[at[z] - w])
        out[1][z] = middle(view[at[z] + 1])
    return out


def _medians(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median (NaN where there is none) and number of the values of each row's group, NaN left out."""
    order = np.lexsort((x, group))  # NaN last
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(x) else np.zeros(0, np.int64)
    counts = np.add.reduceat(np.isfinite(x).astype(np.int64), starts) if len(x) else starts
    s = x[order]
    middle = (s[starts + np.maximum(counts - 1, 0) // 2] + s[starts + np.maximum(np.minimum(counts // 2, counts - 1), 0)]) / 2
    return middle[group], counts[group]


def _runs(value: np.ndarray, usable: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run of equal values, over usable bars of a group, that each bar lies in; 0 where not usable."""
    at = np.flatnonzero(usable)
    out = np.zeros(len(value), np.int32)
    if len(at):
        v, g = value[at], group[at]
        starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (g[1:] != g[:-1])])
        lengths = np.diff(np.r_[starts, len(at)])
        out[at] = np.repeat(lengths, lengths)
    return out


def _own_runs(x: np.ndarray, place: np.ndarray, value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run that each x would lie in, were it the value at its place among the values of the groups."""
    n = len(value)
    new = np.r_[True, (value[1:] != value[:-1]) | (group[1:] != group[:-1])]
    starts = np.flatnonzero(new)
    start, end = starts[np.cumsum(new) - 1], np.r_[starts[1:], n][np.cumsum(new) - 1]
    prev, nxt = np.maximum(place - 1, 0), np.minimum(place + 1, n - 1)
    left = np.where((place > 0) & (group[prev] == group[place]) & (value[prev] == x), place - start[prev], 0)
    right = np.where((place < n - 1) & (group[nxt] == group[place]) & (value[nxt] == x), end[nxt] - place - 1, 0)
    return left + 1 + right


def _features(source: str, segment: str, time: str, row: str, levels: list[str], amount: str, p: Limits, schema: pa.Schema):
    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = lambda c: t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], t.schema.field(c).type)
        n = t.num_rows
        starts = run_starts([col(source), col(segment)])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        second = col(time).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.r_[True, (second[1:] != second[:-1]) | (group[1:] != group[:-1])]  # the first row of each time; others were sent again
        bar = np.cumsum(fresh) - 1
        bars = np.flatnonzero(fresh)
        g = group[bars]
        out: dict[str, np.ndarray] = {}
        impossible = np.zeros(n, bool)
        for i, name in enumerate(levels):
            c = col(name)
            there = c.is_valid().to_numpy(zero_copy_only=False)
            x = c.fill_null(1.0).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(invalid="ignore"):
                bad = there & ~((x > 0) & np.isfinite(x))
            impossible |= bad
            # a time's value is that of its first row that has a usable one
            good = there & ~bad
            value = np.full(len(bars), np.nan)
            idx = np.flatnonzero(good)[::-1]
            value[bar[idx]] = x[idx]
            have = np.isfinite(value)
            at = np.flatnonzero(have)
            move = np.full(len(bars), np.nan)
            gap, run = np.zeros(n), np.where(good, _runs(np.nan_to_num(value), have, g)[bar], 0)
            own = good & (x != value[bar])  # another reading than the time's; it is judged by itself
            if len(at):
                lx, gg = np.log(value[at]), g[at]
                sides = np.full((2, len(bars)), np.nan)
                sides[:, at] = _side_medians(lx, gg, p.neighbours)
                read = np.flatnonzero(good)
                lr = np.log(x[read])
                d0, d1 = lr - sides[0][bar[read]], lr - sides[1][bar[read]]
                both = np.isfinite(d0) & np.isfinite(d1)
                with np.errstate(invalid="ignore"):
                    near = np.where(np.sign(d0) == np.sign(d1), np.minimum(np.abs(d0), np.abs(d1)), 0.0)
                one = np.where(np.isfinite(d0), np.abs(d0), np.where(np.isfinite(d1), np.abs(d1), 0.0))
                gap[read] = np.where(both, near, one)
                step = np.r_[np.nan, np.abs(np.diff(lx))]
                step[np.flatnonzero(np.r_[True, gg[1:] != gg[:-1]])] = np.nan
                move[at] = step
                if own.any():
                    place = np.cumsum(have) - 1
                    run[own] = _own_runs(x[own], place[bar[own]], value[at], gg)
            out[f"gap{i}"] = gap.astype(np.float32)
            out[f"move{i}"] = np.where(fresh, move[bar], np.nan).astype(np.float32)
            out[f"run{i}"] = run.astype(np.int32)
            out[f"own{i}"] = own
        c = col(amount)
        there = c.is_valid().to_numpy(zero_copy_only=False)
        x = c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        impossible |= there & (x < 0)
        value = np.full(len(bars), np.nan)
        idx = np.flatnonzero(there & (x >= 0))[::-1]
        value[bar[idx]] = x[idx]
        run = _runs(np.nan_to_num(value), value > 0, g)
        with np.errstate(divide="ignore", invalid="ignore"):
            out["amount"] = np.where(there & (x > 0), np.log(x), np.nan).astype(np.float32)
        out["local"], out["locals"] = _medians(np.where(fresh, out["amount"], np.nan), group)
        out["idle"] = there & (x == 0)
        out["arun"] = np.where(there & (x > 0), run[bar], 0).astype(np.int32)
        out["bin"] = np.clip((second - 1) * p.seasons // p.day, 0, p.seasons - 1).astype(np.int8)
        out["first"], out["impossible"] = fresh, impossible
        arrays = []
        for f in schema:
            if f.name == "source":
                arrays.append(col(source))
            elif f.name == "rid":
                arrays.append(col(row))
            elif f.name.startswith("__"):
                arrays.append(col([segment, time, *levels, amount][int(f.name[2:])]))
            elif pa.types.is_floating(f.type):
                arrays.append(pa.array(out[f.name], f.type, from_pandas=True))
            else:
                arrays.append(pa.array(out[f.name], f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole segments only: the last segment of what is held waits for more rows."""
        held: list[pa.RecordBatch] = []
        rows, enough = 0, 100_000
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = int(run_starts([t.column(source).chunk(0), t.column(segment).chunk(0)])[-1])
                if cut:
                    yield block(t.slice(0, cut))
                    t = t.slice(cut)
                held, rows = t.to_batches(), t.num_rows
                enough = max(100_000, 2 * rows)  # a long segment is put together a few times only
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def esd_critical(m: float, alpha: float) -> float:
    """Critical value of the generalised deviate test with m residuals left, the one tested included.

    (m - 1) t / sqrt((m - 2 + t^2) m), t Student's quantile at 1 - alpha / (2 m) with m - 2 degrees of freedom, by its
    expansion about the normal quantile.
    """
    m = max(m, 4.0)
    z, d = -NormalDist().inv_cdf(alpha / (2 * m)), m - 2
    t = z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d)
    return (m - 1) * t / math.sqrt((d + t * t) * m)


def _beyond(t: float, v: float) -> float:
    """Chance that Student's t with v degrees of freedom is above t > 0: half the incomplete beta function, by its continued fraction."""
    x, a, b = v / (v + t * t), v / 2, 0.5
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + e * d), 1 + e / c
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    part = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * h / a
    return (1 - part if turned else part) / 2


def deviate_limit(m: float, alpha: float, prior: float = 0.0) -> float:
    """The limit of the deviate test for the most extreme of m residuals whose scale isn't drawn from the tested one.

    Student's quantile at 1 - alpha / (2 m). ``esd_critical`` is the same test for residuals studentised by a deviation that
    the tested one is part of; a median of absolute deviations isn't. ``prior`` pooled values besides stand behind the scale.
    """
    m = max(m, 2.0)
    p, v = alpha / (2 * m), max(m - 2 + prior, 1.0)
    if v > 200:
        z = -NormalDist().inv_cdf(p)
        return z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    low, high = 0.0, 1.0
    while _beyond(high, v) > p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _beyond(middle, v) > p else (low, middle)
    return high


def esd_limit(n: Column, rank: Column | int, alpha: float, prior: float = 0.0) -> Column:
    """The limit for the rank-th largest of n residuals, for sizes in steps of 10 percent, rounded down."""
    step = math.log(1.1)
    table = F.array(*[F.lit(deviate_limit(math.exp(k * step), alpha, prior)) for k in range(330)])
    m = F.greatest(n - rank + F.lit(1), F.lit(1)).cast("double")
    return F.element_at(table, (F.floor(F.log(m) / F.lit(step)) + 1).cast("int"))


#: quantiles at which tails are read off, and the normal distribution's values there
TAIL = (0.9, 0.99)
NORMAL = tuple(NormalDist().inv_cdf(q) for q in TAIL)


def _cutoffs(scored: DataFrame, tests: list[tuple[str, float, float, str]], p: Limits) -> DataFrame:
    """The least flagged score of each source and test, (source, cut_<score>...): ranks come from counts in buckets of the score.

    Scores are such that the limit of the test is that of normal residuals. Only rows that the test's last column names are
    counted, and of those only scores that any rank could flag; there are at most a few thousand buckets a source, whatever its size.
    """
    each = F.array(*[F.struct(F.lit(i).alias("test"), F.when(F.col(c), F.col(z)).alias("z")) for i, (z, _, _, c) in enumerate(tests)])
    high = scored.select("source", "n", F.explode(each).alias("e")).select("source", "n", "e.*").filter("z > 1")
    high = high.withColumn("b", F.floor(F.log("z") / F.lit(math.log1p(p.width))).cast("int"))
    counts = high.groupBy("source", "test", "b").agg(F.count("*").alias("c"), F.min("z").alias("low"), F.max("n").alias("n"))
    w = Window.partitionBy("source", "test").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("rank", F.sum("c").over(w))
    limit = F.lit(None)
    for i, (_, alpha, prior, _) in enumerate(tests):
        limit = F.when(F.col("test") == i, esd_limit(F.col("n"), F.col("rank"), alpha, prior)).otherwise(limit)
    passed = counts.filter(F.col("low") > limit)
    return passed.groupBy("source").agg(*[F.min(F.when(F.col("test") == i, F.col("low"))).alias(f"cut_{z}") for i, (z, *_) in enumerate(tests)])


def implausible(df: DataFrame, source: str, segment: str, time: str, row: str, levels: list[str], amount: str, limits: Limits = Limits()) -> DataFrame:
    """Rows that hold an implausible reading: (row, impossible, spike, stuck).

    ``time`` is an integer, ``levels`` are floating, ``amount`` is an integer; a segment (a day) is a bounded stretch of time.
    Rows without source, segment or time, or with a time outside 1..limits.day, are not judged. Nulls are no readings and are
    passed over. Rows with the same source, segment, time and values are one reading sent again, folded before the shuffle and
    given one verdict. Of different readings of the same time the first (by row) counts in all statistics; the others are
    judged by their own values against the neighbours of that time. Sources with few readings lean on the pooled scale of all.
    An empty table gives no rows.
    """
    p, c = limits, (lambda name: F.col(f"`{name}`"))
    names = [source, segment, time, *levels, amount]
    slim = df.filter(c(source).isNotNull() & c(segment).isNotNull() & c(time).between(1, p.day)).select(c(row), *[c(x) for x in names])
    readings = slim.groupBy(*[c(x) for x in names]).agg(F.min(c(row)).alias(row))
    schema = _feature_schema(source, segment, time, row, readings, levels, amount)
    # a segment has at most as many times as its length, so no task holds more than its different readings, however many rows its source has
    feats = readings.repartition(partitions(df), c(source), c(segment)).sortWithinPartitions(source, segment, time, row).mapInArrow(_features(source, segment, time, row, levels, amount, p, to_arrow_schema(schema)), schema)
    feats = materialize(feats, "features")

    k = len(levels)
    bars = feats.filter("first")
    moving = lambda i: F.when(F.col(f"move{i}") > 0, F.col(f"move{i}"))
    stats = bars.groupBy("source").agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(moving(i), 0.5, 500).alias(f"step{i}") for i in range(k)],
        *[F.percentile_approx(f"gap{i}", list(TAIL), 500).alias(f"tail{i}") for i in range(k)],
        *[F.count(moving(i)).alias(f"moves{i}") for i in range(k)],
        *[F.count(f"move{i}").alias(f"steps{i}") for i in range(k)],
        *[F.greatest(F.max(f"run{i}"), F.lit(1)).alias(f"longest{i}") for i in range(k)],
        F.greatest(F.max("arun"), F.lit(1)).alias("longest"),
        F.percentile_approx("amount", 0.5, 500).alias("mid"),
        F.count("amount").alias("amounts"),
        F.count_if(F.col("arun") > 1).alias("same_amounts"),
        (F.count_if("idle") > F.lit(p.idle) * F.count("*")).alias("quiet"),
    )
    stats = materialize(stats, "sources")
    pooled = stats.agg(*[F.percentile_approx(f"step{i}", 0.5, 500).alias(f"s{i}") for i in range(k)]).first()
    for i in range(k):
        own, pool = F.col(f"step{i}"), F.lit(float(pooled[f"s{i}"] or 0.001))
        # in logarithms: few moves lean on the pool
        share = F.col(f"moves{i}") / (F.col(f"moves{i}") + F.lit(p.level_prior))
        stats = stats.withColumn(f"scale{i}", F.coalesce(F.exp(share * F.log(own) + (1 - share) * F.log(pool)), pool) * 1.4826)
        stats = stats.withColumn(f"repeats{i}", _repeats(F.col(f"steps{i}") - F.col(f"moves{i}"), F.col(f"steps{i}"), F.col(f"longest{i}") - 1))
    stats = stats.withColumn("repeats", _repeats(F.col("same_amounts"), F.col("amounts"), F.col("longest") - 1))
    tails = stats.agg(*[F.percentile_approx(F.when(F.col(f"moves{i}") > 0, F.col(f"tail{i}")[j] / F.col(f"scale{i}")), 0.5, 1000).alias(f"t{i}{j}") for i in range(k) for j in (0, 1)]).first()
    stats = materialize(stats.select("source", "n", "mid", "quiet", "repeats", *[x for i in range(k) for x in (f"scale{i}", f"repeats{i}")]), "scales")

    # amounts: the season is the source's median profile around its trend, few bars of a period leaning on the median of the
    # sources' profiles; then its spread about it
    local = F.col("locals") / (F.col("locals") + F.lit(p.trend_prior))
    detrended = F.col("amount") - F.col("mid") - F.coalesce(local * (F.col("local") - F.col("mid")), F.lit(0.0))
    about = join_dimension(bars.select("source", "bin", "amount", "local", "locals").filter("amount is not null"), stats.select("source", "mid"), ["source"], "inner").select("source", "bin", detrended.alias("r"))
    own = materialize(about.groupBy("source", "bin").agg(F.percentile_approx("r", 0.5, 500).alias("own"), F.count("*").alias("rs")), "profiles")
    profile = {r["bin"]: float(r["season"]) for r in own.groupBy("bin").agg(F.percentile_approx("own", 0.5, 1000).alias("season")).collect()}  # one value for each of the day's periods
    weight = F.col("rs") / (F.col("rs") + F.lit(p.amount_prior))
    season = lambda b: F.coalesce(F.max(F.when(F.col("bin") == b, weight * F.col("own") + (1 - weight) * F.lit(profile.get(b, 0.0)))), F.lit(profile.get(b, 0.0)))
    seasons = materialize(own.groupBy("source").agg(F.array(*[season(b) for b in range(p.seasons)]).cast("array<float>").alias("seasons")), "seasons")
    seasonal = F.element_at("seasons", F.col("bin").cast("int") + 1)
    residual = join_dimension(about, seasons, ["source"], "inner").select("source", (F.col("r") - seasonal).alias("r"))
    spread = residual.groupBy("source").agg(F.percentile_approx(F.abs("r"), 0.5, 500).alias("mad"), F.percentile_approx("r", TAIL[1], 500).alias("high"), F.count("*").alias("rs"))
    spread = materialize(spread, "spread")
    pool = float(spread.agg(F.percentile_approx("mad", 0.5, 500)).first()[0] or 0.35)
    lean = lambda prior: F.col("rs") / (F.col("rs") + F.lit(prior))
    spread = spread.withColumn("spread", 1.4826 * F.greatest(lean(p.amount_prior) * F.col("mad") + (1 - lean(p.amount_prior)) * F.lit(pool), F.lit(0.1)))
    high = float(spread.agg(F.percentile_approx(F.col("high") / F.col("spread"), 0.5, 1000)).first()[0] or NORMAL[1])
    heavier = F.greatest((lean(p.tail_prior) * F.col("high") / F.col("spread") + (1 - lean(p.tail_prior)) * F.lit(high)) / F.lit(NORMAL[1]), F.lit(1.0))
    spread = spread.select("source", (F.col("spread") * heavier).alias("spread"))

    tests = [*[(f"z{i}", p.level_alpha, p.level_prior, f"ranked{i}") for i in range(k)], ("za", p.amount_alpha, p.amount_prior, "first")]
    # only rows that any check may flag go on: the test goes down to half of a source's bars
    least = {z: esd_limit(F.col("n"), F.ceil(F.col("n") / 2), alpha, prior) for z, alpha, prior, _ in tests}
    judged = stats.join(spread, "source", "left").join(seasons, "source", "left")
    judged = judged.withColumns({f"least{i}": (F.col(f"scale{i}") * _from_normal(least[f"z{i}"], tails[f"t{i}0"], tails[f"t{i}1"])).cast("float") for i in range(k)} | {"leasta": F.col("spread") * least["za"]})
    whole = join_dimension(feats, materialize(judged, "judged"), ["source"], "inner")
    over = detrended - seasonal
    stuck = _stuck([(f"run{i}", f"repeats{i}") for i in range(k)] + [("arun", "repeats")], p)
    may = reduce(Column.__or__, [F.coalesce(F.col(f"gap{i}") >= F.col(f"least{i}"), F.lit(False)) for i in range(k)], F.col("impossible") | stuck | F.coalesce(over >= F.col("leasta"), F.lit(False)))
    scored = whole.filter(may).select(
        "source",
        *[f"__{i}" for i in range(len(names) - 1)],
        "first",
        "impossible",
        "n",
        *[f"own{i}" for i in range(k)],
        *[_as_normal(F.col(f"gap{i}") / F.col(f"scale{i}"), tails[f"t{i}0"], tails[f"t{i}1"]).alias(f"z{i}") for i in range(k)],
        (over / F.col("spread")).alias("za"),
        stuck.alias("stuck"),
    )
    scored = materialize(scored, "scored")
    ranked = scored.withColumns({f"ranked{i}": F.col("first") | F.col(f"own{i}") for i in range(k)})
    flagged = join_dimension(scored, materialize(_cutoffs(ranked, tests, p), "cutoffs"), ["source"], "left")
    spike = reduce(Column.__or__, [F.coalesce(F.col(z) >= F.col(f"cut_{z}"), F.lit(False)) for z, *_ in tests])
    found = flagged.select(F.col("source").alias(source), F.col("__0").alias(segment), F.col("__1").alias(time), *[f"__{i}" for i in range(2, len(names) - 1)], "impossible", spike.alias("spike"), "stuck")
    found = materialize(found.filter("impossible or spike or stuck"), "found")
    # every row of a flagged reading: the same source, segment and time, and the same values, nulls being equal
    flat = slim.select(c(row).alias("__row"), c(source), c(segment), c(time), *[c(x).alias(f"__of{i}") for i, x in enumerate(names[3:], 2)])
    same = reduce(Column.__and__, [F.col(f"__{i}").eqNullSafe(F.col(f"__of{i}")) for i in range(2, len(names) - 1)])
    return join_dimension(flat, found, [source, segment, time], "inner").filter(same).select(F.col("__row").alias(row), "impossible", "spike", "stuck")


def _as_normal(z: Column, near: float | None, far: float | None) -> Column:
    """A residual as the normal deviate that is as far out: z = far (u / NORMAL[1])^b goes through both quantiles read off, b at least 1."""
    if not near or not far or far <= near:
        return z
    b = max(math.log(far / near) / math.log(NORMAL[1] / NORMAL[0]), 1.0)
    return F.lit(NORMAL[1]) * F.pow(z / F.lit(far), F.lit(1 / b))


def _from_normal(u: Column, near: float | None, far: float | None) -> Column:
    """The residual that ``_as_normal`` gives u for."""
    if not near or not far or far <= near:
        return u
    b = max(math.log(far / near) / math.log(NORMAL[1] / NORMAL[0]), 1.0)
    return F.lit(float(far)) * F.pow(u / F.lit(NORMAL[1]), F.lit(b)) * F.lit(1 - 1e-6)


def _repeats(same: Column, of: Column, longest: Column) -> Column:
    """Share of steps that repeat the value, the longest run left out, as that may be the stuck one."""
    return F.greatest(same - longest, F.lit(0)) / F.greatest(of - longest, F.lit(1))


def _stuck(runs: list[tuple[str, str]], p: Limits) -> Column:
    """A run counts if it is long in itself and against the run that the source's own rate of repeats would bring by chance.

    With a share q of steps that repeat, the longest run among n bars is about 1 + log(n) / log(1 / q).
    """
    any_run = F.lit(False)
    for run, repeats in runs:
        q = F.least(F.greatest(F.col(repeats), F.lit(0.005)), F.lit(0.95))
        usual = 1 + F.log(F.greatest(F.col("n"), F.lit(2)).cast("double")) / -F.log(q)
        any_run |= (F.col(run) >= F.greatest(F.lit(float(p.stuck_bars)), p.stuck_times * usual)) & (F.col(repeats) <= p.stuck_repeats) & ~F.col("quiet")
    return F.coalesce(any_run, F.lit(False))
