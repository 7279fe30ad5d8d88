"""Past-only features of ordered units. Every function takes and returns a `Series`."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import array_median
from .series import Series, series

# Slope below which a series counts as declining, and the life proxy's ceiling.
DECLINE_SLOPE = -1e-4
LIFE_CEILING = 500.0


def first_difference(s: Series, columns: Sequence[str], suffix: str = "_delta") -> Series:
    return s.trailing(2, lambda f: {
        c + suffix: F.coalesce(F.col(c) - F.lag(c).over(f.ordered), F.lit(0.0)) for c in columns})


def trailing_mean(s: Series, columns: Sequence[str], windows: Sequence[int]) -> Series:
    return s.trailing(max(windows), lambda f: {
        f"{c}_mean_{w}": F.avg(c).over(f.last(w)) for c in columns for w in windows})


def trailing_std(s: Series, columns: Sequence[str], windows: Sequence[int]) -> Series:
    """Population deviation; rounding can make a tiny negative variance, never below zero here."""
    return s.trailing(max(windows), lambda f: {
        f"{c}_std_{w}": F.greatest(F.stddev_pop(c).over(f.last(w)), F.lit(0.0)) for c in columns for w in windows})


def trailing_median(s: Series, columns: Sequence[str], windows: Sequence[int]) -> Series:
    return s.trailing(max(windows), lambda f: {
        f"{c}_median_{w}": F.percentile(c, 0.5).over(f.last(w)) for c in columns for w in windows})


def trailing_mad(s: Series, column: str, window: int, name: str) -> Series:
    """Median distance from the window's own median."""
    held = s.trailing(window, lambda f: {"__held": F.collect_list(column).over(f.last(window))})
    centred = held.select(__centre=array_median(F.col("__held")))
    distance = array_median(F.transform("__held", lambda v: F.abs(v - F.col("__centre"))))
    done = centred.select(**{name: distance})
    return done.using(done.df.drop("__held", "__centre"))


def growing_mean_baseline(s: Series, columns: Sequence[str], rows: int = 10) -> Series:
    """Mean of the first ``rows`` rows seen so far, constant afterwards."""
    numbered = s.number("__n")
    early = lambda c: F.when(F.col("__n") <= rows, F.col(c))
    held = numbered.running(**{f"__sum_{c}": ("sum", early(c)) for c in columns},
                            **{f"__cnt_{c}": ("count", early(c)) for c in columns})
    done = held.select(**{f"{c}_baseline": F.try_divide(F.col(f"__sum_{c}"), F.col(f"__cnt_{c}")) for c in columns})
    return done.using(done.df.drop("__n", *[f"__{k}_{c}" for k in ("sum", "cnt") for c in columns]))


def growing_median_baseline(s: Series, column: str, name: str, rows: int = 5) -> Series:
    numbered = s.number("__n").trailing(rows, lambda f: {"__so_far": F.percentile(column, 0.5).over(f.last(rows))})
    frozen = numbered.totals(__frozen=F.max_by("__so_far", F.when(F.col("__n") <= rows, F.col("__n"))))
    done = frozen.select(**{name: F.when(F.col("__n") <= rows, F.col("__so_far")).otherwise(F.col("__frozen"))})
    return done.using(done.df.drop("__n", "__so_far", "__frozen"))


def difference_from_first(s: Series, columns: Sequence[str], suffix: str = "_relative_first") -> Series:
    numbered = s.number("__n").totals(**{f"__first_{c}": F.min_by(c, F.col("__n")) for c in columns})
    done = numbered.select(**{c + suffix: F.col(c) - F.col(f"__first_{c}") for c in columns})
    return done.using(done.df.drop("__n", *[f"__first_{c}" for c in columns]))


def lagged_slope(s: Series, column: str, order: str, lags: Sequence[int], prefix: str | None = None) -> Series:
    prefix = prefix or f"{column}_slope"
    return s.trailing(max(lags) + 1, lambda f: {
        f"{prefix}_{k}": F.coalesce(F.try_divide(
            F.col(column) - F.lag(column, k).over(f.ordered), F.col(order) - F.lag(order, k).over(f.ordered)), F.lit(0.0))
        for k in lags})


def regression_slope(s: Series, column: str, order: str, windows: Sequence[int], prefix: str) -> Series:
    """Least-squares slope over trailing windows; 0 where fewer than two rows exist."""
    return s.trailing(max(windows), lambda f: {
        f"{prefix}_{w}": F.coalesce(F.regr_slope(F.col(column), F.col(order)).over(f.last(w)), F.lit(0.0)) for w in windows})


def theil_sen_slope(s: Series, column: str, order: str, windows: Sequence[int], prefix: str) -> Series:
    """Median of all pairwise slopes of the last w points (the window bounds the pairs)."""
    widest, names = max(windows), [f"{prefix}_{w}" for w in windows]

    def make():
        held = {"x": np.empty(0), "y": np.empty(0), "rank": np.empty(0, dtype=int)}

        def step(pdf, fresh):
            start = np.where(fresh, np.arange(len(pdf)), -1)
            first = np.maximum.accumulate(start)
            carried = held["rank"][-1] + 1 if len(held["rank"]) else 0
            rank = np.where(first >= 0, np.arange(len(pdf)) - first, np.arange(len(pdf)) + carried)
            x, y = np.r_[held["x"], pdf[order].to_numpy(float)], np.r_[held["y"], pdf[column].to_numpy(float)]
            out = {n: pairwise_median_slopes(x, y, rank, len(held["x"]), w) for n, w in zip(names, windows)}
            keep = widest - 1
            held.update(x=x[-keep:], y=y[-keep:], rank=rank[-1:])
            return out

        return step

    return s.swept(widest, names, make)


def pairwise_median_slopes(x, y, rank, offset: int, window: int, chunk: int = 4096):
    """For each row (at ``offset`` + i in x, y) the median slope over its last ``window`` rows of the unit."""
    near, far = np.triu_indices(window, k=1)
    result = np.zeros(len(rank))
    for begin in range(0, len(rank), chunk):
        r = rank[begin:begin + chunk]
        at = offset + begin + np.arange(len(r))
        older, newer = at[:, None] - far, at[:, None] - near
        inside = r[:, None] >= far
        older, newer = np.where(inside, older, at[:, None]), np.where(inside, newer, at[:, None])
        run = np.where(inside, x[newer] - x[older], 1.0)
        slopes = np.where(inside, (y[newer] - y[older]) / run, np.inf)
        slopes.sort(axis=1)
        points = np.minimum(r + 1, window)
        count = points * (points - 1) // 2
        rows = np.arange(len(r))
        low, high = slopes[rows, np.maximum((count - 1) // 2, 0)], slopes[rows, np.minimum(count // 2, slopes.shape[1] - 1)]
        some = count > 0
        result[begin:begin + chunk][some] = (low[some] + high[some]) / 2
    return result


def declining(slope: Column) -> Column:
    return slope < DECLINE_SLOPE


def life_proxy(margin: Column, slope: Column) -> Column:
    """Steps until the margin is used up at the present slope, within [0, ceiling]."""
    steps = F.when(declining(slope), margin / -F.least(slope, F.lit(DECLINE_SLOPE))).otherwise(F.lit(LIFE_CEILING))
    return F.least(F.greatest(steps, F.lit(0.0)), F.lit(LIFE_CEILING))


def segments(s: Series, position: str, name: str = "segment") -> Series:
    """Running number of unbroken stretches: a step other than +1 opens a new one."""
    marked = s.trailing(2, lambda f: {"__break": F.coalesce(
        (F.col(position) - F.lag(position).over(f.ordered) != 1).cast("int"), F.lit(0))})
    done = marked.running(**{name: ("sum", F.col("__break"))})
    return done.using(done.df.drop("__break"))


def persistence(s: Series, vote: str, window: int, required: int, name: str = "alert") -> Series:
    """1 when at least ``required`` of the last ``window`` votes of the unit are 1."""
    if not 1 <= required <= window:
        raise ValueError("persistence needs 1 <= required <= window")
    return s.trailing(window, lambda f: {name: (F.sum(vote).over(f.last(window)) >= required).cast("int")})


def segmented_persistence(df: DataFrame, unit: Sequence[str], position: str, vote: str,
                          window: int, required: int, name: str = "alert", **layout) -> Series:
    """Persistence that restarts after every gap in the positions."""
    cut = segments(series(df, unit, position, **layout), position)
    return persistence(cut.refine(["segment"]), vote, window, required, name)


def last_rows(df: DataFrame, unit: Sequence[str], order: Sequence[Column], rows: int, name: str = "row_from_end") -> DataFrame:
    """The final ``rows`` rows per unit; Spark trims to the limit before its shuffle."""
    w = Window.partitionBy(*unit).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= rows)


def terminal_rows(df: DataFrame, unit: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each unit, by a partially aggregated max_by rather than a sort."""
    key = F.struct(*order)
    whole = F.max_by(F.struct(*df.columns), key).alias("__row")
    return df.groupBy(*[F.col(u).alias(f"__u_{u}") for u in unit]).agg(whole).select("__row.*")


def checkpoints(s: Series, fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """Rows at fixed shares of each trajectory: position max(0, ceil(f n) - 1)."""
    sized = s.number("__n").totals(__rows=F.count("*"))
    spots = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(float(f)) * F.col("__rows"))).cast("long") for f in fractions])
    return sized.frame.filter(F.array_contains(spots, F.col("__n"))).drop("__n", "__rows")


def mission_phase(s: Series, position: str, bins: int = 6) -> Series:
    """Share of the trajectory flown, its cycle encoding and bin (uses the unit's last position)."""
    span = s.totals(__last=F.max(position))
    phase = (F.col(position) - 1) / F.greatest(F.col("__last") - 1, F.lit(1))
    done = span.select(phase=phase)
    done = done.select(phase_sin=F.sin(2 * F.pi() * F.col("phase")), phase_cos=F.cos(2 * F.pi() * F.col("phase")),
                       phase_bin=F.least(F.floor(F.col("phase") * bins), F.lit(bins - 1)).cast("int"))
    return done.using(done.df.drop("__last"))


def transitions(s: Series, column: str, name: str = "changed") -> Series:
    return s.trailing(2, lambda f: {name: F.coalesce(
        (F.col(column) != F.lag(column).over(f.ordered)).cast("int"), F.lit(0))})


def contiguous_blocks(s: Series, blocks: int, name: str = "block") -> Series:
    """Near-equal contiguous blocks (0-based); the first n mod k blocks get one row more."""
    sized = s.number("__n").totals(__rows=F.count("*"))
    base, extra = F.floor(F.col("__rows") / blocks), F.pmod(F.col("__rows"), F.lit(blocks))
    spot = F.col("__n") - 1
    long_part = extra * (base + 1)
    block = F.when(spot < long_part, F.floor(spot / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(spot - long_part, base)))
    done = sized.select(**{name: block.cast("int")})
    return done.using(done.df.drop("__n", "__rows"))
