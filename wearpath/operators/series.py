"""Ordered per-unit windows that survive a unit holding a large share of all rows.

`series()` counts rows per unit (one pruned, partially aggregated scan). When no
unit exceeds ``block_rows`` every window partitions by the unit, so all features
of a table share one exchange and one sort. When some unit is larger, rows get
their exact position inside the unit and are cut into blocks of ``block_rows``:

* bounded frames copy the last ``rows - 1`` rows of a block into the next block;
* running aggregates add the carry of the earlier blocks;
* whole-unit aggregates become a group-by joined back (AQE splits the hot side).

The positioned rows are written once, as every window and aggregate over them would place them anew.
Results are identical in both layouts; no task ever holds more than one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import wall_micros
from ..session import materialise

BLOCK_ROWS = 1_000_000
MAX_SPLITS = 8192
BROADCAST_ROWS = 1_000_000
POSITION, BLOCK, TARGET = "__position", "__block", "__target"
_SPLITS, _CHUNK, _OFFSET = "__splits", "__chunk", "__offset"


def bisect_right(splits: Column, x: Column, steps: int = 14) -> Column:
    """How many entries of an ascending array are <= x, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))

    def halve(state, _):
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), state["hi"].alias("hi"))
        left = F.struct(state["lo"].alias("lo"), mid.alias("hi"))
        return F.when(state["lo"] >= state["hi"], state).when(F.get(splits, mid) <= x, right).otherwise(left)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):  # daylight saving must not fold the order
        return wall_micros(F.col(name).cast("timestamp_ntz")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise ValueError(f"leading order column {name!r} must be numeric or a date/time to split a large unit")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null meets null, as grouping has it."""
    other = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__key_{k}"]) for k in keys])
    return left.join(other, condition, how).drop(*[f"__key_{k}" for k in keys])


@dataclass(frozen=True)
class Frames:
    """Window specifications offered to feature builders."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, rows: int):
        return self.ordered.rowsBetween(-(rows - 1), 0)

    def before(self, rows: int):
        return self.ordered.rowsBetween(-rows, -1)


# Called per Arrow batch with the rows and a flag per row "first of its unit"; gives the new columns.
Sweep = Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]]


def _sweep(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str], make: Callable[[], Sweep]) -> DataFrame:
    """Sort each partition in the JVM (it may spill) and stream it through ``make()``'s step.

    A step keeps what it needs of a unit between batches, so no unit is ever held whole.
    """
    keys, schema = list(keys), T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        step, before = make(), None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            fresh = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                values = pdf[k].to_numpy()
                fresh[1:] |= values[1:] != values[:-1]
            fresh[0] = before is None or any(pdf[k].iloc[0] != v for k, v in zip(keys, before))
            before = [pdf[k].iloc[-1] for k in keys]
            yield pdf.assign(**step(pdf, fresh))

    placed = df.repartition(*keys) if keys else df.coalesce(1)  # no unit: at most one block of rows
    return placed.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class Series:
    df: DataFrame
    unit: tuple[str, ...]
    order: tuple[str, ...]
    block_rows: int
    blocked: bool

    # -- plumbing ---------------------------------------------------------------
    def using(self, df: DataFrame) -> "Series":
        """Same layout over a frame that kept this series' columns and rows' order."""
        return replace(self, df=df)

    def select(self, **columns: Column) -> "Series":
        return self.using(self.df.withColumns(columns))

    @property
    def frame(self) -> DataFrame:
        """The rows without layout columns."""
        return self.df.drop(POSITION, BLOCK)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.unit + (BLOCK,) if self.blocked else self.unit

    def refine(self, extra: Sequence[str], order: str | Sequence[str] | None = None) -> "Series":
        """Smaller units inside these ones. No unit grew, so a layout without blocks needs no new count."""
        order = self.order if order is None else ((order,) if isinstance(order, str) else tuple(order))
        if self.blocked:
            return series(self.frame, self.unit + tuple(extra), order, self.block_rows)
        return Series(self.df, self.unit + tuple(extra), order, self.block_rows, False)

    # -- operators --------------------------------------------------------------
    def number(self, name: str) -> "Series":
        """1-based position of each row in its unit."""
        if self.blocked:
            return self.select(**{name: F.col(POSITION)})
        w = Window.partitionBy(*self.unit).orderBy(*self.order)
        return self.select(**{name: F.row_number().over(w).cast("long")})

    def trailing(self, rows: int, build: Callable[[Frames], dict[str, Column]]) -> "Series":
        """Columns over frames that look back at most ``rows - 1`` rows."""
        if not self.blocked:
            return self.select(**build(Frames(self.unit, self.order)))
        built = self._with_copies(rows).withColumns(build(Frames(self.unit + (TARGET,), (POSITION,))))
        return self.using(built.filter(F.col(TARGET) == F.col(BLOCK)).drop(TARGET))

    def _with_copies(self, rows: int) -> DataFrame:
        """The last ``rows - 1`` rows of every block once more for the block after it."""
        reach = rows - 1
        if reach >= self.block_rows:
            raise ValueError("a frame may not exceed the block size")
        near_end = F.pmod(F.col(POSITION) - 1, F.lit(self.block_rows)) >= self.block_rows - reach
        both = F.array(F.col(BLOCK), F.col(BLOCK) + 1)
        return self.df.withColumn(TARGET, F.explode(F.when(near_end, both).otherwise(F.array(BLOCK))))

    def swept(self, rows: int, names: Sequence[str], make: Callable[[], Sweep]) -> "Series":
        """Like `trailing`, for features that need numpy: sorted rows pass by in Arrow batches."""
        if not self.blocked:
            return self.using(_sweep(self.df, self.unit, self.order, names, make))
        built = _sweep(self._with_copies(rows), self.unit + (TARGET,), (POSITION,), names, make)
        return self.using(built.filter(F.col(TARGET) == F.col(BLOCK)).drop(TARGET))

    def totals(self, **aggregates: Column) -> "Series":
        """Whole-unit aggregates on every row."""
        if not self.blocked:
            w = Window.partitionBy(*self.unit)
            return self.select(**{name: agg.over(w) for name, agg in aggregates.items()})
        per_unit = self.df.groupBy(*self.unit).agg(*[a.alias(n) for n, a in aggregates.items()])
        if not self.unit:
            return self.select(**{n: per_unit.select(n).scalar() for n in aggregates})
        return self.using(null_safe_join(self.df, per_unit, self.unit, "left"))

    def running(self, reverse: bool = False, **aggregates: tuple[str, Column]) -> "Series":
        """Aggregates from the unit's first row to this one (or from this one to the last).

        Kinds: ``sum``, ``count``, ``min``, ``max``, ``last`` (latest non-null value; the
        nearest following non-null value when reversed).
        """
        # Backwards means forwards over the descending order: a frame up to unboundedFollowing would
        # be evaluated anew for every row.
        span, rest = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
        turn = F.desc if reverse else F.asc

        def fold(kind, column):
            if kind == "last":
                return F.last(column, ignorenulls=True)
            return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](column)

        order = (POSITION,) if self.blocked else self.order
        local = Window.partitionBy(*self.keys).orderBy(*[turn(c) for c in order]).rowsBetween(*span)
        numbered = self.df.withColumns({n: fold(k, c).over(local) for n, (k, c) in aggregates.items()})
        if not self.blocked:
            return self.using(numbered)

        # One row per block, folded exclusively over the unit's blocks.
        def summary(kind, column):
            if kind == "last":
                present = F.when(column.isNotNull(), F.col(POSITION))
                return (F.min_by if reverse else F.max_by)(column, present)
            return fold(kind, column)

        per_block = self.df.groupBy(*self.keys).agg(*[summary(k, c).alias(n) for n, (k, c) in aggregates.items()])
        over_blocks = Window.partitionBy(*self.unit).orderBy(turn(BLOCK)).rowsBetween(*rest)
        carried = {n: f"__carry_{n}" for n in aggregates}
        again = {n: ("sum" if k == "count" else k) for n, (k, _) in aggregates.items()}
        carry = per_block.select(
            *self.keys, *[fold(again[n], F.col(n)).over(over_blocks).alias(carried[n]) for n in aggregates]
        )
        joined = null_safe_join(numbered, carry, self.keys, "left")

        def merge(name, kind):
            here, there = F.col(name), F.col(carried[name])
            if kind in ("sum", "count"):
                return F.coalesce(here + there, here, there)
            if kind == "last":
                return F.coalesce(here, there)
            return (F.least if kind == "min" else F.greatest)(here, there)

        merged = joined.withColumns({n: merge(n, k) for n, (k, _) in aggregates.items()})
        return self.using(merged.drop(*carried.values()))

    def ewm(self, spans: dict[str, tuple[str, int]]) -> "Series":
        """Recursive exponential means, ``y = a*x + (1-a)*y_prev`` seeded with the first value.

        ``spans`` maps an output name to (input column, span). Each task runs pandas over
        one bounded block; a block's effect on later rows is one number, its last value.
        """
        names = list(spans)

        def make() -> Sweep:
            level: dict[str, float] = {}

            def step(pdf, fresh):
                groups, out = np.cumsum(fresh), {}
                for name, (column, span) in spans.items():
                    x, g = pdf[column].to_numpy(float), groups
                    if not fresh[0]:  # go on from the level the unit had in the batch before
                        x, g = np.r_[level[name], x], np.r_[g[0], g]
                    y = pd.Series(x).groupby(g).ewm(span=span, adjust=False).mean().to_numpy()
                    out[name] = y[-len(pdf):]
                    level[name] = y[-1]
                return out

            return step

        order = (POSITION,) if self.blocked else self.order
        built = _sweep(self.df, self.keys, order, names, make)
        if not self.blocked:
            return self.using(built)
        # Blocks were seeded with their own first value; shift them by the carried level:
        # y_j = local_j + (1-a)^j * (carry - first), with j = 1 at the block's first row.
        # Local means are taken again only for the block ends, which are one row per block.
        ends = built.groupBy(*self.keys).agg(
            F.count("*").alias("__n"),
            *[F.max_by(n, POSITION).alias(f"__end_{n}") for n in names],
            *[F.min_by(F.col(c).cast("double"), POSITION).alias(f"__first_{n}") for n, (c, _) in spans.items()],
        )
        listed = ends.groupBy(*self.unit).agg(
            F.array_sort(F.collect_list(F.struct(BLOCK, "__n", *[f"__end_{n}" for n in names],
                                                 *[f"__first_{n}" for n in names]))).alias("__ends")
        )
        fields = ", ".join([f"{BLOCK} long", *[f"__shift_{n} double" for n in names]])
        alphas = {n: 2.0 / (span + 1) for n, (_, span) in spans.items()}

        @F.pandas_udf(f"array<struct<{fields}>>")
        def chain(column):
            def one(blocks):
                level = {n: None for n in names}
                out = []
                for b in blocks:
                    row = {BLOCK: b[BLOCK]}
                    for n in names:
                        shift = 0.0 if level[n] is None else level[n] - b[f"__first_{n}"]
                        row[f"__shift_{n}"] = shift
                        level[n] = b[f"__end_{n}"] + (1 - alphas[n]) ** b["__n"] * shift
                    out.append(row)
                return out

            return column.map(one)

        shifts = listed.select(*self.unit, F.inline(chain("__ends")))
        joined = null_safe_join(built, shifts, self.keys, "left")
        inside = F.pmod(F.col(POSITION) - 1, F.lit(self.block_rows)) + 1
        moved = {n: F.col(n) + F.pow(F.lit(1 - alphas[n]), inside) * F.col(f"__shift_{n}") for n in names}
        return self.using(joined.withColumns(moved).drop(*[f"__shift_{n}" for n in names]))


def series(df: DataFrame, unit: str | Sequence[str], order: str | Sequence[str],
           block_rows: int | None = None) -> Series:
    """Choose the layout for ordered work on ``df`` from the measured size of its largest unit.

    The bound comes from the session setting ``spark.wearpath.blockRows`` unless given.
    """
    if block_rows is None:
        block_rows = int(df.sparkSession.conf.get("spark.wearpath.blockRows", str(BLOCK_ROWS)))
    unit = (unit,) if isinstance(unit, str) else tuple(unit)
    order = (order,) if isinstance(order, str) else tuple(order)
    counts = df.groupBy(*unit).agg(F.count("*").alias("__rows"))
    size = counts.agg(
        F.max("__rows").alias("top"), F.count_if(F.col("__rows") > block_rows).alias("hot")
    ).first()
    if (size["top"] or 0) <= block_rows:
        return Series(df, unit, order, block_rows, False)
    placed = _positions(df, unit, order, counts, size["top"], size["hot"], block_rows)
    block = F.floor((F.col(POSITION) - 1) / block_rows).cast("long")
    return Series(materialise(placed.withColumn(BLOCK, block), "series"), unit, order, block_rows, True)


def _positions(df, unit, order, counts, top, hot_units, block_rows) -> DataFrame:
    """Exact row numbers: large units are cut at approximate quantiles of the leading order
    column, numbered per piece and shifted by the pieces' exact sizes."""
    pieces = min(MAX_SPLITS, max(2, 2 * math.ceil(top / block_rows)))
    fractions = [i / pieces for i in range(1, pieces)]
    lead = _as_number(df, order[0])
    small = hot_units * pieces <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    if unit:
        hot = counts.filter(F.col("__rows") > block_rows).select(*unit)
        inside = null_safe_join(df, hint(hot), unit, "left_semi")
    else:
        inside = df
    cuts = inside.groupBy(*unit).agg(
        F.array_distinct(F.percentile_approx(lead, fractions, 10 * pieces)).alias(_SPLITS)
    )
    if unit:
        marked = null_safe_join(df, hint(cuts), unit, "left")
    else:
        marked = df.withColumn(_SPLITS, cuts.scalar())
    chunk = F.coalesce(bisect_right(F.col(_SPLITS), lead), F.lit(0))
    marked = marked.withColumn(_CHUNK, chunk).drop(_SPLITS)
    sizes = marked.groupBy(*unit, _CHUNK).agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*unit).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*unit, _CHUNK, F.sum("__rows").over(earlier).alias(_OFFSET)).filter(F.col(_CHUNK) > 0)
    local = Window.partitionBy(*unit, _CHUNK).orderBy(*order)
    numbered = marked.withColumn(POSITION, F.row_number().over(local).cast("long"))
    joined = null_safe_join(numbered, hint(offsets), [*unit, _CHUNK], "left")
    return joined.withColumn(POSITION, F.col(POSITION) + F.coalesce(_OFFSET, F.lit(0))).drop(_CHUNK, _OFFSET)
