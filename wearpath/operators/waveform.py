"""Waveform (array per cycle) statistics and discharge-curve summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import array_mean, array_std
from .series import series

STATISTICS = ("mean", "std", "min", "max", "range", "rms", "slope")


def waveform_statistics(samples: Column, prefix: str) -> dict[str, Column]:
    """Seven numbers of one array, computed in the row: nothing is exploded or shuffled.

    The slope is least squares against time running from 0 to 1 over the cycle.
    """
    v = F.transform(samples, lambda x: x.cast("double"))
    n = F.size(v)
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    centred = F.transform(v, lambda x, i: x * (i / (n - 1) - 0.5))
    spread = n * (n + 1) / (12.0 * (n - 1))
    out = {
        "mean": array_mean(v), "std": array_std(v), "min": F.array_min(v), "max": F.array_max(v),
        "range": F.array_max(v) - F.array_min(v), "rms": F.sqrt(squares / n),
        "slope": F.aggregate(centred, F.lit(0.0), lambda a, x: a + x) / spread,
    }
    return {f"{prefix}_{k}": c for k, c in out.items()}


def waveform_table(waveforms: DataFrame, key: str, sensors: Sequence[str]) -> DataFrame:
    """One row per cycle with the statistics of every sensor column (arrays side by side)."""
    columns = {}
    for sensor in sensors:
        columns |= waveform_statistics(F.col(sensor), sensor.lower())
    return waveforms.select(key, *[c.alias(n) for n, c in columns.items()])


def phase_statistics(samples: Column, seconds: int, hz: int, prefix: str) -> dict[str, Column]:
    """Per-second mean, deviation and mean relative to the first second, as arrays of ``seconds``."""
    v = F.transform(samples, lambda x: x.cast("double"))
    cut = lambda i: F.slice(v, i * hz + 1, hz)
    spots = F.sequence(F.lit(0), F.lit(seconds - 1))
    means = F.transform(spots, lambda i: array_mean(cut(i)))
    return {
        f"{prefix}_phase_mean": means,
        f"{prefix}_phase_std": F.transform(spots, lambda i: array_std(cut(i))),
        f"{prefix}_phase_relative": F.transform(means, lambda m: m - F.get(means, 0)),
    }


def expand(df: DataFrame, arrays: Sequence[str], length: int) -> DataFrame:
    """Fixed-length arrays to numbered columns, for sinks that need flat rows."""
    flat = [F.get(a, i).alias(f"{a}_{i:02d}") for a in arrays for i in range(length)]
    return df.select(*[c for c in df.columns if c not in arrays], *flat)


def incomplete_waveforms(df: DataFrame, key: str, samples: str, length: int) -> DataFrame:
    """Cycles with the wrong number of samples or a missing or non-finite one."""
    bad = F.exists(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    short = F.size(samples) != length
    return df.filter(short | bad).select(key, F.when(short, "length").otherwise("non_finite").alias("rule"))


def trapezoid(y: Column, t: Column, window) -> Column:
    """Area between this sample and the one before it; null at the first sample."""
    return (t - F.lag(t).over(window)) * (y + F.lag(y).over(window)) / 2


# The discharge sample columns.
CURVE = {"voltage": "Voltage_measured", "current": "Current_measured", "temperature": "Temperature_measured",
         "load_current": "Current_load", "load_voltage": "Voltage_load", "time": "Time"}


def curve_features(samples: DataFrame, key: Sequence[str], names: dict[str, str] = CURVE,
                   order: Sequence[str] | None = None, **layout) -> DataFrame:
    """The 21 summaries of each discharge curve, in one job over all curves."""
    v, i, temp, li, lv, t = (F.col(names[k]) for k in ("voltage", "current", "temperature", "load_current", "load_voltage", "time"))
    at = F.struct(*(order or [names["time"]]))
    areas = series(samples, key, order or names["time"], **layout).trailing(2, lambda f: {
        "__ah": trapezoid(F.abs(i), t, f.ordered), "__wh": trapezoid(v * F.abs(i), t, f.ordered)})
    start, end = (lambda c: F.min_by(c, at)), (lambda c: F.max_by(c, at))
    return areas.df.groupBy(*key).agg(
        F.count("*").cast("double").alias("sample_count"), (F.max(t) - F.min(t)).alias("duration_seconds"),
        start(v).alias("voltage_start"), end(v).alias("voltage_end"), F.min(v).alias("voltage_min"),
        F.max(v).alias("voltage_max"), F.avg(v).alias("voltage_mean"), F.stddev_pop(v).alias("voltage_std"),
        (start(v) - end(v)).alias("voltage_drop"), F.avg(F.abs(i)).alias("current_abs_mean"),
        F.stddev_pop(i).alias("current_std"), start(temp).alias("temperature_start"), end(temp).alias("temperature_end"),
        F.avg(temp).alias("temperature_mean"), F.max(temp).alias("temperature_max"),
        (end(temp) - start(temp)).alias("temperature_rise"), F.avg(F.abs(li)).alias("load_current_abs_mean"),
        F.avg(lv).alias("load_voltage_mean"), F.min(lv).alias("load_voltage_min"),
        (F.sum("__ah") / 3600).alias("charge_throughput_ah"), (F.sum("__wh") / 3600).alias("energy_throughput_wh"),
    ).filter(F.col("sample_count") >= 2)


def short_curves(samples: DataFrame, key: Sequence[str], least: int = 2) -> DataFrame:
    """Curves with too few samples for `curve_features`, which leaves them out: key, sample_count."""
    return samples.groupBy(*key).agg(F.count("*").alias("sample_count")).filter(F.col("sample_count") < least)


def cutoff_integrals(samples: DataFrame, key: Sequence[str], time: str, voltage: str, current: str, cutoff: float,
                     order: Sequence[str] | None = None, **layout) -> DataFrame:
    """Charge up to the first sample at or below the cutoff, crossing time interpolated.

    Later rebounds above the cutoff are ignored; curves that never cross, or start below, say so.
    """
    t, v, c = F.col(time), F.col(voltage), F.abs(F.col(current))
    s = series(samples, key, order or time, **layout).number("__n").trailing(2, lambda f: {
        "__t": F.lag(t).over(f.ordered), "__v": F.lag(v).over(f.ordered), "__c": F.lag(c).over(f.ordered),
        "__area": trapezoid(c, t, f.ordered)})
    s = s.totals(__k=F.min(F.when(v <= cutoff, F.col("__n"))))
    share = (F.col("__v") - cutoff) / (F.col("__v") - v)
    here = (F.col("__n") == F.col("__k")) & (F.col("__n") > 1)
    cross_t = F.when(here, F.col("__t") + share * (t - F.col("__t")))
    cross_c = F.when(here, F.col("__c") + share * (c - F.col("__c")))
    part = F.when(here, (cross_t - F.col("__t")) * (F.col("__c") + cross_c) / 2)
    area_to = lambda within: F.coalesce(F.sum(F.when(within, F.col("__area"))), F.lit(0.0)) / 3600
    per = s.df.groupBy(*key).agg(
        F.max("__k").alias("__k"), F.coalesce(F.sum("__area") / 3600, F.lit(0.0)).alias("full_throughput_ah"),
        area_to(F.col("__n") < F.col("__k")).alias("__above"), area_to(F.col("__n") <= F.col("__k")).alias("__below"),
        F.max(cross_t).alias("crossing_seconds"), (F.max(part) / 3600).alias("__part"))
    crossed = F.col("__k") > 1
    return per.select(
        *key,
        F.when(F.col("__k").isNull(), "no_observed_crossing").when(F.col("__k") == 1, "starts_at_or_below_cutoff")
        .otherwise("crossing_observed").alias("status"),
        "full_throughput_ah", F.when(crossed, F.col("__above") + F.col("__part")).alias("cutoff_interpolated_ah"),
        "crossing_seconds", F.when(crossed, F.col("__above")).alias("last_above_sample_ah"),
        F.when(crossed, F.col("__below")).alias("first_below_sample_ah"))
