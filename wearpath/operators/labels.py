"""Target derivation: remaining life, state of health, end of life and censoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Series

# Rated capacity and the documented end-of-life capacity per battery (Ah).
RATED_CAPACITY_AH = 2.0
END_OF_LIFE_AH = {
    "B0005": 1.4, "B0006": 1.4, "B0007": 1.4, "B0018": 1.4,
    "B0033": 1.6, "B0034": 1.6, "B0036": 1.6,
    "B0038": 1.6, "B0039": 1.6, "B0040": 1.6,
    "B0041": 1.4, "B0042": 1.4, "B0043": 1.4, "B0044": 1.4,
    "B0045": 1.4, "B0046": 1.4, "B0047": 1.4, "B0048": 1.4,
    "B0053": 1.4, "B0054": 1.4, "B0055": 1.4, "B0056": 1.4,
}


def remaining_life(s: Series, order: str, name: str = "rul") -> Series:
    """Run-to-failure label: the unit's last order value minus this one."""
    done = s.totals(__last=F.max(order)).select(**{name: F.col("__last") - F.col(order)})
    return done.using(done.df.drop("__last"))


def truncated_life(s: Series, order: str, labels: DataFrame, extra: str = "additional_rul", name: str = "rul") -> Series:
    """As `remaining_life`, plus the life a label file says remained after the last row."""
    joined = s.using(s.df.join(labels, list(s.unit), "left"))
    done = remaining_life(joined, order, "__observed").select(**{name: F.col("__observed") + F.col(extra)})
    return done.using(done.df.drop("__observed", extra))


def discharge_histories(s: Series, capacity: str = "capacity", threshold: str = "eol_capacity",
                        rated: float = RATED_CAPACITY_AH) -> Series:
    """Cycle number, health, first crossing, censor status and eligibility of each discharge.

    The threshold column is null where no end of life is documented.
    """
    c, limit, cycle = F.col(capacity), F.col(threshold), F.col("discharge_cycle")
    valid = c.isNotNull() & (c > 0)
    s = s.number("discharge_cycle").select(valid_capacity=valid)
    s = s.select(soh_percent=F.when(F.col("valid_capacity"), c / rated * 100.0))
    s = s.totals(initial_valid_capacity=F.min_by(c, F.when(F.col("valid_capacity"), cycle)))
    starts_above = F.coalesce(F.col("initial_valid_capacity") > limit, F.lit(False))
    crossed = F.col("valid_capacity") & starts_above & (c <= limit)
    s = s.totals(observed_eol_cycle=F.min(F.when(crossed, cycle)))
    eol = F.col("observed_eol_cycle")
    starts_below = F.coalesce(F.col("initial_valid_capacity") <= limit, F.lit(False))
    status = (F.when(eol.isNotNull(), "observed_eol")
              .when(limit.isNull(), "no_documented_threshold")
              .when(starts_below, "starts_at_or_below_threshold")
              .otherwise("right_censored"))
    s = s.select(rul_cycles=F.when(eol.isNotNull(), F.greatest(eol - cycle, F.lit(0))),
                 at_or_after_eol=F.coalesce(cycle >= eol, F.lit(False)), rul_label_status=status)
    return s.select(rul_training_eligible=F.col("valid_capacity") & F.coalesce(cycle <= eol, F.lit(False)))


def life_phase(cycle: Column, rul: Column) -> Column:
    """Thirds of the whole life; for scoring only, as it looks at the label."""
    share = F.try_divide(cycle, cycle + rul)
    return F.when(share <= 1 / 3, "early").when(share <= 2 / 3, "middle").otherwise("late")


def rul_band(rul: Column) -> Column:
    return F.when(rul <= 30, "0-30").when(rul <= 100, "31-100").otherwise(">100")


def trajectory_third(position: Column, cuts: tuple[int, int, int] = (57, 114, 171)) -> Column:
    """Right-closed thirds of a fixed mission length; null outside (0, last cut]."""
    first, second, last = cuts
    return (F.when((position > 0) & (position <= first), "first")
            .when((position > first) & (position <= second), "second")
            .when((position > second) & (position <= last), "third"))
