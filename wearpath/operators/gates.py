"""Acceptance gates over metric tables: boolean checks and the reasons for a refusal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, notes
from .metrics import PHASES, balanced_scores

TOLERANCE = 1e-10
RETENTION_TOLERANCE = 1e-8
PROTOCOL_KEYS = ("unit_mean_mae", "unit_mean_rmse", "worst_unit_mae", "near_failure_unit_mae", "near_failure_over_by_10_rate",
                 *[f"{p}_unit_mean_{k}" for p in PHASES for k in ("mae", "rmse")])


def protocol_checks(candidate: DataFrame, reference: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Balanced-phase error at least 1 % better and nothing else worse, from two aligned prediction sets."""
    marked = candidate.withColumn("version", F.lit("new")).unionByName(reference.withColumn("version", F.lit("old")))
    scores = balanced_scores(marked, [*by, "version"])
    names = ["balanced_phase_mae", *PROTOCOL_KEYS]
    wide = scores.groupBy(*by).agg(F.min("complete").alias("complete"), *[
        F.max(F.when(F.col("version") == v, F.col(n))).alias(f"{v}_{n}") for v in ("new", "old") for n in names])
    new, old = F.col("new_balanced_phase_mae"), F.col("old_balanced_phase_mae")
    checks = {"balanced_phase_mae_improves_1pct": (new <= 0.99 * old) & (new < old - TOLERANCE)}
    # Without near-failure rows on either side the check cannot pass.
    checks |= {f"{n}_no_worse": F.coalesce(F.col(f"new_{n}") <= F.col(f"old_{n}") + TOLERANCE, F.lit(False)) for n in PROTOCOL_KEYS}
    out = wide.select(*by, "complete", *[c.alias(n) for n, c in checks.items()])
    every = F.col("complete")
    for n in checks:
        every = every & F.col(n)
    return out.withColumn("eligible", every)


def nonregression(metrics: DataFrame, by: Sequence[str], gain: float = 0.01) -> DataFrame:
    """One row per task and candidate with the reasons against it; fails closed on missing values.

    ``metrics``: by..., mae, rmse, width, coverage, audit_mae and the baseline_ version of each,
    plus is_baseline and inner_eligible.
    """
    names = ("mae", "rmse", "width", "coverage", "audit_mae")
    whole = F.lit(True)
    for n in names:
        for column in (F.col(n), F.col(f"baseline_{n}")):
            sane = column.between(0, 1) if n == "coverage" else column >= 0
            whole = whole & F.coalesce(finite(column) & sane, F.lit(False))
    worse = lambda n: F.coalesce(F.col(n) > F.col(f"baseline_{n}") + RETENTION_TOLERANCE, F.lit(False))
    reasons = notes(
        (~whole, "incomplete or invalid metrics"), (worse("mae"), "mae is worse"), (worse("rmse"), "rmse is worse"),
        (worse("width"), "interval is wider"),
        (F.coalesce(F.col("coverage") < F.col("baseline_coverage") - RETENTION_TOLERANCE, F.lit(False)), "coverage is lower"),
        (F.coalesce(F.col("audit_mae") > (1 - gain) * F.col("baseline_audit_mae"), F.lit(True)), "audit gain below 1 %"),
        (F.coalesce(F.col("is_baseline"), F.lit(True)), "candidate is the baseline"),
        (~F.coalesce(F.col("inner_eligible"), F.lit(False)), "not eligible inside the fitting groups"))
    return metrics.select(*by, F.concat_ws("; ", reasons).alias("reasons"), (F.size(reasons) == 0).alias("passes"))


def target_gate(checks: dict[str, Column]) -> dict[str, Column]:
    """conditional_pass when every target holds, else fail; unknown counts as failed."""
    held = F.lit(True)
    for c in checks.values():
        held = held & F.coalesce(c, F.lit(False))
    return {**{n: F.coalesce(c, F.lit(False)) for n, c in checks.items()},
            "gate": F.when(held, "conditional_pass").otherwise("fail")}


def roll_up(gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Worst gate of each group."""
    return gates.groupBy(*by).agg(F.when(F.min((F.col("gate") == "conditional_pass").cast("int")) == 1, "conditional_pass")
                                  .otherwise("fail").alias("gate"), F.count("*").alias("tasks"))
