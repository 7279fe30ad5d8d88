"""Risk bands, attention levels, summaries and notes of scored requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import notes

# Life limits of the risk bands and their recommendations.
HIGH_LIFE, MEDIUM_LIFE = 30, 60
RECOMMENDATIONS = {"High": "Inspect Immediately", "Medium": "Monitor Closely", "Low": "No Immediate Action Required"}


def risk_band(rul: Column) -> Column:
    return F.when(rul <= HIGH_LIFE, "High").when(rul <= MEDIUM_LIFE, "Medium").otherwise("Low")


def recommendation(band: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv]), band)


def attention(component: Column, answered: Column, flagged: Column, fault: Column, accepted: Column, tails: Column) -> dict[str, Column]:
    """Level and reason of one component's result.

    ``flagged``: alerts in a fuel trajectory; ``fault``: landing-gear fault class; ``accepted``: the
    acceptance flags of its outputs; ``tails``: number of tail-range warnings. The order of the rules decides.
    """
    fuel = (component == "fuel-system") & (F.coalesce(flagged, F.lit(0)) > 0)
    gear = (component == "landing-gear") & (F.coalesce(fault, F.lit(0)) > 0)
    refused = F.coalesce(F.exists(accepted, lambda a: ~a), F.lit(False))
    level = (F.when(~answered, "Unavailable").when(fuel | gear, "Critical").when(refused | (F.coalesce(tails, F.lit(0)) > 0), "Caution")
             .otherwise("Monitor"))
    reason = (F.when(~answered, "no model response").when(fuel, "samples flagged").when(gear, "fault class predicted")
              .when(refused, "an output was not accepted").when(F.coalesce(tails, F.lit(0)) > 0, "input near the edge of the fitted range")
              .otherwise("no alert"))
    return {"level": level, "reason": reason}


def acceptance(accepted: Column) -> Column:
    """True when every output that carries a flag is accepted; null when none carries one."""
    known = F.array_compact(accepted)
    return F.when(F.size(known) > 0, F.forall(known, lambda a: a))


def needs_review(component: Column, accepted: Column) -> Column:
    """Fuel results always; others unless every output is accepted."""
    known = F.coalesce(F.size(accepted) > 0, F.lit(False)) & F.forall(accepted, lambda a: F.coalesce(a, F.lit(False)))
    return (component == "fuel-system") | ~F.coalesce(known, F.lit(False))


def short_number(value: Column) -> Column:
    """Up to three decimals without trailing zeros."""
    return F.call_function("format_number", value, F.lit("0.###"))


def summary(component: Column, rul: Column, soh: Column, fault: Column, flagged: Column, samples: Column) -> Column:
    # The one-line formats of the result texts.
    return (F.when(component == "engine", F.concat(F.lit("Estimated RUL: "), short_number(rul), F.lit(" cycles")))
            .when(component == "battery", F.concat(F.lit("SOH: "), short_number(soh), F.lit("%; estimated RUL: "), short_number(rul), F.lit(" cycles")))
            .when(component == "landing-gear", F.concat(F.lit("Fault: "), fault.cast("string"), F.lit("; estimated RUL: "), short_number(rul), F.lit(" percent")))
            .when(component == "fuel-system", F.concat(flagged.cast("string"), F.lit(" of "), samples.cast("string"), F.lit(" samples flagged"))))


def history_notes(records: Column, gaps: Column, out_of_order: Column, consecutive_tail: Column) -> Column:
    return notes((records < 10, "limited history"), (gaps > 0, "cycle gaps"), (out_of_order > 0, "reordered by cycle"),
                 ((records < 10) | ~consecutive_tail, "fewer than 10 consecutive recent cycles"))
