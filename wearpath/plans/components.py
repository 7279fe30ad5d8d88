"""Exploration, baselines, readiness and label audit over all five components in one pass of queries each.

Every component is brought to one shape, a unit with a fold, features and a target; the same operators then work on all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import calibrate, gates, learn, metrics, profile
from ..operators.selection import best
from ..session import materialise, shared_folder
from ..sources import artefacts, sinks
from .inputs import waveform_rows
from .jobs import prepared
from .registry import flag, query, r, rs
from .stores import _TABLES

# Component: key, unit of the folds, features, target, and the tolerances of its gate (mean error and root of squares, as shares of the target's deviation).
TASKS = {
    "engine": ("event_id", "user_id", ("value_mean_5", "cycle", "value"), "rul", 1.2, 1.4),
    "battery": ("o_orderkey", "o_custkey", ("discharge_cycle", "initial_valid_capacity"), "soh_percent", 0.9, 1.1),
    "hydraulic": ("cycle_id", "cycle_id", ("emb_std", "emb_mean", "emb_slope"), "emb_range", 0.7, 0.8),
    "fuel_system": ("user_id", "user_id", ("duration_seconds", "current_abs_mean"), "charge_throughput_ah", 0.5, 0.6),
    "landing_gear": ("p_partkey", "p_partkey", ("p_size",), "p_retailprice", 0.9, 1.1),
}


def tasks(spark, d):
    """component -> (key, unit, fold, features as doubles, y), rows with a target and all features."""
    out = {}
    for name, frame in prepared(spark, d).items():
        key, unit, features, target, *_ = TASKS[name]
        rows = frame.select(F.col(key).cast("long").alias("key"), F.col(unit).cast("long").alias("unit"), F.pmod(F.col(unit), F.lit(5)).cast("int").alias("fold"),
                            *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("y"))
        out[name] = rows
    return out


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _task_sql(name):
    key, unit, features, target, *_ = TASKS[name]
    return f"SELECT '{name}' AS component, CAST({key} AS BIGINT) AS key, CAST({unit} AS BIGINT) AS unit, CAST({unit} % 5 AS INTEGER) AS fold, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in features)}, CAST({target} AS DOUBLE) AS y FROM {name}"


@query("job_03b_component_profiles", f"{_TABLES} " + " UNION ALL ".join(
    f"SELECT '{n}' AS component, '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS missing, {rs(f'avg({c})', 1)} AS mean, {rs(f'stddev_samp({c})', 1)} AS std, {rs(f'min({c})', 1)} AS low, {rs(f'max({c})', 1)} AS high, {rs(f'corr({c}, y)', 4)} AS correlation FROM ({_task_sql(n)})"
    for n, (_, _, features, *_) in TASKS.items() for c in features))
def component_profiles(spark, d):
    """Shape, gaps and correlation with the target of every feature of every component."""
    out = []
    for name, rows in tasks(spark, d).items():
        features = TASKS[name][2]
        cells = [F.struct(F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"), r(F.avg(c), 1).alias("mean"), r(F.stddev_samp(c), 1).alias("std"),
                          r(F.min(c), 1).alias("low"), r(F.max(c), 1).alias("high"), r(F.corr(c, "y"), 4).alias("correlation")) for c in features]
        out.append(rows.agg(F.array(*cells).alias("x")).select(F.lit(name).alias("component"), F.inline("x")))
    return _union(out)


def out_of_fold(spark, d):
    """Out-of-fold predictions of a constant and of a linear fit for every component, in long form."""
    out = []
    for name, rows in tasks(spark, d).items():
        features = TASKS[name][2]
        known = materialise(rows.dropna(), f"task-{name}")
        means = learn.linear_oof(known.withColumn("one", F.lit(0.0)), "fold", ["one"], "y", None, name="mean")
        both = learn.linear_oof(means, "fold", features, "y", None, name="linear")
        long = sinks.long_predictions(both.select("key", "unit", F.col("y").alias("actual"), "mean", "linear"), ["key", "unit"], {"mean": "mean", "linear": "linear"})
        out.append(long.withColumn("component", F.lit(name)))
    return _union(out)


def _solve_sql(name):
    """Least squares on other folds for one, two or three features, from centred moments by elimination."""
    features = TASKS[name][2]
    p = len(features)
    p1 = f"{name}_m AS (SELECT f.fold, avg(y) AS my, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(features))}, {', '.join(f'covar_pop({c}, y) AS b{i}' for i, c in enumerate(features))}, " + ", ".join(
        f"covar_pop({features[i]}, {features[j]}) AS a{i}{j}" for i in range(p) for j in range(i, p)) + f" FROM (SELECT DISTINCT fold FROM {name}_t) f JOIN {name}_t t ON t.fold <> f.fold GROUP BY f.fold)"
    steps, last = [p1], f"{name}_m"
    if p == 1:
        steps.append(f"{name}_k AS (SELECT *, b0 / a00 AS w0 FROM {last})")
    elif p == 2:
        steps.append(f"{name}_k AS (SELECT *, (b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) AS w0, (b1 * a00 - b0 * a01) / (a00 * a11 - a01 * a01) AS w1 FROM {last})")
    else:
        det = "(a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02))"
        steps.append(f"""{name}_k AS (SELECT *, (b0 * (a11 * a22 - a12 * a12) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a12 - a11 * b2)) / {det} AS w0,
  (a00 * (b1 * a22 - a12 * b2) - b0 * (a01 * a22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02)) / {det} AS w1, (a00 * (a11 * b2 - b1 * a12) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - a11 * a02)) / {det} AS w2 FROM {last})""")
    value = " + ".join(f"w{i} * ({c} - m{i})" for i, c in enumerate(features))
    steps.append(f"{name}_p AS (SELECT component, key, unit, y AS actual, unnest(['mean', 'linear']) AS model, unnest([my, my + {value}]) AS predicted FROM {name}_t JOIN {name}_k USING (fold))")
    return ", ".join(steps)


_OOF = f"{_TABLES}, " + ", ".join(f"{n}_t AS (SELECT * FROM ({_task_sql(n)}) WHERE y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in TASKS[n][2])}), {_solve_sql(n)}" for n in TASKS) + (
    ", lp AS (" + " UNION ALL ".join(f"SELECT component, key, unit, actual, model, predicted FROM {n}_p" for n in TASKS) + ")")


@query("job_04b_component_baselines", f"""{_OOF}, per_unit AS (SELECT component, model, unit, avg(abs(predicted - actual)) AS mae FROM lp GROUP BY 1, 2, 3)
  SELECT component, model, count(*) AS rows, {rs('avg(abs(predicted - actual))', 3)} AS mae, {rs('sqrt(avg((predicted - actual) ** 2))', 3)} AS rmse, (SELECT {rs('avg(mae)', 3)} FROM per_unit x WHERE x.model = lp.model AND x.component = lp.component) AS unit_mean_mae FROM lp GROUP BY component, model""")
def component_baselines(spark, d):
    """Out-of-fold scores of two baselines for each component; the predictions are kept as an artefact and scored from there."""
    place = shared_folder(spark, "baselines")
    artefacts.save(spark, place, "v1", {"predictions": out_of_fold(spark, d)})
    long = artefacts.load(spark, place, "v1").tables["predictions"]
    scores = metrics.regression_scores(F.col("actual"), F.col("predicted"))
    per = long.groupBy("component", "model").agg(F.count("*").alias("rows"), r(scores["mae"], 3).alias("mae"), r(scores["rmse"], 3).alias("rmse"))
    units = long.groupBy("component", "model", "unit").agg(F.avg(F.abs("error")).alias("e")).groupBy("component", "model").agg(r(F.avg("e"), 3).alias("unit_mean_mae"))
    return per.join(units, ["component", "model"])


def _gate_sql():
    return "CASE component " + " ".join(f"WHEN '{n}' THEN mae <= {t[4]} * spread AND rmse <= {t[5]} * spread" for n, t in TASKS.items()) + " END"


@query("job_05b_component_readiness", f"""{_OOF}, e AS (SELECT *, abs(predicted - actual) AS e, row_number() OVER (PARTITION BY component, model ORDER BY abs(predicted - actual)) AS n, count(*) OVER (PARTITION BY component, model) AS c FROM lp),
  q AS (SELECT component, model, max(e) FILTER (n = least(ceil((c + 1) * CAST(0.9 AS DOUBLE)), c)) AS radius FROM e GROUP BY 1, 2),
  s AS (SELECT component, model, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse, stddev_pop(actual) AS spread, any_value(radius) AS radius, avg(CAST(abs(predicted - actual) <= radius AS INTEGER)) AS coverage FROM lp JOIN q USING (component, model) GROUP BY 1, 2),
  w AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY round(rmse, 6), model) = 1 AS selected FROM s)
  SELECT component, model, {rs('rmse', 3)} AS rmse, {rs('radius', 3)} AS radius, {rs('coverage', 2)} AS coverage, CASE WHEN {_gate_sql()} THEN 'conditional_pass' ELSE 'fail' END AS gate FROM w WHERE selected""")
def component_readiness(spark, d):
    """Selection by root mean square error, 90 % interval and gate for each component, from one set of out-of-fold predictions."""
    long = materialise(out_of_fold(spark, d), "predictions")
    by = ["component", "model"]
    radius = calibrate.conformal_radius(long, "error", 0.1, by)
    covered = long.join(radius, by).groupBy(*by).agg(
        F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.stddev_pop("actual").alias("spread"), F.max("radius").alias("radius"),
        F.avg((F.abs("error") <= F.col("radius")).cast("int")).alias("coverage"))
    chosen = best(covered, [F.round("rmse", 6), F.col("model")], ["component"])
    limit = lambda i: F.element_at(F.create_map(*[x for n, t in TASKS.items() for x in (F.lit(n), F.lit(t[i]))]), F.col("component")) * F.col("spread")
    gate = gates.target_gate({"mae_ok": F.col("mae") <= limit(4), "rmse_ok": F.col("rmse") <= limit(5)})["gate"]
    return chosen.select("component", "model", r("rmse", 3).alias("rmse"), r("radius", 3).alias("radius"), r("coverage", 2).alias("coverage"), gate.alias("gate"))


_LABELS = {"engine": ("CASE WHEN rul <= 10 THEN 'near' WHEN rul <= 30 THEN 'middle' ELSE 'far' END", "user_id", "rul IS NULL"), "battery": ("rul_label_status", "o_custkey", "NOT valid_capacity"),
           "fuel_system": ("CASE WHEN sample_count < 50 THEN 'short' ELSE 'long' END", "user_id", "charge_throughput_ah IS NULL"), "landing_gear": ("fault", "p_partkey", "p_size IS NULL")}


@query("job_09b_component_labels", f"{_TABLES} " + " UNION ALL ".join(
    f"SELECT '{n}' AS component, {label} AS label, count(*) AS rows, count(DISTINCT {unit}) AS units, count(*) FILTER ({bad}) AS invalid FROM {n} GROUP BY ALL" for n, (label, unit, bad) in _LABELS.items())
    + " UNION ALL SELECT 'hydraulic', CAST(label AS VARCHAR), count(*), count(DISTINCT cycle_id), count(*) FILTER (len(samples) <> 64) FROM wave GROUP BY ALL")
def component_labels(spark, d):
    """How the labels of every component are spread, and rows whose label cannot be used."""
    frames = prepared(spark, d)
    out = [frames[n].groupBy(F.expr(label).alias("label")).agg(F.count("*").alias("rows"), F.count_distinct(unit).alias("units"), F.count_if(F.expr(bad)).alias("invalid")).select(F.lit(n).alias("component"), "*")
           for n, (label, unit, bad) in _LABELS.items()]
    waves = waveform_rows(spark, d).groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("rows"), F.count_distinct("cycle_id").alias("units"), F.count_if(F.size("samples") != 64).alias("invalid"))
    return _union([*out, waves.select(F.lit("hydraulic").alias("component"), "*")])
