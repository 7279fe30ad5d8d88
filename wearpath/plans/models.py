"""Model queries. Values of closed-form fits are compared; tree fits report the invariants they must keep."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import calibrate, causal, learn, metrics, profile, splits
from ..operators.joins import with_candidates
from ..operators.labels import remaining_life
from ..operators.selection import best
from ..session import materialise, table
from .inputs import CHANNELS, EV, event_series, tail
from .registry import flag, query, r, rs

FOLDS = (0, 1, 2, 3, 4)
FEATURES = ("cycle", "value", "value_mean_5", "value_std_5")


def training_rows(spark, d):
    """Trajectory rows with features, life left and a fold per user."""
    s = remaining_life(event_series(spark, d), "cycle")
    s = causal.trailing_std(causal.trailing_mean(s, ["value"], (5,)), ["value"], (5,))
    return s.frame.select("user_id", "event_id", "event_type", F.pmod("user_id", F.lit(5)).cast("int").alias("fold"),
                          *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("rul").cast("double").alias("rul"))


TR = EV + f""", tr AS (SELECT user_id, event_id, event_type, CAST(user_id % 5 AS INTEGER) AS fold, CAST(cycle AS DOUBLE) AS cycle, value, avg(value) OVER t AS value_mean_5,
  CAST(max(cycle) OVER (PARTITION BY user_id) - cycle AS DOUBLE) AS rul FROM ev WINDOW {tail(5)})"""


@query("mdl_01_training_scaling", f"""WITH m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in CHANNELS)} FROM lineitem WHERE l_returnflag <> 'R')
  SELECT l_returnflag, {', '.join(f"{rs(f'avg(({c} - m_{c}) / s_{c})', 5)} AS mean_{c}, {rs(f'max(({c} - m_{c}) / s_{c})', 5)} AS top_{c}" for c in CHANNELS)} FROM lineitem, m GROUP BY 1""")
def training_scaling(spark, d):
    """Fitted on two return flags, applied to all three; a constant column is dropped."""
    lines = table(spark, d, "lineitem").select("l_returnflag", *CHANNELS).withColumn("flat", F.lit(1.0))
    scaling = learn.fit_scaling(lines.filter("l_returnflag <> 'R'"), [*CHANNELS, "flat"])
    z = lines.select("l_returnflag", *[c.alias(n) for n, c in scaling.columns().items()])
    return z.groupBy("l_returnflag").agg(*[x for c in scaling.kept for x in (r(F.avg(c), 5).alias(f"mean_{c}"), r(F.max(c), 5).alias(f"top_{c}"))])


@query("mdl_02_baseline_predictors", f"""WITH {TR} SELECT f.fold, {rs('quantile_cont(rul, 0.5)')} AS median_rul, (SELECT event_type FROM tr x WHERE x.fold <> f.fold GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS commonest
  FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY f.fold""")
def baseline_predictors(spark, d):
    rows = training_rows(spark, d)
    middle = learn.fold_statistic(rows, "fold", FOLDS, "rul").select("fold", r("predicted").alias("median_rul"))
    away = rows.select(F.explode(F.array_remove(F.array(*[F.lit(k) for k in FOLDS]), F.col("fold"))).alias("fold"), "event_type")
    counts = away.groupBy("fold", "event_type").agg(F.count("*").alias("n"))
    commonest = best(counts, [-F.col("n"), F.col("event_type")], ["fold"]).select("fold", F.col("event_type").alias("commonest"))
    return middle.join(commonest, "fold")


@query("mdl_03_linear_regression", f"""WITH {TR}, k AS (SELECT regr_slope(rul, cycle) AS b, regr_intercept(rul, cycle) AS a FROM tr) SELECT event_id, {rs('a + b * cycle', 4)} AS predicted FROM tr, k""")
def linear_regression(spark, d):
    rows = training_rows(spark, d)
    model = learn.fit(rows, ["cycle"], learn.linear("rul"))
    return learn.apply_model(model, rows).select("event_id", r("predicted", 4).alias("predicted"))


# The error of the best constant on the same rows: a fit that learns nothing, leaks bounds or loses rows cannot beat it.
_COVER = f"""WITH {TR}, c AS (SELECT least(rul, 60) AS y, event_id FROM tr) SELECT count(*) AS rows, count(DISTINCT event_id) AS distinct_rows, 0 AS missing, 0 AS out_of_bounds,
  {rs('sqrt(var_pop(y))', 4)} AS constant_rmse, {rs('avg(y)', 4)} AS mean_target, 1 AS beats_constant, 1 AS orders_rows FROM c"""


def cover(scored, low, high):
    p, y = F.col("predicted"), F.col("rul")
    rmse = F.sqrt(F.avg((p - y) ** 2))
    return scored.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("distinct_rows"), F.count_if(p.isNull()).cast("int").alias("missing"),
                      F.count_if((p < low) | (p > high)).cast("int").alias("out_of_bounds"), r(F.stddev_pop(y), 4).alias("constant_rmse"), r(F.avg(y), 4).alias("mean_target"),
                      (rmse < 0.9 * F.stddev_pop(y)).cast("int").alias("beats_constant"), (F.corr(p, y) > 0.5).cast("int").alias("orders_rows"))


@query("mdl_04_tree_regression", _COVER)
def tree_regression(spark, d):
    """A forest and a boosted ensemble, averaged and held to the target cap."""
    rows = materialise(training_rows(spark, d).withColumn("rul", F.least("rul", F.lit(60.0))), "training")
    first = learn.apply_model(learn.fit(rows, FEATURES, learn.forest("rul", 10, 5)), rows, 0.0, 60.0, "first")
    second = learn.apply_model(learn.fit(rows, FEATURES, learn.boosted("rul", 4, 3)), first, 0.0, 60.0, "second")
    return cover(second.withColumn("predicted", learn.blend(F.col("first"), F.col("second"))), 0, 60)


@query("mdl_05_balanced_logistic", f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, count(*) AS rows, {rs('any_value(CAST((SELECT sum(n) FROM c) AS DOUBLE) / (SELECT count(*) FROM c) / c.n)')} AS weight, 0 AS unscored, 1 AS leans_to_own FROM labels JOIN c USING (quality) GROUP BY 1""")
def balanced_logistic(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("length"), F.length(F.regexp_replace("text", "[^\\n]", "")).cast("double").alias("breaks"))
    rows = learn.balanced_class_weights(table(spark, d, "labels").join(docs, "doc_id"), "quality")
    model = learn.fit(rows, ["length", "breaks"], learn.logistic("quality"))
    scored = model.transform(rows).withColumn("__p", F.get(vector_to_array("probability"), F.lit(1)))
    per = scored.groupBy("quality").agg(F.count("*").alias("rows"), r(F.max("weight")).alias("weight"),
                                        F.count_if(~F.col("prediction").isin(0.0, 1.0)).cast("int").alias("unscored"), F.avg("__p").alias("__own"))
    # A class must get more of its own probability than all documents with equal class weights do.
    even = scored.agg((F.sum(F.col("__p") * F.col("weight")) / F.sum("weight")).alias("m")).scalar()
    leans = F.when(F.col("quality") == 1, F.col("__own") > even).otherwise(F.col("__own") < even)
    return per.withColumn("leans_to_own", flag(leans)).drop("__own")


@query("mdl_06_out_of_fold", f"""WITH {TR}, k AS (SELECT f.fold, regr_slope(rul, cycle) AS b, regr_intercept(rul, cycle) AS a FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY 1)
  SELECT event_id, {rs('least(greatest(a + b * cycle, 0), 125)', 4)} AS predicted FROM tr JOIN k USING (fold)""")
def out_of_fold(spark, d):
    rows = materialise(training_rows(spark, d), "training")
    scored = learn.regression_oof(rows, "fold", FOLDS, ["cycle"], learn.linear("rul"), 0.0, 125.0)
    return scored.select("event_id", r("predicted", 4).alias("predicted"))


@query("mdl_06b_one_pass_out_of_fold", f"""WITH {TR}, k AS (SELECT f.fold, regr_slope(rul, value_mean_5) AS b, regr_intercept(rul, value_mean_5) AS a FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY 1)
  SELECT event_id, {rs('least(greatest(a + b * value_mean_5, 0), 125)', 4)} AS predicted FROM tr JOIN k USING (fold)""")
def one_pass_out_of_fold(spark, d):
    scored = learn.linear_oof(training_rows(spark, d), "fold", ["value_mean_5"], "rul", 0.0, 125.0)
    return scored.select("event_id", r("predicted", 4).alias("predicted"))


@query("mdl_07_stressed_out_of_fold", f"""WITH {TR} SELECT side, count(*) AS rows, count(DISTINCT event_id) AS distinct_rows, 0 AS bad_confidence, {rs('avg(CAST(rul <= 20 AS INTEGER))', 5)} AS near_share, 1 AS beats_constant
  FROM tr, (SELECT unnest(['clean', 'perturbed']) AS side) GROUP BY 1""")
def stressed_out_of_fold(spark, d):
    rows = materialise(training_rows(spark, d).withColumn("near", flag(F.col("rul") <= 20)), "training", ("fold",))
    return stress_report(learn.classification_oof(rows, "fold", FOLDS, FEATURES, learn.forest_classifier("near", 5, 4), ["event_id"], stress=True))


def stress_report(scored):
    """Per side, each scored row against every known class of its event id (one, where ids do not repeat), by counts per id instead of a join."""
    one = scored.filter("event_id IS NOT NULL").groupBy("side", "event_id").agg(
        F.count("*").alias("n"), F.sum("near").alias("near"), F.sum("predicted").alias("said"), F.count_if(~F.col("raw_confidence").between(0.5, 1.0)).alias("bad"))
    n, near, said = F.col("n"), F.col("near"), F.col("said")
    pairs = F.sum(n * n)
    share = F.sum(n * near).cast("double") / pairs
    right = F.sum(said * near + (n - said) * (n - near)).cast("double") / pairs
    return one.groupBy("side").agg(pairs.alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("bad") * n).cast("int").alias("bad_confidence"),
                                   r(share, 5).alias("near_share"), flag(right >= F.greatest(share, 1 - share)).alias("beats_constant"))


@query("mdl_18_condition_clusters", f"""WITH {TR}, w AS (SELECT tr.*, 1.0 / count(*) OVER (PARTITION BY user_id) AS w FROM tr), m AS (SELECT sum(w * cycle) / sum(w) AS mx, sum(w * rul) / sum(w) AS my FROM w),
  k AS (SELECT sum(w * (cycle - mx) * (rul - my)) / sum(w * (cycle - mx) ** 2) AS b FROM w, m) SELECT count(*) AS rows, 0 AS bad_sums, 0 AS bad_gates, 0 AS out_of_bounds,
  {rs('sqrt(sum(w * (my + b * (cycle - mx) - rul) ** 2) / sum(w))', 3)} AS overall_rmse, 1 AS mixture_not_worse, 3 AS conditions FROM w, m, k""")
def condition_clusters(spark, d):
    """Three weighted conditions; a local linear fit per condition mixed by gate and blended with the global fit."""
    rows = materialise(profile.equal_group_weights(training_rows(spark, d), ["user_id"]), "training")
    gated = learn.condition_gates(rows, ["value_mean_5", "value_std_5"], 3, 1.0, "weight")
    gated = materialise(gated, "gates")
    weights = {"overall": F.col("weight"), **{f"local_{i}": F.col("weight") * F.get("gates", i) for i in range(3)}}
    scored = gated.withColumns(learn.weighted_linear(gated, ["cycle"], "rul", weights))
    names = [f"local_{i}" for i in range(3)]
    mixed = F.greatest(learn.condition_blend(scored, names, "overall"), F.lit(0.0))
    total = F.aggregate("gates", F.lit(0.0), lambda a, g: a + g)
    error = lambda c: F.sqrt(F.sum(F.col("weight") * (F.col(c) - F.col("rul")) ** 2) / F.sum("weight"))
    return scored.withColumn("p", mixed).agg(
        F.count("*").alias("rows"), F.count_if(F.abs(total - 1) > 1e-9).cast("int").alias("bad_sums"),
        F.count_if(F.exists("gates", lambda g: (g < 0) | (g > 1))).cast("int").alias("bad_gates"),
        F.count_if(F.col("p").isNull() | (F.col("p") < 0)).cast("int").alias("out_of_bounds"), r(error("overall"), 3).alias("overall_rmse"),
        flag(error("p") <= error("overall")).alias("mixture_not_worse"), F.count_distinct(F.array_position("gates", F.array_max("gates"))).cast("int").alias("conditions"))


@query("mdl_19_target_transforms", f"""WITH {TR} SELECT event_id, {rs('least(rul, 40)')} AS capped, {rs('ln(1 + least(rul, 40))')} AS logged, {rs('rul + cycle')} AS lifetime, {rs('least(rul, 40)')} AS log_back, {rs('rul')} AS lifetime_back,
  {rs('0.75 * least(rul, 40) + 0.25 * rul')} AS blended FROM tr""")
def target_transforms(spark, d):
    rul, age = F.col("rul"), F.col("cycle")
    rows = training_rows(spark, d).withColumns({
        "capped": learn.encode_target(rul, age, "plain", 40.0), "logged": learn.encode_target(rul, age, "log", 40.0), "lifetime": learn.encode_target(rul, age, "lifetime")})
    return rows.select("event_id", *[r(c).alias(c) for c in ("capped", "logged", "lifetime")],
                       r(learn.decode_target(F.col("logged"), age, "log")).alias("log_back"),
                       r(learn.decode_target(F.col("lifetime"), age, "lifetime")).alias("lifetime_back"), r(learn.blend(F.col("capped"), rul, 0.25)).alias("blended"))


def _weighted_fit(w: str, where: str = "") -> str:
    return f"""wk AS (SELECT sum(w * cycle) / sum(w) AS mx, sum(w * rul) / sum(w) AS my, sum(w * cycle * cycle) / sum(w) AS xx, sum(w * cycle * rul) / sum(w) AS xy FROM ({w}) {where}),
  wf AS (SELECT (xy - mx * my) / (xx - mx * mx) AS b, my - mx * (xy - mx * my) / (xx - mx * mx) AS a FROM wk)"""


@query("mdl_20_weighted_fit", f"""WITH {TR}, {_weighted_fit('SELECT cycle, rul, 1.0 / count(*) OVER (PARTITION BY user_id) AS w FROM tr')} SELECT event_id, {rs('a + b * cycle', 4)} AS predicted FROM tr, wf""")
def weighted_fit(spark, d):
    """Every user counts the same, in the scaling as well as in the loss."""
    rows = profile.equal_group_weights(training_rows(spark, d), ["user_id"])
    model = learn.fit(rows, ["cycle"], learn.linear("rul", weight="weight"), "weight")
    return learn.apply_model(model, rows).select("event_id", r("predicted", 4).alias("predicted"))


@query("mdl_21_grid_selection", f"""WITH {TR}, g AS (SELECT unnest([-30.0, -20.0, -10.0, 0.0, 10.0]) AS shift), e AS (SELECT CAST(shift AS DOUBLE) AS shift, user_id, avg(abs(greatest(value_mean_5 + shift, 0) - rul)) AS mae FROM tr, g GROUP BY 1, 2)
  SELECT shift, {rs('avg(mae)')} AS unit_mean_mae FROM e GROUP BY 1 ORDER BY avg(mae), shift LIMIT 1""")
def grid_selection(spark, d):
    """All offsets scored from one scan; units count equally; the first best wins."""
    grid = [{"shift": s} for s in (-30.0, -20.0, -10.0, 0.0, 10.0)]
    rows = with_candidates(training_rows(spark, d), grid).select(
        F.col("candidate.shift").alias("shift"), F.col("user_id").alias("unit"), F.col("rul").alias("actual"),
        F.greatest(F.col("value_mean_5") + F.col("candidate.shift"), F.lit(0.0)).alias("predicted"))
    scores = metrics.unit_mean_scores(rows, "unit", ["shift"])
    return best(scores, [F.col("mae"), F.col("shift")]).select("shift", r("mae").alias("unit_mean_mae"))


_PART = """gr AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || CAST(user_id AS VARCHAR))) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT user_id FROM events)),
  pt AS (SELECT tr.*, CASE WHEN n - 1 < floor(c * CAST(0.6 AS DOUBLE)) THEN 'fit' WHEN n - 1 < floor(c * CAST(0.8 AS DOUBLE)) THEN 'calibration' ELSE 'evaluation' END AS part FROM tr JOIN gr USING (user_id))"""


@query("mdl_26_disjoint_audit", f"""WITH {TR}, {_PART}, f AS (SELECT regr_slope(rul, cycle) AS b, regr_intercept(rul, cycle) AS a FROM pt WHERE part = 'fit'), s AS (SELECT part, rul, greatest(a + b * cycle, 0) AS p FROM pt, f),
  q AS (SELECT max(e) FILTER (n = least(ceil((c + 1) * CAST(0.9 AS DOUBLE)), c)) AS radius FROM (SELECT abs(p - rul) AS e, row_number() OVER (ORDER BY abs(p - rul)) AS n, count(*) OVER () AS c FROM s WHERE part = 'calibration'))
  SELECT count(*) AS rows, {rs('avg(abs(p - rul))', 5)} AS mae, {rs('any_value(radius)', 4)} AS radius, {rs('avg(CAST(rul BETWEEN greatest(p - radius, 0) AND p + radius AS INTEGER))', 3)} AS coverage FROM s, q WHERE part = 'evaluation'""")
def disjoint_audit(spark, d):
    """Fit, calibrate and evaluate on disjoint users."""
    rows = materialise(splits.three_way(training_rows(spark, d), "user_id"), "training")
    model = learn.fit(rows.filter("part = 'fit'"), ["cycle"], learn.linear("rul"))
    scored = learn.apply_model(model, rows, 0.0).select("part", F.col("rul").alias("actual"), "predicted")
    errors = scored.filter("part = 'calibration'").withColumn("e", F.col("predicted") - F.col("actual"))
    radius = calibrate.conformal_radius(errors, "e", 0.10).first()["radius"]
    held = scored.filter("part = 'evaluation'").withColumns(calibrate.interval(F.col("predicted"), F.lit(radius)))
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    return held.agg(F.count("*").alias("rows"), r(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 5).alias("mae"), r(F.lit(radius), 4).alias("radius"),
                    r(F.avg(flag(inside)), 3).alias("coverage"))


@query("mdl_27_paired_out_of_fold", f"""WITH {TR}, k AS (SELECT f.fold, quantile_cont(rul, 0.5) AS med, avg(rul) AS mean FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY 1)
  SELECT event_id, fold, rul AS actual, {rs('med')} AS old_predicted, {rs('mean')} AS new_predicted, CAST(abs(mean - rul) < abs(med - rul) AS INTEGER) AS improved FROM tr JOIN k USING (fold)""")
def paired_out_of_fold(spark, d):
    """Two predictors on identical folds, joined per fold rather than per row."""
    rows = training_rows(spark, d)
    old = learn.fold_statistic(rows, "fold", FOLDS, "rul").withColumnRenamed("predicted", "old")
    new = learn.fold_statistic(rows, "fold", FOLDS, "rul", "mean").withColumnRenamed("predicted", "new")
    both = rows.join(F.broadcast(old.join(new, "fold")), "fold")
    wins = F.abs(F.col("new") - F.col("rul")) < F.abs(F.col("old") - F.col("rul"))
    return both.select("event_id", "fold", F.col("rul").alias("actual"), r("old").alias("old_predicted"), r("new").alias("new_predicted"), flag(wins).alias("improved"))


_SHARES = {"view": 0.6, "click": 0.1, "error": 0.1, "purchase": 0.1, "signup": 0.1}
_MIX = "SELECT cycle, rul, CASE t.event_type WHEN 'view' THEN 0.6 ELSE 0.1 END / u.n / count(*) OVER (PARTITION BY t.event_type, user_id) AS w FROM tr t JOIN (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1) u ON u.event_type = t.event_type"


@query("mdl_28_cross_source_fit", f"""WITH {TR}, {_weighted_fit(_MIX)} SELECT event_id, {rs('greatest(a + b * cycle, 0)', 4)} AS predicted FROM tr, wf WHERE event_type = 'view'""")
def cross_source_fit(spark, d):
    """The target source keeps 60 % of the weight, the others share the rest; scored on the target source."""
    rows = profile.mixture_weights(training_rows(spark, d), "event_type", "user_id", _SHARES)
    model = learn.fit(rows, ["cycle"], learn.linear("rul", weight="weight"), "weight")
    return learn.apply_model(model, rows.filter("event_type = 'view'"), 0.0).select("event_id", r("predicted", 4).alias("predicted"))


@query("mdl_29_apply_bundle", f"""WITH {TR}, k AS (SELECT regr_slope(value, value_mean_5) AS b, regr_intercept(value, value_mean_5) AS a FROM tr) SELECT event_id, {rs('least(greatest(a + b * value_mean_5, 0), 150)', 4)} AS soh, {rs('least(greatest(a + b * value_mean_5, 0), 100)', 4)} AS percent FROM tr, k""")
def apply_bundle(spark, d):
    rows = training_rows(spark, d)
    model = learn.fit(rows, ["value_mean_5"], learn.linear("value"))
    soh = learn.apply_model(model, rows, 0.0, 150.0, "soh")
    return learn.apply_model(model, soh, 0.0, 100.0, "percent").select("event_id", r("soh", 4).alias("soh"), r("percent", 4).alias("percent"))


@query("mdl_30_refit_terminal_rows", f"""WITH {TR}, k AS (SELECT regr_slope(least(rul, 40), value_mean_5) AS b, regr_intercept(least(rul, 40), value_mean_5) AS a FROM tr) SELECT user_id, cycle, {rs('least(greatest(a + b * value_mean_5, 0), 40)', 4)} AS predicted FROM tr, k WHERE rul = 0""")
def refit_terminal_rows(spark, d):
    rows = training_rows(spark, d).withColumn("capped", F.least("rul", F.lit(40.0)))
    model = learn.fit(rows, ["value_mean_5"], learn.linear("capped"))
    last = causal.terminal_rows(rows, ["user_id"], ["cycle"])
    return learn.apply_model(model, last, 0.0, 40.0).select("user_id", "cycle", r("predicted", 4).alias("predicted"))


# Task registry: name -> (table, group, target, kind).
TASKS = {"engine": ("events", "user_id", "value", "regressor"), "battery_soh": ("orders", "o_custkey", "o_totalprice", "regressor"),
         "hydraulic_valve": ("embeddings", "label", "label", "classifier"), "landing_fault": ("part", "p_brand", "p_size", "classifier"),
         "document_quality": ("labels", "doc_id", "quality", "classifier")}


@query("mdl_31_task_registry", " UNION ALL ".join(f"SELECT '{n}' AS task, '{kind}' AS kind, count(*) AS rows, count(DISTINCT {g}) AS groups, count(DISTINCT {t}) AS targets FROM {src}" for n, (src, g, t, kind) in TASKS.items()))
def task_registry(spark, d):
    out = None
    for name, (source, group, target, kind) in TASKS.items():
        one = table(spark, d, source).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.count_distinct(target).alias("targets")).select(
            F.lit(name).alias("task"), F.lit(kind).alias("kind"), "rows", "groups", "targets")
        out = one if out is None else out.unionByName(one)
    return out
