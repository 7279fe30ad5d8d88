"""Splits, detectors, calibration, gates, fits and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearpath.operators import calibrate, causal, detect, gates, learn, splits
from wearpath.operators.quality import DataQualityError
from wearpath.operators.series import series


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", i, int(rng.integers(0, 3))) for g, n in enumerate([400, *rng.integers(1, 30, 40)]) for i in range(n)]
    return spark.createDataFrame(rows, "g string, i int, y int").cache()


@pytest.mark.parametrize("block_rows", [1_000_000, 9])
def test_splits_keep_groups_whole(spark, groups, block_rows):
    n = groups.select("g").distinct().count()
    held = splits.holdout(groups, "g", block_rows=block_rows)
    assert held.filter("part = 'validation'").select("g").distinct().count() == int(np.ceil(.2 * n))
    assert held.count() == groups.count() and splits.leaking_groups(held, "g", "part").isEmpty()
    parts = splits.three_way(groups, "g", block_rows=block_rows)
    assert parts.select("g", "part").distinct().count() == n
    folds = splits.group_folds(groups, "g", 4, block_rows=block_rows)
    assert folds.count() == n and splits.frozen_fold_drift(groups, "g", folds).isEmpty()
    sizes = sorted(r["count"] for r in groups.join(folds, "g").groupBy("fold").count().collect())
    assert len(sizes) == 4 and sizes[-1] == 400 and sizes[2] - sizes[0] <= 30
    strat = splits.stratified_folds(groups, ["g", "i"], "y", 5, block_rows=block_rows).groupBy("y", "fold").count().toPandas()
    assert (strat.groupby("y")["count"].max() - strat.groupby("y")["count"].min()).max() <= 1


def test_allotment_handles_many_equal_groups():
    cells = splits.allot([(3, 1_000_003), (1_000_000, 1)], 4)
    per = {}
    for size, fold, first, last in cells:
        per[fold] = per.get(fold, 0) + size * (last - first + 1)
    assert sum(per.values()) == 3 * 1_000_003 + 1_000_000 and max(per.values()) - min(per.values()) <= 250_000 + 3


def test_perturbation(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(4000), "x": rng.normal(10, 2, 4000), "other": 1.0}))
    one = splits.perturb(df, df, ["k"], ["x"], noise=.05, dropout=.03).orderBy("k").toPandas()
    two = splits.perturb(df.repartition(7), df, ["k"], ["x"], noise=.05, dropout=.03).orderBy("k").toPandas()
    pd.testing.assert_frame_equal(one, two)
    base = df.orderBy("k").toPandas()
    median = np.median(base.x)
    dropped = np.isclose(one.x, median)
    assert .015 < dropped.mean() < .05 and (one.other == 1).all()
    assert (one.x - base.x)[~dropped].std() == pytest.approx(.05 * base.x.std(), rel=.1)


def normal_rows(spark, n=50, poison=None):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"scenario": "normal", "p": np.arange(1, n + 1), "FTT": rng.normal(-20, .1, n), "CRTT": rng.normal(-20, .1, n), "is_abnormal": 0})
    return spark.createDataFrame(pdf)


def test_envelope(spark):
    rows = normal_rows(spark)
    fits = detect.fit_envelope(rows, ["FTT", "CRTT"], abnormal="is_abnormal")
    one = fits.first()
    x = rows.toPandas()
    mad = 1.4826 * np.median(np.abs(x.FTT - x.FTT.median()))
    assert one["centre"][0] == pytest.approx(x.FTT.median()) and one["scale"][0] == pytest.approx(mad)
    fault = rows.limit(1).withColumn("FTT", F.lit(-40.0))
    for how in ("max", "mahalanobis"):
        full = detect.with_precision(rows, fits, ["FTT", "CRTT"]) if how == "mahalanobis" else fits
        score = lambda df: detect.attach(df, full, []).select(detect.envelope_score(["FTT", "CRTT"], how).alias("s")).agg(F.max("s")).first()[0]
        assert score(fault) > 50 > score(rows)
    with pytest.raises(DataQualityError):
        detect.fit_envelope(rows.withColumn("is_abnormal", F.lit(1)), ["FTT"], abnormal="is_abnormal")
    with pytest.raises(DataQualityError):
        detect.fit_envelope(normal_rows(spark, 11), ["FTT"])


def test_held_out_values_cannot_leak(spark):
    """Rows outside the training fold are poisoned; the fits must not move."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.arange(200), "fold": np.arange(200) % 4, "x": rng.normal(0, 1, 200)})
    pdf["y"] = 3 * pdf.x + rng.normal(0, .1, 200)
    clean = spark.createDataFrame(pdf)
    poisoned = clean.withColumns({"y": F.when(F.col("fold") == 2, 1e9).otherwise(F.col("y"))})
    fit = lambda df: {k: (a, b) for k, a, b in learn.linear_by_fold(df, "fold", ["x"], "y")}
    a, b = fit(clean), fit(poisoned)
    assert b[2][0] == pytest.approx(a[2][0], abs=1e-3) and b[2][1][0] == pytest.approx(a[2][1][0], abs=1e-3)
    scaling = [learn.fit_scaling(df.filter("fold <> 2"), ["x", "y"]) for df in (clean, poisoned)]
    assert scaling[0] == scaling[1]
    medians = [learn.fold_statistic(df, "fold", (0, 1, 2, 3), "y").filter("fold = 2").first()["predicted"] for df in (clean, poisoned)]
    assert medians[0] == medians[1]


def test_one_pass_folds_equal_separate_fits(spark, tmp_path):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.arange(300), "fold": np.arange(300) % 3, "x": rng.normal(5, 2, 300), "z": rng.normal(0, 1, 300), "flat": 1.0})
    pdf["y"] = 2 * pdf.x - pdf.z + rng.normal(0, .1, 300)
    df = spark.createDataFrame(pdf)
    a = learn.linear_oof(df, "fold", ["x", "z"], "y").orderBy("k").toPandas().predicted
    b = learn.regression_oof(df, "fold", (0, 1, 2), ["x", "z", "flat"], learn.linear("y")).orderBy("k").toPandas().predicted
    assert np.allclose(a, b, atol=1e-6)
    model = learn.fit(df, ["x", "z", "flat"], learn.linear("y"))
    model.write().save(str(tmp_path / "m"))
    again = learn.load_model(str(tmp_path / "m"))
    first, second = (learn.apply_model(m, df).orderBy("k").toPandas().predicted for m in (model, again))
    assert (first == second).all()
    with pytest.raises(DataQualityError):
        learn.fit(df, ["flat"], learn.linear("y"))


def test_target_round_trip(spark):
    df = spark.createDataFrame([(10.0, 5.0), (200.0, 7.0)], "rul double, age double")
    for how in ("plain", "log", "lifetime"):
        back = learn.decode_target(learn.encode_target(F.col("rul"), F.col("age"), how), F.col("age"), how)
        assert [r[0] for r in df.select(back).collect()] == pytest.approx([10.0, 200.0])


def test_calibration_and_thresholds(spark):
    rng = np.random.default_rng(6)
    raw = rng.uniform(0, 1, 600).round(2)
    correct = (rng.uniform(0, 1, 600) < raw).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"raw": raw, "correct": correct}))
    out = calibrate.apply_isotonic(calibrate.fit_isotonic(df, "raw", "correct"), df, "raw")
    got = out.toPandas().sort_values("raw")
    assert got.confidence.is_monotonic_increasing and got.confidence.between(0, 1).all()
    for n in (1_000_000, 7):
        t = calibrate.acceptance_threshold(out, "confidence", "correct", .9, .1, block_rows=n)
        expected = next((c for c in np.unique(got.confidence) if (got.confidence >= c).mean() >= .1 and got.correct[got.confidence >= c].mean() >= .9), calibrate.REJECT_ALL)
        assert t == pytest.approx(expected)
    assert calibrate.acceptance_threshold(out.withColumn("correct", F.lit(0)), "confidence", "correct") == calibrate.REJECT_ALL


def test_support_judges_rows_alone(spark):
    bounds = {"x": {"hard_min": 0.0, "hard_max": 10.0, "q01": 1.0, "q99": 9.0}}
    df = spark.createDataFrame([(5.0,), (0.5,), (11.0,)], "x double").withColumns(calibrate.support_flags(bounds))
    rows = df.orderBy("x").collect()
    assert [r["abstain"] for r in rows] == [False, False, True] and [len(r["tail_warnings"]) for r in rows] == [1, 0, 1]


def test_gates_fail_closed(spark):
    names = ("mae", "rmse", "width", "coverage", "audit_mae")
    def row(**changes):
        values = {**{n: .5 for n in names}, **{f"baseline_{n}": .6 for n in names}, "coverage": .9, "baseline_coverage": .9, "is_baseline": False, "inner_eligible": True, **changes}
        return spark.createDataFrame(pd.DataFrame([{"task": "t", **values}]))
    assert gates.nonregression(row(), ["task"]).first()["passes"]
    for change in ({"mae": .7}, {"coverage": .8}, {"audit_mae": .599}, {"is_baseline": True}, {"inner_eligible": False}, {"rmse": float("nan")}, {"width": -1.0}, {"coverage": 1.5}):
        assert not gates.nonregression(row(**change), ["task"]).first()["passes"], change
    rows = [(u, float(c), 9.0 - c, 9.0 - c + 2) for u in ("1", "2") for c in range(1, 10)]
    base = spark.createDataFrame(rows, "unit string, cycle double, actual double, predicted double")
    better = base.withColumn("predicted", F.col("predicted") - 1)
    assert gates.protocol_checks(better, base).first()["eligible"] and not gates.protocol_checks(base, base).first()["eligible"]
    lopsided = better.withColumn("predicted", F.when(F.col("unit") == "1", F.col("actual") + 3).otherwise(F.col("actual")))
    assert not gates.protocol_checks(lopsided, base).first()["eligible"]


def test_prepare_writes_a_manifest(spark, sf_dir, tmp_path):
    from wearpath.plans.jobs import prepare

    manifest = prepare(spark, sf_dir, str(tmp_path / "out")).collect()
    assert len(manifest) == 5 and all(m["rows"] > 0 and m["bytes"] > 0 and len(m["sha256"]) == 64 for m in manifest)
    with pytest.raises(Exception):
        prepare(spark, sf_dir, str(tmp_path / "out"))


def test_few_folds_are_broadcast_and_counted(spark):
    """Rows of five folds are not dealt to five tasks, and a median of the other folds needs no copy of the rows per fold."""
    rows = [(i, i % 5, float(i % 7), float((i * i) % 11)) for i in range(200)] + [(200, 0, 1.0, None), (201, None, 1.0, 99.0)]
    df = spark.createDataFrame(rows, "k long, fold int, x double, y double")
    plan = learn.linear_oof(df.filter("y IS NOT NULL"), "fold", ["x"], "y")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r.fold: r.predicted for r in learn.fold_statistic(df, "fold", (0, 1, 2, 3, 4), "y").collect()}
    known = {k: np.median([y for _, f, _, y in rows if f is not None and f != k and y is not None]) for k in range(5)}
    assert got == known
    lone = learn.fold_statistic(df.filter("k = 200"), "fold", (0, 1), "y").collect()
    assert [(r.fold, r.predicted) for r in lone] == [(1, None)]


def test_stress_report_counts_pairs_without_a_join(spark):
    """One row a side, from counts per event id; ids that repeat meet each other, null ids nothing, and no row is sorted."""
    from wearpath.plans.models import stress_report

    rows = [("clean", 1, 1, 1, 0.9), ("clean", 2, 0, 0, 0.4), ("clean", 3, 1, 0, 0.8), ("clean", 3, 0, 0, 0.7), ("clean", None, 1, 1, 0.9), ("perturbed", 1, 1, 1, 1.1)]
    df = spark.createDataFrame(rows, "side string, event_id long, near int, predicted int, raw_confidence double")
    joined = df.join(df.select("event_id", "side", F.col("near").alias("known")), ["event_id", "side"])
    known = {r.side: (r.n, r.share) for r in joined.groupBy("side").agg(F.count("*").alias("n"), F.avg("known").alias("share")).collect()}
    report = stress_report(df)
    got = {r.side: r for r in report.collect()}
    assert {s: (x.rows, x.near_share) for s, x in got.items()} == {s: (n, round(v, 5)) for s, (n, v) in known.items()}
    assert got["clean"].distinct_rows == 3 and got["clean"].bad_confidence == 1 and got["perturbed"].bad_confidence == 1
    assert (got["clean"].beats_constant, got["perturbed"].beats_constant) == (1, 1)
    assert "SortMergeJoin" not in report._jdf.queryExecution().sparkPlan().toString()


def test_folds_become_folders(spark):
    """A filter on the fold reads the rows of that fold alone."""
    from wearpath.session import materialise

    df = spark.createDataFrame([(i, i % 3 if i else None, float(i)) for i in range(12)], "k long, fold int, x double")
    back = materialise(df, "folds", ("fold",))
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(i, i % 3 if i else None, float(i)) for i in range(12)]
    assert "PartitionFilters: [isnotnull(fold" in back.filter("fold = 1")._jdf.queryExecution().executedPlan().toString()
