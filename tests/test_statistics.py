"""Exact order statistics, curves, profiles, joins and scores against numpy and known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearpath.operators import joins, metrics, order_stats, profile, quality, selection, waveform
from wearpath.operators.order_stats import average_ranks, conformal, higher, linear, quantiles
from wearpath.operators.quality import DataQualityError


@pytest.mark.parametrize("small_rows", [1_000_000, 5])
def test_quantiles_are_exact(spark, small_rows):
    rng = np.random.default_rng(5)
    groups = {"one": [7.0], "two": [1.0, 2.0], "ties": [3.0] * 40 + [4.0, 5.0], "many": rng.normal(0, 1, 3000).round(3).tolist(), "ten": list(range(10))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    wanted = {"lin": ("v", .9, linear(.9)), "hi": ("v", .95, higher(.95)), "conf": ("v", .9, conformal(.1)), "med": ("v", .5, linear(.5)), "low": ("v", 0.0, linear(0.0))}
    out = quantiles(df, ["g"], wanted, small_rows).toPandas().set_index("g")
    for g, vs in groups.items():
        n = len(vs)
        assert out.loc[g, "lin"] == pytest.approx(np.quantile(vs, .9)) and out.loc[g, "med"] == pytest.approx(np.median(vs))
        assert out.loc[g, "hi"] == np.quantile(vs, .95, method="higher") and out.loc[g, "low"] == min(vs)
        assert out.loc[g, "conf"] == sorted(vs)[min(math.ceil((n + 1) * .9), n) - 1]
    alone = quantiles(df.filter("g = 'many'"), [], {"m": ("v", .5, linear(.5))}, small_rows).first()["m"]
    assert alone == pytest.approx(np.median(groups["many"]))


def test_brackets_narrow_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "ACCURACY", 100)  # a coarse sketch, so that the bracket really cuts
    values = np.random.default_rng(1).permutation(20000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    out = quantiles(df, [], {"a": ("v", .5, linear(.5)), "b": ("v", .99, higher(.99))}, 10).first()
    assert out["a"] == np.quantile(values, .5) and out["b"] == np.quantile(values, .99, method="higher")


def test_average_ranks(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0]
    got = average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), [], "v").toPandas().set_index("v")["rank"].to_dict()
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_cutoff_known_answer(spark):
    rows = [(1, t, v, -1.0) for t, v in zip([0.0, 3600.0, 7200.0], [4.0, 2.0, 4.0])] + [(2, 0.0, 4.0, 1.0), (2, 10.0, 3.5, 1.0)] + [(3, 0.0, 2.0, 1.0), (3, 10.0, 3.5, 1.0)]
    df = spark.createDataFrame(rows, "curve long, time double, voltage double, current double")
    for n in (1_000_000, 2):
        out = {r["curve"]: r for r in waveform.cutoff_integrals(df, ["curve"], "time", "voltage", "current", 3.0, block_rows=n).collect()}
        assert out[1].asDict() == pytest.approx({"curve": 1, "status": "crossing_observed", "full_throughput_ah": 2.0, "cutoff_interpolated_ah": 0.5,
                                                 "crossing_seconds": 1800.0, "last_above_sample_ah": 0.0, "first_below_sample_ah": 1.0})
        assert out[2]["status"] == "no_observed_crossing" and out[3]["status"] == "starts_at_or_below_cutoff"


def test_waveforms(spark):
    ramp, flat = [float(i) for i in range(60)], [2.0] * 60
    df = spark.createDataFrame([(1, ramp), (2, flat)], "cycle_id long, PS1 array<double>")
    out = waveform.waveform_table(df, "cycle_id", ["PS1"]).orderBy("cycle_id").collect()
    assert out[0]["ps1_slope"] == pytest.approx(59.0) and out[0]["ps1_std"] == pytest.approx(np.std(ramp)) and out[1]["ps1_range"] == 0
    stats = waveform.phase_statistics(F.col("PS1"), 6, 10, "ps1")
    row = df.filter("cycle_id = 1").select(*[c.alias(n) for n, c in stats.items()]).first()
    m = np.asarray(ramp).reshape(6, 10)
    assert np.allclose(row["ps1_phase_mean"], m.mean(1)) and np.allclose(row["ps1_phase_std"], m.std(1))
    assert np.allclose(row["ps1_phase_relative"], m.mean(1) - m.mean(1)[0])
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")])], "cycle_id long, s array<double>")
    assert {r["cycle_id"]: r["rule"] for r in waveform.incomplete_waveforms(bad, "cycle_id", "s", 2).collect()} == {2: "length", 3: "non_finite"}


@pytest.mark.parametrize("block_rows", [1_000_000, 7])
def test_interpolating_asof(spark, block_rows):
    rng = np.random.default_rng(9)
    knots = {g: (np.sort(rng.choice(1000, n, replace=False)).astype(float), rng.normal(0, 1, n)) for g, n in (("a", 30), ("b", 1), ("c", 5))}
    asks = {g: np.r_[rng.uniform(-50, 1100, 40), x[:3]] for g, (x, _) in knots.items()}
    t = spark.createDataFrame([(g, float(x), float(v)) for g, (xs, vs) in knots.items() for x, v in zip(xs, vs)], "g string, p double, v double")
    q = spark.createDataFrame([(g, float(x)) for g, xs in asks.items() for x in xs], "g string, p double")
    out = joins.interpolating_asof(q, t, ["g"], "p", ["v"], block_rows=block_rows).toPandas()
    assert len(out) == sum(map(len, asks.values()))
    for g, part in out.groupby("g"):
        assert np.allclose(part.v_expected, np.interp(part.p, *knots[g]))


def scored(spark, shift=2.0):
    rows = [(u, float(c), c % 2, 9.0 - c, 9.0 - c + shift) for u in ("1", "2") for c in range(1, 10)]
    return spark.createDataFrame(rows, "unit string, cycle double, fold int, actual double, predicted double")


def test_aligned_predictions_fail_closed(spark):
    base = scored(spark)
    assert joins.aligned_predictions(scored(spark, 1.0), base).agg(F.sum(F.col("predicted") - F.col("actual"))).first()[0] == pytest.approx(18.0)
    broken = [base.filter("cycle <> 3"), base.unionByName(base.limit(1)), base.withColumn("fold", F.lit(7)), base.withColumn("actual", F.col("actual") + 1),
              base.withColumn("predicted", F.lit(float("nan"))), base.withColumn("predicted", F.lit(-1.0))]
    for candidate in broken:
        with pytest.raises(DataQualityError):
            joins.aligned_predictions(candidate, base)


def test_validated_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    with pytest.raises(DataQualityError):
        joins.one_to_one(a.unionByName(a), a.withColumnRenamed("a", "b"), ["k"])
    with pytest.raises(DataQualityError):
        joins.one_to_one(a.limit(1), a.withColumnRenamed("a", "b"), ["k"])
    with pytest.raises(DataQualityError):
        joins.enrich(a, a, ["k"])
    with pytest.raises(DataQualityError):
        joins.many_to_one(a, a.unionByName(a).withColumnRenamed("a", "b"), ["k"])


def test_scores_known_answers(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 20.0), (10.0, 10.0)], "actual double, predicted double")
    penalty = df.agg(metrics.late_penalty(F.col("actual"), F.col("predicted"))).first()[0]
    assert penalty == pytest.approx(math.exp(10 / 13) - 1 + math.exp(1.0) - 1)
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "actual int, predicted int")
    row = metrics.classification_scores(labels, "actual", "predicted").first()
    assert row["accuracy"] == pytest.approx(.6) and row["balanced_accuracy"] == pytest.approx((.5 + 1 + 0) / 3)
    assert row["macro_f1"] == pytest.approx((2 / 3 + 2 * 2 / 6 + 0) / 3)
    out = metrics.balanced_scores(scored(spark)).first()
    assert out["balanced_phase_mae"] == pytest.approx(2.0) and out["complete"] and out["worst_unit_mae"] == pytest.approx(2.0)
    assert not metrics.balanced_scores(scored(spark).filter("not (unit = '1' and cycle <= 3)")).first()["complete"]


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, float("nan"), "b"), (3, float("inf"), "z"), (4, -1.0, None), (5, 2.5, "a")], "k int, x double, c string")
    found = quality.violations(df, ["k"], [quality.non_finite("x"), quality.out_of_range("x", 0, 4), quality.outside_domain("c", ["a", "b"]),
                                           quality.missing("c"), quality.not_integer("x")])
    got = {(r["k"], r["rule"]) for r in found.collect()}
    assert {(2, "non_finite:x"), (3, "non_finite:x"), (1, "out_of_range:x"), (4, "out_of_range:x"), (3, "outside_domain:c"), (4, "missing:c"), (5, "not_integer:x")} <= got
    good, bad = quality.quarantine(df, found, ["k"])
    assert good.count() == 0 and bad.count() == 5
    with pytest.raises(DataQualityError):
        quality.require(found, "rules")
    assert quality.schema_issues(df, ["k", "c", "x"]) == ["columns are in another order"]
    assert quality.schema_issues(df, ["k", "x", "c", "y"]) == ["missing column y"]


def test_shrinkage_matches_its_definition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) @ np.array([[1, .5, 0], [0, 1, .3], [0, 0, 2]])
    cov, precision, amount = profile.shrunk_covariance(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc"))
    c = x - x.mean(0)
    s = c.T @ c / 50
    mu = np.trace(s) / 3
    d2 = ((s - mu * np.eye(3)) ** 2).sum() / 3
    b2 = min(sum((np.outer(r, r) - s).__pow__(2).sum() for r in c) / 50 ** 2 / 3, d2)
    assert amount == pytest.approx(b2 / d2) and np.allclose(cov, (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(3)) and np.allclose(precision @ cov, np.eye(3))


def test_selection(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.005), ("c", 2.0)], "name string, score double")
    assert selection.preferred_near_best(df, "score", "name", ["c", "b", "a"]).first()["name"] == "b"
    assert selection.best(df, [-F.col("score")]).first()["name"] == "c"
    weights = profile.equal_group_weights(spark.createDataFrame([("u",)] * 3 + [("v",)], "g string"), ["g"]).toPandas()
    assert weights.groupby("g").weight.sum().nunique() == 1 and weights.weight.mean() == pytest.approx(1.0)
