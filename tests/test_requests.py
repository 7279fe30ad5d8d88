"""Bundles, scoring rules, leave-one-out fits and importances read from the node table."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearpath.functions import scalars
from wearpath.operators import joins, learn, scoring
from wearpath.operators.quality import DataQualityError
from wearpath.sources import bundles, schemas


def example(spark, component, key="1"):
    body = {"engine": "struct(array(struct(1L AS cycle, 2.5D AS sensor_1)) AS records)", "battery": "struct('B' AS battery_id, array(struct(4.0D AS voltage_measured, 0.0D AS time)) AS samples)",
            "hydraulic": "struct(7L AS cycle_id, true AS operating_condition_stable, map('a', 1.5D) AS features)", "landing-gear": "struct(3.0D AS mass)",
            "fuel-system": "struct(array(struct(5.0D AS FTL)) AS samples)"}[component]
    return spark.range(1).select(F.lit(key).alias("bundle_id"), F.expr(body).alias("payload")).withColumn("payload", F.col("payload").withField("request_id", F.lit(key)))


def test_bundle_needs_all_five(spark):
    every = {c: example(spark, c) for c in schemas.HISTORY_COMPONENTS}
    value = json.loads(bundles.build(every).first()["value"])
    assert list(value) == list(schemas.HISTORY_COMPONENTS) and value["landing-gear"]["mass"] == 3.0
    with pytest.raises(DataQualityError, match="battery"):
        bundles.build({c: f for c, f in every.items() if c != "battery"})
    with pytest.raises(DataQualityError, match="missing:hydraulic"):
        bundles.build(every | {"hydraulic": example(spark, "hydraulic", "2")}).collect()


def test_sections_are_checked_and_split(spark, tmp_path):
    every = {c: example(spark, c) for c in schemas.HISTORY_COMPONENTS}
    good = json.loads(bundles.build(every).first()["value"])
    lines = [good, {c: v for c, v in good.items() if c != "engine"}, good | {"rocket": {}}, good | {"battery": [1]}, good | {"battery": None}]
    path = tmp_path / "bundles.json"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n[1, 2]\n")
    got = bundles.read(spark, str(path))
    assert (got.rows, got.broken) == (7, 6)
    named = sorted(tuple(r.broken_rules) for r in got.bad.select("broken_rules").collect())
    assert ("missing:engine",) in named and ("unexpected",) in named and named.count(("not an object:battery",)) == 2 and sum("unreadable" in n for n in named) == 2
    parts = bundles.split(got.good)
    assert parts["engine"].select(F.inline("records")).first()["sensor_1"] == 2.5
    assert parts["hydraulic"].first()["features"] == {"a": 1.5} and parts["battery"].first()["samples"][0]["voltage_measured"] == 4.0
    assert [parts[c].first()["bundle_id"] for c in schemas.HISTORY_COMPONENTS] == ["1"] * 5


def test_estimates_abstain_outside_their_training(spark):
    train = spark.range(200).select((F.col("id") / 10.0).alias("x"), (F.col("id") / 5.0 + F.col("id") % 3).alias("y"))
    fit = scoring.fit_estimate(train, ["x"], "y", 0.0, 100.0)
    rows = spark.createDataFrame([("in", 10.0), ("tail", 19.85), ("out", 25.0), ("none", None), ("nan", float("nan"))], "bundle_id string, x double")
    got = {r.bundle_id: r for r in scoring.estimated(rows, fit, "engine", "rul").collect()}
    assert got["in"].accepted and got["in"].warnings == "" and got["in"].lower <= got["in"].estimate <= got["in"].upper
    assert got["tail"].accepted and got["tail"].warnings == scoring.TAIL
    for key in ("out", "none", "nan"):
        assert not got[key].accepted and scoring.OUTSIDE in got[key].warnings
    assert got["none"].estimate is None and got["out"].estimate is not None


def test_classes_need_confidence_and_a_stable_condition(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(0, 1, 200), rng.normal(4, 1, 200)], "k": np.repeat([0, 1], 200)})
    fit = scoring.fit_centres(spark.createDataFrame(pdf), ["x"], "k", 0.995, 0.2)
    rows = spark.createDataFrame([("a", 0.0, False), ("b", 4.0, False), ("c", 4.0, True), ("d", 2.0, False), ("e", 99.0, False)], "bundle_id string, x double, unstable boolean")
    got = {r.bundle_id: r for r in scoring.classified(rows, fit, "hydraulic", "valve", F.col("unstable"), (F.col("unstable"), scoring.UNSTABLE)).collect()}
    assert (got["a"].label, got["b"].label) == (0, 1) and got["a"].accepted and got["b"].accepted
    assert not got["c"].accepted and got["c"].warnings == scoring.UNSTABLE
    assert not got["d"].accepted and scoring.UNSURE in got["d"].warnings
    assert not got["e"].accepted and scoring.OUTSIDE in got["e"].warnings
    status = {r.bundle_id: r.status for r in scoring.preflight_status(scoring.classified(rows, fit, "hydraulic", "valve", F.col("unstable"), (F.col("unstable"), scoring.UNSTABLE))).collect()}
    assert status["a"] == "supported" and status["c"] == status["e"] == "review_required"


def test_leave_one_out_equals_separate_fits(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"k": np.arange(n), "unit": [f"u{i}" for i in rng.integers(0, 40, n)], "x": rng.normal(1000, 3, n), "z": rng.normal(0, 1, n), "flat": 7.0})
    pdf["y"] = 2 * pdf.x - pdf.z + rng.normal(0, 1, n)
    got = learn.linear_oof(spark.createDataFrame(pdf), "unit", ["x", "z", "flat"], "y", None).orderBy("k").toPandas().predicted.to_numpy()
    for unit, own in pdf.groupby("unit"):
        rest = pdf[pdf.unit != unit]
        a = np.c_[np.ones(len(rest)), rest.x - 1000, rest.z]
        beta = np.linalg.lstsq(a, rest.y, rcond=None)[0]
        assert np.allclose(got[own.k], np.c_[np.ones(len(own)), own.x - 1000, own.z] @ beta, atol=1e-6)


def test_importances_are_the_models_own(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 300), "b": rng.normal(0, 1, 300), "c": rng.normal(0, 1, 300)})
    pdf["y"] = 3 * pdf.a + pdf.b
    pdf["k"] = (pdf.a > 0).astype(int) + (pdf.b > 1).astype(int)
    df = spark.createDataFrame(pdf)
    for model in (learn.forest("y", 6, 4), learn.boosted("y", 4, 3), learn.forest_classifier("k", 6, 4)):
        fitted = learn.fit(df, ["a", "b", "c"], model)
        found = {r.feature: r.importance for r in learn.importances(fitted).collect()}
        own = fitted.stages[-1].featureImportances
        for i, c in enumerate(["a", "b", "c"]):
            assert found.get(c, 0.0) == pytest.approx(float(own[i]), abs=1e-9)
        assert sum(found.values()) == pytest.approx(1)


def test_tables_of_unequal_length_are_not_cut(spark):
    a, b = spark.range(5).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit(2))
    with pytest.raises(DataQualityError):
        joins.side_by_side([a, b], "id")
    rows = joins.side_by_side([a, b], "id", strict=False)
    assert rows.columns == ["id", "x", "y"] and rows.count() == 5 and rows.filter("y IS NULL").count() == 2
    assert joins.side_by_side([a, a.withColumnRenamed("x", "z")], "id").count() == 5


def test_gates_and_forms_over_long_arrays(spark):
    v = np.linspace(-1, 1, 64)
    row = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    p = np.diag(np.arange(64.0)) + np.diag(np.ones(63), 1)
    got = row.select(scalars.soft_gates(F.col("v"), 0.5).alias("g"), scalars.quadratic_form([F.get("v", F.lit(i)) for i in range(64)], p.tolist()).alias("q")).first()
    raised = np.exp(-v * v / 0.5)
    assert np.allclose(got.g, raised / raised.sum()) and got.q == pytest.approx(v @ p @ v)


def test_replay_notices_another_configuration_or_prediction(spark, sf_dir, tmp_path):
    from wearpath.plans import jobs
    from wearpath.plans.models import training_rows
    from wearpath.sources import artefacts

    rows = training_rows(spark, sf_dir).withColumn("y", F.least("rul", F.lit(40.0)))
    scored = learn.linear_oof(rows, "fold", ["cycle"], "y", 0.0, 40.0).select("user_id", "event_id", "rul", "predicted")
    mae = scored.groupBy("user_id").agg(F.avg(F.abs(F.col("predicted") - F.col("rul"))).alias("e")).agg(F.avg("e")).first()[0]

    def differences(name, cap=40.0, shift=0.0):
        config = spark.createDataFrame([(name, cap, "cycle", mae)], "candidate string, cap double, feature string, mae double")
        moved = F.col("predicted") + F.when(F.col("event_id") == 3, shift).otherwise(0.0)
        artefacts.save(spark, str(tmp_path), name, {"config": config, "predictions": scored.select("event_id", moved.alias("predicted"))})
        return jobs.replay_differences(spark, sf_dir, str(tmp_path), name)

    assert differences("right") == 0
    assert differences("moved", shift=0.5) == 1
    assert differences("capped", cap=25.0) > 10


def test_a_section_is_an_object_by_its_kind_alone(spark, tmp_path):
    """Lists, texts, numbers and nulls are no sections; an empty object and one with lists inside are. No schema of a section is made."""
    whole = {c: {"a": [{"b": 1}, {"b": "x"}]} for c in schemas.HISTORY_COMPONENTS}
    odd = {"list": [1], "text": "x", "number": 1, "null": None, "empty": {}}
    path = tmp_path / "sections.json"
    path.write_text("\n".join(json.dumps(whole | {"engine": v}) for v in odd.values()) + "\n" + json.dumps(whole))
    got = bundles.read(spark, str(path))
    assert (got.rows, got.broken) == (6, 4)
    assert [r.broken_rules for r in got.bad.collect()] == [["not an object:engine"]] * 4
    assert not any("schema_of_variant" in str(rule.broken) for rule in bundles.section_rules())


def test_bundle_results_read_written_features(spark, tmp_path):
    """Windows and curves of the bundles are made once, not again for each result and for the unanswered requests."""
    from datetime import datetime, timedelta

    from wearpath.plans.requests import scored_bundles

    start, kinds = datetime(2024, 1, 1), ("view", "click", "error")
    events = [(40 * u + i, start + timedelta(hours=i, minutes=u), u, kinds[(u + i) % 3], float((7 * i + 3 * u) % 23), json.dumps({"k": (i + u) % 9})) for u in range(12) for i in range(4 + u)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(k, 5 * k % 47 + 1, 900.0 + k) for k in range(1, 60)], "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    vectors = [(v, v % 4, [float(((v * 31 + i * 17) % 13) - 6) for i in range(64)]) for v in range(40)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = scored_bundles(spark, str(tmp_path))
    assert found.groupBy("component", "output").count().filter("count = 12").count() == 7
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
