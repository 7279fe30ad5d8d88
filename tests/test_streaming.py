"""Streams against batch results: any number and order of files, late, repeated and untimed rows, the last window."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearpath.operators import causal, quality
from wearpath.operators.series import series
from wearpath.streaming import online

START = datetime(2024, 1, 1)
SCHEMA = "unit string, event_id long, ts timestamp, x double, vote int, position long"


@pytest.fixture(scope="module")
def readings():
    rng = np.random.default_rng(12)
    n = 240
    pdf = pd.DataFrame({"unit": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "event_id": np.arange(n)})
    # Pairs of events share a time: only the id tells them apart.
    pdf["ts"] = [START + timedelta(minutes=int(m)) for m in np.sort(rng.integers(0, 3000, n // 2)).repeat(2)]
    pdf["x"] = rng.normal(5, 1, n).round(3)
    pdf["vote"] = (pdf.x > 5).astype("int32")
    pdf["position"] = pdf.groupby("unit").cumcount() + 1 + (pdf.groupby("unit").cumcount() > 20) * 5
    return pdf


def written(folder, parts, newest_first=False):
    """Part files with times of arrival in the given order."""
    folder.mkdir()
    for i, part in enumerate(parts):
        path = folder / f"part-{i:03d}.parquet"
        part.to_parquet(path, index=False, coerce_timestamps="us")
        at = 1_700_000_000 + (len(parts) - i if newest_first else i)
        os.utime(path, (at, at))
    return str(folder)


def features(spark, frame, **options):
    stream, hold = online.replay(frame, "ts", **options)
    return online.run_to_end(online.causal_features(online.timed(stream, "ts", hold).drop("ts"), "unit", ["at", "event_id"], "x"), "features", partition_by=["status"])


def test_any_files_give_the_batch_result(spark, tmp_path, readings):
    layouts = {"one": written(tmp_path / "one", [readings]), "many": written(tmp_path / "many", np.array_split(readings.sample(frac=1, random_state=3), 40)),
               "reversed": written(tmp_path / "reversed", np.array_split(readings, 40), newest_first=True)}
    s = series(spark.createDataFrame(readings, SCHEMA), "unit", ("ts", "event_id"))
    s = causal.trailing_std(causal.trailing_mean(causal.first_difference(s, ["x"]), ["x"], (5,)), ["x"], (5,))
    want = causal.growing_mean_baseline(s.ewm({"ewm5": ("x", 5)}), ["x"]).frame.orderBy("event_id").toPandas()
    for name, path in layouts.items():
        found = features(spark, spark.read.schema(SCHEMA).parquet(path), files_per_trigger=2 if name == "many" else 16)
        got = found.filter("status = 'accepted'").orderBy("event_id").toPandas()
        assert len(got) == len(readings) == found.count(), name
        for column in ("x_delta", "x_mean_5", "x_std_5", "ewm5", "x_baseline"):
            assert np.allclose(got[column], want[column]), (name, column)


def test_alerts_restart_behind_gaps(spark, readings):
    frame = spark.createDataFrame(readings, SCHEMA)
    stream, hold = online.replay(frame, "ts", slices=3, files_per_trigger=1)
    rows = online.timed(stream, "ts", hold).drop("ts")
    got = online.run_to_end(online.persistence_alerts(rows, "unit", ["at", "event_id"], "vote", position="position"), "alerts").orderBy("event_id").toPandas()
    want = causal.segmented_persistence(frame, ["unit"], "position", "vote", 5, 3).frame.orderBy("event_id").toPandas()
    assert (got.alert.to_numpy() == want.alert.to_numpy()).all() and (got.segment.to_numpy() == want.segment.to_numpy()).all()


def test_no_row_vanishes(spark, tmp_path, readings):
    """Files that arrive out of order with a short hold: what comes too late is reported, and so are repeats and rows without a time."""
    half = len(readings) // 2
    untimed = readings[:3].assign(ts=pd.NaT, event_id=[900, 901, 902])
    # The second file lets the first one's rows go, all but those of the last minute; the third is older than both.
    later = readings[-1:].assign(event_id=903, ts=readings.ts.max() + timedelta(hours=1))
    parts = [readings[half:], later, readings[:half], readings[half:half + 10], untimed]
    path = written(tmp_path / "in", parts)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    found = online.run_to_end(online.causal_features(online.timed(stream, "ts", "1 minute").drop("ts"), "unit", ["at", "event_id"], "x"), "late")
    counts = {r.status: r["count"] for r in found.groupBy("status").count().collect()}
    assert counts == {"accepted": len(readings) - half, "late": half + 10, "untimed": 3}
    # Without a closing row the newest row still waits; all others came out.
    assert sum(counts.values()) == sum(map(len, parts)) - 1
    accepted = found.filter("status = 'accepted'")
    assert accepted.groupBy("unit").agg((F.max("cycle") == F.count("*")).alias("ok")).filter("NOT ok").count() == 0


def test_repeats_and_late_rows_are_quarantined(spark, tmp_path, readings):
    again = readings[:20].assign(ts=readings.ts[:20] + timedelta(minutes=30))
    old = readings[:1].assign(event_id=777, ts=START - timedelta(days=9))
    path = written(tmp_path / "in", [pd.concat([readings, again]), readings[-1:].assign(event_id=778, ts=readings.ts.max() + timedelta(days=2)), old])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    rows = online.first_of_key(online.timed(stream, "ts", "1 hour").drop("ts"), "event_id", 86_400, buckets=1)
    base = str(tmp_path / "out")
    rules = lambda: [quality.out_of_range("x", 3, 7)]
    online.quality_split(rows, rules, f"{base}/good", f"{base}/bad", f"{base}/offsets").awaitTermination()
    good, bad = spark.read.parquet(f"{base}/good"), spark.read.parquet(f"{base}/bad")
    named = {r.rule: r["count"] for r in bad.select(F.explode("broken_rules").alias("rule")).groupBy("rule").count().collect()}
    assert named["repeated"] == 20 and named["late"] == 1 and named["out_of_range:x"] >= 1
    assert bad.filter("event_id = 777").first()["broken_rules"][0] == "late"
    # The row that moved the watermark is still held: a closing row would release it.
    assert good.count() + bad.count() == len(readings) + 20 + 1


def test_drift_reports_every_window(spark):
    rows = [(START + timedelta(days=d, hours=h), "r", float(h) + (5 if d == 4 else 0)) for d in range(5) for h in range(24)]
    frame = spark.createDataFrame(rows, "ts timestamp, regime string, x double")
    stream, hold = online.replay(frame, "ts")
    bins = online.run_to_end(online.support_drift(online.clocked(stream, "ts", hold), "regime", "x", 0, 23, [6.0, 12.0, 18.0]), "bins")
    assert bins.agg(F.sum("rows")).first()[0] == len(rows)
    base = bins.filter(F.col("window_start") < F.lit(START + timedelta(days=2))).groupBy("regime", "bin").agg(*[F.sum(c).alias(c) for c in ("rows", "total", "squares", "outside")])
    told = online.drift_report(bins, base, "regime").orderBy("window_start").collect()
    assert len(told) == 5 and [r.shift for r in told] == pytest.approx([0, 0, 0, 0, 5])
    assert told[0].statistic == pytest.approx(0) and told[4].statistic > told[3].statistic and told[4].outside_rate == pytest.approx(5 / 24)


def test_predictions_without_review_come_out(spark):
    made = spark.createDataFrame([(i, START + timedelta(hours=i), i % 2) for i in range(48)], "key long, made timestamp, predicted int")
    came = spark.createDataFrame([(i, START + timedelta(hours=i + (1 if i % 3 else 30)), 1) for i in range(40)] + [(99, START, 0)], "key long, reviewed timestamp, actual int")
    (a, hold_a), (b, hold_b) = online.replay(made, "made"), online.replay(came, "reviewed")
    p = online.clocked(a, "made", hold_a).drop("made").withColumnRenamed("clock", "made")
    o = online.clocked(b, "reviewed", hold_b).drop("reviewed").withColumnRenamed("clock", "reviewed")
    rows = online.run_to_end(online.with_outcomes(p, o, ["key"], "made", "reviewed", "24 HOURS"), "outcomes")
    counts = {r.outcome: r["count"] for r in rows.groupBy("outcome").count().collect()}
    late = len([i for i in range(40) if i % 3 == 0])
    assert counts == {"reviewed": 40 - late, "unreviewed": 48 - 40 + late, "unmatched": late + 1}


def test_a_call_serves_many_units(spark, tmp_path):
    """Units share calls and keep their own state over batches; one without a name is a unit too."""
    rows = [(None if u == 40 else f"u{u}", 1000 * u + k, START + timedelta(minutes=7 * k + u), float(k % 5), 1, k) for u in range(41) for k in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    stream, hold = online.replay(frame, "ts", files_per_trigger=3)

    def step(good, starts, held):
        ends = [*starts[1:], len(good)]
        before = np.concatenate([np.arange(1, e - b + 1) + (state[0] if state else 0) for b, e, state in zip(starts, ends, held)])
        return good.assign(seen=before, together=len(starts)), [(int(before[e - 1]),) for e in ends]

    output = [T.StructField("seen", T.LongType()), T.StructField("together", T.LongType())]
    timed = online.timed(stream, "ts", hold).drop("ts")
    got = online.run_to_end(online.in_order(timed, "unit", ["at", "event_id"], output, "n long", step, shards=2), "shards").toPandas()
    assert len(got) == len(rows) and (got.status == "accepted").all()
    assert (got.seen == got.event_id % 1000 + 1).all()
    assert got[got.unit.notna()].together.min() > 1
