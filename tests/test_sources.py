"""File readers and writers on small fixtures written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from wearpath.operators.quality import DataQualityError
from wearpath.sources import readers, schemas, sinks


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def engine_line(unit, cycle):
    return " ".join([str(unit), str(cycle), *[f"{0.5 * i}" for i in range(24)]]) + "  "


def test_trajectories(spark, tmp_path):
    put(tmp_path, "train_A.txt", "\n".join(engine_line(u, c) for u in (1, 2) for c in range(1, 4)) + "\n")
    put(tmp_path, "train_B.txt", engine_line(1, 1) + "\n")
    rows = readers.read_trajectories(spark, str(tmp_path))
    assert rows.count() == 7 and rows.columns[1:3] == ["unit_id", "cycle"]
    assert {r[0] for r in rows.select("file").distinct().collect()} == {"train_A.txt", "train_B.txt"}
    for bad in (engine_line(1, 1) + "\n" + engine_line(1, 1), "1 2 3", engine_line(0, 1), engine_line(1, 1).replace("0.5", "x", 1)):
        with pytest.raises(DataQualityError):
            readers.read_trajectories(spark, put(tmp_path, "bad.txt", bad))


def test_line_numbers_follow_the_file(spark, tmp_path):
    put(tmp_path, "labels.txt", "\n".join(str(3 * i) for i in range(1, 2001)) + "\n")
    for size in ("134217728", "1000"):  # one split, many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.read_life_labels(spark, str(tmp_path / "labels.txt"))
            assert rows.filter(F.col("additional_rul") != 3 * F.col("unit_id")).count() == 0 and rows.count() == 2000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(DataQualityError):
        readers.read_life_labels(spark, put(tmp_path, "neg.txt", "4\n-1\n"))


LOG = "type,start_time,ambient_temperature,battery_id,test_id,uid,filename,Capacity,Re,Rct\n"
VECTOR = '"[2.0100e+03 7.0000e+00 2.1000e+01 2.1000e+01 2.0000e+00 5.6984e+01]"'


def test_event_log_and_samples(spark, tmp_path):
    log = LOG + f'discharge,{VECTOR},24,B0005,1,1,a.csv,1.85,,\nimpedance,"[2010. 7. 21. 15. 0. 35.093]",24,B0005,2,2,b.csv,[],(0.05-0.002j),0.1\n'
    meta = readers.read_event_log(spark, put(tmp_path, "metadata.csv", log))
    by = {r["uid"]: r for r in meta.collect()}
    assert str(by[1]["start_time"]) == "2010-07-21 21:02:56.984000" and str(by[2]["start_time"]) == "2010-07-21 15:00:35.093000"
    assert by[1]["capacity"] == 1.85 and by[2]["capacity"] is None and by[1]["re"] is None
    assert (by[2]["re"]["re"], by[2]["re"]["im"], by[2]["rct"]["re"]) == (0.05, -0.002, 0.1)
    folder = tmp_path / "data"
    folder.mkdir()
    put(folder, "a.csv", ",".join(schemas.SAMPLE_COLUMNS["discharge"]) + "\n4.1,-2,24,2,3.9,0\n3.9,-2,25,2,3.7,10\n")
    samples = readers.read_samples(spark, str(folder), "discharge", meta)
    assert samples.count() == 2 and samples.first()["battery_id"] == "B0005"
    for line in (f'flight,{VECTOR},24,B1,1,1,a.csv,1,,\n', f'charge,{VECTOR},24,B1,1,1,../x.csv,1,,\n', f'charge,"[1 2]",24,B1,1,1,a.csv,1,,\n',
                 f'charge,{VECTOR},24,B1,1,1,a.csv,oops,,\n', f'charge,{VECTOR},-200,B1,1,1,a.csv,1,,\n'):
        with pytest.raises(DataQualityError):
            readers.read_event_log(spark, put(tmp_path, "bad.csv", LOG + line))
    with pytest.raises(DataQualityError):
        readers.read_event_log(spark, put(tmp_path, "head.csv", "a,b\n1,2\n"))


def test_matrix_and_profile(spark, tmp_path):
    put(tmp_path, "TS1.txt", "\n".join("\t".join(str(c + s) for s in range(60)) for c in range(3)) + "\n")
    rows = readers.read_sensor(spark, str(tmp_path), "TS1").orderBy("cycle_id").collect()
    assert [r["cycle_id"] for r in rows] == [1, 2, 3] and rows[2]["TS1"][:2] == [2.0, 3.0]
    profile = readers.read_profile(spark, put(tmp_path, "profile.txt", "3\t100\t0\t130\t1\n20\t73\t2\t90\t0\n"))
    assert profile.filter("cycle_id = 2").first()["valve_condition_percent"] == 73
    for bad in ("3 100 0 130\n", "3.5 100 0 130 1\n", "4 100 0 130 1\n", "3 100 0 nan 1\n"):
        with pytest.raises(DataQualityError):
            readers.read_profile(spark, put(tmp_path, "badp.txt", bad))


def test_scenarios_and_landing(spark, tmp_path):
    head = ",".join(schemas.FUEL_CHANNELS) + "\n"
    folder = tmp_path / "fuel"
    folder.mkdir()
    put(folder, "n.csv", head + "".join(f"{i},1,2,3,4,5,6,7\n" for i in range(5)))
    put(folder, "f.csv", head + "".join(f"{i},1,2,3,4,5,6,7\n" for i in range(5, 10)))
    names = {"n.csv": "normal", "f.csv": "one"}
    rows = readers.read_scenarios(spark, str(folder), names, 5)
    first = rows.filter("scenario_id = 'one' and sample_index = 1").first()
    assert (first["FTL"], first["is_abnormal"], first["scenario_code"]) == (5.0, 1, 1) and rows.count() == 10
    with pytest.raises(DataQualityError):
        readers.read_scenarios(spark, str(folder), names, 6)
    head = ",".join(schemas.LANDING_COLUMNS) + "\n"
    assert readers.read_landing_events(spark, put(tmp_path, "l.csv", head + "1,.1,2,3,4,5,6,0,55\n"), 1).first()["RunID"] == 1
    for line in ("0,.1,2,3,4,5,6,0,55\n", "1,.1,2,3,4,5,6,7,55\n", "1,.1,2,3,-4,5,6,0,55\n", "1,.1,2,3,4,5,6,0,101\n", "1,.1,2,3,4,5,6,0,1\n" * 2):
        with pytest.raises(DataQualityError):
            readers.read_landing_events(spark, put(tmp_path, "lb.csv", head + line))


def test_requests_round_trip(spark, tmp_path):
    request = {"request_id": "r1", "battery_id": "B1", "discharge_cycle": 3, "ambient_temperature": 24.0,
               "samples": [{"voltage_measured": 4.0 - i, "current_measured": -1.0, "temperature_measured": 20.0, "current_load": 1.0,
                            "voltage_load": 3.0, "time": 10.0 * i} for i in range(3)]}
    path = put(tmp_path, "req.json", json.dumps(request) + "\n")
    requests = readers.read_requests(spark, path, "battery")
    flat = readers.request_records(requests, "samples")
    assert [r["time"] for r in flat.orderBy("arrival").collect()] == [0.0, 10.0, 20.0]
    out = str(tmp_path / "csv")
    fields = ["battery_id", "discharge_cycle", "ambient_temperature"]
    sinks.write_table(sinks.payload_rows(requests, "samples", fields).coalesce(1), out, kind="csv")
    again = readers.read_uploads(spark, out, "battery", [*fields, *request["samples"][0]]).first()
    assert again["battery_id"] == "B1" and [s["time"] for s in again["samples"]] == [0.0, 10.0, 20.0]
    with pytest.raises(DataQualityError):
        readers.read_requests(spark, put(tmp_path, "bad.json", "{nope\n"), "battery")
    with pytest.raises(Exception):
        sinks.write_table(requests, out)


def test_uploads_check_shape(spark, tmp_path):
    columns = ["cycle_id", "operating_condition_stable", "ps1_mean"]
    ok = readers.read_uploads(spark, put(tmp_path, "h.csv", ",".join(columns) + "\n7,true,1.5\n"), "hydraulic", columns).first()
    assert ok["cycle_id"] == 7 and ok["operating_condition_stable"] is True and ok["features"] == {"ps1_mean": 1.5}
    with pytest.raises(DataQualityError):
        readers.read_uploads(spark, put(tmp_path, "h2.csv", ",".join(columns) + "\n7,true,1.5\n8,true,2\n"), "hydraulic", columns)
    with pytest.raises(DataQualityError):
        readers.read_uploads(spark, put(tmp_path, "h3.csv", ",".join(columns) + "\n7,true,inf\n"), "hydraulic", columns)


def test_bundles(spark, tmp_path):
    whole = {c: {"a": 1} for c in schemas.HISTORY_COMPONENTS}
    assert readers.read_bundles(spark, put(tmp_path, "b.json", json.dumps(whole))).first()["engine"] == '{"a":1}'
    whole.pop("battery")
    with pytest.raises(DataQualityError):
        readers.read_bundles(spark, put(tmp_path, "b2.json", json.dumps(whole)))


def test_manifest_reader(spark, tmp_path):
    from wearpath.operators.quality import MANIFEST_COLUMNS
    rows = readers.read_manifest(spark, put(tmp_path, "m.csv", "﻿" + ",".join(MANIFEST_COLUMNS) + "\n" + ",".join("x" for _ in MANIFEST_COLUMNS) + "\n"))
    assert rows.columns == list(MANIFEST_COLUMNS)
    with pytest.raises(DataQualityError):
        readers.read_manifest(spark, put(tmp_path, "m2.csv", "component\nengine\n"))


def test_tables_reports_history(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") / 3)
    sinks.write_table(df, str(tmp_path / "t"))
    entry = sinks.table_entry(spark, str(tmp_path / "t"), "ten rows").first()
    assert (entry["rows"], entry["columns"], len(entry["sha256"])) == (10, 2, 64) and entry["bytes"] > 0
    sinks.write_report(df, str(tmp_path / "r"))
    with pytest.raises(DataQualityError):
        sinks.write_report(df.withColumn("x", F.lit(float("nan"))), str(tmp_path / "r2"))
    base = spark.createDataFrame([("engine", "A1", "upload", "RUL 20", True, "v2", "a" * 64), ("battery", "A2", "upload", "SOH 90", False, "v2", "b" * 64)],
                                 "component string, asset_id string, source string, summary string, review_required boolean, model_release string, input_digest string")
    log = str(tmp_path / "log")
    sinks.append_history(sinks.created(base), log)
    key = spark.read.parquet(log).filter("asset_id = 'A1'").first()["id"]
    for status in ("inspected", "confirmed"):
        sinks.append_history(sinks.outcomes(spark.createDataFrame([(key, status)], "id string, outcome_status string")), log)
    now = {r["asset_id"]: r for r in sinks.newest_history(spark.read.parquet(log)).collect()}
    assert now["A1"]["outcome_status"] == "confirmed" and now["A2"]["outcome_status"] is None
    assert [r["asset_id"] for r in sinks.newest_history(spark.read.parquet(log), 5, " A2 ").collect()] == ["A2"]
    with pytest.raises(DataQualityError):
        sinks.created(base.withColumn("component", F.lit("rocket")))


def test_spread_files_keep_a_unit_together(spark):
    """A subset's lines go to several files, so that no task writes a subset whole; a unit's lines stay in one file."""
    from wearpath.plans.ingest import _written

    rows = spark.range(4000).selectExpr("concat('s', id % 2) AS subset", "id % 100 AS unit", "concat(id % 100, ' ', id) AS value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # few rows would go to one task
    try:
        place = _written(rows, "spread", "subset", spread=["unit"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.text(f"{place}/*").selectExpr("value", "split(value, ' ')[0] AS unit", "_metadata.file_path AS path").collect()
    assert sorted(r.value for r in back) == sorted(r.value for r in rows.collect())
    paths = {}
    for r in back:
        paths.setdefault((r.path.split("/")[-2], r.unit), set()).add(r.path)
    assert all(len(p) == 1 for p in paths.values()) and len({r.path for r in back}) > 2
