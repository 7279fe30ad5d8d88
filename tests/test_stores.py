"""Artefacts, table digests and the history log: round trips, tampering, unfinished writes, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from wearpath.operators import learn, quality
from wearpath.operators.quality import DataQualityError
from wearpath.sources import artefacts, readers, sinks


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") * 0.5 + F.col("id") % 17).alias("y"),
                                   F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id"))).alias("name"))


def test_digest_knows_rows_and_not_files(spark, tmp_path, rows):
    rows.repartition(7).write.parquet(str(tmp_path / "a"))
    rows.orderBy(F.desc("id")).coalesce(1).write.parquet(str(tmp_path / "b"))
    a, b = (artefacts.table_digest(spark, str(tmp_path / n)).first() for n in "ab")
    assert a["digest"] == b["digest"] == artefacts.content_digest(rows).first()["digest"] and a["rows"] == 200 and a["columns"] == 4
    assert b["bytes"] == sum(os.path.getsize(tmp_path / "b" / f) for f in os.listdir(tmp_path / "b") if f.startswith("part-"))
    changes = [rows.withColumn("x", F.when(F.col("id") == 3, 99.0).otherwise(F.col("x"))), rows.filter("id > 0"), rows.unionByName(rows.limit(1)),
               rows.withColumn("name", F.when(F.col("id") == 5, "").otherwise(F.col("name"))), rows.withColumnRenamed("x", "z")]
    assert len({artefacts.content_digest(c).first()["digest"] for c in [rows, *changes]}) == 6
    assert artefacts.content_digest(rows.limit(0)).first()["rows"] == 0


def test_artefact_round_trip_and_tampering(spark, tmp_path, rows):
    place = str(tmp_path / "store")
    model = learn.fit(rows, ["x", "id"], learn.linear("y"))
    artefacts.save(spark, place, "v1", {"bounds": rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))}, {"model": model})
    found = artefacts.load(spark, place, "v1")
    assert found.tables["bounds"].first().asDict() == {"low": 0.0, "high": 16.0}
    both = learn.apply_model(found.models["model"], rows).join(learn.apply_model(model, rows).select("id", F.col("predicted").alias("own")), "id")
    assert both.filter(~F.col("predicted").eqNullSafe(F.col("own"))).count() == 0
    assert {r["part"] for r in artefacts.versions(spark, place).filter("version = 'v1'").collect()} == {"bounds", "model"}
    with pytest.raises(Exception):
        artefacts.save(spark, place, "v1", {"bounds": rows})
    spark.createDataFrame([(0.0, 17.0)], "low double, high double").write.mode("overwrite").parquet(f"{place}/v1/bounds")
    with pytest.raises(DataQualityError, match="bounds"):
        artefacts.load(spark, place, "v1")


def test_changed_model_or_missing_part_is_refused(spark, tmp_path, rows):
    place = str(tmp_path / "store")
    for version in ("a", "b"):
        artefacts.save(spark, place, version, {"t": rows.select("id")}, {"model": learn.fit(rows.filter("id < 150") if version == "b" else rows, ["x"], learn.linear("y"))})
    other = learn.fit(rows.filter("id < 100"), ["x"], learn.linear("y"))
    other.write().overwrite().save(f"{place}/a/model")
    with pytest.raises(DataQualityError, match="model"):
        artefacts.load(spark, place, "a")
    rows.limit(0).select("id").write.mode("overwrite").parquet(f"{place}/b/t")
    with pytest.raises(DataQualityError, match="t of b"):
        artefacts.load(spark, place, "b")
    rows.write.parquet(f"{place}/unfinished/t")
    with pytest.raises(Exception):
        artefacts.load(spark, place, "unfinished")


def entries(spark, ids, minute=0):
    made = [(f"e{i}", f"2024-01-01 00:{minute:02d}:{i % 60:02d}", "engine", f"A{i % 3}", "uploaded_file", "text", i % 2 == 0, "v1", "a" * 64) for i in ids]
    names = "id string, at string, component string, asset_id string, source string, summary string, review_required boolean, model_release string, input_digest string"
    return sinks.created(spark.createDataFrame(made, names).withColumn("at", F.col("at").cast("timestamp")))


def changes(spark, rows):
    return sinks.outcomes(spark.createDataFrame(rows, "id string, at string, outcome_status string").withColumn("at", F.col("at").cast("timestamp")), sinks.OUTCOMES)


def test_history_survives_compaction(spark, tmp_path):
    place = str(tmp_path / "history")
    assert sinks.read_history(spark, place).count() == 0
    sinks.append_history(entries(spark, range(10)), place)
    sinks.append_history(changes(spark, [("e1", "2024-01-02 00:00:00", "confirmed_fault"), ("lost", "2024-01-02 00:00:00", "inconclusive")]), place)
    view = lambda: sorted(map(tuple, sinks.current_history(sinks.read_history(spark, place)).select("id", "asset_id", "outcome_status").collect()))
    before = view()
    for _ in range(3):  # folding again changes nothing
        sinks.compact_history(spark, place)
        assert view() == before and [r["id"] for r in sinks.unknown_outcomes(sinks.read_history(spark, place)).select("id").distinct().collect()] == ["lost"]
    assert sinks.read_history(spark, place).count() == 12  # the appends lie behind: only the folded rows are read
    sinks.append_history(changes(spark, [("e1", "2024-01-01 12:00:00", "inconclusive"), ("e2", "2024-01-03 00:00:00", "no_fault_found")]), place)
    sinks.append_history(entries(spark, [77], minute=5), place)
    now = {r["id"]: r["outcome_status"] for r in sinks.current_history(sinks.read_history(spark, place)).collect()}
    assert len(now) == 11 and now["e1"] == "confirmed_fault" and now["e2"] == "no_fault_found"  # an earlier outcome that comes late changes nothing
    newest = sinks.newest_history(sinks.read_history(spark, place), 3).collect()
    assert [r["id"] for r in newest] == ["e77", "e9", "e8"] and newest[0]["created_at_utc"] == "2024-01-01T00:05:17Z"
    assert [r["id"] for r in sinks.newest_history(sinks.read_history(spark, place), 2, "A0").collect()] == ["e9", "e6"]
    with pytest.raises(DataQualityError):
        changes(spark, [("e1", "2024-01-02 00:00:00", "maybe")])
    with pytest.raises(ValueError):
        sinks.newest_history(sinks.read_history(spark, place), 201)


def test_ingest_counts_and_keeps_bad_rows(spark, tmp_path):
    frame = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 500.0)], "key long, x double")
    got = readers.ingest(frame, [quality.missing("x"), quality.non_finite("x"), quality.out_of_range("x", 0, 100)])
    assert (got.rows, got.broken) == (4, 3) and [r.key for r in got.good.collect()] == [1]
    bad = {r.key: r.broken_rules for r in got.bad.collect()}
    assert "non_finite:x" in bad[2] and "missing:x" in bad[3] and bad[4] == ["out_of_range:x"]
    empty = readers.ingest(frame.limit(0), [quality.missing("x")])
    assert (empty.rows, empty.broken, empty.good.count(), empty.bad.count()) == (0, 0, 0, 0)


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for folder, first in (("a", 10), ("b", 50)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "RUL.txt").write_text("\n".join(str(first + i) for i in range(3)) + "\n")
    rows = readers.read_life_labels(spark, f"{tmp_path}/*/RUL.txt").collect()
    assert sorted((r.path.split("/")[-2], r.unit_id, r.additional_rul) for r in rows) == [("a", 1, 10), ("a", 2, 11), ("a", 3, 12), ("b", 1, 50), ("b", 2, 51), ("b", 3, 52)]
