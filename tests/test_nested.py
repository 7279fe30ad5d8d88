"""The nested detector evaluation multiplies no rows that are written or sorted."""

from wearpath.plans import detectors


def test_cells_do_not_multiply_what_is_written(spark, sf_dir, monkeypatch):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    written, write = {}, detectors.materialise

    def counted(df, purpose):
        back = write(df, purpose)
        written[purpose] = back.count()
        return back

    monkeypatch.setattr(detectors, "materialise", counted)
    got = detectors.nested_evaluation(spark, sf_dir)
    assert "variants" in written and max(written.values()) <= 2 * events, written
    assert got.groupBy("outer", "scenario", "position").count().filter("count > 1").count() == 0
