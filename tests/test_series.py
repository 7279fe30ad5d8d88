"""Both layouts of ordered work must agree, whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearpath.operators import order_stats
from wearpath.operators.series import series


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(t), float(x)) for t, x in enumerate(rng.normal(50, 9, 400))]
    rows += [("b", int(t), float(x)) for t, x in enumerate(rng.normal(5, 2, 37))]
    rows += [("c", 4, 1.5)]
    rows += [(None, int(t), float(x)) for t, x in enumerate(rng.normal(9, 1, 53))]
    pdf = pd.DataFrame(rows, columns=["unit", "t", "x"]).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf).withColumn("maybe", F.when(F.col("t") % 17 == 3, F.col("x")))


def both(frame, step, block_rows=19):
    out = []
    for rows in (10_000, block_rows):
        s = series(frame, "unit", "t", rows)
        assert s.blocked == (rows == block_rows)
        pdf = step(s).frame.toPandas().sort_values(["unit", "t"]).reset_index(drop=True)
        out.append(pdf[sorted(pdf.columns)])
    pd.testing.assert_frame_equal(*out, rtol=1e-9, atol=1e-9)
    return out[0]


def test_number(frame):
    pdf = both(frame, lambda s: s.number("n"))
    assert (pdf.n == pdf.groupby("unit", dropna=False).cumcount() + 1).all()


def test_trailing(frame):
    both(frame, lambda s: s.trailing(9, lambda f: {
        "mean": F.avg("x").over(f.last(9)), "lag": F.lag("x", 8).over(f.ordered),
        "med": F.percentile("x", 0.5).over(f.last(5)), "prior": F.min("x").over(f.before(4))}))


def test_totals(frame):
    both(frame, lambda s: s.totals(hi=F.max("x"), n=F.count("*")))


@pytest.mark.parametrize("reverse", [False, True])
def test_running(frame, reverse):
    x, m = F.col("x"), F.col("maybe")
    both(frame, lambda s: s.running(reverse, a=("sum", x), b=("count", m), c=("min", x), d=("max", m), e=("last", m)))


def test_ewm(frame):
    pdf = both(frame, lambda s: s.ewm({"e5": ("x", 5), "e20": ("x", 20)}))
    expected = pdf.groupby("unit", dropna=False).x.transform(lambda v: v.ewm(span=20, adjust=False).mean())
    assert np.allclose(pdf.e20, expected)


def test_no_unit(frame):
    out = []
    for rows in (10_000, 23):
        s = series(frame, (), ("x", "unit", "t"), rows).number("n").totals(c=F.count("*"))
        s = s.running(r=("sum", F.lit(1)))
        out.append(s.frame.toPandas().sort_values("n").reset_index(drop=True))
    pd.testing.assert_frame_equal(out[0], out[1][out[0].columns])


def test_quantiles_keep_null_and_empty_groups(spark):
    rows = [("a", float(i % 40)) for i in range(300)] + [("b", None)] * 5 + [(None, float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, x double")
    small, large = (
        {r.g: r.m for r in order_stats.quantiles(df, ["g"], {"m": order_stats.median("x")}, small_rows=n).collect()} for n in (10_000, 20))
    assert set(small) == {"a", "b", None} and small == large


def test_placed_rows_and_ranks_are_written_once(spark, tmp_path):
    """What follows a block layout or a bracketed quantile reads its written rows; the source is not placed or sketched anew."""
    source = str(tmp_path / "rows")
    spark.range(400).selectExpr("id % 2 AS unit", "id AS at", "cast(id * 7 % 101 AS double) AS x").write.parquet(source)
    rows = spark.read.parquet(source)
    s = series(rows, "unit", "at", block_rows=50)
    assert s.blocked and not any(source in f for f in s.number("n").frame.inputFiles())
    low, mid, high = (("x", q, rule(q)) for q, rule in ((0.01, order_stats.linear), (0.5, order_stats.linear), (0.5, order_stats.higher)))
    found = order_stats.quantiles(rows, ["unit"], {"low": low, "mid": mid, "high": high}, small_rows=10)
    assert not any(source in f for f in found.inputFiles())
    for unit, low, mid, high in found.collect():
        x = np.array([i * 7 % 101 for i in range(400) if i % 2 == unit], dtype=float)
        assert (low, mid, high) == pytest.approx((np.quantile(x, 0.01), np.quantile(x, 0.5), np.quantile(x, 0.5, method="higher")))
