"""Frequency table, histogram and quantile sketches of the report."""

import random

import numpy as np
from pyspark.sql import functions as F

from baleprice.operators import report as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_against_numpy(spark):
    rng = random.Random(3)
    values = [None] + [round(rng.gauss(20, 7), 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    got = R.histogram(df, "x", 12).collect()
    counts, edges = np.histogram([v for v in values if v is not None], 12)
    assert [r.n_rows for r in got] == counts.tolist()
    np.testing.assert_allclose([r.bin_lo for r in got] + [got[-1].bin_hi], edges)


def test_histogram_of_one_value_and_of_none(spark):
    one = R.histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double"), "x", 4).collect()
    assert [r.n_rows for r in one] == [2, 0, 0, 0]
    none = R.histogram(spark.createDataFrame([(None,)], "x double"), "x", 4).collect()
    assert [(r.n_rows, r.bin_lo) for r in none] == [(0, None)] * 4


def test_histogram_reads_its_input_once_and_runs_nothing_before(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("histogram-build", "")
    h = R.histogram(df, "l_extendedprice")
    assert len(tracker.getJobIdsForGroup("histogram-build")) == 0
    h.collect()
    spark.sparkContext.setJobGroup("other", "")
    assert "ReusedExchange" in _plan(h) and "NestedLoop" not in _plan(h)


def test_sketch_quantiles_have_small_rank_errors(spark):
    rng = random.Random(8)
    rows = [(f"g{i % 3}", i % 4, rng.lognormvariate(0, 2) * (1 + i % 3)) for i in range(30_000)] + [("g0", 0, None), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, day int, x double").repartition(6)
    daily = R.quantile_sketches(df, F.col("x"), ["g", "day"])
    qs = {"a": 0.05, "b": 0.5, "c": 0.95}
    for r in R.sketch_quantiles(R.merged_sketches(daily, ["g"]), qs).collect():
        if r.g is None:
            assert (r.n_rows, r.a, r.b, r.c) == (1, 2.0, 2.0, 2.0)
            continue
        values = np.sort([x for g, _, x in rows if g == r.g and x is not None])
        assert r.n_rows == len(values)
        for name, q in qs.items():
            assert abs(np.searchsorted(values, r[name]) / len(values) - q) < 0.02


def test_stored_sketches_merge_to_those_of_all_rows(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 5).alias("day"), F.col("id").cast("double").alias("x"))
    for day in range(5):
        R.quantile_sketches(df.filter(F.col("day") == day), F.col("x"), ["day"]).write.mode("append").parquet(f"{tmp_path}/s")
    got = R.sketch_quantiles(R.merged_sketches(spark.read.parquet(f"{tmp_path}/s"), []), {"median": 0.5}).first()
    assert got.n_rows == 2000 and abs(got.median - 1000) < 40
