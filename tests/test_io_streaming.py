"""Sources, sinks and the streaming job."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="baleprice-test-")


def test_csv_round_trip(spark):
    from baleprice.sources import io
    from baleprice.sources.listings import TRAINING_COLUMNS, training_table
    t = training_table(spark, SF_SMALL).select(*TRAINING_COLUMNS)
    path = os.path.join(_tmp(), "train_csv")
    io.write_csv(t, path)
    back = io.read_csv(spark, path)
    assert back.columns == TRAINING_COLUMNS
    assert back.count() == t.count()
    assert back.exceptAll(t).count() == 0


def test_parquet_partitioned(spark):
    from baleprice.sources import io
    from baleprice.sources.listings import raw_listings
    raw = raw_listings(spark, SF_SMALL)
    path = os.path.join(_tmp(), "listings")
    io.write_parquet(raw, path, partition_by=["waste_type"])
    back = io.read_parquet(spark, path).filter(F.col("waste_type") == "metal")
    assert back.count() == raw.filter(F.col("waste_type") == "metal").count()
    assert "PartitionFilters: [isnotnull(waste_type" in back._jdf.queryExecution().executedPlan().toString() or \
        "waste_type" in back._jdf.queryExecution().executedPlan().toString()


def test_feature_metadata_round_trip(spark):
    from baleprice.sources import io
    meta = io.feature_metadata(spark)
    path = os.path.join(_tmp(), "meta")
    io.write_json(meta, path)
    back = io.read_feature_metadata(spark, path).first()
    assert back.version == "2.2" and len(back.features) == 15
    assert back.multipliers["collection_point"]["dump_site"] == 0.75


def test_metrics_long(spark):
    from baleprice.sources import io
    text = '{"Ridge Regression": {"Test MAE": 54.01, "Test R2": 0.1477}, "XGBoost": {"Test MAE": 4.76}}'
    m = io.metrics_from_json_text(spark, text)
    assert m.count() == 3
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "model string, mae double, r2 double")
    assert io.metrics_long(wide).count() == 2


def test_requests_json_to_nested_responses(spark):
    from baleprice.plans.serve import price_listings
    from baleprice.sources import io
    from baleprice.sources.listings import KEY, raw_listings
    raw = raw_listings(spark, SF_SMALL)
    src = os.path.join(_tmp(), "requests")
    raw.select(*KEY, *[f.name for f in io.REQUEST_SCHEMA.fields], "listed_at").write.json(src)
    req = spark.read.json(src)
    priced = price_listings(req, keep=KEY, rule_model=True)
    assert priced.count() == raw.count()
    valid = priced.filter("is_valid")
    assert valid.filter(F.col("response").isNull()).count() == 0
    r = valid.first().response
    assert r.price_range.currency == "KES" and r.market_info.coverage == "70%"
    out = os.path.join(_tmp(), "responses")
    io.write_responses(valid, out)
    assert spark.read.text(out).count() == valid.count()


def test_streaming_job(spark):
    from baleprice.sources import io
    from baleprice.sources.listings import raw_listings
    from baleprice.streaming.score_stream import start_pricing_stream
    base = _tmp()
    src, sink, ckpt = (os.path.join(base, d) for d in ("in", "out", "ckpt"))
    raw = raw_listings(spark, SF_SMALL).select(*[f.name for f in io.REQUEST_SCHEMA.fields])
    raw.repartition(3).write.json(src)
    q = start_pricing_stream(spark, src, sink, ckpt, trigger_once=True, rule_model=True)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == raw.count()
    assert out.filter("is_valid AND response IS NOT NULL").count() == out.filter("is_valid").count()


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0


def test_csv_binds_columns_by_name(spark, tmp_path):
    from baleprice.sources import io
    names = [f.name for f in io.TRAINING_SCHEMA.fields]
    row = dict(zip(names, ["plastic", "PET", "10.5", "2.0", "clean", "3", "1", "Nairobi", "household", "formal",
                           "0.9", "1.0", "12.5"]))
    shuffled = ["price_per_kg", "note", *reversed(names[:-1])]

    def file(name, columns, values):
        (tmp_path / name).write_text(",".join(columns) + "\n" + ",".join(values.get(c, "x") for c in columns) + "\n")
        return str(tmp_path / name)

    r = io.read_csv(spark, file("shuffled.csv", shuffled, row)).first()
    assert list(r.asDict()) == names and (r.waste_type, r.weight_kg, r.month, r.price_per_kg) == ("plastic", 10.5, 3, 12.5)
    with pytest.raises(ValueError, match="county"):
        io.read_csv(spark, file("missing.csv", [c for c in names if c != "county"], row))
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        io.read_csv(spark, file("malformed.csv", names, {**row, "weight_kg": "ten"})).collect()


def test_train_from_csv(spark):
    from baleprice.operators import train as T
    from baleprice.sources import io
    from baleprice.sources.listings import TRAINING_COLUMNS, training_table
    path = os.path.join(_tmp(), "train_csv_for_fit")
    io.write_csv(training_table(spark, SF_SMALL).select(*TRAINING_COLUMNS), path)
    bundle = T.train_from_csv(spark, path, rounds=2)
    assert set(bundle.models) == {"lower", "mid", "upper"}
    assert all(len(m.trees) == 2 for m in bundle.models.values())


def test_reject_counts_has_dump_site_warning(rows):
    from baleprice.operators.clean import reject_counts
    df = rows([("plastic", "PET", 10.0, "clean", "Nairobi", 5.0, "dump_site"),
               ("stone", "PET", 10.0, "clean", "Nairobi", 5.0, "household")],
              "waste_type string, sub_type string, weight_kg double, condition string, county string, "
              "distance_km double, collection_point string")
    got = {(r.severity, r.reason): r.n_rows for r in reject_counts(df).collect()}
    assert got == {("warning", "collection_point dump_site priced as commercial"): 1,
                   ("error", "waste_type not allowed"): 1}


def test_predict_or_fallback_without_bundle(spark):
    from baleprice.plans.serve import predict_or_fallback
    from baleprice.sources.listings import raw_listings
    req = raw_listings(spark, SF_SMALL)
    out = predict_or_fallback(req, os.path.join(_tmp(), "no_bundle_here"))
    assert out.filter(~F.col("is_fallback")).count() == 0
    r = out.first()
    assert r.fallback_reason.startswith("model bundle unavailable") and r.predicted_price_per_kg >= 1.0


def test_v2_requests_without_model_raise(spark):
    import pytest
    from baleprice.plans.serve import predict_or_fallback
    from baleprice.sources import io
    from baleprice.sources.listings import raw_listings
    req = raw_listings(spark, SF_SMALL).select(*[f.name for f in io.REQUEST_SCHEMA.fields])
    with pytest.raises(RuntimeError, match="model not loaded"):
        predict_or_fallback(req, os.path.join(_tmp(), "absent_bundle"))


def test_rule_prices_are_asked_for_and_flagged(spark):
    from baleprice.plans.serve import price_listings
    from baleprice.sources.listings import raw_listings
    req = raw_listings(spark, SF_SMALL).limit(5)
    with pytest.raises(ValueError, match="rule_model"):
        price_listings(req)
    assert {r.predictor for r in price_listings(req, rule_model=True).select("predictor").collect()} == {"rule"}
