"""Quarantined CSV rows, v1 retraining, published bundles, cross-validation of all models."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

V1 = ["waste_type", "weight_kg", "distance_km", "consistency_score", "month", "day_of_week", "market_demand_index", "price_per_kg"]


def _v1_lines(n):
    rng = random.Random(4)
    base = {"plastic": 20, "metal": 60, "paper": 10}
    for _ in range(n):
        w, c = rng.choice(sorted(base)), round(rng.uniform(0.3, 1), 2)
        yield f"{w},{round(rng.uniform(1, 500), 1)},{rng.randint(1, 60)},{c},{rng.randint(1, 12)},{rng.randint(0, 6)},1.0,{round(base[w] * c, 2)}"


def test_bad_rows_are_set_apart_with_file_and_reason(spark, tmp_path):
    from baleprice.sources import io
    good = list(_v1_lines(20))
    files = {"a.csv": good[:10] + ["plastic,ten,1,0.5,1,1,1.0,9.0"], "b.csv": good[10:] + ["metal,5,1,0.5,1,1,1.0,"]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join([",".join(V1), *lines]) + "\n")
    rows, bad = io.read_csv_quarantined(spark, str(tmp_path), io.V1_TABLE_SCHEMA, ("price_per_kg",), ("sub_type",))
    assert rows.columns == io.V1_TABLE_SCHEMA.names and rows.count() == 20
    assert rows.select("month").count() == 20 and rows.filter("sub_type is not null").count() == 0
    got = {(os.path.basename(r.file), r.reason): r.record for r in bad.collect()}
    assert got.keys() == {("a.csv", "malformed"), ("b.csv", "no price_per_kg")}
    assert got["a.csv", "malformed"] == "plastic,ten,1,0.5,1,1,1.0,9.0"
    assert got["b.csv", "no price_per_kg"].startswith("metal,,5.0,1.0,0.5,1,1,1.0")
    with pytest.raises(ValueError, match="sub_type"):
        io.read_csv_quarantined(spark, str(tmp_path), io.V1_TABLE_SCHEMA)


def test_v1_retraining_from_the_documented_columns(spark, tmp_path):
    from baleprice.operators import train as T
    from pyspark.ml import PipelineModel
    path = tmp_path / "data.csv"
    path.write_text("\n".join([",".join(V1), *_v1_lines(400), "metal,x,1,0.5,1,1,1.0,9.0", "metal,5,1,,1,1,1.0,9.0"]) + "\n")
    model, figures = T.train_v1_from_csv(spark, str(path), str(tmp_path / "bad"), max_iter=5, max_depth=4, step=0.5)
    f = figures.first()
    assert f.trained + f.held_out == 400 and f.rejected == 2 and f.held_out > 40
    assert f.r2 > 0.8
    model.write().save(str(tmp_path / "model"))
    from baleprice.operators.features import v1_features
    one = spark.createDataFrame([("metal", None, 10.0, 5.0, 1.0, 3, 2, 1.0)], "waste_type string, sub_type string, "
                                "weight_kg double, distance_km double, consistency_score double, month int, "
                                "day_of_week int, market_demand_index double")
    assert PipelineModel.load(str(tmp_path / "model")).transform(v1_features(one)).first().pred_mid > 40


def test_range_models_train_on_the_good_rows(spark, tmp_path):
    from baleprice.operators import train as T
    from baleprice.sources import io
    from baleprice.sources.listings import TRAINING_COLUMNS, training_table
    path = str(tmp_path / "csv")
    io.write_csv(training_table(spark, SF_SMALL).select(*TRAINING_COLUMNS).limit(300).coalesce(1), path)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    header = open(f"{path}/{part}").readline()
    with open(f"{path}/bad.csv", "w") as f:
        f.write(header + ",".join(["x"] * len(TRAINING_COLUMNS)) + "\n")
    bundle = T.train_from_csv(spark, path, rounds=1, quarantine=str(tmp_path / "bad"))
    assert bundle.meta["rejected"] == spark.read.parquet(str(tmp_path / "bad")).count() >= 1
    with pytest.raises(Exception):
        T.train_from_csv(spark, path, rounds=1)


class Fake:
    """Stands for a bundle: prices every row alike."""
    def __init__(self, price):
        self.price, self.meta = price, {"rounds": 0}

    def score(self, df):
        return df.withColumns({"pred_lower": F.lit(self.price - 1), "pred_mid": F.lit(self.price), "pred_upper": F.lit(self.price + 1)})

    def save(self, path):
        os.makedirs(path)
        with open(f"{path}/price", "w") as f:
            f.write(str(self.price))

    @staticmethod
    def load(path):
        return Fake(float(open(f"{path}/price").read()))


def test_stream_takes_a_new_version_without_restart(spark, tmp_path, monkeypatch):
    from baleprice.operators import publish
    from baleprice.streaming.score_stream import start_published_stream
    monkeypatch.setattr(publish, "RangeModelBundle", Fake)
    root, source = str(tmp_path / "models"), tmp_path / "in"
    source.mkdir()
    request = {"waste_type": "plastic", "sub_type": "PET", "weight_kg": 10.0, "condition": "clean", "county": "Nairobi",
               "distance_km": 5.0, "collection_point": "household"}
    assert publish.latest_version(spark, root) is None
    (source / "1.json").write_text(json.dumps(request))
    query = start_published_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), root, rule_model=True)
    try:
        query.processAllAvailable()
        first = publish.publish(spark, Fake(10.0), root)
        Fake(99.0).save(f"{root}/version=99999999T000000-unfinished/bundle")  # its writer died before the manifest
        assert publish.latest_version(spark, root)[0] == first
        (source / "2.json").write_text(json.dumps(request))
        query.processAllAvailable()
        second = publish.publish(spark, Fake(30.0), root)
        assert second > first
        (source / "3.json").write_text(json.dumps(request))
        query.processAllAvailable()
    finally:
        query.stop()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("batch_id").collect()
    assert [(r.model_version, r.predictor) for r in out] == [(None, "rule"), (first, "model"), (second, "model")]
    prices = [r.response.price_range.recommended for r in out[1:]]
    assert prices[1] == pytest.approx(3 * prices[0], rel=0.01)


def test_published_bundle_is_saved_and_loaded(spark, tmp_path):
    from baleprice.operators import features as FE
    from baleprice.operators import publish
    from baleprice.operators import train as T
    from baleprice.sources.listings import training_table
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    feats = FE.v2_features(training_table(spark, SF_SMALL).limit(200), drop_inputs=False)
    bundle = T.train_range_bundle(feats, key, rounds=1)
    version = publish.publish(spark, bundle, str(tmp_path))
    held = publish.PublishedBundles(str(tmp_path))
    found, loaded = held.current(spark)
    assert found == version and held.current(spark)[1] is loaded
    assert loaded.meta == bundle.meta


def test_all_models_are_cross_validated_on_the_same_folds(spark):
    from baleprice.operators import features as FE
    from baleprice.operators import train as T
    from baleprice.sources.listings import training_table
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    feats = FE.v2_features(training_table(spark, SF_SMALL).limit(600), drop_inputs=False)
    folds = T.cross_validate_models(feats, key, folds=2, trees=2, boost_rounds=2)
    rows = folds.collect()
    assert len(rows) == 8 and len({r.model for r in rows}) == 4
    sizes = {}
    for r in rows:
        sizes.setdefault(r.fold, set()).add(r.n_rows)
    assert all(len(s) == 1 for s in sizes.values()) and sum(min(s) for s in sizes.values()) == 600
    for r in T.cv_by_model(folds).collect():
        mae = [x.mae for x in rows if x.model == r.model]
        assert r.cv_mae == pytest.approx(sum(mae) / 2) and r.folds == 2
        assert r.cv_mae_std == pytest.approx(abs(mae[0] - mae[1]) / 2 ** 0.5)
