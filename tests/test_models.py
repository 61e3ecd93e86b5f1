"""Model queries: invariants (random split, trained trees) and save/load."""

import pytest
from pyspark.sql import functions as F

from baleprice.functions.numeric import row_digest
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    from baleprice.operators import features as FE
    from baleprice.operators import train as T
    from baleprice.sources.listings import KEY, training_table
    feats = FE.v2_features(T.split_train_test(training_table(spark, SF_SMALL), KEY), drop_inputs=False).cache()
    bundle = T.train_range_bundle(feats.filter(~F.col("is_test")), KEY, rounds=4, parallel=True)
    return feats, bundle


def test_split_is_stable_and_near_15pct(spark, trained):
    feats, _ = trained
    n, n_test = feats.count(), feats.filter("is_test").count()
    assert 0.10 < n_test / n < 0.20
    assert feats.filter("is_test").count() == n_test  # deterministic


def test_ranges_ordered_after_guard(trained):
    from baleprice.operators import scoring as SC
    feats, bundle = trained
    post = SC.postprocess_range(bundle.score(feats.filter("is_test")), "v2")
    bad = post.filter(~((F.col("lower_bound") <= F.col("recommended")) & (F.col("recommended") <= F.col("upper_bound"))))
    assert bad.count() == 0


def test_boosting_beats_constant_and_covers(trained):
    from baleprice.operators import evaluate as E
    from baleprice.operators.train import QuantileBoostModel
    feats, bundle = trained
    test = feats.filter("is_test")
    scored = bundle.score(test)
    m = E.interval_metrics(scored).first()
    assert 0.0 <= m.coverage <= 1.0 and m.coverage > 0.6
    const = QuantileBoostModel(0.95, bundle.models["upper"].f0, 0.3)
    base = E.interval_metrics(const.predict(test.withColumn("features", F.lit(None)), "pred_upper")
                              .withColumn("pred_lower", F.col("pred_upper")).withColumn("pred_mid", F.col("pred_upper"))).first()
    assert m.pinball_upper < base.pinball_upper


def test_importances_normalised(trained):
    _, bundle = trained
    imp = bundle.models["mid"].feature_importances()
    assert len(imp) == 15 and all(v >= 0 for v in imp) and abs(sum(imp) - 1) < 1e-9


def test_bundle_round_trip(spark, trained, tmp_path):
    from baleprice.operators.train import RangeModelBundle
    feats, bundle = trained
    path = str(tmp_path / "bundle")
    bundle.save(path)
    again = RangeModelBundle.load(path)
    test = feats.filter("is_test")
    a = bundle.score(test).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                  "pred_mid").collect()
    b = again.score(test).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                 "pred_mid").collect()
    assert sorted(a) == sorted(b)


def test_missing_bundle_raises(spark, tmp_path):
    from baleprice.operators.train import RangeModelBundle
    with pytest.raises(Exception):
        RangeModelBundle.load(str(tmp_path / "absent"))


def test_permutation_covers_the_whole_table(spark):
    from baleprice.operators.train import permuted
    from baleprice.sources.listings import KEY, training_table
    t = training_table(spark, SF_SMALL).select(*KEY, "weight_kg").withColumn("me", F.xxhash64(*KEY))
    p = permuted(t, KEY, ["weight_kg", "me"], seed=3).cache()
    n = t.count()
    assert p.count() == n and p.select("me").distinct().count() == p.select("_perm.me").distinct().count() == n
    assert p.filter("_perm.me = me").count() < 12  # fixed points: 1 on average
    assert sorted(r[0] for r in t.select("weight_kg").collect()) == sorted(r[0] for r in p.select("_perm.weight_kg").collect())
    again = permuted(t.repartition(3), KEY, ["weight_kg", "me"], seed=3)
    assert {tuple(r) for r in again.select("me", "_perm.me").collect()} == {tuple(r) for r in p.select("me", "_perm.me").collect()}
    other = permuted(t, KEY, ["me"], seed=4)
    assert other.select("me", "_perm.me").intersect(p.select("me", "_perm.me")).count() < 12


def test_permutation_matches_brute_force(spark):
    from baleprice.operators.train import permuted
    df = spark.createDataFrame([(i, float(i * i)) for i in range(57)], "id long, v double").repartition(4)
    got = {r.id: r.v for r in permuted(df, ["id"], ["v"], seed=9).select("id", "_perm.v").collect()}
    rows = df.select("id", "v", row_digest(["id"], 9).alias("h")).collect()
    ranked = sorted(rows, key=lambda r: (r.h, r.id))
    hashes = {r.n: r.h for r in spark.range(57).select(F.col("id").alias("n"), F.xxhash64("id", F.lit(9)).alias("h")).collect()}
    order = sorted(range(57), key=lambda n: (hashes[n], n))
    assert got == {r.id: ranked[order[n]].v for n, r in enumerate(ranked)}


def test_dense_number_matches_the_sorted_order(spark):
    from baleprice.functions.numbering import dense_number
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)] , "a long, b string").repartition(6)
    assert {r.a: r.n for r in dense_number(df, ["b", "a"], "n").collect()} == {a: a for a in range(101)}
    assert dense_number(df.limit(0), ["a"], "n").collect() == []


def test_ensemble_scores_as_its_trees_do(spark, trained):
    feats, bundle = trained
    rows = bundle.pipeline.transform(feats.filter("is_test")).select("features").limit(200)
    for name, model in bundle.models.items():
        def by_hand(x):
            total = model.f0 + model.shift
            for tree in model.trees:
                at = tree[0]
                while len(at) == 4:
                    feature, split, left, right = at
                    goes = x[feature] in split if isinstance(split, list) else x[feature] <= split
                    at = tree[left if goes else right]
                total += model.learning_rate * at[1]
            return total
        for r in model.predict(rows, "p").collect():
            assert abs(r.p - by_hand(r.features.toArray().tolist())) < 1e-9, name
        assert any(isinstance(n[1], list) for tree in model.trees for n in tree if len(n) == 4)


def test_plan_of_an_ensemble_does_not_grow_with_rounds(spark, trained):
    from dataclasses import replace
    feats, bundle = trained
    vectors = bundle.pipeline.transform(feats).select("features")
    mid = bundle.models["mid"]
    lengths = [len(replace(mid, trees=mid.trees * n, _ensemble=None).predict(vectors, "p")._jdf.queryExecution().toString())
               for n in (1, 25)]
    assert abs(lengths[0] - lengths[1]) < 50


def test_leaf_values_are_thresholded_and_shrunk():
    from baleprice.operators.boost import leaf_value
    assert leaf_value(2.0, 10, 0.0, 0.0) == 2.0
    assert leaf_value(2.0, 10, 1.0, 10.0) == 0.95
    assert leaf_value(-2.0, 10, 1.0, 10.0) == -0.95
    assert leaf_value(0.01, 3, 0.05, 0.5) == 0.0


def test_tree_nodes_from_a_tree_description():
    from baleprice.operators.boost import tree_nodes
    text = """DecisionTreeRegressionModel: uid=dtr, depth=2, numNodes=5, numFeatures=3
  If (feature 2 in {0.0,3.0})
   Predict: 1.5
  Else (feature 2 not in {0.0,3.0})
   If (feature 0 <= -1.25E-4)
    Predict: -2.0E-5
   Else (feature 0 > -1.25E-4)
    Predict: 7.0
"""
    assert tree_nodes(text) == [(2, [0.0, 3.0], 1, 2), (0, 1.5), (0, -1.25e-4, 3, 4), (1, -2e-5), (2, 7.0)]


def test_saved_pipeline_equals_the_encoders_on_unseen_values(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from baleprice.operators import train as T
    ddl = "id long, kind string, town string, w double, flat double"
    seen = spark.createDataFrame([(1, "b", "x", 1.0, 5.0), (2, "a", "y", 2.0, 5.0), (3, "c", "x", 6.0, 5.0), (4, None, "z", None, 5.0)], ddl)
    asked = spark.createDataFrame([(1, "c", "x", 3.0, 5.0), (2, "new", "z", 0.0, 7.0), (3, None, "ab", None, None), (4, "", None, -1.0, 5.0)], ddl)
    cat, num = ["kind", "town"], ["w", "flat"]
    estimator = T.ColumnEncoder(catCols=cat, numCols=num)
    estimator.save(str(tmp_path / "estimator"))
    fitted = T.ColumnEncoder.load(str(tmp_path / "estimator")).fit(seen)
    fitted.save(str(tmp_path / "pipeline"))
    got = PipelineModel.load(str(tmp_path / "pipeline")).transform(asked)
    want = T.fit_scaler(seen, num).transform(T.apply_ordinal(asked, T.fit_ordinal(seen, cat)))
    cols = ["id", *[c + "_code" for c in cat], *[c + "_scaled" for c in num]]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert {(r.id, r.kind_code, r.town_code) for r in got.collect()} == {(1, 2, 0), (2, -1, 2), (3, -1, -1), (4, -1, -1)}
    slots = {r.id: r.features.toArray().tolist()[:2] for r in got.collect()}
    assert slots == {1: [3, 1], 2: [0, 3], 3: [0, 0], 4: [0, 0]}
    assert T.categories(fitted) == {0: 4, 1: 4}


def test_sample_per_group_matches_brute_force(spark):
    from baleprice.operators.report import sample_per_group
    from baleprice.sources.listings import KEY, training_table
    t = training_table(spark, SF_SMALL)
    got = sample_per_group(t, "condition", 50, KEY, seed=42, salt_buckets=8)
    hashed = t.select(*KEY, "condition", row_digest(KEY, 42).alias("h")).toPandas()
    hashed = hashed.sort_values(["condition", "h"] + KEY)
    want = set(map(tuple, hashed.groupby("condition").head(50)[KEY].itertuples(index=False)))
    have = {tuple(r) for r in got.select(*KEY).collect()}
    assert have == want
    sizes = {r.condition: r["count"] for r in got.groupBy("condition").count().collect()}
    assert all(v == 50 for v in sizes.values())


def test_conditional_quantiles_match_pandas(spark):
    from baleprice.operators.train import fit_conditional_quantiles
    from baleprice.sources.listings import training_table
    t = training_table(spark, SF_SMALL)
    got = {(r.waste_type, r.sub_type, r.condition): r.q50 for r in fit_conditional_quantiles(t).collect()}
    pdf = t.toPandas()
    want = pdf.groupby(["waste_type", "sub_type", "condition"])["price_per_kg"].quantile(0.5).to_dict()
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_training_loss_falls(trained):
    _, bundle = trained
    for name, m in bundle.models.items():
        h = m.history
        assert len(h) == len(m.trees) and h[-1] < h[0], (name, h)


def test_price_listings_with_bundle(spark, trained):
    from baleprice.plans.serve import price_listings
    from baleprice.sources.listings import KEY, raw_listings
    _, bundle = trained
    req = raw_listings(spark, SF_SMALL).limit(300)
    out = price_listings(req, bundle=bundle, keep=KEY)
    valid = out.filter("is_valid")
    assert valid.filter(F.col("response").isNull()).count() == 0
    pr = valid.select("response.price_range.*")
    assert pr.filter(~((F.col("lower_bound") <= F.col("recommended")) &
                       (F.col("recommended") <= F.col("upper_bound")))).count() == 0
    assert out.filter("NOT is_valid AND response IS NOT NULL").count() == 0
    assert out.filter("predictor != 'model'").count() == 0


def test_sample_n_matches_brute_force(spark):
    from baleprice.operators.report import sample_n
    from baleprice.sources.listings import KEY, training_table
    t = training_table(spark, SF_SMALL)
    got = {tuple(r) for r in sample_n(t, 100, KEY, seed=7, salt_buckets=4).select(*KEY).collect()}
    pdf = t.select(*KEY, row_digest(KEY, 7).alias("h")).toPandas()
    want = set(map(tuple, pdf.sort_values(["h"] + KEY).head(100)[KEY].itertuples(index=False)))
    assert got == want


def test_early_stopping_keeps_best_prefix(spark, trained):
    from baleprice.operators import train as T
    from baleprice.sources.listings import KEY
    feats, bundle = trained
    feat = bundle.pipeline.transform(feats).select(*KEY, "price_per_kg", "features", "is_test")
    train, valid = feat.filter("NOT is_test"), feat.filter("is_test")
    m = T.fit_quantile_boost(train, 0.5, KEY, rounds=6, learning_rate=0.6, valid=valid, patience=1)
    assert 1 <= len(m.trees) <= 6 and len(m.valid_history) >= len(m.trees)
    best = min(range(len(m.valid_history)), key=lambda i: m.valid_history[i]) + 1
    assert len(m.trees) == best


def test_predict_or_fallback_with_bundle(spark, trained, tmp_path):
    from baleprice.plans.serve import predict_or_fallback
    from baleprice.sources.listings import KEY, raw_listings
    _, bundle = trained
    path = str(tmp_path / "bundle_for_serving")
    bundle.save(path)
    out = predict_or_fallback(raw_listings(spark, SF_SMALL), path, keep=KEY)
    assert out.filter("is_fallback").count() == 0
    assert out.filter("is_valid AND response IS NULL").count() == 0


def test_quantile_tables_back_off_to_the_waste_type(spark):
    from baleprice.operators import train as T
    rows = [("plastic", "PET", "clean", float(p)) for p in range(1, 22)] + [("plastic", "PVC", "mixed", 100.0)]
    cols = "waste_type string, sub_type string, condition string, price_per_kg double"
    model = T.fit_quantile_tables(spark.createDataFrame(rows + [("plastic", None, "clean", None)], cols))
    asked = spark.createDataFrame([("plastic", "PET", "clean"), ("plastic", "new", "clean"), ("metal", "PET", "clean"),
                                   ("plastic", None, None)], "waste_type string, sub_type string, condition string")
    got = {(r.waste_type, r.sub_type): (r.pred_lower, r.pred_mid, r.pred_upper) for r in model.score(asked).collect()}
    assert got["plastic", "PET"] == (2.0, 11.0, 20.0)
    assert got["plastic", "new"] == got["plastic", None] == (2.05, 11.5, 20.95)
    assert got["metal", "PET"] == (None, None, None)


def test_row_bucket_is_the_md5_of_the_key(spark):
    import hashlib
    from baleprice.functions.numeric import row_bucket
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string").withColumn("k", row_bucket(["a", "b"], 5, 100))
    want = {a: int(hashlib.md5(f"{a}|{b or ''}|5".encode()).hexdigest()[:8], 16) % 100 for a, b in [(1, "x"), (2, None)]}
    assert {r.a: r.k for r in df.collect()} == want


def _own_features(spark, n: int, partitions: int):
    from baleprice.operators import train as T
    cats = [F.concat(F.lit("v"), (F.col("id") % (i + 2)).cast("string")).alias(c) for i, c in enumerate(T.CAT)]
    nums = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 10.0).alias(c) for i, c in enumerate(T.NUM)]
    rows = spark.range(n).select("id", (F.col("id") % 37 + 1.5).alias("price_per_kg"), *cats, *nums)
    return rows.repartition(partitions, "id")


def test_trees_grow_on_few_partitions(spark, monkeypatch):
    from baleprice.functions import dims as D
    from baleprice.operators import train as T
    seen = []

    def fit(data, quantiles, key, **kw):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return {name: T.QuantileBoostModel(q, 1.0, 0.3) for name, q in quantiles.items()}

    monkeypatch.setattr(T, "fit_boosts", fit)
    cores = spark.sparkContext.defaultParallelism
    assert set(T.train_range_bundle(_own_features(spark, 600, 40), ["id"]).models) == set(D.QUANTILES)
    assert seen == [(min(40, 2 * cores), 600)]
    monkeypatch.setattr(T, "TREE_ROWS", 20)
    T.train_range_bundle(_own_features(spark, 600, 40), ["id"])
    assert seen[1] == (max(30, min(40, 2 * cores)), 600)


def test_report_takes_one_bundle(spark, monkeypatch):
    from types import SimpleNamespace
    from baleprice.operators import train as T
    from baleprice.plans import catalog
    scored = spark.range(50).select((F.col("id") + 2.0).alias("price_per_kg"), (F.col("id") + 1.0).alias("pred_lower"),
                                    (F.col("id") + 2.5).alias("pred_mid"), (F.col("id") + 3.0).alias("pred_upper"),
                                    F.lit(True).alias("is_test"))
    mid = SimpleNamespace(feature_importances=lambda: [(i + 1.0) / 120 for i in range(len(T.FEATURES))])
    taken = []
    monkeypatch.setattr(catalog, "_bundle", lambda *a: taken.append(a) or SimpleNamespace(models={"mid": mid}, score=lambda df: df))
    monkeypatch.setattr(catalog, "_split_features", lambda *a: scored)
    monkeypatch.setattr(catalog, "report_stats", lambda *a: spark.createDataFrame(
        [("data", "n", 1.0)], "section string, metric string, value double"))
    rows = catalog.model_report(spark, "own").collect()
    assert len(taken) == 1
    by = {s: [r for r in rows if r.section == s] for s in ("data", "model performance", "top features", "feature families")}
    assert len(by["top features"]) == 5 and by["top features"] and by["model performance"] and by["data"]
    assert abs(sum(r.value for r in by["feature families"]) - 100) < 1e-3


def test_few_partitions_keep_their_order(spark):
    from baleprice.operators import train as T
    n = 2 * spark.sparkContext.defaultParallelism
    rows = _own_features(spark, 300, n).select("id").persist()

    def places(df):
        return {(r.id, r.p) for r in df.withColumn("p", F.spark_partition_id()).collect()}

    rows.count()
    before = places(rows)
    assert places(T.in_tree_partitions(rows, 300)) == before
    assert len({p for _, p in places(T.in_tree_partitions(rows.repartition(3 * n), 300))}) <= n
    rows.unpersist()
