"""Model fitting on Spark: split, encoders, quantile models, importances, CV, comparison."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numbering import dense_number
from baleprice.functions.numeric import round_even, row_bucket, row_digest
from baleprice.operators.boost import QuantileBoostModel, fit_boosts, fit_quantile_boost
from baleprice.operators.encoders import (ColumnEncoder, OrdinalModel, ScalerModel, apply_ordinal,  # noqa: F401
                                          categories, encoded_columns, fit_ordinal, fit_scaler, ordinal_codes)
from baleprice.session import cut_lineage

GROUP = ["waste_type", "sub_type", "condition"]


def fit_conditional_quantiles(df: DataFrame, y: str = "price_per_kg", keys: list[str] | None = None,
                              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Conditional 5/50/95 % quantiles of ``y`` per key group -- the simple, SQL-checkable range model.

    Exact ``percentile`` keeps one counter per distinct value of the group and aggregates partially in
    every task; for a money column rounded to cents this is bounded by the price range. ``approx=True``
    switches to ``percentile_approx`` (fixed-size sketch) for continuous targets."""
    keys = keys or GROUP
    qs = [D.QUANTILES["lower"], D.QUANTILES["mid"], D.QUANTILES["upper"]]
    names = ["q05", "q50", "q95"]
    if approx:
        aggs = [F.percentile_approx(y, q, accuracy).alias(n) for q, n in zip(qs, names)]
    else:
        aggs = [F.percentile(y, q).alias(n) for q, n in zip(qs, names)]
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


QUANTILE_COLS = {"q05": "pred_lower", "q50": "pred_mid", "q95": "pred_upper"}


@dataclass
class ConditionalQuantileModel:
    """Range model of two tables: quantiles per (waste type, sub-type, condition), and per waste type for rows whose
    group has no training rows. ``score`` takes any frame with these columns, so that it stands where a
    ``RangeModelBundle`` does; a row of an unknown waste type gets NULL predictions."""
    groups: DataFrame
    fallback: DataFrame

    def score(self, df: DataFrame) -> DataFrame:
        own = self.groups.select(*[F.col(k).alias(f"_{k}") for k in GROUP], *QUANTILE_COLS)
        back = self.fallback.select(F.col("waste_type").alias("_backoff"),
                                    *[F.col(q).alias(f"_{q}") for q in QUANTILE_COLS])
        same = [F.col(k) == F.col(f"_{k}") for k in GROUP]
        joined = df.join(own, same, "left").join(back, F.col("waste_type") == F.col("_backoff"), "left")
        return joined.withColumns({p: F.coalesce(q, f"_{q}") for q, p in QUANTILE_COLS.items()}).drop(
            *[f"_{k}" for k in GROUP], "_backoff", *QUANTILE_COLS, *[f"_{q}" for q in QUANTILE_COLS])


def fit_quantile_tables(train: DataFrame, y: str = "price_per_kg", digits: int = 6) -> ConditionalQuantileModel:
    """The conditional quantiles of ``train`` by group and by waste type, both to ``digits`` decimals. The training
    rows are counted per (group, price) once, and both tables come from these counts: they are checkpointed, as each
    table's filter would otherwise reach the training rows and have them read again."""
    counts = cut_lineage(train.filter(F.col(y).isNotNull()).groupBy(*GROUP, y).agg(F.count(F.lit(1)).alias("n")))

    def table(keys: list[str]) -> DataFrame:
        qs = [round_even(F.percentile(y, D.QUANTILES[name], F.col("n")), digits).alias(q)
              for name, q in zip(("lower", "mid", "upper"), QUANTILE_COLS)]
        return counts.dropna(subset=keys).groupBy(*keys).agg(*qs)

    return ConditionalQuantileModel(table(GROUP), table(["waste_type"]))


# ---------------------------------------------------------------------------------------------------
# I1 split, I4 feature pipeline, F1 three models
# ---------------------------------------------------------------------------------------------------


CAT = D.CATEGORICAL_FEATURES
NUM = D.NUMERIC_FEATURES
FEATURES = CAT + NUM


def split_train_test(df: DataFrame, key: list[str], test_pct: int = 15, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` (about ``test_pct`` % of rows) from a seeded hash of the row key."""
    return df.withColumn("is_test", row_bucket(key, seed, 100) < F.lit(test_pct))


def feature_pipeline() -> ColumnEncoder:
    """I4: ordinal codes of the categorical features (-1 for unseen values) and scaled numeric features as one vector."""
    return ColumnEncoder(catCols=CAT, numCols=NUM, outputCol="features")


def tree_bins(pipe: PipelineModel, floor: int = 32) -> int:
    """Histogram bins for the trees: 32, or more when a categorical feature has more values."""
    return max(floor, *categories(pipe).values())


#: Rows of a partition that trees are grown on, where the cores don't call for smaller ones.
TREE_ROWS = 250_000


def in_tree_partitions(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` in at most two partitions a core, or more where these would exceed ``TREE_ROWS``: each level of each tree is
    a job over all partitions whose tasks allot and send histograms of their own, however few their rows. Nothing is
    shuffled. Frames of no more partitions stay as they are: a coalesce would put them in another order, and Spark ML draws
    by partition number (split candidates beyond 10,000 rows, bootstraps)."""
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / TREE_ROWS))
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def fit_range_models(train_feat: DataFrame, key: list[str], parallel: bool = True, **kw) -> dict:
    """The lower / mid / upper models, fitted side by side on one frame (not ``parallel``: one after the other, the same)."""
    if parallel:
        return fit_boosts(train_feat, D.QUANTILES, key, **kw)
    return {n: m for name, q in D.QUANTILES.items() for n, m in fit_boosts(train_feat, {name: q}, key, **kw).items()}


def score_range_models(df_feat: DataFrame, models: dict, features_col: str = "features") -> DataFrame:
    """the three models on the same rows in one plan: ``pred_lower``, ``pred_mid``, ``pred_upper``."""
    out = df_feat
    for name in ("lower", "mid", "upper"):
        out = models[name].predict(out, f"pred_{name}", features_col)
    return out


@dataclass
class RangeModelBundle:
    """A3/A4: feature pipeline + three quantile models + metadata, saved as directories."""
    pipeline: PipelineModel
    models: dict
    meta: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
        for name, m in self.models.items():
            m.save(os.path.join(path, name))
        from pyspark.sql import SparkSession
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "bundle_meta"))

    @staticmethod
    def load(path: str) -> "RangeModelBundle":
        """Raises if the bundle is missing: an ``AnalysisException`` with the condition ``PATH_NOT_FOUND``, on which
        callers fall back to the rule price (F11)."""
        from pyspark.sql import SparkSession
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(os.path.join(path, "bundle_meta")).first()[0])
        pipe = PipelineModel.load(os.path.join(path, "pipeline"))
        models = {n: QuantileBoostModel.load(os.path.join(path, n)) for n in ("lower", "mid", "upper")}
        return RangeModelBundle(pipe, models, meta)

    def score(self, df_features: DataFrame) -> DataFrame:
        return score_range_models(self.pipeline.transform(df_features), self.models).drop(
            *encoded_columns(CAT, NUM))


#: Trees a quantile and learning rate of the reference's three models (scripts/train.py:267).
ROUNDS, RATE = 1000, 0.03


def train_range_bundle(features: DataFrame, key: list[str], rounds: int = ROUNDS, learning_rate: float = RATE,
                       **kw) -> RangeModelBundle:
    """Entry 2 of the reference: fit the feature pipeline on the rows given, fit the three quantile models."""
    rows = features.select(*key, "price_per_kg", *FEATURES).persist()  # input plan runs once
    pipe = feature_pipeline().fit(rows)
    kw = {"max_bins": tree_bins(pipe), "categories": categories(pipe), "rounds": rounds, "learning_rate": learning_rate} | kw
    feat = in_tree_partitions(pipe.transform(rows).select(*key, "price_per_kg", "features"), rows.count())
    models = fit_range_models(feat, key, **kw)
    rows.unpersist()
    meta = {"version": "2.2-spark", "features": FEATURES, "categorical": CAT, "numerical": NUM,
            "quantiles": D.QUANTILES, "rounds": len(models["mid"].trees),
            "learning_rate": models["mid"].learning_rate}
    return RangeModelBundle(pipe, models, meta)


# ---------------------------------------------------------------------------------------------------
# I15 permutation importance
# ---------------------------------------------------------------------------------------------------
def r2_expr(y: str, p: str):
    e = F.col(y) - F.col(p)
    sst = F.count(F.col(y)) * F.var_pop(y)
    return F.lit(1.0) - F.sum(e * e) / F.when(sst == 0, F.lit(None)).otherwise(sst)  # ANSI-safe


def permuted(df: DataFrame, key: list[str], cols: list[str], seed: int, name: str = "_perm") -> DataFrame:
    """Adds the struct ``name`` = the values of ``cols`` in another row of the whole table: a bijection, drawn by hash.

    Rows are numbered densely in the order of their hashed keys, and those numbers again in the order of their own seeded
    hashes; the row with number n takes the values of the row that comes at place n there. Two range exchanges and one
    equi-join of the numbers; no task holds more than its range, at any size."""
    rows = dense_number(df, [row_digest(key, seed), *key], "_n")
    taken = dense_number(rows.select(F.col("_n").alias("_from"), F.struct(*cols).alias(name)),
                         [F.xxhash64("_from", F.lit(seed)), "_from"], "_n").select("_n", name)
    return rows.join(taken, "_n").drop("_n")


def permutation_importance(bundle: RangeModelBundle, test: DataFrame, key: list[str], n_repeats: int = 5,
                           seed: int = 42, y: str = "price_per_kg") -> DataFrame:
    """Drop in R2 of the mid model when one feature's values are permuted across all rows.

    One permutation of the whole table per repeat serves all features; every (feature, repeat) variant is scored in a
    single pass and its R2 aggregated by group."""
    test = cut_lineage(test.select(*key, y, *FEATURES))  # read by the baseline and by each repeat
    base_pred = bundle.score(test)
    baseline = base_pred.agg(r2_expr(y, "pred_mid").alias("r2")).first()["r2"]
    variants = None
    for r in range(n_repeats):
        paired = permuted(test, key, FEATURES, seed + r)
        exploded = paired.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in FEATURES])))
        swapped = exploded.select(
            *key, y, "feature", F.lit(r).alias("repeat"),
            *[F.when(F.col("feature") == c, F.col(f"_perm.{c}")).otherwise(F.col(c)).alias(c) for c in FEATURES])
        variants = swapped if variants is None else variants.unionByName(swapped)
    scored = bundle.score(variants)
    per = scored.groupBy("feature", "repeat").agg(r2_expr(y, "pred_mid").alias("r2"))
    return (per.groupBy("feature").agg(F.avg(F.lit(baseline) - F.col("r2")).alias("importance_mean"),
                                       F.stddev_pop(F.lit(baseline) - F.col("r2")).alias("importance_std"))
            .orderBy(F.desc("importance_mean")))


# ---------------------------------------------------------------------------------------------------
# I17 k-fold cross-validation, I18 model comparison
# ---------------------------------------------------------------------------------------------------
def cross_validate_mid(features: DataFrame, key: list[str], folds: int = 3, seed: int = 7, **kw) -> DataFrame:
    """K-fold CV of the mid (q = .5) model. Fold = seeded hash of the row key, so each fold is
    a fixed subset independent of partitioning. Returns one row per fold (MAE, R2 on the held-out
    fold); ``cv_summary`` turns it into mean +- std."""
    from baleprice.operators.evaluate import regression_aggs
    rows = features.select(F.xxhash64(*key).alias("_row"), row_bucket(key, seed, folds).alias("_fold"), "price_per_kg",
                           *FEATURES).persist()  # input plan runs once; vectors are made again, as they are larger
    pipe = feature_pipeline().fit(rows)
    kw = {"max_bins": tree_bins(pipe), "categories": categories(pipe)} | kw
    feat = in_tree_partitions(pipe.transform(rows).select("_row", "_fold", "price_per_kg", "features"), rows.count())
    out = None
    for k in range(folds):
        model = fit_quantile_boost(feat.filter(F.col("_fold") != k), 0.5, ["_row"], calibrate=False, **kw)
        scored = model.predict(feat.filter(F.col("_fold") == k), "pred_mid")
        res = scored.agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n_rows"), *regression_aggs())
        res = cut_lineage(res)
        out = res if out is None else out.unionByName(res)
    rows.unpersist()
    return out


def cv_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("mae").alias("cv_mae"), F.stddev_samp("mae").alias("cv_mae_std"),
                        F.avg("r2").alias("cv_r2"), F.count(F.lit(1)).alias("folds"))


def _learners(key: list[str], bins: int, cats: dict, seed: int, trees: int, rounds: int) -> dict:
    """Name -> function from training rows to a function that adds ``pred_mid``. Ridge regression, random forest and
    gradient-boosted trees of Spark ML, and the mid quantile booster, on the vector ``features``."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    common = {"featuresCol": "features", "labelCol": "price_per_kg", "predictionCol": "pred_mid"}
    estimators = {
        "Ridge Regression": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=10, maxBins=bins, seed=seed, **common),
        "Gradient Boosting": GBTRegressor(maxIter=trees, maxDepth=5, maxBins=bins, stepSize=0.1, seed=seed, **common),
    }

    def boost(train: DataFrame):
        model = fit_quantile_boost(train, 0.5, key, rounds=rounds, calibrate=False, max_bins=bins, categories=cats)
        return lambda rows: model.predict(rows, "pred_mid")

    return {n: (lambda train, e=e: e.fit(train).transform) for n, e in estimators.items()} | {
        "Quantile Boosting (q=0.5)": boost}


def _figures(learners: dict, train: DataFrame, test: DataFrame, **labels) -> DataFrame:
    """A row per learner: its name, ``labels``, n_rows and the regression figures on ``test``; the learners are fitted
    side by side, and each row is checkpointed."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from baleprice.operators.evaluate import regression_aggs

    def one(name: str) -> DataFrame:
        scored = learners[name](train)(test)
        return cut_lineage(scored.agg(F.lit(name).alias("model"), *[F.lit(v).alias(k) for k, v in labels.items()],
                                      F.count(F.lit(1)).alias("n_rows"), *regression_aggs()))

    with ThreadPoolExecutor(max_workers=len(learners)) as pool:
        rows = list(pool.map(inheritable_thread_target(train.sparkSession)(one), learners))
    return _union(rows)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cross_validate_models(features: DataFrame, key: list[str], folds: int = 5, seed: int = 7, trees: int = 30,
                          boost_rounds: int = 10) -> DataFrame:
    """K-fold cross-validation of all four models on the same folds of one cached frame, a row per (model, fold)
    with n_rows, MAE, RMSE, R2, MAPE on the fold held out. Folds are a seeded hash of the row key; codes and scaling are
    fitted on all rows, once, as they don't look at prices."""
    rows = features.select(*key, "price_per_kg", *FEATURES).persist()  # input plan runs once
    pipe = feature_pipeline().fit(rows)
    feat = in_tree_partitions(pipe.transform(rows).withColumn("_fold", row_bucket(key, seed, folds))
                              .select(*key, "price_per_kg", "features", "_fold"), rows.count()).persist()
    learners = _learners(key, tree_bins(pipe, 64), categories(pipe), seed, trees, boost_rounds)
    out = _union([_figures(learners, feat.filter(F.col("_fold") != k), feat.filter(F.col("_fold") == k), fold=k)
                  for k in range(folds)])
    feat.unpersist()
    rows.unpersist()
    return out


def cv_by_model(per_fold: DataFrame) -> DataFrame:
    """``cv_summary`` for each model: CV MAE, its sample deviation over the folds, CV R2, number of folds."""
    return per_fold.groupBy("model").agg(F.avg("mae").alias("cv_mae"), F.stddev_samp("mae").alias("cv_mae_std"),
                                         F.avg("r2").alias("cv_r2"), F.count(F.lit(1)).alias("folds"))


def compare_models(features: DataFrame, key: list[str], test_pct: int = 15, seed: int = 42,
                   boost_rounds: int = 10) -> DataFrame:
    """Ridge regression, random forest and gradient-boosted trees (Spark ML) against the mid
    quantile booster on the same hash split and feature vector; hold-out MAE, RMSE, R2, MAPE."""
    rows = features.select(*key, "price_per_kg", *FEATURES).persist()  # input plan runs once
    pipe = feature_pipeline().fit(rows)
    feat = in_tree_partitions(pipe.transform(split_train_test(rows, key, test_pct, seed))
                              .select(*key, "price_per_kg", "features", "is_test"), rows.count()).persist()
    learners = _learners(key, tree_bins(pipe, 64), categories(pipe), seed, 30, boost_rounds)
    out = _figures(learners, feat.filter(~F.col("is_test")), feat.filter(F.col("is_test")))
    feat.unpersist()
    rows.unpersist()
    return out


def train_from_csv(spark, path: str, rounds: int = ROUNDS, quarantine: str | None = None, **kw) -> RangeModelBundle:
    """Retrain the three range models from a CSV with the documented training columns (header row,
    declared schema). The file carries no row id, so the row key for the hash split / subsampling is
    the full row: identical rows always fall on the same side.

    With ``quarantine``, malformed rows and rows without a price go to that Parquet folder (file, reason, record), their
    number is ``meta["rejected"]``, and the others train; without it either kind raises."""
    from baleprice.operators.features import v2_features
    from baleprice.sources.io import TRAINING_SCHEMA, read_csv
    rejected = 0
    if quarantine:
        df, rejected = _without_rejects(spark, path, TRAINING_SCHEMA, quarantine)
    else:
        df = read_csv(spark, path, TRAINING_SCHEMA)
        unlabelled = df.filter(F.col("price_per_kg").isNull()).count()
        if unlabelled:
            raise ValueError(f"{unlabelled} rows of {path} have no price_per_kg")
    key = [f.name for f in TRAINING_SCHEMA.fields]
    feats = v2_features(df.select(*key, *[F.col(c).alias(f"_k_{c}") for c in key]), drop_inputs=False)
    kcols = [f"_k_{c}" for c in key]
    bundle = train_range_bundle(feats, kcols, rounds=rounds, **kw)
    bundle.meta["rejected"] = rejected
    return bundle


def _without_rejects(spark, path: str, schema, quarantine: str, required: tuple[str, ...] = ("price_per_kg",),
                     optional: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    from baleprice.sources.io import read_csv_quarantined
    good, bad = read_csv_quarantined(spark, path, schema, required, optional)
    bad.write.mode("overwrite").parquet(quarantine)
    return good, spark.read.parquet(quarantine).count()


def v1_pipeline(max_iter: int = 30, max_depth: int = 5, step: float = 0.1, seed: int = 42):
    """The single-price model of the v1 interface: its 48 features, scaled, and squared-error boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    return Pipeline(stages=[
        VectorAssembler(inputCols=D.v1_feature_names(), outputCol="v1_raw"),
        StandardScaler(inputCol="v1_raw", outputCol="v1_scaled", withMean=True),
        GBTRegressor(featuresCol="v1_scaled", labelCol="price_per_kg", predictionCol="pred_mid", lossType="squared",
                     maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed)])


def train_v1_from_csv(spark, path: str, quarantine: str, test_pct: int = 20, seed: int = 42,
                      **kw) -> tuple[PipelineModel, DataFrame]:
    """A11, v1: retrain from a CSV with the v1 columns (``sub_type`` may be missing). Malformed rows and rows without a
    value that has no default (all but sub-type and demand index) go to ``quarantine``, the hashed ``test_pct`` % of the good ones are held out. Returns the fitted pipeline and one row of figures: trained,
    held_out and rejected rows, and MAE, RMSE, R2, MAPE on the rows held out. Equal rows fall on one side."""
    from baleprice.operators.evaluate import regression_aggs
    from baleprice.operators.features import v1_features
    from baleprice.sources.io import V1_TABLE_SCHEMA
    rows, rejected = _without_rejects(spark, path, V1_TABLE_SCHEMA, quarantine, tuple(
        c for c in V1_TABLE_SCHEMA.names if c not in ("sub_type", "market_demand_index")), ("sub_type",))
    split = split_train_test(rows, V1_TABLE_SCHEMA.names, test_pct, seed)
    feats = v1_features(split, keep=["price_per_kg", "is_test"]).persist()
    model = v1_pipeline(seed=seed, **kw).fit(feats.filter(~F.col("is_test")))
    trained = feats.filter(~F.col("is_test")).count()
    figures = cut_lineage(model.transform(feats.filter(F.col("is_test"))).agg(
        F.lit(trained).cast("long").alias("trained"), F.count(F.lit(1)).alias("held_out"),
        F.lit(rejected).cast("long").alias("rejected"), *regression_aggs()))
    feats.unpersist()
    return model, figures
