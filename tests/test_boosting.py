"""The booster's own trees: rounds of the registered models, counts, splits, residual quantiles, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from baleprice.operators import bins as B


def _layout():
    return B.Layout([None, np.array([0.2, 0.5, 0.7]), None, np.array([]), np.linspace(0, 1, 31)], [5, 4, 3, 1, 32])


def _block(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 5, n), rng.random(n), rng.integers(0, 3, n), rng.random(n), rng.random(n)]).astype(float)
    x[rng.random(n) < 0.05, 4] = np.nan
    y = np.round(10 + 3 * (x[:, 0] == 2) + 5 * x[:, 1] + rng.normal(size=n), 2)
    return x, y, rng.integers(0, 2**32, n).astype(np.uint32)


def _vectors(spark, n=900):
    """Rows of id, price_per_kg and a vector: one nominal place of four values, two numeric ones."""
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(n).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") * 37 % 101 / 10.0).alias("b"),
                               (F.col("id") % 2).cast("double").alias("c"))
    df = df.withColumn("price_per_kg", F.col("a") * 3 + F.col("b") + F.pmod(F.xxhash64("id"), F.lit(100)) / 50.0 + 1)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_registered_models_are_grown_in_the_reference_s_rounds(spark, monkeypatch):
    """scripts/train.py:267: 1000 trees a quantile at a rate of .03."""
    from baleprice.functions import dims as D
    from baleprice.operators import train as T
    from baleprice.plans import catalog
    seen = []

    def fit(data, quantiles, key, **kw):
        seen.append((kw["rounds"], kw["learning_rate"]))
        return {name: T.QuantileBoostModel(q, 1.0, kw["learning_rate"]) for name, q in quantiles.items()}

    cats = [F.concat(F.lit("v"), F.col("id") % 3).alias(c) for c in D.CATEGORICAL_FEATURES]
    rows = spark.range(50).select(*[F.col("id").alias(k) for k in catalog.KEY], (F.col("id") + 1.0).alias("price_per_kg"),
                                  (F.col("id") % 5 == 0).alias("is_test"), *cats,
                                  *[(F.col("id") % 7 * 1.0).alias(c) for c in D.NUMERIC_FEATURES])
    monkeypatch.setattr(T, "fit_boosts", fit)
    monkeypatch.setattr(catalog, "_split_features", lambda *a: rows)
    monkeypatch.setattr(catalog, "_LAST", [])
    bundle = catalog._bundle(spark, "own")
    assert seen == [(1000, 0.03)] and set(bundle.models) == set(D.QUANTILES)


@pytest.mark.parametrize("valid", [False, True])
def test_models_are_the_same_whatever_holds_the_rows(spark, monkeypatch, valid):
    import os

    from baleprice.operators import boost
    from baleprice.session import ensure_checkpoint_dir
    rows = _vectors(spark)
    kw = {"rounds": 5, "learning_rate": 0.5, "max_depth": 3, "categories": {0: 4}, "checkpoint_every": 2}
    if valid:
        kw |= {"valid": rows.filter("id % 7 = 0"), "patience": 1}
        rows = rows.filter("id % 7 != 0")
    one = boost.fit_boosts(rows, {"low": 0.1, "mid": 0.5}, ["id"], **kw)
    alone = boost.fit_boosts(rows.repartition(3), {"mid": 0.5}, ["id"], **kw)
    monkeypatch.setattr(boost, "MOST_ROWS", 100)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {(at, name) for at, _, names in os.walk(folder) for name in names}
    spread = boost.fit_boosts(rows.repartition(5), {"low": 0.1, "mid": 0.5}, ["id"], **kw)
    monkeypatch.setattr(boost, "DIRECT", 1)
    deep = boost.fit_boosts(rows.repartition(5), {"low": 0.1, "mid": 0.5}, ["id"], **kw)
    assert {(at, name) for at, _, names in os.walk(folder) for name in names} == before
    for name in ("low", "mid"):
        for other in (spread, deep) + ((alone,) if name == "mid" else ()):
            assert [t for t in one[name].trees] == [t for t in other[name].trees] and one[name].trees
            assert one[name].importances == other[name].importances and one[name].shift == other[name].shift
            assert one[name].history == pytest.approx(other[name].history)
            assert one[name].valid_history == pytest.approx(other[name].valid_history)


def test_rows_without_label_are_left_out(spark):
    from baleprice.operators import boost
    rows = _vectors(spark, 300)
    more = rows.unionByName(rows.withColumn("price_per_kg", F.lit(None).cast("double")))
    kw = {"rounds": 2, "max_depth": 2, "categories": {0: 4}}
    assert boost.fit_quantile_boost(more, 0.5, ["id"], **kw) == boost.fit_quantile_boost(rows, 0.5, ["id"], **kw)
    with pytest.raises(ValueError):
        boost.fit_quantile_boost(rows.withColumn("price_per_kg", F.lit(None).cast("double")), 0.5, ["id"], **kw)


def test_counts_and_splits_match_brute_force():
    layout, (x, y, h) = _layout(), _block()
    block = layout.binned(x), y, h, None, np.full((1, len(y)), 12.0)
    own = np.column_stack([x[:, 0], np.searchsorted([0.2, 0.5, 0.7], x[:, 1]), x[:, 2], np.zeros(len(x)),
                           np.searchsorted(layout.thresholds[4], x[:, 4])]).astype(int)
    tree = B.Tree()
    tree.grow({0: (1, np.array([True, True, False, False]), True, True)})
    use = B.drawn(h, 99, 0.85)
    assert 0.75 < use.mean() < 0.95
    [counts], = B.level_counts(layout, [(0, tree, 99)], 0.85, iter([block]))
    for slot, side in enumerate((own[:, 1] <= 1, own[:, 1] > 1)):
        for f, size in enumerate(layout.sizes):
            for b in range(size):
                for sign in (0, 1):
                    assert counts[slot, f, b, sign] == (use & side & (own[:, f] == b) & ((y < 12.0) == sign)).sum()
    every = np.ones(counts.shape[:2], bool)
    for slot, found in enumerate(B.best_splits(layout, counts, every, 2)):
        total = counts[slot, 0].sum(0)
        fall = lambda n: n[1] ** 2 / n.sum()
        best = 0.0
        for f, size in enumerate(layout.sizes):
            sets = range(1, 2 ** size - 1) if layout.thresholds[f] is None else [2 ** (k + 1) - 1 for k in range(size - 1)]
            for s in sets:
                left = counts[slot, f, [b for b in range(size) if s >> b & 1]].sum(0)
                if min(left.sum(), (total - left).sum()) >= 2:
                    best = max(best, fall(left) + fall(total - left) - fall(total))
        assert found[-1] == pytest.approx(best)
    assert B.best_splits(layout, counts, ~every, 2) == [None, None]


@pytest.mark.parametrize("q", [0.05, 0.5, 0.95])
def test_residual_quantiles_are_within_a_cell(q):
    layout, (x, y, h) = _layout(), _block(4000)
    block = layout.binned(x), y, h, None, np.full((1, len(y)), 12.0)
    tree = B.Tree()
    tree.grow({0: (0, np.arange(5) == 2, True, True)})
    [(found, sums)], = B.residual_cells(layout, [(0, tree, q, [])], iter([block, block]))
    got = B.node_quantiles(found, q)
    for node, side in ((1, x[:, 0] == 2), (2, x[:, 0] != 2)):
        want = np.quantile(y[side] - 12.0, q, method="inverted_cdf")
        assert got[node][0] == pytest.approx(want, rel=0.01) and got[node][1] == 2 * side.sum()
    e = y - 12.0
    assert sums[0] == pytest.approx(2 * np.where(e >= 0, q * e, (q - 1) * e).sum()) and sums[1] == 2 * len(y)
    for v in (0.0, -0.0, 3.75, -3.75, 1e-9, -250.0, 1e12):
        low, high = B.cell_bounds(B.cells(np.array([v]))[0])
        assert low <= v <= high


def test_scorer_follows_the_trees():
    nominal = [(0, [0.0, 3.0], 1, 2), (0, 1.5), (1, 0.25, 3, 4), (1, -2.0), (2, 7.0)]
    x = np.array([[3, 0.9], [1, 0.25], [1, 0.26], [2, np.nan], [0, -1.0]])
    got = B.Scorer([nominal, [(0, 0.5)]], 2, {0: 4})(x)
    assert got.tolist() == [2.0, -1.5, 7.5, 7.5, 2.0]
    with pytest.raises(ValueError):
        B.Scorer([nominal], 2, {0: 4})(np.array([[4.0, 0.0]]))


def test_cross_validation_leaves_no_rows_on_disk(spark):
    """Neither checkpoints of working rows nor cached vectors: what stays below the checkpoint folder are the folds' figures."""
    import os

    from baleprice.functions import dims as D
    from baleprice.operators import train as T
    from baleprice.session import ensure_checkpoint_dir
    rows = spark.range(4000).select("id", (F.col("id") % 37 + 1.5).alias("price_per_kg"),
                                    *[F.concat(F.lit("v"), F.col("id") % 3).alias(c) for c in D.CATEGORICAL_FEATURES],
                                    *[F.rand(i).alias(c) for i, c in enumerate(D.NUMERIC_FEATURES)])
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def held():
        return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)

    before, cached = held(), len(spark.sparkContext._jsc.getPersistentRDDs())
    folds = T.cross_validate_mid(rows, ["id"], folds=2, rounds=4)
    left = held() - before
    print("bytes left", left)
    assert left < 20 * 4000
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= cached
    found = folds.collect()
    assert [r.fold for r in found] == [0, 1] and sum(r.n_rows for r in found) == 4000
