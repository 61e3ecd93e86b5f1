"""Golden values worked out from the reference formulas (FIXTURES.md sections 4-6)."""

import pytest
from pyspark.sql import functions as F

from baleprice.operators import clean as C
from baleprice.operators import rules as RU
from baleprice.operators import scoring as SC

LISTING = ("waste_type string, sub_type string, weight_kg double, distance_km double, condition string, "
           "county string, collection_point string, month int, day_of_week int")

# FIXTURES section 4: (waste, sub, kg, km, condition, point) -> live, old, training
TIER_CASES = [
    ("plastic", "PET", 5, 3, "contaminated", "household", (.8053, .4875, "semi_formal"), (.62, 0, "informal"), (.62, 0, "informal")),
    ("plastic", "PET", 50, 5, "clean", "commercial", (.9525, .875, "formal"), (.89, .7105, "formal"), (1, 1, "formal")),
    ("plastic", "PET", 150, 8, "clean", "industrial", (.8575, .625, "semi_formal"), (1, 1, "formal"), (1, 1, "formal")),
    ("metal", "steel", 10, 4, "mixed", "household", (.9725, .725, "formal"), (.9254, .2539, "informal"), (.9455, .4545, "semi_formal")),
    ("metal", "steel", 80, 10, "clean", "industrial", (.98, .8, "formal"), (.9884, .8842, "formal"), (1, 1, "formal")),
    ("paper", "cardboard", 8, 3, "mixed", "household", (.919, .73, "formal"), (.7727, .2424, "informal"), (.8364, .4545, "semi_formal")),
    ("paper", "cardboard", 120, 7, "clean", "commercial", (.91, .7, "formal"), (1, 1, "formal"), (1, 1, "formal")),
    ("e_waste", "mixed_ewaste", 5, 2, "mixed", "household", (.9869, .7375, "formal"), (.9612, .225, "informal"), (.9727, .4545, "semi_formal")),
]


@pytest.fixture
def demo(rows):
    data = [(w, s, float(kg), float(km), c, "Nairobi", p, 6, 1) for w, s, kg, km, c, p, *_ in TIER_CASES]
    return rows(data, LISTING)


def _tiers(df):
    return [(r.tier_multiplier, r.tier_score, r.market_tier) for r in df.collect()]


def test_tier_live(demo):
    got = _tiers(RU.tier_live(C.clean_listings(demo, "v2")))
    assert got == [tuple(float(x) if not isinstance(x, str) else x for x in c[6]) for c in TIER_CASES]


def test_tier_old(demo):
    got = _tiers(RU.tier_old(C.clean_listings(demo, "v2old")))
    assert got == [tuple(float(x) if not isinstance(x, str) else x for x in c[7]) for c in TIER_CASES]


def test_tier_train(demo):
    got = _tiers(RU.tier_train(C.clean_listings(demo, "train")))
    assert got == [tuple(float(x) if not isinstance(x, str) else x for x in c[8]) for c in TIER_CASES]


def test_step_multipliers(spark):
    w = spark.createDataFrame([(float(x),) for x in [5, 5.01, 20, 50, 100, 500, 500.01]], "weight_kg double")
    assert [r[0] for r in w.select(RU.volume_multiplier()).collect()] == [1.0, .92, .92, .85, .78, .68, .60]
    d = spark.createDataFrame([(float(x),) for x in [5, 20, 50, 50.1]], "distance_km double")
    assert [r[0] for r in d.select(RU.distance_multiplier()).collect()] == [1.0, .92, .82, .72]


def test_expected_price_v2(rows):
    df = rows([("plastic", "PET", 50.0, 5.0, "clean", "Nairobi", "commercial", 6, 1),
               ("plastic", "PET", 5.0, 3.0, "contaminated", "Nairobi", "household", 6, 1)], LISTING)
    out = RU.expected_price_v2(df).collect()
    assert out[0].expected_price_raw == pytest.approx(14.72625, abs=1e-9)
    assert out[1].expected_price_raw == pytest.approx(7.1216145, abs=1e-9)
    assert out[1].expected_price == 7.12


def test_expected_price_v1(rows):
    df = rows([("PET", 12.5, 8.3, .87, 6, 1, .90)],
              "sub_type string, weight_kg double, distance_km double, consistency_score double, month int, "
              "day_of_week int, market_demand_index double")
    out = RU.expected_price_v1(df, rounded=False).first()
    assert out.expected_price_v1 == pytest.approx(30.839475874, abs=1e-8)


FB = ("waste_type string, sub_type string, weight_kg double, distance_km double, consistency_score double, "
      "month int, day_of_week int, market_demand_index double")


def test_fallback_price_and_factors(rows):
    df = rows([("plastic", None, 12.5, 8.3, .87, 6, 1, None)], FB)
    r = RU.fallback_price(df).first()
    assert (r.predicted_price_per_kg, r.total_estimated_price, r.ci_low, r.ci_high) == (27.14, 339.30, 23.94, 30.34)
    f = r.price_factors
    assert (f.base_price_kes, f.weight_multiplier, f.quality_adjustment, f.distance_penalty, f.seasonality_factor,
            f.demand_boost) == (22.0, 1.052, 3.26, -1.0, .9, .28)
    assert r.confidence_label == "KES 23.94 – 30.34"
    assert r.is_fallback and r.model_version == "fallback-rule-based"


def test_price_factors_v1(rows):
    df = rows([("plastic", None, 12.5, 8.3, .87, 6, 1, None)], FB)
    f = RU.price_factors_v1(df).first().price_factors
    assert (f.base_price_kes, f.weight_multiplier, f.quality_adjustment, f.seasonality_factor, f.demand_boost) == \
        (22.0, 1.052, 3.26, .9, .28)
    assert f.distance_penalty == -1.25


def test_postprocess_v2(rows):
    df = rows([("plastic", "PET", 50.0, 5.0, "clean", "Mombasa", "household", 6, 1, 9.0, 14.0, 20.0, "formal")],
              LISTING + ", pred_lower double, pred_mid double, pred_upper double, market_tier string")
    r = SC.postprocess_range(df, "v2").first()
    assert (r.lower_bound, r.recommended, r.upper_bound) == (7.45, 11.59, 16.56)
    assert (r.payout_lower, r.payout_recommended, r.payout_upper) == (372.60, 579.60, 828.00)
    assert r.range_width == 9.11 and r.market_signal == "volatile"
    assert round(r.volatility, 3) == .786
    assert r.advice.startswith("Negotiate between KES 7–17/kg. Fair market rate is KES 12/kg. You are in the formal")


def test_floor_before_multipliers(rows):
    df = rows([("plastic", "PET", 50.0, 5.0, "clean", "Eldoret", "household", 6, 1, .4, .4, .4, "formal")],
              LISTING + ", pred_lower double, pred_mid double, pred_upper double, market_tier string")
    r = SC.apply_multipliers(df).first()
    assert r.adj_mid == pytest.approx(.702)


def test_edge_rows(rows):
    data = [
        ("plastic", "PET", 0.5, None, None, None, None, 6, 1),
        ("plastic", "PET", 0.49, None, None, None, None, 6, 1),
        ("plastic", "PET", 1000.0, None, None, None, None, 6, 1),
        ("plastic", "PET", 1000.01, None, None, None, None, 6, 1),
        ("plastic", "PET", 10.0, 5.0, "CLEAN", "nairobi", "dump_site", 6, 1),
        ("plastic", "PET", 10.0, 5.0, "Unsorted", "Kiambu", "household", 6, 1),
        ("stone", "", 10.0, 5.0, "clean", "Nairobi", "commercial", 6, 1),
    ]
    df = C.validate_listings(rows(data, LISTING))
    valid = [r.is_valid for r in df.collect()]
    assert valid == [True, False, True, False, False, False, False]
    cleaned = C.clean_listings(df, "v2").collect()
    assert cleaned[1].weight_kg == 0.5 and cleaned[3].weight_kg == 1000.0
    assert cleaned[0].distance_km == 5.0 and cleaned[0].condition == "clean" and cleaned[0].county == "Nairobi"
    assert (cleaned[4].condition, cleaned[4].county, cleaned[4].collection_point) == ("clean", "Nairobi", "commercial")
    assert (cleaned[5].condition, cleaned[5].county) == ("mixed", "Kiambu")
    errs = df.collect()[6].errors
    assert "waste_type not allowed" in errs and "sub_type length not in 2-50" in errs


def test_base_price_lookup(rows):
    from baleprice.operators.lookups import with_base_price_v1
    df = rows([("plastic", "copper"), ("stone", None), ("plastic", "LDPE"), ("plastic", "")],
              "waste_type string, sub_type string")
    got = [(r.base_price, r.base_source) for r in with_base_price_v1(df).collect()]
    assert got == [(600.0, "sub_type"), (20.0, "default"), (22.0, "waste_type"), (22.0, "waste_type")]


def test_has_subtype_and_v1_vector(rows):
    from baleprice.functions.dims import v1_feature_names
    from baleprice.operators.features import v1_features
    df = rows([("plastic", "", 12.5, 8.3, .87, 6, 1, None), ("metal", "unknown", 1.0, 1.0, .5, 1, 0, .5)], FB)
    out = v1_features(df, as_array=True).collect()
    assert out[0].has_subtype == 0.0 and out[1].has_subtype == 1.0
    assert len(out[0].features_v1) == 48 == len(v1_feature_names())
    assert out[0].market_demand_index == pytest.approx(.9)


PRED = LISTING + ", pred_lower double, pred_mid double, pred_upper double, market_tier string"


def test_crossing_guard_v2_only(rows):
    data = [("plastic", "PET", 10.0, 5.0, "clean", "Nairobi", "commercial", 6, 1, 12.0, 10.0, 8.0, "formal")]
    v2 = SC.postprocess_range(rows(data, PRED), "v2").first()
    assert (v2.lower_bound, v2.recommended, v2.upper_bound) == (10.0, 10.0, 10.0)
    old = SC.postprocess_range(rows(data, PRED), "v2old").first()
    # no guard in the old generation: crossed bounds, negative volatility reads 'stable'
    assert (old.lower_bound, old.upper_bound) == (12.0, 8.0) and old.volatility < 0 and old.market_signal == "stable"
    assert old.coverage == "62%" and v2.coverage == "70%"


def test_v1r_advice_and_no_multipliers(rows):
    data = [("plastic", "PET", 10.0, 5.0, "clean", "Eldoret", "household", 6, 1, 2.5, 3.5, 4.5, "formal")]
    r = SC.postprocess_range(rows(data, PRED), "v1r").first()
    assert (r.lower_bound, r.recommended, r.upper_bound) == (2.5, 3.5, 4.5)
    assert r.advice == "Negotiate between KES 2–4/kg. Fair rate is KES 4/kg."


def test_nested_response_shape(rows):
    data = [("plastic", "PET", 50.0, 5.0, "clean", "Mombasa", "household", 6, 1, 9.0, 14.0, 20.0, "formal")]
    post = SC.postprocess_range(rows(data, PRED).withColumn("tier_score", F.lit(0.875)), "v2")
    api = SC.nest_response(post, "v2", api_shape=True).select("response.market_info.*").columns
    full = SC.nest_response(post, "v2", api_shape=False).select("response.market_info.*").columns
    assert "county_multiplier" not in api and "county_multiplier" in full
    assert api == ["market_tier", "tier_score", "range_width", "market_signal", "coverage", "advice"]


def test_date_defaults_conventions(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("2024-01-07 10:00:00",)], "ts string").select(
        F.to_timestamp_ntz(F.col("ts")).alias("listed_at"))   # a Sunday
    py = C.resolve_dates(df, "listed_at", "python").first()
    js = C.resolve_dates(df, "listed_at", "js").first()
    assert (py.month, py.day_of_week) == (1, 6) and js.day_of_week == 0


def test_unmatched_keys_and_split(rows):
    from baleprice.operators.lookups import unmatched_keys, with_base_rates
    df = rows([("plastic", "PET"), ("plastic", "copper"), ("metal", "copper"), ("plastic", "copper")],
              "waste_type string, sub_type string")
    assert {tuple(r) for r in unmatched_keys(df, ["waste_type", "sub_type"]).collect()} == {("plastic", "copper")}
    strict = with_base_rates(df, how="inner")
    assert strict.count() == 2
    kept = with_base_rates(df)
    assert kept.count() == 4 and kept.filter("base_mean IS NULL").count() == 2


def test_split_valid_and_issues(rows):
    data = [("plastic", "PET", 10.0, 5.0, "clean", "Nairobi", "dump_site", 6, 1),
            ("plastic", "PET", 2000.0, 500.0, "dirty", "Kiambu", "household", 6, 1)]
    df = rows(data, LISTING)
    valid, rejected = C.split_valid(df)
    assert valid.count() == 1 and rejected.count() == 1
    assert sorted(rejected.first().errors) == sorted(["weight_kg not in 0.5-1000", "distance_km not in 0.1-200",
                                                      "condition not allowed", "county not allowed"])
    issues = C.listing_issues(df).select("issue.severity", "issue.reason").collect()
    assert ("warning", "collection_point dump_site priced as commercial") in [tuple(r) for r in issues]
    assert len(issues) == 5


def test_scaler_population_std_and_constant_column(rows):
    from baleprice.operators.train import fit_scaler
    df = rows([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = fit_scaler(df, ["a", "b"])
    assert m.means == {"a": 2.0, "b": 5.0} and m.stds == {"a": 1.0, "b": 1.0}
    out = m.transform(df).select("a_scaled", "b_scaled").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_report_lines(spark, tmp_path):
    from baleprice.sources import io
    stats = spark.createDataFrame([("price", "mean", 28.5432)], "section string, metric string, value double")
    lines = io.report_lines(stats)
    assert lines.first()[0] == "price | mean | 28.54"
    io.write_text(lines, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 1


def test_postprocess_without_multipliers(rows):
    data = [("plastic", "PET", 50.0, 5.0, "clean", "Mombasa", "household", 6, 1, 9.0, 14.0, 20.0, "formal")]
    r = SC.postprocess_range(rows(data, PRED), "v2", apply_multipliers=False).first()
    assert (r.lower_bound, r.recommended, r.upper_bound) == (9.0, 14.0, 20.0)
    assert (r.collection_point_multiplier, r.county_multiplier) == (1.0, 1.0)
