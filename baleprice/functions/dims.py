"""Fixed values of the pricing rules, one constant set per rule generation.

Generations (never merge their constants):

* ``v1``    -- point price from consistency score and demand (v1 features, v1 generator).
* ``js``    -- client-side rule-based fallback price.
* ``v2old`` -- older range predictor (tier rule where bulk means *more* formal).
* ``v2``    -- live range predictor (tier rule where bulk means *less* formal).
* ``train`` -- v2 training labels.

Every table below is a FIXED VALUE that must equal the reference for the results to match. They are
small (at most 31 rows), so the dimension DataFrames built from them have a proven size bound and are
safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------
# FIXED VALUES -- validation domains (request schema)
# ---------------------------------------------------------------------------------------------------
VALID_WASTE_TYPES = ["plastic", "metal", "paper", "e_waste", "organic", "glass", "textile", "rubber"]
VALID_CONDITIONS = ["clean", "mixed", "contaminated"]
VALID_COUNTIES = ["Nairobi", "Mombasa", "Kisumu", "Nakuru", "Eldoret"]
VALID_COLLECTION_POINTS = ["household", "commercial", "industrial", "dump_site"]
WEIGHT_BOUNDS = (0.5, 1000.0)
DISTANCE_BOUNDS = (0.1, 200.0)
SUB_TYPE_LENGTH = (2, 50)
DEFAULTS = {"condition": "clean", "county": "Nairobi", "distance_km": 5.0, "collection_point": "commercial"}

# ---------------------------------------------------------------------------------------------------
# FIXED VALUES -- v2 (live) and v2old
# ---------------------------------------------------------------------------------------------------
INFORMAL_DISCOUNTS = {
    "plastic": 0.62, "paper": 0.70, "metal": 0.90, "glass": 0.55,
    "e_waste": 0.95, "organic": 0.85, "rubber": 0.80, "textile": 0.80,
}
INFORMAL_DISCOUNT_DEFAULT = 0.75
V2_COLLECTION_POINT_MULT = {"household": 0.90, "commercial": 1.00, "industrial": 1.12}
COUNTY_MULT = {
    "Nairobi": 1.00, "Mombasa": 0.92, "Kisumu": 0.85, "Nakuru": 0.80,
    "Eldoret": 0.78, "Kiambu": 0.95, "Machakos": 0.88, "Kajiado": 0.85,
}
TIER_ADVICE = {
    "informal": "You are in the informal/household seller tier. "
                "Bring more material or ensure it is clean to unlock higher rates.",
    "semi_formal": "You are in the mid-market tier. "
                   "Sorting and cleaning your waste will improve your payout.",
    "formal": "You are in the formal/bulk seller tier — "
              "you are receiving wholesale market rates.",
}
COLLECTION_POINT_ADVICE = {
    "household": "Household waste receives a 10% discount. "
                 "For better rates, consider aggregating with neighbors or using a commercial collection point.",
    "commercial": "Commercial rates are baseline market price. "
                  "Industrial waste receives a 12% premium.",
    "industrial": "Industrial waste receives a 12% premium! "
                  "These are the best available rates due to volume and consistency.",
}
COVERAGE_LABEL = {"v2": "70%", "v2old": "62%", "v1r": "70%"}
SIGNAL_THRESHOLDS = (0.25, 0.50)  # stable < .25 <= moderate < .50 <= volatile
TIER_THRESHOLDS = (0.70, 0.35)  # formal >= .70 > semi_formal >= .35 > informal
PRICE_FLOOR_MODEL = 1.0
CURRENCY = "KES"
UNIT = "per kg"

# ---------------------------------------------------------------------------------------------------
# FIXED VALUES -- training labels (train)
# ---------------------------------------------------------------------------------------------------
# (waste_type, sub_type) -> (mean, std), in the order of the training table.
BASE_RATES = [
    ("e_waste", "phones", 115.0, 18.0),
    ("e_waste", "computers", 95.0, 15.0),
    ("e_waste", "batteries", 55.0, 12.0),
    ("e_waste", "cables", 78.0, 14.0),
    ("e_waste", "mixed_ewaste", 65.0, 10.0),
    ("plastic", "PET", 17.5, 4.0),
    ("plastic", "HDPE", 17.5, 4.0),
    ("plastic", "PP", 15.0, 3.5),
    ("plastic", "PVC", 12.0, 3.0),
    ("plastic", "LDPE", 10.0, 2.5),
    ("plastic", "mixed_plastic", 12.5, 3.0),
    ("metal", "copper", 520.0, 80.0),
    ("metal", "brass", 310.0, 55.0),
    ("metal", "aluminum", 30.0, 6.0),
    ("metal", "steel_heavy", 50.0, 10.0),
    ("metal", "steel_light", 25.0, 5.0),
    ("metal", "steel", 37.5, 8.0),
    ("metal", "tin", 22.5, 4.0),
    ("paper", "cardboard", 10.0, 2.5),
    ("paper", "office_paper", 10.0, 2.5),
    ("paper", "newspaper", 8.5, 2.0),
    ("paper", "mixed_paper", 8.5, 2.0),
    ("glass", "clear_glass", 5.0, 1.5),
    ("glass", "colored_glass", 3.0, 1.0),
    ("glass", "mixed_glass", 4.0, 1.2),
    ("organic", "food_waste", 10.0, 2.5),
    ("organic", "garden_waste", 8.0, 2.0),
    ("rubber", "tyres", 20.5, 3.5),
    ("rubber", "mixed_rubber", 12.5, 2.5),
    ("textile", "clothes", 10.0, 2.5),
    ("textile", "industrial_textile", 8.0, 2.0),
]
TRAIN_COLLECTION_POINT_MULT = {"household": 0.85, "commercial": 1.00, "industrial": 1.08, "dump_site": 0.75}
TRAIN_COUNTY_MULT = {
    "Nairobi": 1.00, "Mombasa": 0.92, "Kisumu": 0.85, "Nakuru": 0.80,
    "Eldoret": 0.78, "Kiambu": 0.95, "Machakos": 0.88, "Kajiado": 0.85,
}
COND_FACTORS = {"clean": 1.00, "mixed": 0.88, "contaminated": 0.78}
TRAIN_SEASONAL = {1: 1.05, 2: 1.07, 3: 1.02, 4: 0.93, 5: 0.96, 6: 0.99,
                  7: 1.06, 8: 1.08, 9: 1.04, 10: 0.95, 11: 0.91, 12: 0.98}
# Volume steps (right-closed upper bounds, multiplier); above the last bound 0.60.
VOLUME_STEPS = [(5.0, 1.0), (20.0, 0.92), (50.0, 0.85), (100.0, 0.78), (500.0, 0.68)]
VOLUME_STEP_ELSE = 0.60
DISTANCE_STEPS = [(5.0, 1.0), (20.0, 0.92), (50.0, 0.82)]
DISTANCE_STEP_ELSE = 0.72
# Weight bands of the volume sanity check: centre kg, band is [0.7 c, 1.3 c] inclusive, shown if n > 5.
VOLUME_BANDS = [1, 10, 50, 100, 500]
VOLUME_BAND_LOW, VOLUME_BAND_HIGH, VOLUME_BAND_MIN_ROWS = 0.7, 1.3, 5

# ---------------------------------------------------------------------------------------------------
# FIXED VALUES -- v1 features, v1 generator and js fallback
# ---------------------------------------------------------------------------------------------------
V1_WASTE_TYPES = ["plastic", "paper", "metal", "glass", "e_waste", "organic", "textile", "rubber"]
V1_SUBTYPES_BY_WASTE = [
    ("metal", ["copper", "aluminum", "brass", "steel", "tin"]),
    ("plastic", ["PET", "HDPE", "PP", "PVC", "mixed_plastic"]),
    ("paper", ["cardboard", "newspaper", "office_paper", "mixed_paper"]),
    ("glass", ["clear_glass", "colored_glass", "mixed_glass"]),
    ("e_waste", ["computers", "phones", "batteries", "cables", "mixed_ewaste"]),
    ("organic", ["food_waste", "garden_waste"]),
    ("textile", ["clothes", "industrial_textile"]),
    ("rubber", ["tyres", "mixed_rubber"]),
]
SUBTYPE_PRICES = {
    "copper": 600.0, "aluminum": 120.0, "brass": 350.0, "steel": 30.0, "tin": 25.0,
    "PET": 25.0, "HDPE": 20.0, "PP": 15.0, "PVC": 8.0, "mixed_plastic": 10.0,
    "cardboard": 12.0, "newspaper": 8.0, "office_paper": 14.0, "mixed_paper": 7.0,
    "clear_glass": 10.0, "colored_glass": 7.0, "mixed_glass": 5.0,
    "computers": 100.0, "phones": 120.0, "batteries": 60.0, "cables": 80.0, "mixed_ewaste": 70.0,
    "food_waste": 4.0, "garden_waste": 6.0,
    "clothes": 15.0, "industrial_textile": 8.0,
    "tyres": 20.0, "mixed_rubber": 12.0,
}
WASTE_BASE_PRICES = {
    "plastic": 22.0, "paper": 10.0, "metal": 45.0, "glass": 8.0,
    "e_waste": 80.0, "organic": 5.0, "textile": 12.0, "rubber": 18.0,
}
BASE_PRICE_DEFAULT = 20.0
SEASONAL_DEMAND = {1: 0.80, 2: 0.82, 3: 0.95, 4: 0.85, 5: 0.88, 6: 0.90,
                   7: 0.97, 8: 0.92, 9: 0.89, 10: 0.91, 11: 0.99, 12: 0.96}
SEASONAL_DEMAND_DEFAULT = 0.90
FALLBACK_HALF_WIDTH = {"plastic": 3.2, "paper": 1.6, "metal": 6.5, "glass": 1.4,
                       "e_waste": 15.0, "organic": 1.0, "textile": 2.0, "rubber": 2.8}
FALLBACK_HALF_WIDTH_DEFAULT = 4.0
FALLBACK_LEVEL = 0.9
FALLBACK_LOW_FLOOR = 0.5
FALLBACK_MODEL_VERSION = "fallback-rule-based"
# Distance penalty constants differ by generation: (per km, cap as share of base).
PENALTY_V1 = (0.15, 0.30)
PENALTY_JS = (0.12, 0.25)
V1R_DEFAULTS = {"county": "Nairobi", "collection_point": "commercial", "quality_grade": "good",
                "market_demand_index": 0.65, "month": 6, "day_of_week": 1}

# ---------------------------------------------------------------------------------------------------
# FIXED VALUES -- report
# ---------------------------------------------------------------------------------------------------
WEIGHT_BINS = [(0.0, 5.0, "0-5kg"), (5.0, 20.0, "5-20kg"), (20.0, 50.0, "20-50kg"),
               (50.0, 100.0, "50-100kg"), (100.0, 500.0, "100-500kg"), (500.0, 1000.0, "500kg+")]
PRICE_ERROR_BINS = [(0.0, 5.0, "0-5"), (5.0, 10.0, "5-10"), (10.0, 20.0, "10-20"),
                    (20.0, 50.0, "20-50"), (50.0, 100.0, "50-100"), (100.0, 500.0, "100+")]
PIVOT_WASTE_TYPES = ["plastic", "metal", "paper", "glass", "e_waste"]
CATEGORICAL_FEATURES = ["waste_type", "sub_type", "condition", "county", "collection_point", "market_tier"]
NUMERIC_FEATURES = ["log_weight", "log_distance", "tier_score", "tier_multiplier",
                    "weight_x_condition", "month_sin", "month_cos", "dow_sin", "dow_cos"]
FEATURE_FAMILIES = [
    ("Material Type", ["waste_type", "sub_type"]),
    ("Volume/Weight", ["log_weight", "weight_x_condition"]),
    ("Condition", ["condition", "tier_score", "tier_multiplier"]),
    ("Geography", ["county", "collection_point"]),
    ("Distance", ["log_distance"]),
    ("Temporal", ["month_sin", "month_cos", "dow_sin", "dow_cos"]),
]
QUANTILES = {"lower": 0.05, "mid": 0.50, "upper": 0.95}
HISTOGRAM_BINS = 50
TREND_POINTS = 100  # logspace(0, 3, 100)


def v1_all_subtypes() -> list[str]:
    """Flat ordered sub-type list of the v1 one-hot block."""
    return [st for _, subs in V1_SUBTYPES_BY_WASTE for st in subs]


def v1_feature_names() -> list[str]:
    """The 48 v1 feature names in vector order."""
    return ([f"waste_{w}" for w in V1_WASTE_TYPES] + [f"sub_{s}" for s in v1_all_subtypes()]
            + ["has_subtype", "weight_kg", "distance_km", "consistency_score", "month_sin", "month_cos",
               "dow_sin", "dow_cos", "market_demand_index", "base_price", "weight_log", "price_x_quality"])


def subtypes_in_training_order() -> list[tuple[str, int, str]]:
    """(waste_type, position within the type, sub_type) in training-table order."""
    seen: dict[str, int] = {}
    out = []
    for wt, st, _, _ in BASE_RATES:
        pos = seen.get(wt, 0)
        out.append((wt, pos, st))
        seen[wt] = pos + 1
    return out


# ---------------------------------------------------------------------------------------------------
# Dimension DataFrames (all bounded by the fixed tables above: broadcast-safe)
# ---------------------------------------------------------------------------------------------------
def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(x) for x in v) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_frame(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A small fixed table as an inline SQL table: a JVM ``LocalRelation`` (no Python worker, no RDD),
    cast to the declared schema."""
    schema = T.StructType.fromDDL(ddl)
    names = [f.name for f in schema.fields]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return df.select(*[df[n].cast(f.dataType).alias(n) for n, f in zip(names, schema.fields)])


def _frame(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return local_frame(spark, rows, ddl)


def base_rates_dim(spark: SparkSession) -> DataFrame:
    rows = []
    for wt, pos, st in subtypes_in_training_order():
        mean, std = next((m, s) for w, t, m, s in BASE_RATES if w == wt and t == st)
        rows.append((wt, pos, st, mean, std))
    return _frame(spark, rows, "waste_type string, sub_pos int, sub_type string, base_mean double, base_std double")


def subtype_count_dim(spark: SparkSession) -> DataFrame:
    counts: dict[str, int] = {}
    for wt, _, _ in subtypes_in_training_order():
        counts[wt] = counts.get(wt, 0) + 1
    return _frame(spark, list(counts.items()), "waste_type string, n_subtypes int")


def map_dim(spark: SparkSession, mapping: dict, key: str, value: str, key_type: str = "string") -> DataFrame:
    return _frame(spark, [(k, float(v)) for k, v in mapping.items()], f"{key} {key_type}, {value} double")


def text_dim(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    return _frame(spark, list(mapping.items()), f"{key} string, {value} string")


def v1_subtype_lists_dim(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(i, wt, subs) for i, (wt, subs) in enumerate(V1_SUBTYPES_BY_WASTE)],
                  "type_index int, waste_type string, subtypes array<string>")


def bins_dim(spark: SparkSession, bins, prefix: str = "bin") -> DataFrame:
    rows = [(i, lo, hi, label) for i, (lo, hi, label) in enumerate(bins)]
    return _frame(spark, rows, f"{prefix}_index int, {prefix}_lo double, {prefix}_hi double, {prefix}_label string")


def volume_bands_dim(spark: SparkSession) -> DataFrame:
    rows = [(b, b * VOLUME_BAND_LOW, b * VOLUME_BAND_HIGH) for b in VOLUME_BANDS]
    return _frame(spark, rows, "band_kg int, band_lo double, band_hi double")


def feature_family_dim(spark: SparkSession) -> DataFrame:
    rows = [(feat, fam) for fam, feats in FEATURE_FAMILIES for feat in feats]
    return _frame(spark, rows, "feature string, family string")
