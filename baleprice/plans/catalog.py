"""Registered queries: ``key -> (spark builder, DuckDB oracle SQL or None)``.

Every builder takes ``(spark, sf_dir)``, reads the driver's tables (through the listings stand-in),
runs the library's operators over the whole input and returns a DataFrame. Output doubles that come
out of sums, averages or transcendental functions are rounded to a fixed number of decimals in both
engines (``round_doubles`` / ``rd``), so the comparison is not at the mercy of summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numeric import round_doubles, round_even
from baleprice.operators import clean as C
from baleprice.operators import evaluate as E
from baleprice.operators import features as FE
from baleprice.operators import lookups as L
from baleprice.operators import report as R
from baleprice.operators import rules as RU
from baleprice.operators import scoring as SC
from baleprice.plans import sql as S
from baleprice.session import stored
from baleprice.sources.listings import KEY, raw_listings, training_table

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    key: str
    build: Builder
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}
DIGITS = 6


def register(key: str, sql: Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[key] = Query(key, fn, sql() if sql else None, (fn.__doc__ or "").strip())
        return fn
    return deco


def rd(x: str, d: int = DIGITS) -> str:
    """Oracle-side rounding of an output double (same rule as ``round_doubles``)."""
    return S.r_even(x, d)


# ------------------------------------------------------------------------------------------------------
# 2.7 aggregations over the training table
# ------------------------------------------------------------------------------------------------------
def _price_by_waste_type_sql() -> str:
    return S.with_base(f"""
SELECT waste_type, count(price_per_kg) AS n_rows, {rd('avg(price_per_kg)')} AS mean_price,
  {rd('stddev_samp(price_per_kg)')} AS std_price
FROM training WHERE waste_type IS NOT NULL GROUP BY waste_type ORDER BY mean_price DESC, waste_type""")


@register("price_by_waste_type", _price_by_waste_type_sql)
def price_by_waste_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: mean and sample std of the price per kg by waste type, mean descending."""
    return round_doubles(R.mean_std_by(training_table(spark, sf_dir), "waste_type"), DIGITS)


# ------------------------------------------------------------------------------------------------------
# shared builders
# ------------------------------------------------------------------------------------------------------


def _v2_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v2-cleaned listings with the live tier and rule predictions, post-processed."""
    cleaned = RU.tier_live(C.clean_listings(raw_listings(spark, sf_dir), "v2"))
    return SC.postprocess_range(SC.rule_predictions(cleaned), "v2")


def _training_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = training_table(spark, sf_dir, keep=("expected_price_raw",))
    return SC.rule_predictions(priced, price="expected_price_raw").drop("expected_price_raw")


V2_PRICED_SQL = """v2c AS ({clean}),
v2t AS ({tier}),
v2p AS ({pred}),
v2 AS ({post})"""


def _v2_ctes() -> str:
    return V2_PRICED_SQL.format(clean=S.clean_select("v2"), tier=S.tier_select("live", "v2c"),
                                pred=S.rule_pred_select("v2t"), post=S.postprocess_select("v2", "v2p"))


def _train_pred_cte() -> str:
    return f"tp AS ({S.rule_pred_select('training')})"


# ------------------------------------------------------------------------------------------------------
# 2.2 validation, cleaning
# ------------------------------------------------------------------------------------------------------
def _checks_sql() -> list[str]:
    lo_w, hi_w = D.WEIGHT_BOUNDS
    lo_d, hi_d = D.DISTANCE_BOUNDS
    return [
        f"CASE WHEN waste_type IS NULL THEN 'waste_type missing' WHEN waste_type NOT IN {S.in_list(D.VALID_WASTE_TYPES)} "
        f"THEN 'waste_type not allowed' END",
        "CASE WHEN sub_type IS NULL THEN 'sub_type missing' WHEN NOT (length(sub_type) BETWEEN 2 AND 50) "
        "THEN 'sub_type length not in 2-50' END",
        f"CASE WHEN weight_kg IS NULL THEN 'weight_kg missing' WHEN NOT (weight_kg BETWEEN {S.num(lo_w)} AND {S.num(hi_w)}) "
        f"THEN 'weight_kg not in 0.5-1000' END",
        f"CASE WHEN condition IS NOT NULL AND condition NOT IN {S.in_list(D.VALID_CONDITIONS)} THEN 'condition not allowed' END",
        f"CASE WHEN county IS NOT NULL AND county NOT IN {S.in_list(D.VALID_COUNTIES)} THEN 'county not allowed' END",
        f"CASE WHEN distance_km IS NOT NULL AND NOT (distance_km BETWEEN {S.num(lo_d)} AND {S.num(hi_d)}) "
        f"THEN 'distance_km not in 0.1-200' END",
        f"CASE WHEN collection_point IS NOT NULL AND collection_point NOT IN {S.in_list(D.VALID_COLLECTION_POINTS)} "
        f"THEN 'collection_point not allowed' END",
    ]


def _validated_sql() -> str:
    checks = _checks_sql()
    n = " + ".join(f"(CASE WHEN ({c}) IS NULL THEN 0 ELSE 1 END)" for c in checks)
    return f"""validated AS (SELECT {S.KEY}, CAST({n} AS INTEGER) AS n_errors,
  concat_ws('; ', {', '.join(checks)}) AS errors_text FROM raw_listings)"""


def _validated_spark(spark, sf_dir):
    v = C.validate_listings(raw_listings(spark, sf_dir))
    return v.select(*KEY, F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors_text"),
                    "is_valid")


@register("validate_listings", lambda: S.with_base(
    "SELECT *, n_errors = 0 AS is_valid FROM validated", _validated_sql()))
def validate_listings(spark, sf_dir):
    """Per-listing schema check (enums case-sensitive, bounds inclusive, required fields)."""
    return _validated_spark(spark, sf_dir)


@register("rejected_listings", lambda: S.with_base(
    "SELECT * FROM validated WHERE n_errors > 0", _validated_sql()))
def rejected_listings(spark, sf_dir):
    """The rejected listings with every reason (per row, not per batch)."""
    return _validated_spark(spark, sf_dir).filter(~F.col("is_valid")).drop("is_valid")


def _reject_counts_sql() -> str:
    unions = " UNION ALL ".join(f"SELECT {c} AS reason FROM raw_listings" for c in _checks_sql())
    return S.with_base(f"""
SELECT 'error' AS severity, reason, count(*) AS n_rows FROM ({unions}) WHERE reason IS NOT NULL GROUP BY reason
UNION ALL
SELECT 'warning' AS severity, 'collection_point dump_site priced as commercial' AS reason, count(*) AS n_rows
FROM raw_listings WHERE collection_point = 'dump_site' HAVING count(*) > 0""")


@register("reject_counts", _reject_counts_sql)
def reject_counts(spark, sf_dir):
    """Number of listings per rejection reason, plus the dump-site pricing warning."""
    return C.reject_counts(raw_listings(spark, sf_dir))


CLEAN_COLS = ["waste_type", "sub_type", "weight_kg", "distance_km", "condition", "county", "collection_point"]


@register("clean_listings", lambda: S.with_base(
    f"SELECT {S.KEY}, {', '.join(CLEAN_COLS)} FROM ({S.clean_select('v2')})"))
def clean_listings(spark, sf_dir):
    """v2 defaults, clipping and normalisation of every listing."""
    return C.clean_listings(raw_listings(spark, sf_dir), "v2").select(*KEY, *CLEAN_COLS)


@register("date_defaults", lambda: S.with_base(
    f"SELECT {S.KEY}, CAST(month(listed_at) AS INT) AS month, CAST(isodow(listed_at) - 1 AS INT) AS day_of_week, "
    "CAST(dayofweek(listed_at) AS INT) AS day_of_week_js FROM raw_listings"))
def date_defaults(spark, sf_dir):
    """Month and weekday resolved from the listing date when the request omits them
    (Python Monday=0 and JavaScript Sunday=0 conventions)."""
    raw = raw_listings(spark, sf_dir).drop("month", "day_of_week")
    py = C.resolve_dates(raw, "listed_at", "python")
    js = C.resolve_dates(py, "listed_at", "js", month_col="_m_js", dow_col="day_of_week_js").drop("_m_js")
    return js.select(*KEY, "month", "day_of_week", "day_of_week_js")


@register("volume_band_check", lambda: S.with_base(f"""
SELECT b.band_kg, count(*) AS n_rows, {rd('avg(t.price_per_kg)')} AS mean_price
FROM training t JOIN (SELECT band_kg, band_kg * {S.num(D.VOLUME_BAND_LOW)} AS lo, band_kg * {S.num(D.VOLUME_BAND_HIGH)} AS hi
  FROM (VALUES {', '.join(f'({b})' for b in D.VOLUME_BANDS)}) v(band_kg)) b
  ON t.weight_kg >= b.lo AND t.weight_kg <= b.hi
WHERE t.waste_type = 'plastic' AND t.condition = 'clean'
GROUP BY b.band_kg HAVING count(*) > {D.VOLUME_BAND_MIN_ROWS}"""))
def volume_band_check(spark, sf_dir):
    """plastic/clean rows in the overlapping weight bands [0.7c, 1.3c] around 1/10/50/100/500 kg,
    mean price per band, shown when the band holds more than 5 rows."""
    t = training_table(spark, sf_dir).filter((F.col("waste_type") == "plastic") & (F.col("condition") == "clean"))
    out = (L.with_volume_bands(t).groupBy("band_kg")
           .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("price_per_kg").alias("mean_price"))
           .filter(F.col("n_rows") > D.VOLUME_BAND_MIN_ROWS))
    return round_doubles(out, DIGITS)


# ------------------------------------------------------------------------------------------------------
# 2.3 / 2.4 / 2.5 lookups, features and rule prices (row level)
# ------------------------------------------------------------------------------------------------------
def _v1_feature_sql() -> list[str]:
    out = [f"CAST(CASE WHEN waste_type = {S.lit(w)} THEN 1.0E0 ELSE 0.0E0 END AS FLOAT) AS waste_{w}"
           for w in D.V1_WASTE_TYPES]
    out += [f"CAST(CASE WHEN sub_type = {S.lit(s)} THEN 1.0E0 ELSE 0.0E0 END AS FLOAT) AS sub_{s}"
            for s in D.v1_all_subtypes()]
    two_pi = S.num(FE.TWO_PI)
    base = _base_price_sql()
    seas = S.case_map("month", D.SEASONAL_DEMAND, D.SEASONAL_DEMAND_DEFAULT)
    exprs = [
        ("has_subtype", "CASE WHEN sub_type IS NOT NULL AND sub_type <> '' THEN 1.0E0 ELSE 0.0E0 END"),
        ("weight_kg", "weight_kg"), ("distance_km", "distance_km"), ("consistency_score", "consistency_score"),
        ("month_sin", f"sin({two_pi} * month / 12.0E0)"), ("month_cos", f"cos({two_pi} * month / 12.0E0)"),
        ("dow_sin", f"sin({two_pi} * day_of_week / 7.0E0)"), ("dow_cos", f"cos({two_pi} * day_of_week / 7.0E0)"),
        ("market_demand_index", f"coalesce(market_demand_index, {seas})"),
        ("base_price", base), ("weight_log", "ln(1 + weight_kg)"), ("price_x_quality", f"{base} * consistency_score"),
    ]
    return out + [f"CAST({e} AS FLOAT) AS {n}" for n, e in exprs]


def _base_price_sql() -> str:
    return (f"coalesce({S.case_map('sub_type', D.SUBTYPE_PRICES)}, {S.case_map('waste_type', D.WASTE_BASE_PRICES)}, "
            f"{S.num(D.BASE_PRICE_DEFAULT)})")


@register("v1_features", lambda: S.with_base(f"SELECT {S.KEY}, {', '.join(_v1_feature_sql())} FROM raw_listings"))
def v1_features(spark, sf_dir):
    """The 48 float32 v1 features in vector order."""
    return FE.v1_features(raw_listings(spark, sf_dir), keep=KEY)


@register("base_price_lookup", lambda: S.with_base(f"""
SELECT {S.KEY}, waste_type, sub_type, {_base_price_sql()} AS base_price,
  CASE WHEN {S.case_map('sub_type', D.SUBTYPE_PRICES)} IS NOT NULL THEN 'sub_type'
    WHEN {S.case_map('waste_type', D.WASTE_BASE_PRICES)} IS NOT NULL THEN 'waste_type' ELSE 'default' END AS base_source
FROM raw_listings"""))
def base_price_lookup(spark, sf_dir):
    """Sub-type price, else waste-type price, else 20 (sub-type not checked against the type)."""
    return L.with_base_price_v1(raw_listings(spark, sf_dir)).select(
        *KEY, "waste_type", "sub_type", "base_price", "base_source")


FACTOR_FIELDS = ["base_price_kes", "weight_multiplier", "quality_adjustment", "distance_penalty",
                 "seasonality_factor", "demand_boost"]


def _factor_sql(base: str, rnd, per_km: float, cap: float, v1: bool, rnd_weight=None) -> list[str]:
    seas = S.case_map("month", D.SEASONAL_DEMAND, D.SEASONAL_DEMAND_DEFAULT)
    dem = f"coalesce(market_demand_index, {seas})"
    pen = f"least(distance_km * {S.num(per_km)}, {base} * {S.num(cap)})"
    return [
        f"{rnd(base, 2) if v1 else base} AS base_price_kes",
        f"{(rnd_weight or rnd)('1.0E0 + ln(1 + weight_kg) * 0.02E0', 3)} AS weight_multiplier",
        f"{rnd(f'(consistency_score - 0.5E0) * {base} * 0.4E0', 2)} AS quality_adjustment",
        f"(-abs({rnd(pen, 2)})) AS distance_penalty",
        f"{rnd(seas, 3) if v1 else seas} AS seasonality_factor",
        f"{rnd(f'({dem} - 0.85E0) * {base} * 0.25E0', 2)} AS demand_boost",
    ]


def _fallback_sql() -> str:
    base = S.case_map("waste_type", D.WASTE_BASE_PRICES, D.BASE_PRICE_DEFAULT)
    seas = S.case_map("month", D.SEASONAL_DEMAND, D.SEASONAL_DEMAND_DEFAULT)
    dem = f"coalesce(market_demand_index, {seas})"
    half = S.case_map("waste_type", D.FALLBACK_HALF_WIDTH, D.FALLBACK_HALF_WIDTH_DEFAULT)
    price = (f"greatest({base} * {seas} * (0.85E0 + {dem} * 0.3E0) * (0.7E0 + consistency_score * 0.6E0)"
             f" - least(distance_km * 0.12E0, {base} * 0.25E0) + ln(1 + weight_kg) * 0.4E0, 1.0E0)")
    factors = ", ".join(_factor_sql(base, S.r_js, *D.PENALTY_JS, v1=False))
    return S.with_base(f"""
SELECT {S.KEY}, {S.r_js('_p', 2)} AS predicted_price_per_kg, {S.r_js('_p * weight_kg', 2)} AS total_estimated_price,
  ci_low, ci_high, {S.num(D.FALLBACK_LEVEL)} AS ci_level, '{D.FALLBACK_MODEL_VERSION}' AS model_version,
  TRUE AS is_fallback, 'KES ' || printf('%.2f', ci_low) || ' – ' || printf('%.2f', ci_high) AS confidence_label,
  {factors}
FROM (SELECT *, greatest({S.r_js(f'_p - {half}', 2)}, {S.num(D.FALLBACK_LOW_FLOOR)}) AS ci_low,
        {S.r_js(f'_p + {half}', 2)} AS ci_high
      FROM (SELECT *, {price} AS _p FROM raw_listings))""")


@register("fallback_price", _fallback_sql)
def fallback_price(spark, sf_dir):
    """Rule-based fallback price, interval, factors and label for every
    listing (JavaScript rounding)."""
    fb = RU.fallback_price(raw_listings(spark, sf_dir))
    return fb.select(*KEY, "predicted_price_per_kg", "total_estimated_price", "ci_low", "ci_high", "ci_level",
                     "model_version", "is_fallback", "confidence_label",
                     *[F.col(f"price_factors.{f}").alias(f) for f in FACTOR_FIELDS])


@register("price_factors_js", lambda: S.with_base(
    f"SELECT {S.KEY}, {', '.join(_factor_sql(S.case_map('waste_type', D.WASTE_BASE_PRICES, D.BASE_PRICE_DEFAULT), S.r_js, *D.PENALTY_JS, v1=False))} "
    "FROM raw_listings"))
def price_factors_js(spark, sf_dir):
    """Js factor breakdown, distance penalty min(.12 km, .25 base)."""
    fb = RU.fallback_price(raw_listings(spark, sf_dir))
    return fb.select(*KEY, *[F.col(f"price_factors.{f}").alias(f) for f in FACTOR_FIELDS])


@register("price_factors_v1", lambda: S.with_base(
    f"SELECT {S.KEY}, {', '.join(_factor_sql(_base_price_sql(), S.r_py, *D.PENALTY_V1, v1=True, rnd_weight=S.r_even))} FROM raw_listings"))
def price_factors_v1(spark, sf_dir):
    """v1 factor breakdown, base from C1, distance penalty min(.15 km, .30 base)."""
    pf = RU.price_factors_v1(raw_listings(spark, sf_dir))
    return pf.select(*KEY, *[F.col(f"price_factors.{f}").alias(f) for f in FACTOR_FIELDS])


def _e8_sql() -> str:
    base = S.case_map("sub_type", D.SUBTYPE_PRICES)
    seas = S.case_map("month", D.SEASONAL_DEMAND)
    price = (f"greatest({base} * {seas} * (0.85E0 + coalesce(market_demand_index, {seas}) * 0.3E0)"
             f" * (0.7E0 + consistency_score * 0.6E0) * (CASE WHEN day_of_week >= 5 THEN 1.03E0 ELSE 1.0E0 END)"
             f" - least(distance_km * 0.12E0, {base} * 0.25E0) + ln(1 + weight_kg) * 0.4E0, 1.0E0)")
    return S.with_base(f"""SELECT {S.KEY}, CASE WHEN {base} IS NULL OR {seas} IS NULL THEN NULL
  ELSE {S.r_even(price, 2)} END AS expected_price_v1 FROM raw_listings""")


@register("expected_price_v1", _e8_sql)
def expected_price_v1(spark, sf_dir):
    """Noise-free v1 generator price of every listing (strict sub-type price -> NULL when unknown)."""
    return RU.expected_price_v1(raw_listings(spark, sf_dir)).select(*KEY, "expected_price_v1")


@register("tier_live", lambda: S.with_base(
    f"SELECT {S.KEY}, tier_multiplier, tier_score, market_tier FROM ({S.tier_select('live', '(' + S.clean_select('v2') + ')')})"))
def tier_live(spark, sf_dir):
    """Live tier of every v2-cleaned listing (bulk = less formal)."""
    return RU.tier_live(C.clean_listings(raw_listings(spark, sf_dir), "v2")).select(
        *KEY, "tier_multiplier", "tier_score", "market_tier")


@register("tier_old", lambda: S.with_base(
    f"SELECT {S.KEY}, tier_multiplier, tier_score, market_tier FROM ({S.tier_select('old', '(' + S.clean_select('v2old') + ')')})"))
def tier_old(spark, sf_dir):
    """Old-generation tier (bulk = more formal, no clip of the score)."""
    return RU.tier_old(C.clean_listings(raw_listings(spark, sf_dir), "v2old")).select(
        *KEY, "tier_multiplier", "tier_score", "market_tier")


@register("tier_train", lambda: S.with_base(
    f"SELECT {S.KEY}, condition, tier_multiplier, tier_score, market_tier FROM ({S.tier_select('train', '(' + S.clean_select('train') + ')')})"))
def tier_train(spark, sf_dir):
    """Training tier from the condition factor only (label on the rounded score)."""
    return RU.tier_train(C.clean_listings(raw_listings(spark, sf_dir), "train")).select(
        *KEY, "condition", "tier_multiplier", "tier_score", "market_tier")


@register("step_multipliers", lambda: S.with_base(f"""
SELECT {S.KEY}, weight_kg, {S.steps('weight_kg', D.VOLUME_STEPS, D.VOLUME_STEP_ELSE)} AS volume_multiplier,
  distance_km, {S.steps('distance_km', D.DISTANCE_STEPS, D.DISTANCE_STEP_ELSE)} AS distance_multiplier
FROM training"""))
def step_multipliers(spark, sf_dir):
    """Right-closed volume and distance steps of every training row."""
    return RU.with_step_multipliers(training_table(spark, sf_dir)).select(
        *KEY, "weight_kg", "volume_multiplier", "distance_km", "distance_multiplier")


@register("expected_price_v2", lambda: S.with_base(f"""
SELECT {S.KEY}, {S.r_py(f'greatest(0.5E0, {S.e7_raw("x", "x.tier_multiplier")})', 2)} AS expected_price,
  {rd(S.e7_raw("x", "x.tier_multiplier"))} AS expected_price_raw
FROM training x LEFT JOIN subtypes _br ON _br.waste_type = x.waste_type AND _br.sub_type = x.sub_type"""))
def expected_price_v2(spark, sf_dir):
    """Noise-free v2 expected price of every training row."""
    e7 = RU.expected_price_v2(training_table(spark, sf_dir), tier_multiplier="tier_multiplier")
    return e7.select(*KEY, "expected_price", round_even("expected_price_raw", DIGITS).alias("expected_price_raw"))


@register("base_rate_join", lambda: S.with_base(f"""
SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, x.l_extendedprice, s.base_mean, s.base_std
FROM training x JOIN subtypes s ON s.waste_type = x.waste_type AND s.sub_type = x.sub_type"""))
def base_rate_join(spark, sf_dir):
    """Strict composite-key join of every training row to the base-rate table (broadcast)."""
    return L.with_base_rates(training_table(spark, sf_dir), how="inner").select(*KEY, "base_mean", "base_std")


V2F = ["waste_type", "sub_type", "condition", "county", "collection_point", "market_tier", "log_weight",
       "log_distance", "tier_score", "tier_multiplier", "weight_x_condition", "month_sin", "month_cos",
       "dow_sin", "dow_cos"]


def _v2_feature_sql(src: str = "training") -> str:
    two_pi = S.num(FE.TWO_PI)
    cs = "(CASE condition WHEN 'clean' THEN 1.0E0 WHEN 'mixed' THEN 0.5E0 WHEN 'contaminated' THEN 0.0E0 END)"
    return f"""SELECT {S.KEY}, waste_type, sub_type, condition, county, collection_point, market_tier,
  ln(1 + weight_kg) AS log_weight, ln(1 + distance_km) AS log_distance, tier_score, tier_multiplier,
  ln(1 + weight_kg) * {cs} AS weight_x_condition,
  sin({two_pi} * month / 12.0E0) AS month_sin, cos({two_pi} * month / 12.0E0) AS month_cos,
  sin({two_pi} * day_of_week / 7.0E0) AS dow_sin, cos({two_pi} * day_of_week / 7.0E0) AS dow_cos
FROM {src}"""


def _rounded_cols(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"{rd(c)} AS {c}" if c in doubles else c for c in cols)


V2F_DOUBLE = {"log_weight", "log_distance", "tier_score", "tier_multiplier", "weight_x_condition", "month_sin",
              "month_cos", "dow_sin", "dow_cos"}


@register("v2_features", lambda: S.with_base(
    f"SELECT {S.KEY}, {_rounded_cols(V2F, V2F_DOUBLE)} FROM ({_v2_feature_sql()})"))
def v2_features(spark, sf_dir):
    """The 15-feature v2 frame of every training row."""
    return round_doubles(FE.v2_features(training_table(spark, sf_dir)).select(*KEY, *V2F), DIGITS)


V1R = ["waste_type", "sub_type", "consistency_score", "market_demand_index", "county", "collection_point",
       "quality_grade", "log_weight", "log_distance", "month_sin", "month_cos", "dow_sin", "dow_cos",
       "quality_x_demand"]


def _v1r_sql() -> str:
    two_pi = S.num(FE.TWO_PI)
    dflt = D.V1R_DEFAULTS
    inner = f"""SELECT {S.KEY}, waste_type, sub_type, consistency_score,
    coalesce(market_demand_index, {S.num(dflt['market_demand_index'])}) AS market_demand_index,
    coalesce(county, '{dflt['county']}') AS county, coalesce(collection_point, '{dflt['collection_point']}') AS collection_point,
    '{dflt['quality_grade']}' AS quality_grade, ln(1 + weight_kg) AS log_weight, ln(1 + distance_km) AS log_distance,
    sin({two_pi} * coalesce(month, {dflt['month']}) / 12.0E0) AS month_sin, cos({two_pi} * coalesce(month, {dflt['month']}) / 12.0E0) AS month_cos,
    sin({two_pi} * coalesce(day_of_week, {dflt['day_of_week']}) / 7.0E0) AS dow_sin,
    cos({two_pi} * coalesce(day_of_week, {dflt['day_of_week']}) / 7.0E0) AS dow_cos,
    consistency_score * coalesce(market_demand_index, {S.num(dflt['market_demand_index'])}) AS quality_x_demand
  FROM raw_listings"""
    dbl = {"consistency_score", "market_demand_index", "log_weight", "log_distance", "month_sin", "month_cos",
           "dow_sin", "dow_cos", "quality_x_demand"}
    return S.with_base(f"SELECT {S.KEY}, {_rounded_cols(V1R, dbl)} FROM ({inner})")


@register("v1r_features", _v1r_sql)
def v1r_features(spark, sf_dir):
    """v1r feature frame (consistency x demand, pass-through categories with v1r defaults)."""
    return round_doubles(FE.v1r_features(raw_listings(spark, sf_dir)).select(*KEY, *V1R), DIGITS)


def _subtype_rows_sql() -> str:
    vals = ", ".join(f"({i}, {S.lit(w)}, {p}, {S.lit(s)})" for i, (w, subs) in enumerate(D.V1_SUBTYPES_BY_WASTE)
                     for p, s in enumerate(subs))
    return S.with_base(f"""
SELECT r.sub_type, CAST(f.flat_pos AS INTEGER) AS flat_pos, f.waste_type AS list_waste_type, count(*) AS n_rows
FROM raw_listings r LEFT JOIN (
  SELECT waste_type, sub_type, row_number() OVER (ORDER BY type_index, pos) - 1 AS flat_pos
  FROM (VALUES {vals}) v(type_index, waste_type, pos, sub_type)) f ON f.sub_type = r.sub_type
GROUP BY r.sub_type, f.flat_pos, f.waste_type""")


@register("subtype_rows", _subtype_rows_sql)
def subtype_rows(spark, sf_dir):
    """The v1 type -> sub-type lists flattened to ordered one-hot positions, matched to every
    listing's sub-type (sub-types outside the v1 vocabulary get no position)."""
    flat = L.subtype_rows(spark).select("sub_type", F.col("flat_pos").cast("int").alias("flat_pos"),
                                        F.col("waste_type").alias("list_waste_type"))
    raw = raw_listings(spark, sf_dir).select("sub_type")
    return (raw.join(F.broadcast(flat), "sub_type", "left")
            .groupBy("sub_type", "flat_pos", "list_waste_type").agg(F.count(F.lit(1)).alias("n_rows")))


# ------------------------------------------------------------------------------------------------------
# 2.6 scoring / post-processing (rule predictions stand in for the models so the SQL check applies)
# ------------------------------------------------------------------------------------------------------
POST_COLS = ["market_tier", "tier_score", "collection_point_multiplier", "county_multiplier", "lower_bound",
             "recommended", "upper_bound", "payout_lower", "payout_recommended", "payout_upper", "range_width",
             "volatility", "market_signal", "coverage"]


@register("postprocess_range", lambda: S.with_base(
    f"SELECT {S.KEY}, {_rounded_cols(POST_COLS, {'volatility'})} FROM v2", _v2_ctes()))
def postprocess_range(spark, sf_dir):
    """Floor, multipliers, crossing guard, bounds, payouts, width and signal for every
    v2-cleaned listing (predictions from the deterministic rule predictor)."""
    return round_doubles(_v2_priced(spark, sf_dir).select(*KEY, *POST_COLS), DIGITS,
                         exclude=tuple(c for c in POST_COLS if c != "volatility"))


@register("apply_multipliers", lambda: S.with_base(
    f"""SELECT {S.KEY}, collection_point, county, {S.case_map('collection_point', D.V2_COLLECTION_POINT_MULT, 1.0)} AS collection_point_multiplier,
  {S.case_map('county', D.COUNTY_MULT, 1.0)} AS county_multiplier,
  {rd(f"greatest(1.0E0, pred_lower) * {S.case_map('collection_point', D.V2_COLLECTION_POINT_MULT, 1.0)} * {S.case_map('county', D.COUNTY_MULT, 1.0)}")} AS adj_lower,
  {rd(f"greatest(1.0E0, pred_mid) * {S.case_map('collection_point', D.V2_COLLECTION_POINT_MULT, 1.0)} * {S.case_map('county', D.COUNTY_MULT, 1.0)}")} AS adj_mid,
  {rd(f"greatest(1.0E0, pred_upper) * {S.case_map('collection_point', D.V2_COLLECTION_POINT_MULT, 1.0)} * {S.case_map('county', D.COUNTY_MULT, 1.0)}")} AS adj_upper
FROM v2p""", _v2_ctes()))
def apply_multipliers(spark, sf_dir):
    """Prediction floor, then collection-point and county multipliers."""
    cleaned = RU.tier_live(C.clean_listings(raw_listings(spark, sf_dir), "v2"))
    out = SC.apply_multipliers(SC.rule_predictions(cleaned))
    return round_doubles(out.select(*KEY, "collection_point", "county", "collection_point_multiplier",
                                    "county_multiplier", "adj_lower", "adj_mid", "adj_upper"), DIGITS,
                         exclude=("collection_point_multiplier", "county_multiplier"))


@register("advice_text", lambda: S.with_base(f"SELECT {S.KEY}, market_tier, collection_point, advice FROM v2",
                                             _v2_ctes()))
def advice_text(spark, sf_dir):
    """Seller advice (prices to 0 decimals + tier advice + collection-point advice)."""
    return _v2_priced(spark, sf_dir).select(*KEY, "market_tier", "collection_point", "advice")


@register("signal_counts", lambda: S.with_base(
    "SELECT market_signal, count(*) AS n_rows FROM v2 GROUP BY market_signal", _v2_ctes()))
def signal_counts(spark, sf_dir):
    """number of listings per market signal."""
    return _v2_priced(spark, sf_dir).groupBy("market_signal").agg(F.count(F.lit(1)).alias("n_rows"))


OLD_COLS = ["lower_bound", "recommended", "upper_bound", "payout_lower", "payout_recommended", "payout_upper",
            "range_width", "volatility", "market_signal", "coverage", "market_tier", "tier_score", "advice"]


def _old_sql() -> str:
    ctes = f"""oc AS ({S.clean_select('train')}),
op AS ({S.rule_pred_select('oc')}),
o2 AS ({S.tier_select('old', 'op')}),
o2p AS ({S.postprocess_select('v2old', 'o2')}),
r1 AS (SELECT op.* EXCLUDE (weight_kg), rl.weight_kg FROM op JOIN raw_listings rl USING ({S.KEY})),
r1p AS ({S.postprocess_select('v1r', 'r1')})"""
    cols = _rounded_cols(OLD_COLS, {"volatility"})
    cols_v1r = cols.replace("market_tier", "CAST(NULL AS VARCHAR) AS market_tier").replace(
        "tier_score", "CAST(NULL AS DOUBLE) AS tier_score")
    return S.with_base(f"""SELECT 'v2old' AS generation, {S.KEY}, {cols} FROM o2p
UNION ALL SELECT 'v1r' AS generation, {S.KEY}, {cols_v1r} FROM r1p""", ctes)


@register("postprocess_range_old", _old_sql)
def postprocess_range_old(spark, sf_dir):
    """older generations -- v2old (floor, no multipliers, no guard, coverage '62%', old tier) and
    v1r (floor, signal, short advice, unclipped weight) -- over every listing."""
    raw = raw_listings(spark, sf_dir).withColumn("raw_weight_kg", F.col("weight_kg"))  # v1r does not clip
    pred = SC.rule_predictions(C.clean_listings(raw, "train"))
    old = SC.postprocess_range(RU.tier_old(pred), "v2old")
    v1r = SC.postprocess_range(
        old.withColumn("_v2old", F.struct(F.lit("v2old").alias("generation"), *OLD_COLS)), "v1r", weight="raw_weight_kg")
    # a row carries both generations and is unfolded last, so that the listings are joined and priced once
    absent = {"market_tier": F.lit(None).cast("string"), "tier_score": F.lit(None).cast("double")}
    unfolded = F.inline(F.array("_v2old", F.struct(F.lit("v1r").alias("generation"), *[
        absent.get(c, F.col(c)).alias(c) for c in OLD_COLS])))
    both = v1r.select(*KEY, unfolded).select("generation", *KEY, *OLD_COLS)
    return round_doubles(both, DIGITS, exclude=tuple(c for c in OLD_COLS if c != "volatility"))


def _nested_json_sql() -> str:
    # DuckDB's to_json writes the same text as Spark's for these records (field order, UTF-8 dashes,
    # doubles between 1e-3 and 1e7; outside that range the two engines' number formats differ).
    body = f"""SELECT {S.KEY}, to_json(struct_pack(waste_type := waste_type, sub_type := sub_type, weight_kg := weight_kg,
  price_range := struct_pack(lower_bound := lower_bound, recommended := recommended, upper_bound := upper_bound,
    currency := '{D.CURRENCY}', unit := '{D.UNIT}'),
  total_payout_range := struct_pack(lower := payout_lower, recommended := payout_recommended, upper := payout_upper,
    weight_kg := weight_kg, currency := '{D.CURRENCY}'),
  market_info := struct_pack(market_tier := market_tier, tier_score := tier_score, range_width := range_width,
    market_signal := market_signal, coverage := coverage, advice := advice)))::VARCHAR AS response_json
FROM v2"""
    return S.with_base(body, _v2_ctes())


@register("score_nested_json", _nested_json_sql)
def score_nested_json(spark, sf_dir):
    """Nested API-shaped price record per listing, serialised as JSON text."""
    resp = SC.nest_response(_v2_priced(spark, sf_dir), "v2", api_shape=True)
    return resp.select(*KEY, F.to_json("response").alias("response_json"))


# ------------------------------------------------------------------------------------------------------
# 2.7 / 2.8 report over the training table
# ------------------------------------------------------------------------------------------------------
def _training(spark, sf_dir):
    return training_table(spark, sf_dir)


def _report_stats_sql() -> str:
    tiers = [("formal", "Formal"), ("semi_formal", "Semi-formal"), ("informal", "Informal")]
    tier_rows = " UNION ALL ".join(
        f"SELECT 'market_tier' AS section, '{label} count' AS metric, CAST(count(*) FILTER (WHERE market_tier = '{t}') AS DOUBLE) AS value FROM training "
        f"UNION ALL SELECT 'market_tier', '{label} pct', {rd(f'count(*) FILTER (WHERE market_tier = {chr(39)}{t}{chr(39)}) / count(*) * 100.0E0')} FROM training"
        for t, label in tiers)
    return S.with_base(f"""
SELECT 'data' AS section, 'total samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM training
UNION ALL SELECT 'data', 'features', {S.num(len(D.CATEGORICAL_FEATURES) + len(D.NUMERIC_FEATURES))}
UNION ALL SELECT 'data', 'categorical features', {S.num(len(D.CATEGORICAL_FEATURES))}
UNION ALL SELECT 'data', 'numerical features', {S.num(len(D.NUMERIC_FEATURES))}
UNION ALL SELECT 'price', 'mean', {rd('avg(price_per_kg)')} FROM training
UNION ALL SELECT 'price', 'median', {rd('quantile_cont(price_per_kg, 0.5)')} FROM training
UNION ALL SELECT 'price', 'std', {rd('stddev_samp(price_per_kg)')} FROM training
UNION ALL SELECT 'price', 'min', min(price_per_kg) FROM training
UNION ALL SELECT 'price', 'max', max(price_per_kg) FROM training
UNION ALL {tier_rows}""")


_SKETCH_QS = {"q05": 0.05, "q50": 0.50, "q95": 0.95}


@register("sketch_quantiles", lambda: S.with_base(
    "SELECT waste_type, count(*) AS n_rows, " + ", ".join(f"true AS {q}_within" for q in _SKETCH_QS)
    + " FROM training WHERE waste_type IS NOT NULL AND price_per_kg IS NOT NULL GROUP BY waste_type"))
def sketch_quantiles(spark, sf_dir):
    """G2, section 7.3: price quantiles by waste type from KLL sketches kept per month and merged, and whether each
    one's true rank among the prices lies within 2 % of the quantile asked for (ties count on either side). Sketches and
    ranks both read the priced listings: their three columns are stored, so that they are joined and priced once."""
    t = stored(_training(spark, sf_dir).filter(F.col("waste_type").isNotNull() & F.col("price_per_kg").isNotNull())
               .select("waste_type", "month", "price_per_kg"), "prices")
    monthly = R.quantile_sketches(t, F.col("price_per_kg"), ["waste_type", "month"])
    found = R.sketch_quantiles(R.merged_sketches(monthly, ["waste_type"]), _SKETCH_QS)
    counted = R.frequencies(t, F.col("price_per_kg"), ["waste_type"]).withColumnRenamed("n_rows", "n")

    def within(name: str, q: float):
        below = F.sum(F.when(F.col("value") < F.col(name), F.col("n")).otherwise(0)) / F.col("n_rows")
        upto = F.sum(F.when(F.col("value") <= F.col(name), F.col("n")).otherwise(0)) / F.col("n_rows")
        return ((below <= q + 0.02) & (upto >= q - 0.02)).alias(f"{name}_within")

    return counted.join(found, "waste_type").groupBy("waste_type", "n_rows", *_SKETCH_QS).agg(
        *[within(name, q) for name, q in _SKETCH_QS.items()]).drop(*_SKETCH_QS)


@register("report_stats", _report_stats_sql)
def report_stats(spark, sf_dir):
    """The text report's data section as (section, metric, value) rows: sample and feature
    counts, price mean / median / std / min / max, tier counts and shares."""
    t = _training(spark, sf_dir).select("price_per_kg", "market_tier")
    labels = {"formal": "Formal", "semi_formal": "Semi-formal", "informal": "Informal"}
    # one pass: every statistic of the section in a single aggregate, then rows via stack
    one = t.agg(F.count(F.lit(1)).alias("n"), F.avg("price_per_kg").alias("mean"),
                F.percentile("price_per_kg", 0.5).alias("median"), F.stddev_samp("price_per_kg").alias("std"),
                F.min("price_per_kg").alias("min"), F.max("price_per_kg").alias("max"),
                *[F.count(F.when(F.col("market_tier") == k, 1)).alias(f"c_{k}") for k in labels])
    n_feat = len(D.CATEGORICAL_FEATURES) + len(D.NUMERIC_FEATURES)
    rows = [("data", "total samples", "CAST(n AS DOUBLE)"), ("data", "features", f"{float(n_feat)}D"),
            ("data", "categorical features", f"{float(len(D.CATEGORICAL_FEATURES))}D"),
            ("data", "numerical features", f"{float(len(D.NUMERIC_FEATURES))}D"),
            ("price", "mean", "mean"), ("price", "median", "median"), ("price", "std", "std"),
            ("price", "min", "min"), ("price", "max", "max")]
    for k, label in labels.items():
        rows += [("market_tier", f"{label} count", f"CAST(c_{k} AS DOUBLE)"),
                 ("market_tier", f"{label} pct", f"c_{k} / n * 100.0D")]
    stack = "stack({}, {})".format(len(rows), ", ".join(f"'{a}', '{b}', {e}" for a, b, e in rows))
    return round_doubles(one.select(F.expr(stack).alias("section", "metric", "value")), DIGITS)


@register("tier_counts", lambda: S.with_base(
    "SELECT market_tier, count(*) AS n_rows FROM training WHERE market_tier IS NOT NULL GROUP BY market_tier"))
def tier_counts(spark, sf_dir):
    """Frequency of each market tier, descending."""
    return R.value_counts(_training(spark, sf_dir), "market_tier")


@register("condition_counts", lambda: S.with_base(
    "SELECT condition, count(*) AS n_rows FROM training WHERE condition IS NOT NULL GROUP BY condition"))
def condition_counts(spark, sf_dir):
    """Frequency of each (cleaned) condition, descending."""
    return R.value_counts(_training(spark, sf_dir), "condition")


@register("tier_share", lambda: S.with_base(f"""
SELECT market_tier, count(*) AS n_rows, {rd('count(*) / (SELECT count(*) FROM training) * 100.0E0')} AS share_pct
FROM training WHERE market_tier IS NOT NULL GROUP BY market_tier"""))
def tier_share(spark, sf_dir):
    """Count and percentage of all rows per market tier."""
    return round_doubles(R.share_of_total(_training(spark, sf_dir), "market_tier"), DIGITS)


@register("subtype_summary", lambda: S.with_base(f"""
SELECT sub_type, {S.r_even('avg(price_per_kg)', 1)} AS mean, {S.r_even('min(price_per_kg)', 1)} AS min,
  {S.r_even('max(price_per_kg)', 1)} AS max
FROM training WHERE sub_type IS NOT NULL GROUP BY sub_type"""))
def subtype_summary(spark, sf_dir):
    """Mean, min, max price by sub-type, one decimal."""
    return R.summary_by(_training(spark, sf_dir), "sub_type")


def _bins_sql(bins, prefix: str) -> str:
    vals = ", ".join(f"({i}, {S.num(lo)}, {S.num(hi)}, {S.lit(label)})" for i, (lo, hi, label) in enumerate(bins))
    return f"(VALUES {vals}) {prefix}(bin_index, lo, hi, label)"


def _weight_bin_sql() -> str:
    return f"""wb AS (
  SELECT b.bin_index, b.label AS bin_label, count(t.price_per_kg) AS n_rows, avg(t.price_per_kg) AS mean_value,
    stddev_samp(t.price_per_kg) AS std_value
  FROM {_bins_sql(D.WEIGHT_BINS, 'b')} LEFT JOIN training t ON t.weight_kg > b.lo AND t.weight_kg <= b.hi
  GROUP BY b.bin_index, b.label)"""


@register("price_by_weight_bin", lambda: S.with_base(
    f"SELECT CAST(bin_index AS INTEGER) AS bin_index, bin_label, n_rows, {rd('mean_value')} AS mean_value, "
    f"{rd('std_value')} AS std_value FROM wb", _weight_bin_sql()))
def price_by_weight_bin(spark, sf_dir):
    """Price mean and std per right-closed weight bin (0,5] .. (500,1000]; empty bins kept."""
    return round_doubles(R.binned_stats(_training(spark, sf_dir), "weight_kg", D.WEIGHT_BINS), DIGITS)


@register("bin_discount", lambda: S.with_base(f"""
SELECT CAST(bin_index AS INTEGER) AS bin_index, bin_label, {rd('mean_value')} AS mean_value,
  {rd('(first_value(mean_value) OVER (ORDER BY bin_index) - mean_value) / first_value(mean_value) OVER (ORDER BY bin_index) * 100.0E0')} AS discount_pct
FROM wb""", _weight_bin_sql()))
def bin_discount(spark, sf_dir):
    """Discount % of each weight bin's mean price against the first bin."""
    stats = R.binned_stats(_training(spark, sf_dir), "weight_kg", D.WEIGHT_BINS)
    return round_doubles(R.discount_vs_first(stats), DIGITS)


CONDS = sorted(D.VALID_CONDITIONS)


@register("pivot_type_condition", lambda: S.with_base(f"""
SELECT o.waste_type, CAST(o.row_order AS INTEGER) AS row_order,
  {', '.join(f"{rd(f'coalesce(avg(t.price_per_kg) FILTER (WHERE t.condition = {S.lit(c)}), 0.0E0)')} AS {c}" for c in CONDS)}
FROM (VALUES {', '.join(f"({S.lit(w)}, {i})" for i, w in enumerate(D.PIVOT_WASTE_TYPES))}) o(waste_type, row_order)
LEFT JOIN training t ON t.waste_type = o.waste_type AND t.condition IS NOT NULL
GROUP BY o.waste_type, o.row_order"""))
def pivot_type_condition(spark, sf_dir):
    """Mean price waste type x condition for plastic, metal, paper, glass, e_waste; gaps 0."""
    return round_doubles(R.pivot_type_condition(_training(spark, sf_dir)), DIGITS)


@register("pivot_cp_condition", lambda: S.with_base(f"""
SELECT collection_point,
  {', '.join(f"{rd(f'avg(price_per_kg) FILTER (WHERE condition = {S.lit(c)})')} AS {c}" for c in CONDS)}
FROM training WHERE collection_point IS NOT NULL AND condition IS NOT NULL GROUP BY collection_point"""))
def pivot_cp_condition(spark, sf_dir):
    """Pivot collection point x condition of the mean price; gaps stay NULL."""
    return round_doubles(R.pivot_mean(_training(spark, sf_dir), "collection_point", "condition", CONDS), DIGITS)


TIERS = ["formal", "informal", "semi_formal"]


@register("crosstab_county_tier", lambda: S.with_base(f"""
SELECT county, {', '.join(f"{rd(f'count(*) FILTER (WHERE market_tier = {S.lit(t)}) / count(*) * 100.0E0')} AS {t}" for t in TIERS)}
FROM training WHERE county IS NOT NULL AND market_tier IS NOT NULL GROUP BY county"""))
def crosstab_county_tier(spark, sf_dir):
    """County x market tier as row percentages, gaps 0."""
    return round_doubles(R.crosstab_row_pct(_training(spark, sf_dir), "county", "market_tier", TIERS), DIGITS)


@register("price_by_county", lambda: S.with_base(f"""
SELECT county, count(price_per_kg) AS n_rows, {rd('avg(price_per_kg)')} AS mean_price
FROM training WHERE county IS NOT NULL GROUP BY county"""))
def price_by_county(spark, sf_dir):
    """Mean price by county, descending."""
    return round_doubles(R.mean_by(_training(spark, sf_dir), ["county"]).orderBy(F.desc("mean_price")), DIGITS)


@register("price_by_collection_point", lambda: S.with_base(f"""
SELECT collection_point, count(price_per_kg) AS n_rows, {rd('avg(price_per_kg)')} AS mean_price,
  {rd('stddev_samp(price_per_kg)')} AS std_price
FROM training WHERE collection_point IS NOT NULL GROUP BY collection_point"""))
def price_by_collection_point(spark, sf_dir):
    """Mean and std of the price by collection point, mean descending."""
    return round_doubles(R.mean_std_by(_training(spark, sf_dir), "collection_point"), DIGITS)


@register("price_by_month", lambda: S.with_base(f"""
SELECT month, count(price_per_kg) AS n_rows, {rd('avg(price_per_kg)')} AS mean_price
FROM training WHERE month IS NOT NULL GROUP BY month"""))
def price_by_month(spark, sf_dir):
    """Mean price by month."""
    return round_doubles(R.mean_by(_training(spark, sf_dir), ["month"]).orderBy("month"), DIGITS)


@register("peak_month", lambda: S.with_base(f"""
SELECT CAST((SELECT month FROM m ORDER BY mean_price DESC, month LIMIT 1) AS INTEGER) AS peak_month,
  {rd('max(mean_price)')} AS max_mean, {rd('min(mean_price)')} AS min_mean FROM m""",
    "m AS (SELECT month, avg(price_per_kg) AS mean_price FROM training WHERE month IS NOT NULL GROUP BY month)"))
def peak_month(spark, sf_dir):
    """Month with the highest mean price (first month on ties), highest and lowest monthly mean."""
    return round_doubles(R.peak(R.mean_by(_training(spark, sf_dir), ["month"]), "month"), DIGITS)


@register("top_materials", lambda: S.with_base(f"""
SELECT waste_type, sub_type, n_rows, {rd('mean_price')} AS mean_price FROM (
  SELECT waste_type, sub_type, count(price_per_kg) AS n_rows, avg(price_per_kg) AS mean_price
  FROM training WHERE waste_type IS NOT NULL AND sub_type IS NOT NULL GROUP BY waste_type, sub_type)
ORDER BY mean_price DESC, waste_type, sub_type LIMIT 10"""))
def top_materials(spark, sf_dir):
    """The 10 (waste type, sub-type) pairs with the highest mean price."""
    means = R.mean_by(_training(spark, sf_dir), ["waste_type", "sub_type"])
    return round_doubles(R.top_k(means, 10, [F.desc("mean_price"), F.asc("waste_type"), F.asc("sub_type")]), DIGITS)


@register("top_types_by_condition", lambda: S.with_base(f"""
SELECT waste_type, {', '.join(f'{rd(c)} AS {c}' for c in CONDS)}, {rd('mean_of_means')} AS mean_of_means FROM (
  SELECT waste_type, {', '.join(f'avg(price_per_kg) FILTER (WHERE condition = {S.lit(c)}) AS {c}' for c in CONDS)}
  FROM training WHERE waste_type IS NOT NULL AND condition IS NOT NULL GROUP BY waste_type)
  , LATERAL (SELECT ({' + '.join(f'coalesce({c}, 0.0E0)' for c in CONDS)}) /
      ({' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)' for c in CONDS)}) AS mean_of_means)
ORDER BY mean_of_means DESC, waste_type LIMIT 6"""))
def top_types_by_condition(spark, sf_dir):
    """Condition pivot for the 6 waste types with the highest unweighted mean of condition means."""
    return round_doubles(R.top_types_by_condition(_training(spark, sf_dir)), DIGITS)


def _hist_sql(src: str, x: str) -> str:
    n = D.HISTOGRAM_BINS
    return f"""h AS (SELECT {x} AS _x FROM {src} WHERE {x} IS NOT NULL),
hb AS (SELECT min(_x) AS lo, max(_x) AS hi FROM h),
hc AS (SELECT CASE WHEN hb.hi = hb.lo THEN 0 ELSE CAST(least(floor((h._x - hb.lo) / (hb.hi - hb.lo) * {S.num(n)}), {n - 1}) AS INTEGER) END AS bin_index,
  count(*) AS n_rows FROM h, hb GROUP BY 1),
hist AS (SELECT CAST(r.i AS INTEGER) AS bin_index, {rd(f'hb.lo + r.i * ((hb.hi - hb.lo) / {S.num(n)})')} AS bin_lo,
  {rd(f'hb.lo + (r.i + 1) * ((hb.hi - hb.lo) / {S.num(n)})')} AS bin_hi, CAST(coalesce(hc.n_rows, 0) AS BIGINT) AS n_rows
  FROM range({n}) r(i) CROSS JOIN hb LEFT JOIN hc ON hc.bin_index = r.i)"""


@register("price_histogram", lambda: S.with_base("SELECT * FROM hist", _hist_sql("training", "price_per_kg")))
def price_histogram(spark, sf_dir):
    """50-bin equal-width histogram of the price per kg (last bin closed on the right)."""
    return round_doubles(R.histogram(_training(spark, sf_dir), "price_per_kg"), DIGITS)


@register("price_volume_trend", lambda: S.with_base(f"""
SELECT count(price_per_kg) AS n_rows, {rd('regr_slope(price_per_kg, ln(1 + weight_kg))')} AS slope,
  {rd('regr_intercept(price_per_kg, ln(1 + weight_kg))')} AS intercept FROM training"""))
def price_volume_trend(spark, sf_dir):
    """Least-squares line price ~ log1p(weight) over the whole table."""
    return round_doubles(R.trend_line(_training(spark, sf_dir)), DIGITS)


@register("trend_points", lambda: S.with_base(f"""
SELECT CAST(r.i AS INTEGER) AS point, {rd(f'pow(10.0E0, r.i * {S.num(3.0 / (D.TREND_POINTS - 1))})')} AS weight_kg,
  {rd(f'c.slope * ln(1 + pow(10.0E0, r.i * {S.num(3.0 / (D.TREND_POINTS - 1))})) + c.intercept')} AS price_per_kg
FROM range({D.TREND_POINTS}) r(i) CROSS JOIN (
  SELECT regr_slope(price_per_kg, ln(1 + weight_kg)) AS slope, regr_intercept(price_per_kg, ln(1 + weight_kg)) AS intercept
  FROM training) c"""))
def trend_points(spark, sf_dir):
    """The fitted price/volume line evaluated at 100 log-spaced weights from 1 to 1000 kg."""
    return round_doubles(R.trend_points(_training(spark, sf_dir)), DIGITS)


@register("subtypes_by_type", lambda: S.with_base("""
SELECT waste_type, string_agg(sub_type, ',' ORDER BY sub_type) AS values_text, count(*) AS n_values
FROM (SELECT DISTINCT waste_type, sub_type FROM training WHERE waste_type IS NOT NULL AND sub_type IS NOT NULL)
GROUP BY waste_type"""))
def subtypes_by_type(spark, sf_dir):
    """Distinct sub-types per waste type as a sorted list."""
    out = R.distinct_sorted_list(_training(spark, sf_dir), "waste_type", "sub_type")
    return out.select("waste_type", "values_text", F.col("n_values").cast("bigint").alias("n_values"))


def _revenue_spark(spark, sf_dir):
    t = _training(spark, sf_dir)
    rev = (t.filter(F.col("waste_type").isNotNull() & F.col("sub_type").isNotNull())
           .groupBy("waste_type", "sub_type").agg(F.sum(F.col("price_per_kg") * F.col("weight_kg")).alias("revenue")))
    # round the group sums before ranking so both engines rank identical values
    rev = rev.withColumn("revenue", round_even("revenue", 4))
    return R.ranked_cumulative_share(rev, ["waste_type", "sub_type"], "revenue")


REVENUE_SQL = f"""rev AS (SELECT waste_type, sub_type, {S.r_even('sum(price_per_kg * weight_kg)', 4)} AS revenue
  FROM training WHERE waste_type IS NOT NULL AND sub_type IS NOT NULL GROUP BY waste_type, sub_type),
shared AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, waste_type, sub_type) AS rank,
  revenue / sum(revenue) OVER () AS share FROM rev),
ranked AS (SELECT *, sum(share) OVER (ORDER BY revenue DESC, waste_type, sub_type
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_share FROM shared)"""


@register("cumulative_share", lambda: S.with_base(
    f"SELECT waste_type, sub_type, {rd('revenue')} AS revenue, CAST(rank AS INTEGER) AS rank, {rd('share')} AS share, "
    f"{rd('cum_share')} AS cum_share FROM ranked", REVENUE_SQL))
def cumulative_share(spark, sf_dir):
    """H3: materials ranked by revenue (price x weight) with share and running share of the total."""
    return round_doubles(_revenue_spark(spark, sf_dir), DIGITS)


@register("items_to_80pct", lambda: S.with_base(
    "SELECT CAST(min(rank) AS INTEGER) AS n_items FROM ranked WHERE cum_share >= 0.8E0", REVENUE_SQL))
def items_to_80pct(spark, sf_dir):
    """H4: number of top materials needed to reach 80 % of revenue."""
    return R.items_to_reach(_revenue_spark(spark, sf_dir), 0.8)


@register("conditional_quantiles", lambda: S.with_base(f"""
SELECT waste_type, sub_type, condition, count(*) AS n_rows,
  {rd('quantile_cont(price_per_kg, 0.05)')} AS q05, {rd('quantile_cont(price_per_kg, 0.5)')} AS q50,
  {rd('quantile_cont(price_per_kg, 0.95)')} AS q95
FROM training WHERE waste_type IS NOT NULL AND sub_type IS NOT NULL AND condition IS NOT NULL
GROUP BY waste_type, sub_type, condition"""))
def conditional_quantiles(spark, sf_dir):
    """Conditional 5/50/95 % price quantiles per (waste type, sub-type, condition): the simple range model."""
    from baleprice.operators import train as T
    return round_doubles(T.fit_conditional_quantiles(_training(spark, sf_dir)), DIGITS)


# ------------------------------------------------------------------------------------------------------
# 2.8 / 2.9 evaluation of predictions (rule predictor: SQL-checkable)
# ------------------------------------------------------------------------------------------------------
def _metrics_sql(src: str) -> str:
    e = "(price_per_kg - pred_mid)"
    return f"""SELECT count(*) AS n_rows, {rd(f'avg(abs({e}))')} AS mae, {rd(f'sqrt(avg({e} * {e}))')} AS rmse,
  {rd(f'1.0E0 - sum({e} * {e}) / (count(price_per_kg) * var_pop(price_per_kg))')} AS r2,
  {rd(f'100.0E0 * avg(abs({e}) / (CASE WHEN abs(price_per_kg) = 0 THEN NULL ELSE abs(price_per_kg) END))')} AS mape_pct,
  {rd(f'avg({e})')} AS mean_error
FROM {src} WHERE price_per_kg IS NOT NULL AND pred_mid IS NOT NULL"""


@register("eval_metrics", lambda: S.with_base(_metrics_sql("tp"), _train_pred_cte()))
def eval_metrics(spark, sf_dir):
    """MAE, RMSE, R2, MAPE and mean error of the mid prediction over every labelled row."""
    return round_doubles(E.regression_metrics(_training_predicted(spark, sf_dir)), DIGITS)


def _pin(y: str, p: str, q: float) -> str:
    return f"(CASE WHEN {y} - {p} >= 0 THEN {S.num(q)} * ({y} - {p}) ELSE {S.num(q - 1.0)} * ({y} - {p}) END)"


def _interval_sql(src: str) -> str:
    return f"""SELECT count(*) AS n_rows,
  {rd('avg(CASE WHEN price_per_kg >= pred_lower AND price_per_kg <= pred_upper THEN 1.0E0 ELSE 0.0E0 END)')} AS coverage,
  {rd('avg(pred_upper - pred_lower)')} AS mean_width,
  {rd(f"avg({_pin('price_per_kg', 'pred_lower', D.QUANTILES['lower'])})")} AS pinball_lower,
  {rd(f"avg({_pin('price_per_kg', 'pred_mid', D.QUANTILES['mid'])})")} AS pinball_mid,
  {rd(f"avg({_pin('price_per_kg', 'pred_upper', D.QUANTILES['upper'])})")} AS pinball_upper,
  {rd('avg(CASE WHEN price_per_kg < pred_lower THEN 1.0E0 ELSE 0.0E0 END)')} AS share_below_lower,
  {rd('avg(CASE WHEN price_per_kg > pred_upper THEN 1.0E0 ELSE 0.0E0 END)')} AS share_above_upper
FROM {src} WHERE price_per_kg IS NOT NULL"""


@register("interval_metrics", lambda: S.with_base(_interval_sql("tp"), _train_pred_cte()))
def interval_metrics(spark, sf_dir):
    """Interval coverage (inclusive), mean width and pinball loss of each bound."""
    return round_doubles(E.interval_metrics(_training_predicted(spark, sf_dir)), DIGITS)


@register("error_histogram", lambda: S.with_base(
    "SELECT * FROM hist", _train_pred_cte() + ",\n" + _hist_sql("tp", "(price_per_kg - pred_mid)")))
def error_histogram(spark, sf_dir):
    """50-bin histogram of the signed error actual - mid prediction."""
    return round_doubles(E.error_histogram(_training_predicted(spark, sf_dir)), DIGITS)


@register("error_by_price_bin", lambda: S.with_base(f"""
SELECT CAST(b.bin_index AS INTEGER) AS price_bin_index, b.label AS price_bin_label, count(t.price_per_kg) AS n_rows,
  {rd('avg(abs(t.price_per_kg - t.pred_mid))')} AS mae
FROM {_bins_sql(D.PRICE_ERROR_BINS, 'b')} LEFT JOIN tp t ON t.price_per_kg > b.lo AND t.price_per_kg <= b.hi
GROUP BY b.bin_index, b.label""", _train_pred_cte()))
def error_by_price_bin(spark, sf_dir):
    """MAE by actual-price bin; prices above 500 are left out."""
    return round_doubles(E.error_by_price_bin(_training_predicted(spark, sf_dir)), DIGITS)


LOW_COLS = ["price_per_kg", "pred_lower", "pred_mid", "pred_upper"]


@register("lowest_200", lambda: S.with_base(f"""
SELECT {S.KEY}, price_per_kg, {rd('pred_lower')} AS pred_lower, {rd('pred_mid')} AS pred_mid, {rd('pred_upper')} AS pred_upper
FROM tp ORDER BY price_per_kg, {S.KEY} LIMIT 200""", _train_pred_cte()))
def lowest_200(spark, sf_dir):
    """H5: the 200 lowest actual prices with their predicted range (ties broken by the row key)."""
    t = _training_predicted(spark, sf_dir).select(*KEY, *LOW_COLS)
    return round_doubles(R.top_k(t, 200, [F.asc("price_per_kg")] + [F.asc(k) for k in KEY]), DIGITS)


def _ordinal_sql() -> str:
    joins, cols = [], []
    for i, c in enumerate(D.CATEGORICAL_FEATURES):
        joins.append(f"""LEFT JOIN (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM training WHERE {c} IS NOT NULL)) o{i} ON o{i}.value = t.{c}""")
        cols.append(f"coalesce(o{i}.code, -1) AS {c}_code")
    keys = ", ".join(f"t.{k}" for k in KEY)
    return S.with_base(f"SELECT {keys}, {', '.join(cols)} FROM training t " + "\n".join(joins))


@register("ordinal_encode", _ordinal_sql)
def ordinal_encode(spark, sf_dir):
    """Ordinal codes of the six categorical features (sorted categories, unknown -> -1)."""
    from baleprice.operators import train as T
    t = training_table(spark, sf_dir)
    model = T.fit_ordinal(t, D.CATEGORICAL_FEATURES)
    out = T.apply_ordinal(t, model)
    return out.select(*KEY, *[f"{c}_code" for c in D.CATEGORICAL_FEATURES])


def _scale_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in D.NUMERIC_FEATURES)
    cols = ", ".join(
        f"{rd(f'(f.{c} - s.m_{c}) / (CASE WHEN s.s_{c} IS NULL OR s.s_{c} = 0 THEN 1.0E0 ELSE s.s_{c} END)')} AS {c}_scaled"
        for c in D.NUMERIC_FEATURES)
    keys = ", ".join(f"f.{k}" for k in KEY)
    return S.with_base(f"SELECT {keys}, {cols} FROM feat f CROSS JOIN (SELECT {stats} FROM feat) s",
                       f"feat AS ({_v2_feature_sql()})")


@register("standard_scale", _scale_sql)
def standard_scale(spark, sf_dir):
    """Standard scaling (population std) of the nine numeric v2 features, fitted on the table."""
    from baleprice.operators import train as T
    feat = FE.v2_features(training_table(spark, sf_dir))
    model = T.fit_scaler(feat, D.NUMERIC_FEATURES)
    return round_doubles(model.transform(feat).select(*KEY, *[f"{c}_scaled" for c in D.NUMERIC_FEATURES]), DIGITS)


LIVE_COLS = ["lower_bound", "recommended", "upper_bound", "range_width", "market_tier", "tier_score", "market_signal"]


def _live_model_ctes() -> str:
    """The conditional quantiles of the training side, and (``{src}`` -> predictions) as ``_live_pred``."""
    qs = ", ".join(f"{rd(f'quantile_cont(price_per_kg, {q})')} AS {n}"
                   for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)))
    keys = "waste_type, sub_type, condition"
    return f"""split AS (SELECT *, {S.is_test()} AS is_test FROM training),
qg AS (SELECT {keys}, {qs} FROM split WHERE NOT is_test AND waste_type IS NOT NULL AND sub_type IS NOT NULL
  AND condition IS NOT NULL GROUP BY {keys}),
qw AS (SELECT waste_type, {qs} FROM split WHERE NOT is_test AND waste_type IS NOT NULL GROUP BY waste_type)"""


def _live_pred(src: str) -> str:
    return f"""SELECT x.*, coalesce(g.q05, w.q05) AS pred_lower, coalesce(g.q50, w.q50) AS pred_mid,
  coalesce(g.q95, w.q95) AS pred_upper FROM {src} x
  LEFT JOIN qg g ON g.waste_type = x.waste_type AND g.sub_type = x.sub_type AND g.condition = x.condition
  LEFT JOIN qw w ON w.waste_type = x.waste_type"""


def _score_live_sql() -> str:
    cols = ", ".join(f"CASE WHEN v.n_errors = 0 THEN p.{c} END AS {c}" for c in LIVE_COLS)
    keys = ", ".join(f"v.{k}" for k in KEY)
    return S.with_base(f"""SELECT {keys}, v.n_errors = 0 AS is_valid, {cols}
FROM validated v LEFT JOIN lv p USING ({S.KEY}) WHERE {S.is_test('v')}""", f"""{_validated_sql()},
{_live_model_ctes()},
lc AS ({S.clean_select('v2')}),
lt AS ({S.tier_select('live', 'lc')}),
lp AS ({_live_pred('lt')}),
lv AS ({S.postprocess_select('v2', 'lp')})""")


def _live_model(spark, sf_dir):
    from baleprice.operators import train as T
    rows = T.split_train_test(training_table(spark, sf_dir), KEY)
    return T.fit_quantile_tables(rows.filter(~F.col("is_test"))), rows.filter(F.col("is_test"))


@register("score_live", _score_live_sql)
def score_live(spark, sf_dir):
    """hold-out requests through the live chain (validate, clean, live tier, predict, post-process) with
    conditional quantiles fitted on the training side; rejected requests carry no price."""
    from baleprice.operators.train import split_train_test
    from baleprice.plans.serve import price_listings
    model, _ = _live_model(spark, sf_dir)
    requests = split_train_test(raw_listings(spark, sf_dir), KEY).filter(F.col("is_test"))
    priced = price_listings(requests, bundle=model, keep=KEY)
    inside = {"lower_bound": "price_range", "recommended": "price_range", "upper_bound": "price_range"}
    return priced.select(*KEY, "is_valid", *[
        F.col(f"response.{inside.get(c, 'market_info')}.{c}").alias(c) for c in LIVE_COLS])


@register("score_live_metrics", lambda: S.with_base(
    _interval_sql("lm"), f"{_live_model_ctes()},\nlm AS ({_live_pred('(SELECT * FROM split WHERE is_test)')})"))
def score_live_metrics(spark, sf_dir):
    """Coverage, width and pinball losses, on the labelled hold-out rows, of the model that ``score_live``
    serves (its predictions before the live multipliers)."""
    model, test = _live_model(spark, sf_dir)
    return round_doubles(E.interval_metrics(model.score(test)), DIGITS)


# ------------------------------------------------------------------------------------------------------
# 2.9 trained models (random split, boosted trees): rows-only checks
# ------------------------------------------------------------------------------------------------------
#: The last bundle trained, with the application, the path and the digest of the rows that it was trained on.
_LAST: list = []


def _split_features(spark, sf_dir):
    from baleprice.operators import train as T
    t = T.split_train_test(training_table(spark, sf_dir), KEY)
    return FE.v2_features(t, drop_inputs=False)


def _bundle(spark, sf_dir):
    """The range models of the training side. Every call reads the tables and digests the training rows (one aggregate);
    models are trained unless the last ones were trained on these very rows."""
    from baleprice.operators import train as T
    train = _split_features(spark, sf_dir).filter(~F.col("is_test")).select(*KEY, "price_per_kg", *T.FEATURES)
    digest = train.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*train.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *digest)
    if not _LAST or _LAST[0] != key:
        _LAST[:] = [key, T.train_range_bundle(train, KEY)]
    return _LAST[1]


def _scored_test(spark, sf_dir, bundle=None):
    bundle = bundle or _bundle(spark, sf_dir)
    test = _split_features(spark, sf_dir).filter(F.col("is_test"))
    return bundle.score(test)


def _performance(scored):
    """Hold-out figures of the trained models as (n_rows, metric, value)."""
    wide = scored.filter(F.col("price_per_kg").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"), *E.regression_aggs(), *E.interval_aggs())
    cols = [c for c in wide.columns if c != "n_rows"]
    stack = "stack({}, {})".format(len(cols), ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols))
    return wide.select("n_rows", F.expr(stack).alias("metric", "value"))


def _ranked_importances(spark, bundle):
    from baleprice.operators import train as T
    imp = bundle.models["mid"].feature_importances()
    df = D.local_frame(spark, list(zip(T.FEATURES, imp)), "feature string, importance double")
    return R.ranked_cumulative_share(df, ["feature"], "importance")  # 15 rows, one per feature


def _by_family(imp):
    fam = D.feature_family_dim(imp.sparkSession)
    return (imp.join(F.broadcast(fam), "feature", "left")
            .withColumn("family", F.coalesce("family", F.lit("other")))
            .groupBy("family").agg(F.sum("importance").alias("importance"))
            .orderBy(F.desc("importance")))


@register("train_test_counts", lambda: S.with_base(
    f"SELECT {S.is_test()} AS is_test, count(*) AS n_rows FROM training GROUP BY 1"))
def train_test_counts(spark, sf_dir):
    """Rows per side of the seeded 85/15 hash split."""
    from baleprice.operators import train as T
    t = T.split_train_test(training_table(spark, sf_dir), KEY)
    return t.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"))


@register("score_range")
def score_range(spark, sf_dir):
    """Three boosted quantile models (q = .05/.50/.95; 1000 trees each, rate .03) trained on the 85 % split,
    scored on the hold-out rows and post-processed into price ranges (v2 rules)."""
    scored = _scored_test(spark, sf_dir)
    post = SC.postprocess_range(scored, "v2")
    return post.select(*KEY, "price_per_kg", "pred_lower", "pred_mid", "pred_upper", "lower_bound", "recommended",
                       "upper_bound", "range_width", "market_signal")


@register("model_metrics")
def model_metrics(spark, sf_dir):
    """I6-I11 on the trained models: hold-out MAE, RMSE, R2, MAPE, coverage, width, pinball losses."""
    return _performance(_scored_test(spark, sf_dir))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Split-gain importances of the mid model averaged over boosting rounds, ranked, with their share and
    running share of the total."""
    return _ranked_importances(spark, _bundle(spark, sf_dir))


@register("features_to_80pct")
def features_to_80pct(spark, sf_dir):
    """H4: number of the mid model's features whose importances reach 80 % of the total."""
    return R.items_to_reach(feature_importance(spark, sf_dir), 0.8)


@register("importance_by_family")
def importance_by_family(spark, sf_dir):
    """I16: importances summed by feature family; features in no family (market_tier) go to 'other'."""
    return _by_family(feature_importance(spark, sf_dir))


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Permutation importance of the mid model on the hold-out rows (5 repeats, seed 42, R2 drop)."""
    from baleprice.operators import train as T
    test = _split_features(spark, sf_dir).filter(F.col("is_test"))
    return T.permutation_importance(_bundle(spark, sf_dir), test, KEY, n_repeats=5, seed=42)


@register("stratified_sample", lambda: S.with_base(f"""
SELECT * FROM (SELECT {S.KEY}, condition, weight_kg, price_per_kg,
  CAST(row_number() OVER (PARTITION BY condition ORDER BY {S.digest(42)}, {S.KEY}) AS INTEGER) AS sample_rank
  FROM training) WHERE sample_rank <= 500"""))
def stratified_sample(spark, sf_dir):
    """H6: min(500, n) rows per condition drawn by a seeded hash (two-phase, skew-safe)."""
    t = training_table(spark, sf_dir)
    return R.sample_per_group(t, "condition", 500, KEY, seed=42).select(
        *KEY, "condition", "weight_kg", "price_per_kg", "sample_rank")


@register("cv_metrics")
def cv_metrics(spark, sf_dir):
    """3-fold cross-validation of the mid model: per-fold MAE and R2 (hash folds), with the
    summary the reference reports (CV MAE mean +- std, CV R2) on every row."""
    from pyspark.sql import Window
    from baleprice.operators import train as T
    feats = FE.v2_features(training_table(spark, sf_dir), drop_inputs=False)
    folds = T.cross_validate_mid(feats, KEY, folds=3, rounds=6)
    w = Window.partitionBy()  # over the k fold rows only
    return folds.withColumns({"cv_mae": F.avg("mae").over(w), "cv_mae_std": F.stddev_samp("mae").over(w),
                              "cv_r2": F.avg("r2").over(w)})


@register("cv_comparison")
def cv_comparison(spark, sf_dir):
    """3-fold cross-validation of all four models on the same folds: CV MAE, its deviation, CV R2."""
    from baleprice.operators import train as T
    feats = FE.v2_features(training_table(spark, sf_dir), drop_inputs=False)
    return T.cv_by_model(T.cross_validate_models(feats, KEY, folds=3))


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Ridge, random forest, gradient boosting and the quantile booster on the same split."""
    from baleprice.operators import train as T
    feats = FE.v2_features(training_table(spark, sf_dir), drop_inputs=False)
    return T.compare_models(feats, KEY)


@register("sample_trend", lambda: S.with_base(f"""
SELECT count(price_per_kg) AS n_rows, {rd('regr_slope(price_per_kg, ln(1.0E0 + weight_kg))')} AS slope,
  {rd('regr_intercept(price_per_kg, ln(1.0E0 + weight_kg))')} AS intercept
FROM (SELECT * FROM training WHERE waste_type = 'plastic' AND condition = 'clean'
  ORDER BY {S.digest(42)}, {S.KEY} LIMIT 1000)"""))
def sample_trend(spark, sf_dir):
    """G17 (training variant), H6: least-squares line price ~ log1p(weight) on a 1000-row hash sample
    of the plastic / clean rows."""
    t = training_table(spark, sf_dir).filter((F.col("waste_type") == "plastic") & (F.col("condition") == "clean"))
    return round_doubles(R.trend_line(R.sample_n(t, 1000, KEY, seed=42)), DIGITS)


@register("model_report")
def model_report(spark, sf_dir):
    """The full text report as (section, metric, value) rows -- data statistics and tier mix
    (``report_stats``), hold-out model performance (``model_metrics``), the five most important
    features and the importance by feature family of the mid model. Render with
    ``io.report_lines`` + ``io.write_text``."""
    data = report_stats(spark, sf_dir)
    bundle = _bundle(spark, sf_dir)
    perf = _performance(_scored_test(spark, sf_dir, bundle)).select(
        F.lit("model performance").alias("section"), "metric", "value")
    imp = _ranked_importances(spark, bundle)
    top5 = (imp.filter(F.col("rank") <= 5)
            .select(F.lit("top features").alias("section"),
                    F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("feature")).alias("metric"),
                    (F.col("importance") * F.lit(100.0)).alias("value")))
    fam = _by_family(imp).select(
        F.lit("feature families").alias("section"), F.col("family").alias("metric"),
        (F.col("importance") * F.lit(100.0)).alias("value"))
    return round_doubles(data.unionByName(perf).unionByName(top5).unionByName(fam), DIGITS)
