"""Rule-based pricing: tiers, step multipliers, expected prices, fallback price, factors.

Each operator is one projection (narrow, codegen'd). Floating-point operations keep the reference's
order (products left to right, the live tier's detour through ``.78 + .22 * cs``) so thresholds land
on the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numeric import clip01, col_of, map_get, round_even, round_js, round_py, step_value
from baleprice.operators import lookups as L

_COND_SCORE = {"clean": 1.0, "mixed": 0.5, "contaminated": 0.0}


def tier_label(score) -> Column:
    """Formal >= .70, semi_formal >= .35, else informal (NULL score -> NULL). Written as an index
    into the three labels so the score is referenced twice only."""
    s = col_of(score)
    hi, lo = D.TIER_THRESHOLDS
    idx = F.lit(1) + (s >= F.lit(lo)).cast("int") + (s >= F.lit(hi)).cast("int")
    return F.element_at(F.array(F.lit("informal"), F.lit("semi_formal"), F.lit("formal")), idx)


def _tier_mult(discount: Column, score: Column) -> Column:
    return discount + score * (F.lit(1.0) - discount)


def _finish_tier(df: DataFrame, waste_type, label_on_rounded: bool) -> DataFrame:
    """Multiplier d + score (1 - d) and both values rounded to 4 decimals (Python rule). The unrounded
    values are separate columns first, so the exact rounding references a column, not a re-inlined
    expression."""
    d = L.informal_discount(waste_type)
    work = df.withColumn("_tier_mult", _tier_mult(d, F.col("_tier_score")))
    work = work.withColumns({"tier_multiplier": round_py("_tier_mult", 4), "tier_score": round_py("_tier_score", 4)})
    work = work.withColumn("market_tier", tier_label("tier_score" if label_on_rounded else "_tier_score"))
    return work.drop("_tier_score", "_tier_mult")


def tier_live(df: DataFrame, weight="weight_kg", condition="condition", waste_type="waste_type") -> DataFrame:
    """E1 (v2): weight score 1 at 0 kg falling to 0 at 200 kg, condition score via .78 + .22 cs;
    label tested on the unrounded score; multiplier and score rounded to 4 decimals."""
    ws = clip01(F.lit(1.0) - col_of(weight) / F.lit(200.0))
    cs = F.lit(0.78) + map_get(_COND_SCORE, condition, 0.5) * F.lit(0.22)
    score = clip01(F.lit(0.5) * ws + F.lit(0.5) * ((cs - F.lit(0.78)) / F.lit(0.22)))
    return _finish_tier(df.withColumn("_tier_score", score), waste_type, label_on_rounded=False)


def tier_old(df: DataFrame, weight="weight_kg", condition="condition", waste_type="waste_type") -> DataFrame:
    """E2 (v2old): weight score rises from 5 kg to 100 kg; score = .55 ws + .45 cs (no clip)."""
    ws = clip01((col_of(weight) - F.lit(5.0)) / F.lit(95.0))
    score = F.lit(0.55) * ws + F.lit(0.45) * map_get(_COND_SCORE, condition, 0.5)
    return _finish_tier(df.withColumn("_tier_score", score), waste_type, label_on_rounded=False)


def tier_train(df: DataFrame, condition="condition", waste_type="waste_type") -> DataFrame:
    """E3 (train): score from the condition factor only; weight is ignored. The label is taken on the
    rounded score, as the training script does."""
    score = clip01((L.condition_factor(condition) - F.lit(0.78)) / F.lit(0.22))
    return _finish_tier(df.withColumn("_tier_score", score), waste_type, label_on_rounded=True)


def volume_multiplier(weight="weight_kg") -> Column:
    """E5: right-closed volume steps."""
    return step_value(weight, D.VOLUME_STEPS, D.VOLUME_STEP_ELSE)


def distance_multiplier(distance="distance_km") -> Column:
    """Right-closed distance steps."""
    return step_value(distance, D.DISTANCE_STEPS, D.DISTANCE_STEP_ELSE)


def with_step_multipliers(df: DataFrame) -> DataFrame:
    return df.withColumns({"volume_multiplier": volume_multiplier(), "distance_multiplier": distance_multiplier()})


def with_train_tier_multiplier(df: DataFrame, out_col: str, condition="condition",
                               waste_type="waste_type") -> DataFrame:
    """E3 multiplier (rounded to 4 decimals, as the training labels use it) as a new column."""
    score = clip01((L.condition_factor(condition) - F.lit(0.78)) / F.lit(0.22))
    raw = f"{out_col}_raw"
    return (df.withColumn(raw, _tier_mult(L.informal_discount(waste_type), score))
            .withColumn(out_col, round_py(raw, 4)).drop(raw))


def expected_price_v2(df: DataFrame, tier_multiplier: str | None = None, raw_col: str = "expected_price_raw",
                      out_col: str | None = "expected_price") -> DataFrame:
    """Base mean x condition x distance x volume x county x collection point x season x tier.

    Expects training-cleaned rows. Lookups are strict (unknown key -> NULL price). The noise of the
    reference's generator is not applied: ``raw_col`` is the noise-free price, ``out_col`` the same
    floored at 0.5 and rounded to 2 decimals. ``tier_multiplier`` names an existing E3 column; when
    absent the E3 multiplier is derived from condition and waste type."""
    work = df
    if tier_multiplier:
        tm = F.col(tier_multiplier)
    else:
        work = with_train_tier_multiplier(work, "_e7_tm")
        tm = F.col("_e7_tm")
    dim = D.base_rates_dim(df.sparkSession).select(
        "waste_type", "sub_type", F.col("base_mean").alias("_e7_base"))
    work = work.join(F.broadcast(dim), on=["waste_type", "sub_type"], how="left")
    price = (F.col("_e7_base") * L.condition_factor() * distance_multiplier() * volume_multiplier()
             * L.training_county_multiplier() * L.collection_point_multiplier(generation="train")
             * L.training_seasonal() * tm)
    work = work.withColumn(raw_col, price)
    if out_col:
        work = work.withColumn("_e7_floored", F.greatest(F.lit(0.5), F.col(raw_col))).withColumn(
            out_col, round_py("_e7_floored", 2)).drop("_e7_floored")
    return work.drop("_e7_base", "_e7_tm")


def expected_price_v1(df: DataFrame, out_col: str = "expected_price_v1", rounded: bool = True) -> DataFrame:
    """E8 (v1 generator, noise left out):
    base x season x (.85 + .3 demand) x (.7 + .6 consistency) x day - min(.12 km, .25 base) + .4 log1p(kg),
    floored at 1; day = 1.03 on weekends (Monday = 0, so day_of_week >= 5).

    The sub-type price is strict (unknown sub-type -> NULL). A missing demand index falls back to the
    seasonal value, as the v1 feature code does."""
    base = map_get(D.SUBTYPE_PRICES, "sub_type")
    seasonal = map_get(D.SEASONAL_DEMAND, "month")
    demand = F.coalesce(F.col("market_demand_index"), seasonal)
    demand_f = F.lit(0.85) + demand * F.lit(0.30)
    quality = F.lit(0.70) + F.col("consistency_score") * F.lit(0.60)
    dist_pen = F.least(F.col("distance_km") * F.lit(0.12), base * F.lit(0.25))
    wt_bonus = F.log1p("weight_kg") * F.lit(0.4)
    day_f = F.when(F.col("day_of_week") >= 5, F.lit(1.03)).otherwise(F.lit(1.0))
    price = F.greatest(base * seasonal * demand_f * quality * day_f - dist_pen + wt_bonus, F.lit(1.0))
    price = F.when(base.isNull() | seasonal.isNull(), F.lit(None).cast("double")).otherwise(price)
    return df.withColumn(out_col, round_even(price, 2) if rounded else price)


def _factors(base: Column, weight: Column, distance: Column, consistency: Column, month: Column,
             demand: Column, rnd, per_km: float, cap: float, seasonal_rounded: bool, rnd_weight=None) -> Column:
    seasonal = L.seasonal_demand(month)
    dem = F.coalesce(demand, seasonal)
    penalty = F.least(distance * F.lit(per_km), base * F.lit(cap))
    return F.struct(
        (rnd(base, 2) if seasonal_rounded else base).alias("base_price_kes"),
        (rnd_weight or rnd)(F.lit(1.0) + F.log1p(weight) * F.lit(0.02), 3).alias("weight_multiplier"),
        rnd((consistency - F.lit(0.5)) * base * F.lit(0.4), 2).alias("quality_adjustment"),
        (-F.abs(rnd(penalty, 2))).alias("distance_penalty"),
        (rnd(seasonal, 3) if seasonal_rounded else seasonal).alias("seasonality_factor"),
        rnd((dem - F.lit(0.85)) * base * F.lit(0.25), 2).alias("demand_boost"),
    )


def price_factors_v1(df: DataFrame, out_col: str = "price_factors") -> DataFrame:
    """E11 (v1): factor breakdown with base from C1 and penalty min(.15 km, .30 base); Python rounding
    (the weight multiplier is a numpy value, so it takes numpy's rule)."""
    work = df.withColumn("_pf_base", L.base_price_v1())
    f = _factors(F.col("_pf_base"), F.col("weight_kg"), F.col("distance_km"), F.col("consistency_score"),
                 F.col("month"), F.col("market_demand_index"), round_py, *D.PENALTY_V1, seasonal_rounded=True,
                 rnd_weight=round_even)
    return work.withColumn(out_col, f).drop("_pf_base")


def fallback_price(df: DataFrame, reason: str | None = None) -> DataFrame:
    """E9, E10, E12, F11, F13 (js): rule price used when no model answers.

    price = max(base x season x (.85 + .3 demand) x (.7 + .6 consistency) - min(.12 km, .25 base)
    + .4 log1p(kg), 1) with base by waste type only; JavaScript rounding (half up)."""
    base = L.waste_base_price()
    seasonal = L.seasonal_demand()
    demand = F.coalesce(F.col("market_demand_index"), seasonal)
    quality = F.lit(0.7) + F.col("consistency_score") * F.lit(0.6)
    penalty = F.least(F.col("distance_km") * F.lit(0.12), base * F.lit(0.25))
    bonus = F.log1p("weight_kg") * F.lit(0.4)
    price = F.greatest(base * seasonal * (F.lit(0.85) + demand * F.lit(0.3)) * quality - penalty + bonus,
                       F.lit(1.0))
    half = L.fallback_half_width()
    work = df.withColumn("_fb_price", price)
    p = F.col("_fb_price")
    low = F.greatest(round_js(p - half, 2), F.lit(D.FALLBACK_LOW_FLOOR))
    high = round_js(p + half, 2)
    factors = _factors(base, F.col("weight_kg"), F.col("distance_km"), F.col("consistency_score"),
                       F.col("month"), F.col("market_demand_index"), round_js, *D.PENALTY_JS,
                       seasonal_rounded=False)
    work = work.withColumns({
        "predicted_price_per_kg": round_js(p, 2),
        "total_estimated_price": round_js(p * F.col("weight_kg"), 2),
        "ci_low": low,
        "ci_high": high,
        "ci_level": F.lit(D.FALLBACK_LEVEL),
        "price_factors": factors,
        "model_version": F.lit(D.FALLBACK_MODEL_VERSION),
        "is_fallback": F.lit(True),
        "fallback_reason": F.lit(reason).cast("string"),
    })
    # "KES a – b" with two decimals
    work = work.withColumn("confidence_label", F.concat(
        F.lit("KES "), F.expr("format_number(ci_low, '0.00')"), F.lit(" – "),
        F.expr("format_number(ci_high, '0.00')")))
    return work.drop("_fb_price")
