"""Lookups of the fixed price tables.

Every lookup is many-to-one against a fixed table of at most 31 rows:

* single-key tables of at most 12 keys are literal MAP columns (``try_element_at`` + ``coalesce``):
  no join, no exchange, stays inside whole-stage codegen;
* the composite-key table (waste_type, sub_type) and the weight-band range match are joins against a
  dimension DataFrame with a ``broadcast`` hint -- safe because the dimension is a fixed table.

"Strict" lookups (a KeyError in the reference) give NULL for an unknown key instead of failing the job;
``unmatched_keys`` reports such keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numeric import col_of, map_get


# -- single-key lookups (C2-C8, C10) ------------------------------------------------------------------
def informal_discount(waste_type="waste_type") -> Column:
    """Informal-market discount by waste type, default 0.75."""
    return map_get(D.INFORMAL_DISCOUNTS, waste_type, D.INFORMAL_DISCOUNT_DEFAULT)


def county_multiplier(county="county") -> Column:
    """C4: county multiplier, default 1.00."""
    return map_get(D.COUNTY_MULT, county, 1.0)


def collection_point_multiplier(cp="collection_point", generation: str = "v2") -> Column:
    """C5 (v2, default 1.00) or C6 (training, strict -> NULL when unknown)."""
    if generation == "train":
        return map_get(D.TRAIN_COLLECTION_POINT_MULT, cp)
    return map_get(D.V2_COLLECTION_POINT_MULT, cp, 1.0)


def training_county_multiplier(county="county") -> Column:
    """Training county multiplier, strict."""
    return map_get(D.TRAIN_COUNTY_MULT, county)


def seasonal_demand(month="month") -> Column:
    """v1/js seasonal demand by month, default 0.90."""
    return map_get(D.SEASONAL_DEMAND, month, D.SEASONAL_DEMAND_DEFAULT)


def training_seasonal(month="month") -> Column:
    """Training seasonal factor, strict."""
    return map_get(D.TRAIN_SEASONAL, month)


def condition_factor(condition="condition") -> Column:
    """Training condition factor, strict."""
    return map_get(D.COND_FACTORS, condition)


def fallback_half_width(waste_type="waste_type") -> Column:
    """Js interval half-width by waste type, default 4."""
    return map_get(D.FALLBACK_HALF_WIDTH, waste_type, D.FALLBACK_HALF_WIDTH_DEFAULT)


def waste_base_price(waste_type="waste_type") -> Column:
    """Base price by waste type only, default 20."""
    return map_get(D.WASTE_BASE_PRICES, waste_type, D.BASE_PRICE_DEFAULT)


def tier_advice(tier="market_tier") -> Column:
    """Advice by tier, default ''."""
    return map_get(D.TIER_ADVICE, tier, "")


def collection_point_advice(cp="collection_point") -> Column:
    """Advice by collection point, default ''."""
    return map_get(D.COLLECTION_POINT_ADVICE, cp, "")


def base_price_v1(waste_type="waste_type", sub_type="sub_type") -> Column:
    """Sub-type price, else waste-type price, else 20 (sub-type is not checked against the type)."""
    return F.coalesce(map_get(D.SUBTYPE_PRICES, sub_type), map_get(D.WASTE_BASE_PRICES, waste_type),
                      F.lit(D.BASE_PRICE_DEFAULT))


def base_price_source(waste_type="waste_type", sub_type="sub_type") -> Column:
    return (F.when(map_get(D.SUBTYPE_PRICES, sub_type).isNotNull(), F.lit("sub_type"))
            .when(map_get(D.WASTE_BASE_PRICES, waste_type).isNotNull(), F.lit("waste_type"))
            .otherwise(F.lit("default")))


def with_base_price_v1(df: DataFrame) -> DataFrame:
    """C1 as a DataFrame operator: adds ``base_price`` and where it came from."""
    return df.withColumn("base_price", base_price_v1()).withColumn("base_source", base_price_source())


# -- composite-key lookup (C9) --------------------------------------------------------------------------
def with_base_rates(df: DataFrame, how: str = "left") -> DataFrame:
    """(mean, std) of the training base rate by (waste_type, sub_type).

    ``how='inner'`` is the reference's strict lookup (rows with an unknown pair drop out);
    the default keeps every row and leaves NULL, see ``unmatched_keys``."""
    dim = D.base_rates_dim(df.sparkSession).select("waste_type", "sub_type", "base_mean", "base_std")
    return df.join(F.broadcast(dim), on=["waste_type", "sub_type"], how=how)


def unmatched_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Distinct key combinations of ``df`` absent from the base-rate table (anti join, then distinct)."""
    dim = D.base_rates_dim(df.sparkSession).select("waste_type", "sub_type")
    return df.select(*on).join(F.broadcast(dim), on=on, how="left_anti").distinct()


# -- range match (C11) ----------------------------------------------------------------------------------
def with_volume_bands(df: DataFrame, weight="weight_kg") -> DataFrame:
    """C11: match each row to every weight band [0.7 c, 1.3 c] containing it (bands may overlap).

    The band table has five rows; the non-equi condition is planned as a broadcast nested-loop join,
    i.e. five comparisons per row, no shuffle."""
    bands = D.volume_bands_dim(df.sparkSession)
    w = col_of(weight)
    return df.join(F.broadcast(bands), (w >= bands.band_lo) & (w <= bands.band_hi), "inner")


# -- v1 sub-type lists (D13) ------------------------------------------------------------------------------
def subtype_rows(spark) -> DataFrame:
    """Flatten the v1 type -> sub-type lists into ordered rows
    (type_index, waste_type, pos, sub_type, flat_pos); flat_pos is the one-hot column order."""
    from pyspark.sql import Window
    rows = D.v1_subtype_lists_dim(spark).select(
        "type_index", "waste_type", F.posexplode("subtypes").alias("pos", "sub_type"))
    # 28 rows of a fixed table: a global window is fine here.
    return rows.withColumn("flat_pos", F.row_number().over(Window.orderBy("type_index", "pos")) - 1)
