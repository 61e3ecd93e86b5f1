"""Listings derived from the driver's TPC-H-style tables.

The test tables hold no waste listings, so ``raw_listings`` projects one listing per lineitem row
(lineitem x orders x customer x part) into the request schema, deterministically and with every
category, out-of-range value, unknown value and NULL represented. It only supplies rows in the
schema the jobs expect; all pricing work happens in ``baleprice.operators``.

Row key (unique at every scale factor): ``KEY``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numeric import round_even, round_py
from baleprice.operators.clean import clean_listings
from baleprice.operators.rules import expected_price_v2, tier_train
from baleprice.session import limit_method_size

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# FIXED VALUES of the projection (see FIXTURES.md section 2)
_WASTE_BY_PART = ["plastic", "metal", "paper", "e_waste", "organic", "glass", "textile", "rubber"]
_COUNTY_BY_NATION = ["Nairobi", "Mombasa", "Kisumu", "Nakuru", "Eldoret", "Kiambu", "Machakos", "Kajiado", "Turkana"]
_POINT_BY_SEGMENT = {"HOUSEHOLD": "household", "BUILDING": "commercial", "MACHINERY": "industrial",
                     "AUTOMOBILE": "dump_site"}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _pick(index_col, values: list[str]):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index_col == i, F.lit(v)) if expr is None else expr.when(index_col == i, F.lit(v))
    return expr


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing requests (uncleaned) with the v1 columns, the listing date and the row key.

    Joins are plain equi-joins; Catalyst/AQE choose broadcast for the small sides from runtime sizes
    and sort-merge at scale. Only the needed columns are read (pruned scans). The session's limit on generated methods
    is lowered where need be, since all pricing chains start here (``limit_method_size``)."""
    limit_method_size(spark)
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                                                 "l_returnflag", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    # Join order for scale: orders x customer is orders-sized; lineitem meets part and then the
    # (orders x customer) result, so at most two lineitem-sized shuffles happen when no side is small
    # enough to broadcast (the written order would shuffle lineitem-sized data three times).
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    j = li.join(part, li.l_partkey == part.p_partkey).join(oc, li.l_orderkey == oc.o_orderkey)
    seg = F.col("c_mktsegment")
    point = None
    for k, v in _POINT_BY_SEGMENT.items():
        point = F.when(seg == k, F.lit(v)) if point is None else point.when(seg == k, F.lit(v))
    listings = j.select(
        *KEY,
        _pick(F.col("p_partkey") % 8, _WASTE_BY_PART).alias("waste_type"),
        F.floor(F.col("p_partkey") / 8).cast("bigint").alias("sub_seq"),
        (F.col("l_quantity") * (F.lit(1) + F.col("p_size") % 25)).alias("weight_kg"),
        (((F.col("l_suppkey") * 37 + F.col("l_partkey")) % 2500) / F.lit(10.0)).alias("distance_km"),
        F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("l_tax") == 0), F.lit("Unsorted"))
         .when(F.col("l_returnflag") == "N", F.lit("clean"))
         .when(F.col("l_returnflag") == "A", F.lit("mixed"))
         .otherwise(F.lit("contaminated")).alias("condition"),
        _pick(F.col("c_nationkey") % 9, _COUNTY_BY_NATION).alias("county"),
        point.alias("collection_point"),
        F.month("l_shipdate").cast("int").alias("month"),
        F.weekday("l_shipdate").cast("int").alias("day_of_week"),
        round_even(F.lit(1.0) - F.col("l_discount") * F.lit(8.0), 2).alias("consistency_score"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_tax") * F.lit(12.5)).alias("market_demand_index"),
        (F.lit(0.7) + F.lit(0.6) * ((F.floor("l_extendedprice") % 1000) / F.lit(1000.0))).alias("noise"),
        F.col("o_orderdate").alias("listed_at"),
    )
    # sub_type = entry (sub_seq mod n) of the waste type's training list: a 31-row fixed dimension.
    counts = D.subtype_count_dim(spark)
    subs = D.base_rates_dim(spark).select("waste_type", "sub_pos", "sub_type")
    listings = (listings.join(F.broadcast(counts), "waste_type", "left")
                .withColumn("sub_pos", (F.col("sub_seq") % F.col("n_subtypes")).cast("int"))
                .join(F.broadcast(subs), ["waste_type", "sub_pos"], "left")
                .drop("sub_seq", "n_subtypes", "sub_pos"))
    return listings


TRAINING_COLUMNS = ["waste_type", "sub_type", "weight_kg", "distance_km", "condition", "month", "day_of_week",
                    "county", "collection_point", "market_tier", "tier_score", "tier_multiplier", "price_per_kg"]


def label_listings(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The v2 training table: training-cleaned rows, E3 tier and the price label
    ``round2(max(0.5, E7 x noise))`` (noise is a column of the stand-in rows). ``keep`` names further columns, such as
    the noise-free ``expected_price_raw``."""
    cleaned = tier_train(clean_listings(raw, "train"))
    priced = expected_price_v2(cleaned, tier_multiplier="tier_multiplier", out_col=None)
    labelled = priced.withColumn(
        "price_per_kg", round_py(F.greatest(F.lit(0.5), F.col("expected_price_raw") * F.col("noise")), 2))
    return labelled.select(*KEY, *TRAINING_COLUMNS, *keep)


def training_table(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return label_listings(raw_listings(spark, sf_dir), keep)
