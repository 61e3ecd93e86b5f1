"""Validation, cleaning and date defaults. All narrow projections: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numeric import clip


def _in(c: Column, values) -> Column:
    return c.isin(*values)


def validation_errors() -> Column:
    """The reasons a listing fails the request schema, as ``array<string>`` (empty = valid).

    Enum checks are case-sensitive; a NULL optional field takes its default and is therefore valid;
    a NULL required field is an error."""
    wt, st, w = F.col("waste_type"), F.col("sub_type"), F.col("weight_kg")
    cond, county, dist, cp = F.col("condition"), F.col("county"), F.col("distance_km"), F.col("collection_point")
    lo_w, hi_w = D.WEIGHT_BOUNDS
    lo_d, hi_d = D.DISTANCE_BOUNDS
    lo_s, hi_s = D.SUB_TYPE_LENGTH
    checks = [
        F.when(wt.isNull(), F.lit("waste_type missing"))
         .when(~_in(wt, D.VALID_WASTE_TYPES), F.lit("waste_type not allowed")),
        F.when(st.isNull(), F.lit("sub_type missing"))
         .when(~F.length(st).between(lo_s, hi_s), F.lit("sub_type length not in 2-50")),
        F.when(w.isNull(), F.lit("weight_kg missing"))
         .when(~w.between(lo_w, hi_w), F.lit("weight_kg not in 0.5-1000")),
        F.when(cond.isNotNull() & ~_in(cond, D.VALID_CONDITIONS), F.lit("condition not allowed")),
        F.when(county.isNotNull() & ~_in(county, D.VALID_COUNTIES), F.lit("county not allowed")),
        F.when(dist.isNotNull() & ~dist.between(lo_d, hi_d), F.lit("distance_km not in 0.1-200")),
        F.when(cp.isNotNull() & ~_in(cp, D.VALID_COLLECTION_POINTS), F.lit("collection_point not allowed")),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate_listings(df: DataFrame) -> DataFrame:
    """Add ``errors`` and ``is_valid``. One row in, one row out; rejection is per row."""
    return df.withColumn("errors", validation_errors()).withColumn("is_valid", F.size("errors") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = df if "errors" in df.columns else validate_listings(df)
    return checked.filter(F.col("is_valid")), checked.filter(~F.col("is_valid"))


def listing_issues(df: DataFrame) -> DataFrame:
    """B6 + the dump-site note: one row per (listing, issue) with a severity.

    ``dump_site`` passes the schema but the live model prices it as ``commercial``: a warning."""
    checked = df if "errors" in df.columns else validate_listings(df)
    warn = F.when(F.col("collection_point") == "dump_site",
                  F.array(F.lit("collection_point dump_site priced as commercial"))).otherwise(F.array())
    errors = F.transform("errors", lambda e: F.struct(F.lit("error").alias("severity"), e.alias("reason")))
    warnings = F.transform(warn, lambda e: F.struct(F.lit("warning").alias("severity"), e.alias("reason")))
    return checked.select("*", F.explode(F.concat(errors, warnings)).alias("issue"))


def reject_counts(df: DataFrame) -> DataFrame:
    """Number of listings per (severity, reason); partial aggregation before the shuffle."""
    return (listing_issues(df).groupBy(F.col("issue.severity").alias("severity"),
                                       F.col("issue.reason").alias("reason"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def _lower_or(c: Column, allowed, otherwise: str) -> Column:
    low = F.lower(c)
    return F.when(_in(low, allowed), low).otherwise(F.lit(otherwise))


def clean_listings(df: DataFrame, generation: str = "v2") -> DataFrame:
    """Defaults, clipping and normalisation before pricing.

    * ``v2``    live rules: condition lower-cased, unknown -> mixed; county exact match in the 8-county
      table else Nairobi; collection point lower-cased, unknown (including ``dump_site``) -> commercial.
    * ``train`` as v2, but ``dump_site`` is a known collection point (it has a training multiplier).
    * ``v2old`` only clips and normalises the condition; county and collection point pass through.
    """
    lo_w, hi_w = D.WEIGHT_BOUNDS
    lo_d, hi_d = D.DISTANCE_BOUNDS
    cond = F.coalesce(F.col("condition"), F.lit(D.DEFAULTS["condition"]))
    county = F.coalesce(F.col("county"), F.lit(D.DEFAULTS["county"]))
    cp = F.coalesce(F.col("collection_point"), F.lit(D.DEFAULTS["collection_point"]))
    dist = F.coalesce(F.col("distance_km"), F.lit(D.DEFAULTS["distance_km"]))
    out = {
        "weight_kg": clip("weight_kg", lo_w, hi_w),
        "distance_km": clip(dist, lo_d, hi_d),
        "condition": _lower_or(cond, D.VALID_CONDITIONS, "mixed"),
    }
    if generation in ("v2", "train"):
        out["county"] = F.when(_in(county, list(D.COUNTY_MULT)), county).otherwise(F.lit("Nairobi"))
        allowed = D.TRAIN_COLLECTION_POINT_MULT if generation == "train" else D.V2_COLLECTION_POINT_MULT
        out["collection_point"] = _lower_or(cp, list(allowed), "commercial")
    elif generation == "v2old":
        out["county"] = county
        out["collection_point"] = cp
    else:
        raise ValueError(f"unknown generation {generation!r}")
    return df.withColumns(out)


def resolve_dates(df: DataFrame, as_of="listed_at", convention: str = "python",
                  month_col: str = "month", dow_col: str = "day_of_week") -> DataFrame:
    """Fill month and weekday from the listing date when absent.

    ``as_of`` is a column (or a literal date) standing for "now" in the reference, so results repeat.
    Python convention: Monday = 0; JavaScript convention: Sunday = 0."""
    ts = F.col(as_of) if isinstance(as_of, str) else as_of
    month = F.month(ts).cast("int")
    dow = (F.weekday(ts) if convention == "python" else F.dayofweek(ts) - 1).cast("int")
    if month_col in df.columns:
        month = F.coalesce(F.col(month_col).cast("int"), month)
    if dow_col in df.columns:
        dow = F.coalesce(F.col(dow_col).cast("int"), dow)
    return df.withColumns({month_col: month, dow_col: dow})
