"""Sources and sinks: declared schemas only, never inference.

* A1/A2  CSV training table in/out (header, no index), parquet in/out (optionally partitioned).
* A5/A6  feature metadata as one JSON record (arrays and string-keyed maps).
* A7     metrics as a long (model, metric, value) table, written as JSON lines.
* A8     the report as text lines from the (section, metric, value) rows.
* A9     JSON listing requests in, nested price records out.
A3/A4 (model bundle save/load) live with the models in ``operators.train``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baleprice.functions import dims as D
from baleprice.session import stored

REQUEST_SCHEMA = T.StructType([
    T.StructField("waste_type", T.StringType()),
    T.StructField("sub_type", T.StringType()),
    T.StructField("weight_kg", T.DoubleType()),
    T.StructField("condition", T.StringType()),
    T.StructField("county", T.StringType()),
    T.StructField("distance_km", T.DoubleType()),
    T.StructField("collection_point", T.StringType()),
])

TRAINING_SCHEMA = T.StructType([
    T.StructField("waste_type", T.StringType()), T.StructField("sub_type", T.StringType()),
    T.StructField("weight_kg", T.DoubleType()), T.StructField("distance_km", T.DoubleType()),
    T.StructField("condition", T.StringType()), T.StructField("month", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()), T.StructField("county", T.StringType()),
    T.StructField("collection_point", T.StringType()), T.StructField("market_tier", T.StringType()),
    T.StructField("tier_score", T.DoubleType()), T.StructField("tier_multiplier", T.DoubleType()),
    T.StructField("price_per_kg", T.DoubleType()),
])

V1_TABLE_SCHEMA = T.StructType([
    T.StructField("waste_type", T.StringType()), T.StructField("sub_type", T.StringType()),
    T.StructField("weight_kg", T.DoubleType()), T.StructField("distance_km", T.DoubleType()),
    T.StructField("consistency_score", T.DoubleType()), T.StructField("month", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()), T.StructField("market_demand_index", T.DoubleType()),
    T.StructField("price_per_kg", T.DoubleType()),
])

FEATURE_META_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("categorical", T.ArrayType(T.StringType())),
    T.StructField("numerical", T.ArrayType(T.StringType())),
    T.StructField("volume_logic", T.StringType()),
    T.StructField("multipliers", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("informal_discounts", T.MapType(T.StringType(), T.DoubleType())),
])

METRIC_SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("metric", T.StringType()),
                              T.StructField("value", T.DoubleType())])


# -- A1 / A2 -----------------------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRAINING_SCHEMA) -> DataFrame:
    """A CSV with a header row, its columns bound by name to the declared schema, in any order; further columns
    are left out. A missing column raises ``ValueError``; a malformed value, or a file with another header than the
    first, fails the job that reads it."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    rows = spark.read.schema(found).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return rows.csv(path).select(*schema.names)


def read_csv_quarantined(spark: SparkSession, path: str, schema: T.StructType = TRAINING_SCHEMA,
                         required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV that parse as ``schema`` and have a value in every ``required`` column, and the others
    as (file, reason, record): the reason is ``malformed`` or ``no <column>``, the record the line as it stands in the
    file, or the parsed values as CSV. Together they are all rows of the input, each in one of the two.

    Columns are bound by name; ``optional`` ones may be missing and are NULL then. Spark parses only the columns that a
    query needs, and a bad value elsewhere would go unseen; so the file is parsed whole, once, into the shared folder,
    and both sides read that: a row's side doesn't depend on the query."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header and f.name not in optional]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    corrupt = "_malformed"
    while corrupt in header:
        corrupt += "_"
    found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header] + [T.StructField(corrupt, T.StringType())])
    rows = spark.read.schema(found).options(
        header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt).csv(path)
    file = "_file"
    while file in found.names:
        file += "_"
    rows = stored(rows.select(*found.names, F.col("_metadata.file_path").alias(file)), "csv")
    values = [(F.col(f.name) if f.name in header else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    reason = F.when(F.col(corrupt).isNotNull(), F.lit("malformed"))
    for c in required:
        reason = reason.when(F.col(c).isNull(), F.lit(f"no {c}"))
    good = rows.filter(reason.isNull()).select(*values)
    bad = rows.filter(reason.isNotNull()).select(
        F.col(file).alias("file"), reason.alias("reason"), F.coalesce(F.col(corrupt), F.to_csv(F.struct(*values))).alias("record"))
    return good, bad


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: header row, no index column; one file per task (no single-writer funnel)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Listings partitioned by e.g. ``waste_type`` let later filters prune whole directories."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# -- A5 / A6 -----------------------------------------------------------------------------------------
def feature_metadata(spark: SparkSession) -> DataFrame:
    """A5: the training metadata record (version, feature lists, multiplier tables, discounts)."""
    mult = {
        "collection_point": {k: float(v) for k, v in D.TRAIN_COLLECTION_POINT_MULT.items()},
        "county": {k: float(v) for k, v in D.TRAIN_COUNTY_MULT.items()},
        "seasonal": {str(k): float(v) for k, v in D.TRAIN_SEASONAL.items()},
        "condition": {k: float(v) for k, v in D.COND_FACTORS.items()},
        "volume": {"1": 1.0, "20": 0.92, "50": 0.85, "100": 0.78, "500": 0.68, "1000": 0.60},
    }
    row = ("2.2", D.CATEGORICAL_FEATURES + D.NUMERIC_FEATURES, D.CATEGORICAL_FEATURES, D.NUMERIC_FEATURES,
           "Bulk discount: 1kg=1.0, 100kg=0.78, 500kg=0.60", mult,
           {k: float(v) for k, v in D.INFORMAL_DISCOUNTS.items()})
    return spark.createDataFrame([row], FEATURE_META_SCHEMA)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_feature_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Read the metadata back with its declared schema (JSON lines or one multi-line document)."""
    return spark.read.schema(FEATURE_META_SCHEMA).option("multiLine", True).json(path)


# -- A7 ----------------------------------------------------------------------------------------------
def metrics_long(df_wide: DataFrame, model_col: str = "model") -> DataFrame:
    """Wide metric rows (one per model) -> long (model, metric, value) rows."""
    cols = [c for c, t in df_wide.dtypes if c != model_col and t in ("double", "float", "bigint", "int")]
    stack = "stack({}, {})".format(len(cols), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))
    return df_wide.select(F.col(model_col).alias("model"), F.expr(stack).alias("metric", "value"))


def metrics_from_json_text(spark: SparkSession, text: str) -> DataFrame:
    """A nested ``{model: {metric: value}}`` document (e.g. a metrics file) as a long table.
    The document is small by construction (a handful of models)."""
    doc = json.loads(text)
    rows = [(m, k, float(v)) for m, d in doc.items() for k, v in d.items()]
    return spark.createDataFrame(rows, METRIC_SCHEMA)


# -- A8 ----------------------------------------------------------------------------------------------
def report_lines(stats: DataFrame) -> DataFrame:
    """(section, metric, value) rows rendered as ``section | metric | value`` text lines."""
    return stats.select(F.concat_ws(" | ", "section", "metric",
                                    F.format_number(F.col("value"), 2)).alias("value"))


def write_text(df_lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    df_lines.write.mode(mode).text(path)


# -- A9 ----------------------------------------------------------------------------------------------
def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Listing requests (JSON lines or parquet) with the request schema."""
    reader = spark.read.schema(REQUEST_SCHEMA)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def write_responses(df: DataFrame, path: str, col: str = "response", mode: str = "overwrite") -> None:
    """Nested response records as JSON lines (``to_json`` of the struct per row)."""
    df.select(F.to_json(col).alias("value")).write.mode(mode).text(path)
