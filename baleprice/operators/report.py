"""Report aggregates, pivots, bins, rankings and samples.

Every aggregate is a ``groupBy`` with partial (map-side) aggregation, so a hot key costs one combined
row per task before the shuffle. Global windows are only used over already aggregated rows (a few
dozen groups). Histogram bounds and line coefficients are scalar subqueries of the query itself, so nothing
runs while it is built. No cross joins.

Null group keys are dropped first, as pandas ``groupby`` does. ``std`` is the sample deviation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baleprice.functions import dims as D
from baleprice.functions.numeric import row_digest

PRICE = "price_per_kg"


def _nonnull(df: DataFrame, *keys: str) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond) if cond is not None else df


def mean_std_by(df: DataFrame, key: str, value: str = PRICE) -> DataFrame:
    """Mean and sample std of ``value`` by ``key``, mean descending."""
    return (_nonnull(df, key).groupBy(key)
            .agg(F.count(value).alias("n_rows"), F.avg(value).alias("mean_price"),
                 F.stddev_samp(value).alias("std_price"))
            .orderBy(F.desc("mean_price"), F.asc(key)))


def mean_by(df: DataFrame, keys: list[str], value: str = PRICE) -> DataFrame:
    """Mean of ``value`` by ``keys``."""
    return (_nonnull(df, *keys).groupBy(*keys)
            .agg(F.count(value).alias("n_rows"), F.avg(value).alias("mean_price")))


def global_stats(df: DataFrame, value: str = PRICE) -> DataFrame:
    """Count, mean, median (exact, interpolated), sample std, min, max in one pass.

    The exact median keeps one counter per distinct value (partially aggregated per task); for money
    rounded to cents that is bounded by the price range. For continuous data use ``approx=True``
    variants (``percentile_approx``)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"),
                  F.percentile(value, 0.5).alias("median"), F.stddev_samp(value).alias("std"),
                  F.min(value).alias("min"), F.max(value).alias("max"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Frequency of each value, descending (NULL dropped as in pandas)."""
    return _nonnull(df, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")) \
        .orderBy(F.desc("n_rows"), F.asc(key))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of all rows per value in one pass: the NULL-key group is kept until
    the total is summed over the (few) aggregated rows, since NULL keys count in the total as
    ``len(df)`` does, then dropped."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())  # over aggregated rows only
    return (counts.withColumn("share_pct", F.col("n_rows") / total * F.lit(100.0))
            .filter(F.col(key).isNotNull()))


def summary_by(df: DataFrame, key: str, value: str = PRICE, digits: int = 1) -> DataFrame:
    """Mean, min, max by key, rounded (numpy rule) to ``digits``."""
    from baleprice.functions.numeric import round_even
    return (_nonnull(df, key).groupBy(key)
            .agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
            .select(key, *[round_even(c, digits).alias(c) for c in ("mean", "min", "max")]))


def right_closed_bin(x, bins) -> Column:
    """Index of the right-closed bin (lo, hi] holding ``x``; NULL outside all bins (``pd.cut``)."""
    c = F.col(x) if isinstance(x, str) else x
    expr = None
    for i, (lo, hi, _) in enumerate(bins):
        cond = (c > F.lit(float(lo))) & (c <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def binned_stats(df: DataFrame, x: str, bins, value: str | None = PRICE, prefix: str = "bin",
                 value_expr: Column | None = None) -> DataFrame:
    """Right-closed bins of ``x``; count, mean and std of ``value`` per bin. Empty bins are
    kept (right join onto the fixed bin table, which is tiny and broadcast)."""
    val = value_expr if value_expr is not None else F.col(value)
    agg = (df.select(right_closed_bin(x, bins).alias(f"{prefix}_index"), val.alias("_v"))
           .filter(F.col(f"{prefix}_index").isNotNull())
           .groupBy(f"{prefix}_index")
           .agg(F.count("_v").alias("n_rows"), F.avg("_v").alias("mean_value"), F.stddev_samp("_v").alias("std_value")))
    dim = D.bins_dim(df.sparkSession, bins, prefix)
    # agg has at most len(bins) rows: broadcast it (the fixed bin table is the preserved side)
    return (dim.join(F.broadcast(agg), f"{prefix}_index", "left")
            .select(f"{prefix}_index", f"{prefix}_label", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    "mean_value", "std_value")
            .orderBy(f"{prefix}_index"))


def discount_vs_first(bin_stats: DataFrame, prefix: str = "bin") -> DataFrame:
    """(first bin's mean - bin mean) / first bin's mean x 100 over the six aggregated bins."""
    w = Window.orderBy(f"{prefix}_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first("mean_value").over(w)
    return bin_stats.select(f"{prefix}_index", f"{prefix}_label", "mean_value",
                            ((base - F.col("mean_value")) / base * F.lit(100.0)).alias("discount_pct"))


def pivot_mean(df: DataFrame, row: str, col: str, values: list[str], value: str = PRICE,
               fill: float | None = None) -> DataFrame:
    """Mean of ``value`` with ``row`` down and the listed ``col`` values across. The pivot
    values are given, so Spark does not run an extra job to discover them."""
    out = _nonnull(df, row, col).groupBy(row).pivot(col, values).agg(F.avg(value))
    if fill is not None:
        out = out.fillna(fill, subset=values)
    return out


def pivot_type_condition(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Waste type x condition means for the listed types in that order, gaps 0."""
    types = types or D.PIVOT_WASTE_TYPES
    order = D.local_frame(df.sparkSession, [(t, i) for i, t in enumerate(types)], "waste_type string, row_order int")
    piv = pivot_mean(df.filter(F.col("waste_type").isin(*types)), "waste_type", "condition",
                     sorted(D.VALID_CONDITIONS))
    # piv has at most len(types) rows
    return (order.join(F.broadcast(piv), "waste_type", "left").fillna(0.0, subset=sorted(D.VALID_CONDITIONS))
            .orderBy("row_order"))


def crosstab_row_pct(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` x ``col`` as a percentage of the row total, gaps 0."""
    piv = _nonnull(df, row, col).groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0, subset=values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return piv.select(row, *[(F.col(v) / total * F.lit(100.0)).alias(v) for v in values])


def peak(df_means: DataFrame, key: str, value: str = "mean_price") -> DataFrame:
    """Key of the largest mean (first key on ties) with the largest and smallest means."""
    return df_means.agg(F.min_by(key, F.struct(-F.col(value), F.col(key))).alias(f"peak_{key}"),
                        F.max(value).alias("max_mean"), F.min(value).alias("min_mean"))


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """H2: ``orderBy(...).limit(k)`` -- planned as TakeOrderedAndProject (per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def top_types_by_condition(df: DataFrame, k: int = 6) -> DataFrame:
    """Type x condition means restricted to the ``k`` types with the highest unweighted mean of
    their condition means (NULL conditions skipped)."""
    conds = sorted(D.VALID_CONDITIONS)
    piv = pivot_mean(df, "waste_type", "condition", conds)
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in conds]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in conds[1:]), F.coalesce(F.col(conds[0]), F.lit(0.0)))
    n = sum(present[1:], present[0])
    scored = piv.withColumn("mean_of_means", total / n)
    return scored.orderBy(F.desc("mean_of_means"), F.asc("waste_type")).limit(k)


def frequencies(df: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """One row per distinct ``value`` (and keys) with its ``n_rows``, NULL values left out: the table that the median,
    the histogram and conditional quantiles are computed from, so that their input is read once. Prices in cents have
    few distinct values; others shuffle at most one number a row."""
    named = df.select(*(keys or []), value.alias("value")).filter(F.col("value").isNotNull())
    return named.groupBy(*(keys or []), "value").agg(F.count(F.lit(1)).alias("n_rows"))


def histogram(df: DataFrame, x: str, bins: int = D.HISTOGRAM_BINS, value_expr: Column | None = None) -> DataFrame:
    """Equal-width histogram between min and max; the last bin is closed on the right. Empty bins are kept.

    Bounds and bins both come from ``frequencies``, whose exchange Spark reuses: the input is read once."""
    counted = frequencies(df, value_expr if value_expr is not None else F.col(x))
    # the sum keeps the counts in this branch: with the same columns as the bins it is the same exchange
    bounds = counted.agg(F.struct(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"),
                                  F.sum("n_rows").alias("n")).alias("b")).scalar()
    b = F.col("b")
    place = F.floor((F.col("value") - b["lo"]) / (b["hi"] - b["lo"]) * F.lit(float(bins)))
    binned = counted.select("value", "n_rows", bounds.alias("b")).select(
        F.when(b["hi"] == b["lo"], F.lit(0)).otherwise(F.least(place, F.lit(bins - 1))).cast("int").alias("bin_index"), "n_rows")
    counts = binned.groupBy("bin_index").agg(F.sum("n_rows").alias("n_rows"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_index"), bounds.alias("b")).withColumn(
        "width", (b["hi"] - b["lo"]) / F.lit(float(bins)))
    # counts has at most ``bins`` rows
    return (edges.join(F.broadcast(counts), "bin_index", "left")
            .select("bin_index", (b["lo"] + F.col("bin_index") * F.col("width")).alias("bin_lo"),
                    (b["lo"] + (F.col("bin_index") + 1) * F.col("width")).alias("bin_hi"),
                    F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))
            .orderBy("bin_index"))


def quantile_sketches(df: DataFrame, value: Column, keys: list[str], k: int = 400) -> DataFrame:
    """G2 for any column: a KLL sketch of ``value`` per group, ``keys`` + (n_rows, sketch), NULL values left out.

    A sketch has a fixed largest size whatever the values, is aggregated in part by every task, and is a column that can
    be stored with its partition (a month of listings, say) and merged with others later. With ``k`` = 400 the rank of a
    quantile is off by less than 1 % with 99 % confidence."""
    named = df.select(*keys, value.cast("double").alias("value")).filter(F.col("value").isNotNull())
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str], k: int = 400) -> DataFrame:
    """The sketches of finer groups or of several partitions merged by ``keys``, without their rows."""
    return sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches replaced by a column per quantile, named by ``quantiles``."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
                                 for name, q in quantiles.items()}).drop("sketch")


def trend_line(df: DataFrame, y: str = PRICE, x: Column | None = None) -> DataFrame:
    """Least-squares line y ~ log1p(weight): slope and intercept in one aggregate."""
    xc = x if x is not None else F.log1p("weight_kg")
    return df.select(F.col(y).alias("_y"), xc.alias("_x")).agg(
        F.count("_y").alias("n_rows"), F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"))


def trend_points(df: DataFrame, y: str = PRICE, n: int = D.TREND_POINTS) -> DataFrame:
    """The fitted line evaluated at ``n`` log-spaced weights 10^0 .. 10^3."""
    line = trend_line(df, y).select(F.struct("slope", "intercept").alias("line")).scalar()
    pts = df.sparkSession.range(n).select(F.col("id").cast("int").alias("point"), line.alias("line"))
    x = F.pow(F.lit(10.0), F.col("point") * F.lit(3.0 / (n - 1)))
    return pts.select("point", x.alias("weight_kg"),
                      (F.col("line.slope") * F.log1p(x) + F.col("line.intercept")).alias("price_per_kg"))


def distinct_sorted_list(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of ``value`` per ``key`` as a sorted list (and its text form)."""
    return (_nonnull(df, key, value).select(key, value).distinct().groupBy(key)
            .agg(F.array_sort(F.collect_list(value)).alias("values"))
            .select(key, "values", F.array_join("values", ",").alias("values_text"),
                    F.size("values").alias("n_values")))


def ranked_cumulative_share(df_groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """H3: groups ranked by ``value`` descending with share and running share of the total.
    Input is already aggregated (one row per group), so the ordered window is over few rows."""
    order = [F.desc(value)] + [F.asc(k) for k in keys]
    w = Window.orderBy(*order)
    total = F.sum(value).over(Window.partitionBy())
    return (df_groups.withColumn("rank", F.row_number().over(w))
            .withColumn("share", F.col(value) / total)
            .withColumn("cum_share", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def items_to_reach(ranked: DataFrame, threshold: float = 0.8) -> DataFrame:
    """H4: number of ranked items needed for the running share to reach ``threshold``."""
    return ranked.filter(F.col("cum_share") >= F.lit(threshold)).agg(F.min("rank").alias("n_items"))


def sample_per_group(df: DataFrame, group: str, n: int, key: list[str], seed: int = 42,
                     salt_buckets: int | None = None) -> DataFrame:
    """H6: ``min(n, group size)`` rows per group, chosen by a seeded hash of the row key.

    Two phases so a hot group never lands in one task: first the ``n`` smallest hashes per (group, salt), then the
    ``n`` smallest of those candidates per group. The salt is the task that read the row, modulo ``salt_buckets`` (by
    default the session's shuffle partitions), so that a task ships at most ``n`` rows of a group; the result is
    exactly the ``n`` smallest hashes per group whatever the salt."""
    salts = salt_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = df.withColumns({"_h": row_digest(key, seed), "_salt": F.spark_partition_id() % F.lit(salts)})
    w1 = Window.partitionBy(group, "_salt").orderBy("_h", *key)
    cand = work.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n).drop("_r")
    w2 = Window.partitionBy(group).orderBy("_h", *key)
    return (cand.withColumn("sample_rank", F.row_number().over(w2)).filter(F.col("sample_rank") <= n)
            .drop("_h", "_salt"))


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42, salt_buckets: int | None = None) -> DataFrame:
    """H6: ``min(n, len(df))`` rows drawn by a seeded hash of the row key (the whole input is one
    group; the two-phase plan of ``sample_per_group`` keeps every task's share bounded)."""
    return sample_per_group(df.withColumn("_all", F.lit(0)), "_all", n, key, seed, salt_buckets).drop("_all")
