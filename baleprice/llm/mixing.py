"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source the keys are sorted by range: equal key ranges, as many as the
source's rows need, so that no source is ever sorted in one task. Sums per range, then running sums within each range,
are the distributed prefix sums; the order is cut at each source's exact budget, after whole epochs where it is larger
than the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baleprice.llm.common import WORD, written

#: Two to the power of 52: the hash-random key has 52 bits, exact in a double.
_KEYS = 1 << 52


def random_key(id_col: str, seed: str) -> Column:
    """The first 52 bits of md5(seed:id) as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))), 1, 13), 16, 10).cast(
        "long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """Per source: source, n_docs, source_size, weight, target (double).

    ``sizes`` has (source, size). Weights go to the sources by code point order, null last, repeating. The total is
    ``share`` of all sizes, shared by weight; a target above ``max_epochs`` times its source's size stops there and
    the excess goes to the others by weight until none is above. In the order of size over weight, the sources that
    stop are a prefix, so that running sums give the result of all rounds at once. If all stop, the rest of the
    total is not given out. The window without a partition sees one row per source."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("_i", F.lit(len(weights))) + 1))
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), "_i")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (per.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
           .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
           .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
           .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("_level", F.col("_left") / F.col("_weights"))
           .withColumn("_stops", F.col("_cap") <= F.col("_level") * F.col("weight")))
    rate = F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(
        upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(rate * F.col("weight"))).select(
        "source", "n_docs", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix",
        rows_per_range: int = 50_000) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``size`` counts the words of the text (null: 0); ``taken`` is how many of the row's words the mix takes, whole
    epochs included: the order of the hash-random keys is repeated until the source's target, rounded down, is used
    up, and the document at the cut gives its first words only. So the taken words of a source sum to its target
    exactly. Equal inputs give equal results whatever the partitioning; a null source is a source of its own; rows
    with equal ids are ordered by size, then lie side by side; null ids share one key; other columns are ignored;
    an empty table gives no rows. Word counts are written once to the shared folder, so texts are read once."""
    sized = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = written(source_targets(sized, weights, share, max_epochs), "targets")
    return _taken(sized, sized, targets, seed, rows_per_range).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def _taken(rows: DataFrame, sized: DataFrame, targets: DataFrame, seed: str, rows_per_range: int, *ties: str) -> DataFrame:
    """``rows`` (doc_id, source, size and others, all kept) with ``taken`` and what it follows from. ``sized`` has the
    doc_id, source and size of the same rows, for the sums per range. Among equal ids and sizes ``ties`` order."""
    keyed = lambda df: (df.withColumn("_key", F.coalesce(random_key("doc_id", seed), F.lit(0)))
             .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
             .withColumn("_range", F.floor(F.col("_key") / F.lit(float(_KEYS))
                                           * F.ceil(F.col("n_docs") / F.lit(float(rows_per_range))))))
    spans = keyed(sized).groupBy(F.col("source").alias("_s"), F.col("_range").alias("_r")).agg(F.sum("size").alias("_sum"))
    spans = spans.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_s").orderBy("_r")) - F.col("_sum"))
    inner = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = keyed(rows).withColumn("_before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(
        spans, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_base") - F.col("_before")))
    return placed.withColumn("taken", (epochs * F.col("size") + extra).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
                    seed: str = "mix", rows_per_range: int = 50_000) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch that takes the document, the last one cut
    to its first words where the budget ends inside it; documents of which nothing is taken are left out, but those
    without words, which cost nothing, stay once. The whole row goes through the mix, no id is looked up again: each
    row stands for itself, ids may be null or repeated. Null ids share the first place of the order; rows with equal
    ids lie side by side by size, then by a hash of their columns (maps aside), so that only equal rows are
    interchangeable. The words of a source sum to its target, rounded down, in every case."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    key = (F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size)
    sized = written(docs.select(*key), "sizes")
    targets = written(source_targets(sized, weights, share, max_epochs), "targets")
    hashed = [F.col(f"`{c.name}`") for c in docs.schema if "map<" not in c.dataType.simpleString()]
    rows = docs.select(*key, F.xxhash64(*hashed).alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mixed = _taken(rows, sized, targets, seed, rows_per_range, "_tie")
    passes = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(
        F.transform(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int")),
                    lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size"))), lambda left: left > 0))
    text = F.col("_row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), 1, F.col("_n").cast("int")), " ")
    return mixed.withColumn("_n", F.explode(passes)).select(*[
        (F.when(F.col("_n") == F.col("size"), text).otherwise(cut) if c == text_col
         else F.col("_row").getField(c)).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
           FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
v AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
t AS (SELECT *, (sum(source_size) OVER ()) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING
                                       AND 1 PRECEDING), 0) AS rest,
             (sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY source_size / weight, i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM v),
u AS (SELECT *, rest / weights AS level, cap <= rest / weights * weight AS stops FROM t),
g AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE
        (SELECT level FROM u WHERE NOT stops ORDER BY source_size / weight, i LIMIT 1) * weight END AS target FROM u),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY
          substr(md5('mix:' || d.doc_id::VARCHAR), 1, 13), d.doc_id, d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
