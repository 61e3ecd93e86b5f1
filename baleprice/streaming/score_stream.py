"""Structured Streaming: price listing requests as they arrive.

The pricing plan is stateless (one row in, one row out), so the streaming job is ``readStream`` ->
``price_listings`` -> ``writeStream`` with no watermark or state store. Output is written per
micro-batch with ``foreachBatch`` into its own ``batch_id=<n>`` parquet directory (a replayed batch
overwrites its own output, so the sink is idempotent). The checkpoint must live on shared storage on
a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from baleprice.operators.publish import PublishedBundles
from baleprice.plans.serve import price_listings
from baleprice.sources.io import REQUEST_SCHEMA


def request_stream(spark: SparkSession, source_dir: str, fmt: str = "json", schema=REQUEST_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format(fmt).load(source_dir)


def priced_stream(stream: DataFrame, bundle=None, keep: list[str] | None = None,
                  rule_model: bool = False) -> DataFrame:
    """The batch pricing plan applied to a stream; the request's arrival time stands for "now"."""
    stamped = stream.withColumn("received_at", F.current_timestamp())
    return price_listings(stamped, bundle=bundle, as_of="received_at", keep=keep, rule_model=rule_model)


def start_published_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, bundle_root: str,
                           fmt: str = "json", keep: list[str] | None = None, trigger_once: bool = False,
                           rule_model: bool = False) -> StreamingQuery:
    """As ``start_pricing_stream``, with the newest bundle published below ``bundle_root`` at the start of each
    micro-batch; ``model_version`` names it on every row. Publishing another one needs no restart. Before the first
    publication ``rule_model`` asks for rule prices (version NULL); without it the stream fails. A batch that is run
    again after a failure replaces its output, priced by the version that is newest then."""
    published = PublishedBundles(bundle_root)
    stamped = request_stream(spark, source_dir, fmt).withColumn("received_at", F.current_timestamp())

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        version, bundle = published.current(batch.sparkSession)
        priced = price_listings(batch, bundle=bundle, as_of="received_at", keep=keep, rule_model=rule_model)
        priced.withColumn("model_version", F.lit(version).cast("string")).write.mode("overwrite").parquet(
            f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stamped.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_pricing_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         bundle=None, fmt: str = "json", keep: list[str] | None = None,
                         trigger_once: bool = False, rule_model: bool = False) -> StreamingQuery:
    """Start the job: each micro-batch of priced rows lands in ``sink_dir/batch_id=<n>`` as parquet."""
    priced = priced_stream(request_stream(spark, source_dir, fmt), bundle, keep, rule_model)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # one directory per micro-batch, overwritten on re-execution: a batch replayed after a failure
        # replaces its own output instead of appending duplicates (idempotent by batch id)
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    writer = priced.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
