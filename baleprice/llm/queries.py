"""The registered queries ``opN_<name>`` of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baleprice.llm import (chat, embeddings, imatch, jaccard, lexical, licences, mixing, negatives, pack, sharding,
                           substrings, toxicity, warc)
from baleprice.llm.common import scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed best-fit into sequences of 512 to 8192 words: a row per piece."""
    return pack.pack(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to weights 5, 2, 1 and 150 % of all words, at most two epochs."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine 0.9 or more, whatever their labels."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, a row per row of ``documents``.

    Rows are told apart by their place in the files, so that null and repeated ids keep theirs; they follow each other
    by id (nulls last), equal ids by a hash of the text. The next row comes from a range-sorted table without texts; its
    first code points go to the row that they edit. Ids go with the order, so that both joins of the texts read one and
    the same exchange."""
    at, after_at = ["file", "row"], [F.col("next.file").alias("file"), F.col("next.row").alias("row")]
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"))
    terms = imatch.lexicon(docs)
    by = [F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"), *at]
    names = ["nameless", "doc_id", "text_hash", *at]
    ids = written(docs.select(*by, F.char_length("text").cast("long").alias("n_chars")).repartitionByRange(*names)
                  .withColumn("part", F.spark_partition_id()), "ids")
    firsts = ids.groupBy("part").agg(F.min(F.struct(*names)).alias("first"))
    after = firsts.select("part", F.coalesce(
        F.lead("first").over(Window.orderBy("first")), F.min("first").over(Window.partitionBy())).alias("beyond"))
    order = written(ids.withColumn("next", F.lead(F.struct(*at)).over(Window.partitionBy("part").orderBy(*names))).join(
        after, "part").select(*at, "doc_id", "n_chars", F.coalesce("next", F.struct("beyond.file", "beyond.row")).alias("next")), "order")
    texts = docs.select(*at, "text")
    half = F.floor(F.col("n_chars") / 2).cast("int").alias("half")
    heads = texts.join(order.select(*after_at, F.struct(*at).alias("of"), "doc_id", half), at).select(
        "of.file", "of.row", "doc_id", F.left("text", F.col("half")).alias("head"))
    n_chars = F.char_length("text")
    edited = texts.join(heads, at).select("doc_id", *at, "text", n_chars.cast("long").alias("n_chars"), F.concat(
        F.left("text", n_chars - F.floor(n_chars / 2).cast("int")), "head").alias("edited"))
    prints = written(imatch.fingerprints(
        edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), at,
        {"prints": "text", "edited_prints": "edited"}, terms), "prints")
    following = order.select(*after_at, F.struct(*at).alias("of")).join(
        prints.select(*at, F.col("prints").alias("next_prints")), at).select("of.file", "of.row", "next_prints")
    return prints.join(following, at).select(
        "doc_id", "n_chars", "edited_sha256", imatch.as_text(F.col("prints")).alias("fingerprint"),
        imatch.as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        imatch.likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        imatch.likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share at least 75 % of their 5-word shingles."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that aren't held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, read back and assembled: a row per capture."""
    path = scratch(spark, "warc")
    warc.write_captures(_table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=False))
    captures = written(captures.select("record_id", F.col("type").alias("record_type"), "refers_to", "payload_digest",
                                       "payload_bytes", warc.page_id(F.col("metadata")).alias("page_id")), "captures")
    first = captures.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"))
    return captures.join(first, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of all documents, as comma-separated lists."""
    return licences.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"))


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted as chat text and read back from it.

    A conversation is a chain: each message replies to the one before it by turn."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.withColumn("node", nth).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(None).cast("double").alias("score"))
    said = chat.format_paths(chat.reply_paths(written(messages, "messages")))
    back = said.select(F.col("tree").alias("conv_id"), "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of 13 words that start in a document with a smaller id too."""
    return substrings.with_digest(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt uniformly to shards 0 to 7, whose counts are at most one apart."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor's positives among all embeddings; every seventh label is one off at first."""
    off = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", off),
                                    F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_mix_sources, op3_embedding_near_dedup, op4_imatch_fingerprints, op5_ngram_jaccard_join,
    op6_toxicity, op7_warc, op8_licence_scan, op9_reply_trees, op10_substring_dedup, op11_hypergeometric_shards,
    op12_bit_sliced_search, op13_hard_negatives)}

_REPLY_SQL = r"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
      coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\t') AS body,
      replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\t'), ': ', '\c') AS head FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

ORACLE_SQL = {"op2_mix_sources": mixing.ORACLE_SQL, "op5_ngram_jaccard_join": jaccard.ORACLE_SQL,
              "op9_reply_trees": _REPLY_SQL, "op10_substring_dedup": substrings.ORACLE_SQL,
              "op12_bit_sliced_search": lexical.ORACLE_SQL, "op13_hard_negatives": negatives.ORACLE_SQL}
