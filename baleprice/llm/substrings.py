"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against all smaller ones. The reference index holds the hash of each run of ``k`` words (a seed)
and the smallest document that has it; it lies in blocks, dealt by a second hash of the seed, each built by one task. The
seeds of a document are looked up in the blocks that could hold them, so that all blocks are covered without a pass of
every document over every block. The parse is greedy: a factor opens at the first seed found and goes on while the next
seed is found too; where it ends, the seeds that straddle its boundary have been looked up like all others, so a factor
that begins inside the last one joins it. Factors of at least ``k`` words are the duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from baleprice.llm import words as W
from baleprice.llm.common import bucket_count, by_bucket, planes, released, small_arrow_batches, text_batches, unplanes

#: A seed's identity: the low 7 bytes of one hash, and its block, dealt by a second, independent hash.
_SEED, _BLOCK, _KEY_BYTES = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 7
_KEY = np.uint64((1 << (8 * _KEY_BYTES)) - 1)
BLOCK_BYTES, _BATCH = 8 << 20, 4 << 20


def _seeds(table: pa.Table, k: int):
    """Keys, blocks' hashes and document rows of all seeds of a table's texts, and where each text's words lie."""
    h, bounds = W.word_hashes(*W.buffers(table["text"]))
    inside = W.window_mask(bounds, k, len(h))
    at = np.flatnonzero(inside)
    row = np.searchsorted(bounds, at, "right") - 1
    return W.rolling(h, k, _SEED)[at] & _KEY, W.rolling(h, k, _BLOCK)[at], row


def _index_rows(k: int, n_blocks: int):
    """Map side: the seeds of a batch by block, each once with its smallest document; what other documents of the batch
    share with that one is known at once and passes the index as a finding."""

    def run(batches):
        for table in text_batches(batches, _BATCH):
            ids = table["doc_id"].to_numpy()
            key, block_hash, row = _seeds(table, k)
            if not len(key):
                continue
            block = (block_hash % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(key ^ (block_hash << np.uint64(56)))
            key_o, block_o = key[order], block[order]
            new = np.r_[True, (key_o[1:] != key_o[:-1]) | (block_o[1:] != block_o[:-1])]
            starts = np.flatnonzero(new)
            first = np.minimum.reduceat(order, starts)
            later = np.flatnonzero(ids[row[order]] > np.repeat(ids[row[first]], np.diff(np.r_[starts, len(order)])))
            found = {"bucket": [], "docs": [], "counts": [], "keys": [], "finding": []}

            def add(bucket, at, finding):
                docs, counts = np.unique(row[at], return_counts=True)
                found["bucket"].append(int(bucket))
                found["docs"].append(planes(np.diff(ids[docs], prepend=0)))
                found["counts"].append(planes(counts.astype(np.int64)))
                found["keys"].append(planes(key[at], _KEY_BYTES))
                found["finding"].append(finding)

            first.sort()
            by = first[np.argsort(block[first], kind="stable")]
            for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                add(block[part[0]], part, False)
            if len(later):
                late = np.sort(order[later])
                add(int(ids[0]) % n_blocks, late, True)
            yield pa.RecordBatch.from_pydict(found, schema=_SHIPPED)

    return run


_SHIPPED = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()),
                      ("finding", pa.bool_())])


def _look_up(n_groups: int):
    """One block at a time: the smallest document of each seed; the others that hold it have found it. Findings go out
    by group of documents, many documents a row."""

    def run(batches):
        columns = ["docs", "counts", "keys", "finding"]
        for _, held in by_bucket(batches, columns):
            docs, keys = [], []
            for d, c, x, finding in zip(*[held[c] for c in columns]):
                doc = np.repeat(np.cumsum(unplanes(d, np.int64)), unplanes(c, np.int64))
                if finding:
                    yield from _findings(doc, unplanes(x, np.uint64, _KEY_BYTES), n_groups)
                else:
                    docs.append(doc)
                    keys.append(x)
            if not docs:
                continue
            doc = np.concatenate(docs)
            key = np.concatenate([unplanes(x, np.uint64, _KEY_BYTES) for x in keys])
            # what has been taken apart or put in order goes at once: a block's arrays are large
            del docs, keys
            held.clear()
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            del order
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            least = np.minimum.reduceat(doc, starts)
            late = doc > np.repeat(least, np.diff(np.r_[starts, len(key)]))
            del starts, least
            yield from _findings(doc[late], key[late], n_groups)

    return run


def _findings(doc: np.ndarray, key: np.ndarray, n_groups: int):
    if not len(doc):
        return
    group = W.group_of(doc, n_groups)
    by = np.lexsort((doc, group))
    out = {c: [] for c in ("part", "docs", "counts", "keys")}
    for at in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        ids, counts = np.unique(doc[at], return_counts=True)
        out["part"].append(group[at[0]])
        out["docs"].append(planes(np.diff(ids, prepend=0)))
        out["counts"].append(planes(counts.astype(np.int64)))
        out["keys"].append(planes(key[at], _KEY_BYTES))
    yield pa.RecordBatch.from_pydict(out)


def _with_group(n_groups: int):
    """Texts with the group of their document; those without an id go anywhere."""

    def run(batches):
        for batch in batches:
            doc = batch["doc_id"].fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(W.group_of(doc, n_groups)), *batch.columns],
                                             names=["part", *batch.schema.names])

    return run


def _parsed(k: int, whole: bool):
    """Rows sorted by group, findings first: the greedy parse of each document against its findings, and what is left.
    A group's findings are held while its texts pass one by one; ``rest`` goes along as it is.
    With ``whole``, a text without findings goes along as ``whole`` in place of its words."""

    def run(batches):
        at, found = None, {}

        def parsed(batch, rows, out):
            cut = pa.RecordBatch.from_pydict(out, schema=_PARSED)
            return pa.RecordBatch.from_arrays([*cut.columns, batch["rest"].take(pa.array(rows, pa.int64()))],
                                              names=[*_PARSED.names, "rest"])

        for batch in batches:
            out, taken = {c: [] for c in _PARSED.names}, []
            held = 0
            rows = zip(*[batch[c] for c in ("part", "doc_id", "text", "docs", "counts", "keys")])
            for row, (part, doc, text, docs, counts, keys) in enumerate(rows):
                if part.as_py() != at:
                    at, found = part.as_py(), {}
                if docs.is_valid:
                    ids = np.cumsum(unplanes(docs.as_py(), np.int64)).tolist()
                    ends = np.cumsum(unplanes(counts.as_py(), np.int64))[:-1]
                    for i, x in zip(ids, np.split(unplanes(keys.as_py(), np.uint64, _KEY_BYTES), ends)):
                        found.setdefault(i, []).append(x)
                    continue
                raw = (text.as_py() or "").encode()
                tokens, spans = raw.split(), []
                if doc.as_py() in found:
                    h, _ = W.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    hit = np.flatnonzero(np.isin(W.rolling(h, k, _SEED) & _KEY, np.concatenate(found[doc.as_py()])))
                    if len(hit):
                        opens = np.r_[True, np.diff(hit) > k]
                        start = hit[opens]
                        end = hit[np.r_[opens[1:], True]] + k
                        spans = list(zip(start.tolist(), (end - start).tolist()))
                        for s, n in reversed(spans):
                            del tokens[s:s + n]
                removed = sum(n for _, n in spans)
                out["doc_id"].append(doc.as_py())
                out["n_words"].append(len(tokens) + removed)
                out["n_removed"].append(removed)
                out["kept"].append(b" ".join(tokens).decode() if spans or not whole else None)
                out["spans"].append([{"start": s, "length": n} for s, n in spans])
                out["whole"].append(text.as_py() if whole and not spans else None)
                taken.append(row)
                held += len(raw)
                if held > _BATCH:
                    yield parsed(batch, taken, out)
                    out, taken, held = {c: [] for c in _PARSED.names}, [], 0
            if taken:
                yield parsed(batch, taken, out)

    return run


_PARSED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                     ("whole", pa.string())])
_PARSED_DDL = ("doc_id long, n_words long, n_removed long, kept string, "
               "spans array<struct<start: long, length: long>>, whole string")


def _parse(docs: DataFrame, id_col: str, text_col: str, k: int, rest: Column, whole: bool) -> DataFrame:
    """The parse of each row of ``docs``, with ``rest`` of it."""
    small_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    named = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    n_blocks = bucket_count(texts, "text", BLOCK_BYTES)
    shipped = named.mapInArrow(
        released(_index_rows(k, n_blocks)), "bucket long, docs binary, counts binary, keys binary, finding boolean")
    n_groups = 4 * n_blocks
    found = shipped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        released(_look_up(n_groups)), "part long, docs binary, counts binary, keys binary")
    dealt = texts.mapInArrow(released(_with_group(n_groups)),
                             StructType([StructField("part", LongType()), *texts.schema.fields]))
    both = found.unionByName(dealt, allowMissingColumns=True)
    out = StructType([*StructType.fromDDL(_PARSED_DDL).fields, StructField("rest", texts.schema["rest"].dataType)])
    return both.repartition("part").sortWithinPartitions("part", F.col("docs").isNull()).mapInArrow(
        released(_parsed(k, whole)), out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space), spans.

    ``spans`` lists the removed (start, length) in words, ascending and apart: all words covered by a run of ``k``
    consecutive words of one document that also starts in a document with a smaller id. Runs are judged on the input.
    Words are compared by bytes, unchanged, as 64-bit hashes. Null and empty texts have no words; a document shorter
    than ``k`` words, or that repeats only itself, keeps all. Rows with equal ids are parts of one document for
    the comparison, but each keeps its own row; rows with a null id are compared with nothing and keep their words;
    other columns are ignored; an empty table gives no rows. Ids are integers."""
    return _parse(docs, id_col, text_col, k, F.lit(None).cast("boolean"), False).drop("whole", "rest")


def with_digest(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """``docs`` with the repeated spans taken out of ``text_col``; documents without one stay as they are, those with
    nothing left are dropped. The other columns travel with the text, so that it is shuffled once. Nulls, repeated ids
    and empty tables are as in ``remove_repeats``."""
    others = [c for c in docs.columns if c != text_col]
    parsed = _parse(docs, id_col, text_col, k, F.struct(*[F.col(f"`{c}`") for c in others]), True)
    return parsed.filter("n_removed = 0 OR kept != ''").select(*[
        F.coalesce("kept", "whole").alias(c) if c == text_col else F.col("rest").getField(c).alias(c)
        for c in docs.columns])


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
r AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT run, min(doc_id) AS least FROM r GROUP BY run HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r.doc_id, i + j AS at FROM r JOIN f USING (run), range(0, 13) AS t(j) WHERE r.doc_id > f.least),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) AS kept, count(*) AS n
      FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.at = c.at GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
