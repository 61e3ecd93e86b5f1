"""Ranked lexical search over bit-sliced Bloom signatures.

Each document's terms are hashed into a Bloom signature; a term that occurs often is put in once for every step of
occurrences it reaches. Signatures of one width are stored as slices, one bitmap over a block's documents for each bit, so
that the bitmaps of a term, joined by AND, show every document that may hold it (some that don't, none too few). The
slices of a query's terms, weighted by what the term is worth at the next step of occurrences and the document's length,
add up to an upper bound of each document's score.

A search reads the index twice. First, each item's documents with the highest bounds are scored exactly, which gives the
score to beat. Then all documents whose bound is not below that are scored exactly from their whole texts; the others
are provably not among the results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baleprice.llm import words as W
from baleprice.llm.common import scratch, written

#: Terms are runs of ASCII letters, digits and any other character from 128 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
#: Steps of occurrences that have a key of their own: 1 to 4, then 6, 8, 12, 16 and so on.
STEPS = np.array([1, 2, 3, *[m << e for e in range(1, 30) for m in (2, 3)]], np.int64)
#: Bits of a signature for each key, at least (the width is the next power of two), and bits set for a key.
BITS_PER_KEY, HASHES = 10, 4
#: Documents and bits of one block, at most; text that is indexed at a time.
BLOCK_DOCS, BLOCK_BITS, _BATCH = 1024, 1 << 23, 4 << 20
#: Terms of the queries that are searched at a time; a longer item comes alone. Values held for a block's part at a time.
QUERY_TERMS, _CELLS = 20_000, 1 << 22
#: Documents of each item that are scored first.
FIRST = 16


def _key(terms: np.ndarray, step: int) -> np.ndarray:
    return W.mix(terms + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % (1 << 64)))


def _positions(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits of each key in a signature of ``width`` bits, a power of two."""
    a, b = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


def _counted(text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: their lengths in terms, and (row, term, occurrences) of each distinct term of each."""
    h, bounds = W.word_hashes(*W.buffers(text), lower=True, separator=W.PUNCTUATED)
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][:len(h)])
    return lengths, row[new], h[new], np.diff(np.r_[new, len(h)])


def _block(width: int, docs: list) -> dict:
    """A block of documents (id, whether it is null, length, keys' bits) as slices."""
    slices = np.zeros((width, -(-len(docs) // 8)), np.uint8)
    for i, (_, _, _, at) in enumerate(docs):
        slices[at, i >> 3] |= np.uint8(0x80 >> (i & 7))
    return {"width": width, "ids": np.array([d[0] for d in docs], np.int64).tobytes(),
            "named": np.array([d[1] for d in docs], bool).tobytes(),
            "lengths": np.array([d[2] for d in docs], np.int64).tobytes(), "slices": slices.tobytes(),
            "terms": None, "holders": None}


_INDEX = pa.schema([("width", pa.int64()), ("ids", pa.binary()), ("named", pa.binary()), ("lengths", pa.binary()),
                    ("slices", pa.binary()), ("terms", pa.binary()), ("holders", pa.binary())])
_INDEX_DDL = "width long, ids binary, named binary, lengths binary, slices binary, terms binary, holders binary"


def _slices(batches):
    """Blocks of signatures, documents of like width together, and of each batch the terms with their documents."""
    open_blocks: dict[int, list] = {}

    def rows(found: list[dict]):
        return pa.RecordBatch.from_pylist(found, schema=_INDEX)

    for batch in batches:
        size = np.cumsum(batch["size"].to_numpy())
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + _BATCH, "right")))
            part = batch.slice(start, stop - start)
            start = stop
            lengths, row, terms, times = _counted(part["text"])
            ids, named = part["doc_id"].to_numpy(), part["named"].to_numpy(zero_copy_only=False)
            held, holders = np.unique(terms, return_counts=True)
            found = [dict.fromkeys(_INDEX.names) | {"terms": held.tobytes(), "holders": holders.astype(np.int64).tobytes()}]
            reached = [np.flatnonzero(times >= step) for step in STEPS if len(times) and step <= times.max()]
            owner = np.concatenate([row[at] for at in reached]) if reached else row
            keys = np.concatenate([_key(terms[at], i) for i, at in enumerate(reached)]) if reached else terms
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(ids) + 1))
            for i in np.flatnonzero(lengths):
                own = keys[order[ends[i]:ends[i + 1]]]
                width = max(64, 1 << int(BITS_PER_KEY * len(own) - 1).bit_length())
                held_docs = open_blocks.setdefault(width, [])
                held_docs.append((ids[i], named[i], lengths[i], _positions(own, width).astype(np.int32).reshape(-1)))
                if len(held_docs) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // width)):
                    found.append(_block(width, open_blocks.pop(width)))
            yield rows(found)
    for width in sorted(open_blocks):
        yield rows([_block(width, open_blocks[width])])


def _terms(batches):
    for batch in batches:
        for terms, holders in zip(batch["terms"], batch["holders"]):
            yield pa.RecordBatch.from_pydict({"term": np.frombuffer(terms.as_py(), np.int64),
                                              "holders": np.frombuffer(holders.as_py(), np.int64)})


@dataclass
class Index:
    """Signatures of all documents with a term, the documents of each term, and their numbers."""
    docs: DataFrame
    blocks: DataFrame
    holders: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of ``docs``, written to the shared folder: about a fifth of the size of the texts."""
    named = F.col(id_col).cast("long")
    rows = docs.select(named.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text",
                       F.octet_length("text").cast("long").alias("size"))
    index = written(read.mapInArrow(_slices, _INDEX_DDL), "signatures")
    blocks = index.filter("width IS NOT NULL").select("width", "ids", "named", "lengths", "slices")
    pairs = index.filter("terms IS NOT NULL").select("terms", "holders").mapInArrow(_terms, "term long, holders long")
    holders = written(pairs.groupBy("term").agg(F.sum("holders").alias("df")), "holders")
    sizes = blocks.select("lengths").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return Index(rows, blocks, holders, sizes[0] or 0, sizes[1] or 0)


def _sizes(batches):
    for batch in batches:
        lengths = [np.frombuffer(x, np.int64) for x in batch["lengths"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"docs": [len(x) for x in lengths], "terms": [int(x.sum()) for x in lengths]})


def _worth(weight, times, lengths, index: tuple[int, int]):
    """What ``times`` occurrences of a term of ``weight`` add to the score of documents of ``lengths`` terms."""
    n_docs, n_terms = index
    m = 10 + (90 * lengths * n_docs) // n_terms
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * m))


@dataclass
class _Queries:
    """Some items: the distinct terms and weights of all, and which of them each item holds."""
    terms: np.ndarray
    weights: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    totals: tuple[int, int]


def _bounds(block: dict, q: _Queries) -> Iterator[tuple[np.ndarray, slice]]:
    """The upper bounds (items x documents) of one block, some documents at a time."""
    width, lengths = block["width"], np.frombuffer(block["lengths"], np.int64)
    slices = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
    step = max(8, _CELLS // len(q.flat) // 8 * 8)
    at = [_positions(_key(q.terms, 0), width)]
    for low in range(0, len(lengths), step):
        part = slices[:, low // 8:(low + step) // 8]
        inside = slice(low, min(low + step, len(lengths)))
        present = part[at[0][:, 0]]
        for j in range(1, HASHES):
            present = present & part[at[0][:, j]]
        term, doc = np.nonzero(np.unpackbits(present, axis=1))
        reached, more = np.zeros(len(term), np.int64), np.arange(len(term))
        for s in range(1, len(STEPS) - 1):
            if len(at) == s:
                at.append(_positions(_key(q.terms, s), width))
            bits = part[at[s][term[more]], (doc[more] >> 3)[:, None]] >> (7 - (doc[more] & 7))[:, None].astype(np.uint8) & 1
            more = more[bits.all(axis=1)]
            if not len(more):
                break
            reached[more] = s
        long = lengths[low + doc]
        worth = np.zeros((len(q.terms), inside.stop - low))
        worth[term, doc] = _worth(q.weights[term], np.minimum(STEPS[reached + 1] - 1, long), long, q.totals)
        yield np.add.reduceat(worth[q.flat], q.starts, axis=0), inside


_CANDIDATES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("bound", pa.int64())])


def _rows(batches) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)


def _highest(q: _Queries, n: int):
    """The ``n`` documents with the highest bounds of each item, for each task."""

    def run(batches):
        items = len(q.starts)
        best, ids, named = np.zeros((items, n)), np.zeros((items, n), np.int64), np.zeros((items, n), bool)
        for block, its, names in _rows(batches):
            for bounds, part in _bounds(block, q):
                some = np.flatnonzero((bounds > best.min(axis=1)[:, None]).any(axis=1))
                if not len(some):
                    continue
                both = np.concatenate([best[some], bounds[some]], axis=1)
                top = np.argpartition(both, both.shape[1] - n, axis=1)[:, -n:]
                wide = lambda old, new: np.concatenate([old[some], np.broadcast_to(new[part], bounds[some].shape)], axis=1)
                ids[some] = np.take_along_axis(wide(ids, its), top, axis=1)
                named[some] = np.take_along_axis(wide(named, names), top, axis=1)
                best[some] = np.take_along_axis(both, top, axis=1)
        item, place = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids[item, place], mask=~named[item, place]),
                                          pa.array(best[item, place].astype(np.int64))], schema=_CANDIDATES)

    return run


def _not_excluded(q: _Queries, least: np.ndarray, last: np.ndarray):
    """All documents with a bound above ``least`` of an item, or equal to it with an id up to ``last``."""

    def run(batches):
        for block, its, names in _rows(batches):
            for bounds, part in _bounds(block, q):
                order = np.where(names[part], its[part], np.iinfo(np.int64).max)
                item, doc = np.nonzero((bounds > least[:, None]) | ((bounds == least[:, None]) & (order <= last[:, None])))
                if len(item):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item), pa.array(its[part][doc], mask=~names[part][doc]),
                         pa.array(bounds[item, doc].astype(np.int64))], schema=_CANDIDATES)

    return run


def _exact(items: list[dict[str, int]], totals: tuple[int, int]):
    """The scores of the texts that come with the items they are candidates of; scores of 0 are left out."""

    def run(batches):
        for batch in batches:
            out = {"item": [], "doc_id": [], "score": [], "copy": []}
            for doc, text, asked in zip(batch["doc_id"], batch["text"], batch["asked"]):
                raw = text.as_py()
                times = Counter(_TERM.findall(raw.translate(_TO_LOWER)))
                # decides between rows with one id and one score
                copy = int.from_bytes(hashlib.blake2b(raw.encode(), digest_size=8).digest(), signed=True)
                length = sum(times.values())
                for item in asked.as_py():
                    held = items[item].keys() & times.keys()
                    score = sum(_worth(items[item][t], times[t], length, totals) for t in held) if length else 0
                    if score > 0:
                        out["item"].append(item)
                        out["doc_id"].append(doc.as_py())
                        out["score"].append(score)
                        out["copy"].append(copy)
            yield pa.RecordBatch.from_pydict(out, schema=_SCORES)

    return run


_SCORES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("copy", pa.int64())])


def _scored(index: Index, candidates: DataFrame, items: list[dict[str, int]], k: int) -> DataFrame:
    """The ``k`` best of each item, from the exact scores of the candidates (item, doc_id)."""
    asked = written(candidates.select("item", F.col("doc_id").alias("id")), "candidates").groupBy("id").agg(
        F.collect_set("item").alias("asked"))
    scores = index.docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "asked").mapInArrow(
        _exact(items, (index.n_docs, index.n_terms)), "item long, doc_id long, score long, copy long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last(), "copy"))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


def _search_some(index: Index, texts: list[list[str]], k: int) -> DataFrame:
    """The ``k`` best documents (item, rank, doc_id, score) of some items, each a list of distinct terms."""
    spark = index.docs.sparkSession
    terms = sorted({t for its in texts for t in its})
    raw = "".join(t + " " for t in terms).encode()
    hashes = W.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), separator=W.PUNCTUATED)[0]
    asked = spark.createDataFrame(
        list(zip(range(len(terms)), hashes.view(np.int64).tolist())), "nth int, term long")
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.n_docs + 2) / (2 * F.coalesce("df", F.lit(0)) + 1))).cast("long")
    weights = np.zeros(len(terms), np.int64)
    for nth, value in asked.join(index.holders, "term", "left").select("nth", weight.alias("w")).collect():
        weights[nth] = value
    place = {t: i for i, t in enumerate(terms)}
    flat = np.array([place[t] for its in texts for t in its], np.int64)
    starts = np.cumsum([0, *[len(its) for its in texts]])[:-1]
    q = _Queries(hashes, weights, flat, starts, (index.n_docs, index.n_terms))
    items = [{t: int(weights[place[t]]) for t in its} for its in texts]
    ddl = "item long, doc_id long, bound long"
    best = index.blocks.mapInArrow(_highest(q, max(FIRST, k)), ddl)
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
    first = _scored(index, best.withColumn("nth", nth).filter(F.col("nth") <= max(FIRST, k)), items, k)
    least, last = np.ones(len(texts)), np.full(len(texts), np.iinfo(np.int64).max)
    for item, doc, score in first.filter(F.col("rank") == k).select("item", "doc_id", "score").collect():
        least[item] = score
        last[item] = np.iinfo(np.int64).max if doc is None else doc
    left = index.blocks.mapInArrow(_not_excluded(q, least, last), ddl)
    return _scored(index, left, items, k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: item_id, rank (from 1), doc_id, score.

    A document's score is the sum, over the item's distinct terms, of w * ((10**9 * tf) div (1000 * tf + 8 * m)), where w is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 10 + (90 * n * N) div L; N documents have a term, they have L in
    all, df of them hold the term, the document has n terms and tf times this one. Scores of 0 are left out, equal scores
    come by ascending id, null last, rows with one id by their text. Only A-Z are lower-cased. Documents that are null,
    empty or without a term are in no result and no count; every row is a document of its own, repeated rows and ids too.
    Rows of ``items`` with one id are one item with the terms of all, rows with a null id too; items without a term get no
    rows. An empty table on either side gives no rows. Other columns are ignored. Ids are integers.

    The items come to the driver some at a time, as many as have ``QUERY_TERMS`` terms or one; every such lot reads the
    index twice."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    low = F.translate(F.coalesce(F.col(query_col), F.lit("")), _UPPER, _LOWER)
    asked = written(items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(
        F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id").agg(
        F.array_sort(F.collect_set("term")).alias("terms")), "items")
    base, lots, lot, held = scratch(spark, "hits"), 0, [], 0

    def search_lot():
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(lot)], "item long, item_id long")
        hits = _search_some(index, [its for _, its in lot], k)
        hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{base}/lot={lots}")

    for name, its in asked.toLocalIterator() if index.n_docs else ():
        if lot and held + len(its) > QUERY_TERMS:
            search_lot()
            lots, lot, held = lots + 1, [], 0
        lot.append((name, its))
        held += len(its)
    if not lot:
        return spark.createDataFrame([], _FOUND)
    search_lot()
    return spark.read.schema(_FOUND).parquet(base).drop("lot")


_FOUND = "item_id long, rank int, doc_id long, score long"

ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
z AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), z GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
