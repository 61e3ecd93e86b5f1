"""N-gram Jaccard join through a token-group matrix.

Similar documents form groups, a group's token union bounds what a document can share with any of its members, and only
groups whose bound reaches the threshold are opened. Two levels of groups keep it exact and cheap:

1. All other documents are one group. A document whose tokens don't occur in enough others can link with none. The
   union is looked up in a packed shuffle of token hashes, of each document's tokens up to the place in hash order that
   the threshold needs.
2. Documents that pass are grouped by min-hash, and compared with a few leaders of their group; verified links make
   components. Against the unions of *other* components the bound is taken again; few documents pass.
3. For these, the matrix (token, group) is a table of the rarest tokens. It finds the groups that a document may share
   enough with; there the overlap with the group's token union is counted, and only if that reaches the threshold is
   the group opened and its members compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baleprice.llm import words as W
from baleprice.llm.common import (bucket_count, by_bucket, components, fresh, planes, released, small_arrow_batches,
                                  text_batches, unplanes, written)

SHINGLE = 5
_SEED = 0xE7037ED1A0B428DB
_BATCH, BUCKET_BYTES = 8 << 20, 16 << 20
_NOBODY = np.iinfo(np.int64).min
#: Leaders that a document is compared with in the grouping, and documents of a group in one task at least; links that
#: this misses are found by level 3.
LEADERS, GROUP = 8, 2000
#: Min-hashes: one makes the first groups, the others those of what the second bound lets pass.
LOWS = 8


def _needed(n, percent: int):
    """The least overlap a set of n tokens must have with any set that it links to."""
    return -(-percent * n // 100)


def _extra(n):
    """By how much the looked-up prefix of a set is longer than needed for one hit: then so many hits are needed."""
    return -(-n // 10)


def token_sets(table: pa.Table) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts: their whole word sequence as one."""
    h, bounds = W.word_hashes(*W.buffers(table["text"]), lower=True)
    shingles = W.rolling(h, SHINGLE, _SEED)
    out = []
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s >= SHINGLE:
            out.append(np.unique(shingles[s:e - SHINGLE + 1]))
        elif e > s:
            out.append(W.rolling(h[s:e], e - s, _SEED) ^ np.uint64(e - s))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SIZES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary())])


def _sizes(batches):
    for table in text_batches(batches, _BATCH):
        sets = token_sets(table)
        yield pa.RecordBatch.from_pydict({
            "doc_id": table["doc_id"].to_numpy(), "n": np.array([len(s) for s in sets], np.int64),
            "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]},
            schema=_SIZES)


def _sets(batches):
    for table in text_batches(batches, _BATCH):
        sets = token_sets(table)
        low = [[int(W.mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))).min(
            initial=np.uint64((1 << 64) - 1)).view(np.int64)) for j in range(LOWS)] for s in sets]
        yield pa.RecordBatch.from_pydict({
            "doc_id": table["doc_id"].to_numpy(), "n": np.array([len(s) for s in sets], np.int64),
            "tokens": [s.tobytes() for s in sets], "low": low}, schema=_SETS)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("low", pa.list_(pa.int64()))])


_SHIPPED = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()),
                      ("tokens", pa.binary())])
_SHIPPED_DDL = "bucket long, docs binary, owners binary, counts binary, tokens binary"


def prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    return tokens[:n - _needed(n, percent) + _extra(n)]


def _ship(ids: np.ndarray, owners: np.ndarray, cut: list[np.ndarray], n_buckets: int):
    """Some sets, or prefixes of sets, by bucket. Tokens that two owners in this batch share count at once; one nameless
    copy of each goes on for the others, so a token that everybody has costs one entry a batch."""
    lengths = np.array([len(c) for c in cut])
    if not lengths.sum():
        return
    token = np.concatenate(cut)
    row = np.repeat(np.arange(len(cut)), lengths)
    order = np.argsort(token)
    t, r = token[order], row[order]
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    sizes = np.diff(np.r_[starts, len(t)])
    own = owners[r]
    many = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    shared = np.repeat(many, sizes)
    local = np.bincount(r[shared], minlength=len(ids))
    single = np.sort(order[~shared])
    token_1 = np.r_[t[starts[many]], token[single]]
    row_1 = np.r_[np.full(int(many.sum()), -1), row[single]]
    mixed = W.mix(token_1)
    bucket = (mixed >> np.uint64(32)) % np.uint64(n_buckets)
    by = np.argsort(bucket, kind="stable")
    out = {c: [] for c in _SHIPPED.names}

    def add(b, docs, own, counts, tokens):
        for c, v in zip(_SHIPPED.names, (int(b), planes(docs), planes(own), planes(counts.astype(np.int64)),
                                         planes(tokens.astype(np.uint32)))):
            out[c].append(v)

    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        rows, counts = np.unique(row_1[part], return_counts=True)
        nameless = rows < 0
        docs = np.where(nameless, _NOBODY, ids[np.maximum(rows, 0)])
        add(bucket[part[0]], docs, np.where(nameless, _NOBODY, owners[np.maximum(rows, 0)]), counts,
            mixed[part] & np.uint64(0xFFFFFFFF))
    hit = np.flatnonzero(local)
    if len(hit):
        add(int(ids[0]) % n_buckets, ids[hit], ids[hit], local[hit], np.zeros(0, np.uint64))
    yield pa.RecordBatch.from_pydict(out, schema=_SHIPPED)


def _ship_texts(percent: int, n_buckets: int):
    def run(batches):
        for table in text_batches(batches, _BATCH):
            ids = table["doc_id"].to_numpy()
            yield from _ship(ids, ids, [prefix(s, percent) for s in token_sets(table)], n_buckets)
    return run


def _ship_sets(n_buckets: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [np.frombuffer(x, np.uint64) for x in part["tokens"].to_pylist()]
                yield from _ship(part["doc_id"].to_numpy(), part["owner"].to_numpy(), sets, n_buckets)
    return run


def _packed(docs: np.ndarray, hits: np.ndarray, n_groups: int):
    """Hits of documents, a row for each group of documents."""
    if not len(docs):
        return
    group = W.group_of(docs, n_groups)
    by = np.lexsort((docs, group))
    out = {c: [] for c in ("bucket", "docs", "hits")}
    for at in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        out["bucket"].append(group[at[0]])
        out["docs"].append(planes(np.diff(docs[at], prepend=0)))
        out["hits"].append(planes(hits[at].astype(np.int64)))
    yield pa.RecordBatch.from_pydict(out)


def _count(n_groups: int):
    """One bucket at a time: how many of a document's tokens another owner has too, by group of documents."""

    def run(batches):
        columns = ["docs", "owners", "counts", "tokens"]
        for _, held in by_bucket(batches, columns):
            docs, owners, tokens = [], [], []
            for d, o, c, t in zip(*[held[c] for c in columns]):
                doc, count = unplanes(d, np.int64), unplanes(c, np.int64)
                if not t:
                    yield from _packed(doc, count, n_groups)
                    continue
                docs.append(np.repeat(doc, count))
                owners.append(np.repeat(unplanes(o, np.int64), count))
                tokens.append(unplanes(t, np.uint32))
            if not docs:
                continue
            doc, own, token = np.concatenate(docs), np.concatenate(owners), np.concatenate(tokens)
            order = np.argsort(token)
            t, own, doc = token[order], own[order], doc[order]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            many = ((np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts))
                    | (np.minimum.reduceat(own, starts) == _NOBODY))
            doc = doc[np.repeat(many, np.diff(np.r_[starts, len(t)]))]
            yield from _packed(*np.unique(doc[doc != _NOBODY], return_counts=True), n_groups)

    return run


def _total(batches):
    """One group of documents at a time: the hits of each document over all buckets."""
    for _, held in by_bucket(batches, ["docs", "hits"]):
        doc = np.concatenate([np.cumsum(unplanes(d, np.int64)) for d in held["docs"]])
        hits = np.concatenate([unplanes(h, np.int64) for h in held["hits"]])
        ids, at = np.unique(doc, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, hits)
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "hits": total})


def _may_link(shipped: DataFrame, sizes: DataFrame, least: Column, n_groups: int) -> DataFrame:
    """The rows of ``sizes`` (doc_id, n) with at least ``least`` tokens that another owner has too."""
    packed = shipped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        released(_count(n_groups)), "bucket long, docs binary, hits binary")
    hits = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_total), "doc_id long, hits long")
    return sizes.join(hits, "doc_id").filter(F.col("hits") >= least).drop("hits")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _lead(percent: int):
    """Rows sorted by group: links of documents with a leader of their group that has another owner so far, as links
    of their owners."""

    def run(batches):
        at, leaders, joined = None, [], {}

        def root(owner):
            while joined.get(owner, owner) != owner:
                owner = joined[owner]
            return owner

        for batch in batches:
            u, v = [], []
            rows = zip(*[batch[c].to_pylist() for c in ("owner", "j", "low", "salt", "tokens")])
            for owner, *group, raw in rows:
                if group != at:
                    at, leaders, joined = group, [], {}
                tokens = np.frombuffer(raw, np.uint64)
                for its, held in leaders:
                    if root(its) != root(owner) and _linked(tokens, held, percent):
                        u.append(owner)
                        v.append(its)
                        joined[root(owner)] = root(its)
                if all(root(its) != root(owner) or len(held) * 10 < len(tokens) * 9 for its, held in leaders):
                    leaders = [*leaders, (owner, tokens)][-LEADERS:]
            if u:
                yield pa.RecordBatch.from_pydict({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return run


def _grouped_links(sets: DataFrame, percent: int, lows: range) -> DataFrame:
    """Verified links to leaders of other owners, over groups by some min-hashes. ``sets``: doc_id, owner, tokens, low.

    A group of more than ``GROUP`` documents is dealt to as many tasks as it needs."""
    narrow = sets.select("owner", F.posexplode(F.slice("low", lows.start + 1, len(lows))).alias("j", "low"))
    sizes = written(narrow.groupBy("j", "low").agg(
        F.ceil(F.count("*") / GROUP).alias("salts"), F.min("owner").alias("a"), F.max("owner").alias("b")).filter(
        "a != b AND salts > 1").select("j", "low", "salts"), "large")
    rows = sets.select("doc_id", "owner", "tokens", F.posexplode(F.slice("low", lows.start + 1, len(lows))).alias("j", "low"))
    dealt = rows.join(sizes, ["j", "low"], "left").withColumn("salt", F.pmod(
        F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))).select("doc_id", "owner", "j", "low", "salt", "tokens")
    return written(dealt.repartition("j", "low", "salt").sortWithinPartitions("j", "low", "salt", "doc_id").mapInArrow(
        released(_lead(percent)), "u long, v long"), "leaders")


def _open_groups(percent: int):
    """Rows sorted by group, members first. The group's token union bounds its overlap with each asking document; where
    that reaches what a link needs, the group is opened: the document's link with its owner, if there is one."""

    def run(batches):
        at, members, union = None, [], None
        for batch in batches:
            u, v = [], []
            rows = zip(*[batch[c].to_pylist() for c in ("grp", "asks", "owner", "tokens")])
            for group, asks, owner, raw in rows:
                if group != at:
                    at, members, union = group, [], None
                tokens = np.frombuffer(raw, np.uint64)
                if not asks:
                    members.append((owner, tokens))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([held for _, held in members]))
                place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                if int((union[place] == tokens).sum()) < _needed(len(tokens), percent):
                    continue
                for other, held in members:
                    if _linked(tokens, held, percent):
                        u.append(owner)
                        v.append(other)
                        break
            if u:
                yield pa.RecordBatch.from_pydict({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return run


def _matrix_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between different owners, by the token-group matrix. ``sets``: doc_id, owner, n, tokens, low.

    A group is an owner's documents with two equal min-hashes, dealt to as many groups as hold ``GROUP`` documents
    each; all its members have one owner, so that one link of a document to it is enough."""
    alike = ["owner", "low1", "low2"]
    sets = sets.withColumn("low1", F.element_at("low", 1)).withColumn("low2", F.element_at("low", 2)).drop("low")
    large = written(sets.groupBy(alike).agg(F.ceil(F.count("*") / GROUP).alias("salts")).filter("salts > 1"), "large")
    sets = sets.join(large, alike, "left").withColumn("grp", F.xxhash64(*alike, F.pmod(
        F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))))).drop("low1", "low2", "salts")
    tokens = sets.select("doc_id", "tokens").mapInArrow(released(_longs), "doc_id long, tokens array<long>")
    cells = written(tokens.join(sets.select("doc_id", "owner", "grp", "n"), "doc_id").select(
        "doc_id", "owner", "grp", "n", F.explode("tokens").alias("token")), "cells")
    held = cells.groupBy("token").agg(F.count("*").alias("holders"), F.min("owner").alias("a"), F.max("owner").alias("b"))
    ranked = cells.join(held, "token").withColumn("rank", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("holders", "token")))
    # sets of n and m tokens that link share at least share * (n + m), so one of the rarest n + 1 - share * (n + m) of
    # the one and one of as many of the other
    share = percent / (100 + percent)
    probes = written(ranked.filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
                                   & (F.col("a") != F.col("b"))).select("doc_id", "owner", "grp", "n", "token", "rank"), "probes")
    matrix = probes.groupBy("token", F.col("grp").alias("asked")).agg(
        F.min("owner").alias("owner2"), F.min("n").alias("least"),
        F.max(F.col("n") * (1 - share) + 1 - F.col("rank")).alias("slack"))
    near = probes.join(matrix, "token").filter(
        (F.col("owner") != F.col("owner2")) & (F.col("slack") + 1e-6 >= F.col("n") * share)
        & (F.col("rank") <= F.col("n") + 1 + 1e-6 - (F.col("n") + F.col("least")) * share)).select(
        "doc_id", F.col("asked").alias("grp")).distinct()
    asking = near.join(sets.select("doc_id", "owner", "tokens"), "doc_id").withColumn("asks", F.lit(True))
    members = sets.select("doc_id", "grp", "owner", "tokens", F.lit(False).alias("asks"))
    return asking.unionByName(members).repartition("grp").sortWithinPartitions("grp", "asks", "doc_id").mapInArrow(
        released(_open_groups(percent)), "u long, v long")


def _longs(batches):
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch["tokens"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "tokens": sets}, schema=pa.schema(
            [("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))]))


def _with_other_owners(sets: DataFrame, owners: DataFrame, needed: Column, n_buckets: int) -> DataFrame:
    """The sets, each ``owner`` replaced by its component among ``owners``, that share enough tokens with others."""
    owned = _component_of(sets, "owner", owners)
    passed = _may_link(owned.select("doc_id", "owner", "tokens").mapInArrow(released(_ship_sets(n_buckets)), _SHIPPED_DDL),
                       owned.select("doc_id", "n"), needed, n_buckets)
    return written(owned.join(written(passed.select("doc_id"), "passed"), "doc_id"), "owned")


def _component_of(rows: DataFrame, col: str, owners: DataFrame) -> DataFrame:
    """``rows`` with ``col`` replaced by its component, where it has links."""
    found = owners.select(F.col("node").alias("_node"), "component")
    return rows.join(found, F.col(col) == F.col("_node"), "left").withColumn(col, F.coalesce("component", col)).drop(
        "_node", "component")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reachable by links, itself included).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct 5-word shingles, A-Z
    lower-cased; shorter texts are one shingle; null and empty texts have none and link with nothing. Shingles are
    compared as 64-bit hashes. No link between different texts is lost: every bound used is one that all linked sets
    satisfy, and equal sets are one class from the start. Rows with equal ids count as the largest of their sets; rows with a null
    id stay, a row each with a null component, as no link could name them; other columns are ignored; an empty table gives
    no rows."""
    small_arrow_batches(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = every.filter("doc_id IS NOT NULL")
    nameless = every.filter("doc_id IS NULL").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(
        released(_sizes), "doc_id long, n long, key binary").select(
        F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    n_buckets = bucket_count(texts, "text", BUCKET_BYTES)
    sizes = written(texts.mapInArrow(released(_sizes), "doc_id long, n long, key binary").groupBy("doc_id").agg(
        F.max(F.struct("n", "key")).alias("s")).select("doc_id", "s.n", "s.key"), "sizes")
    classes = sizes.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("class"), F.max("n").alias("n"))
    needed = F.ceil(F.col("n") * percent / 100)
    passed = _may_link(texts.mapInArrow(released(_ship_texts(percent, n_buckets)), _SHIPPED_DDL),
                       classes.select(F.col("class").alias("doc_id"), "n"), F.ceil(needed / 10), n_buckets)
    sets = written(texts.join(passed.select("doc_id"), "doc_id").mapInArrow(
        released(_sets), "doc_id long, n long, tokens binary, low array<long>").join(
        passed, ["doc_id", "n"], "left_semi").dropDuplicates(["doc_id"]), "sets")
    # links are links of owners, the components so far: each step's graph has only the links that are new
    owned = sets.withColumn("owner", F.col("doc_id"))
    first = components(_grouped_links(owned, percent, range(1)))
    some = _with_other_owners(owned, first, needed, n_buckets)
    second = components(_grouped_links(some, percent, range(1, LOWS)))
    few = _with_other_owners(some, second, needed, n_buckets)
    # written first, so that no task has a Python worker for the links and another for their components
    third = components(written(_matrix_links(few, percent), "matrix"))
    label = sizes.join(classes.drop("n"), "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))
    for owners in (first, second, third):
        label = _component_of(label, "component_id", owners)
    return label.unionByName(nameless)


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the least id. Of rows with one id, all that differ
    in their text stay if the id stays; a repeated row stays once. Rows with a null id stay as they are."""
    least, text = fresh(docs, "least", "text_hash")
    kept = jaccard_components(docs, id_col, text_col, percent).filter("doc_id = component_id").select(
        F.col("doc_id").alias(least))
    named = docs.join(kept, F.col(id_col) == F.col(least), "left_semi").withColumn(
        text, F.xxhash64(text_col)).dropDuplicates([id_col, text]).drop(text)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM t a JOIN t b ON a.s = b.s AND a.doc_id != b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
c(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.node, l.v FROM c JOIN l ON l.u = c.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d
  JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
