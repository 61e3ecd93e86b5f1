"""Hard-negative mining by threshold joins on a partial inverted index.

Vectors are scaled to integers and dealt to blocks. For a threshold, a block's index holds, for each dimension, the vectors
that have it in their indexed part: a vector's first dimensions, those of least energy, are left out as long as the
norms of what is left out can't reach the threshold by themselves. Partial scores are accumulated over the indexed
dimensions; a pair goes on only while its partial score and the norms that remain can reach the threshold, and is then
completed from the dimensions left out. So a join finds exactly the pairs at or above the threshold.

Each window (an anchor's positives; the negatives under a positive's score) is first joined at a high threshold, which is
lowered for those windows that aren't full, down to the window's own end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baleprice.llm.common import scratch, written

#: Vectors of one block, and bytes of anchors that are joined with all blocks at a time.
BLOCK_ROWS, ANCHOR_BYTES = 2048, 4 << 20
#: Anchors and dimensions that are accumulated at a time.
_ANCHORS, _CHUNK = 512, 8
#: Thresholds for positives, as shares of the largest possible score; then all rows of the label.
POSITIVE_STEPS = (0.8, 0.5, 0.3, 0.15)
#: Thresholds for negatives, as shares of the way from the window's upper to its lower end.
NEGATIVE_STEPS = (0.1, 0.4, 1.0)
_EXACT, _LAST = float(1 << 53), np.iinfo(np.int64).max

_BLOCK = pa.schema([("dim", pa.int64()), ("ids", pa.binary()), ("named", pa.binary()), ("labels", pa.binary()),
                    ("anchors", pa.binary()), ("norm", pa.float64()), ("x", pa.binary())])
_BLOCK_DDL = "dim long, ids binary, named binary, labels binary, anchors binary, norm double, x binary"


def _matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) of each dimension in a batch, without vectors that hold a null or non-finite component."""
    lists = batch["vector"]
    lengths = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = values[starts[rows][:, None] + np.arange(dim)]
        whole = np.isfinite(x).all(axis=1)
        yield rows[whole], np.floor(scale * x[whole])


def _blocks(scale: float):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                for rows, x in _matrices(part, scale):
                    if not len(rows):
                        continue
                    if np.abs(x).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] >= _EXACT:
                        raise OverflowError("scores of these vectors don't fit whole numbers of 53 bits")
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_pylist([{
                        "dim": x.shape[1], "ids": own["vec_id"].to_numpy().tobytes(),
                        "named": own["named"].to_numpy(zero_copy_only=False).tobytes(),
                        "labels": own["label"].to_numpy().tobytes(),
                        "anchors": own["anchor"].to_numpy(zero_copy_only=False).tobytes(),
                        "norm": float(np.sqrt((x * x).sum(axis=1)).max()), "x": x.tobytes()}], schema=_BLOCK)

    return run


@dataclass
class _Rows:
    ids: np.ndarray
    named: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    def take(self, at) -> "_Rows":
        return _Rows(self.ids[at], self.named[at], self.labels[at], self.x[at])


def _read(batches) -> Iterator[_Rows]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield _Rows(ids, np.frombuffer(row["named"], bool), np.frombuffer(row["labels"], np.int64),
                        np.frombuffer(row["x"], np.float64).reshape(len(ids), row["dim"]))


def _anchors(batches):
    """The anchors of the blocks, a row each."""
    for batch in batches:
        for block in batch.to_pylist():
            is_anchor = np.frombuffer(block["anchors"], bool)
            ids = np.frombuffer(block["ids"], np.int64)
            labels = np.frombuffer(block["labels"], np.int64)
            x = np.frombuffer(block["x"], np.float64).reshape(len(ids), -1)
            at = np.flatnonzero(is_anchor)
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "dim": np.full(len(at), block["dim"], np.int64), "anchor_id": ids[at], "label": labels[at],
                    "x": [x[i].tobytes() for i in at]}, schema=_ANCHOR)


_ANCHOR = pa.schema([("dim", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])
_ANCHOR_DDL = "dim long, anchor_id long, label long, x binary"


def _prefix_norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1))


def joined(q: np.ndarray, least: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (anchor, vector, score) with a score of at least the anchor's ``least``; integer values."""
    dim = x.shape[1]
    by_energy = np.argsort((x * x).sum(axis=0), kind="stable")
    q, x = q[:, by_energy], x[:, by_energy]
    q_norms, x_norms = _prefix_norms(q), _prefix_norms(x)
    edges = [*range(0, dim, _CHUNK), dim]
    # the dimensions before a vector's cut aren't indexed: their norms alone stay below every anchor's threshold
    under = x_norms[:, edges] * q_norms.max(axis=0)[edges] * (1 + 1e-9) + 1e-6 < least.min()
    cut = np.where(under.all(axis=1), len(edges) - 1, np.maximum(np.argmin(under, axis=1) - 1, 0))
    order = np.argsort(cut, kind="stable")
    x, x_norms, cut = x[order], x_norms[order], cut[order]
    listed = np.searchsorted(cut, np.arange(len(edges)), "right")
    found = []
    for low in range(0, len(q), _ANCHORS):
        own, floor = slice(low, low + _ANCHORS), least[low:low + _ANCHORS]
        n = listed[len(edges) - 2] if dim else len(x)
        score = np.zeros((len(floor), n))
        for c in range(len(edges) - 2, -1, -1):
            part = slice(edges[c], edges[c + 1])
            score[:, :listed[c]] += q[own, part] @ x[:listed[c], part].T
        first = np.array(edges)[cut[:n]]
        remaining = q_norms[own][:, first] * x_norms[np.arange(n), first]
        a, v = np.nonzero(score + remaining * (1 + 1e-9) + 1e-6 >= floor[:, None])
        s = score[a, v]
        for c in range(int(cut[:n].max(initial=0)) - 1, -1, -1):
            part = slice(edges[c], edges[c + 1])
            more = np.flatnonzero(cut[v] > c)
            s[more] += np.einsum("ij,ij->i", q[low + a[more], part], x[v[more], part])
            rest = q_norms[low + a, edges[c]] * x_norms[v, edges[c]]
            on = (cut[v] <= c) | (s + rest * (1 + 1e-9) + 1e-6 >= floor[a])
            a, v, s = a[on], v[on], s[on]
        on = s >= floor[a]
        found.append((a[on] + low, order[v[on]], s[on].astype(np.int64)))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


_FOUND = pa.schema([("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class _Best:
    """The first ``k`` rows of each window, by falling score and rising id, that a task has seen so far."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, window, order, score):
        self.held.append((window, order, score))
        self.size += len(window)
        if self.size > 1 << 18:
            self.reduce()

    def reduce(self):
        window, order, score = (np.concatenate(c) for c in zip(*self.held))
        by = np.lexsort((order, -score, window))
        window, order, score = window[by], order[by], score[by]
        new = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        nth = np.arange(len(window)) - np.repeat(new, np.diff(np.r_[new, len(window)]))
        keep = nth < self.k
        self.held, self.size = [(window[keep], order[keep], score[keep])], int(keep.sum())

    def rows(self):
        if self.size:
            self.reduce()
            window, order, score = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(order, mask=order == _LAST), pa.array(score)],
                                             schema=_FOUND)


def _positives(anchors: dict[int, tuple[_Rows, np.ndarray, np.ndarray]], k: int):
    """The best rows of an anchor's own label, but itself, at or above its threshold."""

    def run(batches):
        best = _Best(k)
        for rows in _read(batches):
            if rows.x.shape[1] not in anchors:
                continue
            asking, nth, least = anchors[rows.x.shape[1]]
            for label in np.intersect1d(asking.labels, rows.labels):
                q, r = np.flatnonzero(asking.labels == label), np.flatnonzero(rows.labels == label)
                a, v, s = joined(asking.x[q], least[q], rows.x[r])
                a, v = q[a], r[v]
                other = (rows.ids[v] != asking.ids[a]) | ~rows.named[v]
                best.add(nth[a[other]], np.where(rows.named[v], rows.ids[v], _LAST)[other], s[other])
        yield from best.rows()

    return run


def _negatives(anchors: dict[int, tuple], k: int):
    """The best rows of other labels in each window (least, most) of each anchor, at or above the window's threshold."""

    def run(batches):
        best = _Best(k)
        for rows in _read(batches):
            if rows.x.shape[1] not in anchors:
                continue
            asking, nth, least, most = anchors[rows.x.shape[1]]
            a, v, s = joined(asking.x, least.min(axis=1), rows.x)
            other = asking.labels[a] != rows.labels[v]
            a, v, s = a[other], v[other], s[other]
            pair, window = np.nonzero((s[:, None] >= least[a]) & (s[:, None] <= most[a]))
            best.add(nth[a[pair], window], np.where(rows.named[v], rows.ids[v], _LAST)[pair], s[pair])
        yield from best.rows()

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _find_positives(blocks: DataFrame, anchors: dict[int, _Rows], norm: float, others: dict, k: int) -> dict:
    """Of each anchor, (dim, its place) -> its positives, a list of (vec_id, score)."""
    out = {}
    for share in (*POSITIVE_STEPS, None):
        asked, names = {}, []
        for dim, rows in anchors.items():
            open_ = np.array([i for i in range(len(rows.ids)) if (dim, i) not in out], np.int64)
            if not len(open_):
                continue
            least = np.full(len(open_), -np.inf)
            if share is not None:
                few = np.array([others[dim, int(rows.labels[i])] <= k for i in open_])
                least[~few] = share * norm * np.sqrt((rows.x[open_[~few]] ** 2).sum(axis=1))
            asked[dim] = rows.take(open_), len(names) + np.arange(len(open_)), least
            names += [(dim, int(i), bool(np.isinf(low))) for i, low in zip(open_, least)]
        if not asked:
            break
        found: dict[int, list] = {}
        hits = blocks.mapInArrow(_positives(asked, k), "window long, vec_id long, score long")
        for window, vec_id, score, _ in _first(hits, k).orderBy("window", "rank").collect():
            found.setdefault(window, []).append((vec_id, score))
        for window, (dim, i, whole) in enumerate(names):
            if whole or len(found.get(window, ())) == k:
                out[dim, i] = found.get(window, [])
    return out


def _find_negatives(blocks: DataFrame, anchors: dict[int, _Rows], positives: dict, low: int, high: int, k: int,
                    path: str) -> None:
    """Writes the full windows' rows, threshold by threshold, until none is left open."""
    spark = blocks.sparkSession
    todo = [(dim, i, vec_id, score, -(-low * score // 100), high * score // 100)
            for (dim, i), its in sorted(positives.items()) for vec_id, score in its]
    todo = [w for w in todo if w[4] <= w[5]]
    for step, share in enumerate(NEGATIVE_STEPS):
        if not todo:
            break
        asked = {}
        for dim in {w[0] for w in todo}:
            own: dict[int, list] = {}
            for n, w in enumerate(todo):
                if w[0] == dim:
                    own.setdefault(w[1], []).append((n, w[5] - share * (w[5] - w[4]), w[5]))
            width = max(len(its) for its in own.values())
            nth = np.zeros((len(own), width), np.int64)
            least, most = np.full(nth.shape, np.inf), np.full(nth.shape, -np.inf)
            for row, its in enumerate(own.values()):
                for column, (n, floor, top) in enumerate(its):
                    nth[row, column], least[row, column], most[row, column] = n, floor, top
            asked[dim] = anchors[dim].take(np.array(list(own))), nth, least, most
        hits = written(_first(blocks.mapInArrow(_negatives(asked, k), "window long, vec_id long, score long"), k), "negatives")
        last = step == len(NEGATIVE_STEPS) - 1
        full = set(range(len(todo))) if last else {
            r[0] for r in hits.filter(F.col("rank") == k).select("window").collect()}
        names = [(n, int(anchors[w[0]].ids[w[1]]), w[2], w[3]) for n, w in enumerate(todo) if n in full]
        if names:
            windows = spark.createDataFrame(names, "window long, anchor_id long, positive_id long, positive_score long")
            hits.join(F.broadcast(windows), "window").select(
                "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")).write.parquet(f"{path}/step={step}")
        todo = [w for n, w in enumerate(todo) if n not in full]


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30,
                   high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """For each anchor and each of its positives the first hard negatives: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor. An anchor's positives are its
    first ``n_positives`` other rows of the same label, its negatives the first ``n_negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score; fewer where there are fewer. Higher scores come
    first, then smaller ids, null last. ``anchors`` is a condition on ``vectors``. Rows with a null label or vector, or with
    a null or non-finite component, take no part; vectors meet only those of their own dimension, empty ones with a score
    of 0. Rows with the anchor's id aren't its positives. Repeated rows count one by one; an anchor that is repeated whole
    counts once, anchors with a null id not at all. Other columns are ignored; an empty table gives no rows. Ids and labels
    are integers. Components so large that scores pass 2**53 raise OverflowError.

    The anchors come to the driver some at a time, ``ANCHOR_BYTES`` of them; every such lot reads all blocks once for each
    threshold that it needs."""
    spark = vectors.sparkSession
    is_anchor = F.coalesce(anchors, F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("vec_id"), F.col(id_col).isNotNull().alias("named"),
        F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), is_anchor.alias("anchor"))
    blocks = written(rows.filter("label IS NOT NULL AND vector IS NOT NULL").mapInArrow(_blocks(scale), _BLOCK_DDL), "blocks")
    asking = written(blocks.select("dim", "ids", "labels", "anchors", "x").mapInArrow(_anchors, _ANCHOR_DDL).distinct(), "anchors")
    n_bytes = asking.agg(F.sum(F.octet_length("x") + 64)).first()[0] or 0
    norm = blocks.agg(F.max("norm")).first()[0] or 0.0
    path, lots = scratch(spark, "windows"), -(-n_bytes // ANCHOR_BYTES)
    of_label = written(blocks.select("dim", "labels").mapInArrow(_label_counts, "dim long, label long, n long").groupBy(
        "dim", "label").agg((F.sum("n") - 1).alias("others")), "labels")
    for lot in range(lots):
        some = asking.filter(F.pmod(F.xxhash64("anchor_id", "x"), F.lit(lots)) == lot)
        held = some.join(of_label, ["dim", "label"]).collect()
        by_dim, others = {}, {}
        for r in held:
            by_dim.setdefault(r["dim"], []).append(r)
            others[r["dim"], r["label"]] = r["others"]
        its = {dim: _Rows(np.array([r["anchor_id"] for r in rs], np.int64), np.ones(len(rs), bool),
                          np.array([r["label"] for r in rs], np.int64),
                          np.frombuffer(b"".join(bytes(r["x"]) for r in rs), np.float64).reshape(len(rs), dim))
               for dim, rs in by_dim.items()}
        found = _find_positives(blocks, its, norm, others, n_positives)
        _find_negatives(blocks, its, found, low, high, n_negatives, f"{path}/lot={lot}")
    none = spark.createDataFrame([], _RESULT)
    none.write.parquet(f"{path}/lot=-1/step=-1")
    return spark.read.schema(_RESULT).parquet(path).drop("lot", "step")


def _label_counts(batches):
    for batch in batches:
        for dim, labels in zip(batch["dim"].to_pylist(), batch["labels"].to_pylist()):
            label, n = np.unique(np.frombuffer(labels, np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(label), dim, np.int64), "label": label, "n": n})


ORACLE_SQL = """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM e a JOIN e b ON len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id != anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
