"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baleprice.llm import words as W
from baleprice.llm.common import released, small_arrow_batches, text_batches, written

#: Features are hashed to so many weights; the weights sent to the executors take 4 MB at most, L1 leaves far fewer.
BITS = 20
#: Labelled rows that the classifier learns from at most, those with the least hash of their id: one task learns them.
MAX_LABELLED = 20_000
_SEEDS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
#: Text that a worker takes at a time, and the Arrow batch that it comes in: its three features a word take arrays
#: of several times the text.
_BATCH = 1 << 19
_ARROW_BATCH = 4 << 20


def features(text) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, word pair and pair with one word between; a row repeats a feature as its text does."""
    h, bounds = W.word_hashes(*W.buffers(text), lower=True, separator=W.PUNCTUATED)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rows, out = [row], [h]
    for gap, seed in zip((1, 2), _SEEDS):
        if len(h) > gap:
            within = row[:-gap] == row[gap:]
            rows.append(row[:-gap][within])
            out.append(W.mix(h[:-gap] * np.uint64(seed) + h[gap:])[within])
    return np.concatenate(rows), (np.concatenate(out) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = 5, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 10.0, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes in the given order. Each coordinate has its own rate, alpha / (beta +
    root of its summed squared gradients); weights within the L1 threshold are exactly 0. The bias isn't shrunk."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            zi, ni = z[x], n[x]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -bias_z / ((beta + bias_n ** 0.5) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[x] = ni + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n ** 0.5) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-bias_z / ((beta + bias_n ** 0.5) / alpha))


def _vectors(batches):
    for batch in batches:
        for table in text_batches([batch], _BATCH):
            row, feature = features(table["text"])
            order = np.argsort(row, kind="stable")
            parts = np.split(feature[order], np.searchsorted(row[order], np.arange(1, len(table))))
            yield pa.RecordBatch.from_pydict({
                "at": table["at"].to_numpy(), "label": table["label"].to_numpy(),
                "x": [np.unique(p).astype(np.int32).tobytes() for p in parts]},
                schema=pa.schema([("at", pa.int64()), ("label", pa.int64()), ("x", pa.binary())]))


def _rows_of(x) -> list[np.ndarray]:
    """The int32 lists in a binary column without nulls, as views of the column's own buffer."""
    x = x.cast(pa.large_binary())
    _, at, data = x.buffers()
    bounds = np.frombuffer(at, np.int64)[x.offset:x.offset + len(x) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.split(held[bounds[0]:bounds[-1]].view(np.int32), (bounds[1:-1] - bounds[0]) // 4)


def _learn(options: dict):
    def run(batches):
        rows, labels = [], []
        for batch in batches:
            if batch.num_rows:
                rows += _rows_of(batch["x"])
                labels += batch["label"].to_pylist()
        if rows:
            w, bias = ftrl(rows, labels, **options)
            at = np.flatnonzero(w).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"at": [at.tobytes()], "w": [w[at].astype(np.float32).tobytes()],
                                              "bias": [bias]})
    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_LABELLED, **options) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Indices, weights and bias of the classifier; None where no row has a label.

    ``labelled`` has one row per document. It learns from the at most ``max_rows`` rows with the least hash of their
    id, in that order, so reruns agree; null labels are left out, null texts are empty. Their features are made by
    many tasks, the weights by one."""
    small_arrow_batches(labelled.sparkSession, _ARROW_BATCH)
    rows = labelled.filter(F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col)).alias("at"),
        F.col(label_col).cast("long").alias("label"), F.col(text_col).alias("text"))
    vectors = rows.mapInArrow(released(_vectors), "at long, label long, x binary")
    model = vectors.repartition(1).sortWithinPartitions("at", "label", "x").limit(max_rows).mapInArrow(
        released(_learn(options)), "at binary, w binary, bias double").first()
    return model and (np.frombuffer(model["at"], np.int32), np.frombuffer(model["w"], np.float32), model["bias"])


def _scores(model):
    at, weights, bias = model if model else (np.zeros(0, np.int32), np.zeros(0, np.float32), None)

    def run(batches):
        w = np.zeros(1 << BITS)
        w[at] = weights
        for table in text_batches(batches, _BATCH):
            row, feature = features(table["text"])
            heavy = w[feature] != 0
            once = np.unique(row[heavy] << BITS | feature[heavy])
            total = np.bincount(once >> BITS, w[once & ((1 << BITS) - 1)], minlength=len(table))
            score = np.zeros(len(table)) if bias is None else 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].to_numpy(), "score": score})

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row with an id: doc_id, score (0 to 1) from the whole text alone.

    Null and empty texts score what the bias gives; without a model all scores are 0; rows with equal ids are scored each
    on its own; rows with a null id get no score; other columns are ignored; an empty table gives no rows."""
    small_arrow_batches(docs.sparkSession, _ARROW_BATCH)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        "doc_id IS NOT NULL").mapInArrow(released(_scores(model)), "doc_id long, score double")


def without_toxic(docs: DataFrame, model, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, nothing is shuffled."""
    small_arrow_batches(docs.sparkSession, _ARROW_BATCH)
    names = docs.columns

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            plain = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), batch[text_col]],
                                               names=["doc_id", "text"])
            at, scores = [], []
            for part in _scores(model)([plain]):
                at.append(part["doc_id"].to_numpy())
                scores.append(part["score"].to_numpy())
            if at:
                keep = np.sort(np.concatenate(at)[np.concatenate(scores) < threshold])
                yield from rows.take(pa.array(keep)).select(names).to_batches()

    return docs.mapInArrow(released(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", max_rows: int = MAX_LABELLED) -> DataFrame:
    """Documents with a label that may be learned from: at most ``max_rows``, those with the least hash of their id.

    A document with several labels has the largest. The chosen ids are few, by that bound, and go to all tasks, so that
    no text is shuffled but theirs."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).alias(label_col)).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    return docs.select(id_col, text_col).join(F.broadcast(written(chosen, "labels")), F.col(id_col) == F.col("_id")).drop("_id")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, from a classifier learned from ``labels``."""
    model = fit(learning_rows(docs, labels))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
