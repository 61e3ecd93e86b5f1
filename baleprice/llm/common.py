"""Helpers shared by the training-data operators: scratch tables, packed shuffles, connected components."""

from __future__ import annotations

import ctypes
import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baleprice.session import ensure_checkpoint_dir

#: Words are runs of bytes other than space and \t \n \v \f \r, in text and in every SQL pattern here.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int) -> int:
    """Buckets of a packed shuffle, in proportion to the text of the whole input (one scan, one number)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / bucket_bytes))


def text_batches(batches, max_bytes: int):
    """Arrow batches with the columns (doc_id, text, ...) cut into tables of about ``max_bytes`` of text, rows by
    ascending doc_id, nulls as empty texts. A longer single text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        text = pc.fill_null(table["text"], "")
        table = table.set_column(table.column_names.index("text"), "text", text)
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < table.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + max_bytes, "right")))
            part = table.slice(start, stop - start)
            yield part.take(pa.array(np.argsort(part["doc_id"].to_numpy(), kind="stable"))).combine_chunks()
            start = stop


def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """Integers as bytes, all lowest bytes first: the zero high bytes then compress to nothing."""
    return a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes() if len(a) else b""


def unplanes(raw: bytes, dtype, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    width = width or size
    out = np.zeros((len(raw) // width, size), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(dtype).reshape(-1)


def by_bucket(batches, columns: list[str]):
    """Rows of one partition, sorted by ``bucket``, as (bucket, {column: list of values}), one bucket at a time."""
    at, held = None, None
    for batch in batches:
        rows = batch.to_pydict()
        for i, bucket in enumerate(rows["bucket"]):
            if bucket != at:
                if held is not None:
                    yield at, held
                at, held = bucket, {c: [] for c in columns}
            for c in columns:
                held[c].append(rows[c][i])
    if held is not None:
        yield at, held


_FOREST = 1 << 20


def _least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forest(with_roots: bool):
    """A partition's links replaced by links of each node to the least one that it reaches through them. A partition
    of more than ``_FOREST`` links is taken in pieces; ``with_roots`` adds a row for each least node itself."""

    def run(batches):
        u, v, held = [], [], 0

        def stars():
            nodes, least = _least_linked(np.concatenate(u), np.concatenate(v))
            keep = slice(None) if with_roots else nodes != least
            return nodes[keep], least[keep]

        for batch in batches:
            u.append(batch["u"].to_numpy())
            v.append(batch["v"].to_numpy())
            held += batch.num_rows
            if held > _FOREST and not with_roots:
                nodes, least = stars()
                u, v, held = [nodes], [least], len(nodes)
                if 2 * held > _FOREST:
                    yield pa.RecordBatch.from_pydict({"u": nodes, "v": least})
                    u, v, held = [], [], 0
        if held:
            nodes, least = stars()
            yield pa.RecordBatch.from_pydict({"u": nodes, "v": least})

    return run


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = _FOREST) -> DataFrame:
    """Connected components of the links (u, v): rows (node, component), component the least node reachable.

    Each partition first replaces its links by links to the least node reachable through them. If no more than
    ``one_task`` links of 16 bytes are left by then (they are counted), one task ends the job. Beyond, alternating star
    contraction: every round links larger neighbours, then smaller ones, to the least neighbour, until every node has
    one link to a node that has none itself. All links are written to the shared folder.
    Links with a null end and from a node to itself are ignored; repeated links count once; nodes without links don't
    appear. No links: no rows. The rounds grow as the logarithm of the largest component; stars need none."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        tangled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
            "up > 1 OR (up = 1 AND down = 1)")
        return tangled.isEmpty()

    e = written(edges.filter("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(
        released(_forest(False)), "u long, v long"), "forest")
    if e.count() <= one_task:
        whole = written(e.coalesce(1).mapInArrow(released(_forest(True)), "u long, v long"), "components")
        return whole.select(F.col("u").alias("node"), F.col("v").alias("component"))
    e = written(e.distinct(), "links")
    for _ in range(max_rounds):
        if stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        small = large.join(least(large), "u")
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def released(run):
    """``run`` over the batches of a partition, after which the worker hands freed memory back to the system. Workers wait
    for further tasks, and without this hold the most that they took while the stages after theirs run."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have none
            if trim:
                trim(0)

    return whole


def small_arrow_batches(spark: SparkSession, max_bytes: int = 8 << 20) -> None:
    """Has the session hand Python workers batches of at most so many bytes, where it allows larger ones: a worker holds
    several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= max_bytes:
        spark.conf.set(key, str(max_bytes))
