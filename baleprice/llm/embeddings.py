"""Near duplicates of embeddings by randomised-rotation binary codes.

Every vector is scaled to length 1, rotated at random, and coded as the signs of its coordinates with the factor that
corrects for what the signs lose. From a code and a rotated query follows an unbiased estimate of their inner product,
and, as angles obey the triangle inequality, the least estimate that a pair at the threshold can have. Pairs that reach
it are computed exactly; no link falls below it. Cells around pivots, a bounded sample, are gathered into groups; any two
groups meet in one tile, to which come all vectors that can link with a cell of the other group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baleprice.llm.common import components, written

#: Pivots: at most so many vectors, those with the least hash. They go to every task (64 dimensions: 512 kB). They
#: decide which pairs of groups needn't meet, never which links are found.
MAX_PIVOTS = 1024
#: Half-width of the confidence interval in standard errors of the estimate.
CONFIDENCE = 3.5
#: Vectors of one group, at most so many and so many bytes; a larger cell has more groups.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 8 << 20
#: Groups into which even a small table is dealt, so that their tiles are work for many tasks.
LEAST_GROUPS = 8


def rotation(dim: int, seed: int = 20_240_501) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed sign bits) of unit vectors and their correction factors: the inner product of the vector with
    its own code, a unit vector of signs."""
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(1) / math.sqrt(rotated.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and, for each code, the standard error of its estimate."""
    dim = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    error = np.sqrt(np.maximum(0.0, 1 - factors ** 2)) / factors / math.sqrt(max(1, dim - 1))
    return (queries.astype(np.float32) @ signs.T) / factors.astype(np.float32), error


def least_estimate(factors: np.ndarray, threshold: float, dim: int) -> np.ndarray:
    """For each code the estimate that every query with a cosine of ``threshold`` or more reaches: the query is at most
    the threshold's angle from the vector, so at most this and the vector's own angle from its code. The slack covers
    single precision."""
    angle = np.arccos(np.clip(factors, -1, 1)) + math.acos(max(-1.0, min(1.0, threshold)))
    return (np.cos(np.minimum(angle, math.pi)) - 1e-5 - 1e-7 * dim) / factors


def apart(pivots: np.ndarray, most: float = 0.7) -> np.ndarray:
    """Pivots without those near an earlier one, so that a large group of near copies has few cells."""
    near = np.triu(pivots @ pivots.T >= most, 1)
    kept = np.ones(len(pivots), bool)
    for i in range(len(pivots)):
        if kept[i]:
            kept &= ~near[i]
    return pivots[kept]


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _nearest(pivots: np.ndarray):
    """Of each vector its cell, that of the nearest pivot, and its angle to the pivot."""

    def run(batches):
        for batch in batches:
            angles = _angles(_matrix(batch["unit"]), pivots)
            cell = np.argmin(angles, axis=1)
            yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int64), "angle": angles[np.arange(len(cell)), cell]})

    return run


def gathered(sizes: dict[int, int], n_cells: int, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First group and number of groups of each cell, and the number of all: cells in a row share a group while it has
    at most ``limit`` vectors; a larger cell has groups of its own."""
    first, number = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64)
    group, held = 0, 0
    for cell in range(n_cells):
        size = sizes.get(cell, 0)
        if held and held + size > limit:
            group, held = group + 1, 0
        first[cell], number[cell] = group, max(1, -(-size // limit))
        held += size
        if number[cell] > 1:
            group, held = group + int(number[cell]), 0
    return first, number, group + bool(held)


def _deal(pivots: np.ndarray, spans: dict[int, tuple[float, float]], cells: tuple, threshold: float):
    """Rows for the tiles (a, b), a <= b: each vector goes to the tile of its group with itself and with every group
    that has a cell where the best possible cosine, from the angles to the pivot, reaches the threshold."""
    first, number, n_groups = cells
    theta = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    used = np.array(sorted(spans))
    low, high = np.array([spans[c] for c in used]).T
    member = np.zeros((len(used), n_groups), np.float32)
    for i, c in enumerate(used):
        member[i, first[c]:first[c] + number[c]] = 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, unit = batch["class_id"].to_numpy(), _matrix(batch["unit"])
            angles = _angles(unit, pivots)
            cell = np.argmin(angles, axis=1)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = first[cell] + (mixed % number[cell].astype(np.uint64)).astype(np.int64)
            reach = (angles[:, used] <= high + theta) & (angles[:, used] >= low - theta)
            asks = reach.astype(np.float32) @ member > 0
            asks[np.arange(len(own)), own] = True
            row, other = np.nonzero(asks)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(own[row], other)), pa.array(np.maximum(own[row], other)), pa.array(own[row]),
                 batch["class_id"].take(at), batch["weight"].take(at), batch["unit"].take(at)],
                names=["a", "b", "own", "class_id", "weight", "unit"])

    return run


_TILE_DDL = "a long, b long, own long, class_id long, weight long, unit binary"
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _links(threshold: float, step: int = 512):
    """The links of one tile, each pair once: of both ends their number, and links that span them."""

    def run(tile: pa.Table) -> pa.Table:
        a, b = tile["a"][0].as_py(), tile["b"][0].as_py()
        own, ids = tile["own"].to_numpy(), tile["class_id"].to_numpy()
        weights, units = tile["weight"].to_numpy(), _matrix(tile["unit"])
        dim = units.shape[1]
        held, asking = np.flatnonzero(own == b), np.flatnonzero(own == a)
        out = []
        if len(held) and len(asking):
            turned = rotation(dim)
            codes, factors = encode(units[held] @ turned)
            least = least_estimate(factors, threshold, dim).astype(np.float32)
            for start in range(0, len(asking), step):
                asked = asking[start:start + step]
                value, _ = estimate(codes, factors, units[asked] @ turned)
                q, s = np.nonzero(value >= least)
                q, s = asked[q], held[s]
                if a == b:
                    q, s = q[q < s], s[q < s]
                exact = [np.einsum("ij,ij->i", units[q[i:i + 65536]], units[s[i:i + 65536]]) >= threshold
                         for i in range(0, len(q), 65536)]
                if not exact or not (linked := np.concatenate(exact)).any():
                    continue
                q, s = q[linked], s[linked]
                number = np.bincount(q, weights[s], len(ids)) + np.bincount(s, weights[q], len(ids))
                # every node with the least id that the links found here lead to: they span the links
                label = ids.copy()
                while True:
                    before = label[q], label[s]
                    np.minimum.at(label, q, before[1])
                    np.minimum.at(label, s, label[q])
                    if np.array_equal(label[q], before[0]) and np.array_equal(label[s], before[1]):
                        break
                hit = np.flatnonzero(number)
                out.append(pa.table([ids[hit], label[hit], number[hit].astype(np.int64)], schema=_LINK))
        return pa.concat_tables(out) if out else _LINK.empty_table()

    return run


def _unit(batches):
    """Vectors as unit vectors in double precision; those that link with nothing are left out."""
    for batch in batches:
        ids, out, dims = [], [], []
        for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"]):
            if not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            big = np.abs(x).max()
            if not np.isfinite(big) or big == 0:
                continue
            x = x / big
            ids.append(i)
            out.append((x / np.linalg.norm(x)).tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_pydict({"vec_id": ids, "unit": out, "dim": dims}, schema=pa.schema(
            [("vec_id", pa.int64()), ("unit", pa.binary()), ("dim", pa.int64())]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                    max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine >= ``threshold``), component_id, kept.

    Cosines that count as links are computed in double precision; cells and codes leave out only pairs that can't
    reach the threshold, so every link is found and counts for both ends. Where the cells rule out nothing, as among
    unrelated vectors, all pairs meet as codes: the time then grows as the square of the distinct vectors. Vectors that are null, empty or zero,
    or that hold null or non-finite components, link with nothing; so do vectors of different dimension. Equal unit vectors are
    one class with a weight, so any number of copies costs one. Ids must not be null, rows without one are left out;
    equal ids count as copies of one another when their vectors are equal; other columns are ignored; an empty table
    gives no rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter(
        "vec_id IS NOT NULL")
    units = written(rows.mapInArrow(_unit, "vec_id long, unit binary, dim long"), "units")
    classes = written(units.groupBy("unit", "dim").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight")),
                      "classes")
    counted = links = None
    for dim in sorted(r[0] for r in classes.select("dim").distinct().collect()):
        same = classes.filter(F.col("dim") == dim).select("class_id", "unit", "weight")
        chosen = same.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(max_pivots).collect()
        pivots = apart(np.frombuffer(b"".join(r[0] for r in chosen), np.float64).reshape(len(chosen), dim))
        cells = same.mapInArrow(_nearest(pivots), "cell long, angle double").groupBy("cell").agg(
            F.count("*"), F.min("angle"), F.max("angle")).collect()
        n_classes = sum(r[1] for r in cells)
        limit = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim), -(-n_classes // LEAST_GROUPS)))
        groups = gathered({r[0]: r[1] for r in cells}, len(pivots), limit)
        tiles = groups[2] * (groups[2] + 1) // 2
        dealt = same.mapInArrow(_deal(pivots, {r[0]: (r[2], r[3]) for r in cells}, groups, threshold), _TILE_DDL)
        found = written(dealt.repartition(min(2 * tiles, 4096), "a", "b").groupBy("a", "b").applyInArrow(
            _links(threshold), "u long, v long, links long"), "found")
        links = found if links is None else links.unionByName(found)
    labels = units.join(classes, ["unit", "dim"]).select("vec_id", "class_id", "weight")
    if links is not None:
        counted = links.groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("links"))
        joined = components(links).withColumnRenamed("node", "class_id")
        labels = labels.join(counted, "class_id", "left").join(joined, "class_id", "left")
        labels = labels.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                               F.coalesce("component", "class_id").alias("component_id"))
    else:
        labels = labels.selectExpr("vec_id", "weight - 1 AS n_links", "class_id AS component_id")
    alone = rows.select("vec_id").join(units.select("vec_id").distinct(), "vec_id", "left_anti").selectExpr(
        "vec_id", "CAST(0 AS long) AS n_links", "vec_id AS component_id")
    return labels.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))

