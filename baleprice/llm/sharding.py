"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows of each partition are permuted in place. How many of them go to each block of each shard is a row of the
communication matrix: the matrix of a uniform random permutation, whose row sums are the partitions' counts and whose
column sums are the blocks' exact sizes. One exchange carries the rows to their blocks, which are permuted again; a row's
slot is its block's place in the shard and its rank in the block.

Nobody holds the whole matrix. The partitions are halved again and again; a seeded draw from the multivariate
hypergeometric distribution says how much of every block each half fills. A task walks down to its own partitions, and
all tasks draw the same numbers on the way. The driver sees one count a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baleprice.llm.common import fresh, written

#: Rows of one block, at most: what one task permutes after the exchange.
ROWS_PER_BLOCK = 1 << 16
#: numpy draws hypergeometric numbers of fewer items than this.
_NUMPY_MOST = 10 ** 9
_RANK = (1 << 33) - 1


def _draw_many(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """A hypergeometric number of any size: the cumulative distribution around its mode, out to 12 deviations."""
    total = good + bad
    mode = (taken + 1) * (good + 1) // (total + 2)
    deviation = math.sqrt(taken * (good / total) * (bad / total) * ((total - taken) / max(1, total - 1)))
    span = int(12 * deviation) + 16
    low, high = max(0, taken - bad, mode - span), min(good, taken, mode + span)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(taken - x) - np.log(x + 1) - np.log(bad - taken + x + 1)
    logs = np.r_[0.0, np.cumsum(steps)]
    cumulative = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(cumulative, rng.random() * cumulative[-1], "right"))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """How many of ``taken`` items, drawn from good and bad ones without replacement, are good; element by element."""
    out = np.zeros(len(good), np.int64)
    small = good + bad < _NUMPY_MOST
    out[small] = rng.hypergeometric(good[small], bad[small], taken[small])
    for i in np.flatnonzero(~small):
        out[i] = _draw_many(rng, int(good[i]), int(bad[i]), int(taken[i]))
    return out


def draw(rng: np.random.Generator, free: np.ndarray, taken: int) -> np.ndarray:
    """``taken`` items drawn without replacement from ``free`` items of each kind: how many of each kind.

    The kinds are halved level by level, so that one call draws a whole level."""
    sums = [np.r_[free, np.zeros((1 << (len(free) - 1).bit_length()) - len(free), np.int64)]]
    while len(sums[-1]) > 1:
        sums.append(sums[-1][0::2] + sums[-1][1::2])
    out = np.array([taken], np.int64)
    for level in sums[-2::-1]:
        left = hypergeometric(rng, level[0::2], level[1::2], out)
        out = np.stack([left, out - left], 1).reshape(-1)
    return out[:len(free)]


class CommunicationMatrix:
    """Rows of the matrix for partitions of ``counts`` rows and blocks of ``capacities`` rows, drawn when asked for."""

    def __init__(self, counts: np.ndarray, capacities: np.ndarray, seed: int):
        self.before = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        self.seed = seed
        self.path = [(0, len(counts), np.asarray(capacities, np.int64))]

    def row(self, part: int) -> np.ndarray:
        """How many rows of a partition go to each block."""
        while not self.path[-1][0] <= part < self.path[-1][1]:
            self.path.pop()
        low, high, free = self.path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, low, high])
            left = draw(rng, free, int(self.before[middle] - self.before[low]))
            low, high, free = (low, middle, left) if part < middle else (middle, high, free - left)
            self.path.append((low, high, free))
        return free


def block_sizes(n_rows: int, n_shards: int, rows_per_block: int) -> tuple[np.ndarray, int]:
    """The sizes of all blocks, shard by shard, and the blocks of a shard. Shards are at most one row apart, and so are
    the blocks of a shard."""
    shards = n_rows // n_shards + (np.arange(n_shards) < n_rows % n_shards)
    blocks = max(1, math.ceil(int(shards.max()) / rows_per_block))
    return (shards[:, None] // blocks + (np.arange(blocks) < shards[:, None] % blocks)).reshape(-1), blocks


def _block_of(parts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, seed: int):
    """The block of each row, from its partition and its rank there."""

    def block(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matrix = CommunicationMatrix(counts, sizes, seed)
        for part, rank in batches:
            out = np.zeros(len(part), np.int32)
            for p in np.unique(part):
                own = (part == p).to_numpy()
                row = matrix.row(int(np.searchsorted(parts, p)))
                out[own] = np.searchsorted(np.cumsum(row), rank[own], "right")
            yield pd.Series(out)

    return F.pandas_udf(block, "int")


def shuffle_into_shards(rows: DataFrame, n_shards: int = 8, seed: int = 42, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with the columns ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard), at the end.

    Every assignment of rows to (shard, slot) is equally likely; shard sizes are at most one row apart, whatever the
    partitions hold. Only the number of rows counts: nulls in any column, empty and very long texts, ties and repeated rows
    change nothing, equal rows are dealt one by one. Columns called shard or slot stay, the new ones are then named with
    underscores behind. An empty table gives no rows. The rows as they were permuted are written to the shared folder
    first, so that a task that runs again sends the same rows; the same partitions and seed give the same shards."""
    key, part, rank, block, shard, slot = fresh(rows, "key", "part", "rank", "block", "shard", "slot")
    permuted = written(
        rows.withColumn(key, F.rand(seed)).sortWithinPartitions(key).drop(key).withColumns({
            part: F.spark_partition_id().cast("long"),
            rank: F.monotonically_increasing_id().bitwiseAND(F.lit(_RANK))}), "permuted")
    counted = sorted(permuted.groupBy(part).count().collect())
    parts, counts = np.array(counted, np.int64).reshape(-1, 2).T
    n_rows = int(counts.sum())
    sizes, blocks = block_sizes(n_rows, n_shards, rows_per_block)
    in_order = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), part, rank), part, rank)
    size = F.floor(F.lit(n_rows) / n_shards) + F.when(F.col(shard) < n_rows % n_shards, 1).otherwise(0)
    nth = F.col(block) % blocks
    start = nth * F.floor(size / blocks) + F.least(nth, size % blocks)
    dealt = permuted.withColumn(block, _block_of(parts, counts, sizes, seed)(part, rank)).repartitionById(
        len(sizes), F.col(block))
    return dealt.withColumn(slot, F.row_number().over(in_order) - 1).withColumn(
        shard, F.floor(F.col(block) / blocks).cast("int")).withColumn(
        slot, F.col(slot) + start.cast("long")).select(*rows.columns, shard, slot)


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder for each shard; the blocks of a shard are its files."""
    shuffled.write.partitionBy(shard).parquet(path)
