"""Best-fit packing of token runs into sequences of several permitted lengths."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baleprice.llm.common import WORD, written

LENGTHS = (512, 1024, 2048, 4096, 8192)
_PACKED = "doc_id long, piece long, start long, n_tokens long, bin string, bin_length long, bin_tokens long, offset long"


def bin_cost(length: int, overhead: int) -> int:
    """What a sequence costs: its length, padding included, and a fixed overhead."""
    return length + overhead


def opening_length(sizes_left: list[int], first: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length that is cheapest a token when a new bin must hold the piece at ``first`` and then what
    comes after it in descending order, each piece that still fits, until it is full or nothing fits: the joint choice
    over all lengths. Pieces of equal size are taken in one step. Ties go to the shorter length."""
    best = None
    for length in lengths:
        if length < sizes_left[first]:
            continue
        room, used, i = length, 0, first
        while i < len(sizes_left) and room:
            size = sizes_left[i]
            if size > room:
                i = _first_at_most(sizes_left, room, i + 1)
                continue
            after = _first_at_most(sizes_left, size - 1, i + 1)
            held = min(after - i, room // size)
            room -= held * size
            used += held * size
            i = after
        rate = bin_cost(length, overhead) / used
        if best is None or rate < best[0]:
            best = (rate, length)
    return best[1]


def _first_at_most(sizes: list[int], room: int, start: int) -> int:
    """Index from ``start`` of the first size <= room in a descending list."""
    lo, hi = start, len(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if sizes[mid] <= room:
            hi = mid
        else:
            lo = mid + 1
    return lo


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = 16) -> list[tuple[int, int, int]]:
    """(bin number, offset in it, permitted length) for each of ``sizes``, which must be in descending order.

    A piece goes to the open bin that it fills best (the least room left, then the oldest bin). Where none has room, a
    bin of the length that is cheapest a token is opened. Finally each bin is downsized to the shortest permitted length that
    holds its contents."""
    rooms: list[int] = []
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    placed = []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            number = heapq.heappop(open_bins[room])
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
        else:
            room = opening_length(sizes, i, lengths, overhead)
            number = len(used)
            used.append(0)
        placed.append((number, used[number]))
        used[number] += size
        room -= size
        if room:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            heapq.heappush(open_bins[room], number)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return [(number, offset, final[number]) for number, offset in placed]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None,
         lengths: tuple[int, ...] = LENGTHS, overhead: int = 16, pieces_per_group: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start and n_tokens in its document, bin, bin_length, bin_tokens, offset.

    A document longer than the longest permitted length is cut into pieces of that length and a rest; every token lies
    in exactly one piece, every piece in exactly one bin. Tokens are words unless ``tokens_col`` gives counts. Pieces
    are dealt by a hash of their id and number into groups of about ``pieces_per_group``, as many as the input needs, and
    each group is packed best-fit decreasing, so that no task sees more than a group; only the last bins of a group
    are fuller in one global packing. Null and empty texts have one piece of no tokens with a null bin and no length;
    rows with equal ids are pieces on their own, told apart by their size only; a null id packs like any other; no rows in,
    no rows out; other columns are ignored. Equal inputs give equal bins, whatever the partitioning."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    count = F.col(tokens_col) if tokens_col else F.regexp_count(text_col, F.lit(WORD))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(count, F.lit(0)).cast("long").alias("n"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.lit(0), F.floor((F.col("n") - 1) / longest))))).select(
        "doc_id", "piece", (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens"))
    pieces = written(pieces, "pieces")
    n_groups = max(1, math.ceil(pieces.count() / pieces_per_group))
    dealt = pieces.filter("n_tokens > 0").withColumn(
        "bin_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = best_fit(frame["n_tokens"].tolist(), lengths, overhead)
        group = frame["bin_group"].iloc[0]
        frame = frame.assign(bin=[f"{group}-{b}" for b, _, _ in placed], offset=[o for _, o, _ in placed],
                             bin_length=[length for _, _, length in placed])
        frame["bin_tokens"] = frame.groupby("bin")["n_tokens"].transform("sum")
        return frame[["doc_id", "piece", "start", "n_tokens", "bin", "bin_length", "bin_tokens", "offset"]]

    packed = dealt.groupBy("bin_group").applyInPandas(run, _PACKED)
    empty = pieces.filter("n_tokens = 0").selectExpr(
        "doc_id", "piece", "start", "n_tokens", "CAST(NULL AS string) AS bin", "CAST(NULL AS long) AS bin_length",
        "CAST(NULL AS long) AS bin_tokens", "CAST(NULL AS long) AS offset")
    return packed.unionByName(empty)
