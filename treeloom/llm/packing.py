"""Filling fixed-capacity containers: exact-complement hashing over availability counts.

Items of one length are alike, so a packing is decided on counts per length, of which there are at most ``capacity``
however many items there are; that histogram is all the driver sees. A decision is a pattern (lengths in a container)
with the number of containers that use it. Items then find their containers in parallel: an item has a rank among the
items of its length, and each pattern owns ranges of ranks.

From the longest length down: the gap it leaves is looked up in an index of single lengths, sums of two and sums of
three, which follows the counts; a combination that fills it exactly is consumed as often as the counts allow. Where there is none, the longest item that
fits is added and the rest of the gap looked up again (best fit).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 256


def _descending(flags: np.ndarray, low: int) -> Iterator[int]:
    """``low`` plus the places of the true flags, last first; the first one alone is mostly enough."""
    down = flags[::-1]
    first = int(down.argmax()) if len(down) else 0
    if len(down) and down[first]:
        top = low + len(down) - 1
        yield top - first
        yield from (top - first - 1 - int(i) for i in np.flatnonzero(down[first + 1 :]))


class _Sums:
    """Availability counts with an index of the sums of one, two and three available lengths.

    Sums are looked up at their own place in an array (a perfect hash): ``there[s]`` for single lengths, ``pairs[s]`` for
    the number of pairs that add up to ``s``, and the last combinations found for a gap. A triple is a length whose
    complement is in the index of pairs. The index follows the counts: a length that runs out takes its pairs with it.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64)
        self.n[0] = 0
        self.there = self.n > 0
        size = 2 * len(counts)
        ordered = np.rint(np.fft.irfft(np.fft.rfft(self.there.astype(float), size) ** 2, size)).astype(np.int64)[: len(counts)]
        twice = np.flatnonzero(self.there)
        twice = twice[2 * twice < len(counts)]
        ordered[2 * twice] -= 1
        self.pairs = (ordered // 2).astype(np.int32)
        self.pairs[2 * twice] += self.n[twice] >= 2
        self.has_pair = self.pairs > 0
        self.pair_of: dict[int, tuple[int, ...]] = {}
        self.triple_of: dict[int, tuple[int, ...]] = {}

    def take(self, length: int, times: int) -> None:
        """Use up items of one length."""
        before = self.n[length]
        self.n[length] -= times
        both = 2 * length
        if before >= 2 > self.n[length] and both < len(self.n):
            self.pairs[both] -= 1
            self.has_pair[both] = self.pairs[both] > 0
        if not self.n[length]:
            self.there[length] = False
            at = slice(length, len(self.n))
            self.pairs[at] -= self.there[: len(self.n) - length]
            np.greater(self.pairs[at], 0, out=self.has_pair[at])

    def usable(self, lengths: tuple[int, ...], used: dict[int, int]) -> bool:
        need = dict(used)
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        return all(self.n[x] >= need[x] for x in lengths)

    def pair(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """Two lengths that fill the gap, the longer one as long as possible."""
        if not self.has_pair[gap]:
            return None
        known = self.pair_of.get(gap)
        if known and self.usable(known, used):
            return known
        low = (gap + 1) // 2
        for a in _descending(self.there[low:gap] & self.there[1 : gap - low + 1][::-1], low):
            found = (a, gap - a)  # the first is usable unless its items are used up by this very container
            if self.usable(found, used):
                self.pair_of[gap] = found
                return found
        return None

    def triple(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """Three lengths that fill the gap, the longest one as long as possible."""
        known = self.triple_of.get(gap)
        if known and self.usable(known, used):
            return known
        low = (gap + 2) // 3
        if gap < 3:
            return None
        for a in _descending(self.there[low : gap - 1] & self.has_pair[2 : gap - low + 1][::-1], low):
            rest = self.pair(gap - a, used | {a: used.get(a, 0) + 1})
            if rest and self.usable((a, *rest), used):
                self.triple_of[gap] = (a, *rest)
                return self.triple_of[gap]
        return None

    def fill(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """Lengths that fill the gap exactly: one, two or three."""
        if self.usable((gap,), used):
            return (gap,)
        return self.pair(gap, used) or self.triple(gap, used)

    def longest(self, gap: int, used: dict[int, int]) -> int | None:
        return next((a for a in _descending(self.there[: gap + 1], 0) if self.usable((a,), used)), None)


def solve(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (number of containers, {length: items in each}) that use up ``counts[1..capacity]``."""
    sums, patterns = _Sums(counts), []
    for length in range(capacity, 0, -1):
        while sums.n[length] > 0:
            used = {length: 1}
            gap = capacity - length
            while gap:
                more = sums.fill(gap, used)
                if more is None:
                    one = sums.longest(gap, used)
                    if one is None:
                        break
                    more = (one,)
                for x in more:
                    used[x] = used.get(x, 0) + 1
                    gap -= x
            times = min(int(sums.n[x]) // k for x, k in used.items())
            for x, k in used.items():
                sums.take(x, times * k)
            patterns.append((times, used))
    return patterns


def _runs(patterns: list[tuple[int, dict[int, int]]], capacity: int):
    """For each length the ranges of ranks its patterns own: arrays (length, first rank, items a container, first container)."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for times, used in patterns:
        for x, k in used.items():
            rows.append((x, taken[x], k, base))
            taken[x] += times * k
        base += times
    a = np.array(rows, np.int64).reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return a, base


def _place(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(2**40)  # ranks are below it
        keys = runs[:, 0] * span + runs[:, 1]
        for b in batches:
            length, rank = b.column("len").to_numpy(), b.column("rank").to_numpy()
            if len(runs):
                at = np.searchsorted(keys, length * span + rank, "right") - 1
                at = np.maximum(at, 0)
                box = runs[at, 3] + (rank - runs[at, 1]) // runs[at, 2]
            else:
                box = np.zeros(len(length), np.int64)
            box = np.where(length == 0, 0, box)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("piece"), b.column("len"), pa.array(box, pa.int64())], names=["doc", "piece", "len", "box"])

    return run


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc, piece, start, len, container) for every row of ``sizes`` (doc, n).

    An item longer than the capacity is split into full containers of its own and a remainder (none if it divides
    evenly); no other item is split. Items of size 0 take no room and lie in the first shared container. A null size
    is like 0. ``sizes`` should be a stored table: it is read twice.
    """
    n = F.coalesce("n", F.lit(0)).cast("long")
    c = F.lit(capacity).cast("long")
    rows = sizes.select("doc", n.alias("n"))
    full = (
        rows.filter(F.col("n") > c).select("doc", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / c) - 1).cast("int"))).alias("piece"))
        .select("doc", "piece", (F.col("piece") * c).alias("start"), c.alias("len"), F.concat(F.lit("own-"), F.coalesce(F.col("doc").cast("string"), F.lit("null")), F.lit("-"), F.col("piece").cast("string")).alias("container"))
    )
    rest = F.when(F.col("n") > c, F.col("n") % c).otherwise(F.col("n"))
    items = rows.select("doc", F.when(F.col("n") > c, F.floor(F.col("n") / c)).otherwise(F.lit(0)).cast("int").alias("piece"), rest.alias("len"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    items = items.filter((F.col("len") > 0) | (F.col("piece") == 0))
    hist = items.groupBy("len", "salt").agg(F.count(F.lit(1)).alias("k"))
    cells = hist.groupBy("len").agg(F.sum("k").alias("k")).toPandas()  # at most capacity + 1 counts
    counts = np.zeros(capacity + 1, np.int64)
    counts[cells["len"].to_numpy(np.int64)] = cells["k"].to_numpy(np.int64)
    runs, _ = _runs(solve(counts, capacity), capacity)
    before = F.coalesce(F.sum("k").over(Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = hist.select("len", "salt", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("len", "salt").orderBy("doc"))
    ranked = items.withColumn("rn", rank).join(offsets, ["len", "salt"]).select("doc", "piece", "len", (F.col("before") + F.col("rn") - 1).cast("long").alias("rank"))
    placed = ranked.mapInArrow(_place(runs), "doc long, piece int, len long, box long")
    shared = placed.select("doc", "piece", (F.col("piece") * c).alias("start"), "len", F.concat(F.lit("mix-"), F.col("box").cast("string")).alias("container"))
    return full.unionByName(shared)
