"""A few keys holding most records: per-key results by distributed exact selection.

Quantiles per key come from value histograms that are refined until each rank is resolved: in every round a key's
bracket is cut into ``BINS`` equal bins, rows are counted per (key, rank, bin) with map-side partial counts, and the
bin that holds the rank becomes the next bracket. What meets in one place per key is a histogram of at most ``BINS``
counts, never its values. Values are integers, so a bracket of width 1 is an exact result; 32-bit values need at most
four rounds. Distinct counts and totals are two-step aggregates that spread a hot key by value.

The keys that hold a share of all rows are found by the same selection among the keys themselves (:func:`heavy_values`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.runtime import hot_keys, materialize, split_join

BINS = 256


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v, c): mergeable counts per key and value; hot keys are spread by value and combined on the map side."""
    return df.groupBy(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def key_totals(counts: DataFrame) -> DataFrame:
    """(k, n, lo, hi): rows, smallest and greatest non-null value of each key, from :func:`value_counts`."""
    return counts.groupBy("k").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v").isNotNull(), F.col("c"))).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _bins(lo: int, hi: int) -> list[tuple[int, int]]:
    """The interval in at most BINS parts of equal width; one that does not fit into 64 bits is cut at 0."""
    if hi - lo >= 2**62:
        return [(lo, -1), (0, hi)] if lo < 0 <= hi else [(lo, lo + 2**61), (lo + 2**61 + 1, hi)]
    width = (hi - lo) // BINS + 1
    return [(at, min(at + width - 1, hi)) for at in range(lo, hi + 1, width)]


def _bin_of(v: Column, brackets: Sequence[tuple[int, int]]) -> Column:
    """Number of the bin of a value, counted over all brackets; null outside of them."""
    out, first = None, 0
    for lo, hi in brackets:
        bins = _bins(lo, hi)
        if len(bins) == 2 and hi - lo >= BINS:
            nth = F.when(v <= bins[0][1], F.lit(first)).otherwise(F.lit(first + 1))
        else:
            nth = F.call_function("div", v - lo, F.lit(bins[0][1] - bins[0][0] + 1)) + first
        here = v.between(lo, hi)
        out = F.when(here, nth) if out is None else out.when(here, nth)
        first += len(bins)
    return out


def heavy_values(df: DataFrame, column: str, share: str) -> list[tuple[int, int]]:
    """(value, rows) of the non-null integers of a column that at least ``share`` of all rows hold: at most ``1 / share``.

    Let s be the least number of rows that makes the share. Of the rows in the order of the column, those of one value
    stand together, so a value with s rows stands at one of the ranks s, 2 s, 3 s, ... Exact selection asks for the
    values at these ranks: the column's range is cut into bins, rows are counted per bin on the map side, and the bins
    that hold a rank become the next brackets. A bin of fewer than s rows holds no such value and is dropped. What the
    driver sees in a round is at most ``BINS`` counts for each of the ``1 / share`` ranks. Rows with a null count for the
    whole. ``share`` is text, so that it is exact. No rows, or only nulls: nothing.
    """
    v = F.col(column).cast("long")
    total, n, lo, hi = df.agg(F.count(F.lit(1)), F.count(column), F.min(v), F.max(v)).first()
    step = max(1, math.ceil(Fraction(share) * total))
    brackets = {(lo, hi): (n, list(range(step, n + 1, step)))} if n >= step else {}
    found = []
    while brackets:
        found += [(at, rows) for (at, end), (rows, _) in brackets.items() if at == end]
        open_ = {b: x for b, x in brackets.items() if b[0] < b[1]}
        if not open_:
            break
        counts = dict(df.groupBy(_bin_of(v, list(open_)).alias("_bin")).agg(F.count(F.lit(1)).alias("_rows")).filter("_bin is not null").collect())
        brackets, first = {}, 0
        for (low, high), (_, ranks) in open_.items():
            before = 0
            for i, part in enumerate(_bins(low, high)):
                rows = counts.get(first + i, 0)
                inside = [r - before for r in ranks if before < r <= before + rows]
                before += rows
                if inside and rows >= step:
                    brackets[part] = (rows, inside)
            first += len(_bins(low, high))
    return sorted(found)


def quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(k, q, x) with x the exact lower quantile: the value at rank ``ceil(q * n)``, at least 1, of the non-null values.

    ``counts`` from :func:`value_counts`, best materialised. Keys without a non-null value, and the null key, are
    left out. An empty input gives an empty result.
    """
    counts = counts.filter("k is not null and v is not null")
    ps = F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("q")
    state = key_totals(counts).select("k", "m", "lo", "hi", ps)
    rank = F.greatest(F.ceil(F.col("q") * F.col("m")), F.lit(1)).cast("long")
    state = materialize(state.select("k", "q", rank.alias("r"), "lo", "hi"), "ranks")
    hot = hot_keys(counts, "k")
    done: list[DataFrame] = []
    while True:
        open_ = state.filter("lo < hi")
        done.append(state.filter("lo = hi").select("k", "q", F.col("lo").alias("x")))
        if open_.isEmpty():
            break
        width = F.floor((F.col("hi") - F.col("lo")) / BINS) + 1
        wanted = open_.withColumn("w", width.cast("long")).groupBy(F.col("k").alias("kk")).agg(F.collect_list(F.struct("q", "r", "lo", "hi", "w")).alias("s"))
        met = split_join(counts, wanted, "k", "kk", "inner", hot).select("k", "v", "c", F.explode("s").alias("s"))
        binned = met.filter("v >= s.lo and v <= s.hi").select("k", "s", F.floor((F.col("v") - F.col("s.lo")) / F.col("s.w")).alias("b"), "c")
        hist = binned.groupBy("k", "s", "b").agg(F.sum("c").alias("c"))
        w = Window.partitionBy("k", "s").orderBy("b")  # at most BINS rows
        upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
        pick = hist.withColumn("upto", upto).filter("upto >= s.r and upto - c < s.r")
        lo = F.col("s.lo") + F.col("b") * F.col("s.w")
        state = materialize(
            pick.select("k", F.col("s.q").alias("q"), (F.col("s.r") - (F.col("upto") - F.col("c"))).alias("r"), lo.alias("lo"), F.least(lo + F.col("s.w") - 1, F.col("s.hi")).alias("hi")),
            "ranks",
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def distinct_per_key(df: DataFrame, key: str, *values: str) -> DataFrame:
    """(k, d): number of distinct combinations of non-null ``values`` per key, in two steps (by value, then by key)."""
    there = df.filter(" and ".join(f"{v} is not null" for v in values)).select(F.col(key).alias("k"), *values)
    return there.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("d"))
