"""Overlapping and gapped intervals: a mergeable aggregate of sorted disjoint intervals.

The state of a key is its list of disjoint merged intervals in order, each with a mark telling whether it was made of
at least two different intervals. Two states merge linearly. Partial states are built for all keys of a scan
partition at once (vectorised), so a key that holds a third of all rows leaves each task as its few merged intervals.
States then meet by key: the last step reads a key's partial lists as one sorted stream and holds nothing but the
interval it is extending, then emits the merged periods and the complement between them. Keys that are still hot then
go through one more level of the tree, in blocks of their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.runtime import hot_keys, materialize

#: An open end; larger than any end, and one more than it does not overflow.
OPEN = 2**62
STATE = "src int, key long, lo long, hi long, multi boolean"
FLUSH_ROWS = 500_000


def merge_sorted(src, key, lo, hi, multi):
    """Merge intervals sorted by (src, key, lo) into disjoint ones; numbers that adjoin belong together."""
    n = len(lo)
    if n == 0:
        return src, key, lo, hi, multi
    group = np.ones(n, bool)
    group[1:] = (src[1:] != src[:-1]) | (key[1:] != key[:-1])
    # Running maximum of hi inside each key: rank the ends so that keys can be offset without overflow.
    ends, rank = np.unique(hi, return_inverse=True)
    gid = np.cumsum(group) - 1
    top = ends[np.maximum.accumulate(gid * len(ends) + rank) - gid * len(ends)]
    start = group.copy()
    start[1:] |= lo[1:] > top[:-1] + 1
    at = np.flatnonzero(start)
    lo0, hi0 = lo[at], hi[at]
    pid = np.cumsum(start) - 1
    out_hi = np.maximum.reduceat(hi, at)
    out_multi = np.logical_or.reduceat(multi | (lo != lo0[pid]) | (hi != hi0[pid]), at)
    return src[at], key[at], lo0, out_hi, out_multi


def _batch(src, key, lo, hi, multi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(src, pa.int32()), pa.array(key, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(multi, pa.bool_())],
        names=["src", "key", "lo", "hi", "multi"],
    )


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of what a task reads, flushed every FLUSH_ROWS rows."""
    held, n = [], 0

    def flush():
        cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        return merge_sorted(*(c[order] for c in cols))

    for b in batches:
        if b.num_rows:
            held.append(_columns(b))
            n += b.num_rows
        if n >= FLUSH_ROWS:
            merged = flush()
            yield _batch(*merged)
            held, n = [], 0
    if n:
        yield _batch(*flush())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Linear merge of a stream sorted by (src, key, lo): yields merged columns; only the last interval is carried over."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = _columns(b)
        if carry is not None:
            cols = [np.concatenate([c, x]) for c, x in zip(carry, cols, strict=True)]
        cols = merge_sorted(*cols)
        carry = [c[-1:] for c in cols]
        if len(cols[0]) > 1:
            yield tuple(c[:-1] for c in cols)
    if carry is not None:
        yield tuple(carry)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _merged(batches):
        yield _batch(*cols)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, key, gap, lo, hi, multi): the periods, and the gap between each and the one before."""
    last = None
    for src, key, lo, hi, multi in _merged(batches):
        p_src, p_key, p_hi = (np.concatenate([[x], c[:-1]]) for x, c in zip(last or (-1, 0, 0), (src, key, hi), strict=True))
        last = (src[-1], key[-1], hi[-1])
        gap = (p_src == src) & (p_key == key)
        rows = [
            np.concatenate([src, src[gap]]),
            np.concatenate([key, key[gap]]),
            np.concatenate([np.zeros(len(src), bool), np.ones(gap.sum(), bool)]),
            np.concatenate([lo, p_hi[gap] + 1]),
            np.concatenate([hi, lo[gap] - 1]),
            np.concatenate([multi, np.zeros(gap.sum(), bool)]),
        ]
        types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["src", "key", "gap", "lo", "hi", "multi"])


def interval_rows(df: DataFrame, src: int, key: str, lo: str, hi: str, open_end: int | None = None) -> DataFrame:
    """Rows of ``df`` as one-interval states. Key 0 or null, null bounds and ends before starts do not count.

    ``open_end``: the value of ``hi`` that means no end; None if there is none.
    """
    h = F.col(hi).cast("long")
    if open_end is not None:
        h = F.when(F.col(hi) == open_end, F.lit(OPEN)).otherwise(h)
    return (
        df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("key"), F.col(lo).cast("long").alias("lo"), h.alias("hi"), F.lit(False).alias("multi"))
        .filter("key is not null and key <> 0 and lo is not null and hi is not null and hi >= lo")
    )


_OUT = "src int, key long, gap boolean, lo long, hi long, multi boolean"


def merged_and_gaps(rows: DataFrame, hot_rows: int = 2_000_000) -> DataFrame:
    """(src, key, gap, lo, hi, multi) of all keys of ``rows`` (from :func:`interval_rows`, of one or more sources).

    Periods (gap false) are the merged intervals; ``multi`` tells that a period was made of at least two different
    intervals (equal rows are one). Gaps lie between successive periods of a key. ``hi`` is OPEN for an open period.
    Keys whose partial lists still hold ``hot_rows`` rows after the map side are split into blocks of their range.
    """
    partial = materialize(rows.mapInArrow(_partial, STATE), "intervals")
    hot = hot_keys(partial, "key", share=0.01, least=hot_rows)
    is_hot = F.col("key").isin(*hot)
    by_key = partial.filter(~is_hot) if hot else partial
    out = by_key.repartition("src", "key").sortWithinPartitions("src", "key", "lo", "hi").mapInArrow(_emit, _OUT)
    return out.unionByName(_in_blocks(partial.filter(is_hot), hot_rows)) if hot else out


def _in_blocks(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Periods and gaps of hot keys (at most a hundred), none of whose lists has to pass through one task.

    A key's range is cut into blocks by quantiles of ``lo``. Blocks merge on their own; all that crosses a block's edge
    is the greatest end before it (the carry). Inside a block, which is sorted and disjoint by then, the intervals
    reached by the carry are a prefix and belong to a period that starts in an earlier block; the others start periods.
    """
    counts = rows.groupBy("src", "key").count()
    blocks = min(1000, 1 + counts.agg(F.max("count")).first()[0] // max(1, hot_rows // 4))
    cuts = rows.groupBy("src", "key").agg(F.percentile_approx("lo", [(i + 1) / (blocks + 1) for i in range(blocks)], 10_000).alias("cuts"))
    block = F.size(F.filter("cuts", lambda c: c <= F.col("lo")))
    parts = rows.join(F.broadcast(cuts), ["src", "key"]).select("src", "key", "lo", "hi", "multi", block.alias("block"))
    # Blocks of one key are told apart by their number in the source column, which then comes back.
    tagged = parts.select((F.col("src") * 4096 + F.col("block")).cast("int").alias("src"), "key", "lo", "hi", "multi")
    merged = tagged.repartition("src", "key").sortWithinPartitions("src", "key", "lo", "hi").mapInArrow(_reduce, STATE)
    merged = materialize(merged.select(F.shiftright("src", 12).alias("src"), F.col("src").bitwiseAND(4095).alias("block"), "key", "lo", "hi", "multi"), "blocks")

    key = Window.partitionBy("src", "key").orderBy("block")  # one row per block
    ends = merged.groupBy("src", "key", "block").agg(F.max("hi").alias("top"))
    carry = ends.select("src", "key", "block", F.max("top").over(key.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    rows = merged.join(F.broadcast(carry), ["src", "key", "block"]).withColumn("reached", F.coalesce(F.col("lo") <= F.col("carry") + 1, F.lit(False)))
    per = rows.groupBy("src", "key", "block").agg(
        F.max(F.when(F.col("reached"), F.col("hi"))).alias("far"), F.max(F.when(~F.col("reached"), F.col("lo"))).alias("last"), F.count(F.when(F.col("reached"), 1)).alias("k"), F.max("carry").alias("carry")
    )
    per = materialize(per.withColumn("group", F.coalesce(F.sum(F.when(F.col("last").isNotNull(), 1).otherwise(0)).over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "edges")
    ext = per.filter("k > 0").groupBy("src", "key", "group").agg(F.max("far").alias("ext"))
    heads = per.filter("last is not null").select("src", "key", "block", "last", F.greatest("carry", "far").alias("before"), (F.col("group") + 1).alias("group"))
    heads = heads.join(ext, ["src", "key", "group"], "left").drop("group")
    inside = Window.partitionBy("src", "key", "block").orderBy("lo")
    starts = rows.filter("not reached").join(F.broadcast(heads), ["src", "key", "block"])
    is_last = F.col("lo") == F.col("last")
    starts = starts.withColumn("prev", F.coalesce(F.lag("hi").over(inside), "before"))
    periods = starts.select(
        "src", "key", F.lit(False).alias("gap"), "lo", F.when(is_last, F.greatest("hi", "ext")).otherwise(F.col("hi")).alias("hi"),
        (F.col("multi") | (is_last & F.col("ext").isNotNull())).alias("multi"),
    )
    gaps = starts.filter("prev is not null").select("src", "key", F.lit(True).alias("gap"), (F.col("prev") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"), F.lit(False).alias("multi"))
    return periods.unionByName(gaps)


def covered(rows: DataFrame) -> DataFrame:
    """(src, key, covered): how many numbers the merged intervals of a key hold; open periods do not count."""
    return merged_and_gaps(rows).filter(f"not gap and hi < {OPEN}").groupBy("src", "key").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"))
