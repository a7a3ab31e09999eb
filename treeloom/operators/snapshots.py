"""What changed between full snapshots: Merkle digests over hash ranges, rows compared only where digests differ."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.runtime import materialize

#: Rows of a snapshot in one leaf range, on average.
LEAF_ROWS = 8


#: Bits kept of the sums of a digest, so that parents can add up their children's.
_KEPT = 2**45 - 1
_PART = 2**27 - 1


def snapshot_pairs(snapshots: DataFrame, vid: str) -> DataFrame:
    """(old, new) of consecutive snapshots in order of ``vid``; one row per snapshot, so the window is small."""
    vids = snapshots.select(F.col(vid).alias("new")).filter("new is not null").distinct()
    return vids.withColumn("old", F.lag("new").over(Window.orderBy("new"))).filter("old is not null")


def leaf_bits_for(rows: int) -> int:
    """Bits that cut a snapshot of so many rows into ranges of about LEAF_ROWS rows."""
    return min(30, max(0, math.ceil(math.log2(max(1, rows / LEAF_ROWS)))))


def _rows(snapshots: DataFrame, vid: str, key: str, value: str, leaf_bits: int) -> DataFrame:
    leaf = F.shiftrightunsigned(F.xxhash64("k"), 64 - leaf_bits).cast("int") if leaf_bits else F.lit(0)
    rows = snapshots.filter(F.col(key).isNotNull() & F.col(vid).isNotNull()).select(F.col(vid).alias("v"), F.col(key).alias("k"), F.col(value).alias("x"))
    return rows.select("v", "k", "x", leaf.alias("node"))


def leaf_digests(snapshots: DataFrame, vid: str, key: str, value: str, leaf_bits: int) -> DataFrame:
    """(v, node, d1, d2, d3, n): the digest of each hash range of each snapshot, repeated rows included.

    Two sums of 27 bits of a hash, a xor of another hash, and a count: they merge in any order, on the map side first.
    A snapshot does not change, so its digests may be stored and passed to :func:`merkle_changes` later.
    """
    h = F.xxhash64("k", "x", F.col("x").isNull())
    other = F.xxhash64(F.lit("second"), "x", "k", F.col("x").isNull())
    return _rows(snapshots, vid, key, value, leaf_bits).groupBy("v", "node").agg(
        F.sum(h.bitwiseAND(_PART)).alias("d1"), F.sum(F.shiftrightunsigned(h, 27).bitwiseAND(_PART)).alias("d2"), F.bit_xor(other).alias("d3"), F.count(F.lit(1)).alias("n")
    )


def _parents(level: DataFrame, bits: int) -> DataFrame:
    kept = [F.sum(F.col(d).bitwiseAND(_KEPT)).alias(d) for d in ("d1", "d2")]
    return level.groupBy("v", F.shiftright("node", bits).alias("node")).agg(*kept, F.bit_xor("d3").alias("d3"), F.sum("n").alias("n"))


def merkle_changes(snapshots: DataFrame, vid: str, key: str, value: str, leaf_bits: int | None = None, fan_bits: int = 7, known: DataFrame | None = None) -> DataFrame:
    """Changes between consecutive snapshots: (vid, key, change) with change A, D or M.

    1. A key belongs to one of ``2**leaf_bits`` hash ranges. Each (vid, range) gets a digest of its rows where they are
       read; only digests are shuffled. Those of ``2**fan_bits`` neighbours add up to their parent's, up to the root;
       each level is written once.
    2. Top-down, a node is compared only below a parent whose digests differ.
    3. The rows of leaf ranges that differ are read again and reduced to one per (vid, key) with the greatest value; of
       each two snapshots they are compared key by key. A null value equals a null value.

    Null keys and null vids are no rows (but a snapshot with null keys only still counts as a snapshot). Repeated rows
    make digests differ at most, which costs a comparison of rows and changes no result. Digests are 118 bits and a
    count, not keyed; different ranges with equal digests are not expected.

    ``leaf_bits`` defaults to ranges of about LEAF_ROWS rows. ``known`` are digests stored before (:func:`leaf_digests`
    with the same ``leaf_bits``): the snapshots in them are not digested again.
    """
    sizes = snapshots.filter(F.col(vid).isNotNull()).groupBy(F.col(vid).alias("v")).agg(F.count(key).alias("n")).collect()  # one row per snapshot
    if leaf_bits is None:
        leaf_bits = leaf_bits_for(max((r["n"] for r in sizes), default=0))
    fresh = snapshots
    if known is not None:
        fresh = snapshots.join(F.broadcast(known.select(F.col("v").alias("_known")).distinct()), F.col(vid) == F.col("_known"), "left_anti")
    level = leaf_digests(fresh, vid, key, value, leaf_bits)
    level = materialize(level if known is None else level.unionByName(known), "digests")
    levels, bits = [(leaf_bits, level)], leaf_bits
    while bits > 0:
        up = min(fan_bits, bits)
        level = materialize(_parents(level, up), "digests")
        bits -= up
        levels.append((bits, level))
    # One row per snapshot and role: each snapshot is the later one of a pair and the earlier one of the next.
    vids = sorted(r["v"] for r in sizes)
    kind = dict(snapshots.dtypes)[vid]
    steps = [x for old, new in zip(vids, vids[1:], strict=False) for x in ((old, new, 0), (new, new, 1))]
    roles = F.broadcast(snapshots.sparkSession.createDataFrame(steps, f"v {kind}, new {kind}, side int"))
    differing, above = None, 0
    for bits, level in reversed(levels):
        both = level.join(roles, "v")
        if differing is not None:
            parent = differing.withColumnRenamed("node", "parent")
            both = both.withColumn("parent", F.shiftright("node", bits - above)).join(parent, ["new", "parent"], "left_semi")
        differs = F.count(F.lit(1)) != 2
        for d in ("d1", "d2", "d3", "n"):
            differs = differs | (F.min(d) != F.max(d))
        found = both.groupBy("new", "node").agg(differs.alias("differs")).filter("differs").select("new", "node")
        differing = materialize(found, "differing")
        above = bits
    sides = _rows(snapshots, vid, key, value, leaf_bits).join(roles, "v").join(differing, ["new", "node"], "left_semi")
    here = F.struct("x")
    change = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").when(~F.col("a.x").eqNullSafe(F.col("b.x")), "M")
    return (
        sides.groupBy("new", "k")
        .agg(F.max(F.when(F.col("side") == 0, here)).alias("a"), F.max(F.when(F.col("side") == 1, here)).alias("b"))
        .select(F.col("new").alias(vid), F.col("k").alias(key), change.alias("change"))
        .filter("change is not null")
    )
