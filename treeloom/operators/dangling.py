"""References to records that do not exist: compressed bitmaps per key range, reference AND-NOT parent.

1. Each task leaves one row for each distinct (target, role, period, key) it reads, so a key that a third of all rows
   refer to costs a row before the shuffle. Keys go to hash ranges; the ranges arrive in the order of their keys.
2. The keys of a range get a dictionary: their places in that order, dense whatever the keys are (far apart, hashed, or
   text). It is built while the range streams by, 65,536 keys at a time, and left behind with them.
3. Codes form one container for each role and period: a sorted array of 16-bit codes while it is sparse, a bitmap of
   8 KB beyond 4,096 codes. ``reference AND NOT parent`` is computed on them and what survives is decoded.

A range in work has at most 65,536 keys, which bounds the memory whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of the parent side: the row is in the table; the last log entry says it is there; or that it is gone.
IN_TABLE, LOG_THERE, LOG_GONE = 100, 101, 102
NO_PERIOD = -(2**31)
CODES = 65536
ARRAY_MAX = 4096
FLUSH_ROWS = 500_000


def pack(codes: np.ndarray) -> bytes:
    """Sorted unique 16-bit codes as a container."""
    if len(codes) <= ARRAY_MAX:
        return b"a" + codes.astype("<u2").tobytes()
    bits = np.zeros(CODES, np.uint8)
    bits[codes] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack_into(data: bytes, bits: np.ndarray) -> None:
    """OR a container into an array of 65,536 flags."""
    if data[:1] == b"a":
        bits[np.frombuffer(data, "<u2", offset=1)] = True
    else:
        bits |= np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little").view(bool)


def and_not(data: bytes, bits: np.ndarray) -> np.ndarray:
    """The codes of a container that the flags lack, in order; a sparse one costs only its own codes."""
    if data[:1] == b"a":
        codes = np.frombuffer(data, "<u2", offset=1)
        return codes[~bits[codes]]
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little").view(bool) & ~bits)


_COLUMNS = ("tgt", "role", "period", "key")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each combination once for every FLUSH_ROWS rows a task reads."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= FLUSH_ROWS:
            yield from pa.Table.from_batches(held).group_by(list(_COLUMNS)).aggregate([]).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).group_by(list(_COLUMNS)).aggregate([]).combine_chunks().to_batches()


def _range(rows: pa.Table, code: np.ndarray, at: np.ndarray) -> pa.Table:
    """The dangling (role, period, key) among the rows of a range of keys, given the dictionary code of each row."""
    role, period = (rows.column(c).to_numpy() for c in ("role", "period"))
    order = np.lexsort((code, period, role))
    role, period, code = role[order], period[order], code[order]
    new = np.r_[True, (role[1:] != role[:-1]) | (period[1:] != period[:-1])]
    first = np.flatnonzero(new)
    containers = [(int(role[i]), int(period[i]), pack(c)) for i, c in zip(first, np.split(code, first[1:]), strict=True)]
    parents = {r: np.zeros(CODES, bool) for r in (IN_TABLE, LOG_THERE, LOG_GONE)}
    for r, _, data in containers:
        if r >= IN_TABLE:
            unpack_into(data, parents[r])
    there = (parents[IN_TABLE] & ~parents[LOG_GONE]) | parents[LOG_THERE]
    left = [(r, p, and_not(data, there)) for r, p, data in containers if r < IN_TABLE]
    codes = np.concatenate([c for _, _, c in left]).astype(np.int64) if left else np.zeros(0, np.int64)
    many = [len(c) for _, _, c in left]
    keys = rows.column("key").take(pa.array(at[codes]))  # decoded: a key's first row stands for its code
    return pa.table({"role": pa.array(np.repeat([r for r, _, _ in left], many), pa.int32()), "period": pa.array(np.repeat([p for _, p, _ in left], many), pa.int32()), "key": keys})


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (tgt, key). A range ends after CODES keys or with its target table."""
    held, n = None, 0

    def ranges(rows: pa.Table, end: bool) -> tuple[list[pa.Table], pa.Table]:
        tgt, key = rows.column("tgt").to_numpy(), rows.column("key").combine_chunks()
        other = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) if len(key) > 1 else np.zeros(0, bool)
        new = np.r_[True, other | (tgt[1:] != tgt[:-1])]
        at = np.flatnonzero(new)
        nth, out, done = np.cumsum(new) - 1, [], 0
        starts = np.flatnonzero(np.r_[True, tgt[at][1:] != tgt[at][:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(at)], strict=True):
            for low in range(a, b, CODES):
                high = min(low + CODES, b)
                if high == len(at) and not end:  # its last key, and the range, may go on in the next batch
                    break
                stop = at[high] if high < len(at) else rows.num_rows
                out.append(_range(rows.slice(at[low], stop - at[low]), nth[at[low] : stop] - low, at[low:high] - at[low]))
                done = stop
        return out, rows.slice(done)

    for b in batches:
        if b.num_rows:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            n += b.num_rows
        if n >= 2 * CODES:
            out, held = ranges(held, False)
            n = 0
            for t in out:
                yield from t.combine_chunks().to_batches()
    if held is not None and held.num_rows:
        for t in ranges(held, True)[0]:
            yield from t.combine_chunks().to_batches()


def side(df: DataFrame, tgt: int, role: int, key: str, period: Column | None = None) -> DataFrame:
    """One side of the comparison as (tgt, role, period, key); null keys drop out, and 0 where it means no reference.

    Integer keys are longs; keys of other types stay as they are (all sides must agree).
    """
    p = F.lit(NO_PERIOD) if period is None else F.coalesce(period.cast("int"), F.lit(NO_PERIOD))
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    keys = df.filter(F.col(key).isNotNull())
    if role < IN_TABLE and whole:
        keys = keys.filter(F.col(key) != 0)
    return keys.select(F.lit(tgt).alias("tgt"), F.lit(role).alias("role"), p.alias("period"), (F.col(key).cast("long") if whole else F.col(key)).alias("key"))


def last_log(key_log: DataFrame) -> DataFrame:
    """(tbl, key_id, what) of the last entry of each key by (logged_at, log_id), null times first."""
    return (
        key_log.filter("tbl is not null and key_id is not null")
        .groupBy("tbl", "key_id")
        .agg(F.max(F.struct("logged_at", "log_id", "what")).getField("what").alias("what"))
    )


def dangling_keys(sides: list[DataFrame]) -> DataFrame:
    """(role, period, key) of references to missing targets; ``sides`` from :func:`side`, references and parents."""
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionAll(s)
    kind = dict(rows.dtypes)["key"]
    once = rows.mapInArrow(_distinct, f"tgt int, role int, period int, key {kind}")
    # Tasks leave their own rows; the second distinct needs no further shuffle and bounds the rows of a key.
    return once.repartition("tgt", "key").distinct().sortWithinPartitions("tgt", "key").mapInArrow(_and_not, f"role int, period int, key {kind}")
