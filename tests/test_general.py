"""Problems 2, 3, 5 and 6 on small dirty inputs, against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.functions import source_text
from treeloom.operators import dangling, intervals, selection, snapshots
from treeloom.queries import general


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# References without a target -----------------------------------------------------------------------------------------

def test_containers_round_trip():
    for codes in ([], [0], [65535], list(range(0, 65536, 7)), random.Random(1).sample(range(65536), 5000)):
        want = np.zeros(65536, bool)
        want[codes] = True
        got = np.zeros(65536, bool)
        dangling.unpack_into(dangling.pack(np.array(sorted(codes), np.int64)), got)
        assert (got == want).all()


def test_dangling_keys(spark):
    rng = random.Random(2)
    ids = [rng.randrange(1, 400_000) for _ in range(3000)] + [2**40 + i for i in range(50)] + [-5, -70000]
    parents = ids[:2000] + [2**40 + 3, -5]
    there, gone = set(ids[2000:2100]), set(ids[:100])
    refs = [(i, rng.choice([1, 2, None])) for i in ids] + [(None, 1), (0, 1)] + [(ids[5], 1)] * 1000
    ref = spark.createDataFrame(refs, "k long, v int").withColumn("role", F.lit("x"))
    side = dangling.side
    got = dangling.dangling_keys([
        side(ref, 0, 0, "k", F.col("v")),
        side(spark.createDataFrame([(p,) for p in parents] + [(None,)], "k long"), 0, dangling.IN_TABLE, "k"),
        side(spark.createDataFrame([(p,) for p in there], "k long"), 0, dangling.LOG_THERE, "k"),
        side(spark.createDataFrame([(p,) for p in gone], "k long"), 0, dangling.LOG_GONE, "k"),
    ])
    exists = (set(parents) - gone) | there
    want = {(0, dangling.NO_PERIOD if v is None else v, k) for k, v in refs if k and k not in exists}
    got = [tuple(r) for r in got.collect()]
    assert set(got) == want and len(got) == len(want)


def test_dangling_of_nothing(spark):
    none = spark.createDataFrame([], "k long")
    assert dangling.dangling_keys([dangling.side(none, 0, 0, "k"), dangling.side(none, 0, dangling.IN_TABLE, "k")]).count() == 0
    ref = spark.createDataFrame([(4,)], "k long")
    assert rows(dangling.dangling_keys([dangling.side(ref, 0, 0, "k"), dangling.side(none, 0, dangling.IN_TABLE, "k")]).select("key")) == [(4,)]


def test_references_are_counted_and_not_only_their_keys(spark, tmp_path):
    tables = {
        "m_ast_container": ([(1, 0, 0, 77), (1, 1, 0, 77), (2, 0, 0, 77), (2, 0, 0, 77), (2, 1, 0, 1)], "ast_id long, priority int, type_id short, ref_ast_id long"),
        "m_bridge_tag": ([(1, 5, 1, 1, 1, 1)], "fid long, tag_id long, line_s int, line_e int, char_s int, char_e int"),
        "m_ast_include": ([], "ast_id long, fnid long"),
        "m_tag": ([(5, 1, 0, "a", 77, 0, 0), (6, 1, 0, "a", 77, 0, 0), (6, 2, 0, "a", 77, 0, 0), (7, None, 0, "a", 78, 0, 0)], "tag_id long, vid_s int, vid_e int, code string, ast_id long, hl_s int, hl_l int"),
        "m_ast": ([(1, "x", 1), (2, "x", 1)], "ast_id long, name string, type_id short"),
        "m_file_name": ([], "fnid long, fname string"),
        "key_log": ([], "log_id long, tbl string, key_id long, vid int, what string, logged_at timestamp"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = general.p2_references(spark, str(tmp_path))
    assert rows(got) == sorted([("m_ast_container", "table", None, 3, 1), ("m_tag", "table", None, 4, 2), ("m_tag", "version", 1, 2, 1), ("m_tag", "version", 2, 1, 1), ("m_tag", "version", None, 1, 1)], key=repr)


def test_only_comments_of_directives_are_cut(spark):
    long = "x" * 300
    df = spark.createDataFrame([(1, f'#include "{long}"\n#error {long}\n# comment {long}')], "k long, text string")
    assert [r["rest"] for r in source_text.directive_rows(df, "k", "text").orderBy("line").collect()] == [f'"{long}"', long, long[:255]]


def test_last_log_entry(spark):
    log = spark.createDataFrame([(1, "t", 5, "arrived", 3), (2, "t", 5, "deleted", 3), (3, "t", 5, "arrived", None), (4, "t", 6, "arrived", 1), (5, None, 6, "deleted", 9)], "log_id long, tbl string, key_id long, what string, logged_at int")
    assert rows(dangling.last_log(log)) == [("t", 5, "deleted"), ("t", 6, "arrived")]


def test_text_keys_and_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(dangling, "CODES", 16)  # of keys in a range, in local workers only if they see it; results are the same
    side = dangling.side
    keys = [f"k{i:05d}" for i in range(500)]
    ref = spark.createDataFrame([(t, k) for t in (0, 1) for k in keys], "t int, k string")
    there = spark.createDataFrame([(k,) for k in keys[::3]], "k string")
    got = dangling.dangling_keys([side(ref.filter("t = 0"), 0, 0, "k"), side(ref.filter("t = 1"), 1, 1, "k"), side(there, 0, dangling.IN_TABLE, "k"), side(there.limit(0), 1, dangling.IN_TABLE, "k")])
    assert rows(got.select("role", "key")) == sorted([(0, k) for i, k in enumerate(keys) if i % 3] + [(1, k) for k in keys], key=repr)


def test_ranges_end_where_they_should(monkeypatch):
    monkeypatch.setattr(dangling, "CODES", 8)
    rng = random.Random(7)
    refs, there = {(t, rng.randrange(200)) for t in (0, 1) for _ in range(90)}, {(t, rng.randrange(200)) for t in (0, 1) for _ in range(90)}
    data = sorted([(t, k, t, p) for t, k in refs for p in (1, 2)] + [(t, k, dangling.IN_TABLE, 0) for t, k in there])
    for size in (1, 5, 17, 1000):
        batches = [pa.RecordBatch.from_pydict({"tgt": pa.array([r[0] for r in part], pa.int32()), "role": pa.array([r[2] for r in part], pa.int32()), "period": pa.array([r[3] for r in part], pa.int32()), "key": pa.array([r[1] for r in part], pa.int64())})
                   for part in (data[i : i + size] for i in range(0, len(data), size))]
        got = [tuple(r.values()) for b in dangling._and_not(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((t, p, k) for t, k in refs - there for p in (1, 2))
        assert sum(b.num_rows for b in dangling._distinct(iter(batches * 2))) == len(data)


# Snapshots -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [3, 12, None])
def test_snapshot_changes(spark, bits):
    rng = random.Random(bits or 0)
    data = []
    for v in (1, 2, 5, 9):
        for k in range(300):
            if rng.random() < 0.9:
                data += [(v, k, 7 if rng.random() < 0.9 else rng.choice([8, 9, None]))] * rng.randint(1, 2)
        data.append((v, None, 3))
    data += [(None, 1, 1), (11, None, 4)]
    df = spark.createDataFrame(data, "vid int, fnid long, fid long").withColumn("leaf", F.lit("x")).withColumn("x", F.lit(1))
    state = defaultdict(dict)
    for v, k, x in data:
        if v is not None:
            state[v]
            if k is not None:
                old = state[v].get(k)
                state[v][k] = x if old is None else old if x is None else max(old, x)
    want, vids = [], sorted(state)
    for a, b in zip(vids, vids[1:]):
        for k in set(state[a]) | set(state[b]):
            if k not in state[a]:
                want.append((b, k, "A"))
            elif k not in state[b]:
                want.append((b, k, "D"))
            elif state[a][k] != state[b][k]:
                want.append((b, k, "M"))
    assert rows(snapshots.merkle_changes(df, "vid", "fnid", "fid", leaf_bits=bits)) == sorted(want, key=repr)
    known = snapshots.leaf_digests(df.filter("vid <= 2"), "vid", "fnid", "fid", bits or 3)  # stored before
    assert rows(snapshots.merkle_changes(df, "vid", "fnid", "fid", leaf_bits=bits or 3, known=known)) == sorted(want, key=repr)


def test_no_snapshot(spark):
    assert snapshots.merkle_changes(spark.createDataFrame([], "vid int, fnid long, fid long"), "vid", "fnid", "fid").count() == 0


# Intervals -----------------------------------------------------------------------------------------------------------

def brute_intervals(data):
    per = defaultdict(set)
    for src, k, lo, hi in data:
        if k and lo is not None and hi is not None:
            h = math.inf if src == 0 and hi == 0 else hi
            if h >= lo:
                per[src, k].add((lo, h))
    out = []
    for (src, k), s in per.items():
        merged = []
        for lo, hi in sorted(s):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
                merged[-1][2] += 1
            else:
                merged.append([lo, hi, 1])
        for i, (lo, hi, n) in enumerate(merged):
            out.append((src, k, False, lo, intervals.OPEN if hi == math.inf else hi, n > 1))
            if i:
                out.append((src, k, True, merged[i - 1][1] + 1, lo - 1, False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [2_000_000, 3])
def test_intervals(spark, hot_rows, monkeypatch):
    rng = random.Random(hot_rows)
    data = [(src, rng.choice([1, 2, 3, 0, None, 50, 51]), rng.choice([rng.randint(-3, 300), None]) if rng.random() < 0.1 else rng.randint(1, 300), None) for src in (0, 1) for _ in range(400)]
    data = [(s, k, lo, rng.choice([None, 0, (lo or 1) - 2]) if rng.random() < 0.1 else (lo or 1) + rng.randint(0, 6)) for s, k, lo, _ in data]
    data += data[:100]
    data += [(0, 9, 5, 0), (0, 9, 5, 0), (1, 9, 0, 0)]
    monkeypatch.setattr(intervals, "FLUSH_ROWS", 37)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    df = spark.createDataFrame(data, "s int, k long, lo int, hi int").withColumn("multi", F.lit("x")).withColumn("src", F.lit(8)).withColumn("key", F.lit(8))
    rows_in = intervals.interval_rows(df.filter("s = 0"), 0, "k", "lo", "hi", open_end=0).unionAll(intervals.interval_rows(df.filter("s = 1"), 1, "k", "lo", "hi"))
    assert rows(intervals.merged_and_gaps(rows_in, hot_rows=hot_rows)) == brute_intervals(data)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_intervals(spark):
    df = spark.createDataFrame([(1, 3, 2), (0, 1, 2), (None, 1, 1)], "k long, lo int, hi int")
    assert intervals.merged_and_gaps(intervals.interval_rows(df, 0, "k", "lo", "hi")).count() == 0


def test_adjoining_and_covered(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 3, 4), (1, 7, 7), (2, 5, 5), (2, 5, 5)], "k long, lo int, hi int")
    r = intervals.interval_rows(df, 0, "k", "lo", "hi")
    assert rows(intervals.merged_and_gaps(r)) == [(0, 1, False, 1, 4, True), (0, 1, False, 7, 7, False), (0, 1, True, 5, 6, False), (0, 2, False, 5, 5, False)]
    assert rows(intervals.covered(r)) == [(0, 1, 5), (0, 2, 1)]


# Skewed keys ---------------------------------------------------------------------------------------------------------

def test_quantiles(spark):
    rng = random.Random(3)
    data = [(1, rng.randint(-10**9, 10**9)) for _ in range(3000)] + [(2, 5)] * 50 + [(3, None)] * 4 + [(None, 7)] + [(4, x) for x in (1, 1, 2)]
    df = spark.createDataFrame(data, "key long, val long").withColumn("k", F.lit("x")).withColumn("v", F.lit(1))
    got = {(r[0], r[1]): r[2] for r in selection.quantiles(selection.value_counts(df, "key", "val"), (0.0, 0.5, 0.9, 1.0)).collect()}
    want = {}
    for k in (1, 2, 4):
        xs = sorted(v for kk, v in data if kk == k)
        for q in (0.0, 0.5, 0.9, 1.0):
            want[k, q] = xs[max(1, math.ceil(q * len(xs))) - 1]
    assert got == want


def test_quantiles_with_hot_key(spark, monkeypatch):
    monkeypatch.setattr(selection, "hot_keys", lambda df, key, **kw: [1])
    df = spark.createDataFrame([(k, v) for k in (1, 2) for v in range(1000)], "k long, v long")
    assert rows(selection.quantiles(selection.value_counts(df, "k", "v"), (0.5,))) == [(1, 0.5, 499), (2, 0.5, 499)]


def test_heavy_values(spark):
    data = [(1,)] * 3 + [(None,)] * 90 + [(i,) for i in range(2, 9)]
    df = spark.createDataFrame(data, "k long")
    assert selection.heavy_values(df, "k", "0.03") == [(1, 3)]
    assert selection.heavy_values(df.limit(0), "k", "0.03") == selection.heavy_values(df.filter("k is null"), "k", "0.03") == []
    assert selection.quantiles(selection.value_counts(df.withColumn("v", F.lit(1)).limit(0), "k", "v"), (0.5,)).count() == 0
    rng = random.Random(3)
    for spread in (5, 300, 10**6, 2**63 - 1):
        hot = [rng.randint(-spread, spread) for _ in range(6)] + [-spread, spread]
        keys = [rng.choice(hot) if rng.random() < 0.5 else rng.randint(-spread, spread) for _ in range(1500)]
        some = spark.createDataFrame([(k,) for k in keys], "k long")
        assert selection.heavy_values(some, "k", "0.03") == sorted((k, n) for k, n in Counter(keys).items() if n * 100 >= 3 * len(keys))


def test_distinct_per_key(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, None), (2, 3), (2, 4)], "key long, val long").withColumn("d", F.lit(0))
    assert dict(Counter({r[0]: r[1] for r in selection.distinct_per_key(df, "key", "val").collect()})) == {1: 1, 2: 2}
