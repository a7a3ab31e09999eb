"""Problem 1: chains rebuilt from stored rows and updates, against a step-by-step version."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from treeloom.operators import chains

STORED = "kind string, key_id long, vid_s int, vid_e int, code string, ast_id long"
UPD = "upd_id long, kind string, key_id long, vid int, stat string, code string, ast_id long, arrived_at timestamp_ntz"


def brute(stored, updates):
    keys = {(r[0], r[1]) for r in stored} | {(u[1], u[2]) for u in updates if u[3] is not None}
    out = []
    for kind, key in keys:
        starts, ends = defaultdict(list), set()
        for r in stored:
            if (r[0], r[1]) == (kind, key) and r[2] is not None:
                starts[r[2]].append((r[4], r[5]))
                if r[3]:
                    ends.add(r[3] + 1)
        ups = defaultdict(list)
        for u in updates:
            if (u[1], u[2]) == (kind, key) and u[3] is not None:
                ups[u[3]].append(u)
        now, since, versions = None, None, []

        def close(v):
            if now is not None:
                versions.append([since, v - 1, now])

        low = lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0)
        for v in sorted(set(starts) | ends | set(ups)):
            if v in ups:
                u = max(ups[v], key=lambda u: (u[7] or datetime.min, u[0]))
                if u[4] == "D":
                    close(v)
                    now = None
                    continue
                old = now or (None, None)
                new = (u[5] if u[5] is not None else old[0], u[6] if u[6] is not None else old[1])
            elif v in starts:
                new = max(starts[v], key=low)
            else:
                close(v)
                now = None
                continue
            if now is not None and kind == "tag" and new == now:
                continue
            close(v)
            now, since = new, v
        if now is not None:
            versions.append([since, 0, now])
        out += [(kind, key, a, b, *n) for a, b, n in versions]
    return sorted(out, key=repr)


def frames(spark, stored, updates):
    s = spark.createDataFrame(stored, STORED)
    u = spark.createDataFrame(updates, UPD)
    for name in ("vid_e", "start", "goes_on", "ends"):  # clashing names must not matter
        u = u.withColumn(name, F.lit("x"))
    return s, u


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_chains(spark):
    rng = random.Random(5)
    stored, updates = [], []
    for kind in ("tag", "file"):
        for key in range(1, 40):
            for _ in range(rng.randint(0, 4)):
                s = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, None])
                e = rng.choice([0, 0, 1, 3, 4, 5, 8, None])
                val = (rng.choice(["a", "b", None]), rng.choice([1, 2, None])) if kind == "tag" else (None, None)
                stored += [(kind, key, s, e, *val)] * rng.randint(1, 2)
            for _ in range(rng.randint(0, 4)):
                t = datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 3))
                val = (rng.choice(["a", "b", None]), rng.choice([1, 2, None])) if kind == "tag" else (None, None)
                updates.append((len(updates) + 1, kind, key, rng.choice([1, 2, 4, 6, 9, None]), rng.choice("ADMR"), *val, t))
    s, u = frames(spark, stored, updates)
    assert rows(chains.rebuild(s, u)) == brute(stored, updates)


def test_null_code_keeps_the_value_in_force(spark):
    t = datetime(2024, 1, 1)
    stored = [("tag", 1, 1, 0, "a", 7)]
    updates = [(1, "tag", 1, 3, "M", None, 8, t), (2, "tag", 1, 5, "D", None, None, t), (3, "tag", 1, 6, "A", None, None, t)]
    s, u = frames(spark, stored, updates)
    assert rows(chains.rebuild(s, u)) == [("tag", 1, 1, 2, "a", 7), ("tag", 1, 3, 4, "a", 8), ("tag", 1, 6, 0, None, None)]


def test_only_touched_chains(spark):
    tag = spark.createDataFrame([(1, 1, 0, "a", 1), (2, 1, 0, "b", 1)], "tag_id long, vid_s int, vid_e int, code string, ast_id long")
    file = spark.createDataFrame([(10, 1, 2), (11, 3, 0)], "fid long, vid_s int, vid_e int")
    bridge = spark.createDataFrame([(1, 5, 10), (3, 5, 11), (3, None, 11)], "vid int, fnid long, fid long")
    t = datetime(2024, 1, 1)
    u = spark.createDataFrame([(1, "tag", 1, 4, "M", "c", None, t), (2, "tag", 2, None, "M", "c", None, t), (3, "file", 5, 6, "D", None, None, t)], UPD)
    got = rows(chains.affected_chains(tag, file, bridge, u).select("kind", "key_id", "vid_s", "vid_e"))
    assert got == [("file", 5, 1, 2), ("file", 5, 3, 5), ("tag", 1, 1, 3), ("tag", 1, 4, 0)]
    store = chains.ChainStore(spark, buckets=3)
    store.write(chains.stored_history(tag, file, bridge))
    store.replace(chains.touched_keys(u), chains.affected_chains(tag, file, bridge, u))
    assert rows(store.read().select("kind", "key_id", "vid_s", "vid_e")) == sorted(got + [("tag", 2, 1, 0)])


def test_empty(spark):
    s, u = frames(spark, [], [])
    assert rows(chains.rebuild(s, u)) == []


def test_store_replaces_chains_at_once(spark, tmp_path):
    schema = "kind string, key_id long, vid_s int, vid_e int, code string, ast_id long"
    store = chains.ChainStore(spark, f"file://{tmp_path}/store", buckets=4)
    store.write(spark.createDataFrame([("tag", k, 1, 0, "a", k) for k in range(20)], schema))
    new = spark.createDataFrame([("tag", 3, 1, 4, "a", 3), ("tag", 3, 5, 0, "b", 3), ("tag", 99, 2, 0, "n", 1)], schema)
    before = store.read()
    touched = new.select("kind", "key_id").unionByName(spark.createDataFrame([("tag", 7)], "kind string, key_id long"))
    store.replace(touched, new)
    after = rows(store.read())
    assert len(after) == 18 + 3 and ("tag", 3, 5, 0, "b", 3) in after and not any(r[1] == 7 for r in after)
    assert before.count() == 20  # a reader of the old state still sees it whole


def test_a_replacement_that_dies_can_be_repeated(spark, tmp_path, monkeypatch):
    schema = "kind string, key_id long, vid_s int, vid_e int, code string, ast_id long"
    store = chains.ChainStore(spark, f"file://{tmp_path}/store", buckets=4)
    new = spark.createDataFrame([("tag", 3, 5, 0, "b", 3)], schema)
    store.write(spark.createDataFrame([("tag", k, 1, 0, "a", k) for k in range(20)], schema))
    before = rows(store.read())

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", dies)
        with pytest.raises(RuntimeError, match="lost"):
            store.replace(new, new)
    assert rows(store.read()) == before
    store.replace(new, new)
    assert ("tag", 3, 5, 0, "b", 3) in rows(store.read()) and len(rows(store.read())) == 20
    n, manifest = store._manifest()
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(n, manifest)
    assert store._manifest() == (n, manifest)


def test_replacing_in_an_empty_store(spark, tmp_path):
    store = chains.ChainStore(spark, f"file://{tmp_path}/store", buckets=4)
    none = spark.createDataFrame([], "kind string, key_id long, vid_s int, vid_e int, code string, ast_id long")
    store.replace(none, none)
    assert store.read().count() == 0
    some = spark.createDataFrame([("tag", 1, 1, 0, "a", 1)], none.schema)
    store.replace(some, some)
    assert rows(store.read()) == [("tag", 1, 1, 0, "a", 1)]
