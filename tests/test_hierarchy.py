"""Problem 4: full hierarchies, cycles and nodes with several parents, against a recursive version."""

import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.operators import browse
from treeloom.operators import hierarchy_paths as hp

sys.setrecursionlimit(10_000)
SCHEMA = "ast_id long, priority int, ref_ast_id long"


def brute(data):
    par, nodes = {}, set()
    for a, p, c in data:
        if c:
            nodes.add(c)
            if a is not None:
                nodes.add(a)
                d = par.setdefault(c, {})
                d[a] = p if a not in d or d[a] is None else d[a] if p is None else min(d[a], p)

    def up(v):
        seen, todo = set(), list(par.get(v, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += par.get(x, ())
        return seen

    ups = {v: up(v) for v in nodes}
    bad = {v for v in nodes if v in ups[v] or any(a in ups[a] for a in ups[v])}

    def walk(v):
        if v in bad:
            return (-1, -1, "")
        if not par.get(v):
            return (v, 0, "")
        p = min(par[v])
        r, d, path = walk(p)
        rank = "" if par[v][p] is None else str(par[v][p])
        return (r, d + 1, path + "." + rank if path and rank else path or rank)

    return {v: walk(v) for v in nodes}


def got(df, every=4):
    out = hp.hierarchy(df, "ast_id", "ref_ast_id", "priority", every=every).collect()
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: tuple(r[1:]) for r in out}


@pytest.mark.parametrize("every", [3, 10_000])
def test_random_graphs(spark, every):
    rng = random.Random(every)
    data, base = [], 0
    for size, shape in ((60, "tree"), (40, "chain"), (15, "cycle"), (30, "cycle-tail"), (40, "dag"), (40, "mixed")):
        ids = [base + i + 1 for i in range(size)]
        base += size
        for i, v in enumerate(ids):
            r = rng.randint(0, 9)
            if shape == "tree" and i:
                data.append((rng.choice(ids[:i]), r, v))
            elif shape == "chain" and i:
                data.append((ids[i - 1], r, v))
            elif shape == "cycle":
                data.append((ids[i - 1], r, v))
            elif shape == "cycle-tail":
                data.append((ids[3] if i == 0 else rng.choice(ids[:i]), r, v))
            elif shape == "dag" and i:
                data += [(rng.choice(ids[:i]), rng.randint(0, 9), v) for _ in range(rng.randint(1, 3))]
            elif shape == "mixed" and i:
                data.append((rng.choice(ids[:i]), r, v))
                if rng.random() < 0.1:
                    data.append((rng.choice(ids), r, v))
    data += [(7, 3, 7), (None, 1, 9999), (9998, 1, 0), (9997, 2, None)]
    data += data[:40] + [(a, p + 1, c) for a, p, c in data[:20]]
    df = spark.createDataFrame(data, SCHEMA).withColumn("v", F.lit("x")).withColumn("p", F.lit("x")).withColumn("path", F.lit("x"))
    assert got(df, every) == brute(data)


def test_nodes_below(spark):
    rng = random.Random(8)
    data = [(rng.choice(range(1, v)), rng.randint(0, 2), v) for v in range(2, 120)] + [(500, 1, 501), (600, 0, 601), (601, 0, 600), (601, 0, 602)]
    df = spark.createDataFrame(data + data[:9], SCHEMA)
    numbered = hp.below(df, "ast_id", "ref_ast_id", "priority", every=3)
    up = {c: a for a, _, c in data if c < 600}
    want = set()
    for v in up:
        a = v
        while a in up:
            a = up[a]
            want.add((a, v))
    assert {tuple(r) for r in hp.nodes_below(numbered, numbered, "node_id").collect()} == want
    at = {r["node_id"]: r for r in numbered.collect()}
    assert sorted(r["pos"] for r in at.values()) == list(range(1, len(at) + 1)) and 600 not in at
    assert hp.below(df.limit(0), "ast_id", "ref_ast_id", "priority").count() == 0


@pytest.mark.parametrize("every", [3, 10_000])
def test_all_nodes_below_with_cycles_and_several_parents(spark, every):
    rng = random.Random(every)
    data = [(rng.choice(range(1, v)), rng.randint(0, 2), v) for v in range(2, 80)]  # a tree
    data += [(300 + (i - 1) % 12, 0, 300 + i) for i in range(12)] + [(3, 1, 305), (302, 1, 320), (320, 0, 321)]  # a ring below the tree
    data += [(500, 1, 500), (500, 2, 501), (601, 0, 600), (600, 0, 601), (601, 0, 602), (602, None, 603)]
    data += [(700, 0, 701), (701, 0, 702), (702, 0, 700), (701, 0, 703), (703, 0, 700), (702, 0, 704), (5, 0, 704)]  # two ways around
    data += [(800 + rng.randint(0, i - 1), rng.randint(0, 3), 800 + i) for i in range(1, 40) for _ in range(2)]  # several parents
    data += [(850, 0, 900), (900 + 19, 0, 900)] + [(900 + rng.randint(0, i - 1), 0, 900 + i) for i in range(1, 20) for _ in range(2)]
    data += [(321, 0, 850), (None, 1, 9999), (9998, 1, 0), (9997, 2, None)]
    df = spark.createDataFrame(data + data[:9], SCHEMA)
    down = {}
    for a, _, c in data:
        if c and a is not None:
            down.setdefault(a, set()).add(c)
    want = set()
    for v in down:
        seen, todo = set(), [v]
        while todo:
            new = down.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        want |= {(v, x) for x in seen}
    numbered = hp.materialize(hp.below_all(df, "ast_id", "ref_ast_id", "priority", every=every), "test")
    got = [tuple(r) for r in hp.all_nodes_below(numbered, numbered, "node_id").collect()]
    assert set(got) == want and len(got) == len(want)
    at = {(r["node_id"], r["pos"]) for r in numbered.collect()}
    assert {v for v, _ in at} == {x for a, _, c in data if c for x in (a, c) if x is not None} and sorted(p for _, p in at) == list(range(1, len(at) + 1))
    assert hp.below_all(df.limit(0), "ast_id", "ref_ast_id", "priority").count() == 0


def test_container_depths_have_no_bound(spark, monkeypatch):
    monkeypatch.setattr(browse, "range", lambda *a: iter(range(*a[:-1], min(a[-1], 3))), raising=False)  # a bound would end at 2 levels
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(1, 5)], "g long, p long, c long")
    assert {r["node"]: r["depth"] for r in browse.container_depths(edges, "g", "p", "c", 1).collect()} == {i: i - 1 for i in range(1, 6)}


def test_small_cases(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}
    data = [(10, 0, 11), (10, 1, 12), (11, 0, 13), (20, 0, 21), (21, 0, 20), (30, 0, 0)]
    assert got(spark.createDataFrame(data, SCHEMA)) == {10: (10, 0, ""), 11: (10, 1, "0"), 12: (10, 1, "1"), 13: (10, 2, "0.0"), 20: (-1, -1, ""), 21: (-1, -1, "")}


def test_star_with_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(hp, "HOT_ROWS", 10)
    data = [(1, i, 100 + i) for i in range(50)] + [(2, 0, 1), (3, 5, 2)]
    assert got(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_ladder_of_nodes_with_several_parents(spark, monkeypatch):
    n = 100_000
    ways = [(2 * i + s, max(m, 1), 1, "0", m % 2 == 0) for i in range(1, n) for s in (0, 1) for m in (2 * i - 2, 2 * i - 1)]
    ways += [(v, m, 1, "0", True) for v, m in ((-5, -6), (-6, -5), (-7, -6), (-8, None), (-9, -8))]
    ways = [(v, m, d, p if v < 4 or v % 9999 == 0 else "", c) for v, m, d, p, c in ways]  # short paths
    batch = pa.RecordBatch.from_pydict({k: list(x) for k, x in zip("vpdqc", zip(*ways, strict=True), strict=True)})
    got_ = {r["s"]: (r["root"], r["sd"], r["cyclic"]) for b in hp._solve(iter([batch])) for r in b.to_pylist()}
    assert {v for v, x in got_.items() if x[2]} == {-5, -6, -7, -8, -9} and got_[2 * n - 1] == (1, n - 1, False) and len(got_) == 2 * n - 2 + 5
    data = [(a, 0, b) for i in range(1, 12) for a in (2 * i - 1, 2 * i) for b in (2 * i + 1, 2 * i + 2)] + [(24, 0, 30), (30, 0, 31), (31, 0, 30), (3, 1, 31), (31, 2, 40), (2, 2, 40)]
    want = brute(data)
    for most in (hp.ONE_TASK, 0):
        monkeypatch.setattr(hp, "ONE_TASK", most)
        assert got(spark.createDataFrame(data, SCHEMA)) == want
