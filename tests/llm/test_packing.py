"""Problem 8: nothing lost, nothing too full, nothing split without need, little room left."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import packing


def check(spark, sizes, capacity):
    df = spark.createDataFrame(sizes, "doc long, n long").withColumn("len", F.lit("x")).withColumn("piece", F.lit("x"))
    out = [tuple(r) for r in packing.pack(df, capacity).collect()]
    used, parts = defaultdict(int), defaultdict(list)
    for doc, piece, start, n, box in out:
        used[box] += n
        parts[doc].append((piece, start, n))
    assert all(u <= capacity for u in used.values())
    want = {d: n or 0 for d, n in sizes}
    assert set(parts) == set(want)
    for d, n in want.items():
        got = sorted(parts[d])
        assert [p[0] for p in got] == list(range(len(got))) and sum(p[2] for p in got) == n
        assert all(p[1] == i * capacity for i, p in enumerate(got))
        assert len(got) == max(1, -(-n // capacity))
    return len([u for u in used.values() if u]), -(-sum(want.values()) // capacity)


def test_mixed_sizes(spark):
    rng = random.Random(1)
    sizes = [(i, int(rng.lognormvariate(4, 1.2))) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 1000), (5003, 12345)]
    boxes, least = check(spark, sizes, 500)
    assert boxes <= least + 2


def test_one_size_holds_most(spark):
    boxes, least = check(spark, [(i, 100) for i in range(900)] + [(2000 + i, 50) for i in range(10)], 250)
    assert boxes <= 451  # two of 100 fit; the smaller ones fill gaps of 50


@pytest.mark.parametrize("sizes", [[], [(1, 0)], [(1, None)], [(1, 7)], [(1, 14)], [(1, 15)], [(None, 3), (2, 3)]])
def test_edges(spark, sizes):
    check(spark, sizes, 7)


def test_exact_combinations_come_first():
    counts = np.zeros(11, np.int64)
    for x, n in ((6, 2), (4, 1), (3, 1), (1, 1), (5, 1), (2, 2)):
        counts[x] = n
    patterns = packing.solve(counts, 10)
    assert sum(t for t, _ in patterns) == 3 and all(sum(x * k for x, k in p.items()) <= 10 for _, p in patterns)
    full = sum(t for t, p in patterns if sum(x * k for x, k in p.items()) == 10)
    assert full == 2  # 26 tokens: two full containers and one of six


def test_solver_against_volume():
    rng = np.random.default_rng(3)
    for _ in range(5):
        counts = np.bincount(rng.integers(1, 300, 4000), minlength=513)
        patterns = packing.solve(counts, 512)
        spent = np.zeros(513, np.int64)
        for t, p in patterns:
            for x, k in p.items():
                spent[x] += t * k
        assert (spent == counts).all()
        assert sum(t for t, _ in patterns) <= -(-int((counts * np.arange(513)).sum()) // 512) + 1


def test_a_pair_beyond_64_used_ones_is_found():
    import numpy as np

    from treeloom.llm.packing import _Sums

    counts = np.zeros(1001, int)
    counts[430:571] = 1
    used = {x: 1 for x in range(501, 571) if x != 502}
    assert _Sums(counts).pair(1000, used) == (502, 498)
