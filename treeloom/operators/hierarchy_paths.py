"""Parent-child links to full hierarchies by list ranking over splitters.

1. One aggregation leaves each child's link. Only nodes that are a parent take part in what follows; most nodes are
   leaves and hang below one of these in the last step.
2. Splitters are chosen deterministically: every parent whose id hashes to 0 modulo ``every``, and every node with more
   than one parent. Roots and splitters are terminals.
3. Every other parent walks up to its next terminal by pointer doubling, carrying link count and local path.
4. The splitters alone form a reduced pointer graph, ``every`` times smaller; only here do full (long) paths take part.
   Up to ``ONE_TASK`` of its links are solved by one task, from the roots down. A greater graph is solved in rounds, with
   the same result: pointers of splitters with one parent are doubled first; of the nodes with several parents those
   that lead to no cycle are found, and as each of these has one chosen parent then, pointers are doubled once more.
5. Paths are expanded with two joins: path of the next splitter plus local path for the parents, path of the parent plus
   the own link for all nodes.

A walk that has made more steps than there are unsettled nodes (see :func:`_walk`) never ends: its node lies on or below
a cycle that has no splitter. Cycles with splitters show up as walks without end in the reduced graph.

Every round joins unsettled nodes with the pointers on the node pointed at. Nodes that share a hot parent meet a
broadcast of the few hot pointers instead of one shuffle partition. Each round is written to the shared folder, so
lineage stays short and a lost executor costs at most a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import broadcast_if_small, dense_ids, forget, hot_keys, materialize, split_join

#: Pointers to one node from which on they are kept out of the shuffle of a round.
HOT_ROWS = 500_000
#: Links of the reduced graph up to which one task solves it.
ONE_TASK = 500_000


def _join_path(a: Column, b: Column) -> Column:
    """Path ``a`` then path ``b``, joined by a dot; an empty path joins without one."""
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("."), b))


def _walk(pointers: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Follow ``pointers`` (v, p, d, path), v unique, until ``p`` is no v. Returns (settled, endless).

    settled: (v, p, d, path) with p the first node that is no v; endless: (v) whose walk never gets there.

    Pointer doubling: after round r, an unsettled node has made 2**r steps, and every node nearer than that is settled.
    With U nodes unsettled then, no finite walk is longer than U + 2**r (all but the last 2**r nodes of the longest finite
    walk are unsettled), so once the steps made exceed the least such bound, what is still unsettled is endless.
    """
    active = materialize(pointers, tag)
    n = active.count()
    settled: list[DataFrame] = []
    steps, bound = 1, n + 1
    while n and steps <= bound:
        lookup = active.withColumn("end2", F.lit(False))
        for s in settled:
            lookup = lookup.unionAll(s.withColumn("end2", F.lit(True)))
        lookup = lookup.select(F.col("v").alias("v2"), F.col("p").alias("p2"), F.col("d").alias("d2"), F.col("path").alias("path2"), "end2")
        met = split_join(active, lookup, "p", "v2", "left", hot_keys(active, "p", least=HOT_ROWS, total=n) if n >= HOT_ROWS else [])
        step = met.select(
            "v",
            F.coalesce("p2", "p").alias("p"),
            F.when(F.col("v2").isNull(), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"),
            F.when(F.col("v2").isNull(), F.col("path")).otherwise(_join_path(F.col("path2"), F.col("path"))).alias("path"),
            F.coalesce("end2", F.lit(True)).alias("done"),
        )
        moved = materialize(step, tag)
        settled.append(moved.filter("done").drop("done"))
        last, active = active, moved.filter("not done").drop("done")
        forget(last)
        n = active.count()
        steps *= 2
        bound = min(bound, n + steps)
    out = pointers.limit(0) if not settled else settled[0]
    for s in settled[1:]:
        out = out.unionAll(s)
    return out.select("v", "p", "d", "path"), active.select("v")


def links(df: DataFrame, parent: str, child: str, rank: str, trail: bool = False) -> DataFrame:
    """Distinct links (v, p, path): child, parent and the lowest rank by which the parent names the child.

    With ``trail`` the path component is ``rank:child``.

    Rows whose child is null or 0 are no links. A null parent makes the child a node without a link. A null rank is
    the lowest possible only if no other rank is given, and then gives an empty path component.
    """
    rows = df.filter(F.col(child).isNotNull() & (F.col(child) != 0) & F.col(parent).isNotNull())
    return rows.groupBy(F.col(child).alias("v"), F.col(parent).alias("p")).agg(F.min(rank).alias("rank")).select(
        "v", "p", F.concat(F.coalesce(F.col("rank").cast("string"), F.lit("")), *([F.lit(":"), F.col("v").cast("string")] if trail else [])).alias("path")
    )


def below(df: DataFrame, parent: str, child: str, rank: str, every: int = 16) -> DataFrame:
    """(node_id, root_id, pos, last) of every node that is not on or below a cycle: all nodes below each node, in linear size.

    Nodes are numbered in the order of their trees (root, then rank and id at each level). The nodes below a node are
    those whose ``pos`` is greater than its own and at most its ``last``; :func:`nodes_below` lists them.
    """
    h = materialize(hierarchy(df, parent, child, rank, every, trail=True).filter("depth >= 0"), "trails")
    steps = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "\\."))
    parts = h.select("node_id", "root_id", steps.alias("s"))
    order = F.transform("s", lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("r"), F.substring_index(x, ":", -1).cast("long").alias("n")))
    placed = dense_ids(parts.select("node_id", "root_id", order.alias("o")), ["root_id", "o"], "pos")
    above = F.concat(F.array("root_id"), F.transform(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda x: F.substring_index(x, ":", -1).cast("long")))
    sizes = parts.filter(F.size("s") > 0).select(F.explode(above).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, F.col("node_id") == F.col("a"), "left").select("node_id", "root_id", "pos", (F.col("pos") + F.coalesce("size", F.lit(0))).alias("last"))


def nodes_below(numbered: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(node_id, below_id) for the chosen nodes: a range join inside each tree on the numbers of :func:`below`."""
    chosen = numbered.join(nodes.select(F.col(key).alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", F.col("root_id").alias("r"), F.col("pos").alias("lo"), F.col("last").alias("hi"))
    under = numbered.select(F.col("node_id").alias("below_id"), "root_id", F.col("pos").alias("at"))
    return chosen.join(under, (F.col("r") == F.col("root_id")) & (F.col("at") > F.col("lo")) & (F.col("at") <= F.col("hi"))).select("node_id", "below_id")


def below_all(df: DataFrame, parent: str, child: str, rank: str, every: int = 16) -> DataFrame:
    """(node_id, root_id, pos, first, last): all nodes below each node, those on and below cycles and over every parent.

    The nodes below a node are those whose ``pos`` lies between ``first`` and ``last`` of one of its rows; a leaf has one
    row with an empty range. ``pos`` and ``root_id`` (of its tree) are the same in all rows of a node, and the ranges of
    a node are disjoint. A node on a cycle is below itself.

    Each cycle is condensed to its smallest node, under which its other nodes hang, so that what is left has no cycles;
    every member has the range of the smallest node, that node included. Nodes hang below one of their parents; a link
    from another parent gives its lower end's range to that parent and to all nodes above it.
    """
    h = materialize(hierarchy(df, parent, child, rank, every, trail=True), "trails")
    edges = materialize(links(df, parent, child, rank).select("v", "p", F.expr("try_cast(path as int)").alias("rank")), "edges")
    bad = materialize(h.filter("depth < 0").select(F.col("node_id").alias("v")), "bad")
    into = edges.join(bad, "v", "left_semi")
    inner = materialize(into.join(bad.select(F.col("v").alias("p")), "p", "left_semi").select("v", "p", "rank"), "inner")
    entries = into.join(bad.select(F.col("v").alias("p")), "p", "left_anti")
    rings = materialize(cycle_members(inner), "rings")
    of_v = rings.select("v", F.col("c").alias("cv"))
    of_p = rings.select(F.col("v").alias("p"), F.col("c").alias("cp"))

    # Without its cycles: links that lead into a ring lead to its smallest node, links inside it are gone.
    flat = inner.join(of_v, "v", "left").join(of_p, "p", "left").filter("cv is null or cp is null or cv <> cp").select(F.coalesce("cv", "v").alias("v"), "p", "rank")
    flat = flat.unionByName(rings.filter("v <> c").select("v", F.col("c").alias("p"), F.lit(0).alias("rank")))
    flat = materialize(flat.groupBy("v", "p").agg(F.min("rank").alias("rank")), "flat")
    alone = bad.select("v", F.lit(None).cast("long").alias("p"), F.lit(None).cast("int").alias("rank"))
    inside = materialize(hierarchy(flat.unionByName(alone), "p", "v", "rank", every, trail=True), "inside")
    entries = materialize(entries.join(of_v, "v", "left").groupBy(F.coalesce("cv", "v").alias("v"), "p").agg(F.min("rank").alias("rank")), "entries")
    tops = inside.filter("depth = 0").select(F.col("node_id").alias("v"))
    hung = entries.join(tops, "v", "left_semi").groupBy("v").agg(F.min(F.struct("p", "rank")).alias("x")).select("v", "x.p", "x.rank")
    good = h.filter("depth >= 0").select("node_id", "root_id", "path")
    over = hung.join(good, F.col("p") == F.col("node_id")).select(
        F.col("v").alias("top"), F.col("root_id").alias("r"),
        _join_path(F.col("path"), F.concat(F.coalesce(F.col("rank").cast("string"), F.lit("")), F.lit(":"), F.col("v").cast("string"))).alias("up"),
    )
    moved = inside.join(over, F.col("root_id") == F.col("top"), "left").select(
        "node_id", F.coalesce("r", "root_id").alias("root_id"), F.when(F.col("up").isNull(), F.col("path")).otherwise(_join_path(F.col("up"), F.col("path"))).alias("path")
    )
    whole = materialize(good.unionByName(moved), "whole")

    placed, above = _numbered(whole)
    numbered = materialize(placed, "numbered")
    at = numbered.select(F.col("node_id").alias("c"), "pos", "last")
    ring = rings.join(at, "c").select(F.col("v").alias("node_id"), F.col("pos").alias("lo"), F.col("last").alias("hi"))
    own = numbered.join(ring, "node_id", "left").select("node_id", F.coalesce("lo", F.col("pos") + 1).alias("first"), F.coalesce("hi", "last").alias("last"))

    # Links from further parents: a node that hangs below its parent in the trees has the parent just above it.
    healthy = edges.join(bad, "v", "left_anti").select("v", "p")
    everything = healthy.unionByName(flat.select("v", "p")).unionByName(entries.select("v", "p"))
    hangs = above.select(F.col("node_id").alias("v"), F.element_at("above", -1).alias("p"))
    extra = materialize(everything.join(hangs, ["v", "p"], "left_anti").distinct(), "extra")
    if not extra.isEmpty():
        n = numbered.select("node_id", "root_id", "pos", "last")
        src = n.select(F.col("node_id").alias("p"), F.col("root_id").alias("sr"), F.col("pos").alias("at"))
        dst = n.select(F.col("node_id").alias("v"), F.col("root_id").alias("dr"), F.col("pos").alias("lo"), F.col("last").alias("hi"))
        spans = materialize(extra.join(src, "p").join(dst, "v"), "spans")
        # (p, lo, hi): what is reached from p over one link, then over links that start in what is reached.
        found = materialize(spans.select("p", "dr", "lo", "hi").distinct(), "reached")
        new = found
        onward = spans.select(F.col("sr").alias("dr"), "at", F.col("dr").alias("dr2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        while not new.isEmpty():
            met = new.join(onward, "dr").filter("at between lo and hi").select("p", F.col("dr2").alias("dr"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi")).distinct()
            new = materialize(met.join(found, ["p", "dr", "lo", "hi"], "left_anti"), "reached")
            found = found.unionAll(new)
        found = found.select("p", "lo", "hi")
        ups = above.join(extra.select(F.col("p").alias("node_id")).distinct(), "node_id", "left_semi").select(F.col("node_id").alias("p"), F.explode("above").alias("node_id"))
        given = found.select(F.col("p").alias("node_id"), "lo", "hi").unionByName(ups.join(found, "p").select("node_id", "lo", "hi"))
        # The members of a ring share what any of them is given.
        to_ring = rings.select(F.col("v").alias("node_id"), "c")
        given = given.join(to_ring, "node_id", "left")
        shared = given.filter("c is not null").select("c", "lo", "hi").distinct().join(to_ring, "c").select("node_id", F.col("lo").alias("first"), F.col("hi").alias("last"))
        own = own.unionByName(given.filter("c is null").select("node_id", F.col("lo").alias("first"), F.col("hi").alias("last"))).unionByName(shared)
        # Ranges are nested or apart; a range inside another one, and an empty one beside others, says nothing new.
        several = extra.select("p").join(ups, "p", "left").select(F.explode(F.array("p", "node_id")).alias("node_id")).filter("node_id is not null").unionByName(shared.select("node_id")).distinct()
        several = materialize(several, "several")
        w = Window.partitionBy("node_id").orderBy(F.col("empty"), "first", F.desc("last"))
        many = own.join(several, "node_id", "left_semi").distinct().withColumn("empty", F.col("last") < F.col("first"))
        many = many.withColumn("top", F.max(F.when(~F.col("empty"), F.col("last"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        many = many.filter(F.col("top").isNull() | (~F.col("empty") & (F.col("last") > F.col("top")))).select("node_id", "first", "last")
        own = own.join(several, "node_id", "left_anti").unionByName(many)
    return numbered.select("node_id", "root_id", "pos").join(own, "node_id").select("node_id", "root_id", "pos", "first", "last")


def _numbered(h: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, root_id, pos, last) in the order of the trees, and (node_id, above) of those not at a root, from trails."""
    steps = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "\\."))
    parts = h.select("node_id", "root_id", steps.alias("s"))
    order = F.transform("s", lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("int").alias("r"), F.substring_index(x, ":", -1).cast("long").alias("n")))
    placed = dense_ids(parts.select("node_id", "root_id", order.alias("o")), ["root_id", "o"], "pos")
    ids = F.concat(F.array("root_id"), F.transform(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda x: F.substring_index(x, ":", -1).cast("long")))
    above = parts.filter(F.size("s") > 0).select("node_id", ids.alias("above"))
    sizes = above.select(F.explode("above").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, F.col("node_id") == F.col("a"), "left").select("node_id", "root_id", "pos", (F.col("pos") + F.coalesce("size", F.lit(0))).alias("last")), above


def all_nodes_below(numbered: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(node_id, below_id) for the chosen nodes, by a range join on the numbers of :func:`below_all`.

    The distinct positions are cut into blocks of 1,024, so that a range meets only the blocks it touches.
    """
    block = 1024
    chosen = numbered.join(nodes.select(F.col(key).alias("node_id")).distinct(), "node_id", "left_semi").filter("first <= last")
    chosen = chosen.select("node_id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("b"))
    under = numbered.select(F.col("node_id").alias("below_id"), F.col("pos").alias("at")).distinct().withColumn("b", F.floor(F.col("at") / block))
    return chosen.join(under, "b").filter("at between first and last").select("node_id", "below_id")


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c) of the nodes on cycles of the links (v, t): strongly connected components, by Tarjan's method without recursion."""
    ups: dict[int, list[int]] = {}
    for b in batches:
        for v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ups.setdefault(v, []).append(t)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    on: set[int] = set()
    out_v, out_c = [], []
    for start in ups:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        held.append(start)
        on.add(start)
        todo = [(start, iter(ups[start]))]
        while todo:
            v, rest = todo[-1]
            for t in rest:
                if t not in index:
                    index[t] = low[t] = len(index)
                    held.append(t)
                    on.add(t)
                    todo.append((t, iter(ups.get(t, ()))))
                    break
                if t in on:
                    low[v] = min(low[v], index[t])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(held.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or v in ups.get(v, ()):
                        out_v += part
                        out_c += [v] * len(part)
    yield pa.RecordBatch.from_arrays([pa.array(out_v, pa.int64()), pa.array(out_c, pa.int64())], names=["v", "c"])


def cycle_members(edges: DataFrame) -> DataFrame:
    """(v, c) of the nodes on cycles of the distinct links (v, p): c is the smallest node of those that reach each other.

    Nodes with one parent are walked over by pointer doubling. Walks without end lead to a cycle of such nodes alone; of
    the others only the nodes with several parents and the walks between them are left, far fewer, for one task.
    """
    loops = edges.filter("v = p").select("v")
    e = materialize(edges.filter("v <> p").select("v", "p"), "ring-links")
    per = e.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    multi = materialize(per.filter("n > 1").select("v"), "ring-multi")
    single = e.join(multi, "v", "left_anti")
    settled, endless = _walk(single.select("v", "p", F.lit(1).alias("d"), F.col("v").cast("string").alias("path")), "ring-walk")
    endless = materialize(endless, "ring-endless")

    # After more steps than there are nodes every walk stands on its cycle, and all nodes of the cycle are stood on.
    f = materialize(single.join(endless, "v", "left_semi").select("v", "p", F.col("v").alias("m")), "ring-steps")
    n, steps = f.count(), 1
    while steps < n:
        nxt = f.select(F.col("v").alias("p"), F.col("p").alias("p2"), F.col("m").alias("m2"))
        last, f = f, materialize(f.join(nxt, "p").select("v", F.col("p2").alias("p"), F.least("m", "m2").alias("m")), "ring-steps")
        forget(last)
        steps *= 2
    pure = f.join(f.select(F.col("p").alias("v")).distinct(), "v", "left_semi").select("v", F.col("m").alias("c"))

    ways = e.join(multi, "v", "left_semi").select("v", F.col("p").alias("via")).join(endless.select(F.col("v").alias("via")), "via", "left_anti")
    ways = materialize(ways.join(settled.select(F.col("v").alias("via"), "p", "path"), "via", "left").select("v", F.coalesce("p", "via").alias("t"), "path"), "ring-ways")
    strong = materialize(ways.select("v", "t").distinct().coalesce(1).mapInArrow(_strong, "v long, c long"), "ring-strong")
    of_t = strong.select(F.col("v").alias("t"), "c")
    between = ways.filter("path is not null").join(strong, "v").join(of_t, ["t", "c"], "left_semi").select(F.explode(F.split("path", "\\.").cast("array<long>")).alias("v"), "c")
    rings = pure.unionByName(strong).unionByName(between).distinct()
    names = rings.groupBy("c").agg(F.min("v").alias("least"))
    rings = materialize(rings.join(names, "c").select("v", F.col("least").alias("c")), "ring-members")
    return rings.unionByName(loops.join(rings.select("v"), "v", "left_anti").select("v", F.col("v").alias("c")))


def _component(rank: Column, v: Column, trail: bool) -> Column:
    return F.concat(F.coalesce(rank.cast("string"), F.lit("")), *([F.lit(":"), v.cast("string")] if trail else []))


def hierarchy(df: DataFrame, parent: str, child: str, rank: str, every: int = 16, trail: bool = False) -> DataFrame:
    """(node_id, root_id, depth, path) of every node of the links in ``df``; see :func:`links` for dirty rows.

    A node on a cycle, or with an ancestor on one, has root_id -1, depth -1 and an empty path. A node with several
    parents, none of which leads to a cycle, hangs below the one with the smallest id. Repeated rows change nothing;
    an empty table gives no rows.
    """
    rows = df.filter(F.col(child).isNotNull() & (F.col(child) != 0)).select(F.col(child).cast("long").alias("v"), F.col(parent).cast("long").alias("p"), F.col(rank).alias("rank"))
    # Of a child with one parent that parent and the lowest rank; of others the smallest parent (their ranks come below).
    ends = rows.groupBy("v").agg(F.min("p").alias("p"), F.max("p").alias("top"), F.min(F.when(F.col("p").isNotNull(), F.col("rank"))).alias("rank"))
    kids = materialize(ends.select("v", "p", "rank", (F.col("top") != F.col("p")).alias("several")), "kids")
    multi = kids.filter("several").select("v", F.col("p").alias("p0"))
    n_multi = multi.count()
    edges = None
    if n_multi:
        few = broadcast_if_small(multi.select("v"), n_multi)
        edges = rows.filter("p is not null").join(few, "v", "left_semi").groupBy("v", "p").agg(F.min("rank").alias("rank"))
        edges = materialize(edges.select("v", "p", _component(F.col("rank"), F.col("v"), trail).alias("path")), "several")
    single = kids.filter("p is not null and not several").select("v", "p", _component(F.col("rank"), F.col("v"), trail).alias("path"))

    # Parents, how many point to them, and their own links.
    over = single.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    if n_multi:
        over = over.unionAll(edges.select("p", F.lit(0).cast("long"))).groupBy("p").agg(F.sum("n").alias("n"))
    over = materialize(over, "parents")
    stats = over.agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    hot = [r[0] for r in over.filter(F.col("n") >= max(HOT_ROWS, stats["links"] // 200)).select("p").collect()]  # at most 200
    inner = materialize(single.join(broadcast_if_small(over.select(F.col("p").alias("v")), stats["parents"]), "v", "left_semi"), "inner")

    is_splitter = F.pmod(F.xxhash64("v", F.lit(17)), F.lit(every)) == 0
    local, endless = _walk(inner.filter(~is_splitter).select("v", "p", F.lit(1).alias("d"), "path"), "walk")
    lost = endless.select(F.col("v").alias("lost"))

    # The reduced graph: from each splitter, over each of its parents, to the next terminal. Stuck ones lead to null.
    first = inner.filter(is_splitter).select("v", "p", "path")
    if n_multi:
        first = first.unionByName(edges)
    first = first.select("v", F.col("p").alias("via"), "path")
    beyond = local.select(F.col("v").alias("w"), "p", "d", F.col("path").alias("up"))
    step = split_join(first, beyond, "via", "w", "left", hot)
    step = split_join(step, lost, "via", "lost", "left", hot)
    reduced = materialize(
        step.select(
            "v", "via",
            F.when(F.col("lost").isNull(), F.coalesce("p", "via")).alias("p"),
            (F.coalesce("d", F.lit(0)) + 1).alias("d"),
            F.when(F.col("w").isNull(), F.col("path")).otherwise(_join_path(F.col("up"), F.col("path"))).alias("path"),
        ),
        "reduced",
    )
    if n_multi:
        reduced = reduced.join(F.broadcast(multi) if n_multi <= ONE_TASK else multi, "v", "left").withColumn("chosen", F.col("p0").isNull() | (F.col("via") == F.col("p0"))).drop("p0")
    else:
        reduced = reduced.withColumn("chosen", F.lit(True))
    # Splitters: (s, root, sd, up), or cyclic if on or below a cycle. Then all parents but roots, in the same form.
    on_cycle = [F.lit(None).cast("long").alias("root"), F.lit(0).alias("sd"), F.lit("").alias("up"), F.lit(True).alias("cyclic")]
    if reduced.count() <= ONE_TASK:
        splitters = reduced.select("v", "p", "d", "path", "chosen").coalesce(1).mapInArrow(_solve, "s long, root long, sd int, up string, cyclic boolean")
    else:
        good, bad = _solve_in_rounds(reduced, multi, n_multi)
        splitters = good.select(F.col("v").alias("s"), F.col("p").alias("root"), F.col("d").alias("sd"), F.col("path").alias("up"), F.lit(False).alias("cyclic"))
        splitters = splitters.unionAll(bad.distinct().select(F.col("v").alias("s"), *on_cycle))
    splitters = materialize(splitters, "splitters")
    walked = local.join(splitters, F.col("p") == F.col("s"), "left").select(
        F.col("v").alias("s"), F.when(F.col("cyclic"), F.lit(None)).otherwise(F.coalesce("root", "p")).alias("root"), (F.col("d") + F.coalesce("sd", F.lit(0))).alias("sd"),
        F.when(F.col("s").isNull(), F.col("path")).otherwise(_join_path(F.col("up"), F.col("path"))).alias("up"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )
    parents = walked.unionAll(splitters).unionAll(endless.select(F.col("v").alias("s"), *on_cycle))
    below = split_join(single, materialize(parents, "settled"), "p", "s", "left", hot)
    cyclic = F.coalesce("cyclic", F.lit(False))

    def node(v: Column, root: Column, depth: Column, path: Column, cyclic: Column) -> list[Column]:
        return [
            v.cast("long").alias("node_id"), F.when(cyclic, F.lit(-1)).otherwise(root).cast("long").alias("root_id"),
            F.when(cyclic, F.lit(-1)).otherwise(depth).cast("int").alias("depth"), F.when(cyclic, F.lit("")).otherwise(path).alias("path"),
        ]

    hangs = below.select(*node(F.col("v"), F.coalesce("root", "p"), F.coalesce("sd", F.lit(0)) + 1, F.when(F.col("s").isNull(), F.col("path")).otherwise(_join_path(F.col("up"), F.col("path"))), cyclic))
    # Roots are parents that are no child, and children without a parent.
    linked = kids.filter("p is not null").select("v")
    alone = kids.filter("p is null").select("v").join(over.select(F.col("p").alias("v")), "v", "left_anti")
    roots = over.select(F.col("p").alias("v")).join(linked, "v", "left_anti").unionAll(alone)
    out = hangs.unionAll(roots.select(*node(F.col("v"), F.col("v"), F.lit(0), F.lit(""), F.lit(False))))
    if n_multi:
        tops = splitters.join(multi.select(F.col("v").alias("s")), "s", "left_semi")
        out = out.unionAll(tops.select(*node(F.col("s"), F.col("root"), F.col("sd"), F.col("up"), F.col("cyclic"))))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, root, sd, up, cyclic) of all nodes of a reduced graph, given its ways (v, p, d, path, chosen); p null leads nowhere.

    From the roots down: a node is settled once all nodes its ways lead to are; it keeps its chosen way. What is left is
    on or below a cycle.
    """
    chosen: dict[int, tuple[int, int, str]] = {}
    open_ways: dict[int, int] = {}
    ways: list[tuple[int, int | None]] = []
    for b in batches:
        for v, p, d, path, mine in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            ways.append((v, p))
            open_ways[v] = 0
            if mine:
                chosen[v] = (p, d, path)
    waits: dict[int, list[int]] = {}
    for v, p in ways:
        if p is None:
            open_ways[v] += 1  # for ever
        elif p in open_ways:
            open_ways[v] += 1
            waits.setdefault(p, []).append(v)
    done: dict[int, tuple[int, int, str]] = {}
    todo = [v for v, n in open_ways.items() if not n]
    while todo:
        v = todo.pop()
        p, d, path = chosen[v]
        if p in done:
            root, above, up = done[p]
            done[v] = (root, above + d, f"{up}.{path}" if up and path else up or path)
        else:
            done[v] = (p, d, path)
        for w in waits.get(v, ()):
            open_ways[w] -= 1
            if not open_ways[w]:
                todo.append(w)
    every = list(open_ways)
    for i in range(0, len(every), 10_000):
        part = [(v, *done.get(v, (None, 0, "")), v not in done) for v in every[i : i + 10_000]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=["s", "root", "sd", "up", "cyclic"])


def _solve_in_rounds(reduced: DataFrame, multi: DataFrame, n_multi: int) -> tuple[DataFrame, DataFrame]:
    """(v, p = root, d, path) of the good splitters and (v) of those on or below a cycle, for a graph of any size."""
    chain = reduced.join(multi.select("v"), "v", "left_anti") if n_multi else reduced
    solved, no_end = _walk(chain.filter("p is not null").select("v", "p", "d", "path"), "reduced-walk")
    # A chain that ends at a splitter whose own way is stuck ends nowhere.
    stuck = chain.filter("p is null").select("v")
    bad = no_end.unionAll(stuck).unionAll(solved.join(stuck.select(F.col("v").alias("p")), "p", "left_semi").select("v"))
    good = solved.join(stuck.select(F.col("v").alias("p")), "p", "left_anti").select("v", "p", "d", "path")
    return _settle_multi(reduced, multi, good, bad) if n_multi else (good, bad)


def _peel_rounds(ways: DataFrame) -> DataFrame:
    """(v) of the nodes none of whose ways (v, m) leads to a cycle; m 0: to a root, null: nowhere. One round for each of
    the most such nodes above one another.
    """
    good = ways.limit(0).select("v")
    while True:
        g = good.select(F.col("v").alias("m"), F.lit(True).alias("settled"))
        free = F.col("m").isNotNull() & ((F.col("m") == 0) | F.coalesce("settled", F.lit(False)))
        met = ways.join(g, "m", "left").groupBy("v").agg(F.min(free).alias("free")).filter("free").select("v")
        new = materialize(met.join(good, "v", "left_anti"), "peeled")
        if new.isEmpty():
            return good
        good = good.unionAll(new)


def _settle_multi(reduced: DataFrame, multi: DataFrame, good: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle nodes with several parents: (v, root, d, path) of all good splitters, and the bad ones.

    A node is good if all its ways up lead to roots or to good nodes; what is left leads to a cycle. Each good node then
    keeps the way over its smallest parent, so their root, depth and path come from doubling pointers.
    """
    ways = reduced.join(multi.select("v"), "v", "left_semi").select("v", "via", "p", "d", "path", "chosen")
    # One way: to the end of its chain. p: a root, or a node with several parents.
    g = good.select(F.col("v").alias("w"), F.col("p").alias("gp"), F.col("d").alias("gd"), F.col("path").alias("gpath"))
    b = bad.distinct().select(F.col("v").alias("bw"))
    ways = ways.join(g, F.col("p") == F.col("w"), "left").join(b, F.col("p") == F.col("bw"), "left")
    ways = ways.select(
        "v", "chosen",
        F.when(F.col("p").isNotNull() & F.col("bw").isNull(), F.coalesce("gp", "p")).alias("p"),
        (F.col("d") + F.coalesce("gd", F.lit(0))).alias("d"),
        F.when(F.col("w").isNull(), F.col("path")).otherwise(_join_path(F.col("gpath"), F.col("path"))).alias("path"),
    )
    ways = materialize(ways.join(multi.select(F.col("v").alias("m")), F.col("p") == F.col("m"), "left"), "ways")
    short = ways.select("v", F.when(F.col("p").isNotNull(), F.coalesce("m", F.lit(0))).alias("m")).distinct()
    fine = materialize(_peel_rounds(materialize(short, "ways")), "good-several")
    settled, _ = _walk(ways.filter("chosen").join(fine, "v", "left_semi").select("v", "p", "d", "path"), "several-walk")
    # Chains that end at a settled node go on to its root; chains that end at an unsettled one lead to a cycle.
    s = settled.select(F.col("v").alias("sv"), F.col("p").alias("sp"), F.col("d").alias("sd"), F.col("path").alias("spath"))
    g = good.join(multi.select(F.col("v").alias("m")), F.col("p") == F.col("m"), "left").join(s, F.col("p") == F.col("sv"), "left")
    still = g.filter("m is not null and sv is null").select("v")
    done = g.filter("m is null or sv is not null").select(
        "v", F.coalesce("sp", "p").alias("p"), (F.col("d") + F.coalesce("sd", F.lit(0))).alias("d"),
        F.when(F.col("sv").isNull(), F.col("path")).otherwise(_join_path(F.col("spath"), F.col("path"))).alias("path"),
    )
    open_ = multi.select("v").join(fine, "v", "left_anti")
    return materialize(done.unionAll(settled), "good"), materialize(bad.unionAll(still).unionAll(open_).distinct(), "bad")
