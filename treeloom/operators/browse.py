"""The read side: directories, files, tags and node trees as flat or nested rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.operators.select import below, has_separator, immediate_child, tail, without_zero
from treeloom.runtime import broadcast_if_small, forget, materialize


def files_at(v_main: DataFrame, bridge: DataFrame, names: DataFrame, files: DataFrame, version: str | None = None) -> DataFrame:
    """Every path of every version (or of one, by name): four tables joined on their keys; equal rows once."""
    v = v_main.select("vid", "vname").distinct()
    if version is not None:
        v = v.filter(F.col("vname") == version)
    b = bridge.select("vid", "fnid", "fid").distinct()
    return (
        b.join(F.broadcast(v), "vid")  # one row per version
        .join(names.select("fnid", "fname").distinct(), "fnid")
        .join(files.select("fid", "vid_s", "vid_e", "ftype", "s_stat", "e_stat").distinct(), "fid")
        .select("vid", "vname", "fnid", "fname", "fid", "vid_s", "vid_e", "ftype", "s_stat", "e_stat")
    )


def sub_directories(paths: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """Distinct names of the directories right below ``prefix``."""
    rest = tail(F.col(path), prefix)
    return paths.filter(below(F.col(path), prefix) & has_separator(rest)).select(F.substring_index(rest, "/", 1).alias("name")).distinct()


def files_below(paths: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """Rows of the files right below ``prefix``; names that are directories there are left out."""
    rest = tail(F.col(path), prefix)
    direct = paths.filter(immediate_child(F.col(path), prefix)).withColumn("name", rest)
    return direct.join(sub_directories(paths, path, prefix), "name", "left_anti")


def listing(paths: DataFrame, group: str, path: str) -> DataFrame:
    """(group, dir, name, is_dir): what stands right below each directory, the root (an empty dir) included.

    A name that is a directory is none of the files. Repeated paths count once.
    """
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("dir"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir")))
    rows = paths.filter(F.col(path) != "").select(group, F.explode(ups).alias("x")).select(group, "x.dir", "x.name", "x.is_dir")
    return rows.groupBy(group, "dir", "name").agg(F.max("is_dir").alias("is_dir"))


def kind_of(paths: DataFrame, path: str, ftype: str, wanted: str) -> DataFrame:
    """One row (path, is_file): a path is a file if it is there with a type that is not 0 (directory); null types are files."""
    hit = paths.filter(F.col(path) == wanted).agg(F.count(F.when(F.col(ftype).isNull() | (F.col(ftype) != 0), 1)).alias("n"))
    return hit.select(F.lit(wanted).alias("path"), (F.col("n") > 0).alias("is_file"))


def _with_debug(df: DataFrame, debug: DataFrame | None) -> DataFrame:
    """Adds ``ast_raw`` of ``ast_id`` by a left join, null without a debug table; equal rows of it count once."""
    if debug is None:
        return df.withColumn("ast_raw", F.lit(None).cast("string"))
    return df.join(debug.select(F.col("ast_id").alias("_d"), "ast_raw").distinct(), F.col("ast_id") == F.col("_d"), "left").drop("_d")


def tag_rows(bridge: DataFrame, tags: DataFrame, ast: DataFrame, types: DataFrame, debug: DataFrame | None = None) -> DataFrame:
    """Tags of files with their places and node: inner joins, type name and debug text by left joins; equal rows once."""
    b = bridge.select("fid", "tag_id", "line_s", "line_e", "char_s", "char_e").distinct()
    t = tags.select("tag_id", "vid_s", "vid_e", "code", "ast_id", "hl_s", "hl_l").distinct()
    a = ast.select("ast_id", F.col("name").alias("ast_name"), "type_id").distinct()
    names = F.broadcast(types.select(F.col("type_id").alias("_t"), F.col("name").alias("type_name")))  # fixed table
    return _with_debug(b.join(t, "tag_id").join(a, "ast_id").join(names, F.col("type_id") == F.col("_t"), "left").drop("_t"), debug)


def map_rows(maps: DataFrame, ast: DataFrame, types: DataFrame, bridge_map: DataFrame | None = None) -> DataFrame:
    """Node extents with node and type name, equal rows once; with ``bridge_map`` (tag_id, map_id) those of each tag."""
    m = maps.filter("map_id <> 0").distinct()
    if bridge_map is not None:
        m = m.join(bridge_map.select("tag_id", "map_id").distinct(), "map_id")
    a = ast.select("ast_id", F.col("name").alias("ast_name"), "type_id").distinct()
    names = F.broadcast(types.select(F.col("type_id").alias("_t"), F.col("name").alias("type_name")))
    return m.join(a, "ast_id").join(names, F.col("type_id") == F.col("_t"), "left").drop("_t")


def file_detail(
    fid: int, bridge: DataFrame, tags: DataFrame, maps: DataFrame, ast: DataFrame, types: DataFrame,
    bridge_map: DataFrame | None = None, debug: DataFrame | None = None, containers: DataFrame | None = None,
) -> DataFrame:
    """One file, nested: each tag with node, debug text, depth in the containers, and its extents in order of place.

    Without ``bridge_map`` a map has the id of its tag; without ``containers`` depths are null. Depths are those among
    the links that touch a node of the file. Only the maps of one tag are put together; the tags of the file stay rows.
    """
    t = tag_rows(bridge.filter(F.col("fid") == fid), tags, ast, types, debug)
    links = maps.filter("map_id <> 0").select(F.col("map_id").alias("tag_id"), "map_id").distinct() if bridge_map is None else bridge_map
    m = map_rows(maps, ast, types, links.join(t.select("tag_id").distinct(), "tag_id", "left_semi"))
    if containers is not None:
        ids = without_zero(t.select("ast_id").unionByName(m.select("ast_id")).distinct(), "ast_id").withColumnRenamed("ast_id", "_i")
        e = containers.select(F.lit(0).cast("long").alias("g"), F.col("ast_id").alias("p"), F.col("ref_ast_id").alias("c")).distinct()
        e = e.join(ids, F.col("p") == F.col("_i"), "left_semi").unionByName(e.join(ids, F.col("c") == F.col("_i"), "left_semi"))
        depth = materialize(container_depths(e, "g", "p", "c").select(F.col("node").alias("ast_id"), F.col("depth").alias("container_depth")), "depths")
        t, m = t.join(depth, "ast_id", "left"), m.join(depth, "ast_id", "left")
    else:
        t, m = (x.withColumn("container_depth", F.lit(None).cast("int")) for x in (t, m))
    item = F.struct("line_s", "char_s", "line_e", "char_e", "map_id", "ast_id", "ast_name", "type_id", "type_name", "container_depth")
    nested = m.groupBy("tag_id").agg(F.array_sort(F.collect_list(item)).alias("maps"))
    empty = F.array().cast(nested.schema["maps"].dataType)
    return t.join(nested, "tag_id", "left").withColumn("maps", F.coalesce("maps", empty))


def tag_detail(
    tag_id: int, bridge: DataFrame, tags: DataFrame, ast: DataFrame, types: DataFrame,
    maps: DataFrame | None = None, bridge_map: DataFrame | None = None, debug: DataFrame | None = None,
) -> DataFrame:
    """One tag, its first row by (vid_s, fid, place): the place by a left join, the node by an inner one, debug text, and
    with ``maps`` and ``bridge_map`` its extents in order of place as an array (empty without any).
    """
    one = tags.filter(F.col("tag_id") == tag_id).select("tag_id", "vid_s", "vid_e", "code", "ast_id", "hl_s", "hl_l").distinct()
    b = bridge.filter(F.col("tag_id") == tag_id).select("tag_id", "fid", "line_s", "line_e", "char_s", "char_e").distinct()
    a = ast.select("ast_id", F.col("name").alias("ast_name"), "type_id").distinct()
    names = F.broadcast(types.select(F.col("type_id").alias("_t"), F.col("name").alias("type_name")))
    row = one.join(b, "tag_id", "left").join(a, "ast_id").join(names, F.col("type_id") == F.col("_t"), "left").drop("_t").orderBy("vid_s", "fid", "line_s", "char_s", "line_e", "char_e", "code", "ast_name").limit(1)
    row = _with_debug(row, debug)
    if maps is None or bridge_map is None:
        return row
    m = map_rows(maps, ast, types, bridge_map.filter(F.col("tag_id") == tag_id))
    nested = m.groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct("line_s", "char_s", "line_e", "char_e", "map_id", "ast_id", "ast_name", "type_id", "type_name"))).alias("maps"))
    return row.join(nested, "tag_id", "left").withColumn("maps", F.coalesce("maps", F.array().cast(nested.schema["maps"].dataType)))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, d) of whole groups of links (g, p, c), which arrive one after the other: breadth-first search in memory."""
    held: list[pa.RecordBatch] = []

    def depths(g: object, links: list[tuple[int, int]]) -> tuple[list, list, list]:
        below: dict[int, list[int]] = {}
        for p, c in links:
            below.setdefault(p, []).append(c)
        kids = {c for _, c in links}
        found: dict[int, int | None] = {p: 0 for p in below if p not in kids} or dict.fromkeys(below, 0)
        todo = deque(found)
        while todo:
            p = todo.popleft()
            for c in below.get(p, ()):
                if c not in found:
                    found[c] = found[p] + 1
                    todo.append(c)
        nodes = list(kids.union(below))
        return [g] * len(nodes), nodes, [found.get(n) for n in nodes]

    def groups(end: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        g, p, c = (t.column(i).to_pylist() for i in range(3))
        starts = [i for i in range(len(g)) if not i or g[i] != g[i - 1]]
        ends = [*starts[1:], len(g)]
        whole = len(starts) - (not end)  # the last group may go on
        parts = [depths(g[a], list(zip(p[a:b], c[a:b], strict=True))) for a, b in zip(starts[:whole], ends[:whole], strict=True)]
        held[:] = t.slice(ends[whole - 1] if whole else 0).to_batches()
        out = [[x for part in parts for x in part[i]] for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(out[0], t.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["g", "n", "d"])

    last = None
    for b in batches:
        if b.num_rows:
            held.append(b)
            if (b.column(0)[0] != last or b.column(0)[-1] != last) and last is not None:
                yield groups(False)
            last = b.column(0)[-1]
    if held:
        yield groups(True)


def container_depths(edges: DataFrame, group: str, parent: str, child: str, most: int = 1_000_000) -> DataFrame:
    """(group, node, depth): least number of links from a root of the group.

    Roots are parents that are no child in the group, or all parents if there are none. Ids 0 and null are no nodes, a
    null group is none. Nodes no root reaches (cycles beside real roots) get a null depth. A group of up to ``most``
    distinct links is searched in one task; greater ones, level by level over all tasks, give the same.
    """
    e = without_zero(without_zero(edges, parent), child).filter(F.col(group).isNotNull())
    e = materialize(e.select(F.col(group).alias("g"), F.col(parent).cast("long").alias("p"), F.col(child).cast("long").alias("c")).distinct(), "edges")
    large = materialize(e.groupBy("g").count().filter(F.col("count") > most).select("g"), "large")
    n = large.count()
    small = e.join(broadcast_if_small(large, n), "g", "left_anti") if n else e
    out = small.repartition("g").sortWithinPartitions("g").mapInArrow(_search, f"g {dict(e.dtypes)['g']}, n long, d int")
    if n:
        out = out.unionByName(_depths_by_level(materialize(e.join(broadcast_if_small(large, n), "g", "left_semi"), "edges")))
    return out.select(F.col("g").alias(group), F.col("n").alias("node"), F.col("d").alias("depth"))


def _depths_by_level(e: DataFrame) -> DataFrame:
    """The same for links (g, p, c) of groups of any size: one round per level; a level is written once."""
    heads = e.select("g", "p").distinct()
    roots = heads.join(e.select("g", F.col("c").alias("p")).distinct(), ["g", "p"], "left_anti")
    rootless = heads.join(roots.select("g").distinct(), "g", "left_anti")
    reached = materialize(roots.unionByName(rootless).select("g", F.col("p").alias("n"), F.lit(0).alias("d")), "reached")
    frontier, parts = reached, [reached]
    for level in count(1):  # reached nodes are taken out, so the frontier runs empty
        met = frontier.select("g", F.col("n").alias("p")).join(e, ["g", "p"]).select("g", F.col("c").alias("n")).distinct()
        for part in parts:
            met = met.join(part.select("g", "n"), ["g", "n"], "left_anti")
        frontier = materialize(met.withColumn("d", F.lit(level)), "reached")
        if frontier.isEmpty():
            forget(frontier)
            break
        parts.append(frontier)
        if len(parts) > 8:
            merged = parts[0]
            for part in parts[1:-1]:
                merged = merged.unionByName(part)
            parts = [materialize(merged, "reached"), frontier]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    nodes = e.select("g", F.col("p").alias("n")).unionByName(e.select("g", F.col("c").alias("n"))).distinct()
    return nodes.join(found, ["g", "n"], "left").select("g", "n", F.col("d").cast("int").alias("d"))


def bounded_tree(roots: DataFrame, edges: DataFrame, ast: DataFrame, types: DataFrame, depth: int = 3, debug: DataFrame | None = None) -> DataFrame:
    """The trees below ``roots`` (node), to ``depth`` levels (1 to 10), one row for each node of a tree:
    (root, path, node, depth, priority, relation, name, type_id, type_name, ast_raw).

    ``path`` holds the priorities from the root, ``relation`` is the type of the link. A node that is its own ancestor
    appears once more and has no children there. A missing root is ``Unknown`` of type 0, ``Undefined``, without
    children; a child without a node is left out, with all below it. ``debug`` gives ``ast_raw``, null without it. One
    join per level; equal links and equal nodes count once.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    nodes = ast.select(F.col("ast_id").alias("_a"), "name", "type_id").distinct()
    there = nodes.select("_a").distinct()
    e = without_zero(edges, "ref_ast_id").select(F.col("ast_id").alias("p"), F.col("priority").alias("rank"), F.col("type_id").alias("rel"), F.col("ref_ast_id").alias("c")).distinct()
    e = e.join(there, F.col("c") == F.col("_a"), "left_semi").join(there, F.col("p") == F.col("_a"), "left_semi")
    level = roots.select(
        F.col("node").alias("root"), F.lit("").alias("path"), "node", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("short").alias("rel"), F.array("node").alias("seen"), F.lit(False).alias("again")
    )
    out = level
    for d in range(1, depth + 1):
        nxt = level.filter("not again").join(e.withColumnRenamed("rel", "rel2"), F.col("node") == F.col("p"))
        sep = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit(".")))
        level = nxt.select(
            "root", F.concat(sep, F.coalesce(F.col("rank").cast("string"), F.lit(""))).alias("path"), F.col("c").alias("node"), F.lit(d).alias("depth"), F.col("rank").alias("priority"), F.col("rel2").alias("rel"),
            F.concat("seen", F.array("c")).alias("seen"), F.array_contains("seen", F.col("c")).alias("again"),
        )
        out = out.unionByName(level)
    raw = types.limit(0).select(F.lit(0).cast("long").alias("_d"), F.lit("").alias("ast_raw")) if debug is None else debug.select(F.col("ast_id").alias("_d"), "ast_raw").distinct()
    names = types.select(F.col("type_id").alias("_n"), F.col("name").alias("type_name"))  # fixed table
    relations = types.select(F.col("type_id").alias("_r"), F.col("name").alias("relation"))
    j = out.join(nodes, F.col("node") == F.col("_a"), "left").withColumn("type_id", F.when(F.col("_a").isNull(), F.lit(0)).otherwise(F.col("type_id")).cast("short"))
    j = j.join(F.broadcast(names), F.col("type_id") == F.col("_n"), "left").join(F.broadcast(relations), F.col("rel") == F.col("_r"), "left").join(raw, F.col("node") == F.col("_d"), "left")
    name = F.when(F.col("_a").isNull(), "Unknown").otherwise(F.col("name"))
    return j.select("root", "path", "node", "depth", "priority", "relation", name.alias("name"), "type_id", "type_name", "ast_raw")


def ordered_children(df: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Rows with their position below the parent, from 0."""
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1).cast("int"))
