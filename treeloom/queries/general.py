"""Queries p1_ to p6_ over the tables of a versioned source tree, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators import chains, dangling, hierarchy_paths, intervals, selection, snapshots
from treeloom.runtime import materialize
from treeloom.sources.catalog import table


# 1 ---------------------------------------------------------------------------------------------------------------

def _p1_inputs(spark, d):
    return table(spark, d, "m_tag"), table(spark, d, "m_file"), table(spark, d, "m_bridge_file"), table(spark, d, "raw_update")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of the complete history of each entity that updates touch, as published by the chain store."""
    tables = _p1_inputs(spark, d)
    store = chains.ChainStore(spark, buckets=max(8, tables[3].count() // 2_000_000))
    store.replace(chains.touched_keys(tables[3]), chains.affected_chains(*tables))
    return store.read().select("kind", "key_id", "vid_s", "vid_e")


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of all entities: the stored one, in which the touched chains are replaced at once."""
    tag, file, bridge, updates = _p1_inputs(spark, d)
    store = chains.ChainStore(spark, buckets=max(64, (tag.count() + file.count()) // 2_000_000))
    store.write(chains.stored_history(tag, file, bridge))
    store.replace(chains.touched_keys(updates), chains.affected_chains(tag, file, bridge, updates))
    return store.read()


# 2 ---------------------------------------------------------------------------------------------------------------

#: src, its reference column, target table, target key, k1, k2, period. Fixed by the data model.
REFERENCES = (
    ("m_ast_container", "ref_ast_id", "m_ast", "ast_id", "ast_id", "priority", None),
    ("m_bridge_tag", "tag_id", "m_tag", "tag_id", "fid", "tag_id", None),
    ("m_ast_include", "fnid", "m_file_name", "fnid", "ast_id", "fnid", None),
    ("m_tag", "ast_id", "m_ast", "ast_id", "tag_id", "vid_s", "vid_s"),
)
_TARGETS = ("m_ast", "m_tag", "m_file_name")


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    """(src_no, period, key) of missing targets, from the bitmaps."""
    sides = []
    for i, (src, ref, target, _, _, _, period) in enumerate(REFERENCES):
        sides.append(dangling.side(table(spark, d, src), _TARGETS.index(target), i, ref, None if period is None else F.col(period)))
    for t, (name, key) in enumerate((("m_ast", "ast_id"), ("m_tag", "tag_id"), ("m_file_name", "fnid"))):
        log = dangling.last_log(table(spark, d, "key_log").filter(F.col("tbl") == name))
        there = F.coalesce(F.col("what") == "arrived", F.lit(False))
        sides.append(dangling.side(table(spark, d, name), t, dangling.IN_TABLE, key))
        sides.append(dangling.side(log.filter(there), t, dangling.LOG_THERE, "key_id"))
        sides.append(dangling.side(log.filter(~there), t, dangling.LOG_GONE, "key_id"))
    return dangling.dangling_keys(sides)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each dangling reference with its place; equal rows once."""
    missing = materialize(_dangling(spark, d), "missing")
    sizes = {r[0]: r[1] for r in missing.groupBy("role").count().collect()}  # one row per referring table
    out = None
    for i, (src, ref, _, _, k1, k2, _) in enumerate(REFERENCES):
        keys = missing.filter(F.col("role") == i).select(F.col("key").alias("ref_id")).distinct()
        if sizes.get(i, 0) <= 500_000:
            keys = F.broadcast(keys)
        rows = table(spark, d, src).select(F.lit(src).alias("src"), F.col(k1).cast("long").alias("k1"), F.col(k2).cast("long").alias("k2"), F.col(ref).cast("long").alias("ref_id"))
        rows = rows.join(keys, "ref_id", "left_semi").select("src", "k1", "k2", "ref_id").distinct()
        out = rows if out is None else out.unionAll(rows)
    return out


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Missing keys per referring table and period (null where the row has no version)."""
    name = F.element_at(F.array(*(F.lit(r[0]) for r in REFERENCES)), F.col("role") + 1)
    period = F.when(F.col("period") != dangling.NO_PERIOD, F.col("period"))
    return _dangling(spark, d).groupBy(name.alias("src"), period.alias("vid")).agg(F.count(F.lit(1)).alias("missing_keys"))


def p2_references(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references and the keys they miss: per table (level "table") and, where rows have a version, per version.

    A reference is a row of :func:`p2_found`. Tables without one have no row; in level "version" a null vid stands for rows without it.
    """
    dated = [r[0] for r in REFERENCES if r[6] is not None]  # their k2 is the version
    vid = F.when(F.col("src").isin(dated), F.col("k2")).cast("int")
    per = materialize(p2_found(spark, d).groupBy("src", "ref_id", vid.alias("vid")).agg(F.count(F.lit(1)).alias("n")), "per-key")
    n = F.sum("n").alias("refs")
    whole = per.groupBy("src").agg(n, F.countDistinct("ref_id").alias("missing_keys")).select("src", F.lit("table").alias("level"), F.lit(None).cast("int").alias("vid"), "refs", "missing_keys")
    each = per.filter(F.col("src").isin(dated)).groupBy("src", "vid").agg(n, F.count(F.lit(1)).alias("missing_keys"))
    return whole.unionByName(each.select("src", F.lit("version").alias("level"), "vid", "refs", "missing_keys"))


# 3 ---------------------------------------------------------------------------------------------------------------

def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths added, removed or given another fid from each snapshot to the next."""
    return snapshots.merkle_changes(table(spark, d, "m_bridge_file"), "vid", "fnid", "fid")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes of each kind per snapshot."""
    return p3_found(spark, d).groupBy("vid", "change").agg(F.count(F.lit(1)).alias("n"))


# 4 ---------------------------------------------------------------------------------------------------------------

def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and path of every node; nodes on or below cycles are marked."""
    return hierarchy_paths.hierarchy(table(spark, d, "m_ast_container"), "ast_id", "ref_ast_id", "priority")


def p4_below(spark: SparkSession, d: str) -> DataFrame:
    """All nodes below each node, as ranges of positions in the order of the trees."""
    return hierarchy_paths.below(table(spark, d, "m_ast_container"), "ast_id", "ref_ast_id", "priority")


def p4_below_all(spark: SparkSession, d: str) -> DataFrame:
    """All nodes below each node, those on and below cycles included; :func:`p4_below` has the nodes off cycles only."""
    return hierarchy_paths.below_all(table(spark, d, "m_ast_container"), "ast_id", "ref_ast_id", "priority")


# 5 ---------------------------------------------------------------------------------------------------------------

def _p5(spark: SparkSession, d: str) -> DataFrame:
    tags = intervals.interval_rows(table(spark, d, "m_tag"), 0, "tag_id", "vid_s", "vid_e", open_end=0)
    maps = intervals.interval_rows(table(spark, d, "m_map_ast"), 1, "map_id", "line_s", "line_e")
    name = F.when(F.col("src") == 0, "m_tag").otherwise("m_map_ast")
    hi = F.when(F.col("hi") == intervals.OPEN, F.lit(0)).otherwise(F.col("hi"))
    rows = intervals.merged_and_gaps(tags.unionAll(maps))
    return rows.select(
        name.alias("src"), F.when(F.col("gap"), "gap").otherwise("period").alias("what"), F.col("key").alias("key_id"),
        F.col("lo").cast("int").alias("lo"), hi.cast("int").alias("hi"), "multi", "gap",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Merged periods made of at least two different intervals, and the gaps between successive periods."""
    return _p5(spark, d).filter("gap or multi").drop("gap", "multi")


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """All merged periods and gaps, single intervals included."""
    return _p5(spark, d).drop("gap", "multi")


# 6 ---------------------------------------------------------------------------------------------------------------

def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys holding at least 3 % of all rows: the values at every 3 % of the ranks of the key, by distributed selection."""
    keys = (("m_bridge_tag", "fid"), ("m_ast", "type_id"))
    found = [(t, k) for t, c in keys for k, _ in selection.heavy_values(table(spark, d, t), c, "0.03")]  # at most 33 a table
    return spark.createDataFrame(found, "tbl string, key_id long")


def _with_quantiles(base: DataFrame, counts: DataFrame) -> DataFrame:
    q = selection.quantiles(counts, (0.5, 0.9)).groupBy("k").agg(F.max(F.when(F.col("q") == 0.5, F.col("x"))).alias("x50"), F.max(F.when(F.col("q") == 0.9, F.col("x"))).alias("x90"))
    return base.join(q, "k", "left")


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Per fid: rows, distinct tags, lines covered by extents, and the median and 90 % quantile of the first line."""
    rows = table(spark, d, "m_bridge_tag").filter("fid is not null")
    counts = materialize(selection.value_counts(rows, "fid", "line_s"), "counts")
    totals = selection.key_totals(counts).select("k", "n")
    tags = selection.distinct_per_key(rows, "fid", "tag_id")
    lines = intervals.covered(intervals.interval_rows(rows, 0, "fid", "line_s", "line_e")).select(F.col("key").alias("k"), "covered")
    base = totals.join(tags, "k", "left").join(lines, "k", "left")
    return _with_quantiles(base, counts).select(
        F.col("k").alias("fid"), "n", F.coalesce("d", F.lit(0)).alias("tags"), F.coalesce("covered", F.lit(0)).alias("lines_covered"), F.col("x50").alias("line_50"), F.col("x90").alias("line_90")
    )


def p6_types(spark: SparkSession, d: str) -> DataFrame:
    """Per type: rows, distinct nodes, distinct names, and the median and 90 % quantile of the length of the name."""
    rows = table(spark, d, "m_ast").filter("type_id is not null")
    counts = materialize(selection.value_counts(rows.withColumn("len", F.length("name")), "type_id", "len"), "counts")
    totals = selection.key_totals(counts).select("k", "n")
    nodes = selection.distinct_per_key(rows, "type_id", "ast_id").withColumnRenamed("d", "nodes")
    names = selection.distinct_per_key(rows, "type_id", "name").withColumnRenamed("d", "names")
    base = totals.join(nodes, "k", "left").join(names, "k", "left")
    return _with_quantiles(base, counts).select(
        F.col("k").alias("type_id"), "n", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("names", F.lit(0)).alias("names"), F.col("x50").alias("len_50"), F.col("x90").alias("len_90")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p2_found, p2_counts, p2_references, p3_found, p3_counts, p4_found, p4_below, p4_below_all, p5_found, p5_periods, p6_found, p6_files, p6_types)}

# SQL of the same results, for DuckDB over the same tables -----------------------------------------------------------

_CHAIN_SQL = """
stored as (
  select 'tag' kind, tag_id key_id, vid_s, vid_e, code, ast_id from m_tag
  union all
  select distinct 'file', b.fnid, f.vid_s, f.vid_e, null, null from m_bridge_file b join m_file f on b.fid = f.fid where b.fnid is not null),
upd as (select * from raw_update where vid is not null and key_id is not null and kind is not null
  qualify row_number() over (partition by kind, key_id, vid order by arrived_at desc nulls last, upd_id desc nulls last) = 1),
touched as (select distinct kind, key_id from upd),
starts as (select kind, key_id, vid_s vid, code, ast_id from stored where vid_s is not null
  qualify row_number() over (partition by kind, key_id, vid_s order by code desc nulls last, ast_id desc nulls last) = 1),
marks as (
  select kind, key_id, vid, case when stat = 'D' then 'end' else 'upd' end what, code, ast_id from upd
  union all
  select s.kind, s.key_id, s.vid, 'start', s.code, s.ast_id from starts s anti join upd u on s.kind = u.kind and s.key_id = u.key_id and s.vid = u.vid
  union all
  select e.kind, e.key_id, e.vid, 'end', null, null
  from (select distinct kind, key_id, vid_e + 1 vid from stored where vid_s is not null and vid_e <> 0) e
  anti join upd u on e.kind = u.kind and e.key_id = u.key_id and e.vid = u.vid
  anti join starts s on e.kind = s.kind and e.key_id = s.key_id and e.vid = s.vid),
filled as (
  select kind, key_id, vid, what,
    count(case when not (what = 'upd' and code is null) then 1 end) over w gc,
    count(case when not (what = 'upd' and ast_id is null) then 1 end) over w ga,
    code, ast_id
  from marks window w as (partition by kind, key_id order by vid)),
vals as (
  select kind, key_id, vid, what,
    max(case when what = 'start' or (what = 'upd' and code is not null) then code end) over (partition by kind, key_id, gc) code,
    max(case when what = 'start' or (what = 'upd' and ast_id is not null) then ast_id end) over (partition by kind, key_id, ga) ast_id
  from filled),
cut as (
  select *, case when kind = 'tag' and what <> 'end' and lag(what) over w <> 'end'
    and code is not distinct from lag(code) over w and ast_id is not distinct from lag(ast_id) over w then 0 else 1 end fresh
  from vals window w as (partition by kind, key_id order by vid)),
chains as (
  select kind, key_id, what, vid vid_s, coalesce(lead(vid) over (partition by kind, key_id order by vid) - 1, 0) vid_e, code, ast_id
  from cut where fresh = 1)
"""

_P2_SQL = """
with log as (select tbl, key_id, what from key_log where tbl is not null and key_id is not null
  qualify row_number() over (partition by tbl, key_id order by logged_at desc nulls last, log_id desc nulls last) = 1),
there as (
  select t.* from (select 'm_ast' tbl, ast_id k from m_ast union select 'm_tag', tag_id from m_tag union select 'm_file_name', fnid from m_file_name) t
    where (t.tbl, t.k) not in (select (tbl, key_id) from log)
  union select tbl, key_id from log where what = 'arrived'),
refs as (
  select 'm_ast_container' src, ast_id k1, cast(priority as bigint) k2, ref_ast_id ref_id, 'm_ast' tbl, null vid from m_ast_container
  union all select 'm_bridge_tag', fid, tag_id, tag_id, 'm_tag', null from m_bridge_tag
  union all select 'm_ast_include', ast_id, fnid, fnid, 'm_file_name', null from m_ast_include
  union all select 'm_tag', tag_id, vid_s, ast_id, 'm_ast', vid_s from m_tag),
missing as (select distinct src, k1, k2, ref_id, vid from refs where ref_id <> 0 and not exists (select 1 from there t where t.tbl = refs.tbl and t.k = refs.ref_id))
"""

_P3_SQL = """
with s as (select vid, fnid, max(fid) fid from m_bridge_file where fnid is not null and vid is not null group by 1, 2),
v as (select vid, lag(vid) over (order by vid) old from (select distinct vid from m_bridge_file where vid is not null)),
a as (select v.vid, s.fnid, s.fid from v join s on s.vid = v.old),
b as (select v.vid, s.fnid, s.fid from v join s on s.vid = v.vid where v.old is not null),
changes as (
  select coalesce(b.vid, a.vid) vid, coalesce(b.fnid, a.fnid) fnid,
    case when a.vid is null then 'A' when b.vid is null then 'D' when a.fid is distinct from b.fid then 'M' end change
  from a full join b on a.vid = b.vid and a.fnid = b.fnid)
"""

_P4_SQL = """
with recursive e as (
  select ref_ast_id v, ast_id p, min(priority) pr from m_ast_container
  where ref_ast_id is not null and ref_ast_id <> 0 and ast_id is not null group by 1, 2),
n as (select v from e union select p from e union select ref_ast_id from m_ast_container where ref_ast_id is not null and ref_ast_id <> 0),
up(v, a) as (select v, p from e union select up.v, e.p from up join e on up.a = e.v),
cyc as (select v from up where v = a),
bad as (select v from cyc union select v from up where a in (select v from cyc)),
one as (select v, min(p) p from e where v not in (select v from bad) group by 1),
walk(node_id, root_id, depth, path) as (
  select v, v, 0, '' from n where v not in (select v from e)
  union all
  select o.v, w.root_id, w.depth + 1, case when w.depth = 0 then '' else w.path || '.' end || coalesce(cast(e.pr as varchar), '')
  from walk w join one o on o.p = w.node_id join e on e.v = o.v and e.p = o.p)
select * from walk union all select v, -1, -1, '' from bad
"""

_P5_SQL = """
with i as (
  select distinct 'm_tag' src, tag_id k, cast(vid_s as bigint) lo, case when vid_e = 0 then 1000000000000 else vid_e end hi from m_tag
    where tag_id <> 0 and vid_s is not null and vid_e is not null and (vid_e = 0 or vid_e >= vid_s)
  union all
  select distinct 'm_map_ast', map_id, line_s, line_e from m_map_ast where map_id <> 0 and line_s is not null and line_e >= line_s),
j as (select *, case when lo <= max(hi) over (partition by src, k order by lo, hi rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end fresh from i),
g as (select *, sum(fresh) over (partition by src, k order by lo, hi) grp from j),
p as (select src, k, grp, min(lo) lo, max(hi) hi, count(*) n from g group by 1, 2, 3),
allp as (
  select src, 'period' what, k key_id, cast(lo as int) lo, case when hi = 1000000000000 then 0 else cast(hi as int) end hi, n from p
  union all
  select src, 'gap', k, cast(prev + 1 as int), cast(lo - 1 as int), 2 from (select *, lag(hi) over (partition by src, k order by lo) prev from p) where prev is not null)
"""

_P6_QUANTILE = """
q as (select k, max(case when rn = greatest(ceil(0.5 * n), 1) then x end) x50, max(case when rn = greatest(ceil(0.9 * n), 1) then x end) x90
  from (select k, x, row_number() over (partition by k order by x) rn, count(*) over (partition by k) n from r where x is not null) group by k)
"""

SQL: dict[str, str] = {
    "p1_found": f"with {_CHAIN_SQL} select c.kind, c.key_id, c.vid_s, cast(c.vid_e as int) vid_e from chains c semi join touched t on c.kind = t.kind and c.key_id = t.key_id where what <> 'end'",
    "p1_history": f"with {_CHAIN_SQL} select c.kind, c.key_id, c.vid_s, cast(c.vid_e as int) vid_e, c.code, c.ast_id from chains c where what <> 'end' and (c.kind <> 'tag' or c.key_id <> 0 or exists (select 1 from touched t where t.kind = 'tag' and t.key_id = 0))",
    "p2_found": _P2_SQL + " select distinct src, k1, k2, ref_id from missing",
    "p2_counts": _P2_SQL + " select src, vid, count(distinct ref_id) missing_keys from missing group by 1, 2",
    "p2_references": _P2_SQL + """, found as (select distinct src, k1, k2, ref_id from missing)
select src, 'table' as level, cast(null as int) vid, count(*) refs, count(distinct ref_id) missing_keys from found group by src
union all
select src, 'version', cast(k2 as int), count(*), count(distinct ref_id) from found where src = 'm_tag' group by src, k2""",
    "p3_found": _P3_SQL + " select vid, fnid, change from changes where change is not null",
    "p3_counts": _P3_SQL + " select vid, change, count(*) n from changes where change is not null group by 1, 2",
    "p4_found": _P4_SQL,
    "p4_below": _P4_SQL.rsplit("select * from walk", 1)[0].replace("walk(node_id, root_id, depth, path)", "walk(node_id, root_id, depth, path, trail)")
    .replace("select v, v, 0, ''", "select v, v, 0, '', cast([] as struct(r int, n bigint)[])").replace("coalesce(cast(e.pr as varchar), '')", "coalesce(cast(e.pr as varchar), ''), list_append(w.trail, struct_pack(r := cast(e.pr as int), n := o.v))")
    + """, t as (select node_id, root_id, trail, row_number() over (order by root_id, trail) pos from walk),
k as (select a, count(*) size from (select unnest(list_concat([root_id], list_transform(trail[:-2], lambda x: x.n))) a from t where len(trail) > 0) group by a)
select node_id, root_id, pos, pos + coalesce(size, 0) as last from t left join k on node_id = a""",
    "p5_found": _P5_SQL + " select src, what, key_id, lo, hi from allp where n > 1",
    "p5_periods": _P5_SQL + " select src, what, key_id, lo, hi from allp",
    "p6_found": """
select 'm_bridge_tag' tbl, fid key_id from m_bridge_tag where fid is not null group by fid having count(*) >= 0.03 * (select count(*) from m_bridge_tag)
union all
select 'm_ast', cast(type_id as bigint) from m_ast where type_id is not null group by type_id having count(*) >= 0.03 * (select count(*) from m_ast)""",
    "p6_files": f"""
with r as (select fid k, cast(line_s as bigint) x, line_s lo, line_e hi, tag_id from m_bridge_tag where fid is not null), {_P6_QUANTILE},
i as (select distinct k, lo, hi from r where hi >= lo and k <> 0),
j as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) top from i),
c as (select k, sum(greatest(0, hi - greatest(lo, coalesce(top + 1, lo)) + 1)) covered from j group by k)
select r.k fid, count(*) n, count(distinct tag_id) tags, cast(coalesce(max(c.covered), 0) as bigint) lines_covered, max(q.x50) line_50, max(q.x90) line_90
from r left join q on q.k = r.k left join c on c.k = r.k group by r.k""",
    "p6_types": f"""
with r as (select type_id k, cast(length(name) as bigint) x, name, ast_id from m_ast where type_id is not null), {_P6_QUANTILE}
select r.k type_id, count(*) n, count(distinct ast_id) nodes, count(distinct name) as names, max(q.x50) len_50, max(q.x90) len_90 from r left join q on q.k = r.k group by r.k""",
}
