"""Queries for sources, engines, staging and the steps that write a version, with the SQL of the same result for DuckDB.

Where the data has nothing for an operator to work on, the query adds a few invented rows, and so does its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import report, text
from treeloom.operators import browse, extents, select, staging, tags, versions
from treeloom.plans import joingraph
from treeloom.plans.joingraph import Join
from treeloom.queries.model import _ALL_SNAPS, _AT_SQL, _TYPE_SQL, _at, _transitions
from treeloom.runtime import materialize, new_path
from treeloom.sources import tree
from treeloom.sources.catalog import SPECS, counts_or_errors, missing_tables, table, type_descriptor
from treeloom.sources.engines import ENGINES, MemoryEngine, ParquetEngine, debug_json, get_engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of literal rows."""
    def lit(x):
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"cast({x} as bigint)"

    return "select * from (values " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") t({columns})"


# Sources ----------------------------------------------------------------------------------------------------------

@query("select distinct fid, vid_s, vid_e, ftype, s_stat, e_stat from m_file")
def memory_scan(spark, d):
    """A table held in memory, read back."""
    e = MemoryEngine(spark)
    e.replace("m_file", table(spark, d, "m_file").distinct())
    return e.scan("m_file")


_DIFF = f"""with {_ALL_SNAPS}, c as (
  select n.vid, n.fnid, 'A' op from n where not exists (select 1 from o where o.vid = n.vid and o.fnid = n.fnid)
  union all select o.vid, o.fnid, 'D' from o where not exists (select 1 from n where o.vid = n.vid and o.fnid = n.fnid)
  union all select n.vid, n.fnid, 'M' from n join o on o.vid = n.vid and o.fnid = n.fnid where o.fid is distinct from n.fid)"""


@query(_DIFF + """ select op, cast(null as int) score, fname path, cast(null as varchar) old_path from (select distinct op, fname from c join m_file_name using (fnid) where fname <> '')
union all select 'R', 100, 'moved/' || fname, fname from m_file_name where fname <> ''""")
def change_list(spark, d):
    """A saved list of changes (one line each, renames with their similarity), read and parsed."""
    old, new, _ = _transitions(spark, d)
    names = table(spark, d, "m_file_name").filter("fname <> ''")
    ops = versions.classify(old, new, "k", "fid").filter("op <> '='").select("op", "k.fnid").join(names, "fnid").select("op", "fname").distinct()
    lines = ops.select(F.concat_ws("\t", "op", "fname").alias("value")).unionByName(names.select(F.concat(F.lit("R100\t"), "fname", F.lit("\tmoved/"), "fname").alias("value")))
    path = new_path(spark, "changes")
    lines.unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(path)
    return tree.read_changes(spark, path)


_FILES = (("a/one.c", "int x;\n"), ("a/b/two.S", "nop\n"), ("Kconfig", "config X\n"), ("d e.rs", ""))


@query("select cast(vid as int) vid, path, content, sha256(content) content_hash, cast(ftype as smallint) ftype from ("
       + _values([(7, p, c, {"c": 1, "S": 4, "rs": 3}.get(p.rpartition(".")[2], 2)) for p, c in _FILES], "vid, path, content, ftype") + ")")
def tree_extract(spark, d):
    """A folder of files as a snapshot; the files are invented."""
    path = new_path(spark, "tree")
    jvm = spark.sparkContext._jvm
    for name, content in _FILES:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(content.encode()))
        out.close()
    return tree.read_tree(spark, path, 7)


@query(_values([("m_moved_file",), ("m_ast_debug",)], "name"))
def catalog_missing(spark, d):
    """Tables of the model the session does not know; all others are registered first."""
    names = [n for n in SPECS if n not in ("m_moved_file", "m_ast_debug")]
    for n in names:
        spark.createDataFrame([], SPECS[n].ddl).createOrReplaceTempView(n)
    try:
        return spark.createDataFrame([(n,) for n in missing_tables(spark, list(SPECS))], "name string")
    finally:
        for n in names:
            spark.catalog.dropTempView(n)


@query(_values([("parquet", "ParquetEngine"), ("memory", "MemoryEngine"), ("inmemory", "MemoryEngine"), ("mock", "MemoryEngine"), ("oracle", "ValueError")], "name, engine"))
def engine_factory(spark, d):
    def of(name):
        try:
            return get_engine(name.upper()).__name__
        except ValueError as e:
            return type(e).__name__

    return spark.createDataFrame([(n, of(n)) for n in (*ENGINES, "oracle")], "name string, engine string")


def _engine(spark) -> ParquetEngine:
    return ParquetEngine(spark, new_path(spark, "engine"))


def _sizes(spark, e, names) -> DataFrame:
    out = None
    for n in names:
        one = e.scan(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(_values([(s.name, len(s.seed)) for s in SPECS.values()], "name, n"))
def create_tables(spark, d):
    """All tables of the model, new, with their seed rows; creating them again changes nothing."""
    e = _engine(spark)
    e.create(list(SPECS))
    e.create(list(SPECS))
    return _sizes(spark, e, SPECS)


@query(_values([("m_tag",), ("m_ast",), ("m_file",)], "name"))
def drop_tables(spark, d):
    """Tables missing after some of them were dropped; dropping one that is not there is no error."""
    e = _engine(spark)
    e.create(["m_tag", "m_ast", "m_v_main", "m_file"])
    e.drop(["m_tag", "m_file", "m_ast", "m_map_ast"])
    return spark.createDataFrame([(n,) for n in e.missing(["m_tag", "m_ast", "m_v_main", "m_file"])], "name string")


@query("select tag_id, vid_s, vid_e, code, ast_id, hl_s, hl_l from m_tag union all select 0, 0, 0, '', 0, 0, 0")
def insert_rows(spark, d):
    """Rows added to a table with its seed row, in two steps."""
    e, t = _engine(spark), table(spark, d, "m_tag")
    e.create(["m_tag"])
    e.insert("m_tag", t.filter("vid_s < 5"))
    e.insert("m_tag", t.filter("vid_s >= 5 or vid_s is null"))
    return e.scan("m_tag")


_LAST_FILE = "(select fid, max(vid_s) vid_s, max(vid_e) vid_e, max(ftype) ftype, max(s_stat) s_stat, max(e_stat) e_stat from m_file group by fid)"


@query(f"""select 'm_file_name' name, count(*) n, cast(sum(fnid) as bigint) total from (select fnid from m_file_name union all select 0)
union all select 'm_file', count(*), cast(sum(fid + vid_e) as bigint) from (select fid, 99 vid_e from {_LAST_FILE} where fid % 2 = 0 union all select fid, vid_e from {_LAST_FILE} where fid % 2 <> 0 union all select 0, 0 where not exists (select 1 from {_LAST_FILE} where fid = 0))""")
def commit_tables(spark, d):
    """Inserts into two tables and updates of one of them, committed at once."""
    e = _engine(spark)
    e.create(["m_file_name", "m_file"])
    files = table(spark, d, "m_file").groupBy("fid").agg(*(F.max(c).alias(c) for c in ("vid_s", "vid_e", "ftype", "s_stat", "e_stat")))
    e.commit({"m_file_name": table(spark, d, "m_file_name"), "m_file": files.filter("fid <> 0")}, {"m_file": files.filter("fid % 2 = 0").withColumn("vid_e", F.lit(99))})
    names = e.scan("m_file_name").agg(F.count(F.lit(1)).alias("n"), F.sum("fnid").alias("total")).select(F.lit("m_file_name").alias("name"), "n", "total")
    return names.unionAll(e.scan("m_file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fid") + F.col("vid_e")).alias("total")).select(F.lit("m_file").alias("name"), "n", "total"))


@query("select true made, true again, false other, false removed, count(*) n, cast(sum(ast_id) as bigint) total from m_ast")
def index_layout(spark, d):
    """A sorted layout in place of an index: made once, found, removed; the rows stay."""
    e = _engine(spark)
    e.replace("m_ast", table(spark, d, "m_ast"))
    e.create_index("m_ast", ["type_id"])
    state = [e.index_exists("m_ast", ["type_id"])]
    e.create_index("m_ast", ["type_id"])
    state += [e.index_exists("m_ast", ["type_id"]), e.index_exists("m_ast", ["name"])]
    e.remove_index("m_ast", ["type_id"])
    state.append(e.index_exists("m_ast", ["type_id"]))
    flags = [F.lit(x).alias(n) for x, n in zip(state, ("made", "again", "other", "removed"), strict=True)]
    return e.scan("m_ast").agg(F.count(F.lit(1)).alias("n"), F.sum("ast_id").alias("total")).select(*flags, "n", "total")


@query("""select 'm_ast' table_name, count(*) n, cast(null as varchar) error from m_ast union all select 'm_tag', count(*), null from m_tag
union all select 'm_bridge_map', null, 'Error: AnalysisException'""")
def count_or_error(spark, d):
    return counts_or_errors(spark, d, ["m_ast", "m_tag", "m_bridge_map"])


_CHECKED = ("m_v_main", "m_file_name", "m_file", "m_bridge_file", "m_ast", "m_ast_container", "m_ast_include", "m_tag", "m_bridge_tag", "m_map_ast")


@query(" union all ".join([*(f"select '{t}' name, cast(null as varchar) problem where false" for t in _CHECKED[:1]), "select 'wrong', 'fid: long instead of int'", "select 'wrong', 'size: missing instead of int'"]))
def schema_check(spark, d):
    """Columns of the stored tables that differ from the model; a wrong schema is checked as well."""
    found = [(n, p) for n in _CHECKED for p in select.check_schema(table(spark, d, n), SPECS[n].ddl)]
    found += [("wrong", p) for p in select.check_schema(table(spark, d, "m_file"), "fid int, vid_s int, size int")]
    return spark.createDataFrame(found, "name string, problem string")


@query("select log_id, tbl, cast(what = 'deleted' as int) gone, strftime(logged_at, '%Y-%m-%d') logged from key_log")
def plain_values(spark, d):
    log = table(spark, d, "key_log").select("log_id", "tbl", (F.col("what") == "deleted").alias("gone"), F.to_date("logged_at").alias("logged"))
    return select.plain_values(log)


# Joins ------------------------------------------------------------------------------------------------------------

@query("""select a.ast_id A1_ast_id, a.name A1_name, a.type_id A1_type_id, c.ast_id A2_ast_id, c.priority A2_priority, c.type_id A2_type_id, c.ref_ast_id A2_ref_ast_id,
  e.ast_id A3_ast_id, e.priority A3_priority, e.type_id A3_type_id, e.ref_ast_id A3_ref_ast_id, t.tag_id A4_tag_id, t.vid_s A4_vid_s, t.ast_id A4_ast_id
from m_ast a join m_ast_container c on a.ast_id = c.ast_id join m_ast_container e on a.ast_id = e.ast_id join (select distinct tag_id, vid_s, ast_id from m_tag) t on c.ref_ast_id = t.ast_id where c.priority = 0 and e.priority = 1""")
def view_onward(spark, d):
    """A join onward from a table that is there twice starts from its first alias."""
    tables = {"m_ast": table(spark, d, "m_ast"), "m_ast_container": table(spark, d, "m_ast_container"), "m_tag": table(spark, d, "m_tag").select("tag_id", "vid_s", "ast_id").distinct()}
    joins = [Join("m_ast", "ast_id", "m_ast_container", "ast_id", repeat=2), Join("m_ast_container", "ref_ast_id", "m_tag", "ast_id")]
    return joingraph.view(tables, "m_ast", joins, (None, None, None, None, 0, None, None, None, 1))


@query("""select b.vid A1_vid, b.fnid A1_fnid, b.fid A1_fid, v.vid A2_vid, v.vname A2_vname from (select distinct * from m_bridge_file) b join m_v_main v on b.vid = v.vid where v.vname = 'w3.1'""")
def view_in_memory(spark, d):
    """The same joins over tables held in memory."""
    e = MemoryEngine(spark)
    e.replace("m_bridge_file", table(spark, d, "m_bridge_file").distinct())
    e.replace("m_v_main", table(spark, d, "m_v_main"))
    return joingraph.view(e.tables, "m_bridge_file", [Join("m_bridge_file", "vid", "m_v_main", "vid")], (None, None, None, None, "w3.1"))


_DEBUG_SQL = "(select ast_id, json_object('ast_id', ast_id, 'name', name, 'type_id', type_id)::varchar ast_raw from (select distinct ast_id, name, type_id from m_ast where name is not null and type_id is not null))"


def _debug(spark, d):
    """m_ast_debug, of which the data has none: each whole node as JSON."""
    nodes = table(spark, d, "m_ast").filter("name is not null and type_id is not null").select("ast_id", "name", "type_id").distinct()
    return debug_json(nodes, "ast_id")


@query(f"""select b.fid, b.tag_id, b.line_s, b.char_s, t.vid_s, t.code, t.hl_s, t.hl_l, a.name ast_name, a.type_id, y.name type_name, g.ast_raw
from (select distinct * from m_bridge_tag) b join (select distinct * from m_tag) t on b.tag_id = t.tag_id join (select distinct * from m_ast) a on t.ast_id = a.ast_id
left join {_TYPE_SQL} y on a.type_id = y.type_id left join {_DEBUG_SQL} g on g.ast_id = a.ast_id""")
def tag_rows_debug(spark, d):
    """Tags of all files with node, type and debug text."""
    b, t, a = (table(spark, d, n) for n in ("m_bridge_tag", "m_tag", "m_ast"))
    r = browse.tag_rows(b, t, a, type_descriptor(spark), _debug(spark, d))
    return r.select("fid", "tag_id", "line_s", "char_s", "vid_s", "code", "hl_s", "hl_l", "ast_name", "type_id", "type_name", "ast_raw")


_BRIDGE_MAP_SQL = "(select distinct t.tag_id, m.map_id from m_tag t join m_map_ast m on t.tag_id = m.map_id where m.map_id <> 0)"


def _bridge_map(spark, d):
    """m_bridge_map, of which the data has none: a map has the id of its tag."""
    t, m = table(spark, d, "m_tag"), table(spark, d, "m_map_ast").filter("map_id <> 0")
    return t.select("tag_id").distinct().join(m.select("map_id").distinct(), F.col("tag_id") == F.col("map_id"))


_MAPS_SQL = f"""select bm.tag_id, m.map_id, m.line_s, m.char_s, m.line_e, m.char_e, m.ast_id, a.name ast_name, a.type_id, y.name type_name
from {_BRIDGE_MAP_SQL} bm join (select distinct * from m_map_ast) m on bm.map_id = m.map_id join (select distinct * from m_ast) a on m.ast_id = a.ast_id left join {_TYPE_SQL} y on a.type_id = y.type_id"""


@query(_MAPS_SQL)
def tag_maps(spark, d):
    """The node extents of all tags, over the table that links tags to maps."""
    m = browse.map_rows(table(spark, d, "m_map_ast"), table(spark, d, "m_ast"), type_descriptor(spark), _bridge_map(spark, d))
    return m.select("tag_id", "map_id", "line_s", "char_s", "line_e", "char_e", "ast_id", "ast_name", "type_id", "type_name")


_DEPTH_SQL = """ids as (select distinct ast_id id from (select ast_id from one union all select ast_id from maps where tag_id in (select tag_id from one)) where ast_id <> 0),
e as (select distinct c.ast_id p, c.ref_ast_id c from m_ast_container c where (c.ast_id in (select id from ids) or c.ref_ast_id in (select id from ids)) and c.ast_id <> 0 and c.ref_ast_id <> 0),
roots as (select distinct p from e where p not in (select c from e)),
w(node, depth) as (select p, 0 from e where p in (select p from roots) or not exists (select 1 from roots) union select e.c, w.depth + 1 from w join e on e.p = w.node where w.depth < 400),
dep as (select node, min(depth) depth from w group by 1)"""


@query(f"""with recursive one as (select b.fid, b.tag_id, b.line_s, b.char_s, t.vid_s, t.vid_e, t.code, t.ast_id, a.name ast_name, g.ast_raw
  from (select distinct * from m_bridge_tag where fid = 7) b join (select distinct * from m_tag) t on b.tag_id = t.tag_id join (select distinct * from m_ast) a on t.ast_id = a.ast_id left join {_DEBUG_SQL} g on g.ast_id = a.ast_id),
maps as ({_MAPS_SQL}), {_DEPTH_SQL}
select o.tag_id, o.line_s, o.char_s, o.vid_s, o.code, o.ast_name, o.ast_raw, d.depth container_depth, m.line_s map_line_s, m.char_s map_char_s, m.line_e map_line_e, m.ast_name map_name, m.type_name map_type, x.depth map_depth
from one o left join maps m on m.tag_id = o.tag_id left join dep d on d.node = o.ast_id left join dep x on x.node = m.ast_id""")
def file_detail_rows(spark, d):
    """One file whole, its nested extents taken apart again: tags, nodes, debug text, extents and container depths."""
    b, t, m, a, c = (table(spark, d, n) for n in ("m_bridge_tag", "m_tag", "m_map_ast", "m_ast", "m_ast_container"))
    one = browse.file_detail(7, b, t, m, a, type_descriptor(spark), _bridge_map(spark, d), _debug(spark, d), c)
    r = one.withColumn("m", F.explode_outer("maps"))
    return r.select(
        "tag_id", "line_s", "char_s", "vid_s", "code", "ast_name", "ast_raw", "container_depth", F.col("m.line_s").alias("map_line_s"), F.col("m.char_s").alias("map_char_s"),
        F.col("m.line_e").alias("map_line_e"), F.col("m.ast_name").alias("map_name"), F.col("m.type_name").alias("map_type"), F.col("m.container_depth").alias("map_depth"),
    )


@query(f"""with one as (select t.tag_id, t.vid_s, t.code, t.hl_s, t.hl_l, b.fid, b.line_s, a.name ast_name, g.ast_raw
  from (select distinct * from m_tag where tag_id = 1500) t left join (select distinct * from m_bridge_tag) b on b.tag_id = t.tag_id join (select distinct * from m_ast) a on t.ast_id = a.ast_id left join {_DEBUG_SQL} g on g.ast_id = a.ast_id
  order by t.vid_s nulls first, b.fid nulls first, b.line_s nulls first, b.char_s nulls first, b.line_e nulls first, b.char_e nulls first, t.code nulls first, a.name nulls first limit 1)
select o.*, m.line_s map_line_s, m.line_e map_line_e, m.ast_name map_name, m.type_name map_type from one o left join ({_MAPS_SQL}) m on m.tag_id = o.tag_id""")
def tag_detail_rows(spark, d):
    """One tag whole, its nested extents taken apart again."""
    b, t, a, m = (table(spark, d, n) for n in ("m_bridge_tag", "m_tag", "m_ast", "m_map_ast"))
    one = browse.tag_detail(1500, b, t, a, type_descriptor(spark), m, _bridge_map(spark, d), _debug(spark, d)).withColumn("m", F.explode_outer("maps"))
    return one.select(
        "tag_id", "vid_s", "code", "hl_s", "hl_l", "fid", "line_s", "ast_name", "ast_raw", F.col("m.line_s").alias("map_line_s"), F.col("m.line_e").alias("map_line_e"), F.col("m.ast_name").alias("map_name"), F.col("m.type_name").alias("map_type"),
    )


@query(f"""with p as (select vid, vname, unnest(range(1, len(string_split(fname, '/')) + 1)) i, string_split(fname, '/') s from {_AT_SQL} where fname <> '')
select vname, array_to_string(s[1:i - 1], '/') dir, s[i] as name, max(i < len(s)) is_dir from p group by 1, 2, 3""")
def browse_everything(spark, d):
    """What stands right below each directory of each version."""
    return browse.listing(_at(spark, d), "vname", "fname")


@query(f"select substring(fname, 13) as name, fnid, fid, ftype from {_AT_SQL} where vname = 'w3.1' and fname like 'include/gen/%' and fname not like 'include/gen/%/%'")
def browse_folder_files(spark, d):
    return browse.files_below(_at(spark, d, "w3.1"), "fname", "include/gen").select("name", "fnid", "fid", "ftype")


_PLACE = ("line_s", "char_s", "line_e", "char_e")


@query("""select tag_id, min(p) is not distinct from max(p) same from (select tag_id, (coalesce(line_s, -1), coalesce(char_s, -1), coalesce(line_e, -1), coalesce(char_e, -1)) p from m_bridge_tag where tag_id is not null) group by 1""")
def extent_equal(spark, d):
    """Whether all places of a tag are the same extent: the least against the greatest; a null equals a null."""
    place = F.struct(*_PLACE)
    ends = table(spark, d, "m_bridge_tag").filter("tag_id is not null").groupBy("tag_id").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    flat = ends.select("tag_id", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in _PLACE))
    return flat.select("tag_id", extents.equal("a_", "b_").alias("same"))


# Staging ----------------------------------------------------------------------------------------------------------

@query("""with u as (select key_id, vid, code, ast_id, row_number() over (partition by key_id, vid order by arrived_at desc nulls last, upd_id desc nulls last) rn
  from raw_update where kind = 'tag' and vid is not null),
k as (select u.* from u where rn = 1 and (ast_id is null or ast_id in (select ast_id from m_ast)))
select b.tag_id, b.vid_s, coalesce(u.code, b.code) code, coalesce(u.ast_id, b.ast_id) ast_id
from (select distinct tag_id, vid_s, code, ast_id from m_tag) b left join k u on u.key_id = b.tag_id and u.vid = b.vid_s""")
def patch_resolved(spark, d):
    """Updates that refer to a node which is not there are skipped."""
    t, r, a = (table(spark, d, n) for n in ("m_tag", "raw_update", "m_ast"))
    u = r.filter("kind = 'tag' and vid is not null").select(F.col("key_id").alias("tag_id"), F.col("vid").alias("vid_s"), "arrived_at", "upd_id", "code", "ast_id")
    u = staging.last_wins(u, ["tag_id", "vid_s"], ["arrived_at", "upd_id"]).join(a.select(F.col("ast_id").alias("_a")).distinct(), F.col("ast_id") == F.col("_a"), "left")
    return staging.patch(t.select("tag_id", "vid_s", "code", "ast_id").distinct(), u.select("tag_id", "vid_s", "code", "ast_id", "_a"), ["tag_id", "vid_s"], F.col("ast_id").isNotNull() & F.col("_a").isNull())


@query("select row_number() over (order by ast_id) new_id, ast_id as source from (select distinct ast_id from m_ast_container where ast_id is not null)")
def view_parents(spark, d):
    """The parent rows of a view taken apart: one new id each."""
    c = table(spark, d, "m_ast_container").filter("ast_id is not null")
    parents, _ = staging.decompose(c, ["ast_id"], {"source": F.col("ast_id")}, {"type_id": F.col("type_id")}, ["type_id"])
    return parents


_KIDS_SQL = "(select distinct c.ast_id, c.priority old, c.ref_ast_id child, a.type_id kind from m_ast_container c join (select ast_id, max(type_id) type_id from m_ast group by 1) a on c.ref_ast_id = a.ast_id)"


@query(f"""select ast_id, cast(row_number() over (partition by ast_id order by old nulls first, child nulls first) as int) priority,
cast(case when kind in (27, 28, 29) then 27 when kind = 20 then 21 else 1 end as smallint) type_id, child from {_KIDS_SQL}""")
def expand_children(spark, d):
    """Container rows made from child nodes: the type of the link by rules on the child, the place by order, from 1."""
    a = table(spark, d, "m_ast").groupBy(F.col("ast_id").alias("child")).agg(F.max("type_id").alias("kind"))
    kids = table(spark, d, "m_ast_container").select("ast_id", F.col("priority").alias("old"), F.col("ref_ast_id").alias("child")).distinct().join(a, "child")
    return staging.expand(kids, "ast_id", ["old", "child"], F.col("kind"), [({27, 28, 29}, 27), (20, 21)], 1, 1)


@query("select ast_id, priority, ref_ast_id, cast(row_number() over (partition by ast_id order by priority nulls first, ref_ast_id nulls first) - 1 as int) as position from (select distinct ast_id, priority, ref_ast_id from m_ast_container)")
def collect_children(spark, d):
    c = table(spark, d, "m_ast_container").select("ast_id", "priority", "ref_ast_id").distinct()
    return browse.ordered_children(c, "ast_id", ["priority", "ref_ast_id"])


# A file waits for the folder above it: paths lead to their parents, so rounds are depths.
_FOLDERS = "(select distinct array_to_string(s[1:i], '/') me, array_to_string(s[1:i - 1], '/') up from (select string_split(fname, '/') s, unnest(range(1, len(string_split(fname, '/')) + 1)) i from m_file_name where fname <> ''))"


@query(f"""with f as {_FOLDERS}, k as (select me, row_number() over (order by me) id from (select me from f union select '' )),
r as (select k.id, cast(len(string_split(me, '/')) - case when me = '' then 1 else 0 end as int) round from k)
select id, round from r union all select 1000000000, null union all select 1000000001, null""")
def resolve_rounds(spark, d):
    """Rows that wait for rows: folders wait for the folder above; two invented rows wait for each other."""
    parts = F.split("fname", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("me"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("up")))
    f = materialize(table(spark, d, "m_file_name").filter("fname <> ''").select(F.explode(ups).alias("x")).select("x.me", "x.up").distinct(), "folders")
    ids = materialize(staging.assign_ids(f.select("me").unionAll(spark.createDataFrame([("",)], "me string")), ["me"], "id", 1), "ids")
    rows = f.join(ids, "me").join(ids.select(F.col("me").alias("up"), F.col("id").alias("needs")), "up").select("id", "needs")
    odd = spark.createDataFrame([(10**9, 10**9 + 1), (10**9 + 1, 10**9)], "id long, needs long")
    return staging.resolve_all(rows.unionByName(odd), "id", "needs")


@query("""select 'm_ast.name' what, count(*) n, count(*) filter (where name is null or name = '') failed from m_ast union all
select 'm_map_ast.line_e', count(*), count(*) filter (where not coalesce(line_e >= line_s, false)) from m_map_ast""")
def failed_rows(spark, d):
    """How many rows fail a check, per check."""
    a = report.failures(table(spark, d, "m_ast"), F.col("name") != "", "m_ast.name")
    return a.unionByName(report.failures(table(spark, d, "m_map_ast"), F.col("line_e") >= F.col("line_s"), "m_map_ast.line_e"))


# References and keys of the whole model ----------------------------------------------------------------------------

_HERE = [t for t in SPECS if t in _CHECKED]
_REFS = [(t, c, p, k) for t in _HERE for c, p, k in SPECS[t].foreign if p in (*_HERE, "m_type_descriptor")]


def _parent_sql(p: str, k: str) -> str:
    return f"(select {k} from {_TYPE_SQL})" if p == "m_type_descriptor" else f"(select {k} from {p} where {k} is not null)"


@query(" union all ".join(f"select '{t}.{c}' ref, cast({c} as bigint) \"key\", count(*) n from {t} where {c} is not null and {c} <> 0 and {c} not in {_parent_sql(p, k)} group by {c}" for t, c, p, k in _REFS))
def reference_violations(spark, d):
    """For every reference of the model the keys its target lacks, and how many rows have them."""
    out = None
    for t, c, p, k in _REFS:
        parent = type_descriptor(spark) if p == "m_type_descriptor" else table(spark, d, p)
        counts = table(spark, d, t).groupBy(c).agg(F.count(F.lit(1)).alias("n"))  # once per key before the join
        one = staging.missing_parents(counts, c, parent, k).select(F.lit(f"{t}.{c}").alias("ref"), F.col(c).cast("long").alias("key"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(" union all ".join(f"select '{t}' table_name, count(*) keys, cast(sum(n) as bigint) n from (select count(*) n from {t} group by {', '.join(SPECS[t].primary)} having count(*) > 1)" for t in _HERE))
def key_violations(spark, d):
    """For every table of the model how many keys come more than once, and in how many rows."""
    out = None
    for t in _HERE:
        one = staging.repeated_keys(table(spark, d, t), SPECS[t].primary).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).select(F.lit(t).alias("table_name"), "keys", "n")
        out = one if out is None else out.unionAll(one)
    return out


# Writing a version ------------------------------------------------------------------------------------------------

@query("select cast(8 as int) vid, 8 old_vid, 'w3.1' vname, true known where (select vid from m_v_main where vname = 'w3.1') = 8 union all select max(vid) + 1, max(vid), 'next', false from m_v_main")
def register_version(spark, d):
    v = table(spark, d, "m_v_main")
    return versions.register(v, "w3.1").unionByName(versions.register(v, "next"))


@query(f"with {_ALL_SNAPS} select n.vid, n.fnid, o.fid from o join n on o.vid = n.vid and o.fnid = n.fnid and o.fid is not distinct from n.fid")
def unchanged_links(spark, d):
    """The links of unchanged paths in each snapshot: (vid, fnid) with the file they had before."""
    old, new, _ = _transitions(spark, d)
    kept = versions.unchanged(old.select("k", "fid"), new.select("k", "fid"), "k", "fid")
    return kept.join(old.select("k", "fid"), "k").select("k.vid", "k.fnid", "fid")


_STEPS_SQL = "v as (select vid, row_number() over (order by vid) i, lead(vid) over (order by vid) nxt from (select distinct vid from m_bridge_file where vid is not null))"
_DIR_ROWS_SQL = "(select distinct b.vid, array_to_string(s[1:i], '/') dir from (select vid, string_split(fname, '/') s, unnest(range(1, len(string_split(fname, '/')))) i from m_bridge_file join m_file_name using (fnid) where vid is not null and fname like '%/%') b)"


@query(f"""with {_STEPS_SQL}, x as (select dir, v.vid, v.i, v.nxt, v.i - row_number() over (partition by dir order by v.i) run from {_DIR_ROWS_SQL} s join v on v.vid = s.vid)
select dir, cast(min(vid) as int) vid_s, cast(coalesce(arg_max(coalesce(nxt, 1), i) - 1, 0) as int) vid_e, cast(0 as smallint) ftype, 'A' s_stat, case when arg_max(coalesce(nxt, -1), i) = -1 then '0' else 'D' end e_stat from x group by dir, run""")
def directory_history(spark, d):
    """File rows of directories: opened where they come, closed where they go, over all snapshots."""
    b = table(spark, d, "m_bridge_file").filter("vid is not null")
    steps = b.select("vid").distinct().select("vid", F.row_number().over(Window.orderBy("vid")).alias("i"), F.lead("vid").over(Window.orderBy("vid")).alias("nxt"))  # one row per version
    names = table(spark, d, "m_file_name")
    dirs = versions.ancestors(b.join(names, "fnid").select(F.concat_ws("/", "vid", "fname").alias("at")), "at").filter("dir like '%/%'")
    at = dirs.select(F.substring_index("dir", "/", 1).cast("int").alias("vid"), F.expr("substring(dir, instr(dir, '/') + 1)").alias("dir"))
    p = versions.presence(at, steps, "dir")
    return p.select("dir", "vid_s", "vid_e", F.lit(0).cast("short").alias("ftype"), F.lit("A").alias("s_stat"), F.when(F.col("vid_e") == 0, "0").otherwise("D").alias("e_stat"))


_OPS = "(select fid, max(s_stat) op from m_file group by fid)"
_PLACED = "select distinct b.fid, b.tag_id, t.code, b.line_s, b.char_s, b.line_e, b.char_e from m_bridge_tag b join m_tag t on b.tag_id = t.tag_id where t.vid_s {0} 8"
_MATCH_SQL = f"""q as (select * from ({_PLACED.format('<')}) where fid in (select fid from {_OPS} where op <> 'A')),
m as (select distinct fid, code, line_s, char_s, line_e, char_e from ({_PLACED.format('>=')}) where fid in (select fid from {_OPS} where op <> 'D')),
p as (select distinct fid, tag_id, code, row_number() over (partition by fid, code order by line_s, char_s, line_e, char_e nulls first, tag_id) occ from q where code <> ''),
n as (select *, row_number() over (partition by fid, code order by line_s, char_s, line_e, char_e nulls first) occ from m where code <> ''),
j as (select coalesce(n.fid, p.fid) fid, p.tag_id, coalesce(n.code, p.code) code, n.line_s, n.char_s, n.line_e, n.char_e, case when p.occ is null then 'OPEN' when n.occ is null then 'CLOSE' else 'RECYCLE' end op
  from n full join p on n.fid = p.fid and n.code = p.code and n.occ = p.occ
  union all select fid, null, code, line_s, char_s, line_e, char_e, 'OPEN' from m where code is null or code = ''
  union all select fid, tag_id, code, null, null, null, null, 'CLOSE' from q where code is null or code = ''),
o as (select (select max(tag_id) from m_tag) + row_number() over (order by fid nulls first, code nulls first, line_s nulls first, char_s nulls first, line_e nulls first, char_e nulls first) tag_id, fid, code, line_s, char_s, line_e, char_e from j where op = 'OPEN')"""


def _matched(spark, d):
    """Tags before version 8 against the nodes of the files from version 8 on, each file by its operation."""
    b, t, f = (table(spark, d, n) for n in ("m_bridge_tag", "m_tag", "m_file"))
    places = b.select("fid", "tag_id", "line_s", "char_s", "line_e", "char_e")
    prior, nodes = (places.join(t.filter(w).select("tag_id", "code"), "tag_id").distinct() for w in ("vid_s < 8", "vid_s >= 8"))
    order = ["line_s", "char_s", "line_e", "char_e"]
    prior, nodes = tags.by_operation(f.groupBy("fid").agg(F.max("s_stat").alias("op")), prior, nodes.select("fid", "code", *order).distinct(), "fid")
    prior = prior.select("fid", "tag_id", "code", *(F.col(c).alias(f"p_{c}") for c in order))
    return materialize(tags.match(prior, nodes, ["fid"], "code", [*(f"p_{c}" for c in order), "tag_id"], order), "matched"), t


_ORDER = ["fid", "code", "line_s", "char_s", "line_e", "char_e"]


def _opened(spark, d):
    matched, t = _matched(spark, d)
    top = t.agg(F.max("tag_id")).first()[0] or 0
    return tags.opened(matched, top + 1, 8, _ORDER), matched, t


@query(f"with {_MATCH_SQL} select * from j")
def tags_by_operation(spark, d):
    return _matched(spark, d)[0].select("fid", "tag_id", "code", "line_s", "char_s", "line_e", "char_e", "op")


@query(f"with {_MATCH_SQL} select tag_id, cast(8 as int) vid_s, cast(0 as int) vid_e, code from o")
def tags_opened(spark, d):
    """The tag rows a version writes: one for each node without a prior tag."""
    return _opened(spark, d)[0].filter("vid_s is not null").select("tag_id", "vid_s", "vid_e", "code")


@query(f"with {_MATCH_SQL} select fid, tag_id, line_s, line_e, char_s, char_e from o union all select fid, tag_id, line_s, line_e, char_s, char_e from j where op = 'RECYCLE'")
def tags_placed(spark, d):
    """The places a version writes: of new and of recycled tags."""
    return _opened(spark, d)[0].select("fid", "tag_id", "line_s", "line_e", "char_s", "char_e")


@query(f"with {_MATCH_SQL} select tag_id, tag_id map_id, cast(1 as int) line_s, cast(1 as int) char_s, cast(greatest(1, line_e - line_s + 1) as int) line_e, char_e from o")
def tags_mapped(spark, d):
    """The extents a version writes for new tags, moved to start at line 1, column 1; a map has the id of its tag."""
    new = _opened(spark, d)[0].filter("vid_s is not null")
    return new.select("tag_id", F.col("tag_id").alias("map_id"), F.lit(1).alias("line_s"), F.lit(1).alias("char_s"), extents.relative_height(F.col("line_s"), F.col("line_e")).alias("line_e"), "char_e")


@query(f"with {_MATCH_SQL} select t.tag_id, t.vid_s, cast(case when t.vid_e = 0 and t.tag_id in (select tag_id from j where op = 'CLOSE') then 7 else t.vid_e end as int) vid_e from (select distinct tag_id, vid_s, vid_e from m_tag where vid_s < 8) t")
def tags_closed(spark, d):
    """Prior tags after the match: those left over end before the version."""
    matched, t = _matched(spark, d)
    return tags.closed(t.filter("vid_s < 8").select("tag_id", "vid_s", "vid_e").distinct(), matched, 8)


# Reports ----------------------------------------------------------------------------------------------------------

@query("select event_id, case when value >= 1 then printf('%5.2fs', value) when value >= 0.01 then printf('%5.1fms', value * 1000) else printf('%5.2fms', value * 1000) end shown from (select event_id, floor(value) / 70 as value from events)")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", text.duration(F.floor("value") / 70).alias("shown"))


_STAGES = ("click", "error", "view")


@query("""with t as (select event_type stage, sum(value) s from events where event_type in ('click', 'error', 'view') group by 1)
select stage, round(s, 4) as seconds, round(s * 100 / sum(s) over (), 4) pct, case when s * 100 / sum(s) over () >= 50 then 'high' when s * 100 / sum(s) over () >= 25 then 'medium' else 'low' end as level from t""")
def stage_report(spark, d):
    """Seconds and shares of stages from a table with a column for each."""
    t = table(spark, d, "events").select(*(F.when(F.col("event_type") == s, F.col("value")).alias(s) for s in _STAGES))
    return report.stage_report(t, list(_STAGES)).select("stage", F.round("seconds", 4).alias("seconds"), F.round("pct", 4).alias("pct"), "level")


@query("select vid, '> ' || vname line, vname || ', a, b and c' listed from m_v_main")
def prefixed_lines(spark, d):
    lines = table(spark, d, "m_v_main").select("vid", "vname", text.prefixed(F.array("vname"), "> ").alias("p"))
    return lines.select("vid", F.col("p")[0].alias("line"), text.listed(F.array(F.col("vname"), F.lit("a"), F.lit("b"), F.lit("c"))).alias("listed"))
