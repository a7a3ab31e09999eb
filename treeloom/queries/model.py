"""Queries for the operators of the versioned model, each over whole tables, with the SQL of the same result for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import report, source_text, text
from treeloom.operators import browse, extents, select, staging, tags, versions
from treeloom.plans import joingraph
from treeloom.plans.joingraph import Join
from treeloom.runtime import materialize
from treeloom.sources.catalog import NODE_TYPES, table, table_counts, type_descriptor
from treeloom.sources.engines import debug_json
from treeloom.streaming.versions import VersionedTree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MODEL = ("m_v_main", "m_file_name", "m_file", "m_bridge_file", "m_ast", "m_ast_container", "m_ast_include", "m_tag", "m_bridge_tag", "m_map_ast")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Invented texts for what the documents lack: macros with arguments, conditions that nest, are open or stray, braces.
_INVENTED = (
    (-1, "#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#define F( x , g(y, z) ,...) x\n#define OPEN(a, b\n#define NONE() 1\n #  define S(a) #a\n#define PLAIN (1)"),
    (-2, "#ifdef A\nint x;\n#elif defined( B ) && C > 1 // c\n#if D\n#endif\n#else\n#endif\n#endif\n#if E\n#else\n#ifndef G\n#endif"),
    (-3, "int f(void) {\n  if (x) { y(); } }\n} struct s { int a; };\nenum e {"),
    (-4, "#ifdef CONFIG_A\n#ifdef\tCONFIG_B\n  #ifdef C\n#endif\n#elif"),
)
_DOCS_SQL = "(select doc_id, text from documents union all select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in _INVENTED) + ") t(doc_id, text))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_INVENTED, "doc_id long, text string"))


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# Scans, catalog ---------------------------------------------------------------------------------------------------

@query("select * from m_file")
def scan_table(spark, d):
    return table(spark, d, "m_file")


@query(" union all ".join(f"select '{t}' table_name, count(*) n from {t}" for t in _MODEL))
def count_tables(spark, d):
    return table_counts({t: table(spark, d, t) for t in _MODEL})


@query("select vid, vname from m_v_main order by vid")
def list_versions(spark, d):
    return table(spark, d, "m_v_main").select("vid", "vname").orderBy("vid")


@query("select * from (values " + ", ".join(f"(cast({i} as smallint), '{n}')" for i, n in enumerate(NODE_TYPES)) + ") t(type_id, name)")
def list_types(spark, d):
    return type_descriptor(spark).orderBy("type_id")


_ENDPOINTS = (
    ("/api/versions", "list_versions"), ("/api/type_descriptors", "list_types"), ("/api/version/{v}/browse/{path}", "browse_children"), ("/api/file/{fid}", "file_detail"),
    ("/api/tag/{id}", "tag_detail"), ("/api/ast/{id}/tree", "bounded_tree"), ("/api/dev/tables", "count_tables"), ("/api/dev/endpoints", "list_endpoints"),
)


@query("select * from (values " + ", ".join(f"('{r}', '{q}')" for r, q in _ENDPOINTS) + ") t(route, query)")
def list_endpoints(spark, d):
    return spark.createDataFrame(_ENDPOINTS, "route string, query string")


# Selection --------------------------------------------------------------------------------------------------------

@query("select * from m_ast where type_id = 41")
def wildcard_select(spark, d):
    return select.wildcard_select(table(spark, d, "m_ast"), (None, None, 41))


@query("select * from m_ast where type_id = 20 order by ast_id, name limit 1")
def select_first(spark, d):
    return select.select_first(table(spark, d, "m_ast"), (None, None, 20), ["ast_id"])


@query("select fnid, fname from m_file_name where fname like '%/%'")
def names_with_folder(spark, d):
    return table(spark, d, "m_file_name").filter(select.has_separator(F.col("fname")))


@query("select fnid, fname from m_file_name where starts_with(fname, 'include/')")
def names_below(spark, d):
    return table(spark, d, "m_file_name").filter(select.below(F.col("fname"), "include"))


@query("select t.* from m_tag t where t.ast_id in (select ast_id from m_ast where type_id = 20)")
def in_keys(spark, d):
    t, a = _tables(spark, d, "m_tag", "m_ast")
    return select.in_keys(t, "ast_id", a.filter("type_id = 20"), "ast_id")


@query("select distinct ast_id, priority, type_id, ref_ast_id from m_ast_container c where ast_id in (select ast_id from m_tag where ast_id is not null) or ref_ast_id in (select ast_id from m_tag where ast_id is not null)")
def either_endpoint(spark, d):
    c, t = _tables(spark, d, "m_ast_container", "m_tag")
    return select.either_endpoint(c, "ast_id", "ref_ast_id", t, "ast_id")


@query("select * from m_ast_container where ref_ast_id is not null and ref_ast_id <> 0")
def without_zero(spark, d):
    return select.without_zero(table(spark, d, "m_ast_container"), "ref_ast_id")


@query("select fnid, fname from m_file_name n where not exists (select 1 from m_bridge_file b where b.fnid = n.fnid)")
def names_without_file(spark, d):
    n, b = _tables(spark, d, "m_file_name", "m_bridge_file")
    return select.not_in_keys(n, "fnid", b, "fnid")


@query("select ast_id, case when type_id in (27, 28, 29) then 'struct' when type_id = 26 then 'pointer' when type_id in (46, 50, 51) then 'condition' else 'other' end family from m_ast")
def first_rule(spark, d):
    rules = [({27, 28, 29}, "struct"), (26, "pointer"), ({46, 50, 51}, "condition")]
    return table(spark, d, "m_ast").select("ast_id", select.first_rule(F.col("type_id"), rules, "other").alias("family"))


# Joins ------------------------------------------------------------------------------------------------------------

_FILE_JOINS = (Join("m_v_main", "vid", "m_bridge_file", "vid"), Join("m_bridge_file", "fnid", "m_file_name", "fnid"), Join("m_bridge_file", "fid", "m_file", "fid"))


def _file_view(spark, d, values=()):
    names = ("m_v_main", "m_bridge_file", "m_file_name", "m_file")
    return joingraph.view(dict(zip(names, _tables(spark, d, *names), strict=True)), "m_v_main", _FILE_JOINS, values)


_FILE_VIEW_SQL = """select v.vid A1_vid, v.vname A1_vname, b.vid A2_vid, b.fnid A2_fnid, b.fid A2_fid, n.fnid A3_fnid, n.fname A3_fname,
  f.fid A4_fid, f.vid_s A4_vid_s, f.vid_e A4_vid_e, f.ftype A4_ftype, f.s_stat A4_s_stat, f.e_stat A4_e_stat
from m_v_main v join m_bridge_file b on v.vid = b.vid join m_file_name n on b.fnid = n.fnid join m_file f on b.fid = f.fid"""


@query(_FILE_VIEW_SQL)
def view_chain(spark, d):
    return _file_view(spark, d)


@query(_FILE_VIEW_SQL + " where v.vname = 'w3.1' and f.ftype = 1 and f.s_stat = 'M'")
def view_select(spark, d):
    return _file_view(spark, d, (None, "w3.1", None, None, None, None, None, None, None, None, 1, "M"))


@query(_FILE_VIEW_SQL + " where f.ftype = 4 order by v.vid, v.vname, b.vid, b.fnid, b.fid limit 1")
def view_first(spark, d):
    names = ("m_v_main", "m_bridge_file", "m_file_name", "m_file")
    values = (None,) * 10 + (4,)
    return joingraph.view_first(dict(zip(names, _tables(spark, d, *names), strict=True)), "m_v_main", _FILE_JOINS, values, ["vid"])


@query("""select a.ast_id A1_ast_id, a.name A1_name, a.type_id A1_type_id, c.ast_id A2_ast_id, c.priority A2_priority, c.type_id A2_type_id, c.ref_ast_id A2_ref_ast_id,
  e.ast_id A3_ast_id, e.priority A3_priority, e.type_id A3_type_id, e.ref_ast_id A3_ref_ast_id
from m_ast a join m_ast_container c on a.ast_id = c.ast_id join m_ast_container e on a.ast_id = e.ast_id where c.priority = 0 and e.priority = 1 and e.type_id = 41""")
def view_repeat(spark, d):
    a, c = _tables(spark, d, "m_ast", "m_ast_container")
    values = (None, None, None, None, 0, None, None, None, 1, 41)
    return joingraph.view({"m_ast": a, "m_ast_container": c}, "m_ast", [Join("m_ast", "ast_id", "m_ast_container", "ast_id", repeat=2)], values)


@query("select ast_id from m_ast_container where ast_id is not null group by 1 having count(case when priority = 0 then 1 end) > 0 and count(case when priority = 1 and type_id = 41 then 1 end) > 0")
def view_division(spark, d):
    return joingraph.containing(table(spark, d, "m_ast_container"), "ast_id", [{"priority": 0}, {"priority": 1, "type_id": 41}])


_TYPE_SQL = "(select * from (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NODE_TYPES)) + ") t(type_id, name))"
_TAG_ROWS_SQL = f"""select b.fid, b.tag_id, b.line_s, b.line_e, b.char_s, b.char_e, t.vid_s, t.vid_e, t.code, t.ast_id, a.name ast_name, a.type_id, y.name type_name
from (select distinct * from m_bridge_tag) b join (select distinct tag_id, vid_s, vid_e, code, ast_id from m_tag) t on b.tag_id = t.tag_id
join (select distinct * from m_ast) a on t.ast_id = a.ast_id left join {_TYPE_SQL} y on a.type_id = y.type_id"""


@query(_TAG_ROWS_SQL)
def tag_rows(spark, d):
    b, t, a = _tables(spark, d, "m_bridge_tag", "m_tag", "m_ast")
    return browse.tag_rows(b, t, a, type_descriptor(spark)).drop("hl_s", "hl_l", "ast_raw")


@query(f"""select m.map_id, m.line_s, m.char_s, m.line_e, m.char_e, m.ast_id, a.name ast_name, a.type_id, y.name type_name
from (select distinct * from m_map_ast where map_id <> 0) m join (select distinct * from m_ast) a on m.ast_id = a.ast_id left join {_TYPE_SQL} y on a.type_id = y.type_id""")
def map_rows(spark, d):
    m, a = _tables(spark, d, "m_map_ast", "m_ast")
    return browse.map_rows(m, a, type_descriptor(spark))


@query(f"""select c.ast_id, c.priority, r.name relation, c.ref_ast_id, y.name node_type
from m_ast_container c left join {_TYPE_SQL} r on c.type_id = r.type_id left join m_ast a on c.ref_ast_id = a.ast_id left join {_TYPE_SQL} y on a.type_id = y.type_id""")
def double_dimension(spark, d):
    c, a = _tables(spark, d, "m_ast_container", "m_ast")
    t = type_descriptor(spark)
    rel = F.broadcast(t.select(F.col("type_id").alias("r_id"), F.col("name").alias("relation")))
    typ = F.broadcast(t.select(F.col("type_id").alias("y_id"), F.col("name").alias("node_type")))
    j = c.join(rel, c["type_id"] == F.col("r_id"), "left").join(a.select(F.col("ast_id").alias("a_id"), F.col("type_id").alias("a_type")), F.col("ref_ast_id") == F.col("a_id"), "left")
    return j.join(typ, F.col("a_type") == F.col("y_id"), "left").select("ast_id", "priority", "relation", "ref_ast_id", "node_type")


# Staging ----------------------------------------------------------------------------------------------------------

@query("select coalesce(max(ast_id), 0) + 1 next_id from m_ast")
def next_id(spark, d):
    return staging.next_id(table(spark, d, "m_ast"), "ast_id")



@query("""with u as (select key_id tag_id, vid vid_s, code, ast_id, row_number() over (partition by key_id, vid order by arrived_at desc nulls last, upd_id desc nulls last) rn
  from raw_update where kind = 'tag' and vid is not null and stat <> 'D'),
b as (select distinct tag_id, vid_s, code, ast_id from m_tag)
select tag_id, vid_s, code, ast_id from u where rn = 1 union all select * from b where not exists (select 1 from u where u.tag_id = b.tag_id and u.vid_s = b.vid_s)""")
def upsert(spark, d):
    t, r = _tables(spark, d, "m_tag", "raw_update")
    u = r.filter("kind = 'tag' and vid is not null and stat <> 'D'").select(F.col("key_id").alias("tag_id"), F.col("vid").alias("vid_s"), "arrived_at", "upd_id", "code", "ast_id")
    u = staging.last_wins(u, ["tag_id", "vid_s"], ["arrived_at", "upd_id"]).select("tag_id", "vid_s", "code", "ast_id")
    return staging.upsert(t.select("tag_id", "vid_s", "code", "ast_id").distinct(), u, ["tag_id", "vid_s"])


@query("""with u as (select key_id, vid, code, ast_id, row_number() over (partition by key_id, vid order by arrived_at desc nulls last, upd_id desc nulls last) rn
  from raw_update where kind = 'tag' and vid is not null)
select b.tag_id, b.vid_s, coalesce(u.code, b.code) code, coalesce(u.ast_id, b.ast_id) ast_id
from (select distinct tag_id, vid_s, code, ast_id from m_tag) b left join u on u.rn = 1 and u.key_id = b.tag_id and u.vid = b.vid_s""")
def patch(spark, d):
    t, r = _tables(spark, d, "m_tag", "raw_update")
    u = r.filter("kind = 'tag' and vid is not null").select(F.col("key_id").alias("tag_id"), F.col("vid").alias("vid_s"), "arrived_at", "upd_id", "code", "ast_id")
    u = staging.last_wins(u, ["tag_id", "vid_s"], ["arrived_at", "upd_id"]).select("tag_id", "vid_s", "code", "ast_id")
    return staging.patch(t.select("tag_id", "vid_s", "code", "ast_id").distinct(), u, ["tag_id", "vid_s"])


@query("select 100 + row_number() over (order by name nulls first, type_id nulls first) id, name, type_id from (select distinct name, type_id from m_ast)")
def dedup_assign_ids(spark, d):
    return staging.assign_ids(table(spark, d, "m_ast"), ["name", "type_id"], "id", 101).select("id", "name", "type_id")


@query("""with dim as (select fname, fnid from m_file_name), new as (select distinct concat('moved/', fname) fname from m_file_name where fname <> ''
  union select fname from m_file_name),
n as (select fname, row_number() over (order by fname) k from new where fname not in (select fname from dim))
select fname, fnid, 'DONE' op from dim union all select fname, (select max(fnid) from dim) + k, 'SET' from n""")
def get_or_create(spark, d):
    dim = table(spark, d, "m_file_name").select("fname", "fnid")
    wanted = dim.filter("fname <> ''").select(F.concat(F.lit("moved/"), "fname").alias("fname")).unionByName(dim.select("fname"))
    return staging.get_or_create(dim, wanted, "fname", "fnid")


_SIG_SQL = """select ast_id, string_agg(concat(coalesce(cast(priority as varchar), ''), ':', coalesce(cast(type_id as varchar), ''), ':', coalesce(cast(ref_ast_id as varchar), '')), '|'
  order by priority nulls first, type_id nulls first, ref_ast_id nulls first) sig, count(*) k from (select distinct * from m_ast_container) group by 1"""


@query(f"select k, count(*) n, min(ast_id) rep from ({_SIG_SQL}) group by sig, k")
def structural_signature(spark, d):
    c = table(spark, d, "m_ast_container").distinct()
    return staging.same_structure(staging.signature(c, "ast_id", ["priority", "type_id", "ref_ast_id"]), "ast_id")


_FLAT_SQL = "(select distinct c.ast_id, c.priority, c.type_id, c.ref_ast_id from m_ast_container c)"


@query(f"""select i.new_id, cast(row_number() over (partition by s.ast_id order by s.priority nulls first, s.type_id nulls first, s.ref_ast_id nulls first) - 1 as int) priority, s.type_id, s.ref_ast_id
from {_FLAT_SQL} s join (select ast_id, row_number() over (order by ast_id) new_id from (select distinct ast_id from m_ast_container)) i on s.ast_id = i.ast_id""")
def view_decompose(spark, d):
    c = table(spark, d, "m_ast_container").withColumnRenamed("priority", "old")
    _, kids = staging.decompose(c, ["ast_id"], {}, {"type_id": F.col("type_id"), "ref_ast_id": F.col("ref_ast_id")}, ["old", "type_id", "ref_ast_id"])
    return kids


@query(f"select ast_id, type_id, ref_ast_id, cast(row_number() over (partition by ast_id order by priority nulls first, type_id nulls first, ref_ast_id nulls first) as int) rank from {_FLAT_SQL}")
def rank_children(spark, d):
    c = table(spark, d, "m_ast_container").distinct()
    return staging.rank_children(c, "ast_id", ["priority", "type_id", "ref_ast_id"], 1, "rank").select("ast_id", "type_id", "ref_ast_id", "rank")


@query("""with ids as (select name, row_number() over (order by name) nid from (select distinct name from m_ast where name is not null))
select a.ast_id, i.nid from m_ast a left join ids i on a.name = i.name""")
def ref_resolution(spark, d):
    a = table(spark, d, "m_ast")
    ids = staging.assign_ids(a.filter("name is not null"), ["name"], "nid", 1)
    return staging.resolve(a.select("ast_id", "name"), "name", ids, "name", "nid").select("ast_id", "nid")


@query("select * from m_tag where ast_id is not null and ast_id <> 0 and ast_id not in (select ast_id from m_ast)")
def fk_violations(spark, d):
    t, a = _tables(spark, d, "m_tag", "m_ast")
    return staging.missing_parents(t, "ast_id", a, "ast_id")


@query("select tag_id, vid_s, count(*) n from m_tag group by 1, 2 having count(*) > 1")
def pk_violations(spark, d):
    return staging.repeated_keys(table(spark, d, "m_tag"), ["tag_id", "vid_s"])


# Versions ---------------------------------------------------------------------------------------------------------

def _snap(spark, d, vid):
    return table(spark, d, "m_bridge_file").filter((F.col("vid") == vid) & F.col("fnid").isNotNull()).groupBy("fnid").agg(F.max("fid").alias("fid"))


_SNAPS = "o as (select fnid, max(fid) fid from m_bridge_file where vid = 7 and fnid is not null group by 1), n as (select fnid, max(fid) fid from m_bridge_file where vid = 8 and fnid is not null group by 1)"


@query(f"with {_SNAPS} select coalesce(n.fnid, o.fnid) fnid, case when o.fnid is null then 'A' when n.fnid is null then 'D' when o.fid is distinct from n.fid then 'M' else '=' end op from o full join n on o.fnid = n.fnid")
def diff_classify(spark, d):
    return versions.classify(_snap(spark, d, 7), _snap(spark, d, 8), "fnid", "fid")


@query(f"with {_SNAPS} select o.fnid from o join n on o.fnid = n.fnid and o.fid is not distinct from n.fid")
def unchanged_propagate(spark, d):
    return versions.unchanged(_snap(spark, d, 7), _snap(spark, d, 8), "fnid", "fid")


_REPORTED = "select distinct key_id fnid from raw_update where kind = 'file' and stat = 'D'"


@query(f"with {_SNAPS}, r as ({_REPORTED}) select fnid from o where fnid not in (select fnid from n) and fnid not in (select fnid from r)")
def forgotten_deletes(spark, d):
    reported = table(spark, d, "raw_update").filter("kind = 'file' and stat = 'D'").select(F.col("key_id").alias("fnid"))
    return versions.forgotten(_snap(spark, d, 7), _snap(spark, d, 8), reported, "fnid")


@query("with " + _SNAPS + ", r as (select distinct key_id fnid from raw_update where kind = 'file' and stat = 'A') select fnid from n where fnid not in (select fnid from o) and fnid not in (select fnid from r)")
def forgotten_news(spark, d):
    reported = table(spark, d, "raw_update").filter("kind = 'file' and stat = 'A'").select(F.col("key_id").alias("fnid"))
    return versions.forgotten(_snap(spark, d, 8), _snap(spark, d, 7), reported, "fnid")


_TEXT_AT = "select {0} pair, doc_id, md5(text) c from documents where vid is not null and text is not null"


@query(f"""with o as ({_TEXT_AT.format('vid + 1')}), n as ({_TEXT_AT.format('vid')})
select min(o.pair || '/' || o.doc_id) old_key, n.pair || '/' || n.doc_id new_key from o join n on o.pair = n.pair and o.c = n.c group by n.pair, n.doc_id""")
def rename_detect(spark, d):
    """Texts of one version that come back in the next under another id."""
    docs = table(spark, d, "documents").filter("vid is not null and text is not null")

    def side(pair):
        return docs.select(F.concat_ws("/", pair, "doc_id").alias("k"), F.concat_ws("/", pair, F.md5("text")).alias("c"))

    old, new = side(F.col("vid") + 1), side(F.col("vid"))
    # Both sides use the same keys where a pair's document stays; here an id has one version, so none stays.
    return versions.renames(old, new, "k", "c")


@query(f"""with {_SNAPS}
select o.fnid, 7 vid_s, case when n.fnid is null or n.fid <> o.fid then 7 else 0 end vid_e, 'A' s_stat, case when n.fnid is null then 'D' when n.fid <> o.fid then 'M' else '0' end e_stat from o left join n on o.fnid = n.fnid
union all select n.fnid, 8, 0, case when o.fnid is null then 'A' else 'M' end, '0' from n left join o on o.fnid = n.fnid where o.fnid is null or n.fid <> o.fid""")
def scd2_close_open(spark, d):
    active = _snap(spark, d, 7).select("fnid", "fid", F.lit(7).alias("vid_s"), F.lit(0).alias("vid_e"), F.lit("A").alias("s_stat"), F.lit("0").alias("e_stat"))
    return versions.close_open(active, _snap(spark, d, 8), "fnid", "fid", 8)


@query("select distinct fid, vid_s, vid_e from m_file where vid_s <= 9 and (vid_e = 0 or vid_e >= 9)")
def scd2_asof(spark, d):
    return versions.valid_at(table(spark, d, "m_file"), 9).select("fid", "vid_s", "vid_e").distinct()


_DIRS = """select distinct array_to_string(list_slice(string_split(fname, '/'), 1, i), '/') dir from (select fname, unnest(range(1, len(string_split(fname, '/')))) i from m_file_name n join {0} using (fnid) where fname like '%/%')"""


@query(f"with {_SNAPS}, a as ({_DIRS.format('o')}), b as ({_DIRS.format('n')}) select coalesce(b.dir, a.dir) dir, case when a.dir is null then 'A' when b.dir is null then 'D' else '=' end op from a full join b on a.dir = b.dir")
def directory_changes(spark, d):
    names = table(spark, d, "m_file_name")
    old, new = (_snap(spark, d, v).join(names, "fnid").select("fname") for v in (7, 8))
    return versions.directory_changes(old, new, "fname")


# The same over all delivered snapshots: vid is the later one of each two that follow each other -----------------------

def _transitions(spark, d):
    """(old, new): per snapshot but the first, the paths before and at vid, as (k = (vid, fnid), vid, fnid, fid); and (vid, old)."""
    b = table(spark, d, "m_bridge_file").filter("vid is not null and fnid is not null")
    snaps = b.groupBy("vid", "fnid").agg(F.max("fid").alias("fid"))
    # One row per version: the window holds no more.
    steps = table(spark, d, "m_bridge_file").filter("vid is not null").select("vid").distinct().withColumn("old", F.lag("vid").over(Window.orderBy("vid"))).filter("old is not null")
    k = F.struct("vid", "fnid").alias("k")
    old = snaps.withColumnRenamed("vid", "old").join(F.broadcast(steps), "old").select(k, "vid", "fnid", "fid")
    new = snaps.join(F.broadcast(steps), "vid").select(k, "vid", "fnid", "fid")
    return old, new, steps


_ALL_SNAPS = """s as (select vid, fnid, max(fid) fid from m_bridge_file where vid is not null and fnid is not null group by 1, 2),
v as (select vid, old from (select vid, lag(vid) over (order by vid) old from (select distinct vid from m_bridge_file where vid is not null)) where old is not null),
o as (select v.vid, s.fnid, s.fid from v join s on s.vid = v.old), n as (select v.vid, s.fnid, s.fid from v join s on s.vid = v.vid)"""


@query(f"""with {_ALL_SNAPS} select coalesce(n.vid, o.vid) vid, coalesce(n.fnid, o.fnid) fnid, case when o.fnid is null then 'A' when n.fnid is null then 'D' when o.fid is distinct from n.fid then 'M' else '=' end op
from o full join n on o.vid = n.vid and o.fnid = n.fnid""")
def diff_classify_all(spark, d):
    old, new, _ = _transitions(spark, d)
    return versions.classify(old, new, "k", "fid").select("k.vid", "k.fnid", "op")


@query(f"with {_ALL_SNAPS} select o.vid, o.fnid from o join n on o.vid = n.vid and o.fnid = n.fnid and o.fid is not distinct from n.fid")
def unchanged_propagate_all(spark, d):
    old, new, _ = _transitions(spark, d)
    return versions.unchanged(old.select("k", "fid"), new.select(F.col("k").alias("k2"), "fid").withColumnRenamed("k2", "k"), "k", "fid").select("k.vid", "k.fnid")


def _reported_by(spark, d, stat, steps):
    """Reports of a kind by the snapshot they belong to: the first delivered one at or after their version."""
    r = table(spark, d, "raw_update").filter((F.col("kind") == "file") & (F.col("stat") == stat)).select(F.col("vid").alias("at"), F.col("key_id").alias("fnid"))
    return r.join(F.broadcast(steps), (F.col("at") > F.col("old")) & (F.col("at") <= F.col("vid"))).select(F.struct("vid", "fnid").alias("k")).distinct()


_REPORTED_AT = "select v.vid, r.key_id fnid from raw_update r join v on r.vid > v.old and r.vid <= v.vid where r.kind = 'file' and r.stat = '{0}'"


@query(f"""with {_ALL_SNAPS}, r as ({_REPORTED_AT.format('D')}) select vid, fnid from o
where not exists (select 1 from n where n.vid = o.vid and n.fnid = o.fnid) and not exists (select 1 from r where r.vid = o.vid and r.fnid = o.fnid)""")
def forgotten_deletes_all(spark, d):
    old, new, steps = _transitions(spark, d)
    return versions.forgotten(old, new, _reported_by(spark, d, "D", steps), "k").select("k.vid", "k.fnid")


@query(f"""with {_ALL_SNAPS}, r as ({_REPORTED_AT.format('A')}) select vid, fnid from n
where not exists (select 1 from o where o.vid = n.vid and o.fnid = n.fnid) and not exists (select 1 from r where r.vid = n.vid and r.fnid = n.fnid)""")
def forgotten_news_all(spark, d):
    old, new, steps = _transitions(spark, d)
    return versions.forgotten(new, old, _reported_by(spark, d, "A", steps), "k").select("k.vid", "k.fnid")


def _snapshots(spark, d):
    """The delivered vids in order, and (vid, fnid, fid) of all."""
    b = table(spark, d, "m_bridge_file").filter("vid is not null")
    vids = sorted(r[0] for r in b.select("vid").distinct().collect())  # one row per version
    return vids, materialize(b.filter("fnid is not null").groupBy("vid", "fnid").agg(F.max("fid").alias("fid")), "snapshots")


@query("""with s as (select vid, fnid, max(fid) fid from m_bridge_file where vid is not null and fnid is not null group by 1, 2),
v as (select vid, row_number() over (order by vid) i, lead(vid) over (order by vid) nxt from (select distinct vid from m_bridge_file where vid is not null)),
x as (select s.*, v.i, v.nxt, lag(v.i) over w pi, lag(s.fid) over w pf, lead(v.i) over w ni from s join v on s.vid = v.vid window w as (partition by fnid order by v.i)),
y as (select *, case when pi is null or pi <> i - 1 then 'A' when pf is distinct from fid then 'M' end st from x),
z as (select *, count(st) over (partition by fnid order by i) g from y)
select fnid, max(fid) fid, min(vid) vid_s, cast(coalesce(arg_max(coalesce(nxt, 1), i) - 1, 0) as int) vid_e, max(st) s_stat,
  case when arg_max(coalesce(nxt, -1), i) = -1 then '0' when arg_max(coalesce(ni, -1), i) = max(i) + 1 then 'M' else 'D' end e_stat from z group by fnid, g""")
def scd2_history(spark, d):
    """Validity rows of every path over all snapshots: each closes and opens rows; before the first there is none."""
    vids, snaps = _snapshots(spark, d)
    closed, active = [], spark.createDataFrame([], "fnid long, fid long, vid_s int, vid_e int, s_stat string, e_stat string")
    for vid in vids:
        new = snaps.filter(F.col("vid") == vid).select("fnid", "fid")
        # close_open names keys, not contents: an open row has the content of the new snapshot, a closed one that of the old.
        rows = versions.close_open(active, new, "fnid", "fid", vid)
        was = active.select("fnid", "vid_s", F.col("fid").alias("was"))
        rows = rows.join(was, ["fnid", "vid_s"], "left").join(new.withColumnRenamed("fid", "now"), "fnid", "left")
        rows = materialize(rows.select("fnid", F.when((F.col("vid_s") == vid), F.col("now")).otherwise(F.col("was")).alias("fid"), "vid_s", "vid_e", "s_stat", "e_stat"), "scd2")
        closed.append(rows.filter("e_stat <> '0'"))
        active = rows.filter("e_stat = '0'")
    for c in closed:
        active = active.unionByName(c)
    return active


@query()
def tree_history(spark, d):
    """Every snapshot applied to the versioned tree, renames included; a path is its fnid, its content the fid of the snapshot."""
    vids, snaps = _snapshots(spark, d)
    kinds = table(spark, d, "m_file").groupBy("fid").agg(F.max("ftype").cast("smallint").alias("ftype"))
    snaps = materialize(snaps.join(kinds, "fid", "left").select("vid", F.col("fnid").cast("string").alias("path"), F.col("fid").cast("string").alias("content"), "ftype"), "kinds")
    tree = VersionedTree(spark)
    tree.last = min(vids, default=1) - 1
    for vid in vids:
        tree.add(snaps.filter(F.col("vid") == vid), vid)
    return tree.files.select("fid", F.col("path").cast("long").alias("fnid"), F.col("content").cast("long").alias("content"), "vid_s", "vid_e", "ftype", "s_stat", "e_stat")


_ALL_DIRS = """select distinct vid, array_to_string(list_slice(string_split(fname, '/'), 1, i), '/') dir from (select vid, fname, unnest(range(1, len(string_split(fname, '/')))) i from m_file_name join {0} using (fnid) where fname like '%/%')"""


@query(f"with {_ALL_SNAPS}, a as ({_ALL_DIRS.format('o')}), b as ({_ALL_DIRS.format('n')}) select coalesce(b.vid, a.vid) vid, coalesce(b.dir, a.dir) dir, case when a.dir is null then 'A' when b.dir is null then 'D' else '=' end op from a full join b on a.vid = b.vid and a.dir = b.dir")
def directory_changes_all(spark, d):
    old, new, _ = _transitions(spark, d)
    names = table(spark, d, "m_file_name")
    # The vid goes before the path as a directory of its own and is taken off again.
    sides = [x.join(names, "fnid").select(F.concat_ws("/", "vid", "fname").alias("at")) for x in (old, new)]
    at = F.instr("dir", "/")
    return versions.directory_changes(*sides, "at").filter(at > 0).select(F.substring_index("dir", "/", 1).cast("int").alias("vid"), F.expr("substring(dir, instr(dir, '/') + 1)").alias("dir"), "op")


# Tags -------------------------------------------------------------------------------------------------------------

_NODES = "select distinct b.fid, b.tag_id, t.code, b.line_s, b.char_s from m_bridge_tag b join m_tag t on b.tag_id = t.tag_id where t.vid_s {0} 8"


def _nodes(spark, d, where):
    b, t = _tables(spark, d, "m_bridge_tag", "m_tag")
    return b.select("fid", "tag_id", "line_s", "char_s").join(t.filter(where).select("tag_id", "code"), "tag_id").distinct()


@query(f"""with p as (select *, row_number() over (partition by fid, code order by line_s, char_s, tag_id) occ from ({_NODES.format('<')})),
n as (select *, row_number() over (partition by fid, code order by line_s, char_s) occ from (select distinct fid, code, line_s, char_s from ({_NODES.format('>=')})))
select coalesce(n.fid, p.fid) fid, p.tag_id, coalesce(n.code, p.code) code, n.line_s, n.char_s, case when p.occ is null then 'OPEN' when n.occ is null then 'CLOSE' else 'RECYCLE' end op
from n full join p on n.fid = p.fid and n.code = p.code and n.code <> '' and n.occ = p.occ""")
def tag_recycle(spark, d):
    prior = _nodes(spark, d, "vid_s < 8").withColumnRenamed("line_s", "pl").withColumnRenamed("char_s", "pc")
    nodes = _nodes(spark, d, "vid_s >= 8").select("fid", "code", "line_s", "char_s").distinct()
    return tags.match(prior, nodes, ["fid"], "code", ["pl", "pc", "tag_id"], ["line_s", "char_s"])


@query("""select f.fnid, f.fid, b.tag_id, b.line_s, b.line_e, b.char_s, b.char_e, t.vid_s, t.vid_e, t.code, t.ast_id
from (select distinct fnid, fid from m_bridge_file where vid = 8 and fnid is not null) f join (select distinct * from m_bridge_tag) b on f.fid = b.fid join (select distinct tag_id, vid_s, vid_e, code, ast_id from m_tag) t on b.tag_id = t.tag_id""")
def prior_tags(spark, d):
    return tags.prior_tags(*_tables(spark, d, "m_bridge_file", "m_bridge_tag", "m_tag"), 8).select("fnid", "fid", "tag_id", "line_s", "line_e", "char_s", "char_e", "vid_s", "vid_e", "code", "ast_id")


# Browsing ---------------------------------------------------------------------------------------------------------

_AT_SQL = "(select distinct v.vid, v.vname, n.fnid, n.fname, f.fid, f.vid_s, f.vid_e, f.ftype, f.s_stat, f.e_stat from m_v_main v join m_bridge_file b on v.vid = b.vid join m_file_name n on b.fnid = n.fnid join m_file f on b.fid = f.fid)"


def _at(spark, d, version=None):
    return browse.files_at(*_tables(spark, d, "m_v_main", "m_bridge_file", "m_file_name", "m_file"), version)


@query(f"select * from {_AT_SQL}")
def files_at(spark, d):
    return _at(spark, d)


@query(f"select distinct split_part(fname, '/', 1) as name from {_AT_SQL} where vname = 'w3.1' and fname like '%/%'")
def browse_root(spark, d):
    return browse.sub_directories(_at(spark, d, "w3.1"), "fname")


@query(f"select distinct split_part(substring(fname, 9), '/', 1) as name from {_AT_SQL} where vname = 'w3.1' and fname like 'include/%/%'")
def browse_children(spark, d):
    return browse.sub_directories(_at(spark, d, "w3.1"), "fname", "include")


@query(f"select fname as name, fnid, fid, ftype from {_AT_SQL} where vname = 'w3.1' and fname not like '%/%' and fname not in (select split_part(fname, '/', 1) from {_AT_SQL} where vname = 'w3.1' and fname like '%/%')")
def browse_files(spark, d):
    return browse.files_below(_at(spark, d, "w3.1"), "fname").select("name", "fnid", "fid", "ftype")


@query(f"select 'include' path, count(case when ftype is null or ftype <> 0 then 1 end) > 0 is_file from {_AT_SQL} where vname = 'w3.1' and fname = 'include'")
def path_resolve(spark, d):
    return browse.kind_of(_at(spark, d, "w3.1"), "fname", "ftype", "include")


@query(f"""select r.fid, r.tag_id, r.line_s, r.char_s, r.vid_s, r.code, r.ast_name, r.type_name, cast(coalesce(m.k, 0) as bigint) maps
from ({_TAG_ROWS_SQL}) r left join (select map_id, count(*) k from (select distinct * from m_map_ast where map_id <> 0) m join (select distinct ast_id, name, type_id from m_ast) a on m.ast_id = a.ast_id group by 1) m on r.tag_id = m.map_id where r.fid = 7""")
def file_detail(spark, d):
    b, t, m, a = _tables(spark, d, "m_bridge_tag", "m_tag", "m_map_ast", "m_ast")
    one = browse.file_detail(7, b, t, m, a, type_descriptor(spark))
    return one.select("fid", "tag_id", "line_s", "char_s", "vid_s", "code", "ast_name", "type_name", F.size("maps").cast("long").alias("maps"))


@query(f"""select t.tag_id, t.vid_s, t.vid_e, t.code, t.ast_id, b.fid, b.line_s, b.line_e, b.char_s, b.char_e, a.name ast_name, a.type_id, y.name type_name
from (select distinct tag_id, vid_s, vid_e, code, ast_id from m_tag where tag_id = 1500) t left join (select distinct * from m_bridge_tag) b on b.tag_id = t.tag_id
join (select distinct * from m_ast) a on t.ast_id = a.ast_id left join {_TYPE_SQL} y on a.type_id = y.type_id order by vid_s nulls first, fid nulls first, line_s nulls first, char_s nulls first limit 1""")
def tag_detail(spark, d):
    b, t, a = _tables(spark, d, "m_bridge_tag", "m_tag", "m_ast")
    return browse.tag_detail(1500, b, t, a, type_descriptor(spark)).select("tag_id", "vid_s", "vid_e", "code", "ast_id", "fid", "line_s", "line_e", "char_s", "char_e", "ast_name", "type_id", "type_name")


_FILE_EDGES = """select distinct i.fid, c.ast_id p, c.ref_ast_id c from (select distinct b.fid, t.ast_id from m_bridge_tag b join m_tag t on b.tag_id = t.tag_id where t.ast_id <> 0 and b.fid is not null) i
join m_ast_container c on (i.ast_id = c.ast_id or i.ast_id = c.ref_ast_id) where c.ref_ast_id <> 0 and c.ast_id <> 0"""


@query(f"""with recursive e as ({_FILE_EDGES}),
heads as (select distinct fid, p from e), roots as (select fid, p from heads h where not exists (select 1 from e where e.fid = h.fid and e.c = h.p)),
start as (select * from roots union select * from heads h where not exists (select 1 from roots r where r.fid = h.fid)),
w(fid, node, depth) as (select fid, p, 0 from start union select w.fid, e.c, w.depth + 1 from w join e on e.fid = w.fid and e.p = w.node where w.depth < 400),
n as (select fid, p node from e union select fid, c from e)
select n.fid, n.node, min(w.depth) depth from n left join w on n.fid = w.fid and n.node = w.node group by 1, 2""")
def container_depth(spark, d):
    b, t, c = _tables(spark, d, "m_bridge_tag", "m_tag", "m_ast_container")
    ids = b.select("fid", "tag_id").distinct().join(select.without_zero(t, "ast_id").select("tag_id", F.col("ast_id").alias("id")).distinct(), "tag_id").select("fid", "id").distinct()
    e = c.select(F.col("ast_id").alias("p"), F.col("ref_ast_id").alias("c")).distinct()
    edges = ids.join(e, F.col("id") == F.col("p")).select("fid", "p", "c").unionByName(ids.join(e, F.col("id") == F.col("c")).select("fid", "p", "c"))
    return browse.container_depths(edges, "fid", "p", "c")


@query(f"""with recursive e as (select distinct ast_id p, priority, type_id rel, ref_ast_id c from m_ast_container where ref_ast_id <> 0 and ref_ast_id in (select ast_id from m_ast) and ast_id in (select ast_id from m_ast)),
w(root, path, node, depth, priority, rel, seen, again) as (
  select ast_id, '', ast_id, 0, cast(null as int), cast(null as smallint), [ast_id], false from (select distinct ast_id from m_ast_container where ast_id is not null union select -1)
  union all select w.root, case when w.path = '' then '' else w.path || '.' end || coalesce(cast(e.priority as varchar), ''), e.c, w.depth + 1, e.priority, e.rel, list_append(w.seen, e.c), list_contains(w.seen, e.c)
  from w join e on w.node = e.p where not w.again and w.depth < 3)
select w.root, w.path, w.node, w.depth, w.priority, r.name relation, case when a.ast_id is null then 'Unknown' else a.name end as name, cast(case when a.ast_id is null then 0 else a.type_id end as smallint) type_id, y.name type_name,
  case when a.name is not null and a.type_id is not null then json_object('ast_id', a.ast_id, 'name', a.name, 'type_id', a.type_id)::varchar end ast_raw
from w left join (select distinct * from m_ast) a on w.node = a.ast_id left join {_TYPE_SQL} y on case when a.ast_id is null then 0 else a.type_id end = y.type_id left join {_TYPE_SQL} r on w.rel = r.type_id""")
def bounded_tree(spark, d):
    """The trees below every container, to three levels; one invented root is missing."""
    c, a = _tables(spark, d, "m_ast_container", "m_ast")
    roots = c.select(F.col("ast_id").alias("node")).filter("node is not null").unionAll(spark.createDataFrame([(-1,)], "node long")).distinct()
    debug = debug_json(a.filter("name is not null and type_id is not null").select("ast_id", "name", "type_id").distinct(), "ast_id")
    return browse.bounded_tree(roots, c, a, type_descriptor(spark), 3, debug)


# Extents ----------------------------------------------------------------------------------------------------------

@query("""with m as (select distinct map_id, line_s, char_s, line_e, char_e from m_map_ast where map_id <> 0 and line_e >= line_s)
select a.map_id, a.line_s a_line_s, a.char_s a_char_s, a.line_e a_line_e, a.char_e a_char_e, b.line_s b_line_s, b.char_s b_char_s, b.line_e b_line_e, b.char_e b_char_e
from m a join m b on a.map_id = b.map_id and (a.line_s, a.char_s, a.line_e, a.char_e) <> (b.line_s, b.char_s, b.line_e, b.char_e)
where (a.line_s < b.line_s or (a.line_s = b.line_s and a.char_s <= b.char_s)) and (b.line_e < a.line_e or (b.line_e = a.line_e and b.char_e <= a.char_e))""")
def extent_contains(spark, d):
    return extents.containing_pairs(table(spark, d, "m_map_ast").filter("map_id <> 0"), "map_id")


@query("""
select map_id, max(case when s = 1 then line_s end) line_s, max(case when s = 1 then char_s end) char_s, max(case when e = 1 then line_e end) line_e, max(case when e = 1 then char_e end) char_e
from (select *, row_number() over (partition by map_id order by line_s nulls first, char_s nulls first) s, row_number() over (partition by map_id order by line_e desc nulls last, char_e desc nulls last) e from m_map_ast) group by 1""")
def extent_hull(spark, d):
    h = table(spark, d, "m_map_ast").groupBy("map_id").agg(*extents.hull())
    return h.select("map_id", F.col("s.line").alias("line_s"), F.col("s.char").alias("char_s"), F.col("e.line").alias("line_e"), F.col("e.char").alias("char_e"))


@query("select map_id, ast_id, cast(greatest(1, line_e - line_s + 1) as int) height from m_map_ast where line_e is not null")
def extent_relative(spark, d):
    return table(spark, d, "m_map_ast").filter("line_e is not null").select("map_id", "ast_id", extents.relative_height(F.col("line_s"), F.col("line_e")).alias("height"))


@query("select fid, line_s, count(*) n, min(tag_id) first_tag from (select distinct * from m_bridge_tag) group by 1, 2")
def extents_by_line(spark, d):
    return table(spark, d, "m_bridge_tag").distinct().groupBy("fid", "line_s").agg(F.count(F.lit(1)).alias("n"), F.min("tag_id").alias("first_tag"))


@query("""select map_id, line_s, char_s, case when 5 < line_s or (5 = line_s and 10 < char_s) then line_s else 5 end line_e, case when 5 < line_s or (5 = line_s and 10 < char_s) then char_s else 10 end char_e from m_map_ast""")
def extent_new_end(spark, d):
    return table(spark, d, "m_map_ast").select("map_id", "line_s", "char_s", *extents.with_end(F.lit(5), F.lit(10)))


# Text -------------------------------------------------------------------------------------------------------------

_LINES = r"regexp_split_to_array(text, '\r\n|\n|\r')"
_LINE_ROWS = f"(select doc_id, i as line, l[i] code from (select doc_id, {_LINES} l, unnest(range(1, len({_LINES}) + 1)) i from {_DOCS_SQL} where text is not null))"


@query(f"select doc_id, cast(line as int) line, code from {_LINE_ROWS}")
def line_explode(spark, d):
    return source_text.source_lines(_docs(spark, d), "doc_id", "text")


@query(f"""with l as (select doc_id, text, {_LINES} l, 1 + doc_id % 3 ls, doc_id % 5 cs, 1 + doc_id % 3 + doc_id % 2 le, doc_id % 7 ce from documents),
g as (select *, l[ls:le] got from l),
c as (select *, list_transform(got, lambda x, i: case when i = len(got) and len(got) = le - ls + 1 and ce > 0 then substring(x, 1, greatest(ce - 1, 0)) else x end) cut from g)
select doc_id, case when text is null then null else coalesce(array_to_string(list_transform(cut, lambda x, i: case when i = 1 and cs > 1 then substring(x, cs) else x end), chr(10)), '') end slice from c""")
def line_slice(spark, d):
    """An extent of each document that depends on its id: start and end columns from 0 (whole line) on, one or two lines."""
    k = F.col("doc_id")
    at = [(1 + k % 3).cast("int"), (k % 5).cast("int"), (1 + k % 3 + k % 2).cast("int"), (k % 7).cast("int")]
    return table(spark, d, "documents").select("doc_id", extents.slice_text(F.col("text"), *at).alias("slice"))


@query("select fnid, cast(case when fname like '%.c' or fname like '%.h' then 1 when fname like '%.S' or fname like '%.s' then 4 when fname like '%Kconfig' then 2 when fname like '%.rs' then 3 end as smallint) ftype from m_file_name")
def classify_ftype(spark, d):
    return table(spark, d, "m_file_name").select("fnid", text.file_type(F.col("fname")).alias("ftype"))


@query("select event_id, json_extract_string(props, '$.k') k from events union all select -1, 'no {json'")
def json_extract(spark, d):
    """A value of a JSON text; one invented text is none and stays as it is."""
    e = table(spark, d, "events").select("event_id", "props").unionByName(spark.createDataFrame([(-1, "no {json")], "event_id long, props string"))
    return e.select("event_id", text.json_or_text(F.col("props"), "$.k").alias("k"))


@query("select event_id, json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type)::varchar ast_raw from events")
def json_debug(spark, d):
    return debug_json(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("select doc_id, text from documents union all select -1, 'á'")
def safe_decode(spark, d):
    """Bytes as text; one invented row is no UTF-8."""
    raw = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return raw.unionByName(spark.createDataFrame([(-1, bytearray(b"\xe1"))], "doc_id long, raw binary")).select("doc_id", text.safe_decode(F.col("raw")).alias("text"))


@query(r"select doc_id, trim(regexp_replace(text, '[ \t\r\n\f\x0b]+', ' ', 'g'), ' ') t from documents")
def normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_ws(F.col("text")).alias("t"))


@query("select fnid, regexp_replace(concat('/', fname, '/'), '^/+|/+$', '', 'g') path from m_file_name")
def strip_slashes(spark, d):
    return table(spark, d, "m_file_name").select("fnid", text.strip_slashes(F.concat(F.lit("/"), "fname", F.lit("/"))).alias("path"))


@query("select doc_id, substring(text, 1, 255) t from documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text")).alias("t"))


@query("select fnid, case when starts_with(fname, 'include/') then substring(fname, 9) else fname end path from m_file_name")
def relative_paths(spark, d):
    return table(spark, d, "m_file_name").select("fnid", text.relative_path(F.col("fname"), "include").alias("path"))


@query("select doc_id, regexp_replace(text, '\\\\(\r\n|\n|\r)', '', 'g') t from documents")
def join_continued(spark, d):
    return table(spark, d, "documents").select("doc_id", text.joined_lines(F.col("text")).alias("t"))


@query(r"""select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)[^/"'']+|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|/\*.*?\*/|//[^\n]*|.'),
  lambda x: case when x[1] = '/' and length(x) > 1 then regexp_replace(x, '[^\n]', '', 'g') else x end), '') t from documents""")
def comment_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", text.comment_free(F.col("text")).alias("t"))


@query(r"select doc_id, line, 'ifdef' word, regexp_extract(code, '^#ifdef[ \t]+([A-Za-z_][A-Za-z_0-9]*)', 1) as name from (select doc_id, cast(line as int) line, code from " + _LINE_ROWS + r") where regexp_matches(code, '^#ifdef[ \t]+[A-Za-z_]')")
def ifdef_names(spark, d):
    rows = source_text.source_lines(_docs(spark, d), "doc_id", "text")
    names = text.ifdef_names(F.col("code"))
    return rows.withColumn("n", names).filter(F.size("n") > 0).select("doc_id", "line", F.lit("ifdef").alias("word"), F.col("n")[0].alias("name"))


_WORDS = "case word " + " ".join(f"when '{w}' then {t}" for w, t in source_text.DIRECTIVES.items()) + " else 66 end"
_DIRECTIVE_SQL = rf"""(select doc_id, cast(line as int) line, word, trim(regexp_replace(code, '^[ \t]*#[ \t]*[a-z]+', ''), ' ') rest
from (select *, regexp_extract(code, '^[ \t]*#[ \t]*([a-z]+)', 1) word from {_LINE_ROWS}) where word <> '' and word <> 'embed')"""


@query(rf"""select doc_id, line, word, cast(case when word = 'define' and regexp_matches(rest, '^[A-Za-z_][A-Za-z_0-9]*(\(|[ \t]+[^ \t])') then 55 else {_WORDS} end as int) type_id,
regexp_extract(rest, '^([A-Za-z_][A-Za-z_0-9]*)', 1) as name, substring(rest, 1, 255) rest from {_DIRECTIVE_SQL}""")
def directive_classify(spark, d):
    return source_text.directive_rows(_docs(spark, d), "doc_id", "text")


@query(f"""with d as (select doc_id, line, word, case when word in ('if', 'ifdef', 'ifndef') then 1 when word = 'endif' then -1 else 0 end step from {_DIRECTIVE_SQL}
  where word in ('if', 'ifdef', 'ifndef', 'elif', 'elifdef', 'elifndef', 'else', 'endif')),
s as (select *, sum(step) over (partition by doc_id order by line) sm from d),
l as (select *, least(0, min(sm) over (partition by doc_id order by line)) low, least(0, coalesce(min(sm) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)) was from s),
k as (select *, sm - low + case when word = 'endif' then 1 else 0 end depth from l where not (word = 'endif' and low < was) and sm - low + case when word = 'endif' then 1 else 0 end > 0),
g as (select *, sum(case when step = 1 then 1 else 0 end) over (partition by doc_id, depth order by line) grp from k),
e as (select *, lead(word) over w nw, lead(line) over w nl from g window w as (partition by doc_id, depth, grp order by line))
select doc_id, line, word, cast(case when nw is null then 0 when nw = 'endif' then nl else greatest(line, nl - 1) end as int) line_end from e where word <> 'endif'""")
def cppro_scopes(spark, d):
    return source_text.conditional_scopes(source_text.directive_rows(_docs(spark, d), "doc_id", "text"), "doc_id")


@query(f"""select doc_id, line, word, regexp_replace(regexp_replace(rest, '/[*].*?[*]/|//.*', '', 'g'), '[ \t]+', '', 'g') expression from {_DIRECTIVE_SQL} where word in ('if', 'elif')""")
def condition_text(spark, d):
    return source_text.condition_text(_docs(spark, d), "doc_id", "text")


@query()
def token_classify(spark, d):
    return source_text.tokens(_docs(spark, d), "doc_id", "text")


@query()
def brace_zones(spark, d):
    return source_text.brace_zones(_docs(spark, d), "doc_id", "text")


@query(rf"""with r as (select *, trim(regexp_replace(code, '[ \t]+', ' ', 'g'), ' ') s from {_LINE_ROWS.replace(_DOCS_SQL, "(select doc_id, text from documents where kind = 'asm')")}),
t as (select * from r where s <> '' and regexp_extract(code, '^[ \t]*#[ \t]*([a-z]+)', 1) not in ({", ".join(f"'{w}'" for w in source_text.DIRECTIVES)})),
o as (select *, regexp_matches(s, '^\.macro( |$)') opens, coalesce(sum(case when regexp_matches(s, '^\.macro( |$)') then 1 when regexp_matches(s, '^\.endm( |$)') then -1 else 0 end) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) inside from t)
select doc_id, cast(line as int) line, cast(case when opens then 62 when regexp_matches(s, '^(#|//|/\*|;|@)') then 66 when regexp_matches(s, '^[A-Za-z_.$0-9][A-Za-z_.$0-9]* ?:') then 65 when starts_with(s, '.') then 63 else 64 end as int) type_id, substring(s, 1, 255) as name
from o where inside <= 0""")
def asm_lines(spark, d):
    return source_text.asm_rows(table(spark, d, "documents").filter("kind = 'asm'"), "doc_id", "text")


@query()
def declarations(spark, d):
    return source_text.declarations(_docs(spark, d), "doc_id", "text")


_TARGETS = f"(select doc_id, line, regexp_extract(rest, '^(<[^>]+>|\"[^\"]+\")', 1) target from {_DIRECTIVE_SQL} where word = 'include')"


@query(f"""select t.doc_id, line, target, case when target[1] = '<' then 'include/' else 'core/' || coalesce(kind || '/', '') end || substring(target, 2, length(target) - 2) path
from {_TARGETS} t join documents using (doc_id) where target <> ''""")
def include_resolve(spark, d):
    """Includes with their paths; a document is taken for a file in a folder named by its kind."""
    docs = table(spark, d, "documents")
    rows = source_text.directive_rows(docs, "doc_id", "text").filter("word = 'include'")
    rows = rows.select("doc_id", "line", F.regexp_extract("rest", '^(<[^>]+>|"[^"]+")', 1).alias("target")).filter("target <> ''")
    rows = rows.join(docs.select("doc_id", F.concat(F.lit("core/"), F.coalesce(F.concat("kind", F.lit("/")), F.lit("")), F.lit("x.c")).alias("file")), "doc_id")
    return rows.select("doc_id", "line", "target", text.include_path(F.col("target"), F.col("file")).alias("path"))


@query(rf"""select doc_id, cast(line as int) line, array_to_string(list_filter(list_transform(regexp_extract_all(a, '(?:[^,()]|\([^()]*\))+'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') args
from (select doc_id, line, regexp_extract(code, '^[ \t]*#[ \t]*define[ \t]+[A-Za-z_][A-Za-z_0-9]*\(((?:[^()]|\([^()]*\))*)\)', 1) a from {_LINE_ROWS}) where a <> ''""")
def macro_arguments(spark, d):
    rows = source_text.source_lines(_docs(spark, d), "doc_id", "text")
    return rows.select("doc_id", "line", source_text.macro_arguments(F.col("code")).alias("a")).filter(F.size("a") > 0).select("doc_id", "line", F.array_join("a", "|").alias("args"))


@query("select ast_id, array_to_string(list_filter([case when type_id & 1 <> 0 then '16' end, case when type_id & 2 <> 0 then '17' end, case when type_id & 4 <> 0 then '18' end, case when type_id & 8 <> 0 then '19' end], lambda x: x is not null), ',') q from m_ast where type_id is not null")
def qualifier_types(spark, d):
    return table(spark, d, "m_ast").filter("type_id is not null").select("ast_id", F.array_join(text.qualifiers(F.col("type_id").cast("int")).cast("array<string>"), ",").alias("q"))


@query("select ast_id, cast(type_id + 1 as int) decl, cast(type_id + 2 as int) notbind from m_ast where type_id in (20, 27, 30, 33)")
def declared_types(spark, d):
    a = table(spark, d, "m_ast").filter(F.col("type_id").isin(20, 27, 30, 33))
    return a.select("ast_id", text.declared_type(F.col("type_id"), 1).alias("decl"), text.declared_type(F.col("type_id"), 2).alias("notbind"))


@query("select doc_id, cast(len(regexp_extract_all(text, '(?s).{1,80}')) as bigint) pieces from documents where text is not null")
def hard_wrap(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(text.hard_wrapped(F.col("text"), 80)).cast("long").alias("pieces"))


@query()
def word_wrap(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.wrapped(F.col("text"), F.lit(72))).alias("pos", "line"))


# Reports ----------------------------------------------------------------------------------------------------------

@query("select event_type, round(sum(value), 4) total, round(sum(value) * 100.0 / sum(sum(value)) over (), 4) pct from events group by 1")
def pct_of_total(spark, d):
    r = report.share_of_total(table(spark, d, "events"), "event_type", "value")
    return r.select("event_type", F.round("total", 4).alias("total"), F.round("pct", 4).alias("pct"))


@query(f"select doc_id, grp, count(*) n from (select doc_id, sum(case when code = '' then 1 else 0 end) over (partition by doc_id order by line rows unbounded preceding) grp from {_LINE_ROWS}) group by 1, 2".replace("grp, count", "cast(grp as bigint) grp, count"))
def group_lines(spark, d):
    rows = source_text.source_lines(_docs(spark, d), "doc_id", "text")
    return report.grouped_lines(rows, "doc_id", "line", F.col("code") == "").groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("select rpad(cast(vid as varchar), cast((select max(length(cast(vid as varchar))) from m_v_main) + 2 as int), ' ') || rpad(vname, cast((select max(length(vname)) from m_v_main) + 2 as int), ' ') as line from m_v_main")
def align_columns(spark, d):
    return report.aligned(table(spark, d, "m_v_main"), ["vid", "vname"])


@query("select kind, bool_and(coalesce(ok, false)) all_passed, bool_or(not coalesce(ok, false)) any_failed, count(*) n from (select kind, n_chars = length(text) ok from documents) group by 1")
def roll_up(spark, d):
    docs = table(spark, d, "documents").withColumn("ok", F.col("n_chars") == F.length("text"))
    return report.roll_up(docs, ["kind"], "ok")
