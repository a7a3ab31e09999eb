"""Hand-derived fixtures of the versioned model."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.functions import report, source_text, text
from treeloom.operators import browse, extents, select, staging, tags, versions
from treeloom.plans import joingraph
from treeloom.plans.joingraph import Join
from treeloom.sources import catalog, engines, tree
from treeloom.streaming.versions import SNAPSHOT, VersionedTree

ONE_V1 = '#include "two.h"\n#define N 4\nint f(void);'
ONE_V2 = '#include "two.h"\n#define N 8\n\nint f(void);'
TREE = {
    1: {"Kconfig": "k", "a": None, "a/one.c": ONE_V1, "a/two.h": "t", "b": None, "b/x.S": "s"},
    2: {"a": None, "a/one.c": ONE_V2, "a/two.h": "t", "c": None, "c/x.S": "s", "d.rs": "r"},
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def snapshot(spark, vid):
    df = spark.createDataFrame([(vid, p, c) for p, c in TREE[vid].items()], "vid int, path string, content string")
    return df.withColumn("ftype", F.when(F.col("content").isNull(), F.lit(0)).otherwise(text.file_type(F.col("path"))).cast("smallint"))


def test_two_versions(spark):
    t = VersionedTree(spark)
    for v in (1, 2, 2):
        t.add(snapshot(spark, v), v)
    want = [
        ("Kconfig", 1, 1, 2, "A", "D"), ("a", 1, 0, 0, "A", "0"), ("a/one.c", 1, 1, 1, "A", "M"), ("a/two.h", 1, 0, 1, "A", "0"), ("b", 1, 1, 0, "A", "D"),
        ("b/x.S", 1, 1, 4, "A", "R"), ("a/one.c", 2, 0, 1, "M", "0"), ("c", 2, 0, 0, "A", "0"), ("c/x.S", 2, 0, 4, "R", "0"), ("d.rs", 2, 0, 3, "A", "0"),
    ]
    assert rows(t.files.select("path", "vid_s", "vid_e", "ftype", "s_stat", "e_stat")) == sorted(want, key=repr)
    assert t.bridge.groupBy("vid").count().orderBy("vid").collect() == [(1, 6), (2, 6)]
    fid = {(p, s): f for f, p, s in t.files.select("fid", "path", "vid_s").collect()}
    assert rows(t.moved) == [(fid["b/x.S", 1], fid["c/x.S", 2])]
    kept = {(v, p): f for v, p, f in t.bridge.collect()}
    assert kept[2, "a"] == kept[1, "a"] and kept[2, "a/two.h"] == kept[1, "a/two.h"] and kept[2, "a/one.c"] != kept[1, "a/one.c"]
    for v in (1, 2):
        assert versions.valid_at(t.files, v).count() == 6
    at = t.bridge.filter("vid = 2").join(t.files.select("fid", "ftype"), "fid")
    files = at.filter("ftype <> 0")
    assert rows(browse.sub_directories(files, "path")) == [("a",), ("c",)] and rows(browse.files_below(files, "path").select("name")) == [("d.rs",)]
    assert rows(browse.files_below(files, "path", "a").select("name")) == [("one.c",), ("two.h",)] and browse.sub_directories(files, "path", "/a/").count() == 0
    assert rows(browse.kind_of(at, "path", "ftype", "a/one.c")) == [("a/one.c", True)] and rows(browse.kind_of(at, "path", "ftype", "a")) == [("a", False)]
    assert rows(versions.directory_changes(snapshot(spark, 1), snapshot(spark, 2), "path")) == [("a", "="), ("b", "D"), ("c", "A")]


def test_snapshots_as_a_stream(spark, tmp_path):
    for v in (1, 2):
        snapshot(spark, v).select("vid", "path", "content", "ftype").coalesce(1).write.parquet(f"{tmp_path}/v{v}")
    for v in (1, 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"v{v}").glob("*.parquet")).rename(tmp_path / "in" / f"{v}.parquet")
    t = VersionedTree(spark)
    t.follow(f"{tmp_path}/in", f"{tmp_path}/cp").awaitTermination()
    assert t.last == 2 and t.files.count() == 10 and SNAPSHOT.startswith("vid")


def test_a_restarted_stream_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for v in (1, 2):
        snapshot(spark, v).select("vid", "path", "content", "ftype").coalesce(1).write.parquet(f"{tmp_path}/v{v}")
        next((tmp_path / f"v{v}").glob("*.parquet")).rename(tmp_path / "in" / f"{v}.parquet")
        t = VersionedTree(spark, f"file://{tmp_path}/tree")  # a new driver
        t.follow(f"{tmp_path}/in", f"{tmp_path}/cp").awaitTermination()
    whole = VersionedTree(spark)
    for v in (1, 2):
        whole.add(snapshot(spark, v), v)
    again = VersionedTree(spark, f"file://{tmp_path}/tree")
    for name in ("files", "bridge", "moved"):
        assert rows(getattr(again, name)) == rows(getattr(t, name)) == rows(getattr(whole, name))
    assert again.last == 2


def test_tags_of_a_changed_file(spark):
    def lines(code, *names):
        return source_text.source_lines(spark.createDataFrame([(1, code)], "fid long, t string"), "fid", "t").filter("code <> ''")

    prior = lines(ONE_V1).select("fid", F.col("line").cast("long").alias("tag_id"), "code")
    got = tags.match(prior, lines(ONE_V2).select("fid", "code", "line"), ["fid"], "code", ["tag_id"], ["line"])
    assert rows(got.select("tag_id", "code", "line", "op")) == sorted(
        [(1, '#include "two.h"', 1, "RECYCLE"), (3, "int f(void);", 4, "RECYCLE"), (2, "#define N 4", None, "CLOSE"), (None, "#define N 8", 2, "OPEN")], key=repr
    )
    t = prior.select("tag_id", F.lit(1).alias("vid_s"), F.lit(0).alias("vid_e"))
    assert rows(tags.closed(t, got, 2)) == [(1, 1, 0), (2, 1, 1), (3, 1, 0)]
    empty = spark.createDataFrame([(1, 9, ""), (1, 8, None)], "fid long, tag_id long, code string")
    got = tags.match(empty, empty.select("fid", "code", F.lit(1).alias("line")), ["fid"], "code", ["tag_id"], ["line"])
    assert sorted(r[0] for r in got.select("op").collect()) == ["CLOSE", "CLOSE", "OPEN", "OPEN"]


EDGES = [(10, 0, 11), (10, 1, 12), (11, 0, 13), (12, 0, 13), (20, 0, 21), (21, 0, 20), (30, 0, 0), (40, 0, None)]


def test_container_depths(spark):
    df = spark.createDataFrame([("all", a, c) for a, _, c in EDGES] + [("cyc", 20, 21), ("cyc", 21, 20), ("one", 30, 0)], "g string, p long, c long")
    got = browse.container_depths(df, "g", "p", "c")
    want = [("all", n, d) for n, d in ((10, 0), (11, 1), (12, 1), (13, 2), (20, None), (21, None))] + [("cyc", 20, 0), ("cyc", 21, 0)]
    assert rows(got) == sorted(want, key=repr)
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(1, 31)], "g long, p long, c long")
    for most in (1_000_000, 5):  # in one task, and level by level
        assert rows(browse.container_depths(chain, "g", "p", "c", most)) == sorted([(1, i, i - 1) for i in range(1, 32)], key=repr)
    batches = [pa.RecordBatch.from_pydict({"g": [g], "p": [p], "c": [c]}) for g, p, c in ((1, 1, 2), (1, 2, 3), (2, 5, 6), (3, 7, 8), (3, 8, 7))]
    assert sorted(tuple(r.values()) for b in browse._search(iter(batches)) for r in b.to_pylist()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 5, 0), (2, 6, 1), (3, 7, 0), (3, 8, 0)]


def test_bounded_tree(spark):
    edges = spark.createDataFrame([(a, p, 30, c) for a, p, c in [*EDGES, (20, 1, 22)]], "ast_id long, priority int, type_id short, ref_ast_id long")
    ast = spark.createDataFrame([(20, "n20", 27), (21, "n21", None)], "ast_id long, name string, type_id short")
    roots = spark.createDataFrame([(20,), (99,)], "node long")
    debug = spark.createDataFrame([(21, "{}")], "ast_id long, ast_raw string")
    got = browse.bounded_tree(roots, edges, ast, catalog.type_descriptor(spark), 3, debug).select("root", "path", "node", "depth", "relation", "name", "type_name", "ast_raw")
    assert rows(got) == [  # node 22 is missing, so it is left out; 20 comes again below itself, without children
        (20, "", 20, 0, None, "n20", "C_struct", None), (20, "0", 21, 1, "C_enum", "n21", None, "{}"), (20, "0.0", 20, 2, "C_enum", "n20", "C_struct", None), (99, "", 99, 0, None, "Unknown", "Undefined", None),
    ]
    with pytest.raises(ValueError, match="depth"):
        browse.bounded_tree(roots, edges, ast, catalog.type_descriptor(spark), 11)


def test_conditional_scopes(spark):
    code = "\n".join({1: "#ifdef A", 5: "#elif B", 9: "#else", 12: "#endif", 20: "#if X", 14: "#endif", 15: "#else", 21: "#ifndef Y", 23: "#endif"}.get(i, "x") for i in range(1, 25))
    df = spark.createDataFrame([(1, code), (2, None), (3, "")], "k long, t string")
    d = source_text.directive_rows(df, "k", "t")
    assert rows(source_text.conditional_scopes(d, "k").select("line", "word", "line_end")) == sorted(
        [(1, "ifdef", 4), (5, "elif", 8), (9, "else", 12), (20, "if", 0), (21, "ifndef", 23)], key=repr
    )


def test_staging(spark):
    one = lambda df: df.collect()[0][0]
    assert one(staging.next_id(spark.createDataFrame([], "id long"), "id")) == 1 and one(staging.next_id(catalog.seed(spark, "m_file"), "fid")) == 1
    dim = spark.createDataFrame([("p", 4)], "fname string, fnid long")
    want = spark.createDataFrame([("q",), ("q",), ("p",), (None,), ("o",)], "fname string")
    made = staging.get_or_create(dim, want, "fname", "fnid")
    assert rows(made) == sorted([("p", 4, "DONE"), ("o", 5, "SET"), ("q", 6, "SET")], key=repr)
    again = staging.get_or_create(made.drop("op"), want, "fname", "fnid")
    assert again.filter("op = 'SET'").count() == 0
    base = spark.createDataFrame([(1, 1, 0, "0"), (2, 1, 0, "0")], "fid long, vid_s int, vid_e int, e_stat string")
    up = spark.createDataFrame([(2, None, 1, "D"), (3, 1, 1, "D")], "fid long, vid_s int, vid_e int, e_stat string")
    assert rows(staging.patch(base, up, ["fid"])) == [(1, 1, 0, "0"), (2, 1, 1, "D")]
    new = staging.upsert(base, up, ["fid"])
    assert rows(new) == sorted([(1, 1, 0, "0"), (2, None, 1, "D"), (3, 1, 1, "D")], key=repr) and rows(staging.upsert(new, up, ["fid"])) == rows(new)
    flat = spark.createDataFrame([("s", 1, 5), ("s", 2, 6), ("s", 2, 6), ("t", 1, 5)], "name string, pos int, ref long")
    parents, kids = staging.decompose(flat, ["name"], {"name": F.col("name")}, {"ref": F.col("ref")}, ["pos", "ref"], 7)
    assert rows(parents) == [(7, "s"), (8, "t")] and rows(kids) == [(7, 0, 5), (7, 1, 6), (8, 0, 5)]
    assert rows(staging.rank_children(flat.distinct(), "name", ["pos"], 1).select("name", "ref", "priority")) == [("s", 5, 1), ("s", 6, 2), ("t", 5, 1)]
    before = staging.HOT_ROWS
    staging.HOT_ROWS = 2
    many = spark.createDataFrame([(p, c) for p in (1, 2, None) for c in (5, 3, 9, 7)], "p long, c long").withColumn("_first", F.lit(1)).drop("_first")
    assert rows(staging.rank_children(many, "p", ["c"], 1).filter("p is not null")) == sorted([(p, c, r) for p in (1, 2) for r, c in ((1, 3), (2, 5), (3, 7), (4, 9))], key=repr)
    staging.HOT_ROWS = before
    last = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, None, "z")], "k long, o int, v string")
    assert rows(staging.last_wins(last, ["k"], ["o"])) == sorted([(1, 2, None), (2, None, "z")], key=repr)


def test_selection(spark):
    df = spark.createDataFrame([(2, "b", 1), (1, "b", 1), (3, None, 1)], "id long, name string, t int")
    assert rows(select.select_first(df, (), ["id"])) == [(1, "b", 1)] and rows(select.select_first(df, (None, "x"), ["id"])) == []
    with pytest.raises(ValueError, match="more values"):
        select.wildcard_select(df, (1, 2, 3, 4))
    assert rows(select.plain_values(df.select((F.col("t") == 1).alias("b"), "name"))) == rows(df.select("t", "name"))
    assert select.check_schema(df, "id long, name string, t int") == [] and select.check_schema(df, "id int, z long") == ["id: long instead of int", "z: missing instead of long"]
    got = df.select(select.first_rule(F.col("id"), [({1, 2}, "few"), (3, "many")], "none").alias("r"))
    assert rows(got) == [("few",), ("few",), ("many",)]


def test_views_agree(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ast_id long, name string")
    c = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 5)], "ast_id long, priority int, ref long")
    v = joingraph.view({"a": a, "c": c}, "a", [Join("a", "ast_id", "c", "ast_id", 2)], (None, None, None, 0, None, None, 1))
    assert rows(v) == [(1, "x", 1, 0, 5, 1, 1, 6)] and v.columns[0] == "A1_ast_id" and v.columns[-1] == "A3_ref"
    assert rows(joingraph.containing(c, "ast_id", [{"priority": 0}, {"priority": 1}])) == [(1,)]
    assert rows(joingraph.containing(c, "ast_id", [])) == [(1,), (2,)]
    with pytest.raises(ValueError, match="more values"):
        joingraph.view({"a": a}, "a", (), (1, 2, 3))


def test_scalars(spark):
    def value(col, *data):
        return spark.createDataFrame([data], [f"c{i}" for i in range(len(data))]).select(col.alias("x")).collect()[0][0]

    for name, want in (("a.c", 1), ("a.h", 1), ("a.S", 4), ("a.s", 4), ("x/Kconfig", 2), ("m.rs", 3), ("Makefile", None)):
        assert value(text.file_type(F.col("c0")), name) == want
    bare = lambda t: value(text.comment_free(F.col("c0").cast("string")), t)
    assert bare("a /* x\ny */ b // c") == "a \n b " and bare('s = "//"; c = \'"\'; /* gone */ d') == 's = "//"; c = \'"\';  d'
    assert bare("/* open") == "/* open" and bare("") == "" and bare("/**/x/*/") == "x/*/" and bare('"\\"//" // c') == '"\\"//" '
    assert bare("'" + "\\x" * 50_000 + "'//" + "'" * 3) == "'" + "\\x" * 50_000 + "'" and bare("/" * 9) == ""
    assert spark.sql("select cast(null as string) t").select(text.comment_free(F.col("t"))).collect()[0][0] is None
    assert value(text.normalize_ws(F.col("c0")), "  a \t b\n") == "a b"
    assert value(text.safe_decode(F.col("c0")), bytearray(b"\xe1")) == "á" and value(text.safe_decode(F.col("c0")), bytearray(b"\xc3\xa1")) == "á"
    assert value(text.fold_path(F.col("c0")), "a/./b/../../c//d/..") == "c" and value(text.fold_path(F.col("c0")), "../a") == "../a"
    assert value(text.include_path(F.col("c0"), F.col("c1")), '"../x.h"', "drv/a/b.c") == "drv/x.h" and value(text.include_path(F.col("c0"), F.col("c1")), "<l/k.h>", "b.c") == "include/l/k.h"
    assert value(text.listed(F.col("c0")), ["a", "b", "c"]) == "a, b and c" and value(text.listed(F.col("c0")), ["a"]) == "a"
    assert value(text.json_or_text(F.col("c0"), "$.k"), '{"k": 3}') == "3" and value(text.json_or_text(F.col("c0"), "$.k"), "raw") == "raw"
    assert value(text.qualifiers(F.col("c0")), 5) == [16, 18] and value(text.joined_lines(F.col("c0")), "a\\\nb") == "ab"
    assert value(text.hard_wrapped(F.col("c0"), 3), "abcdefg") == ["abc", "def", "g"]
    assert value(source_text.macro_arguments(F.col("c0")), "#define M(a, b ,c) x") == ["a", "b", "c"]
    for code, args in (("#define M(a, (b, c), f(g(x), y)) z(1)", ["a", "(b, c)", "f(g(x), y)"]), ("#define M() 1", []), ("#define M(a, b", []), ("#define M (a)", []), ("x", [])):
        assert value(source_text.macro_arguments(F.col("c0")), code) == args, code


def test_extents(spark):
    def inside(o, i):
        cols = [f"{p}{c}" for p in "oi" for c in ("line_s", "char_s", "line_e", "char_e")]
        return spark.createDataFrame([(*o, *i)], cols).select(extents.contains("o", "i")).collect()[0][0]

    assert inside((1, 5, 3, 2), (1, 5, 3, 2)) and not inside((1, 5, 3, 2), (1, 4, 2, 1)) and inside((1, 5, 3, 2), (2, 90, 3, 1))
    df = spark.createDataFrame([(2, 7, 4, 1), (2, 3, 3, 9)], ["line_s", "char_s", "line_e", "char_e"])
    h = df.agg(*extents.hull()).collect()[0]
    assert (*h["s"], *h["e"]) == (2, 3, 4, 1)
    t = spark.createDataFrame([("abc\r\ndef\nghi",)], ["t"])
    cut = lambda *a: t.select(extents.slice_text(F.col("t"), *map(F.lit, a))).collect()[0][0]
    assert cut(1, 2, 2, 3) == "bc\nde" and cut(2, 0, 2, 0) == "def" and cut(2, 2, 2, 3) == "e" and cut(3, 1, 9, 1) == "ghi"


def test_source_rows(spark):
    asm = "start:\n\tmov r0, r1 ; x\n# note\n.globl start\n.macro M a\n  nop\n.endm\n\n  ret"
    got = rows(source_text.asm_rows(spark.createDataFrame([(1, asm)], "k long, t string"), "k", "t").select("line", "type_id"))
    assert got == [(1, 65), (2, 64), (3, 66), (4, 63), (5, 62), (9, 64)]
    toks = source_text.tokens_of('int a->b; /* x\ny */ "s"')
    assert [t[:2] for t in toks] == [("keyword", "int"), ("identifier", "a"), ("punctuation", "->"), ("identifier", "b"), ("punctuation", ";"), ("comment", "/* x\ny */"), ("literal", '"s"')]
    assert toks[5][2:] == (1, 11, 2, 5) and toks[6][2:] == (2, 6, 2, 9)
    c = "static int f(void)\nstruct a {\nu32 n = 4;\nreturn x;"
    assert rows(source_text.declarations(spark.createDataFrame([(1, c)], "k long, t string"), "k", "t").select("line", "shape", "name")) == [(1, "function", "f"), (2, "struct", "a"), (3, "variable", "n")]
    d = source_text.directive_rows(spark.createDataFrame([(1, "# define X 1\n#define Y\n#define Z(a) a\n#embed x\n#nonsense\n  #include <a.h>")], "k long, t string"), "k", "t")
    assert rows(d.select("line", "type_id", "name")) == sorted([(1, 55, "X"), (2, 54, "Y"), (3, 55, "Z"), (5, 66, ""), (6, 57, "")], key=repr)


def test_reports(spark):
    t = spark.createDataFrame([("a", 1.0, 3.0), ("b", None, 0.0)], "f string, parse double, commit double")
    assert rows(report.stage_report(t, ["parse", "commit"])) == [("commit", 3.0, 75.0, " 3.00s", "high"), ("parse", 1.0, 25.0, " 1.00s", "medium")]
    assert rows(report.aligned(t, ["f", "parse"])) == [("a  1.0  ",), ("b       ",)]
    assert spark.createDataFrame([("the quick brown fox",)], ["t"]).select(text.wrapped("t", F.lit(10))).collect()[0][0] == ["the quick", "brown fox"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.c").write_bytes(b"caf\xe9\n")
    (tmp_path / "Kconfig").write_bytes("é".encode())
    assert rows(tree.read_tree(spark, str(tmp_path), 3).select("vid", "path", "content", "ftype")) == [(3, "Kconfig", "é", 2), (3, "a/x.c", "café\n", 1)]
    lines = spark.createDataFrame([("M\ta/b",), ("R087\told\tnew",), ("",), ("D\tz",)], ["value"])
    assert rows(tree.parse_changes(lines)) == sorted([("M", None, "a/b", None), ("R", 87, "new", "old"), ("D", None, "z", None)], key=repr)


@pytest.mark.parametrize("name", ["parquet", "memory"])
def test_engines(spark, tmp_path, name):
    e = engines.get_engine(name)(spark, f"file://{tmp_path}/db")
    names = ["m_file_name", "m_ast", "m_ast_debug"]
    assert e.missing(names) == names
    e.create(names)
    e.create(names)
    assert e.missing(names) == [] and rows(e.scan("m_file_name")) == [(0, "")] and e.scan("m_ast_debug").count() == 0
    e.commit({"m_file_name": spark.createDataFrame([(1, "a.c")], "fnid long, fname string"), "m_ast": spark.createDataFrame([(5, "n", 1)], "ast_id long, name string, type_id short")})
    e.update("m_file_name", spark.createDataFrame([(1, "b.c"), (2, "c.c")], "fnid long, fname string"))
    assert rows(e.scan("m_file_name")) == [(0, ""), (1, "b.c"), (2, "c.c")] and e.scan("m_ast").count() == 2
    e.drop(["m_ast"])
    assert e.missing(names) == ["m_ast"]
    assert rows(engines.debug_json(e.scan("m_file_name").filter("fnid = 1"), "fnid")) == [(1, '{"fnid":1,"fname":"b.c"}')]
    with pytest.raises(ValueError, match="unknown engine"):
        engines.get_engine("oracle")
