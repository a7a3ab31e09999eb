"""Every registered query outside the text package against its SQL, and what the driver relies on."""

import glob
import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry
from treeloom.queries import engine, general, model

DATA = "/root/testdata/sf0.001"
NAMES = [*general.QUERIES, *model.QUERIES, *engine.QUERIES]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, tmp_path, name):
    df = entry.queries()[name](spark, DATA)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        df.write.parquet(f"{tmp_path}/out")
        return
    duck.execute(sql)
    cols, types = [c[0] for c in duck.description], [str(c[1]) for c in duck.description]
    want = Counter(map(repr, duck.fetchall()))
    assert sorted(cols) == sorted(df.columns)
    df.write.parquet(f"{tmp_path}/out")
    duck.execute(f"select {', '.join(cols)} from '{tmp_path}/out/*.parquet'")
    assert types == [str(c[1]) for c in duck.description]
    assert Counter(map(repr, duck.fetchall())) == want


@needs_data
def test_all_transitions_are_read(spark):
    q = entry.queries()
    vids = {r[0] for r in spark.read.parquet(f"{DATA}/m_bridge_file.parquet").select("vid").distinct().collect()}
    assert len(vids) > 2
    for name in ("diff_classify_all", "unchanged_propagate_all", "directory_changes_all"):
        assert {r[0] for r in q[name](spark, DATA).select("vid").distinct().collect()} == vids - {min(vids)}
    # Two ways to the same history; only the tree knows renames.
    cols = ("fnid", "vid_s", "vid_e")
    tree, scd2 = q["tree_history"](spark, DATA), q["scd2_history"](spark, DATA)
    assert Counter(map(tuple, tree.select(*cols, "content").collect())) == Counter(map(tuple, scd2.select(*cols, "fid").collect()))
    assert tree.filter("s_stat not in ('A', 'M', 'R') or e_stat not in ('0', 'M', 'D', 'R')").isEmpty()


@needs_data
def test_reports_of_another_version_hide_nothing(spark, tmp_path):
    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("m_bridge_file", [(v, f, f) for v, fs in ((1, (1, 2, 3, 4)), (2, (1, 9)), (4, (9, 5, 6))) for f in fs], "vid int, fnid long, fid long")
    put("raw_update", [(1, "file", 2, 2, "D"), (2, "file", 3, 4, "D"), (3, "file", 1, 3, "D"), (4, "file", 5, 3, "A"), (5, "file", 6, 1, "A"), (6, "file", 4, None, "D")], "upd_id long, kind string, key_id long, vid int, stat string")
    q = entry.queries()
    assert sorted(map(tuple, q["forgotten_deletes_all"](spark, str(tmp_path)).collect())) == [(2, 3), (2, 4)]
    assert sorted(map(tuple, q["forgotten_news_all"](spark, str(tmp_path)).collect())) == [(2, 9), (4, 6)]


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_text_package_can_be_left_out():
    code = "import sys; sys.modules['treeloom.llm'] = None; import __spark_entry__ as e; print(sum(n[:2] in ('p7', 'p8', 'p9') for n in e.queries()), len(e.queries()) > 50)"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "True"]
