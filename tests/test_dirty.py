import pytest

from tests import dirty
from treeloom.queries import engine, general, model


@pytest.mark.parametrize("how", ["empty", "nulls", "mixed"])
def test_dealt_queries(spark, tmp_path, how):
    """Every p query runs on such tables; those with SQL agree with it (extra columns are not part of the data there)."""
    duckdb = pytest.importorskip("duckdb")
    d = dirty.write(tmp_path, how)
    con = duckdb.connect()
    for name, ddl in dirty.TABLES.items():
        con.execute(f"create view {name} as select {', '.join(c.split()[0] for c in ddl.split(', '))} from '{d}/{name}.parquet'")
    for name, f in general.QUERIES.items():
        df = f(spark, d)
        got = sorted(map(repr, (tuple(r) for r in df.collect())))
        if name not in general.SQL:
            continue
        cols = ", ".join(f'"{c}"' for c in df.columns)
        want = sorted(map(repr, con.execute(f"select {cols} from ({general.SQL[name]})").fetchall()))
        assert got == want, (name, how, got[:5], want[:5])


def test_model_queries_on_empty_tables(spark, tmp_path):
    d = dirty.write(tmp_path, "empty")
    for name, f in (model.QUERIES | engine.QUERIES).items():
        if name not in ("json_extract", "json_debug", "pct_of_total", "durations", "stage_report"):  # tables that are not part of the model
            f(spark, d).collect()
