import pytest

from tests import dirty
from treeloom.llm import queries


@pytest.mark.parametrize("how", ["empty", "nulls", "mixed", "ones"])
def test_dealt_queries(spark, tmp_path, how):
    d = dirty.write(tmp_path, how)
    got = {name: f(spark, d).collect() for name, f in queries.QUERIES.items()}
    docs = {"empty": 0, "nulls": 3, "ones": 1}.get(how)
    if docs is not None:
        assert len(got["p7_ids"]) == len(got["p7_sizes"]) == len(got["p9_scores"]) == docs and got["p9_found"] == []
    assert all(r["ids"] is not None for r in got["p7_ids"])
