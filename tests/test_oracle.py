"""Every registered query against its DuckDB oracle at sf0.01 (what the driver checks)."""

import os
import sys

import pytest

os.environ.setdefault("STRICT", "1")  # exact float equality, as a value hash sees it

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, duck  # noqa: E402

from conftest import SF01  # noqa: E402
from oddone.catalog import load_all  # noqa: E402

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of a query: that of its result (added by the test) and those of the checkpoints on the way."""
    seen, kind = [], type(spark.range(0))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, f=kind.checkpoint, **k: (seen.append(plan(self)), f(self, *a, **k))[1])
    return seen, lambda df: (seen.append(plan(df)), df)[1]


@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in REG.items() if sql))
def test_query_matches_oracle(spark, con, name, plans):
    fn, sql = REG[name]
    seen, record = plans
    r = compare(spark, con, name, lambda s, d: record(fn(s, d)), sql, SF01)
    assert not [p for p in seen if "BroadcastNestedLoopJoin" in p or "CartesianProduct" in p]
    assert r["cols_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["types_match"], r
    assert r["values_match"], r


@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in REG.items() if not sql))
def test_rows_only_queries_run(spark, name):
    assert REG[name][0](spark, SF01).count() > 0
