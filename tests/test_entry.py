import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    m = load_entry()
    df = m.entry(spark)
    assert set(df.columns) == {"item", "wins"} and df.count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    prepared = {n for n in q if n == "pipeline" or n.startswith("op")}  # an optional part, with tests of its own
    assert set(q) - set(o) - prepared == set()
