"""Run registered queries in Spark and their SQL oracles in DuckDB; compare like the driver
(row count, column names, order-insensitive values).

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = os.environ.get("STRICT") == "1"  # exact float equality (what a value hash sees)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        if isinstance(v, float) and math.isnan(v):
            return None
    except Exception:
        pass
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if v != v:
            return None
        return v + 0.0 if STRICT else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(v) for v in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    s_pdf = fn(spark, sf_dir).toPandas()
    ts = time.time() - t
    if sql is None:
        return {"name": name, "rows": len(s_pdf), "oracle": None, "spark_s": round(ts, 2)}
    t = time.time()
    o_pdf = con.execute(sql).df()
    to = time.time() - t
    sc, sr = rows_of(s_pdf)
    oc, orr = rows_of(o_pdf)
    if STRICT:  # exact dtype names (int32 vs int64 matters to a schema check)
        kinds_s = {c: str(s_pdf[c].dtype) for c in s_pdf.columns}
        kinds_o = {c: str(o_pdf[c].dtype) for c in o_pdf.columns}
    else:
        kinds_s = {c: s_pdf[c].dtype.kind for c in s_pdf.columns}
        kinds_o = {c: o_pdf[c].dtype.kind for c in o_pdf.columns}
    res = {"name": name, "rows": len(sr), "oracle_rows": len(orr), "cols_match": sc == oc,
           "types_match": kinds_s == kinds_o,
           "values_match": sr == orr, "spark_s": round(ts, 2), "oracle_s": round(to, 2)}
    if kinds_s != kinds_o:
        res["type_diffs"] = {c: (kinds_s.get(c), kinds_o.get(c)) for c in set(kinds_s) | set(kinds_o)
                             if kinds_s.get(c) != kinds_o.get(c)}
    if sc != oc:
        res["spark_cols"], res["oracle_cols"] = sc, oc
    elif sr != orr:
        diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
        res["first_diffs"] = diff
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from oddone.catalog import load_all
    from oddone.session import get_spark
    reg = load_all()
    if os.environ.get("PLAIN") == "1":  # a session with Spark's defaults, as a driver might build it
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    else:
        spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = (r.get("oracle") is None and "error" not in r and "values_match" not in r) or \
            (r.get("values_match") and r.get("types_match"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
