from pyspark.sql import functions as F

from oddone.operators.manifest import args_map, dangling, parse_manifest, resolve


def lines(spark, vals):
    return spark.createDataFrame(list(enumerate(vals, 1)), "line_no long, value string")


def test_manifest_parse(spark):
    p = parse_manifest(lines(spark, ["  # c", "", "  e m s version_dir=1a  "])).collect()
    assert len(p) == 1
    r = p[0]
    assert (r.experiment, r.model, r.stimulus, r.version, r.log_name) == ("e", "m", "s", "1a", "1a_m_e.log")


def test_args_last_wins(spark):
    df = spark.createDataFrame([(["a=1", "a=2", "b=x=y", "junk"],)], "args array<string>")
    assert df.select(args_map(F.col("args")).alias("m")).first()["m"] == {"a": "2", "b": "x=y"}


def test_resolve_and_dangling(spark):
    p = parse_manifest(lines(spark, ["e1 m1 s v=1", "e1 gemma-3-9b-it s", "nope m1 s"]))
    models = spark.createDataFrame([("m1", "org/m1")], "name string, model_name string")
    exps = spark.createDataFrame([("e1", 3)], "name string, n_items int")
    assert [r.line_no for r in resolve(p, models, exps).collect()] == [1]
    bad = {(r.line_no, r.reason) for r in dangling(p, models, exps).collect()}
    assert bad == {(2, "unknown model"), (3, "unknown experiment")}
