"""End-to-end plans on files written from the driver tables (E1, E2, E3, F7)."""

import os

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from oddone.functions.prompts import TRIPLET_TEMPLATE
from oddone.plans.experiments import embedding_run, run_manifest, stimuli_set, triplet_run
from oddone.plans.metadata import display, model_arch
from oddone.sinks.writers import write_answers
from oddone.sources.files import read_answers, read_concepts, read_lines, read_matrix, read_results
from oddone.operators.manifest import dangling, parse_manifest, resolve


def _files(spark, tmp_dir):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").orderBy("vec_id").limit(60)
    rows = emb.collect()
    cpath = os.path.join(tmp_dir, "concepts.csv")
    mpath = os.path.join(tmp_dir, "vectors.txt")
    with open(cpath, "w") as f:
        f.write("concept,label\n" + "".join(f"c{r.vec_id % 50},{r.label}\n" for r in rows))
    with open(mpath, "w") as f:
        f.write("# reference vectors\n" + "".join(" ".join(repr(float(v)) for v in r.embedding) + "\n" for r in rows))
    return cpath, mpath


def test_triplet_then_embedding_run(spark, tmp_dir):
    def nearer_scorer(batch):  # defined inline: shipped to workers by value
        return [f"{t} -> {y if len(y) <= len(z) else z}" for t, y, z in zip(batch["text"], batch["y"], batch["z"])]

    cpath, mpath = _files(spark, tmp_dir)
    concepts = read_concepts(spark, cpath, ["concept", "label"], "concept")
    matrix = read_matrix(spark, mpath)
    st = stimuli_set(concepts, matrix, TRIPLET_TEMPLATE, n_items=200, euclid_min=1.35, euclid_max=1.45, seed=3)
    assert st.count() == 200
    assert st.filter(F.col("dist_x_y") >= 1.35).count() == 0 and st.filter(F.col("dist_x_z") <= 1.45).count() == 0
    for model in ("m1", "m2"):
        ans = triplet_run(st, nearer_scorer, {"choose_mode": "tokens", "answer_format": "Answer: "}, batch_size=4)
        ans = ans.select("head", "winner", "loser", "raw_generation")
        assert ans.count() == 200 and ans.filter(F.col("winner").isNull()).count() < 200
        write_answers(ans, os.path.join(tmp_dir, "answers"), "1a", model, "THINGS", fmt="csv")
    back = read_answers(spark, os.path.join(tmp_dir, "answers", "version=1a", "model=m1", "stimulus=THINGS"))
    assert back.count() == 200
    both = spark.read.option("header", True).csv(os.path.join(tmp_dir, "answers")).select(
        F.col("model").alias("run"), "head", "winner", "loser")
    emb, accuracy = embedding_run(both, d=3, max_epochs=5, run_col="run")
    assert emb.select("run").distinct().count() == 2 and {r.run for r in accuracy.collect()} == {"m1", "m2"}
    single, judged = embedding_run(back, d=3, max_epochs=3)
    n = back.filter("winner is not null").count()
    assert judged.first().n_test == -(-n // 5)
    assert single.count() == single.select("item").distinct().count() > 0


def test_subset_stimuli_and_unconstrained(spark, tmp_dir):
    cpath, mpath = _files(spark, tmp_dir)
    concepts = read_concepts(spark, cpath, ["concept", "label"], "concept")
    st = stimuli_set(concepts, None, TRIPLET_TEMPLATE, n_items=50, subset=10, seed=1)
    assert st.count() == 50
    assert st.select(F.explode(F.array("item_x", "item_y", "item_z"))).distinct().count() <= 10
    assert st.filter(F.col("dist_x_y").isNotNull()).count() == 0


def test_run_manifest_and_metadata(spark, tmp_dir):
    mpath = os.path.join(tmp_dir, "w.txt")
    with open(mpath, "w") as f:
        f.write("# runs\nembedding_1_a m1 THINGS version_dir=1a\ntriplet_run_1_a m1 THINGS k=1 k=2 version_dir=1b\n")
    parsed = parse_manifest(read_lines(spark, mpath))
    models = spark.createDataFrame([("m1", "org/m1", "tokens")], "name string, model_name string, choose_mode string")
    exps = spark.createDataFrame([("embedding_1_a", 30), ("triplet_run_1_a", None)], "name string, d int")
    stims = spark.createDataFrame([("THINGS", "concept")], "name string, src_key string")
    calls = run_manifest(spark, parsed, models, exps, stims, {
        "embedding_1_a": lambda row, **kw: ("emb", row["model_name"], kw["version_dir"]),
        "triplet_run_1_a": lambda row, **kw: ("trip", kw["k"], kw["version_dir"])})
    assert calls == [("emb", "org/m1", "1a"), ("trip", "2", "1b")]
    cfg = spark.createDataFrame([("https://huggingface.co/org/x/tree/main", '{"n_layer": 2, "n_embd": 8, "n_head": 2}')],
                                "model_id string, config_json string")
    r = display(model_arch(cfg)).first()
    assert (r.model_id, r.num_layers, r.attention_dimensionality, r.vocabulary_size) == ("org/x", "2", "4", "Not found")


def test_embedding_experiments_checks_and_pruning(spark, tmp_dir):
    from oddone.plans.experiments import embedding_for_model, embedding_from_folder
    with pytest.raises(ValueError, match="version_dir"):
        embedding_from_folder(spark, None)
    with pytest.raises(ValueError, match="not found"):
        embedding_from_folder(spark, os.path.join(tmp_dir, "missing"))
    rows = [(f"a{i % 7}", f"a{(i + 1) % 7}", f"a{(i + 3) % 7}") for i in range(40)]
    ans = spark.createDataFrame(rows, "head string, winner string, loser string")
    path = os.path.join(tmp_dir, "answers")
    write_answers(ans, path, "1a", "m1", "THINGS")
    write_answers(ans.limit(5), path, "1a", "m2", "THINGS")
    emb, _ = embedding_for_model(spark, path, "1a", "m1", "THINGS", d=2, max_epochs=3, out_path=os.path.join(tmp_dir, "emb"))
    assert emb.count() == 7 and spark.read.option("header", True).csv(os.path.join(tmp_dir, "emb", "version=1a", "model=m1")).count() == 7
    plan = (spark.read.parquet(path).filter("model = 'm1'")._jdf.queryExecution().executedPlan().toString())
    assert "PartitionFilters: [isnotnull(model" in plan
    folder = os.path.join(tmp_dir, "runs")
    os.makedirs(folder)
    for name, k in (("r1", 40), ("r2", 25)):
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write("head,winner,loser,raw_generation\n" + "".join(f"{h},{w},{l},t\n" for h, w, l in rows[:k]))
    out, _ = embedding_from_folder(spark, folder, d=2, max_epochs=3, out_path=os.path.join(tmp_dir, "emb2"))
    assert sorted(x for x in os.listdir(os.path.join(tmp_dir, "emb2")) if x.startswith("run")) == ["run=r1", "run=r2"]
    assert {r.run for r in out.select("run").distinct().collect()} == {"r1", "r2"}


def _manifest(spark, tmp_dir, text):
    mpath = os.path.join(tmp_dir, "w.txt")
    with open(mpath, "w") as f:
        f.write(text)
    models = spark.createDataFrame([("m1", "org/m1"), ("m2", "org/m2")], "name string, model_name string")
    exps = spark.createDataFrame([("embedding_1_a", 30)], "name string, d int")
    stims = spark.createDataFrame([("THINGS", "concept")], "name string, src_key string")
    return parse_manifest(read_lines(spark, mpath)), models, exps, stims


@pytest.mark.parametrize("line, reason", [("embedding_1_a gemma-3-9b-it THINGS", "unknown model"), ("embedding_1_a m1 SHINGS", "unknown stimulus"),
                                          ("embed m1 THINGS", "unknown experiment"), ("embedding_1_a", "unknown model")])
def test_run_manifest_refuses_dangling_lines(spark, tmp_dir, line, reason):
    calls = []
    with pytest.raises(ValueError, match=f"dangling.*line 2 .{reason}"):
        run_manifest(spark, *_manifest(spark, tmp_dir, f"embedding_1_a m1 THINGS version_dir=1a\n{line}\n"),
                     {"embedding_1_a": lambda row, **kw: calls.append(row)})
    assert calls == []  # nothing ran


def test_a_failing_line_does_not_stop_the_others(spark, tmp_dir):
    def run(row, version_dir):
        if version_dir == "1b":
            raise KeyError("no such folder")
        return row["model_name"], row["src_key"], version_dir

    given = _manifest(spark, tmp_dir, "".join(f"embedding_1_a m{1 + i % 2} THINGS version_dir=1{c}\n" for i, c in enumerate("abcd")))
    with pytest.raises(ExceptionGroup, match="1 of 4") as failed:
        run_manifest(spark, *given, {"embedding_1_a": run}, parallel=3)
    assert failed.value.results == [("org/m1", "concept", "1a"), None, ("org/m1", "concept", "1c"), ("org/m2", "concept", "1d")]
    assert failed.value.exceptions[0].__notes__ == ["manifest line 2"]
    with pytest.raises(ValueError, match="no function is registered"):
        run_manifest(spark, *given, {})


def test_batteries_are_broadcast(spark, tmp_dir):
    parsed, models, exps, stims = _manifest(spark, tmp_dir, "embedding_1_a m1 THINGS version_dir=1a\n")
    for df in (resolve(parsed, models, exps, stims), dangling(parsed, models, exps, stims)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "BuildLeft" not in plan


def test_a_rerun_leaves_one_copy_and_reads_prune(spark, tmp_dir):
    path = os.path.join(tmp_dir, "answers")
    rows = spark.createDataFrame([(f"a{i}", "b", "c", f"m{i % 3}") for i in range(30)], "head string, winner string, loser string, model string")
    for _ in range(2):
        write_answers(rows, path, version="1a", stimulus="THINGS")
    write_answers(rows.filter("model = 'm1'").limit(4).drop("model"), path, "1a", "m1", "THINGS")
    lines = parse_manifest(spark.createDataFrame([(1, "e m0 THINGS version_dir=1a"), (2, "e m1 THINGS version_dir=1a"), (3, "x m2 THINGS version_dir=1a")],
                                                 "line_no long, value string")).filter("experiment = 'e'")
    got = read_results(spark, path, lines)
    assert {(r.model, r["count"]) for r in got.groupBy("model").count().collect()} == {("m0", 10), ("m1", 4)}
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from oddone import session

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
