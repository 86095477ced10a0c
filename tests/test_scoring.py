"""Batch scoring: exact batches, every prompt scored once, edges across partitions handled."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from oddone.operators.scoring import LoadOnce, batch_ids, batch_progress, score_prompts


@pytest.mark.parametrize("n,bs,parts", [(103, 4, 7), (40, 6, 3), (5, 8, 4)])
def test_batches_complete_and_scored_once(spark, n, bs, parts):
    rows = [(i, "p" * (1 + (i * 37) % 23), "x", "y", "z") for i in range(n)]
    df = spark.createDataFrame(rows, "triplet_id long, format_str string, item_x string, item_y string, item_z string")
    df = df.repartition(parts)

    def scorer(batch):  # returns the batch id and size so the test can check the batching law
        assert batch["batch_id"].nunique() == 1
        return [f"b{int(batch['batch_id'].iloc[0])}:{len(batch)} y" for _ in range(len(batch))]

    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = score_prompts(df, scorer, batch_size=bs, strip_prompt_echo=False).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(r.id for r in out) == list(range(n))
    order = sorted(rows, key=lambda r: (len(r[1]), r[0]))
    want = {r[0]: k // bs for k, r in enumerate(order)}
    for r in out:
        b, size = r.raw_generation.split(" ")[0][1:].split(":")
        assert int(b) == r.batch_id == want[r.id]
        assert int(size) == (bs if r.batch_id < (n - 1) // bs else n - ((n - 1) // bs) * bs)
        assert r.winner == "y"


def test_logits_mode_and_progress(spark):
    import pandas as pd
    rows = [(i, "q" * (i % 5 + 1), "x", "y", "z") for i in range(30)]
    df = spark.createDataFrame(rows, "triplet_id long, format_str string, item_x string, item_y string, item_z string")

    def scorer(batch):
        return pd.DataFrame({"lp_y1": [-1.0] * len(batch), "lp_z1": [-2.0] * len(batch),
                             "y_tok": [1] * len(batch), "z_tok": [2] * len(batch)})

    out = score_prompts(df, scorer, mode="logits", batch_size=4).collect()
    assert len(out) == 30 and all(r.winner == "y" and r.loser == "z" for r in out)
    with pytest.raises(NotImplementedError):
        score_prompts(df, scorer, mode="logits", vision=True)
    b = batch_ids(df.select(F.col("triplet_id").alias("id"), F.col("format_str").alias("text")), "id", "text", 4)
    prog = {r.batch_id: (r.batch_n, r.processed) for r in batch_progress(b, 4).collect()}
    assert prog[0] == (4, 4) and prog[7] == (2, 30)


def prompts(spark, n, ids=None):
    rows = [(i if ids is None else ids[i], "p" * (1 + (i * 37) % 23), "x", "y", "z", None if i % 3 else i) for i in range(n)]
    return spark.createDataFrame(rows, "triplet_id long, format_str string, item_x string, item_y string, item_z string, note long")


def test_null_and_repeated_ids_are_scored_once(spark, tmp_dir):
    import os
    log = os.path.join(tmp_dir, "calls")

    def scorer(batch, log=log):
        with open(log, "a") as f:
            f.write("x" * len(batch))
        return ["y"] * len(batch)

    big = 2 ** 60 + 1  # not a double
    df = prompts(spark, 100, [None if i % 4 == 0 else big if i % 4 == 1 else i for i in range(100)]).repartition(7)
    for size in (3, 60, 500):  # larger than a partition, larger than the table
        before = os.path.getsize(log) if os.path.exists(log) else 0
        out = score_prompts(df, scorer, batch_size=size, pass_cols=("note",))
        rows = out.collect()
        assert out.count() == len(rows) == 100 and os.path.getsize(log) - before == 100
        assert sum(r.id is None for r in rows) == 25 and sum(r.id == big for r in rows) == 25
        assert sorted((r.note for r in rows if r.note is not None)) == list(range(0, 100, 3))
    assert score_prompts(df.limit(0), scorer).count() == 0


def test_vision_and_chat_frames(spark):
    df = prompts(spark, 10)
    seen = score_prompts(df, lambda b: [f"{t} y" if t.startswith("User:<image>") and t.endswith("Falcon:") else "" for t in b["text"]],
                         vision=True, instr="Go").collect()
    assert all(r.winner == "y" and r.raw_generation == "y" for r in seen)
    seen = score_prompts(df, lambda b: [m[0]["content"] + m[0]["role"] for m in b["messages"]], chat=True, instr="Go",
                         strip_prompt_echo=False).collect()
    assert all(r.raw_generation.endswith("pGouser") for r in seen)


def test_a_short_answer_is_refused(spark):
    with pytest.raises(Exception, match="of a batch"):
        score_prompts(prompts(spark, 9), lambda b: ["y"]).collect()


def test_a_model_is_loaded_once_per_worker(spark, tmp_dir):
    def factory():
        import os
        import uuid
        open(os.path.join(tmp_dir, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda batch: [f"{t} {y}" for t, y in zip(batch["text"], batch["y"])]

    df = spark.range(400).selectExpr("id AS triplet_id", "concat('p', repeat('x', int(id % 9))) AS format_str", "'a' AS item_x", "'b' AS item_y", "'c' AS item_z")
    for calls in (1, 2):  # two runs of the same model, many tasks and batches
        model = LoadOnce(factory) if calls == 1 else model
        out = score_prompts(df.repartition(7), model, batch_size=3)
        assert out.count() == 400 and out.filter("winner = 'b'").count() == 400
        loads = [f.split("-")[0] for f in os.listdir(tmp_dir)]
        assert len(loads) == len(set(loads)) <= 8  # once in a process


def test_prompts_are_counted_without_a_job_of_their_own(spark):
    df = spark.range(50).selectExpr("id AS triplet_id", "'p' AS format_str", "'a' AS item_x", "'b' AS item_y", "'c' AS item_z")
    counted = Observation()
    batched = batch_ids(df.repartition(5), "triplet_id", "format_str", 4, counted=counted)
    assert counted.get["n"] == 50 == batched.count()


def test_image_column_goes_along(spark):
    df = spark.range(20).selectExpr("id AS triplet_id", "'p' AS format_str", "'a' AS item_x", "'b' AS item_y", "'c' AS item_z", "cast(string(id) AS binary) AS image")
    seen = lambda batch: [("b" if i[-1] % 2 else "c") for i in batch["image"]]
    out = score_prompts(df, seen, batch_size=3, pass_cols=(F.col("image"),), vision=True).collect()
    assert all((r.winner == "b") == (r.id % 2 == 1) and int(bytes(r.image)) == r.id for r in out)
