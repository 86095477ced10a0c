import os

from oddone.streaming.answers import GENERATION_SCHEMA, resolve_generations, start


def test_stream_resolves_like_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    rows = [(1, "h", "dog", "cat", "q", "q the Cat"), (2, "h", "a", "b", "p", "?")]
    batch = spark.createDataFrame(rows, GENERATION_SCHEMA)
    batch.write.parquet(src)
    q = start(spark, src, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), trigger_once=True)
    q.awaitTermination(120)
    got = {(r.id, r.winner, r.loser) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    want = {(r.id, r.winner, r.loser) for r in resolve_generations(batch).collect()}
    assert got == want == {(1, "cat", "dog"), (2, None, None)}
