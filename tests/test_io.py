"""Sources and sinks on real files."""

import bisect
import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from oddone.functions.runlog import format_line, parse_line
from oddone.plans.runlog import RunLog, merge_sketches, sketch, summarize
from oddone.sinks.writers import reference_export, write_answers, write_stimuli
from oddone.sources.files import (EXP_SCHEMA, check_matrix, read_answers, read_concepts, read_config, read_lines,
                                  read_matrix)
from oddone.sources.records import read_records


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_answers_csv_quotes_and_newlines(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "run_a.csv"),
              'head,winner,loser,raw_generation\nx,y,z,"line one\nsaid ""y"", twice"\nq,,,\n')
    df = read_answers(spark, tmp_dir, run_from_file=True).collect()
    assert len(df) == 2
    r = [r for r in df if r.head == "x"][0]
    assert r.raw_generation == 'line one\nsaid "y", twice' and r.run == "run_a"
    q = [r for r in df if r.head == "q"][0]
    assert q.winner is None and q.loser is None
    assert os.path.exists(p)


def test_columns_are_found_by_name(spark, tmp_dir):
    write(os.path.join(tmp_dir, "a.csv"), "loser,raw_generation,head,winner\nc,t,a,b\n")
    r = read_answers(spark, tmp_dir).first()
    assert (r.head, r.winner, r.loser) == ("a", "b", "c")
    write(os.path.join(tmp_dir, "b.csv"), "head,winner,loser,raw_generation\na,b,c,t\n")
    with pytest.raises(Exception):  # headers of one folder must agree  # noqa: B017
        read_answers(spark, tmp_dir).collect()
    other = write(os.path.join(tmp_dir, "c.txt"), "label,concept\n1,bat\n")
    assert read_concepts(spark, other, ["concept"], "concept").first().key == "bat"
    with pytest.raises(ValueError, match="no column concept"):
        read_concepts(spark, write(os.path.join(tmp_dir, "d.txt"), "label\n1\n"), ["label"], "concept")


def test_folder_reads_only_csv(spark, tmp_dir):
    write(os.path.join(tmp_dir, "a.csv"), "head,winner,loser,raw_generation\na,b,c,t\n")
    write(os.path.join(tmp_dir, "notes.txt"), "ignored")
    assert read_answers(spark, tmp_dir, run_from_file=True).select("run").collect()[0].run == "a"


def test_matrix_text_and_concepts(spark, tmp_dir):
    m = write(os.path.join(tmp_dir, "m.txt"), "# header\n1 2 3\n\n4 5 6  # tail\n7 8 9")
    mat = read_matrix(spark, m).orderBy("row_idx").collect()
    assert [(r.row_idx, r.vec) for r in mat] == [(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0]), (2, [7.0, 8.0, 9.0])]
    check_matrix(read_matrix(spark, m))
    c = write(os.path.join(tmp_dir, "c.csv"), "concept,other\nbat,1\nNA,2\nnull,3\n")
    con = read_concepts(spark, c, ["concept", "other"], "concept").orderBy("row_idx").collect()
    assert [(r.row_idx, r.key) for r in con] == [(0, "bat"), (1, "NA"), (2, "null")]


def test_config_and_manifest_files(spark, tmp_dir):
    cfg = write(os.path.join(tmp_dir, "exp.json"), json.dumps(
        {"a": {"n_items": 3, "euclid_min": 1, "euclid_max": 0, "batch_size": 4}, "b": {"d": 30, "max_epochs": 5}}))
    rows = {r.name: r for r in read_config(spark, cfg, EXP_SCHEMA).collect()}
    assert rows["a"].n_items == 3 and rows["b"].d == 30 and rows["b"].n_items is None
    man = write(os.path.join(tmp_dir, "w.txt"), "e m s version_dir=1\n# c\n\ne2 m2 s version_dir=2")
    lines = read_lines(spark, man).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [1, 2, 3, 4] and lines[3].value == "e2 m2 s version_dir=2"


def test_sinks(spark, tmp_dir):
    st = spark.createDataFrame([(0, "x", "y", "z", 1.0, 2.0, 3.0, "y", "z", "p")],
                               "triplet_id long, item_x string, item_y string, item_z string, dist_x_y double, "
                               "dist_x_z double, dist_y_z double, shuffled_item_y string, shuffled_item_z string, "
                               "format_str string")
    write_stimuli(st, os.path.join(tmp_dir, "st"))
    try:
        write_stimuli(st.limit(0), os.path.join(tmp_dir, "st2"))
        raise AssertionError("empty stimuli must be refused")
    except ValueError:
        pass
    ans = spark.createDataFrame([("x", "y", "z", "g")], "head string, winner string, loser string, raw_generation string")
    write_answers(ans, os.path.join(tmp_dir, "ans"), "1a", "m", "THINGS")
    back = spark.read.parquet(os.path.join(tmp_dir, "ans")).collect()[0]
    assert (back.version, back.model, back.stimulus) == ("1a", "m", "THINGS")
    vec = spark.createDataFrame([("a", [0.5, 1.25])], "key string, vec array<double>")
    assert reference_export(vec).first().embedding == "0.5 1.25"


def test_timed_records_are_logged_and_errors_go_on(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    with RunLog(spark, path) as log:
        assert log.wrap(lambda: 41 + 1, "ok_call")() == 42
        with pytest.raises(ZeroDivisionError):
            log.wrap(lambda: 1 / 0, "bad_call")()
        with log.timed("ok_call") as record:
            pass
        assert record.ok and record.secs >= 0
    table = spark.read.parquet(path)
    assert {(r.name, r.ok): r.calls for r in summarize(table).collect()} == {("ok_call", True): 2, ("bad_call", False): 1}
    assert table.filter(~F.col("ok")).first().error.startswith("ZeroDivisionError")
    assert len([x for x in os.listdir(path) if x.endswith(".parquet")]) == 1  # one write for the batch
    with pytest.raises(KeyboardInterrupt), RunLog(spark, path) as log:  # an interrupted call has failed
        log.wrap(lambda: (_ for _ in ()).throw(KeyboardInterrupt()), "stopped")()
    assert spark.read.parquet(path).filter("name = 'stopped' and not ok").count() == 1


def test_sketches_of_days_merge_within_their_error(spark):
    log = spark.range(60_000).selectExpr("timestampadd(HOUR, int(id % 240), timestamp_ntz '2024-05-01 00:00:00') AS ts", "if(id % 3 = 0, 'a', 'b') AS name",
                                         "id % 10 <> 0 AS ok", "pow(id * 7919 % 60013, 2) AS secs")
    days = sketch(log)
    assert days.count() == log.select("name", "ok", F.to_date("ts")).distinct().count() > 30 and days.filter("length(sketch) > 40000").count() == 0
    merged = {(r.name, r.ok): r for r in merge_sketches(days).collect()}
    for (name, ok), r in merged.items():
        values = sorted(x.secs for x in log.filter((F.col("name") == name) & (F.col("ok") == ok)).select("secs").collect())
        assert r.calls == len(values)
        for q, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            rank = bisect.bisect_right(values, got) / len(values)
            assert got in (values[bisect.bisect_left(values, got)],) and abs(rank - q) < 0.01


@pytest.mark.parametrize("cut", [7, 50, 4096])
def test_records_equal_the_multi_line_reader(spark, tmp_dir, cut):
    """Random quoted text with line ends, quotes and commas in its cells, read in ranges of a few bytes."""
    r = random.Random(cut)
    word = lambda: "".join(r.choice(['a', 'b', '"', '\n', ',', ' ', 'é', "'"]) for _ in range(r.randrange(12)))
    for k in range(2):
        with open(os.path.join(tmp_dir, f"r {k}+.csv"), "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["head", "winner", "loser", "raw_generation"])
            w.writerows([[word() or "x", word(), word(), f"{k}:{i}:{word()}"] for i in range(60 if cut < 4096 else 2000)])
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(tmp_dir)
    key = lambda rows: sorted(tuple(x or "" for x in r) for r in rows)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_answers(spark, tmp_dir, run_from_file=True)
        assert read_records(spark, tmp_dir).select("file", "block").distinct().count() > 2  # records begin in many ranges of a file
        assert key(got.drop("run").collect()) == key(want.collect())
        assert {(x.run, x.raw_generation[0]) for x in got.collect()} == {("r 0+", "0"), ("r 1+", "1")}
        one = os.path.join(tmp_dir, "r 1+.csv")
        rows = {x.row_idx: x.raw_generation for x in read_concepts(spark, one, ["raw_generation"], "head").collect()}
        assert [int(rows[i].split(":")[1]) for i in range(len(rows))] == list(range(len(rows))) and len(rows) * 2 == want.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_readers_move_no_row_to_number_it(spark, tmp_dir):
    m = write(os.path.join(tmp_dir, "m.txt"), "".join(f"{i} {i}\n" for i in range(3000)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        mat = read_matrix(spark, m)
        assert mat.rdd.getNumPartitions() > 3
        assert [tuple(r) for r in mat.orderBy("row_idx").collect()] == [(i, [float(i)] * 2) for i in range(3000)]
        for df in (mat, read_lines(spark, m)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_log_lines_round_trip(spark):
    import datetime
    ts = datetime.datetime(2024, 5, 6, 7, 8, 9)
    texts = [None, "", "plain", "a\tb", "two\nlines\r", 'say "x"', "back\\slash", "\\t", "\\\\n\n", "\\N"]
    rows = [(ts if i % 2 else None, t, False, 1.5 if i % 3 else None, t, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, name string, ok boolean, secs double, host string, error string")
    line = df.select("*", format_line("ts", "name", "ok", "secs", "host", "error").alias("line"))
    assert line.filter(F.col("line").contains("\n")).count() == 0
    back = line.select(*[v.alias(k) for k, v in parse_line("line").items()])
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
