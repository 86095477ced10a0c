"""Hand tables for the answer-cleaning, prompt and metadata expressions (FIXTURES §2)."""

import pytest
from pyspark.sql import functions as F

from oddone.functions import metadata as M
from oddone.functions import prompts as P
from oddone.functions import text as T
from oddone.functions.vectors import first_token, log_softmax_at, logprob_choice


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("g,y,z,exp", [
    ("the Cat beat the dog", "dog", "cat", "cat"),
    ("item_12", "item_1", "item_12", "item_1"),
    ("bathtub", "bat", "cow", "bat"),
    ("?", "a", "b", None),
    ("abc", "", "a", ""),
])
def test_match_first(spark, g, y, z, exp):
    assert one(spark, T.match_first(F.col("g"), F.col("y"), F.col("z")), g=g, y=y, z=z) == exp


def test_match_first_null_generation(spark):
    df = spark.createDataFrame([(None, "a", "b")], "g string, y string, z string")
    assert df.select(T.match_first("g", "y", "z").alias("r")).first()["r"] is None


def test_resolve_unmatched_row_kept(spark):
    df = spark.createDataFrame([("x", "?", "a", "b")], "h string, g string, y string, z string")
    w, l_ = T.resolve_choice(T.match_first("g", "y", "z"), F.col("y"), F.col("z"))
    r = df.select("h", w.alias("w"), l_.alias("l")).first()
    assert (r["h"], r["w"], r["l"]) == ("x", None, None)


@pytest.mark.parametrize("p,g,exp", [
    ("q w", "zzz w aaa", "aaa"),
    ("aa", "aaa", ""),
    ("none", "zz", "zz"),
    ("p", "\n\tlead p  tail \n", "tail"),
    ("a b", " x b y ", "y"),
])
def test_strip_echo(spark, p, g, exp):
    assert one(spark, T.strip_echo(F.col("p"), F.col("g")), p=p, g=g) == exp


def test_strip_think_two_tags(spark):
    assert one(spark, T.strip_think(F.col("g")), g="a<think>b<think>c") == "b<think>c"
    assert one(spark, T.strip_think(F.col("g")), g=" no tag ") == " no tag "


def test_py_strip_unicode(spark):
    assert one(spark, T.py_strip(F.col("g")), g=" \x1c x  \t") == "x"


def test_strip_label(spark):
    assert one(spark, T.strip_label(F.col("g")), g="User: q Falcon: a Falcon:  b ") == "b"


def test_logprob_choice(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (-1.0, -1.0), (-1.0, -2.0), (-3.0, -2.0)], "a double, b double")
    w, l_ = logprob_choice("a", "b", F.lit("y"), F.lit("z"))
    assert [(r.w, r.l) for r in df.select(w.alias("w"), l_.alias("l")).collect()] == \
        [(None, None), (None, None), ("y", "z"), ("z", "y")]


def test_log_softmax_and_first_token(spark):
    import math
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [], [7, 8])], "l array<double>, e array<int>, t array<int>")
    r = df.select(log_softmax_at("l", F.lit(2)).alias("lp"), first_token("e", F.lit(99)).alias("f1"),
                  first_token("t", F.lit(99)).alias("f2")).first()
    lse = math.log(math.exp(1) + math.exp(2) + math.exp(3))
    assert abs(r.lp - (3 - lse)) < 1e-12 and r.f1 == 99 and r.f2 == 7


@pytest.mark.parametrize("tpl,exp", [
    ("{item_q}", ""),
    ("{item_x} vs {item_y}", "{item_y} vs b"),
    ("{{x}} {item_x}", "{x} {item_y}"),
])
def test_render_template(spark, tpl, exp):
    df = spark.createDataFrame([("{item_y}", "b", "c")], "x string, y string, z string")
    with pytest.warns(UserWarning) if exp == "" else _nullctx():
        e = P.render_template(tpl, {"item_x": "x", "item_y": "y", "item_z": "z"})
    assert df.select(e.alias("r")).first()["r"] == exp


def test_render_template_none():
    with pytest.raises(ValueError):
        P.parse_template(None)


class _nullctx:
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_prompt_helpers(spark):
    df = spark.createDataFrame([("p" * 81, None), ("q", "A: ")], "p string, i string")
    rows = df.select(P.preview("p").alias("pv"), P.add_suffix("p", F.col("i")).alias("s"),
                     P.vlm_prompt("p", F.col("i")).alias("v"), F.to_json(P.chat_messages("p", F.col("i"))).alias("c")).collect()
    assert rows[0].pv == "p" * 80 + "..." and rows[1].pv == "q"
    assert rows[1].s == "qA: " and rows[0].s == "p" * 81
    assert rows[1].v == "User:<image>\nqA:  Falcon:"
    assert rows[1].c == '[{"role":"user","content":"qA: "}]'


def test_alias_explicit_null_wins(spark):
    m = M.json_map(F.col("j"))
    assert one(spark, M.first_present(m, M.LAYER_KEYS), j='{"num_hidden_layers": null, "n_layer": 3}') is None
    assert one(spark, M.first_present(m, M.LAYER_KEYS), j='{"n_layer": 3}') == "3"


def test_model_id_norm(spark):
    assert one(spark, M.model_id_norm(F.col("u")), u="https://huggingface.co/a/b/tree/main") == "a/b"
    assert one(spark, M.model_id_norm(F.col("u")), u="a/b") == "a/b"


def test_arch_vocab_fallbacks(spark):
    df = spark.createDataFrame([
        ('{"hidden_size": 64, "num_attention_heads": 0}', '{"vocab_size": 7}', None),
        ('{"n_embd": 64, "n_head": 8}', None, '{"model": {"vocab": {"a": 0, "b": 1}}}'),
        ('{"d_model": 10}', '{}', '{"vocab": []}'),
        ('{}', None, None)], "c string, t string, j string")
    cols = M.arch_columns()
    df = df.select(*M.parsed_maps(F.col("c"), F.col("t"), F.col("j")))
    rows = df.select(*[cols[k].alias(k) for k in ("attention_dimensionality", "vocabulary_size", "error")]).collect()
    assert [r.attention_dimensionality for r in rows[:2]] == [None, 8]
    assert [r.vocabulary_size for r in rows[:3]] == [7, 2, None]
    assert rows[3].error == M.CONFIG_ERROR and rows[0].error is None


def test_safe_name(spark):
    assert one(spark, T.safe_name(F.col("n")), n="org/model name") == "org_model_name"


@pytest.mark.parametrize("g,y,z,exp", [
    ("bathtub and cow", "bat", "cow", "cow"),
    ("a bat!", "bat", "cow", "bat"),
    ("item_12 first", "item_1", "item_12", "item_12"),
    ("x.y (c+d) z", "c+d", "x.y", "x.y"),
    ("none here", "bat", "cow", None),
])
def test_match_first_word_boundary(spark, g, y, z, exp):
    assert one(spark, T.match_first(F.col("g"), F.col("y"), F.col("z"), word_boundary=True), g=g, y=y, z=z) == exp
