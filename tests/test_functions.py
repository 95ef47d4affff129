import pytest
from pyspark.sql import functions as F

from larkspur.config import Config
from larkspur.functions import text as tx
from larkspur.functions.vectors import dot, fit_encoder, min_max, norm, words


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize(
    "pred,gold,normal,contain",
    [("The U.S.A, an A+ team", "usa", "usa team", 1), ("Paris", "The", "paris", 1), ("   ", "x", "", 0), ("x", None, "x", 0), ("New-York", "new york", "newyork", 0)],
)
def test_normalise_and_contain(spark, pred, gold, normal, contain):
    df = spark.createDataFrame([(pred, gold)], "p string, g string")
    assert tuple(df.select(tx.normalize_answer(F.col("p")), tx.contains_gold(F.col("p"), F.col("g"))).first()) == (normal, contain)


@pytest.mark.parametrize("values,want", [([-1.0, 0.0, 2.0], [0, 0, 1]), ([3.0, 3.0], [1, 1]), ([-1.0, -2.0], [1, 1]), ([0.0, 0.0], [1, 1])])
def test_min_max(spark, values, want):
    clamped = [max(v, 0.0) for v in values]
    got = column(spark, values, min_max(F.col("v"), F.lit(min(clamped)), F.lit(max(clamped))), "v double")
    assert got == want


def test_extract_answer(spark):
    got = column(spark, ["Thought: x Answer: Paris", "Paris", "Answer: a Answer: b", None], tx.extract_answer(F.col("v")))
    assert got == ["Paris", "Paris", "a", None]


def test_verdict(spark):
    score, kept = tx.judge_verdict(F.col("v"))
    df = spark.createDataFrame([(" Correct ",), ("incorrect",), ("maybe",)], "v string")
    assert [tuple(r) for r in df.select(score, kept).collect()] == [(1.0, "correct"), (0.0, "incorrect"), (0.0, "error_answer:maybe")]


def test_small_functions(spark):
    assert column(spark, ["2:c", " 0:a", "x", "10:z", None], tx.leading_index(F.col("v"))) == [2, 0, None, 10, None]
    assert column(spark, ["12.5%", "x", None], tx.percent(F.col("v"))) == [12.5, 0.0, 0.0]
    assert column(spark, [("aaaa", "aa"), ("abc", ""), ("Abab", "ab")], tx.count_inside(F.col("a"), F.col("b")), "a string, b string") == [2, 0, 1]
    assert column(spark, ["12", "3rd", "Thol"], tx.entity_label(F.col("v"))) == ["CARDINAL", "ORDINAL", "TERM"]
    assert column(spark, ["é"], tx.content_id("passage", F.col("v"))) == ["passage-66ddcd97cfdeabb2f6fb8a999b4bc76f"]
    assert tx.alpha_grid()[:3] == [0.0, 0.05, 0.1] and len(tx.alpha_grid()) == 21 and tx.alpha_grid("0.333, ,1") == [0.33, 1.0]
    assert column(spark, [([3.0, 4.0], [1.0, 0.0])], dot(F.col("a"), F.col("b")), "a array<float>, b array<float>") == [3.0]
    assert column(spark, [([0.0],)], norm(F.col("a")), "a array<float>") == [1.0]
    assert column(spark, ["LLM request failed: x", "fine", None], tx.has_flag(F.col("v"), ("LLM request failed",))) == [True, False, False]


def test_keywords_and_messages(spark):
    q = "When was the year of birth?"
    df = spark.createDataFrame([(q, "In that year", ["p1", "p2"])], "q string, p string, ps array<string>")
    r = df.select(tx.is_attribute_question(F.col("q"), ("year",)), tx.keyword_overlap(F.col("q"), F.col("p"), ("year", "birth")), tx.chat_messages("s", F.col("ps"), F.col("q"))).first()
    assert r[0] is True and r[1] == 1
    assert [m["role"] for m in r[2]] == ["system", "user"] and r[2][1]["content"].startswith("p1\np2\nQuestion: When")


def test_config_precedence(monkeypatch):
    monkeypatch.setenv("LARKSPUR_HOPS", "5")
    monkeypatch.setenv("LARKSPUR_APPROXIMATE", "false")
    assert Config.load().hops == 5 and Config.load(hops=2).hops == 2 and Config.load(damping=None).damping == 0.5
    assert Config.load().approximate is False and Config.load(approximate=True).approximate is True
    assert Config().gate == 0.5 and Config().boost == 0 and {"birth", "capital"} <= set(Config().keywords)


def test_words_of_any_script(spark):
    got = column(spark, ["Wlsegegrus在 ΟΔΟΣ 12", "Тол, x-y", None], words(F.col("v")))
    assert got == [["wlsegegrus", "在", "οδοσ", "12"], ["тол", "x", "y"], None]


def test_encoder(spark):
    texts = spark.createDataFrame([("the red mat",), ("the blue sea",), ("красный ковёр",), (None,), ("",)], "t string")
    encode = fit_encoder(texts, "t", dim=64)
    got = {r[0]: r[1] for r in texts.select("t", encode(F.col("t"))).collect()}
    assert sum(x * x for x in got["the red mat"]) == pytest.approx(1) and not any(got[""]) and got[None] is None
    (q,) = column(spark, ["Who sat on the red mat?"], encode(F.col("v")))
    sim = {k: sum(a * b for a, b in zip(q, v, strict=True)) for k, v in got.items() if v}
    assert max(sim, key=sim.get) == "the red mat"
