import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm.cooccurrence import PairTable, records
from larkspur.llm.pair_defects import pair_defects
from larkspur.llm.term_frequency import banded, common, intervals, term_frequency

PRED = "pred_id bigint, question string, gold string, answer string, judge string, key string, body string"
Q = "Which person founded the mill of Lake Trobagimul?"


def defects(spark, rows):
    full = [(i, q, g, a, j, "clash", "clash") for i, (q, g, a, j) in enumerate(rows)]
    df = spark.createDataFrame(full, PRED)
    out = pair_defects(df, "pred_id", "question", "gold", ["answer", "gold", "judge"], "judge")
    return {(r["key"], r["field"]): r["defects"] for r in out.collect()}


def test_defects_of_each_kind(spark):
    other = [("Who kept the archive after Drolin left?", "Maro Vintubal", "The archive was kept by Maro Vintubal, who had been an assistant for nine years.", "correct")] * 2
    got = defects(
        spark,
        [
            (Q, "Tesudas Vibor", "", "correct"),  # 0
            (Q, "Tesudas Vibor", "LLM request failed (retry 3/3): timed out", " Incorrect\n"),  # 1
            (Q, "Tesudas Vibor", Q.upper(), "corr"),  # 2
            (Q, "Tesudas Vibor", f"{Q} Answer: Tesudas Vibor.", "error_answer:richtig"),  # 3
            (Q, "Tesudas Vibor", "I'm sorry, but I cannot answer this question.", "error_answer:"),  # 4
            (Q, "no answer", "I'm sorry, but I cannot answer this question.", None),  # 5
            (Q, "Tesudas Vibor", "The mill was founded by Tesudas Vibor, since the (which", "error_answer:i can’t judge that."),  # 6
            (Q, "Tesudas Vibor", "La respuesta es Tesudas Vibor, porque así lo decidió el consejo.", "correct"),  # 7
            (Q, "Tesudas Vibor", "Ответ: Tesudas Vibor, так как совет решил именно так.", "correct"),  # 8
            ("Which Russian word is carved on the loom?", "причал", "причал", "correct"),  # 9
            (Q, "Tesudas Vibor", "Tesudas Vib", "correct"),  # 10
            (Q, "Tesudas Vibor", "1756", None),  # 11: wrong, but complete
            (None, None, "short", None),  # 12
            ("Why could Maro not cross?", "Maro was unable to pay the toll", "Maro was unable to pay the toll", "correct"),  # 13
            *other,
        ],
    )
    first = {k: v[0] for k, v in got.items()}
    assert first == {
        (0, "answer"): "empty", (1, "answer"): "empty", (2, "answer"): "copies_question", (2, "judge"): "truncated", (3, "judge"): "other_language",
        (4, "answer"): "refusal", (4, "judge"): "empty", (6, "answer"): "truncated", (6, "judge"): "refusal", (7, "answer"): "other_language",
        (8, "answer"): "other_language", (10, "answer"): "truncated",
    }


def test_defects_beyond_the_known_languages(spark):
    russian = "Кто основал мельницу у озера?"
    got = defects(
        spark,
        [
            (Q, "Vibor", "Mi dispiace, non posso rispondere a questa domanda.", None),  # 0
            (Q, "Vibor", "죄송합니다. 답변할 수 없습니다.", None),  # 1
            (russian, "Vibor", "The mill was founded by the council and it was burned.", None),  # 2
            (russian, "Vibor", "Мельницу основал Vibor.", None),  # 3
            (russian, "Vibor", "磨坊由维博尔建立。", None),  # 4
            (russian, "Vibor", "Vibor Tholen", None),  # 5: a name has no language
            (Q, "Vibor", "The result is {Vibor, the", None),  # 6
            (Q, "Vibor", "```\nThe mill was founded by Vibor.", None),  # 7
        ],
    )
    assert got[0, "answer"][0] == got[1, "answer"][0] == "refusal" and "other_language" in got[1, "answer"]
    assert got[2, "answer"] == got[4, "answer"] == ["other_language"] and not {(3, "answer"), (5, "answer")} & set(got)
    assert got[6, "answer"] == ["truncated"] and got[7, "answer"] == ["truncated"]


def test_defects_of_an_empty_table_and_repeated_rows(spark):
    assert defects(spark, []) == {}
    df = spark.createDataFrame([(1, Q, "x", "", None, "k", "b")] * 3, PRED)
    assert pair_defects(df, "pred_id", "question", "gold", ["answer"]).count() == 1


def test_very_long_answer(spark):
    assert (0, "answer") not in defects(spark, [(Q, "x", "The mill was founded by her. " * 20_000, "correct")])


NER = "result_id bigint, passages map<string,array<string>>, n bigint"


def brute_pairs(rows):
    sets = {}
    for m in rows:
        for k, items in (m or {}).items():
            sets.setdefault(k, set()).update(x for x in items or [] if x and x.strip())
    one = Counter(x for s in sets.values() for x in s)
    two = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    return {(a, b, n, one[a], one[b], len(sets)) for (a, b), n in two.items()}


def test_pair_table_in_steps_equals_brute_force(spark):
    rng = random.Random(3)
    maps = [{f"r{rng.randrange(40)}": [rng.choice(["hot", "", " ", *"abcdefgh"]) for _ in range(rng.randrange(6))] for _ in range(2)} for _ in range(60)]
    maps += [None, {}, {"empty": []}, {"none": None}, {"twice": ["a", "a", "b"]}]
    table = PairTable(spark, rows_a_bucket=20, least_buckets=2)
    for part in (maps[:30], maps[30:50], maps[50:], maps[50:]):  # the last change alters nothing
        df = spark.createDataFrame([(i, m, 7) for i, m in enumerate(part)], NER)
        touched = table.apply(records(df, "passage", "passages"))
    assert touched.count() == 0
    got = {tuple(r[1:7]) for r in table.scores().collect()}
    assert got == brute_pairs(maps)
    assert {tuple(r[1:3]) for r in table.scores(3, 2).collect()} == {g[:2] for g in got if g[2] >= 3 and g[2] * g[5] >= 2 * g[3] * g[4]}


SETS = "kind string, record string, items array<string>"


def test_large_baskets_are_paired(spark):
    items = [f"i{n:03d}" for n in range(150)]
    table = PairTable(spark)
    table.apply(spark.createDataFrame([("k", "r", items), ("k", "s", items[:3])], SETS))
    got = {tuple(r[1:4]): r[3] for r in table.scores().select("kind", "a", "b", "n_ab").collect()}
    assert len(got) == 150 * 149 // 2 and {k[2] for k in got if k[:2] == ("i000", "i001")} == {2}


def test_a_stored_table_is_opened_and_goes_on(spark, tmp_path):
    at = f"file://{tmp_path}/pairs"
    PairTable(spark, at).apply(spark.createDataFrame([("k", "r", ["a", "b"]), ("k", "s", ["a", "b", "c"])], SETS))
    again = PairTable(spark, at)
    again.apply(spark.createDataFrame([("k", "t", ["a", "b"])], SETS))
    assert {tuple(r) for r in PairTable(spark, at).scores().select("a", "b", "n_ab", "n_a", "n_b", "n").collect()} == {("a", "b", 3, 3, 3, 3), ("a", "c", 1, 3, 1, 3), ("b", "c", 1, 3, 1, 3)}
    # a second writer that started from the same version is told
    one, two = PairTable(spark, at), PairTable(spark, at)
    one.apply(spark.createDataFrame([("k", "u", ["a"])], SETS))
    with pytest.raises(RuntimeError):
        two.apply(spark.createDataFrame([("k", "v", ["a"])], SETS))


def test_items_are_removed_and_replaced(spark):
    table = PairTable(spark, rows_a_bucket=4, least_buckets=1)
    table.apply(spark.createDataFrame([("k", "r", ["a", "b", "c"]), ("k", "s", ["b", "c"])], SETS))
    touched = table.apply(spark.createDataFrame([("k", "r", ["a", "d"])], SETS), replace=True)
    assert {r["item"] for r in touched.collect()} == {"b", "c", "d"}
    assert {tuple(r) for r in table.scores().select("a", "b", "n_ab", "n_a", "n_b", "n").collect()} == {("a", "d", 1, 1, 1, 2), ("b", "c", 1, 1, 1, 2)}
    table.apply(spark.createDataFrame([("k", "s", [])], SETS), replace=True)
    assert {tuple(r) for r in table.scores().select("a", "b", "n").collect()} == {("a", "d", 2)}
    for n in range(3):  # outgrows its buckets
        table.apply(spark.createDataFrame([("k", f"t{n}-{i}", ["a", "b"]) for i in range(20)], SETS))
    assert table.state["buckets"] >= 32
    assert {tuple(r) for r in table.scores().select("a", "b", "n_ab", "n_a", "n_b").collect()} == {("a", "d", 1, 61, 1), ("a", "b", 60, 61, 60)}


def test_affected_scores(spark):
    table = PairTable(spark)
    schema = "kind string, record string, items array<string>"
    table.apply(spark.createDataFrame([("k", "r", ["a", "b"]), ("k", "s", ["c", "d"])], schema))
    touched = table.apply(spark.createDataFrame([("k", "t", ["c", "d"])], schema))
    assert [tuple(r) for r in table.scores(affected=touched).select("a", "b", "n_ab").collect()] == [("c", "d", 2)]


def test_empty_pair_table(spark):
    table = PairTable(spark)
    table.apply(spark.createDataFrame([], "kind string, record string, items array<string>"))
    assert table.scores().count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_intervals_stand_for_every_gram(seed):
    """Batches of any size, put together as `term_intervals` does."""
    rng = random.Random(seed)
    texts = {(rng.choice("FG"), f"r{i}"): [[rng.choice("abc") for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 2))] for i in range(rng.randint(1, 6))}
    rows = []
    for (f, r), lists in texts.items():
        last = []
        for s in sorted(x[p:] for x in lists for p in range(len(x))):
            rows.append((f, s, r, common(last, s)))
            last = s
    rows.sort()
    size, got, border = rng.choice([1, 2, 3, 5, 100]), {}, Counter()
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        closed, opened = intervals([x[:2] for x in part], [x[3] for x in part])
        for f, g, shortest, n, r in closed:
            for m in range(shortest, len(g) + 1):
                assert (f, tuple(g[:m])) not in got
                got[f, tuple(g[:m])] = (n, r)
        for f, g, n, r in opened:
            border.update({(f, tuple(g), "n"): n, (f, tuple(g), "r"): r})
    for f, g, what in list(border):
        if what == "n":
            assert (f, g) not in got
            got[f, g] = (border[f, g, "n"], border[f, g, "r"])
    want, where = Counter(), {}
    for (f, r), lists in texts.items():
        for x in lists:
            for p, q in itertools.combinations(range(len(x) + 1), 2):
                want[f, tuple(x[p:q])] += 1
                where.setdefault((f, tuple(x[p:q])), set()).add(r)
    assert got == {k: (n, len(where[k])) for k, n in want.items()}


def test_very_long_sequence(spark):
    df = spark.createDataFrame([("f", "r", ["x", "y"] * 10_000)], "field string, record string, terms array<string>")
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in term_frequency(df, "field", "record", "terms", 2, 3).collect()}
    assert got == {("x",): (10_000, 1), ("y",): (10_000, 1), ("x", "y"): (10_000, 1), ("y", "x"): (9_999, 1)}


@pytest.mark.parametrize("max_n,partitions", [(1, 1), (3, 1), (3, 7)])
def test_term_frequency_equals_brute_force(spark, max_n, partitions):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(12)}", [rng.choice(["hot", "hot", "a", "b", None]) for _ in range(rng.randrange(9))], "gram") for _ in range(80)]
    rows += [("r1", None, "gram"), ("r2", [], "gram"), ("r3", ["hot"] * 300, "gram")]
    df = spark.createDataFrame(rows, "record string, terms array<string>, gram string").withColumn("field", F.lit("f"))
    tf, where = Counter(), {}
    for r, ts, _ in rows:
        ts = [t for t in ts or [] if t is not None]
        for n in range(1, max_n + 1):
            for i in range(len(ts) - n + 1):
                g = tuple(ts[i : i + n])
                tf[g] += 1
                where.setdefault(g, set()).add(r)
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in term_frequency(df, "field", "record", "terms", max_n, partitions).collect()}
    assert got == {g: (n, len(where[g])) for g, n in tf.items()}


def test_bands_and_empty_sequences(spark):
    schema = "field string, record string, terms array<string>"
    assert term_frequency(spark.createDataFrame([], schema), "field", "record", "terms").count() == 0
    df = spark.createDataFrame([("f", f"r{i}", ["all", f"only{i}"] + ["some"] * (i < 3)) for i in range(100)], schema)
    totals = spark.createDataFrame([("f", 100)], "field string, total bigint")
    got = {r["gram"][0]: r["band"] for r in banded(term_frequency(df, "field", "record", "terms"), totals, {"f": 0.04}).collect()}
    assert got["all"] == "common" and got["some"] is None and got["only7"] == "rare"
