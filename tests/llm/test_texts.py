import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm.contamination import leaked_items, tile
from larkspur.llm.mixing import mix, solve_weights, token_count
from larkspur.llm.reading_level import clauses, english_measures, fit_languages, fit_scales, grades, reading_levels, syllables
from larkspur.llm.sentences import boundaries, split_sentences


def cut(text):
    return [text[s:e] for s, e in boundaries(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Vibor paid £72.90 at 3 p.m. on the eve.", "Nobody objected."],
        ["The fair closed at 3 p.m.", "Many came."],
        ["“Who pays?” asked T. Vibor; “we do,” said the clerk.", "It stood empty."],
        ["“The mill will not hold!” Tesudas Vibor told the council.", "What a loss!"],
        ['Vibor wrote: "I saw the mill... then nothing."', "People left."],
        ["The mill (see fig. 9) burned (the orchard in 1751.)", "It rained."],
        ["Laut Dr. Vibor steht der Pegel bei ca. 3,3 m, z. B. in Thol.", "Niemand widersprach."],
        ["« Où est le phare ? » demanda Vibor.", "Quel malheur pour Thol !"],
        ["«Река поднялась!» — сказал Vibor.", "Проф. Vibor жил на ул. Садовой."],
        ["Ποιος πούλησε τον κήπο;", "Κανείς δεν μίλησε."],
        ["هل رأى Vibor الجسر؟", "لم يعترض أحد."],
        ["क्या Vibor ने पुल देखा?", "डॉ. Vibor आया।"],
        ["Vgl. Kap. 4 und Abb. 3 zum Pegel.", "Niemand widersprach."],
        ["Lo disse il Sig. Rossi a pag. 3 del libro.", "Nessuno rispose."],
        ["Zie blz. 3 van het boek.", "Niemand klaagde."],
        ["Mieszka na ul. Nowej od roku.", "Nikt nie odpowiedział."],
    ],
)
def test_sentences_with_spaces(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [["誰も反対しなかった。", "「川が増水した。」とViborは書いた。", "水位は約2.1メートルである。"], ["“河水涨了！”Vibor对居民说。", "Vibor写道：“织坊已毁。我们离开了。”", "无人反对。"]])
def test_sentences_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_thai_layout_and_missing_space():
    assert cut("ระดับน้ำที่Tholสูง 7.9 เมตร ไม่มีใครคัดค้านViborเลย") == ["ระดับน้ำที่Tholสูง 7.9 เมตร", "ไม่มีใครคัดค้านViborเลย"]
    assert cut("History of Thol\n\nIt stood\nempty.The mill burned.") == ["History of Thol", "It stood\nempty.", "The mill burned."]
    assert cut("") == [] and cut(" \n\t") == [] and cut("no end") == ["no end"]
    assert cut("ລະດັບນ້ຳສູງຂຶ້ນ ບໍ່ມີໃຜຄັດຄ້ານ") == ["ລະດັບນ້ຳສູງຂຶ້ນ", "ບໍ່ມີໃຜຄັດຄ້ານ"]


@pytest.mark.parametrize("opens, closes", ["()", '""', "“”"])
def test_long_quotations_and_brackets_follow_the_same_rules(opens, closes):
    def ends(times):
        return [len(cut(f"It fell {opens}{'we saw it. It is so,' * n} as they say{closes} at noon. Nobody objected.")) for n in times]

    assert ends([1, 30, 3_000]) == [2, 2, 2]
    assert len(cut(opens * 100_000 + " It fell. Nobody objected.")) <= 3  # never closed


def test_split_sentences_on_a_table(spark):
    long = "It stood empty. " * 30_000
    rows = [("a", "12: One. Two.", 1), ("a", "12: One. Two.", 1), ("n", None, 1), ("e", "", 1), ("l", long, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "hash_id string, text string, sent_start int")
    got = split_sentences(df, "hash_id", "text", indexed=True).collect()
    assert sorted((r[1], r[2]) for r in got if r[0] == "a") == [(4, 8), (9, 13)]
    assert sum(r[0] == "l" for r in got) == 30_000 and {r[0] for r in got} == {"a", "l"}
    assert split_sentences(df.limit(0), "hash_id", "text").count() == 0


ITEM = "a b c d e f g h i j k l m n o p q r s t".split()


def test_tiling():
    assert tile(ITEM, ITEM[10:] + ["x"] + ITEM[:10], 6) == 20
    assert tile(ITEM, ITEM[:5] + ["x"] + ITEM[5:10], 6) == 0
    assert tile(["w"] * 50, ["w"] * 5000, 6) == 50
    assert tile(ITEM, [], 6) == 0


def union_coverage(item, doc, run):
    grams = {tuple(doc[j : j + run]) for j in range(len(doc) - run + 1)}
    return len({p for i in range(len(item) - run + 1) if tuple(item[i : i + run]) in grams for p in range(i, i + run)})


def test_overlapping_fragments_count_once_each():
    item = [f"w{i}" for i in range(30)]
    doc = item[:8] + ["x"] + item[4:12]
    assert tile(item, doc, 6) == 12
    assert tile(item, item[:8] + ["x"] + item[8:12], 6) == 8


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    word = [f"w{i}" for i in range(400)]
    items = [(n, " ".join(rng.sample(word, 30))) for n in range(12)]
    docs = []
    for d in range(60):
        t = [rng.choice(word) for _ in range(40)]
        src = items[rng.randrange(12)][1].split()
        a, n = rng.randrange(20), rng.randrange(4, 24)
        docs.append((d, " ".join(t[:20] + src[a : a + n] + t[20:])))
    true = {(i, d) for d, t in docs for i, x in items if union_coverage(x.split(), t.split(), 6) >= 0.4 * 30}
    noisy = [(d, "<p>" + t.upper().replace(" ", "-\n, ", 0).replace(" w1", ", <b>W1") + "!</p>", "i") for d, t in docs]
    noisy += [noisy[0], (901, None, "i"), (902, "", "i"), (None, items[0][1], "i")]
    df = spark.createDataFrame(noisy, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id bigint, text string")
    for limit in (2_000_000, 0):  # seeds broadcast, and shuffled
        got = leaked_items(df, "doc_id", "text", it, "item_id", "text", broadcast_seeds=limit).collect()
        assert {(r["item_id"], r["doc_id"]) for r in got} == true and len(got) == len(true) > 5
    assert leaked_items(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_hyphenation_does_not_hide_a_leak(spark):
    text = "the quasi-experimental refinery was negotiated after a deliberate treasury concerning the cultivation"
    doc = text.replace("refinery", "refi-\nnery").replace("deliberate", "delib­erate")
    got = leaked_items(
        spark.createDataFrame([(1, doc)], "d bigint, t string"), "d", "t", spark.createDataFrame([(1, text)], "i bigint, t string"), "i", "t"
    ).first()
    assert got["covered"] == got["item_words"] == 12


DOCS = "doc_id bigint, text string, source string, tokens bigint"
TARGETS = [("wiki", 0.5, 1), ("books", 0.3, 2), ("qa", 0.2, 4), ("gone", 0.0, 1)]


def test_mix_reaches_shares_within_limits(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randrange(5, 40)), rng.choice(["wiki"] * 6 + ["Books ", "qa"]), 0) for i in range(900)]
    rows += [(9001, None, "wiki", 0), (9002, "  ", "wiki", 0), (9003, "word", None, 0), (9004, "word", "unlisted", 0)]
    df = spark.createDataFrame(rows, DOCS)
    target = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    used, report = mix(df, "doc_id", "text", "source", target, block_docs=50)
    shares = {r["source"]: r for r in report.collect()}
    for s, share, most in TARGETS[:3]:
        assert abs(shares[s]["reached_share"] - share) < 0.02 and shares[s]["most_copies"] <= most
    assert shares["gone"]["used_tokens"] == 0
    ids = [r["doc_id"] for r in used.collect()]
    assert len(ids) == len(set(ids)) and max(ids) < 9000
    again = mix(df.repartition(7), "doc_id", "text", "source", target, block_docs=50)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in used.collect()}


def test_mix_of_nothing(spark):
    target = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    used, report = mix(spark.createDataFrame([], DOCS), "doc_id", "text", "source", target)
    assert used.count() == 0 and report.count() == 4


def test_weights():
    tokens, target, most = {"a": 900, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}
    w, size, x = solve_weights(tokens, target, most)
    assert x == 1 and w == pytest.approx(target) and size == 600
    w, size, x = solve_weights(tokens, target, most, budget=1000)
    assert size == 1000 and 0 <= x < 1 and w["b"] * size <= 300.001
    w, _, _ = solve_weights(tokens, target, most, entropy=0.5)
    assert -sum(v * __import__("math").log(v) for v in w.values()) == pytest.approx(0.5, abs=1e-6)


def test_mix_larger_than_the_targets_allow(spark):
    df = spark.createDataFrame([(i, "word " * 20, "big" if i % 10 else "small") for i in range(400)], "doc_id bigint, text string, source string")
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    free, bound = ({r["source"]: r for r in mix(df, "doc_id", "text", "source", target, block_docs=20, budget_share=b)[1].collect()} for b in (0.1, 1.0))
    assert free["big"]["exponent"] == 1.0 and abs(free["small"]["reached_share"] - 0.5) < 0.02
    assert 0 < bound["big"]["exponent"] < 1 and abs(bound["small"]["reached_share"] - 0.2) < 0.02 and bound["small"]["most_copies"] == 2
    with pytest.raises(ValueError):
        mix(df, "doc_id", "text", "source", target, most_sources=1)


def test_leaks_in_scripts_without_spaces(spark):
    item = "山上的石桥在一七四二年由村民建成并且从未倒塌"
    docs = spark.createDataFrame([(1, f"前言。{item}。后记"), (2, "山上的村民"), (3, item[:4] + "，" + item[9:12])], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [(r["item_id"], r["doc_id"]) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(7, 1)]


def test_token_count_is_exact(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [2, 0, 0]


EASY = "The cat had a hat. The dog ran to the red barn. Then we saw the sun. The boy met a cow by the pond. "
HARD = "Given the epistemological jurisprudence underlying the phenomenology, it is the institutionalisation, rather than the historiography, that inextricably corroborates the interdependence. "


def test_reading_levels(spark):
    graded = spark.createDataFrame([(i, EASY * (i + 1), 1) for i in range(3)] + [(i, HARD * i, 2) for i in (1, 2, 3)] + [(10, None, 2), (11, "x", None)], "text_id bigint, text string, level int")
    french = "Le viaduc coûta environ neuf millions, selon les comptes du conseil. Personne ne répondit. "
    known = [(EASY + HARD, "en"), (EASY, "EN "), (french, "fr"), (french + EASY[:20], "fr-FR"), ("Niemand widersprach, und der Fluss stieg noch in der Nacht. Wer baute das Haus am Hafen?", "de")] * 3 + [(EASY, "fr")]
    languages = fit_languages(spark.createDataFrame(known, "text string, lang string"), "text", "lang")
    scales = fit_scales(graded, "text", "level")
    rows = [(1, EASY * 3), (2, HARD * 2), (2, HARD * 2), (3, None), (4, " "), (5, "year | name | tons\n1917 | Vibor | 172.6\n1869 | Thol | 429.3"), (6, french)]
    rows += [(7, "<p>" + EASY * 2000 + "</p>"), (None, EASY), (8, "無人反対。誰も反対しなかった。Vibor of Thol."), (9, EASY[:30] + french * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("estimate", F.lit("clash"))
    got = {r["key"]: r["reading_level"] for r in reading_levels(df, "doc_id", "text", scales, languages).collect()}
    assert got == {1: 1, 2: 2, 7: 1}
    assert reading_levels(df.limit(0), "doc_id", "text", scales, languages).count() == 0
    assert reading_levels(df, "doc_id", "text", fit_scales(graded.limit(0), "text", "level")).count() == 0
    one = fit_scales(graded.where("level = 1"), "text", "level")
    assert {r["reading_level"] for r in reading_levels(df, "doc_id", "text", one, languages).collect()} == {1}
    assert fit_languages(df.limit(0).withColumn("lang", F.lit("en")), "text", "lang")[0] == []


def test_grades_follow_the_formulas(spark):
    text = "The careful teacher opened the kitchen. Nobody objected to it."
    r = grades(english_measures(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")).first()
    words = re.findall(r"\w+", text)
    spoken = {"the": 1, "careful": 3, "teacher": 2, "opened": 2, "kitchen": 2, "nobody": 3, "objected": 3, "to": 1, "it": 1}
    assert all(syllables(w) == n for w, n in spoken.items())
    s, y, c = len(words) / 2, sum(spoken[w.lower()] for w in words) / len(words), sum(map(len, words)) / len(words)
    assert r["fk"] == pytest.approx(0.39 * s + 11.8 * y - 15.59)
    assert r["ari"] == pytest.approx(4.71 * c + 0.5 * s - 21.43)
    assert r["fog"] == pytest.approx(0.4 * (s + 100 * 3 / len(words)))
    assert r["grade"] == sorted([r["ari"], r["fk"], r["fog"]])[1]


def test_clauses_and_names():
    assert clauses("We hid the cat well and the dog saw the cow".split())[0] == [5, 5]
    assert clauses("The dog and the cow saw the cat".split())[0] == [8]
    assert clauses("It moved both the semiotics of time and the diachrony of the council".split())[0] == [13]
    assert clauses("Vibor Thol of Marine Research saw the cat".split())[0] == [4]
    assert clauses("The cat saw Vibor Thol".split())[0] == [4]


@pytest.mark.slow
def test_graded_texts_are_placed(spark):
    """Each half of the graded texts is placed by weights fitted on the other."""
    graded = spark.read.parquet("/root/testdata/sf0.01/graded_texts.parquet")
    right = total = 0
    for n in (0, 1):
        scales = fit_scales(graded.where(F.col("text_id") % 2 == n), "text", "reading_level")
        held = graded.where(F.col("text_id") % 2 != n)
        rows = reading_levels(held, "text_id", "text", scales).join(held.select(F.col("text_id").alias("key"), F.col("reading_level").alias("level")), "key").collect()
        right, total = right + sum(r["reading_level"] == r["level"] for r in rows), total + held.count()
        assert len(rows) == held.count()
    assert right >= 0.85 * total
