import random

import pytest

from larkspur import queries
from larkspur.functions.vectors import fit_encoder
from larkspur.operators import propagate, search
from larkspur.operators.nearest import Linked, nearest
from larkspur.plans import retrieve


@pytest.mark.parametrize("eta", [1, 3])
def test_sentences_found_from_entities_equal_those_of_all_near_ones(spark, eta):
    rng = random.Random(eta)
    words = [f"w{i}" for i in range(12)]
    say = lambda: " ".join(rng.choice(words) for _ in range(4))
    q = spark.createDataFrame([(f"q{i:02}", say()) for i in range(60)] + [("none", None)], "question_id string, question string")
    texts = [(f"s{i:03}", say()) for i in range(300)] + [("bare", "w1 w2")]
    text = spark.createDataFrame(texts, "sentence_id string, text string")
    links = spark.createDataFrame([(s, e) for s, _ in texts[:-1] for e in {"hub", f"e{rng.randrange(9)}", f"e{rng.randrange(9)}"}], "sentence_id string, entity_id string").coalesce(1)
    seeds = spark.createDataFrame([(f"q{i:02}", e, 0.3 + 0.7 * rng.random()) for i in range(60) for e in ("hub", f"e{i % 9}")] + [("none", "hub", 1.0), ("q00", "lost", 1.0)], "question_id string, entity_id string, score double")
    prior_ = spark.createDataFrame([(f"e{a}", f"e{b}", 0.5 + 0.05 * b) for a in range(9) for b in range(9) if a != b and (a + b) % 3], "src string, dst string, w double")
    encode = fit_encoder(text, "text")
    near = propagate.question_sentences(search.question_sims(q, text, "sentence_id", "text", encode, least=0.4), links)
    linked = Linked(q.toDF("id", "v"), text.toDF("id", "v"), links.toDF("id", "link"), encode, 0.4, block_rows=64, query_rows=32)
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    cols = ("question_id", "entity_id", "score", "sentence_id", "sim")
    used = spark.createDataFrame([r[:2] for r in near.select("question_id", "sentence_id").distinct().collect() if rng.random() < 0.5], "question_id string, sentence_id string")
    for u in (None, used):
        want = rows(propagate.picked(seeds, u, near, 0.4, eta).select(*cols))
        assert len(want) > 60 and rows(propagate.picked(seeds, u, linked, 0.4, eta).select(*cols)) == want
    for way in (propagate.propagate, propagate.propagate_matrix):
        for a, b in zip(way(seeds, near, prior_, 0.4, eta, 3), way(seeds, linked, prior_, 0.4, eta, 3), strict=True):
            assert rows(a) == rows(b.select(*a.columns))
    empty = Linked(q.toDF("id", "v"), text.limit(0).toDF("id", "v"), links.toDF("id", "link"), encode, 0.4)
    assert propagate.picked(seeds, None, empty, 0.4, eta).count() == 0 and propagate.picked(seeds.limit(0), None, linked, 0.4, eta).count() == 0


def test_propagation_makes_no_row_for_sentences_that_no_entity_asks_for(spark, monkeypatch):
    monkeypatch.setattr(retrieve.Index, "near", lambda *_: pytest.fail("all near sentences of all questions"))
    sf = "/root/testdata/sf0.001"
    assert queries.hop1_semantic(spark, sf).count() > 0 and queries.hop1_structural(spark, sf).count() >= 0 and queries.propagate_matrix(spark, sf).count() > 0


def test_texts_of_an_encoder_and_vectors_of_queries_are_shuffled_once(spark):
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    rng = random.Random(3)
    texts = spark.createDataFrame([(f"{rng.random()}", " ".join(f"{rng.getrandbits(60):x}" for _ in range(20))) for _ in range(2000)], "id string, v string").repartition(4).localCheckpoint()
    began = written()
    texts.dropDuplicates(["id"]).write.format("noop").mode("overwrite").save()
    once, began = written() - began, written()
    encode = fit_encoder(texts.dropDuplicates(["id"]), "v", dim=4)
    assert once < written() - began < 1.8 * once

    rows = spark.createDataFrame([(f"{rng.random()}", [rng.gauss(0, 1) for _ in range(64)]) for _ in range(3000)] + [("short", [1.0]), (None, [1.0] * 64)], "id string, v array<double>").repartition(4).localCheckpoint()
    began = written()
    assert nearest(rows, rows, 3, query_rows=700).count() == 9000
    assert 0.9 < (written() - began) / (3000 * 64 * 8) < 1.5
    few = rows.limit(2)
    got = nearest(few, rows, 1).collect()
    assert len(got) == 2 and all(r["query"] == r["item"] and r["sim"] == 1 for r in got) and nearest(rows.limit(0), rows, 1).count() == 0
    assert nearest(texts.limit(5), texts, 1, encode=encode).count() == 5


def test_what_is_found_is_not_broadcast_for_the_size_of_the_numbers_of_its_parts(spark):
    rows = spark.createDataFrame([(f"r{i:03}", [float(i % 7), float(i % 11), 1.0]) for i in range(200)], "id string, v array<double>")
    found = nearest(rows, rows, least=-1.0)
    named = spark.createDataFrame([(f"r{i:03}", f"e{i}") for i in range(200)], "item string, name string")
    joined = found.join(named.repartition(4), "item")
    assert len(joined.collect()) == 200 * 200  # a join of two lists, of which the found one must not go through the driver
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_questions_and_passages_of_a_frequent_entity_meet_in_parts(spark):
    active = spark.createDataFrame([(f"q{i}", e, 0.5 + i / 100, 1 + i % 2) for i in range(20) for e in ("hub", f"e{i % 3}")], "question_id string, entity_id string, score double, tier int")
    occ = spark.createDataFrame([(f"p{i:02}", "hub", 1 + i % 4) for i in range(50)] + [(f"p{i:02}", f"e{i % 5}", 2) for i in range(8)], "passage_id string, entity_id string, n bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    split = search.entity_bonus(active, occ, block=4)
    assert rows(split) == rows(search.entity_bonus(active, occ, block=1000)) and split.count() == 20 * 50
    keys = {x for line in split._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line for x in ("entity_id", "part") if x in line}
    assert keys == {"entity_id", "part"}
