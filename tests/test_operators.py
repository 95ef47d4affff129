import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import queries
from larkspur.functions.vectors import fit_encoder
from larkspur.operators import graph, ppr, prior, search
from larkspur.operators.nearest import nearest
from larkspur.operators.propagate import fold, propagate, propagate_exact, propagate_matrix

NER = "passage_hash_id_to_entities map<string,array<string>>, sentence_to_entities map<string,array<string>>, entity string"


def test_row_prune_keeps_a_tenth(spark):
    rows = [(f"s{n}", f"d{i}", n - i) for n in (1, 9, 10, 19, 20, 50, 3000) for i in range(n)]
    got = {r[0]: r[1] for r in prior.prune(spark.createDataFrame(rows, "src string, dst string, cnt bigint")).groupBy("src").count().collect()}
    assert got == {"s1": 1, "s9": 1, "s10": 1, "s19": 1, "s20": 2, "s50": 5, "s3000": 200}


def test_fusion_of_the_worked_example(spark):
    co = spark.createDataFrame([("0", "1", 4), ("0", "2", 2)], "src string, dst string, cnt bigint")
    sim = spark.createDataFrame([("0", "2", 0.9), ("0", "3", 0.6), ("0", "1", 0.3)], "src string, dst string, sim double")
    got = {r["dst"]: r["w"] for r in prior.fuse(co, sim, [0.5]).collect()}
    assert got == pytest.approx({"1": 0.5, "2": 0.75})


LINKS = [("s0", "A", 0.9), ("s0", "B", 0.9), ("s1", "A", 0.5), ("s1", "C", 0.5), ("s2", "B", 0.8), ("s2", "D", 0.8)]
W = [("A", "B", 0.7), ("B", "C", 0.95)]
SEED = [("q", "A", 0.95)]
WEIGHT = {"A": 1.35, "B": 1.10, "C": 0.665, "D": 0.40}
ACTIVE = {"A": (0.4, 2), "B": (0.4, 3), "C": (0.665, 2), "D": (0.4, 3)}


def world(spark, links=LINKS, w=W, seed=SEED):
    near = spark.createDataFrame([("q", *x) for x in links], "question_id string, sentence_id string, entity_id string, sim double")
    return spark.createDataFrame(seed, "question_id string, entity_id string, score double"), near, spark.createDataFrame(w, "src string, dst string, w double")


def test_propagation_of_the_worked_example(spark):
    active, evidence = propagate(*world(spark), 0.4, 1, 3)
    assert {r["entity_id"]: round(r["weight"], 6) for r in evidence.collect()} == WEIGHT
    assert {r["entity_id"]: (round(r["score"], 6), r["tier"]) for r in active.collect()} == ACTIVE
    exact = propagate_exact(*world(spark), 0.4, 1, 3).collect()
    assert {r["entity_id"]: round(r["weight"], 6) for r in exact} == WEIGHT
    assert {r["entity_id"]: (round(r["score"], 6), r["tier"]) for r in exact} == ACTIVE


def test_synchronous_equals_exact_where_no_sentence_is_contested(spark):
    rng = random.Random(8)
    links = [(f"s{i}", e, round(rng.uniform(0.5, 1), 3)) for i in range(12) for e in (f"e{i}", f"e{i + 1}")]
    links = [(s, e, dict((x[0], x[2]) for x in links)[s]) for s, e, _ in links]
    args = world(spark, links, [("e1", "e2", 0.9), ("e2", "e9", 0.8)], [("q", "e0", 0.9)])
    _, evidence = propagate(*args, 0.3, 1, 4)
    exact = propagate_exact(*args, 0.3, 1, 4)
    assert {r[1]: round(r["weight"], 9) for r in evidence.collect()} == {r[1]: round(r["weight"], 9) for r in exact.collect()}


def test_without_seeds_or_links(spark):
    seed, near, w = world(spark, seed=[("q", "none", 0.9)])
    active, evidence = propagate(seed, near, w, 0.4, 1, 3)
    assert evidence.count() == 1 and active.count() == 1
    assert propagate(seed.limit(0), near, w, 0.4, 1, 3)[1].count() == 0
    assert fold([], {}, {}, 0.4, 1, 3) == ({}, {})


def test_matrix_mode_replaces_scores(spark):
    active, evidence = propagate_matrix(*world(spark), 0.4, 1, 2)
    # A takes s0: 0.95 * 0.9 reaches A and B; the prior pulls A from B
    assert {r["entity_id"]: r["weight"] for r in evidence.collect()} == pytest.approx({"A": 0.95 + 0.855 * 0.7})
    assert {r["entity_id"]: (r["score"], r["tier"]) for r in active.collect()} == {"A": (pytest.approx(0.855 * 0.7), 1)}
    seed, near, w = world(spark)
    _, twice = propagate_matrix(seed.unionByName(seed), near.limit(0), w, 0.4, 1, 2)
    assert twice.first()["weight"] == pytest.approx(1.9)


EDGES = [("p0", "A", 0.5), ("p0", "B", 0.5), ("p1", "B", 0.4), ("p1", "C", 0.4), ("p1", "D", 0.2), ("p0", "p1", 1.0)]


def dense_rank(edges, reset, d):
    ids = sorted({x for e in edges for x in e[:2]} | set(reset))
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b, w in edges:
        m[at[a], at[b]] += w
        m[at[b], at[a]] += w
    v = np.array([reset.get(x, 0) for x in ids])
    v = v / v.sum()
    out = m.sum(axis=1)
    p = np.divide(m, out[:, None], where=out[:, None] > 0, out=np.zeros_like(m)) + np.outer(out == 0, v)
    x = np.linalg.solve(np.eye(len(ids)) - d * p.T, (1 - d) * v)
    return dict(zip(ids, x, strict=True))


@pytest.mark.parametrize("extra", [{}, {"island": 0.7, "nan": float("nan"), "low": -1.0}])
def test_pagerank_equals_the_linear_system(spark, extra):
    reset = WEIGHT | {"p0": 0.147466544, "p1": 0.080209492} | extra
    df = spark.createDataFrame([("q", k, float(v)) for k, v in reset.items()], "question_id string, id string, weight double")
    move = graph.transitions(spark.createDataFrame(EDGES, "src string, dst string, weight double"))
    got = {r["id"]: r["rank"] for r in ppr.pagerank(ppr.clean_reset(df), move, 0.5, 30).collect()}
    want = dense_rank(EDGES, {k: v for k, v in reset.items() if v > 0}, 0.5)
    assert got == pytest.approx(want, abs=1e-8) and sum(got.values()) == pytest.approx(1)
    if not extra:
        assert round(got["p0"], 8) == 0.22749250 and round(got["p1"], 8) == 0.19684047


def test_common_base_is_added_linearly(spark):
    move = graph.transitions(spark.createDataFrame(EDGES, "src string, dst string, weight double"))
    own = ppr.pagerank(ppr.clean_reset(spark.createDataFrame([("q", "A", 2.0)], "question_id string, id string, weight double")), move, 0.5, 30)
    base = ppr.pagerank(ppr.clean_reset(spark.createDataFrame([("", "p0", 1.0), ("", "p1", 1.0)], "question_id string, id string, weight double")), move, 0.5, 30)
    both = ppr.with_common_base(own, spark.createDataFrame([("q", 2.0)], "question_id string, total double"), base.select("id", "rank"), 0.1)
    assert {r["id"]: r["rank"] for r in both.collect()} == pytest.approx(dense_rank(EDGES, {"A": 2.0, "p0": 0.05, "p1": 0.05}, 0.5), abs=1e-8)


def test_passage_scores_of_the_worked_example(spark):
    active = spark.createDataFrame([("q", e, s, t) for e, (s, t) in ACTIVE.items()], "question_id string, entity_id string, score double, tier int")
    occ = spark.createDataFrame([("p0", "A", 1), ("p0", "B", 1), ("p1", "B", 2), ("p1", "C", 2), ("p1", "D", 1)], "passage_id string, entity_id string, n bigint")
    sims = spark.createDataFrame([("q", "p0", 0.8), ("q", "p1", 0.2)], "question_id string, hash_id string, sim double")
    got = {r["passage_id"]: r["score"] for r in search.passage_scores(sims, search.entity_bonus(active, occ), 2, 0.05).collect()}
    assert got == pytest.approx({"p0": 0.147466544, "p1": 0.080209492}, abs=1e-9)


def test_adjacency_across_blocks(spark):
    df = spark.createDataFrame([("c", "2:c"), ("a", " 0:a"), ("x", "x"), ("z", "10:z")], "hash_id string, text string")
    for block in (1, 3, 100):
        assert {(r[0], r[1], r[2]) for r in graph.adjacent_edges(df, block).collect()} == {("a", "c", 1.0), ("c", "z", 1.0)}


def test_graph_tables(spark):
    ner = spark.createDataFrame([({"p": ["Vibor", "Vibor", " ", ""]}, {"s": ["Vibor", "Thol"]}, "clash"), (None, None, ""), ({"p": None, "r": []}, {"s": ["Thol"]}, "")], NER)
    assert graph.mentions(ner).count() == 1 and graph.sentence_entities(ner).count() == 2
    assert {(r["cnt"]) for r in prior.cooccurrence(graph.sentence_entities(ner)).collect()} == {1}
    passages = spark.createDataFrame([("p", "0:Vibor and Vibor"), ("r", "1:nobody")], "hash_id string, text string")
    m = graph.mentions(ner)
    edge = graph.edges(graph.mention_edges(passages, m), graph.adjacent_edges(passages))
    assert {round(r["weight"], 6) for r in edge.collect()} == {1.0}
    sums = graph.transitions(edge).groupBy("src").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in sums)
    assert graph.vertices(passages, m).groupBy("kind").count().count() == 2


def test_exact_neighbours_in_blocks_and_by_hashing(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.standard_normal((40, 16)), 5, axis=0) + 0.2 * rng.standard_normal((200, 16))
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("zero", [0.0] * 16)], "hash_id string, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(f"{i:03d}", f"{j:03d}") for i in range(200) for j in np.argsort(-s[i])[:4]}
    exact = {(r[0], r[1]) for r in prior.entity_knn(df, 4, block_rows=64).collect()}
    assert true <= exact
    near = {(r[0], r[1]) for r in prior.lsh_knn(df, 4, dim=16, bits=6).collect()}
    assert len(near & true) >= 0.9 * len(true)


def test_seeds_and_sims(spark):
    q = spark.createDataFrame([("q1", "Which office did Tesudas Sunabroser hold in Lake Trobagimul?"), ("q2", "why?"), ("q3", None), ("q4", "谁在Port Ösklund 和Тол?")], "question_id string, question string")
    ents = spark.createDataFrame([("e1", "Tesudas Sunabroser"), ("e2", "Lake Trobagimul"), ("e3", "Barola Kedrubalor"), ("e4", "Port Ösklund"), ("e5", "Тол")], "entity_id string, entity string")
    names = search.question_entities(q)
    assert {r["name"] for r in names.collect()} == {"tesudas sunabroser", "lake trobagimul", "port ösklund", "тол"}
    encode = fit_encoder(ents, "entity")
    got = {r["entity_id"]: r["score"] for r in search.seeds(names, ents, encode).collect()}
    assert got == {"e1": 1.0, "e2": 1.0, "e4": 1.0, "e5": 1.0}
    sims = search.question_sims(q, ents, "entity_id", "entity", encode, k=2).groupBy("question_id").count().collect()
    assert {r[0]: r[1] for r in sims} == {"q1": 2, "q2": 2, "q4": 2}  # a question gets its k even where nothing is alike; none without text


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((70, 8)), rng.standard_normal((90, 8))
    y[:3] = y[3]  # ties
    q = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8), ("odd", [1.0]), ("null", None)], "id string, v array<double>")
    b = spark.createDataFrame([(f"b{i:02d}", v.tolist()) for i, v in enumerate(y)] + [("b00", y[0].tolist()), (None, y[1].tolist()), ("short", [1.0]), ("empty", [])], "id string, v array<double>")
    s = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T, 6)
    got = {(r[0], r[1]): r[2] for r in nearest(q, b, 4, block_rows=32).collect() if r[0] != "zero"}
    want = {(f"q{i:02d}", f"b{j:02d}") for i in range(70) for j in np.lexsort((np.arange(90), -s[i]))[:4]}
    assert set(got) == want
    above = {(r[0], r[1]) for r in nearest(q, b, least=0.5, block_rows=32).collect()}
    assert above == {(f"q{i:02d}", f"b{j:02d}") for i, j in zip(*np.nonzero(s >= 0.5), strict=True)}
    assert nearest(q, b.limit(0), 4).count() == 0 and nearest(q.limit(0), b, 4).count() == 0


def test_occurrences_are_exact_for_all_names(spark):
    rng = random.Random(3)
    names = ["Thol", "IBM", "Тол", "在", "marlow", "Lake Bujoløgrem", "x", "Jut0tavun", "ab", "abc", "a b c d e f g h", "ΟΔΟΣ Α", "aaaaaaaaaa", "straße am", ""]
    texts = [" ".join(rng.choice([*names[:-1], "marlows", "zz", "IBMs;", "aaaaaaaaaaaaaaaaaaaaa"]) for _ in range(12)) for _ in range(60)] + ["", "thol"]
    p = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)] + [("null", None), ("p0", texts[0])], "hash_id string, text string")
    e = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)] + [("none", None)], "entity_id string, entity string")
    got = {(r[0], r[1]): r[2] for r in search.entity_occurrences(p, e).collect()}
    want = {(f"p{i}", f"e{j}"): t.lower().count(n.lower()) for i, t in enumerate(texts) for j, n in enumerate(names) if n and n.lower() in t.lower()}
    assert got == want
    assert search.entity_occurrences(p.limit(0), e).count() == 0 and search.entity_occurrences(p, e.limit(0)).count() == 0


def test_small_ranks_are_dropped(spark):
    move = graph.transitions(spark.createDataFrame([("h", f"v{i}", 1.0) for i in range(200)], "src string, dst string, weight double"))
    reset = ppr.clean_reset(spark.createDataFrame([("q", "v0", 1.0)], "question_id string, id string, weight double"))
    assert ppr.pagerank(reset, move, 0.5, 6).count() == 201
    got = {r["id"]: r["rank"] for r in ppr.pagerank(reset, move, 0.5, 6, least=0.01).collect()}
    assert set(got) == {"v0", "h"} and got["v0"] > 0.5


def test_sparsity(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s string, t string")
    assert {tuple(r) for r in prior.sparsity(one=df, none=df.limit(0)).collect()} == {("one", 3, 2, 2, 0.75), ("none", 0, 0, 0, None)}


def test_lsh_compares_all_parts_of_a_crowded_code(spark):
    rng = np.random.default_rng(4)
    x = np.ones(16) + 1e-3 * rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"{i:03d}", x[i].tolist()) for i in range(300)], "hash_id string, embedding array<double>")
    got = {(r[0], r[1]): r[2] for r in prior.lsh_knn(df, 5, dim=16, tables=2, bits=3, block_rows=32).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    least = np.sort(s, axis=1)[:, -5]
    assert len(got) == 5 * 300
    assert all(v >= least[int(a)] - 2e-6 for (a, _), v in got.items())


def test_lsh_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/entity_embedding.parquet").where("size(embedding) = 64").dropDuplicates(["hash_id"]).toPandas()
    x = np.stack(df["embedding"]).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    ids, x = df["hash_id"].to_numpy()[n > 0], x[n > 0] / n[n > 0, None]
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    least = dict(zip(ids, np.sort(s, axis=1)[:, -10] - 2e-6, strict=True))
    hit = sum(r["sim"] >= least[r["src"]] for r in queries.lsh_knn(spark, sf).collect() if r["src"] in least)
    print("recall", hit / (10 * len(ids)))
    assert hit >= 0.95 * 10 * len(ids)


def test_nearest_copies_no_rows_for_pairs_of_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (400, 6)).astype(float)  # many ties, some zero vectors
    df = spark.createDataFrame([(f"e{i:03}", r.tolist()) for i, r in enumerate(x)], "id string, v array<double>")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    sims = np.round(u @ u.T, 6)
    for k, least in ((3, None), (60, None), (5, 0.8), (None, 0.9)):
        found = nearest(df, df, k, least, others=True, block_rows=64, query_rows=256)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan and plan.count("Exchange") == 1
        want = set()
        for i in range(400):
            near = sorted((-sims[i, j], j) for j in range(400) if j != i and (least is None or sims[i, j] >= least))
            want |= {(f"e{i:03}", f"e{j:03}", -s) for s, j in near[:k]}
        assert {tuple(r) for r in found.collect()} == want
    odd = spark.createDataFrame([("nan", [float("nan")] * 6), ("none", None)], "id string, v array<double>")
    assert {r["sim"] for r in nearest(odd, df, 2).collect()} == {0.0}  # as SQL has it


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id string, v array<float>")
    some = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<float>")
    assert [nearest(q, b, 2).count() for q, b in ((none, none), (none, some), (some, none), (some, some))] == [0, 0, 0, 1]


def test_attribute_boost_of_all_passages_makes_only_pairs_that_share_a_keyword(spark):
    ask = ["Where was Ada born?", "When did Bo die?", "Who was it?", "What year, and where?", "Was Eve born where Bo was?", ""]
    have = ["Ada was born somewhere.", "Nothing here.", "BORN in a year when it rained.", "Whenever.", ""]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(ask)], "question_id string, question string")
    p = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(have)], "hash_id string, text string")
    words, sims = ("born", "where", "when", "year"), q.select("question_id").crossJoin(p.select("hash_id"))
    want = {tuple(r) for r in search.attribute_boost(q, p, sims, words, 0.25).collect()}
    for spread in (1, 16):
        got = search.attribute_boost(q, p, None, words, 0.25, spread)
        assert len(want) > 5 and sorted(map(tuple, got.collect())) == sorted(want)


def test_passage_scores_shuffle_similarities_once(spark):
    sims = spark.createDataFrame([("q", "p0", 0.8), ("q", "p1", 0.2), ("r", "p1", 0.3)], "question_id string, hash_id string, sim double")
    bonus = spark.createDataFrame([("q", "p1", 1.0), ("q", "p2", 2.0), ("s", "p0", 0.5)], "question_id string, passage_id string, bonus double")
    out = search.passage_scores(sims, bonus, 3, 0.5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    e = np.e
    want = {("q", "p0"): e / 2, ("q", "p1"): (np.exp(0.25) + 1) / 2, ("q", "p2"): 1.5, ("r", "p1"): e / 2, ("s", "p0"): 0.75}
    assert {(r[0], r[1]): r[2] for r in out.collect()} == pytest.approx(want)
