import numpy as np
import pytest

from larkspur.llm.hnsw import Shard
from larkspur.llm.name_variants import bands_for, monge_elkan, name_sets, remains, tokens, variant_pairs, word_variants
from larkspur.llm.queries import p3_found
from larkspur.llm.similar_vectors import plan_shards, similar_vectors

VEC = "hash_id string, embedding array<float>, id string, shard int"


def clusters(n, dim=16, each=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    x = np.repeat(base, each, axis=0) + 0.25 * rng.standard_normal((n * each, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(x, k, least):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in top[i] if s[i, j] >= least}


def test_shard_finds_its_neighbours():
    x = clusters(300)
    ids, sims = Shard(x, m=10, ef=32).search(x, 8)
    assert (ids[:, 0] == np.arange(len(x))).mean() > 0.97 and np.allclose(sims[:, 0], 1, atol=1e-4)


def test_similar_vectors_recall(spark):
    x = clusters(400)
    rows = [(f"{i:05d}", (x[i] * (1 + i % 3)).tolist(), "clash", 3) for i in range(len(x))]
    rows += rows[:50] + [("null", None, "", 0), ("empty", [], "", 0), ("zero", [0.0] * 16, "", 0), ("nan", [float("nan")] * 16, "", 0), (None, x[0].tolist(), "", 0)]
    got = similar_vectors(spark.createDataFrame(rows, VEC), "hash_id", "embedding", 5, 0.8, dim=16, shard_rows=256, border=0.15).collect()
    pairs = {tuple(sorted((int(r[0]), int(r[1])))) for r in got}
    true = brute(x, 5, 0.8)
    assert len(pairs & true) >= 0.95 * len(true) and len(pairs & true) >= 0.95 * len(pairs)


def test_equal_vectors_are_spread_and_still_linked(spark):
    rows = [(f"{i:04d}", [1.0, 0.0, 0.0, 0.0], "", 0) for i in range(300)]
    got = similar_vectors(spark.createDataFrame(rows, VEC), "hash_id", "embedding", 3, 0.9, dim=4, shard_rows=32).collect()
    assert len({r[0] for r in got}) == 300 and all(r[2] > 0.999 for r in got)
    assert max(np.bincount([int(r[0]) for r in got])) <= 3


def test_equal_vectors_are_one_row_of_the_graphs(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)

    class Counted(Shard):
        def __init__(self, x, **given):
            sizes.add(len(x))
            super().__init__(x, **given)

    monkeypatch.setattr("larkspur.llm.similar_vectors.Shard", Counted)
    x = clusters(60)
    rows = [(f"{i:04d}", x[i].tolist(), "", 0) for i in range(len(x))] + [(f"e{i:04d}", x[0].tolist(), "", 0) for i in range(500)]
    got = similar_vectors(spark.createDataFrame(rows, VEC), "hash_id", "embedding", 3, 0.5, dim=16, shard_rows=64).collect()
    assert sizes.value == len(x)
    near = {}
    for r in got:
        near.setdefault(r[0], set()).add(r[1])
    assert near["e0400"] == {"0000", "e0000", "e0001"} and near["0000"] == {"e0000", "e0001", "e0002"} and near["e0000"] == {"0000", "e0001", "e0002"}
    mates = [i for i in range(1, 6) if "0000" in near[f"{i:04d}"]]
    assert mates and all({"e0000", "e0001"} <= near[f"{i:04d}"] for i in mates if x[i] @ x[0] >= np.sort(x @ x[i])[-2])


def test_vectors_are_shuffled_twice_and_pairs_once(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    x = np.random.default_rng(5).standard_normal((4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "hash_id string, embedding array<float>").repartition(4).localCheckpoint()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    began = written()
    assert similar_vectors(df, "hash_id", "embedding", 5, border=0.0).count() == 5 * len(x)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    took = (written() - began) / x.nbytes
    print("shuffled x vectors", took)
    assert 1.9 < took < 3


def test_every_id_of_equal_vectors_and_of_several_vectors(spark):
    x = clusters(40, each=4)
    rows = [(f"v{i:03d}", x[i]) for i in range(len(x))]
    rows += [(f"{c}{n:03d}", x[i]) for c, i, m in (("a", 0, 3), ("b", 1, 9), ("z", 2, 30), ("y", 9, 2)) for n in range(m)]  # equal ones: few, many, before and behind
    rows += [("v000", x[50]), ("b001", x[51]), ("z029", x[52]), ("z029", x[2])]  # ids of two vectors, and repeated rows
    got = {}
    for i, n, s in similar_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "hash_id string, embedding array<float>").repartition(3), "hash_id", "embedding", 4, 0.6, dim=16, effort=200).collect():
        got.setdefault(i, {})[n] = s
    s = np.stack([v for _, v in rows]) @ np.stack([v for _, v in rows]).T
    for i in {i for i, _ in rows}:
        best = {}
        for r in (r for r, (n, _) in enumerate(rows) if n == i):
            for c, (n, v) in enumerate(rows):
                if n != i and s[r, c] >= 0.6:
                    best[n] = max(best.get(n, -1), 1.0 if np.array_equal(v, rows[r][1]) else round(float(s[r, c]), 5))
        want = dict(sorted(best.items(), key=lambda y: (-y[1], y[0]))[:4])
        assert got.get(i, {}).keys() == want.keys() and all(abs(got[i][n] - want[n]) < 1e-4 for n in want), i


def test_rows_inserted_later_are_found(spark):
    rng = np.random.default_rng(6)
    x = np.ones(16) + 0.05 * rng.standard_normal((2000, 16))  # one dense cell: near rows of most rows come later
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), "", 0) for i, v in enumerate(x)], VEC)
    got = similar_vectors(df, "hash_id", "embedding", 30, dim=16, effort=60).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    least = np.sort(s, axis=1)[:, -30] - 1e-6
    recall = sum(r[2] >= least[int(r[0])] for r in got) / (30 * len(x))
    print("recall", recall)
    assert recall >= 0.98


def test_no_vectors(spark):
    assert similar_vectors(spark.createDataFrame([], VEC), "hash_id", "embedding").count() == 0
    assert similar_vectors(spark.createDataFrame([("a", [0.0] * 64, "", 0)], VEC), "hash_id", "embedding").count() == 0


def test_shard_plan_splits_hot_cells():
    x = np.concatenate([clusters(10, each=3), np.repeat(clusters(1, each=1), 60, axis=0)])
    cent, spread = plan_shards(x, 9000, 100, 64)
    assert len(cent) == len(spread) and spread.max() > 1


@pytest.mark.slow
def test_p3_found_against_brute_force(spark):
    got = {(r[0], r[1], r[2]) for r in p3_found(spark, "/root/testdata/sf0.01").collect()}
    true = set()
    for store in ("entity", "sentence"):
        df = spark.read.parquet(f"/root/testdata/sf0.01/{store}_embedding.parquet").where("size(embedding) = 64").dropDuplicates(["hash_id"]).toPandas()
        x = np.stack(df["embedding"]).astype(np.float32)
        ok = np.linalg.norm(x, axis=1) > 0
        ids, x = df["hash_id"].to_numpy()[ok], x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)
        true |= {(store, *sorted((ids[i], ids[j]))) for i, j in brute(x, 5, 0.9)}
    assert len(got & true) >= 0.97 * len(true) and len(got & true) >= 0.97 * len(got)


NICK = [("Tho", "Thokiwyn"), ("Zuby", "Zubredas")]
FAMILY = [
    ["Thokiwyn Honodritrim", "Thokiwyn Honodritrim", "HONODRITRIM, Thokiwyn", 'Thokiwyn "Tho" Honodritrim', "Tho Honodritrim", "T. Honodritrim", "Dr. Th0kiwyn Honodritrim", "Thokiwyn Honodrirtim"],
    ["Thokiwyn Honodritrim Jr."],
    ["Zubredas Honodritrim", "Zuby Honodritrim"],
    ["Lake Honodritrim", "Honodritrim, Lake", "LakeHonodritrim", "lake honodritrim (place)"],
    ["Honodritrim Museum of Folk History", "Honodritrim Mus. of Folk Hist.", "Museum of Folk History, Honodritrim", "Honodritrim M.F.H."],
    ["Honodritrim Museum of Root Medicine"],
]
OTHERS = [[f"{g} {f}"] for g in ("Thokiwyn", "Zubredas", "Barola") for f in ("Vagimostul", "Kedrubalor", "Pistorugan")] + [[f"{f} Museum of Folk History"] for f in ("Vagimostul", "Kedrubalor")]


def test_name_variants_of_a_family(spark):
    rows = [(f"{i:02d}-{j}", t, "clash") for i, g in enumerate(FAMILY + OTHERS) for j, t in enumerate(g)]
    rows += [rows[0], ("null", None, ""), ("blank", "  ", ""), (None, "x", "")]
    df = spark.createDataFrame(rows, "hash_id string, text string, entity string")
    nick = spark.createDataFrame(NICK, "nickname string, given_name string")
    got = {tuple(r) for r in variant_pairs(name_sets(df, "hash_id", "text", nick)).collect()}
    ids = [[f"{i:02d}-{j}" for j in range(len(g))] for i, g in enumerate(FAMILY + OTHERS)]
    true = {(a, b) for g in ids for a in g for b in g if a < b}
    assert got - true == set()
    assert len(true - got) <= 1


def test_no_names(spark):
    nick = spark.createDataFrame([], "nickname string, given_name string")
    df = spark.createDataFrame([], "hash_id string, text string")
    assert name_sets(df, "hash_id", "text", nick).count() == 0


def test_name_parts():
    assert tokens("Dr. Tésudas-Vibor Jr.") == (["tesudas", "vibor"], True, "", False)
    assert tokens("Mestedafox F.F.H.")[0] == ["mestedafox", "f", "f", "h"]
    assert monge_elkan(["t", "vibor"], ["tesudas", "vibor"]) == pytest.approx(0.95)
    b = bands_for(0.5, 0.97, 3)
    assert 1 - (1 - 0.5**3) ** b >= 0.97 > 1 - (1 - 0.5**3) ** (b - 1)


def test_frequent_and_short_misspellings_are_linked(spark):
    rows = [("research", 300), ("resaerch", 7), ("reserch", 41)]
    got = {r[0]: r[1] for r in word_variants(spark.createDataFrame(rows, "w string, df bigint")).collect()}
    assert got == {"resaerch": "research", "reserch": "research"}
    short = {r[0]: r[1] for r in word_variants(spark.createDataFrame([("local", 108), ("loal", 1), ("tina", 6), ("hina", 3)], "w string, df bigint")).collect()}
    assert short == {"loal": "local"}


def test_every_allowed_slip_is_proposed_and_chains_reach_their_end(spark):
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, true = [], {}
    for _ in range(120):
        u = "".join(rng.choice(letters, 9))
        at = set(rng.choice([1, 4, 7], 3, replace=False))  # three substitutions that leave no common run of three letters
        w = "".join("0" if i in at else c for i, c in enumerate(u))
        rows += [(u, 100), (w, 1)]
        true[w] = u
    got = {r[0]: r[1] for r in word_variants(spark.createDataFrame(rows, "w string, df bigint")).collect()}
    assert got == true
    assert remains("abcde") & remains("abdce") and not remains("abcde") & remains("abxye")
    chain = [("abcde", 1), ("abcdf", 2), ("abcgf", 4), ("abhgf", 8), ("aihgf", 16)]
    got = {r[0]: r[1] for r in word_variants(spark.createDataFrame(chain, "w string, df bigint")).collect()}
    assert got == {w: "aihgf" for w, _ in chain[:-1]}
