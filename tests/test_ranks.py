import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import queries
from larkspur.operators import graph, ppr
from larkspur.plans import retrieve


@pytest.mark.parametrize("least", [0.0, 1e-3])
def test_ranks_in_blocks_equal_those_by_joins(spark, least):
    rng = random.Random(8)
    edges = [("hub", f"v{i}", 1.0) for i in range(150)] + [(f"v{rng.randrange(200)}", f"v{rng.randrange(200)}", rng.random() + 0.1) for _ in range(500)]
    move = graph.transitions(spark.createDataFrame([e for e in edges if e[0] != e[1]], "src string, dst string, weight double"))
    rows = [(f"q{q}", rng.choice(["island", "hub", f"v{rng.randrange(200)}"]), rng.random()) for q in range(90) for _ in range(1 + q % 5)]
    reset = ppr.clean_reset(spark.createDataFrame(rows, "question_id string, id string, weight double").groupBy("question_id", "id").agg(F.sum("weight").alias("weight"))).localCheckpoint()
    got = ppr.pagerank(reset, move, 0.5, 12, least)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # whatever the number of steps
    want = {(r["question_id"], r["id"]): r["rank"] for r in ppr.joined_pagerank(reset, move, 0.5, 12, least).collect()}
    assert len(want) > 500 and {(r["question_id"], r["id"]): r["rank"] for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert ppr.pagerank(reset.limit(0), move, 0.5, 12).count() == 0
    assert [r["rank"] for r in ppr.pagerank(reset.where("question_id = 'q0'"), move.limit(0), 0.5, 12).collect()] == pytest.approx([1.0])


def test_retrieval_of_graphs_that_tasks_hold_equals_that_by_joins(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    some = queries._questions(spark, sf).orderBy("question_id").limit(12)
    rows = lambda: sorted(map(tuple, retrieve.retrieve(queries._index(spark, sf), some).collect()))
    got = rows()
    monkeypatch.setattr(ppr, "EDGES", 0)
    want = rows()
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_steps_over_all_edges_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(ppr, "TURNS", 3)  # so that vertices have more edges than there are turns
    rng = np.random.default_rng(4)
    n = 60
    pairs = np.unique(np.concatenate([rng.integers(0, n, 200) * n + rng.integers(0, 5, 200), np.arange(n - 5) * n + np.arange(1, n - 4)]))
    src, dst = pairs // n, pairs % n
    p = 1 / np.bincount(src, minlength=n)[src]
    g = ppr._Graph(np.arange(n), src, dst, p)
    assert len(g.heads) and len(g.turns) == 3
    for least in (0.0, 1e-3):
        v, mass = np.array([0, 3, n - 1]), np.array([0.5, 0.3, 0.2])  # the last may have no edge that leaves it
        got = np.zeros(n)
        at, x = g.rank(v, mass, 0.5, 20, least)
        got[at] = x
        m, reset = np.zeros((n, n)), np.bincount(v, mass, n)
        m[dst, src] = p
        want = reset
        for _ in range(20):
            want = 0.5 * m @ want + reset * (0.5 + 0.5 * want[np.bincount(src, minlength=n) == 0].sum())
            want = np.where(want >= least, want, 0.0)
        assert np.allclose(got, want, atol=1e-15) and (got > 0).tolist() == (want > 0).tolist()
