"""Spreading a question's evidence over sentences and the prior, for all questions at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .nearest import Linked


def _exact_sum(col: str):
    """A sum that does not depend on the order of its terms."""
    return F.sum(F.round(F.col(col), 12).cast("decimal(38,12)")).cast("double")


def question_sentences(sims: DataFrame, sentence_entity: DataFrame) -> DataFrame:
    """``question_id, sentence_id, entity_id, sim``: sentences near a question with their entities.

    Scores are at most 1, so a sentence less similar than the gate can never pass it, and the more similar ones are picked
    first: starting from those above the gate loses nothing and keeps an entity of many sentences from multiplying.
    """
    return sims.where("sim > 0").join(sentence_entity, "sentence_id")


def picked(frontier: DataFrame, used: DataFrame | None, near: DataFrame | Linked, delta: float, eta: int) -> DataFrame:
    """``question_id, entity_id, score, sentence_id, sim``: of each entity of at least `delta` the `eta` nearest sentences not used yet.

    `near` is a table as of `question_sentences`, or finds the same sentences from the entities, without one.
    """
    live = frontier.where(F.col("score") >= delta).select("question_id", "entity_id", "score")
    if isinstance(near, Linked):
        best = near.best(live.toDF("query", "link", "score"), None if used is None else used.select(F.col("question_id").alias("query"), F.col("sentence_id").alias("item")), eta)
        return cut(best.toDF("question_id", "entity_id", "score", "sentence_id", "sim"))
    cand = near.join(live, ["question_id", "entity_id"])
    if used is not None:
        cand = cand.join(used, ["question_id", "sentence_id"], "left_anti")
    rank = Window.partitionBy("question_id", "entity_id").orderBy(F.desc("sim"), "sentence_id")
    return cand.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= eta).drop("rn")


def members(near: DataFrame | Linked, sentences: DataFrame) -> DataFrame:
    """`sentences`, which are near ones of their questions, with each ``entity_id`` in them."""
    if isinstance(near, Linked):
        return sentences.join(near.links.toDF("sentence_id", "entity_id"), "sentence_id")
    return sentences.join(near.select("question_id", "sentence_id", "entity_id"), ["question_id", "sentence_id"])


def semantic_hop(frontier: DataFrame, used: DataFrame | None, near: DataFrame | Linked, prior: DataFrame, delta: float, eta: int) -> tuple[DataFrame, DataFrame]:
    """Picked sentences ``question_id, entity_id, score, sentence_id, sim`` and transitions ``question_id, src, sentence_id, dst, next``."""
    pick = picked(frontier, used, near, delta, eta)
    base = F.col("score") * F.col("sim")
    step = pick.where(base >= delta).select("question_id", F.col("entity_id").alias("src"), "sentence_id", base.alias("base"))
    step = members(near, step).withColumnRenamed("entity_id", "dst")
    step = step.join(prior.select("src", "dst", "w"), ["src", "dst"], "left")
    nxt = F.when(F.col("w").isNull(), F.lit(delta)).otherwise(F.greatest(F.least("base", "w"), F.lit(delta)))
    return pick, step.select("question_id", "src", "sentence_id", "dst", nxt.alias("next"))


def structural_hop(reached: DataFrame, prior: DataFrame, delta: float) -> DataFrame:
    """``question_id, entity_id, score``: neighbours of the entities reached in this hop, but not these themselves."""
    grown = reached.select("question_id", F.col("entity_id").alias("src"), "score").join(prior.select("src", "dst", "w"), "src")
    score = F.col("score") * F.col("w")
    grown = grown.where(score >= delta).select("question_id", F.col("dst").alias("entity_id"), score.alias("score"), "src")
    new = grown.join(reached.select("question_id", "entity_id"), ["question_id", "entity_id"], "left_anti")
    return new.groupBy("question_id", "entity_id").agg(F.min_by("score", "src").alias("score"))


def propagate(seeds: DataFrame, near: DataFrame | Linked, prior: DataFrame, delta: float, eta: int, max_iterations: int) -> tuple[DataFrame, DataFrame]:
    """Synchronous mode. Active entities ``question_id, entity_id, score, tier`` and evidence ``question_id, entity_id, weight``."""
    frontier = seeds.select("question_id", "entity_id", "score").withColumn("tier", F.lit(1))
    active, used = frontier, None
    evidence = seeds.select("question_id", "entity_id", F.col("score").alias("weight"))
    for hop in range(1, max_iterations):
        pick, step = semantic_hop(frontier, used, near, prior, delta, eta)
        step = cut(step)
        seen = pick.select("question_id", "sentence_id").distinct()
        used = cut(seen if used is None else used.unionByName(seen).distinct())
        reached = step.groupBy("question_id", F.col("dst").alias("entity_id")).agg(F.max_by("next", F.struct("src", "sentence_id")).alias("score"))
        grown = structural_hop(reached, prior, delta)
        frontier = cut(reached.unionByName(grown).withColumn("tier", F.lit(hop + 1)))
        more = step.select("question_id", F.col("dst").alias("entity_id"), F.col("next").alias("weight")).unionByName(
            frontier.join(reached.select("question_id", "entity_id"), ["question_id", "entity_id"], "left_anti").select("question_id", "entity_id", F.col("score").alias("weight"))
        )
        evidence = evidence.unionByName(more)
        active = active.unionByName(frontier)
    active = active.groupBy("question_id", "entity_id").agg(F.max_by("score", "tier").alias("score"), F.max("tier").alias("tier"))
    return active, evidence.groupBy("question_id", "entity_id").agg(_exact_sum("weight").alias("weight"))


def propagate_matrix(seeds: DataFrame, near: DataFrame | Linked, prior: DataFrame, delta: float, eta: int, max_iterations: int) -> tuple[DataFrame, DataFrame]:
    """Matrix mode. Active entities ``question_id, entity_id, score, tier`` and evidence ``question_id, entity_id, weight``.

    A sentence gathers all its active entities, and the prior replaces scores. A hop's scores of at least `delta` make an
    entity active with the hop as its tier (seeds: 0); smaller positive ones only count as evidence. Repeated seeds add up.
    """
    scores = seeds.groupBy("question_id", "entity_id").agg(_exact_sum("score").alias("score"))
    total, used = scores, None
    active = scores.withColumn("tier", F.lit(0))
    for hop in range(1, max_iterations):
        live = scores.where(F.col("score") >= delta)
        pick = cut(picked(scores, used, near, delta, eta).groupBy("question_id", "sentence_id").agg(F.first("sim").alias("sim")))
        seen = pick.select("question_id", "sentence_id")
        used = seen if used is None else cut(used.unionByName(seen).distinct())
        inside = cut(members(near, pick))
        mass = inside.join(live, ["question_id", "entity_id"]).groupBy("question_id", "sentence_id").agg(_exact_sum("score").alias("mass"))
        out = inside.join(mass, ["question_id", "sentence_id"]).select("question_id", "entity_id", F.round(F.col("mass") * F.col("sim"), 9).alias("out"))
        spread = out.groupBy("question_id", "entity_id").agg(_exact_sum("out").alias("s"))
        pulled = spread.withColumnRenamed("entity_id", "dst").join(prior.select("src", "dst", "w"), "dst").select("question_id", F.col("src").alias("entity_id"), F.round(F.col("s") * F.col("w"), 9).alias("part"))
        scores = cut(pulled.groupBy("question_id", "entity_id").agg(_exact_sum("part").alias("score")).where("score > 0"))
        total = total.unionByName(scores)
        active = active.unionByName(scores.where(F.col("score") >= delta).withColumn("tier", F.lit(hop)))
    active = active.groupBy("question_id", "entity_id").agg(F.max_by("score", "tier").alias("score"), F.max("tier").alias("tier"))
    return active, total.groupBy("question_id", "entity_id").agg(_exact_sum("score").alias("weight"))


def fold(seeds: list[tuple[str, float]], links: dict[str, list[tuple[float, str, list[str]]]], prior: dict[str, dict[str, float]], delta: float, eta: int, max_iterations: int):
    """Exact mode for one question, in a defined order: entities as they enter, sentences by similarity and id."""
    active, weight, used = {}, {}, set()
    for e, s in seeds:
        active[e] = (s, 1)
        weight[e] = s
    frontier = dict(active)
    for hop in range(1, max_iterations):
        new: dict[str, tuple[float, int]] = {}
        for e, (score, _) in frontier.items():
            if score < delta:
                continue
            for sim, sentence, members in sorted((x for x in links.get(e, ()) if x[1] not in used), key=lambda x: (-x[0], x[1]))[:eta]:
                used.add(sentence)
                base = score * sim
                if base < delta:
                    continue
                for d in sorted(members):
                    w = prior.get(e, {}).get(d)
                    nxt = delta if w is None else max(min(base, w), delta)
                    weight[d] = weight.get(d, 0.0) + nxt
                    new[d] = (nxt, hop + 1)
        grown: dict[str, tuple[float, int]] = {}
        for e, (score, tier) in new.items():
            for d, w in sorted(prior.get(e, {}).items()):
                if score * w >= delta and d not in new and d not in grown:
                    grown[d] = (score * w, tier)
                    weight[d] = weight.get(d, 0.0) + score * w
        frontier = new | grown
        active |= frontier
    return active, weight


def propagate_exact(seeds: DataFrame, near: DataFrame, prior: DataFrame, delta: float, eta: int, max_iterations: int) -> DataFrame:
    """``question_id, entity_id, score, tier, weight``: the order-dependent mode, one fold a question.

    Each question's local part (its sentences above the gate and the prior of their entities) travels with it to one task;
    where that is too much, `propagate` is the mode without such groups.
    """
    local = near.groupBy("question_id", "sentence_id", "sim").agg(F.sort_array(F.collect_list("entity_id")).alias("members"))
    touched = near.select("question_id", "entity_id").unionByName(seeds.select("question_id", "entity_id")).distinct()
    once = touched.join(prior.select(F.col("src").alias("entity_id"), "dst", "w"), "entity_id")
    # structural steps leave the near entities once, never twice
    part = once.select("question_id", F.lit(1).alias("kind"), F.col("entity_id").alias("a"), F.col("dst").alias("b"), F.col("w").alias("x"), F.lit(None).cast("array<string>").alias("members"))
    part = part.unionByName(local.select("question_id", F.lit(0).alias("kind"), F.col("sentence_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("sim").alias("x"), "members"))
    part = part.unionByName(seeds.select("question_id", F.lit(2).alias("kind"), F.col("entity_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("score").alias("x"), F.lit(None).cast("array<string>").alias("members")))

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        start = sorted((r.a, r.x) for r in groups[groups.kind == 2].itertuples())
        links: dict[str, list[tuple[float, str, list[str]]]] = {}
        for r in groups[groups.kind == 0].itertuples():
            for e in r.members:
                links.setdefault(e, []).append((r.x, r.a, list(r.members)))
        w: dict[str, dict[str, float]] = {}
        for r in groups[groups.kind == 1].itertuples():
            w.setdefault(r.a, {})[r.b] = r.x
        active, weight = fold(start, links, w, delta, eta, max_iterations)
        rows = [(groups.question_id.iloc[0], e, s, t, weight[e]) for e, (s, t) in active.items()]
        return pd.DataFrame(rows, columns=["question_id", "entity_id", "score", "tier", "weight"])

    return part.groupBy("question_id").applyInPandas(run, "question_id string, entity_id string, score double, tier int, weight double")
