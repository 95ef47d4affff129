"""Personalised PageRank of all questions at once, on sparse rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, work_path
from .nearest import _files

#: A graph of up to so many directed edges is held by every task, about 100 bytes an edge while it is read; a larger one is joined with the ranks.
EDGES = 1 << 22
#: So many edges that lead to a vertex are taken in turns.
TURNS = 16
Found = list[tuple[np.ndarray, np.ndarray]]
Finish = Callable[["_Graph", pa.Array, list[float], Found], Iterator[pa.RecordBatch]]


def clean_reset(reset: DataFrame) -> DataFrame:
    """``question_id, id, mass``: NaN and negative weights become 0, the rest sums to 1 per question."""
    w = F.when(F.isnan("weight") | (F.col("weight") < 0), 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    pos = reset.select("question_id", "id", w.alias("weight")).where("weight > 0")
    total = pos.groupBy("question_id").agg(F.sum(F.round("weight", 12).cast("decimal(38,12)")).cast("double").alias("total"))
    return pos.join(total, "question_id").select("question_id", "id", (F.col("weight") / F.col("total")).alias("mass"))


class _Graph:
    """Transitions by the vertex they leave; a vertex is its place among the sorted `codes`."""

    def __init__(self, codes: np.ndarray, src: np.ndarray, dst: np.ndarray, p: np.ndarray) -> None:
        src, dst = np.searchsorted(codes, src), np.searchsorted(codes, dst)
        by = np.lexsort((dst, src))
        self.codes, self.src, self.dst, self.p = codes, src[by], dst[by], p[by]
        self.out = np.bincount(src, minlength=len(codes))
        self.first = np.cumsum(self.out) - self.out
        # the same edges by the vertex they lead to, vertices by the number of such edges: their j-th edges are a turn, what is beyond the turns is summed by vertex
        times = np.bincount(self.dst, minlength=len(codes))
        by = np.argsort(self.dst, kind="stable")
        order = np.argsort(-times, kind="stable")
        self.place = np.argsort(order)
        self.ends = self.place[self.out == 0]
        from_, share = self.place[self.src[by]], self.p[by]
        starts, times = (np.cumsum(times) - times)[order], times[order]
        self.turns = [(from_[e], share[e]) for e in (starts[: np.searchsorted(-times, -j)] + j for j in range(TURNS)) if len(e)]
        hubs = int(np.searchsorted(-times, -TURNS))
        more = times[:hubs] - TURNS
        self.heads = np.cumsum(more) - more
        e = np.repeat(starts[:hubs] + TURNS - self.heads, more) + np.arange(more.sum())
        self.rest = from_[e], share[e]
        self.room = np.empty(len(codes))

    def rows(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, codes)

    def rank(self, v: np.ndarray, mass: np.ndarray, damping: float, steps: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Vertices and their ranks for a reset of `mass` on `v`; a step goes over the edges of what has rank, or from the first time that these are many over all, which is faster for each."""
        n = len(self.codes)
        full = np.bincount(v, mass, minlength=n)
        at, x = np.flatnonzero(full), full[full > 0]
        v, mass = at, x
        for step in range(steps):
            out = self.out[at]
            m = int(out.sum())
            if m and 4 * m > len(self.p):
                return self._dense(at, x, v, mass, damping, steps - step, least)
            edge = np.repeat(self.first[at] - np.cumsum(out) + out, out) + np.arange(m)
            flow = np.bincount(self.dst[edge], self.p[edge] * np.repeat(x, out), minlength=n)
            flow = flow * damping  # of no edges it has whole numbers
            flow[v] += mass * (1 - damping + damping * x[out == 0].sum())
            at = np.flatnonzero(flow >= least if least > 0 else flow)
            x = flow[at]
        return at, x

    def _dense(self, at: np.ndarray, x: np.ndarray, v: np.ndarray, mass: np.ndarray, damping: float, steps: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        full, back = np.zeros(len(self.codes)), self.place[v]
        full[self.place[at]] = x
        for _ in range(steps):
            flow = self._flow(full)
            flow *= damping
            flow[back] += mass * (1 - damping + damping * full[self.ends].sum())
            if least > 0:
                flow[flow < least] = 0.0
            full = flow
        full = full[self.place]
        at = np.flatnonzero(full)
        return at, full[at]

    def _flow(self, x: np.ndarray) -> np.ndarray:
        """What flows into every vertex; both in the order of the new places."""
        flow = np.zeros(len(x))
        for from_, share in self.turns:
            some = x.take(from_, out=self.room[: len(from_)], mode="clip")
            some *= share
            flow[: len(from_)] += some
        if len(self.heads):
            flow[: len(self.heads)] += np.add.reduceat(x[self.rest[0]] * self.rest[1], self.heads)
        return flow


def _read(path: str, columns: list[str]) -> pa.Table:
    fs, files = _files(path)
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=fs) for f in files])


def _written(df: DataFrame, name: str) -> str:
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def small(transition: DataFrame) -> bool:
    """Whether every task can hold the graph."""
    return transition.limit(EDGES + 1).count() <= EDGES


def in_blocks(reset: DataFrame, transition: DataFrame, damping: float, steps: int, least: float, finish: Finish, schema: str, clean: bool = False) -> DataFrame:
    """What `finish` makes of the ranks of some questions at a time, for a graph that every task holds.

    `reset` has ``question_id, id, mass``. A question's rows go to one task; only they are shuffled. `finish` gets the graph, the
    questions, their totals, and vertices and ranks of each. With `clean` the masses are weights: NaN and negative ones count as 0, the rest is divided by its total.
    """
    edges = _written(transition.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"), "p"), "edges")
    more = _written(reset.select(F.xxhash64("id").alias("v")).distinct(), "reset")
    spark = reset.sparkSession

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: _Graph | None = None
        held: list[pa.RecordBatch] = []

        def load() -> _Graph:
            t = _read(edges, ["s", "d", "p"])
            s, d, p = (t[c].to_numpy() for c in "sdp")
            return _Graph(np.unique(np.concatenate([s, d, _read(more, ["v"])["v"].to_numpy()])), s, d, p)

        def take(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            q = t["q"].to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            heads = np.append(heads, len(q)) if last else heads  # else the last question may go on
            questions = t["question_id"].combine_chunks()
            v, mass = g.rows(t["v"].to_numpy()), t["mass"].fill_null(0.0).to_numpy()
            if clean:
                mass = np.where(mass > 0, mass, 0.0)
            done = 0
            for i in range(0, len(heads) - 1, 16):
                some = heads[i : i + 17]
                totals, ranks = [], []
                for a, z in zip(some[:-1], some[1:], strict=True):
                    totals.append(float(np.round(mass[a:z], 12).sum()))
                    ranks.append(g.rank(v[a:z], mass[a:z] / totals[-1] if clean and totals[-1] > 0 else mass[a:z], damping, steps, least))
                yield from finish(g, questions.take(pa.array(some[:-1])), totals, ranks)
                done = some[-1]
            if done < len(q):
                held.extend(t.slice(done).to_batches())

        for b in batches:
            if b.num_rows:
                g = g or load()
                held.append(b)
                if sum(h.num_rows for h in held) >= 1 << 16:
                    yield from take(False)
        if held:
            yield from take(True)

    rows = reset.select(F.xxhash64("question_id").alias("q"), "question_id", F.xxhash64("id").alias("v"), F.col("mass").cast("double").alias("mass"))
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "q").sortWithinPartitions("q").mapInArrow(search, schema)


def pagerank(reset: DataFrame, transition: DataFrame, damping: float = 0.5, steps: int = 20, least: float = 0.0, cut_every: int = 4) -> DataFrame:
    """``question_id, id, rank``: fixed number of power iterations; the L1 error is at most ``2 * damping**steps``.

    With `least`, a step drops ranks below it, so that a question keeps at most ``1 / least`` vertices however large the
    graph; what is dropped is missing from the result and adds to the error.

    Mass at vertices without edges returns to the reset. `reset` has ``question_id, id, mass``. A graph that a task can hold is
    worked `in_blocks` of questions, any other by joins.
    """
    if not small(transition):
        return joined_pagerank(reset, transition, damping, steps, least, cut_every)
    every = transition.select(F.col("src").alias("id")).unionByName(transition.select(F.col("dst").alias("id"))).unionByName(reset.select("id"))
    names = _written(every.distinct().select(F.xxhash64("id").alias("v"), "id"), "vertices")

    def all_of(g: _Graph, questions: pa.Array, _: list[float], ranks: Found) -> Iterator[pa.RecordBatch]:
        if not hasattr(g, "names"):
            t = _read(names, ["v", "id"])
            g.names = t["id"].combine_chunks().take(pa.array(np.argsort(t["v"].to_numpy())))  # as many as there are codes
        at, x = (np.concatenate(y) for y in zip(*ranks, strict=True))
        of = np.repeat(np.arange(len(ranks)), [len(y) for y, _ in ranks])
        for i in range(0, len(at), 1 << 16):
            z = i + (1 << 16)
            yield pa.RecordBatch.from_arrays([questions.take(pa.array(of[i:z])), g.names.take(pa.array(at[i:z])), pa.array(x[i:z])], names=["question_id", "id", "rank"])

    return in_blocks(reset, transition, damping, steps, least, all_of, "question_id string, id string, rank double")


def joined_pagerank(reset: DataFrame, transition: DataFrame, damping: float = 0.5, steps: int = 20, least: float = 0.0, cut_every: int = 4) -> DataFrame:
    """As `pagerank`, for graphs of any size: the ranks of all questions are joined with the transitions at every step.

    The iterations run on 64-bit codes of the keys, which are a third of the keys' size; the keys are joined back once at the end.
    """
    q, v = F.xxhash64("question_id").alias("q"), F.xxhash64("id").alias("v")
    start = cut(reset.select(q, v, "mass"))
    out = cut(transition.select(F.xxhash64("src").alias("v"), F.xxhash64("dst").alias("d"), "p"))
    # mass flows only to vertices with edges, so only vertices of the reset can be without
    ends = cut(start.join(out.select("v").distinct(), "v", "left_anti").select("v").distinct())
    x = start.select("q", "v", F.col("mass").alias("rank"))
    for step in range(1, steps + 1):
        flow = x.join(out, "v").groupBy("q", F.col("d").alias("v")).agg(F.sum(F.col("rank") * F.col("p")).alias("rank"))
        lost = x.join(ends, "v", "left_semi").groupBy("q").agg(F.sum("rank").alias("lost"))
        back = start.join(lost, "q", "left").select("q", "v", (F.col("mass") * (1 - damping + damping * F.coalesce("lost", F.lit(0.0)))).alias("rank"))
        x = flow.withColumn("rank", F.col("rank") * damping).unionByName(back).groupBy("q", "v").agg(F.sum("rank").alias("rank"))
        x = x.where(F.col("rank") >= least) if least > 0 else x
        if step % cut_every == 0 or step == steps:
            x = cut(x)
    ids = transition.select(F.col("src").alias("id")).unionByName(reset.select("id")).distinct().select(v, "id")
    return x.join(reset.select(q, "question_id").distinct(), "q").join(ids, "v").select("question_id", "id", "rank")


def best_with_base(weights: DataFrame, transition: DataFrame, base: DataFrame, base_mass: float, k: int, damping: float, steps: int, least: float) -> DataFrame:
    """``question_id, id, rank``: those of `base` that can be among the `k` best of each question, by the rank `with_common_base` gives.

    `weights` has ``question_id, id, weight``, `base` ``id, rank`` of the vertices that are asked for. Ranks are told apart by nine
    digits, so all within two of the last digit of the k-th come out. Of those without special rank only the `k` best by the base can.
    """
    kept = _written(base.select(F.xxhash64("id").alias("v"), "id", "rank"), "base")

    def top(g: _Graph, questions: pa.Array, totals: list[float], ranks: Found) -> Iterator[pa.RecordBatch]:
        if not hasattr(g, "asked"):
            t = _read(kept, ["v", "id", "rank"]).sort_by([("rank", "descending"), ("id", "ascending")])
            here = np.flatnonzero(np.isin(t["v"].to_numpy(), g.codes))
            g.asked = t["id"].combine_chunks(), t["rank"].to_numpy(), here, g.rows(t["v"].to_numpy()[here])
        names, rank, here, rows = g.asked
        found = []
        for i, (total, (at, x)) in enumerate(zip(totals, ranks, strict=True)):
            if total <= 0 or not len(rank):
                continue
            every, own = np.zeros(len(g.codes)), np.zeros(len(rank))
            every[at] = x
            own[here] = every[rows]
            may = np.flatnonzero((own > 0) | (np.arange(len(own)) < k))
            score = (own[may] * total + rank[may] * base_mass) / (total + base_mass)
            many = min(k, len(score))
            ok = score >= np.partition(score, len(score) - many)[len(score) - many] - 2e-9
            found.append((np.full(ok.sum(), i), may[ok], score[ok]))
        if found:
            of, at, score = (np.concatenate(y) for y in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([questions.take(pa.array(of)), names.take(pa.array(at)), pa.array(score)], names=["question_id", "id", "rank"])

    return in_blocks(weights.withColumnRenamed("weight", "mass"), transition, damping, steps, least, top, "question_id string, id string, rank double", clean=True)


def with_common_base(special: DataFrame, special_mass: DataFrame, base: DataFrame, base_mass: float) -> DataFrame:
    """Ranks for a reset that is `special` plus an equal base on all passages.

    PageRank is linear in the reset, so the base, which is the same for all questions, is ranked once and added:
    no question needs a row for every passage. `special_mass` has ``question_id, total``; `base` has ``id, rank``.
    Only vertices with special rank get rows, with the base added; all others rank by the base alone.
    """
    joined = special.join(special_mass, "question_id").join(base.withColumnRenamed("rank", "base_rank"), "id", "left")
    all_mass = F.col("total") + F.lit(base_mass)
    rank = (F.col("rank") * F.col("total") + F.coalesce("base_rank", F.lit(0.0)) * F.lit(base_mass)) / all_mass
    return joined.select("question_id", "id", rank.alias("rank"))
