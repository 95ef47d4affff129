"""From passages, tags and questions to the best passages of every question, all questions in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vectors import fit_encoder
from ..operators import graph, ppr, prior, propagate, search
from ..operators.nearest import Linked
from ..session import cut, packed
from ..sources.stores import kept


@dataclass
class Index:
    """Linked tables over one snapshot of passages and tags. Parts are made when first asked for and written once.

    Questions, names and texts meet as vectors of `encode` (column to column), by default the built-in encoder fitted on the
    passages. With `store`, a folder, counts, similarities and the prior of every weight are kept there and read again; one folder is for
    one snapshot.
    """

    passages: DataFrame
    ner: DataFrame
    entity_vectors: DataFrame
    config: Config = Config()
    encode: search.Encoder | None = None
    tagger: Callable[[Column], Column] = search.capital_runs
    store: str | None = None

    def __post_init__(self) -> None:
        self.passages = self.passages.select("hash_id", "text").where("hash_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["hash_id"])
        if self.encode is None:
            self.encode = fit_encoder(self.passages, "text")

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return kept(df, f"{self.store}/{name}") if self.store else cut(df)

    @cached_property
    def mentions(self) -> DataFrame:
        return cut(graph.mentions(self.ner))

    @cached_property
    def sentence_entities(self) -> DataFrame:
        return cut(graph.sentence_entities(self.ner))

    @cached_property
    def sentences(self) -> DataFrame:
        rows = self.ner.select(F.explode("sentence_to_entities").alias("text", "list")).select("text").distinct()
        return rows.select(F.concat(F.lit("sentence-"), F.md5(F.col("text").cast("binary"))).alias("sentence_id"), "text")

    @cached_property
    def entities(self) -> DataFrame:
        return self.mentions.select("entity_id", "entity").distinct()

    @cached_property
    def counts(self) -> DataFrame:
        return self._kept("counts", prior.cooccurrence(self.sentence_entities))

    @cached_property
    def similar(self) -> DataFrame:
        c = self.config
        knn = prior.lsh_knn if c.approximate else prior.entity_knn
        return self._kept(f"similar-{c.similar}{'-approximate' if c.approximate else ''}", knn(self.entity_vectors, c.similar))

    @cached_property
    def neighbours(self) -> DataFrame:
        """The prior of the configured weight."""
        return self.neighbours_of([self.config.alpha]).drop("alpha", "rn")

    @cached_property
    def matrix_neighbours(self) -> DataFrame:
        """The prior of the matrix mode: unpruned counts, min-max scaled."""
        c = self.config
        return cut(prior.fuse(self.counts, self.similar, [c.alpha], c.partners, c.partner_weight, "min_max").drop("alpha", "rn"))

    def neighbours_of(self, alphas: list[float]) -> DataFrame:
        """The prior of several weights; with `store`, only those not stored yet are made."""
        c = self.config

        def make(some: list[float]) -> DataFrame:
            return prior.fuse(prior.prune(self.counts), self.similar, some, c.partners, c.partner_weight)

        if not self.store:
            return packed(make(alphas))
        name = f"{self.store}/prior-{c.partners}-{c.partner_weight}-{c.similar}"
        parts = [kept(make([a]), f"{name}/alpha_{a:.2f}") for a in alphas]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def transitions(self) -> DataFrame:
        edge = graph.edges(graph.mention_edges(self.passages, self.mentions), graph.adjacent_edges(self.passages))
        return cut(graph.transitions(edge))

    @cached_property
    def occurrences(self) -> DataFrame:
        return cut(search.entity_occurrences(self.passages, self.entities))

    @cached_property
    def base_rank(self) -> DataFrame:
        """Rank of every vertex when all passages weigh the same; one run for all questions."""
        reset = self.passages.select(F.lit("").alias("question_id"), F.col("hash_id").alias("id"), F.lit(1.0).alias("weight"))
        return cut(ppr.pagerank(ppr.clean_reset(reset), self.transitions, self.config.damping, self.config.rank_steps).select("id", "rank"))

    def seeds(self, questions: DataFrame) -> DataFrame:
        return cut(search.seeds(search.question_entities(questions, self.tagger), self.entities, self.encode))

    def near(self, questions: DataFrame) -> DataFrame:
        """The sentences of each question that can pass the gate, with their entities."""
        sims = search.question_sims(questions, self.sentences, "sentence_id", "text", self.encode, least=self.config.gate)
        return packed(propagate.question_sentences(sims, self.sentence_entities))

    def linked(self, questions: DataFrame) -> Linked:
        """Finds the sentences of `near` from a question's entities, without a row for all the others."""
        asked = questions.select(F.col("question_id").alias("id"), F.col("question").alias("v"))
        texts = self.sentences.select(F.col("sentence_id").alias("id"), F.col("text").alias("v"))
        return Linked(asked, texts, self.sentence_entities.toDF("id", "link"), self.encode, self.config.gate)

    def passage_sims(self, questions: DataFrame) -> DataFrame:
        """Similarities that count; all of them if keywords are to be boosted, and only then read twice and kept."""
        c = self.config
        sims = search.question_sims(questions, self.passages, "hash_id", "text", self.encode, least=-1.0 if c.boost > 0 else c.related)
        return packed(sims) if c.boost > 0 else sims

    def best_passages(self, questions: DataFrame) -> DataFrame:
        """``question_id, hash_id, sim``: the most similar passages of every question."""
        return search.question_sims(questions, self.passages, "hash_id", "text", self.encode, k=self.config.passages)


def propagated(index: Index, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active entities and evidence of all questions."""
    c = index.config
    return propagate.propagate(index.seeds(questions), index.linked(questions), index.neighbours, c.gate, c.sentences, c.hops + 1)


def scored_passages(index: Index, questions: DataFrame, active: DataFrame, sims: DataFrame) -> DataFrame:
    c = index.config
    extra = search.attribute_boost(questions, index.passages, sims, c.keywords, c.boost) if c.boost > 0 else None
    return search.passage_scores(sims, search.entity_bonus(active, index.occurrences), index.passages.count(), c.passage_share, extra)


def ranked(index: Index, evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """``question_id, hash_id, score``: PageRank of passages, at least of the best ones; the base all passages share is ranked once."""
    c = index.config
    base = c.passage_share
    above = scores.select("question_id", F.col("passage_id").alias("id"), (F.col("score") - base).alias("weight")).where("weight > 0")
    total_base = base * index.passages.count()
    if ppr.small(index.transitions):
        special = evidence.select("question_id", F.col("entity_id").alias("id"), "weight").unionByName(above)
        asked = index.base_rank.join(index.passages.select(F.col("hash_id").alias("id")), "id", "left_semi")
        best = ppr.best_with_base(packed(special), index.transitions, asked, total_base, c.passages, c.damping, c.rank_steps, c.rank_least)
        return best.select("question_id", F.col("id").alias("hash_id"), F.round("rank", 9).alias("score"))
    special = cut(evidence.select("question_id", F.col("entity_id").alias("id"), "weight").unionByName(above))
    mass = special.groupBy("question_id").agg(F.sum(F.round("weight", 12).cast("decimal(38,12)")).cast("double").alias("total"))
    own = ppr.pagerank(ppr.clean_reset(special), index.transitions, c.damping, c.rank_steps, c.rank_least)
    with_base = ppr.with_common_base(own, mass, index.base_rank, total_base)
    passage = index.passages.select(F.col("hash_id").alias("id"))
    with_base = with_base.join(passage, "id", "left_semi")
    # passages without special rank: only the best few by the base can come among the best
    best = index.base_rank.join(passage, "id", "left_semi").orderBy(F.desc("rank"), "id").limit(c.passages)
    rest = mass.crossJoin(F.broadcast(best)).select("question_id", "id", (F.col("rank") * total_base / (F.col("total") + total_base)).alias("rank"))
    rest = rest.join(with_base.select("question_id", "id"), ["question_id", "id"], "left_anti")
    return with_base.unionByName(rest).select("question_id", F.col("id").alias("hash_id"), F.round("rank", 9).alias("score"))


def retrieve(index: Index, questions: DataFrame) -> DataFrame:
    """``question_id, rank, hash_id, score``. Questions without a seed fall back to plain similarity."""
    active, evidence = propagated(index, questions)
    active = cut(active)
    seeded = active.select("question_id").distinct()
    asked = questions.join(seeded, "question_id", "left_semi")
    by_graph = ranked(index, evidence, scored_passages(index, asked, active, index.passage_sims(asked)))
    plain = index.best_passages(questions.join(seeded, "question_id", "left_anti")).withColumnRenamed("sim", "score")
    rank = Window.partitionBy("question_id").orderBy(F.desc("score"), "hash_id")
    both = by_graph.unionByName(plain)
    return both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= index.config.passages).select("question_id", "rank", "hash_id", "score")


def nested(results: DataFrame, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """One row a question: ``question, sorted_passage, sorted_passage_scores, gold_answer``."""
    rows = results.join(passages.select("hash_id", "text"), "hash_id")
    best = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "score"))).alias("r"))  # at most top-k a question
    out = questions.join(best, "question_id", "left")
    return out.select("question", F.col("r.text").alias("sorted_passage"), F.col("r.score").alias("sorted_passage_scores"), F.col("answer").alias("gold_answer"))
