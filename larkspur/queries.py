"""Registered queries of the core, over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as tx
from .operators import graph, ppr, prior, propagate, search
from .plans import answer, corpus, retrieve
from .providers import first_passage, same_text_judge
from .session import cut, table, work_path
from .sources import stores
from .sql import SQL as SQL
from .streaming.incremental import follow

#: The gate is the published setting of two of the four data sets (default 0.5). Passages below a cosine of 0.15 do not count as similar, and ranks below a millionth are dropped.
CONFIG = Config(gate=0.4, related=0.15, rank_least=1e-6)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "predictions").where("question IS NOT NULL")
    return rows.groupBy("question").agg(F.max("gold_answer").alias("answer")).select(tx.content_id("question", F.col("question")).alias("question_id"), "question", "answer")


def _index(spark: SparkSession, sf: str, **settings) -> retrieve.Index:
    return retrieve.Index(table(spark, sf, "passage_embedding"), table(spark, sf, "ner_results"), table(spark, sf, "entity_embedding"), replace(CONFIG, **settings))


def passage_index(spark, sf):
    return table(spark, sf, "passage_embedding").select("hash_id", tx.leading_index(F.col("text")).alias("idx")).distinct()


def passage_hash(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", tx.content_id("passage", tx.indexed_chunk(F.col("doc_id"), F.col("text"))).alias("hash_id"))


def distinct_entities(spark, sf):
    return graph.mentions(table(spark, sf, "ner_results"))


def sentence_entities(spark, sf):
    return graph.sentence_entities(table(spark, sf, "ner_results"))


def label_filter(spark, sf):
    words = table(spark, sf, "passage_embedding").select("hash_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return words.select("hash_id", "w", tx.entity_label(F.col("w")).alias("label")).where(~F.col("label").isin(*tx.NO_ANSWER_LABELS)).groupBy("hash_id").agg(F.count("*").alias("kept"))


def cooccur_counts(spark, sf):
    return prior.cooccurrence(graph.sentence_entities(table(spark, sf, "ner_results")))


def cooccur_pruned(spark, sf):
    return prior.prune(cooccur_counts(spark, sf))


def entity_knn(spark, sf):
    return prior.entity_knn(table(spark, sf, "entity_embedding"), CONFIG.similar)


def lsh_knn(spark, sf):
    return prior.lsh_knn(table(spark, sf, "entity_embedding"), CONFIG.similar)


def dense_neighbors(spark, sf):
    """Exact neighbours, a tenth of all entities of each."""
    return prior.dense_knn(table(spark, sf, "entity_embedding"))


def fused_neighbors(spark, sf):
    return _index(spark, sf).neighbours_of([CONFIG.alpha])


def alpha_sweep_neighbors(spark, sf):
    return _index(spark, sf).neighbours_of(tx.alpha_grid())


def neighbor_stats(spark, sf):
    index = _index(spark, sf)
    return prior.neighbour_stats(index.neighbours_of(tx.alpha_grid()), index.entities)


def mention_edges(spark, sf):
    index = _index(spark, sf)
    return graph.mention_edges(index.passages, index.mentions).withColumn("weight", F.round("weight", 9))


def adjacent_edges(spark, sf):
    return graph.adjacent_edges(_index(spark, sf).passages)


def graph_vertices(spark, sf):
    index = _index(spark, sf)
    return graph.vertices(index.passages, index.mentions)


def graph_edges(spark, sf):
    index = _index(spark, sf)
    return graph.edges(graph.mention_edges(index.passages, index.mentions), graph.adjacent_edges(index.passages)).withColumn("weight", F.round("weight", 9))


def transition_matrix(spark, sf):
    return _index(spark, sf).transitions.withColumn("p", F.round("p", 9))


def question_entities(spark, sf):
    return search.question_entities(_questions(spark, sf))


def seed_entities(spark, sf):
    return _index(spark, sf).seeds(_questions(spark, sf))


def question_sentence_sim(spark, sf):
    """The ten most similar sentences of every question."""
    index = _index(spark, sf)
    return search.question_sims(_questions(spark, sf), index.sentences, "sentence_id", "text", index.encode, k=10)


def dense_topk(spark, sf):
    best = _index(spark, sf).best_passages(_questions(spark, sf))
    return search.dense_topk(best, "hash_id", CONFIG.passages).withColumn("rank", F.col("rank").cast("bigint"))


def _first_hop(spark, sf):
    index, q = _index(spark, sf), _questions(spark, sf)
    pick, step = propagate.semantic_hop(index.seeds(q), None, index.linked(q), index.neighbours, CONFIG.gate, CONFIG.sentences)
    return index, pick, step


def hop1_semantic(spark, sf):
    return _first_hop(spark, sf)[2].withColumn("next", F.round("next", 9))


def hop1_structural(spark, sf):
    index, _, step = _first_hop(spark, sf)
    reached = step.groupBy("question_id", F.col("dst").alias("entity_id")).agg(F.max_by("next", F.struct("src", "sentence_id")).alias("score"))
    return propagate.structural_hop(reached, index.neighbours, CONFIG.gate).withColumn("score", F.round("score", 9))


def propagate_sync(spark, sf):
    active, _ = retrieve.propagated(_index(spark, sf), _questions(spark, sf))
    return active.withColumn("score", F.round("score", 9))


def evidence_sync(spark, sf):
    return retrieve.propagated(_index(spark, sf), _questions(spark, sf))[1].withColumn("weight", F.round("weight", 9))


def propagate_matrix(spark, sf):
    index, q, c = _index(spark, sf), _questions(spark, sf), CONFIG
    active, weight = propagate.propagate_matrix(index.seeds(q), index.linked(q), index.matrix_neighbours, c.gate, c.sentences, c.hops + 1)
    return weight.join(active, ["question_id", "entity_id"], "left").withColumns({"weight": F.round("weight", 9), "score": F.round("score", 9)})


def propagate_exact(spark, sf):
    index, q, c = _index(spark, sf), _questions(spark, sf), CONFIG
    return propagate.propagate_exact(index.seeds(q), index.near(q), index.neighbours, c.gate, c.sentences, c.hops + 1)


def entity_occurrences(spark, sf):
    return _index(spark, sf).occurrences


def entity_bonus(spark, sf):
    index = _index(spark, sf)
    active, _ = retrieve.propagated(index, _questions(spark, sf))
    return search.entity_bonus(active, index.occurrences).withColumn("bonus", F.round("bonus", 6))


def passage_scores(spark, sf):
    """Scores above the common base, of the questions with seeds."""
    index, q = _index(spark, sf), _questions(spark, sf)
    active, _ = retrieve.propagated(index, q)
    asked = q.join(active.select("question_id").distinct(), "question_id", "left_semi")
    return retrieve.scored_passages(index, asked, active, index.passage_sims(asked)).withColumn("score", F.round("score", 6))


def attribute_boost(spark, sf):
    index, q = _index(spark, sf, boost=0.25), _questions(spark, sf)
    return search.attribute_boost(q, index.passages, None, index.config.keywords, index.config.boost).withColumn("boost", F.round("boost", 9))


def ppr_scores(spark, sf):
    """Rank of every vertex from each question's seeds."""
    index = _index(spark, sf)
    reset = ppr.clean_reset(index.seeds(_questions(spark, sf)).select("question_id", F.col("entity_id").alias("id"), F.col("score").alias("weight")))
    out = ppr.pagerank(reset, index.transitions, CONFIG.damping, CONFIG.rank_steps, CONFIG.rank_least)
    return out.withColumn("rank", F.round("rank", 6)).where("rank > 0")


def retrieve_topk(spark, sf):
    out = retrieve.retrieve(_index(spark, sf), _questions(spark, sf))
    return out.select("question_id", F.col("rank").cast("bigint").alias("rank"), "hash_id", F.round("score", 6).alias("score"))


def retrieval_nested(spark, sf):
    index, q = _index(spark, sf), _questions(spark, sf)
    best = search.dense_topk(index.best_passages(q), "hash_id", CONFIG.passages).withColumnRenamed("sim", "score")
    return retrieve.nested(best, q, index.passages)


def link_sparsity(spark, sf):
    """How full the link tables are, as matrices."""
    index = _index(spark, sf)
    return prior.sparsity(mentions=index.mentions.select("passage_id", "entity_id"), sentence_entities=index.sentence_entities, cooccurrence=index.counts.select("src", "dst"))


def normalize_answer(spark, sf):
    return table(spark, sf, "predictions").select("pred_id", tx.normalize_answer(F.col("pred_answer")).alias("normal"))


def contain_accuracy(spark, sf):
    return table(spark, sf, "predictions").select("pred_id", tx.contains_gold(F.col("pred_answer"), F.col("gold_answer")).alias("contain"))


def extract_answer(spark, sf):
    return table(spark, sf, "predictions").where("pred_answer IS NOT NULL").select("pred_id", tx.extract_answer(F.col("pred_answer")).alias("answer"))


def judge_verdict(spark, sf):
    score, kept = tx.judge_verdict(F.col("llm_judge_answer"))
    return table(spark, sf, "predictions").where("llm_judge_answer IS NOT NULL").select("pred_id", score.alias("score"), kept.alias("verdict"))


def accuracy_summary(spark, sf):
    return answer.summary(table(spark, sf, "predictions").dropDuplicates(["pred_id"]), ["dataset_name"])


def pending_rows(spark, sf):
    return answer.pending(table(spark, sf, "predictions")).select("pred_id").distinct()


def failed_rows(spark, sf):
    p = table(spark, sf, "predictions")
    both = [answer.failed(p, c, f).select("pred_id", F.lit(c).alias("stage")) for c, f in (("pred_answer", answer.ANSWER_FLAGS), ("llm_judge_answer", answer.JUDGE_FLAGS))]
    return both[0].unionByName(both[1]).distinct()


def percent_parse(spark, sf):
    raw = F.when(F.col("llm_accuracy").isNull(), "n/a").otherwise(F.concat((F.col("llm_accuracy") * 100).cast("int").cast("string"), F.lit("%")))
    return table(spark, sf, "predictions").select("pred_id", tx.percent(raw).alias("value"))


def _ledger(spark, sf):
    p = table(spark, sf, "predictions").dropDuplicates(["pred_id"]).withColumn("alpha", F.round((F.col("pred_id") % 21) * 0.05, 2))
    return p.groupBy(F.col("alpha").alias("cooccur_alpha")).agg(
        F.lit(5).alias("top_k_entity_cooccur"), F.round(F.avg("llm_accuracy"), 6).alias("EM"), F.round(F.avg("contain_accuracy"), 6).alias("Contain_Acc"), F.lit("run").alias("result_dir")
    )


def best_alpha(spark, sf):
    return answer.best_run(_ledger(spark, sf))


def alphas_pending(spark, sf):
    grid = spark.createDataFrame([(a,) for a in tx.alpha_grid()], "alpha double")
    return answer.pending_alphas(grid, _ledger(spark, sf).where("EM > 0.55"))


def new_passages_anti(spark, sf):
    texts = table(spark, sf, "ner_results").select(F.explode(F.map_keys("sentence_to_entities")).alias("text"))
    return stores.new_texts(texts, table(spark, sf, "sentence_embedding"), "sentence")


def merge_union(spark, sf):
    out = stores.merge_ner(table(spark, sf, "ner_results"), "passage_hash_id_to_entities")
    return out.select("key", F.array_join("entities", "|").alias("entities"))


def merge_override(spark, sf):
    out = stores.override_ner(table(spark, sf, "ner_results"), "passage_hash_id_to_entities", "written_at")
    return out.select("key", F.array_join("entities", "|").alias("entities"))


def prompt_messages(spark, sf):
    p = table(spark, sf, "predictions").dropDuplicates(["pred_id"])
    m = tx.chat_messages(answer.SYSTEM, F.coalesce("sorted_passage", F.array().cast("array<string>")), F.col("question"))
    return p.select("pred_id", F.md5(m[1]["content"].cast("binary")).alias("content_md5"), F.length(m[1]["content"]).cast("bigint").alias("chars"))


def qa_pipeline(spark, sf):
    """Missing and failed answers are produced, then judged, by the built-in stand-ins for models."""
    p = table(spark, sf, "predictions").dropDuplicates(["pred_id"]).select("pred_id", "question", "sorted_passage", "gold_answer", "pred_answer", "llm_judge_answer", "llm_accuracy", "contain_accuracy")
    done = answer.judge(answer.answer(p, first_passage, 1), same_text_judge, 1)
    return done.select("pred_id", "pred_answer", "llm_judge_answer", "llm_accuracy", "contain_accuracy")


def incremental_index(spark, sf):
    """The store after the passages' texts arrived as a stream of files, twice."""
    src, store = work_path(spark, "arriving"), work_path(spark, "store")
    texts = table(spark, sf, "passage_embedding").select("text")
    texts.repartition(2).write.parquet(src)
    for _ in range(2):
        follow(spark, src, store, work_path(spark, "stream")).awaitTermination()
    return spark.read.schema(stores.STORE).parquet(store).select("hash_id", "text")


def whole_index(spark, sf):
    """Mentions after the passages were taken in by the built-in tagger and encoder, half of them twice."""
    path = work_path(spark, "corpus")
    texts = table(spark, sf, "passage_embedding").select("text")
    corpus.extend(texts.where(F.xxhash64("text") % 2 == 0), path)
    corpus.extend(texts, path)
    return corpus.mentions(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        passage_index, passage_hash, distinct_entities, sentence_entities, label_filter, cooccur_counts, cooccur_pruned, entity_knn, lsh_knn, fused_neighbors,
        alpha_sweep_neighbors, neighbor_stats, mention_edges, adjacent_edges, graph_vertices, graph_edges, transition_matrix, question_entities, seed_entities,
        question_sentence_sim, dense_topk, hop1_semantic, hop1_structural, propagate_sync, evidence_sync, propagate_matrix, propagate_exact, entity_occurrences,
        entity_bonus, passage_scores, attribute_boost, ppr_scores, retrieve_topk, retrieval_nested, link_sparsity, dense_neighbors, normalize_answer, contain_accuracy, extract_answer, judge_verdict,
        accuracy_summary, pending_rows, failed_rows, percent_parse, best_alpha, alphas_pending, new_passages_anti, merge_union, merge_override, prompt_messages,
        qa_pipeline, incremental_index, whole_index,
    )
}
