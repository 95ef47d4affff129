"""Registered queries of the numbered problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table, work_path
from .contamination import leaked_items
from .cooccurrence import NOT_BLANK, PairTable, records
from .mixing import mix
from .name_variants import name_sets, variant_pairs
from .pair_defects import pair_defects
from .reading_level import english_measures, fit_languages, fit_scales, grades, reading_levels
from .sentences import split_sentences
from .similar_vectors import linked_pairs, similar_vectors
from .sql import SQL as SQL
from .term_frequency import banded, term_intervals

KINDS = {"passage": "passage_hash_id_to_entities", "sentence": "sentence_to_entities"}


def p1_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Every triggered defect of every answer."""
    fields = ["pred_answer", "gold_answer", "llm_judge_answer"]
    found = pair_defects(spread(table(spark, sf, "predictions").select("pred_id", "question", *fields)), "pred_id", "question", "gold_answer", fields, "llm_judge_answer")
    return found.select(F.col("key").alias("pred_id"), "field", F.explode("defects").alias("defect")).distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["pred_answer", "gold_answer", "llm_judge_answer"]
    found = pair_defects(spread(table(spark, sf, "predictions").select("pred_id", "question", *fields)), "pred_id", "question", "gold_answer", fields, "llm_judge_answer")
    return found.select(F.col("key").alias("pred_id"), "field", F.col("defects")[0].alias("defect")).distinct()


def pair_table(spark: SparkSession, sf: str) -> tuple[PairTable, DataFrame]:
    """The pair table after two loads, the second into the reopened table: rows written in the first four fifths of the time, then all later ones."""
    ner = table(spark, sf, "ner_results")
    at = F.unix_micros(F.col("written_at").cast("timestamp"))
    lo, hi = ner.agg(F.min(at), F.max(at)).first()
    early = F.coalesce(at <= F.lit((lo or 0) + ((hi or 0) - (lo or 0)) * 4 // 5), F.lit(True))
    path, touched = work_path(spark, "pairs"), None
    for part in (ner.where(early), ner.where(~early)):
        rows = [records(part, kind, col) for kind, col in KINDS.items()]
        counts = PairTable(spark, path)
        touched = counts.apply(rows[0].unionByName(rows[1]))
    return counts, touched


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    counts, _ = pair_table(spark, sf)
    return counts.scores(5, 5).select(F.col("kind").alias("record_kind"), F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))


def _scored(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("kind").alias("record_kind"), F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair with its counts and its lift."""
    counts, _ = pair_table(spark, sf)
    return _scored(counts.scores())


def p2_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Only the pairs whose counts the second load may have changed, scored again."""
    counts, touched = pair_table(spark, sf)
    return _scored(counts.scores(affected=touched))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        linked_pairs(similar_vectors(table(spark, sf, f"{s}_embedding"), "hash_id", "embedding", 5, 0.9), F.lit(s))
        for s in ("entity", "sentence")
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    sets = name_sets(spread(table(spark, sf, "entity_embedding").select("hash_id", "text")), "hash_id", "text", table(spark, sf, "nicknames"))
    return variant_pairs(sets)


def p4_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The set of every name, named by its smallest member, and the set's size."""
    sets = name_sets(spread(table(spark, sf, "entity_embedding").select("hash_id", "text")), "hash_id", "text", table(spark, sf, "nicknames"))
    whole = sets.groupBy("entity").agg(F.min("id").alias("set_id"), F.count("*").alias("set_size"))
    return sets.join(whole, "entity").select(F.col("id").alias("hash_id"), "set_id", "set_size")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        split_sentences(table(spark, sf, f"{s}_embedding"), "hash_id", "text", indexed=s == "passage").select(F.lit(s).alias("store"), "*")
        for s in ("passage", "sentence")
    ]
    return parts[0].unionByName(parts[1])


def _term_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Term sequences of both fields and the number of records of each field."""
    entry = table(spark, sf, "ner_results").select(F.explode("passage_hash_id_to_entities").alias("record", "list")).distinct()
    ner = entry.select(F.lit("ner_entity").alias("field"), "record", F.filter("list", lambda x: x.rlike(NOT_BLANK)).alias("terms"))
    names = table(spark, sf, "entity_embedding").select("hash_id", "text").distinct()
    words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != "")
    rows = ner.unionByName(names.select(F.lit("entity_term").alias("field"), F.col("hash_id").alias("record"), words.alias("terms")))
    totals = rows.groupBy("field").agg(F.countDistinct("record").alias("total"))
    return rows, totals


def _term_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows, totals = _term_rows(spark, sf)
    return banded(term_intervals(rows, "field", "record", "terms"), totals, {"ner_entity": 0.03, "entity_term": 0.02})


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of single terms: the intervals that a term alone opens."""
    return _term_intervals(spark, sf).where("shortest = 1 AND band IS NOT NULL").select("field", F.col("gram")[0].alias("term"), "band")


def p6_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, records and band of the n-grams of every length: one row for those that occur in the same places, from `shortest` terms to the whole gram."""
    return _term_intervals(spark, sf).select("field", F.array_join("gram", "\x1f").alias("gram"), "shortest", F.size("gram").alias("longest"), "occurrences", "records", F.coalesce("band", F.lit("")).alias("band"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text").select("item_id", "doc_id")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mix(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source", table(spark, sf, "source_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of tokens each source reaches."""
    return mix(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source", table(spark, sf, "source_targets"))[1]


def p8_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a mix as large as all tokens of the sources together, which the repetition limits allow only at a lower exponent."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mix(docs, "doc_id", "text", "source", table(spark, sf, "source_targets"), budget_share=1.0)[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    scales = fit_scales(table(spark, sf, "graded_texts"), "text", "reading_level")
    levels = reading_levels(docs, "doc_id", "text", scales, fit_languages(docs, "text", "lang"))
    return levels.select(F.col("key").alias("doc_id"), "reading_level")


def p9_grades(spark: SparkSession, sf: str) -> DataFrame:
    """The grades of every English prose text by the published formulas, and their median."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    out = grades(english_measures(docs, "doc_id", "text", fit_languages(docs, "text", "lang"))).dropDuplicates(["key"])
    return out.select(F.col("key").alias("doc_id"), *[F.round(c, 3).alias(c) for c in out.columns[1:]])


QUERIES = {
    "p1_found": p1_found,
    "p1_defects": p1_defects,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_changed": p2_changed,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sets": p4_sets,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_ngrams": p6_ngrams,
    "p7_found": p7_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_budget": p8_budget,
    "p9_found": p9_found,
    "p9_grades": p9_grades,
}
