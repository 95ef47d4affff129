"""The whole index of a growing corpus: tags, and stores of passages, sentences and entities, in one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..providers import capital_tagger, embed, hash_encoder, tag
from ..session import cut
from ..sources.stores import STORE, append_store, new_texts, read_or_empty
from .retrieve import Index

TAGS = "passage_id string, sentence string, entity string, label string"


def extend(texts: DataFrame, path: str, tagger: Callable[[str], list[tuple[str, str, str]]] = capital_tagger, encoder: Callable = hash_encoder) -> None:
    """Takes in the texts (column `text`) that the corpus at `path` lacks: only these are tagged and encoded.

    Tags are stored first and passages last, so what an interrupted run has left half done is found and finished by the next one.
    Running it again with texts known already adds nothing.
    """
    spark = texts.sparkSession
    passages = cut(new_texts(texts, read_or_empty(spark, f"{path}/passages", STORE), "passage"))
    if passages.isEmpty():
        return
    stored = read_or_empty(spark, f"{path}/tags", TAGS)
    open_ = passages.join(stored.select(F.col("passage_id").alias("hash_id")), "hash_id", "left_anti")
    append_store(tag(open_, tagger), f"{path}/tags")
    mine = read_or_empty(spark, f"{path}/tags", TAGS).join(passages.select(F.col("hash_id").alias("passage_id")), "passage_id", "left_semi")
    for name, space in (("sentence", "sentences"), ("entity", "entities")):
        new = new_texts(mine.select(F.col(name).alias("text")), read_or_empty(spark, f"{path}/{space}", STORE), name)
        append_store(embed(new, encoder), f"{path}/{space}")
    append_store(embed(passages, encoder), f"{path}/passages")


def tags_as_maps(tags: DataFrame) -> DataFrame:
    """``passage_hash_id_to_entities, sentence_to_entities``, one row a passage: tags in the form of the cached ones."""
    one = tags.where("entity IS NOT NULL AND sentence IS NOT NULL").select("passage_id", "sentence", "entity").distinct()
    by = one.groupBy("passage_id", "sentence").agg(F.sort_array(F.collect_list("entity")).alias("list"))  # the entities of one sentence
    rows = by.groupBy("passage_id").agg(
        F.array_distinct(F.flatten(F.collect_list("list"))).alias("all"), F.map_from_entries(F.collect_list(F.struct("sentence", "list"))).alias("sentence_to_entities")
    )
    return rows.select(F.create_map("passage_id", "all").alias("passage_hash_id_to_entities"), "sentence_to_entities")


def load(spark: SparkSession, path: str, **settings) -> Index:
    """The index over the corpus at `path`."""
    tags = read_or_empty(spark, f"{path}/tags", TAGS)
    return Index(read_or_empty(spark, f"{path}/passages", STORE), tags_as_maps(tags), read_or_empty(spark, f"{path}/entities", STORE), **settings)


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """``passage_id, entity_id``, straight from the tags."""
    return read_or_empty(spark, f"{path}/tags", TAGS).select("passage_id", content_id("entity", F.col("entity")).alias("entity_id")).distinct()
