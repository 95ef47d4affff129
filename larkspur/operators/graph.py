"""Passages, sentences and entities as linked tables, and the graph over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, count_inside, leading_index


def _pairs(ner: DataFrame, col: str) -> DataFrame:
    entry = ner.select(F.explode(col).alias("key", "list"))
    return entry.select("key", F.explode("list").alias("entity")).where(F.trim("entity") != "").distinct()


def mentions(ner: DataFrame) -> DataFrame:
    """``passage_id, entity, entity_id``: the distinct entities of each passage, over all its cached writes."""
    return _pairs(ner, "passage_hash_id_to_entities").select(F.col("key").alias("passage_id"), "entity", content_id("entity", F.col("entity")).alias("entity_id"))


def sentence_entities(ner: DataFrame) -> DataFrame:
    """``sentence_id, entity_id``; both directions of the link are sides of a join."""
    return _pairs(ner, "sentence_to_entities").select(
        content_id("sentence", F.col("key")).alias("sentence_id"), content_id("entity", F.col("entity")).alias("entity_id")
    )


def mention_edges(passages: DataFrame, mention: DataFrame) -> DataFrame:
    """``passage_id, entity_id, weight``: an entity's share of a passage's mentions; entities that never occur get 0."""
    counted = mention.join(passages.select(F.col("hash_id").alias("passage_id"), "text"), "passage_id").select(
        "passage_id", "entity_id", count_inside(F.col("text"), F.col("entity")).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("passage_id"))
    return counted.select("passage_id", "entity_id", F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("weight"))


def adjacent_edges(passages: DataFrame, block: int = 100_000) -> DataFrame:
    """``src, dst, weight``: each numbered passage and the next one.

    Order is global, so it is taken in blocks of indexes: inside a block by a window, across blocks by the first of the next one.
    """
    numbered = passages.select("hash_id", leading_index(F.col("text")).alias("idx")).where("idx IS NOT NULL").withColumn("block", F.floor(F.col("idx") / block))
    inside = numbered.withColumn("next", F.lead("hash_id").over(Window.partitionBy("block").orderBy("idx", "hash_id")))
    heads = numbered.groupBy("block").agg(F.min_by("hash_id", F.struct("idx", "hash_id")).alias("head"))  # one row a block
    follow = heads.withColumn("after", F.lead("head").over(Window.orderBy("block"))).select("block", "after")
    out = inside.join(follow, "block").withColumn("dst", F.coalesce("next", "after")).where("dst IS NOT NULL")
    return out.select(F.col("hash_id").alias("src"), "dst", F.lit(1.0).alias("weight"))


def vertices(passages: DataFrame, mention: DataFrame) -> DataFrame:
    """``id, kind, content``; sentences are no vertices."""
    entity = mention.select(F.col("entity_id").alias("id"), F.lit("entity").alias("kind"), F.col("entity").alias("content")).distinct()
    return entity.unionByName(passages.select(F.col("hash_id").alias("id"), F.lit("passage").alias("kind"), F.col("text").alias("content")))


def edges(mention_edge: DataFrame, adjacent: DataFrame) -> DataFrame:
    """``src, dst, weight`` without self-loops."""
    both = mention_edge.select(F.col("passage_id").alias("src"), F.col("entity_id").alias("dst"), "weight").unionByName(adjacent)
    return both.where("src <> dst AND weight > 0")


def transitions(edge: DataFrame) -> DataFrame:
    """``src, dst, p``: both directions, the weights of each source summing to 1."""
    both = edge.unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return both.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "p")
