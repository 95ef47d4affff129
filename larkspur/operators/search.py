"""What a question is near to: entities in it, seeds, sentences, passages; and passage scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_ANSWER_LABELS, count_inside, entity_label, is_attribute_question, keyword_overlap
from ..functions.vectors import min_max
from ..session import cut
from .nearest import nearest

Encoder = Callable[[Column], Column]

#: A run of capitalised words, with the particles inside it: the built-in notion of a name.
NAME = r"\p{Lu}[\p{L}\p{M}’']+(?:[ -](?:(?:of|and|the|de|la|der|von) )*\p{Lu}[\p{L}\p{M}’'.]*)*"
#: A first word that no capital follows is no name.
FIRST_WORD = r"^([^\p{L}]*)\p{Lu}([\p{L}\p{M}’']*[^\p{L}\p{M}’']+[^\p{Lu}])"


def capital_runs(question: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(question, FIRST_WORD, "$1x$2"), F.lit(NAME), F.lit(0))


def question_entities(questions: DataFrame, tagger: Callable[[Column], Column] = capital_runs) -> DataFrame:
    """``question_id, name``: lower-cased names that `tagger` finds in each question, without bare numbers."""
    found = questions.select("question_id", F.explode(tagger(F.col("question"))).alias("name"))
    return found.select("question_id", F.lower("name").alias("name")).where(~entity_label(F.col("name")).isin(*NO_ANSWER_LABELS)).distinct()


def seeds(names: DataFrame, entities: DataFrame, encode: Encoder) -> DataFrame:
    """``question_id, entity_id, score``: the most similar entity of every name in a question.

    `entities` has ``entity_id, entity``. Several names with one entity keep the last name's score.
    """
    asked = names.select(F.col("name").alias("id"), F.col("name").alias("v"))
    best = nearest(asked, entities.select(F.col("entity_id").alias("id"), F.col("entity").alias("v")), 1, encode=encode)
    return names.join(best.withColumnRenamed("query", "name"), "name").groupBy("question_id", F.col("item").alias("entity_id")).agg(F.max_by("sim", "name").alias("score"))


def question_sims(questions: DataFrame, texts: DataFrame, key: str, text: str, encode: Encoder, k: int | None = None, least: float | None = None) -> DataFrame:
    """``question_id, <key>, sim``: of every question the `k` most similar texts, those of at least `least`, or both."""
    asked = questions.select(F.col("question_id").alias("id"), F.col("question").alias("v"))
    found = nearest(asked, texts.select(F.col(key).alias("id"), F.col(text).alias("v")), k, least, encode=encode)
    return found.toDF("question_id", key, "sim")


def dense_topk(sims: DataFrame, key: str, k: int) -> DataFrame:
    """The k most similar texts of each question, with their rank."""
    rank = Window.partitionBy("question_id").orderBy(F.desc("sim"), key)
    return sims.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _grams(rows: DataFrame, key: str, text: str, q: int, window: int) -> DataFrame:
    """``<key>, gram``: hashes of the runs of `q` letters that are smallest in some `window` neighbouring runs.

    Two texts that share ``q + window - 1`` letters in a row share one of these, as the choice looks at nothing else.
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0), []
            for t in b.column(1).to_pylist():
                c = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                h = np.zeros(max(len(c) - q + 1, 0), np.uint64)
                for i in range(q):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(h)]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                if len(h) >= window:
                    h = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
                out.append(np.unique(h) if len(c) >= q + window - 1 else h[:0])
            at = np.repeat(np.arange(len(out)), [len(x) for x in out])
            flat = np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(flat)], names=[key, "gram"])

    return rows.select(key, text).mapInArrow(chosen, f"{key} string, gram bigint")


def _proposed(names: DataFrame, passages: DataFrame, q: int, window: int) -> DataFrame:
    """``entity_id, name, hash_id`` where the rarest of the name's chosen runs is one of the passage's."""
    inside = _grams(passages, "hash_id", "low", q, window)
    of_name = _grams(names, "entity_id", "name", q, window)
    rare = of_name.join(inside.groupBy("gram").agg(F.count("*").alias("df")), "gram").groupBy("entity_id").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    return rare.join(inside, "gram").join(names, "entity_id").select("entity_id", "name", "hash_id")


def entity_occurrences(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """``passage_id, entity_id, n``: how often an entity's lower-cased text stands in a passage, exactly.

    Pairs are proposed by one run of letters that a name shares with every passage that holds it, never by testing all
    names against all passages; names of fewer than eight letters go by runs of their own length. Every pair is then counted
    in the whole text, which a passage brings once for all its names.
    """
    names = entities.select("entity_id", F.lower("entity").alias("name")).where("name <> ''").dropDuplicates(["entity_id"])
    low = passages.select("hash_id", F.lower("text").alias("low")).where("low IS NOT NULL").dropDuplicates(["hash_id"])
    near = _proposed(names.where(F.length("name") >= 8), low, 4, 5)
    short = names.where(F.length("name") < 8)
    for q, some in ((4, F.length("name") >= 4), (3, F.length("name") == 3), (2, F.length("name") == 2), (1, F.length("name") == 1)):
        part = short.where(some)
        if not part.isEmpty():
            near = near.unionByName(_proposed(part, low, q, 1))
    by = near.groupBy("hash_id").agg(F.collect_list(F.struct("entity_id", "name")).alias("names"))  # no more than a text has letters in a few lengths
    pairs = by.join(low, "hash_id").select("hash_id", "low", F.explode("names").alias("e"))
    counted = pairs.select(F.col("hash_id").alias("passage_id"), "e.entity_id", count_inside(F.col("low"), F.col("e.name")).alias("n"))
    return counted.where("n > 0")


def entity_bonus(active: DataFrame, occurrences: DataFrame, block: int = 256) -> DataFrame:
    """``question_id, passage_id, bonus``: sum of score * ln(1 + n) / tier over the active entities in a passage.

    An entity in more than `block` passages meets its questions in several parts, so no task makes all pairs of a frequent one.
    """
    many = occurrences.groupBy("entity_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    asked = active.join(many, "entity_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    held = occurrences.join(many, "entity_id", "left").withColumn("part", F.pmod(F.xxhash64("passage_id"), parts).cast("int")).drop("parts")
    part = F.col("score") * F.log1p("n") / F.greatest("tier", F.lit(1))
    return asked.join(held, ["entity_id", "part"]).groupBy("question_id", "passage_id").agg(F.sum(F.round(part, 12).cast("decimal(38,12)")).cast("double").alias("bonus"))


def passage_scores(sims: DataFrame, bonus: DataFrame, total_passages: int, weight: float, extra: DataFrame | None = None) -> DataFrame:
    """``question_id, passage_id, score``: exp of the scaled similarity plus bonuses, times `weight`.

    Only passages above the common base ``weight * exp(0)`` have rows; `extra` holds further bonuses.
    """
    # similarities and bonuses of a question meet in one shuffle, by the question
    both = sims.select("question_id", F.col("hash_id").alias("passage_id"), "sim", F.lit(None).cast("double").alias("bonus"))
    both = both.unionByName(bonus.select("question_id", "passage_id", F.lit(None).cast("double").alias("sim"), "bonus"))
    by = Window.partitionBy("question_id")
    low = F.when(F.count("sim").over(by) < total_passages, 0.0).otherwise(F.greatest(F.min("sim").over(by), F.lit(0.0)))
    scaled = F.when(F.col("sim").isNotNull(), min_max(F.col("sim"), low, F.greatest(F.max("sim").over(by), F.lit(0.0))))
    out = both.select("question_id", "passage_id", scaled.alias("near"), "bonus").groupBy("question_id", "passage_id").agg(F.max("near").alias("near"), F.max("bonus").alias("bonus"))
    total = F.exp(F.coalesce("near", F.lit(0.0))) + F.coalesce("bonus", F.lit(0.0))
    if extra is not None:
        out = out.join(extra, ["question_id", "passage_id"], "left")
        total = total + F.coalesce("boost", F.lit(0.0))
    return out.select("question_id", "passage_id", (F.lit(weight) * total).alias("score"))


def attribute_boost(questions: DataFrame, passages: DataFrame, sims: DataFrame | None, keywords: Sequence[str], boost: float, spread: int = 16) -> DataFrame:
    """``question_id, passage_id, boost`` of the passages in `sims`, for attribute questions: `boost` * ln(1 + shared keywords).

    Without `sims`, of all passages that share a keyword: a question and a passage meet by the sets of keywords in them, of which
    there are few, so only pairs of the result are made. A set may be that of most questions; its passages fall into `spread` parts.
    """
    asked = questions.where(is_attribute_question(F.col("question"), keywords)).select("question_id", "question")
    if sims is not None:
        near = sims.join(asked, "question_id").join(passages.select("hash_id", "text"), "hash_id")
        n = keyword_overlap(F.col("question"), F.col("text"), keywords)
        return near.select("question_id", F.col("hash_id").alias("passage_id"), (F.lit(boost) * F.log1p(n)).alias("boost")).where("boost > 0")
    held = lambda text: F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(i)) for i, k in enumerate(keywords)]), lambda x: x.isNotNull())
    ask = cut(asked.select("question_id", held(F.col("question")).alias("asks")))
    have = cut(passages.select(F.col("hash_id").alias("passage_id"), held(F.col("text")).alias("has")).where(F.size("has") > 0))
    n = F.size(F.array_intersect("asks", "has"))
    meet = ask.select("asks").distinct().crossJoin(have.select("has").distinct()).where(F.arrays_overlap("asks", "has"))
    meet = cut(meet.select("asks", "has", (F.lit(boost) * F.log1p(n)).alias("boost")))
    part = F.pmod(F.xxhash64("passage_id"), F.lit(spread)).cast("int")
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    pairs = have.join(meet, "has").select("passage_id", "asks", "boost", part.alias("part")).join(ask, ["asks", "part"])
    return pairs.select("question_id", "passage_id", "boost").where("boost > 0")
