"""Scalar functions of text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"
NO_ANSWER_LABELS = ("ORDINAL", "CARDINAL")


def content_id(namespace: str, text: Column) -> Column:
    """Content key: the namespace and the MD5 of the text."""
    return F.concat(F.lit(namespace + "-"), F.md5(text.cast("binary")))


def indexed_chunk(index: Column, chunk: Column) -> Column:
    return F.concat(index.cast("string"), F.lit(":"), chunk)


def leading_index(text: Column) -> Column:
    """The number before the first colon, NULL if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.trim(text), r"^(\d+):", 1), F.lit("")), F.lit("999999999999999999")).cast("bigint")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; NULL becomes empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    words = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")
    return F.regexp_replace(F.regexp_replace(words, r"(?U)\s+", " "), "^ | $", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def contains_gold(prediction: Column, gold: Column) -> Column:
    """1 if the normalised gold answer is in the normalised prediction; 0 if either is blank."""
    inside = F.contains(normalize_answer(prediction), normalize_answer(gold))
    return F.when(is_blank(prediction) | is_blank(gold), 0).otherwise(inside.cast("int"))


def extract_answer(text: Column) -> Column:
    """What stands between the first and a second `Answer:`; the text itself without one."""
    parts = F.split(text, "Answer:")
    return F.when(F.size(parts) > 1, F.regexp_replace(parts[1], r"(?U)^\s+|\s+$", "")).otherwise(text)


def count_inside(text: Column, part: Column) -> Column:
    """Occurrences of `part` that do not overlap."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("bigint")


def judge_verdict(raw: Column) -> tuple[Column, Column]:
    """Accuracy and stored verdict of a judge's raw answer."""
    word = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    score = F.when(raw.isNull(), None).when(word == "correct", 1.0).otherwise(0.0)
    kept = F.when(word.isin("correct", "incorrect"), word).otherwise(F.concat(F.lit("error_answer:"), word))
    return score, kept


def percent(text: Column) -> Column:
    """`12.5%` as a number; 0 where it is none."""
    return F.coalesce(F.regexp_replace(text, "%", "").try_cast("double"), F.lit(0.0))


def alpha_grid(text: str | None = None) -> list[float]:
    """Comma-separated weights, rounded to two places; without any, 0.00 to 1.00 by 0.05."""
    if text:
        return [round(float(x), 2) for x in text.split(",") if x.strip()]
    return [round(i * 0.05, 2) for i in range(21)]


def entity_label(text: Column) -> Column:
    """Label of the built-in tagger: bare numbers and ordinals are told from names."""
    return F.when(text.rlike(r"^\d+$"), "CARDINAL").when(text.rlike(r"^\d+(st|nd|rd|th)$"), "ORDINAL").otherwise("TERM")


def is_attribute_question(question: Column, keywords: Sequence[str]) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit(r"\w+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*[F.lit(k) for k in keywords]))


def keyword_overlap(question: Column, passage: Column, keywords: Sequence[str]) -> Column:
    """Keywords that are part of both texts."""
    q, p = F.lower(question), F.lower(passage)
    total = F.lit(0)
    for k in keywords:
        total = total + (F.contains(q, F.lit(k)) & F.contains(p, F.lit(k))).cast("int")
    return total


def chat_messages(system: str, passages: Column, question: Column) -> Column:
    """A chat of two messages: instructions, then the passages and the question."""
    user = F.concat(F.array_join(passages, "\n"), F.lit("\nQuestion: "), question, F.lit("\nThought: "))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))
    )


def has_flag(text: Column, flags: Sequence[str]) -> Column:
    """Whether any of the failure flags is in the text."""
    hit = F.lit(False)
    for f in flags:
        hit = hit | F.coalesce(F.contains(text, F.lit(f)), F.lit(False))
    return hit
