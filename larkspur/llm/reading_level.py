"""Reading level of English prose: the median of classic readability grades, placed on a graded scale.

Three classic formulas grade a text by its sentence length and one measure of
its words: Flesch-Kincaid (syllables), Gunning Fog (words of three syllables and
more) and the Automated Readability Index (letters). As these formulas once were
themselves, their weights are fitted again on a graded table, here by ordered
logistic regression on a bounded number of graded rows; the median of the three
estimates is the level.

Sentence length follows Gunning's rule that independent clauses count as
sentences of their own; the usual length is the median one. A name is one word (with a first word right before it),
however long, and tells nothing about difficulty, so it is in no word measure.
Syllables come from hyphenation-style rules: vowel groups, silent endings, and
vowel pairs that part.

Whether a text is English is told by its letter trigrams, from profiles that
are fitted on a bounded number of labelled rows of each language.

Defined results: NULL, blank, record-list and mainly non-English texts have no
row; texts without a full sentence count as one sentence; repeated ids give
one row; without any graded row there is no result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = "sentence double, syllables double, letters double, long double"
#: The word measure that goes with sentence length in each formula.
FORMULAS = {"fk": "syllables", "fog": "long", "ari": "letters"}

_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&[a-z]{1,8};|­")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INITIAL = re.compile(r"\b([A-Z]|[DM]r|Mrs|[SM]t|Jr|Prof)\.(?=[\s,])")
_END = re.compile(r"[!?]+[\"”’»)\]]*(?=\s|$)|\.+[\"”’»)\]]*(?=\s+[\"“‘«(\[]*[^\W_a-z]|\s*$)|[;:]\s+|\n\s*\n")
_SILENT = re.compile(r"(?<=[^aeiouyl])e$|(?<=[aeiouy]l)e$|(?<=[^aeiouytd])e(?=d$)|(?<=[^aeiouyscxzhg])e(?=s$)")
_APART = re.compile(r"i(?=[ao](?!n))|[aeiou](?=ing)|e(?=o)|u(?=[ao])")
_ASCII_LETTER = re.compile("[A-Za-z]")
_FIVE_WORDS = re.compile(r"(?:[^\W\d_]+[\W\d_]+){4}[^\W\d_]")
_JOINING = frozenset(("of", "and", "the", "for", "de"))


@lru_cache(1 << 16)
def syllables(word: str) -> int:
    """Vowel groups that sound, and pairs of vowels that part."""
    w = word.lower()
    groups = len(re.findall(r"[aeiouy]+", w))
    spoken = len(re.findall(r"[aeiouy]+", _SILENT.sub("", w))) if groups > 1 else groups
    return max(1, spoken + len(_APART.findall(w)))


def clauses(words: list[str], least: int = 5) -> tuple[list[int], list[str]]:
    """Lengths of the independent clauses of one sentence and its common words.

    A clause ends before `and` or `but` if it and what follows have `least` words; what `both` opens is no clause.
    """
    part, parts, common, both, name = 0, [], [], False, False
    for i, w in enumerate(words):
        upper = w[0].isupper() and (i > 0 or (len(words) > 1 and words[1][0].isupper()))
        if upper:
            part += not name
            name = True
        elif name and w in _JOINING and i + 1 < len(words) and words[i + 1][0].isupper():
            continue  # inside a name
        else:
            name = False
            if w in ("and", "but") and part and not both:
                parts.append(part)
                part = 0
            else:
                part += 1
                both |= w == "both"
            common.append(w)
    parts.append(part)
    done = [parts[0]]
    for p in parts[1:]:
        if p < least or done[-1] < least:
            done[-1] += p + 1
        else:
            done.append(p)
    return [n for n in done if n], common


def measure(text: str) -> tuple[float, float, float, float]:
    """The usual clause length, and syllables, letters and the share of long words a word."""
    plain = _INITIAL.sub(r"\1", _MARKUP.sub(" ", text))
    lengths, count, syl, letters, long = [], 0, 0, 0, 0
    for sentence in _END.split(plain):
        n, common = clauses(words) if (words := _WORD.findall(sentence)) else ([], [])
        lengths += n
        count += len(common)
        letters += sum(map(len, common))
        for w in common:
            s = syllables(w)
            syl += s
            long += s >= 3
    count = max(count, 1)
    return float(median(lengths)) if lengths else 1.0, max(syl, 1) / count, max(letters, 1) / count, long / count


def is_prose(text: str) -> bool:
    """Running text in Latin script, not blank and no list of records: sentence ends are not outnumbered by separators and short lines."""
    stops, bars = sum(map(text.count, ".!?")), text.count("|")
    if not stops or bars > stops or not _FIVE_WORDS.search(text):
        return False
    if not text.isascii() and 2 * len(_ASCII_LETTER.findall(text)) < sum(map(str.isalpha, text)):
        return False
    lines = sum(len(x) <= 80 for x in text.split("\n")[1:-1])
    return bars + text.count("\t") + text.count(";") + lines <= 4 * stops + 4


def _trigrams(text: str, buckets: int) -> np.ndarray:
    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return (c[:-2] * 1_000_003 + c[1:-1] * 8191 + c[2:]) % buckets


def fit_languages(docs: DataFrame, text: str, lang: str, most: int = 300, languages: int = 32, buckets: int = 1 << 14) -> tuple[list[str], np.ndarray]:
    """Codes and log trigram rates of the most frequent languages, from at most `most` labelled texts of each.

    The label's first two letters count. Of a language, texts are taken in the order of their hash. As some labels are
    wrong, profiles are fitted again without the texts that another language's profile fits better.
    """
    code = F.regexp_extract(F.lower(F.trim(F.col(lang))), r"^([a-z]{2})(?![a-z])", 1)
    rows = docs.select(F.col(text).alias("text"), code.alias("lang")).where((F.length("text") >= 40) & (F.col("lang") != ""))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    few = rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)
    top = few.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    seen = few.join(F.broadcast(top), "lang", "left_semi").select("lang", "text").collect()  # at most `languages * most` rows
    codes = sorted({r["lang"] for r in seen})
    grams, label = [_trigrams(r["text"], buckets) for r in seen], np.array([codes.index(r["lang"]) for r in seen], dtype=int)

    def fit(keep: np.ndarray) -> np.ndarray:
        count = np.full((len(codes), buckets), 0.5)
        for g, c, k in zip(grams, label, keep, strict=True):
            if k:
                np.add.at(count[c], g, 1)
        return np.log(count / count.sum(axis=1, keepdims=True)).astype(np.float32)

    rates = fit(np.ones(len(seen), bool))
    if len(codes) > 1:
        rates = fit(np.array([rates[:, g].sum(axis=1).argmax() == c for g, c in zip(grams, label, strict=True)]))
    return codes, rates


def english_measures(docs: DataFrame, key: str, text: str, languages: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``key`` and the measures of every prose text; with `languages`, of the English ones."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    codes, rates = languages or (["en"], np.zeros((1, 1), np.float32))
    english = codes.index("en") if "en" in codes else -1

    def spoken(t: str) -> int:
        return rates[:, _trigrams(_MARKUP.sub(" ", t), rates.shape[1])].sum(axis=1).argmax()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [is_prose(t) and (len(codes) == 1 or spoken(t) == english) for t in b["text"]]
            some = b[pd.Series(ok, index=b.index, dtype=bool)]
            got = pd.DataFrame([measure(t) for t in some["text"]], columns=[c.split()[0] for c in MEASURES.split(", ")], dtype=float)
            yield got.assign(key=some["key"].to_numpy())[["key", *got.columns]]

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, {MEASURES}")


def grades(measures: DataFrame) -> DataFrame:
    """``key, fk, fog, ari, grade``: the formulas with their published weights, and their median."""
    s, y, c, h = F.greatest("sentence", F.lit(1.0)), F.col("syllables"), F.col("letters"), F.col("long")
    est = {"fk": 0.39 * s + 11.8 * y - 15.59, "fog": 0.4 * (s + 100 * h), "ari": 4.71 * c + 0.5 * s - 21.43}
    out = measures.select("key", *[v.alias(k) for k, v in est.items()])
    return out.withColumn("grade", F.sort_array(F.array(*est))[len(est) // 2])


@dataclass(frozen=True)
class Scale:
    """One formula on the graded scale: weights of sentence length and word measure, and the limits between the levels."""

    measure: str
    sentence: float
    word: float
    limits: tuple[float, ...]
    lowest: int

    def level(self) -> Column:
        """A level with a fraction: limit n lies half-way between two levels, values between limits in proportion."""
        u = self.sentence * F.col("sentence") + self.word * F.col(self.measure)
        if not self.limits:
            return F.lit(float(self.lowest)) + 0 * u
        gaps = [b - a for a, b in zip(self.limits, self.limits[1:], strict=False)] or [1.0]
        out = self.lowest + 0.5 + (u - self.limits[0]) / gaps[0]
        for n, limit in enumerate(self.limits):
            out = F.when(u > limit, self.lowest + n + 0.5 + (u - limit) / gaps[min(n, len(gaps) - 1)]).otherwise(out)
        return out


def _ordered_logit(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights, common to all limits, and limits of ``P(y > k) = logistic(x w - limit_k)``, by Newton's method."""
    mean, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, cuts = (x - mean) / width, np.arange(y.min(), y.max())
    a = np.concatenate([np.hstack([z, np.tile(-np.eye(len(cuts))[j], (len(y), 1))]) for j in range(len(cuts))])
    t = np.concatenate([y > k for k in cuts]).astype(float)
    penalty = np.array([ridge] * x.shape[1] + [1e-3] * len(cuts))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - t) / len(y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(penalty), slope)
        w -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    weights = w[: x.shape[1]] / width
    return weights, np.maximum.accumulate(w[x.shape[1] :] + mean @ weights + 1e-9 * np.arange(len(cuts)))


def fit_scales(graded: DataFrame, text: str, level: str, most: int = 10_000, ridge: float = 0.1) -> dict[str, Scale]:
    """The formulas' weights on the scale of at most `most` graded texts; empty without any."""
    known = graded.where(F.col(text).isNotNull() & F.col(level).isNotNull()).limit(most)
    rows = english_measures(known, level, text).toPandas()
    if rows.empty:
        return {}
    y, out = rows["key"].to_numpy(dtype=int), {}
    for name, word in FORMULAS.items():
        if y.min() == y.max():
            out[name] = Scale(word, 0.0, 0.0, (), int(y.min()))
            continue
        w, limits = _ordered_logit(rows[["sentence", word]].to_numpy(dtype=float), y, ridge)
        out[name] = Scale(word, float(w[0]), float(w[1]), tuple(map(float, limits)), int(y.min()))
    return out


def reading_levels(docs: DataFrame, key: str, text: str, scales: dict[str, Scale], languages: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``key, estimate, reading_level`` of every English prose text: the median of the formulas' estimates, and the level it falls in."""
    found = english_measures(docs, key, text, languages)
    if not scales:
        return found.limit(0).select("key", F.lit(0.0).alias("estimate"), F.lit(0).alias("reading_level"))
    low = min(s.lowest for s in scales.values())
    high = max(s.lowest + len(s.limits) for s in scales.values())
    estimate = F.sort_array(F.array(*[s.level() for s in scales.values()]))[len(scales) // 2]
    rows = found.select("key", estimate.alias("estimate")).groupBy("key").agg(F.max("estimate").alias("estimate"))
    return rows.withColumn("reading_level", F.least(F.greatest(F.floor(F.col("estimate") + 0.5), F.lit(low)), F.lit(high)).cast("int"))
