"""Vector functions, and the built-in encoder of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thai, Lao, Burmese, Khmer, Kana and Han letters, which no spaces part; each is a word of its own.
UNSPACED = r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]"
#: A word: one such letter, or a run of other letters, marks and digits.
WORD = UNSPACED + r"|[\p{L}\p{M}\p{N}&&[^" + UNSPACED[1:-1] + "]]+"
#: Number of buckets of words whose frequency is kept: the bound of what an encoder carries.
BUCKETS = 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for a zero vector, so that dividing by it is safe."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Of values clamped at 0, scaled by the group's range; 1 where all are equal."""
    return F.when(high == low, 1.0).otherwise((F.greatest(value, F.lit(0.0)) - low) / (high - low))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits of any script."""
    return F.regexp_extract_all(F.translate(F.lower(text), "ς", "σ"), F.lit(WORD), F.lit(0))


@lru_cache(1 << 16)
def _place(word: str, dim: int) -> tuple[int, int, float]:
    """Bucket, dimension and sign of a word, from its MD5."""
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:4], 16), int(h[4:10], 16) % dim, 1.0 if h[10] < "8" else -1.0


def fit_encoder(texts: DataFrame, text: str, dim: int = 256) -> Callable[[Column], Column]:
    """An encoder of texts as unit vectors: every word adds its rarity among `texts` to one of `dim` places.

    A text without words has a zero vector, NULL has none. Words are counted in `BUCKETS` buckets over all texts, so the table has the same size whatever the vocabulary.
    """
    bucket = F.array_distinct(F.transform(words(F.col(text)), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int")))
    bucket = F.array_append(bucket, F.lit(BUCKETS))  # one more place counts the texts in the same pass
    seen = np.ones(BUCKETS + 1)
    seen[BUCKETS] = 0
    for r in texts.where(F.col(text).isNotNull()).select(F.explode(bucket).alias("b")).groupBy("b").count().collect():  # at most BUCKETS + 1 rows
        seen[r["b"]] = r["count"]
    weight = np.log(1 + seen[BUCKETS] / seen[:BUCKETS])

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for ws in part:
                if ws is None:
                    out.append(None)
                    continue
                v = np.zeros(dim)
                for w in ws:
                    b, d, sign = _place(w, dim)
                    v[d] += sign * weight[b]
                n = np.sqrt((v * v).sum())
                out.append(v / n if n else v)
            yield pd.Series(out, index=part.index)

    return lambda c: encode(words(c))
