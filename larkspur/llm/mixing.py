"""Mixing sources to target weights, by temperature and budgeted block permutations.

The weights lie between the natural token shares and the target shares:
``weight(x)`` is proportional to ``natural**(1-x) * target**x``. Without a budget the mix
is as large as the target shares and repetition limits allow (``x = 1``). With
a budget the exponent is bisected to the largest one at which no source has to
be repeated more often than allowed; with an entropy it is bisected to that
entropy. Each source is then used in whole passes and one part of a pass:
documents fall into blocks by hash, blocks come in a permuted order, and the
part ends inside one block, so no source is sorted as a whole.

Defined results: NULL, empty and blank texts have no tokens and are not used;
sources without a target are not used; a target without documents reaches 0;
an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern that belongs to the public vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each whole text under a public byte-pair vocabulary."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        shipped = SparkFiles.get(os.path.basename(path))  # sent along by `mix`
        with open(shipped if os.path.exists(shipped) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield part.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def clean_source(col: Column) -> Column:
    """Source names without outer space, in lower case, with underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[-\s]+", "_")


def _weights(natural: dict[str, float], target: dict[str, float], x: float) -> dict[str, float]:
    raw = {s: math.exp((1 - x) * math.log(natural[s]) + x * math.log(target[s])) for s in natural}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def solve_weights(
    tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], budget: int | None = None, entropy: float | None = None
) -> tuple[dict[str, float], int, float]:
    """Weights, size of the mix in tokens, and the exponent."""
    use = [s for s in target if tokens.get(s) and target[s] > 0 and repeats[s] > 0]
    if not use:
        return {}, 0, 1.0
    natural = {s: tokens[s] / sum(tokens[u] for u in use) for s in use}
    goal = {s: target[s] / sum(target[u] for u in use) for s in use}
    room = {s: tokens[s] * repeats[s] for s in use}

    def largest(x: float) -> float:
        return min(room[s] / w for s, w in _weights(natural, goal, x).items())

    def spread(x: float) -> float:
        return -sum(w * math.log(w) for w in _weights(natural, goal, x).values())

    lo, hi, x = 0.0, 1.0, 1.0
    if entropy is not None:
        rising = spread(1.0) >= spread(0.0)
        for _ in range(60):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if (spread(x) < entropy) == rising else (lo, x)
    elif budget is not None and largest(1.0) < budget:
        for _ in range(60):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if largest(x) >= budget else (lo, x)
        x = lo
    size = int(min(largest(x), budget if budget is not None else math.inf))
    return _weights(natural, goal, x), size, x


def mix(
    docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame,
    *, budget: int | None = None, budget_share: float | None = None, entropy: float | None = None, tokenizer: str = TOKENIZER, block_docs: int = 1000, seed: int = 11,
    most_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, tokens, copies`` of every used document, and the report of shares (one row a target).

    `budget` is in tokens, `budget_share` in parts of all tokens of the sources. More than `most_sources` targets are an error.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    goal = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    rows = goal.limit(most_sources + 1).collect()  # one row a source
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    names = [r["source"] for r in rows]
    sized = docs.select(F.col(doc_id).alias("doc_id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    sized = sized.where(F.col("source").isin(names) & F.col("text").rlike(r"(?U)\S"))
    sized = cut(sized.select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens")))
    sums = {r["source"]: (r["tokens"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    if budget_share is not None:
        budget = int(budget_share * sum(t for t, _ in sums.values()))
    share, size, exponent = solve_weights(
        {s: t for s, (t, _) in sums.items()}, {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}, budget, entropy
    )
    plan = []
    for s, w in share.items():
        have, n = sums[s]
        full = int(size * w) // have
        plan.append((s, full, int(size * w) - full * have, max(1, n // block_docs)))
    wanted = F.broadcast(spark.createDataFrame(plan, "source string, full bigint, rest bigint, blocks bigint"))  # one row a source
    key = F.xxhash64(F.lit(seed), "doc_id")
    placed = sized.join(wanted, "source").withColumn("key", key).withColumn("block", F.pmod("key", "blocks"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    blocks = blocks.withColumn("before", F.sum("size").over(order) - F.col("size"))  # one row in `block_docs` documents
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("tokens").over(inside)
    used = placed.join(blocks, ["source", "block"]).withColumn("copies", F.col("full") + (upto <= F.col("rest")).cast("bigint"))
    used = used.where("copies > 0").select("doc_id", "source", "tokens", "copies")
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    total = Window.partitionBy()  # one row a source
    report = (
        goal.join(reached, "source", "left")
        .na.fill(0, ["used_tokens", "most_copies"])
        .withColumn("reached_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(total), F.lit(0)))
    )
    report = report.withColumns({"exponent": F.lit(round(exponent, 6)), "planned_share": F.coalesce(*[F.when(F.col("source") == s, F.lit(round(w, 6))) for s, w in share.items()], F.lit(0.0))})
    return used, report.select("source", "target_share", "max_repeats", "used_tokens", "most_copies", "reached_share", "planned_share", "exponent")
