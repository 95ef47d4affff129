"""Evaluation texts leaking into training text, by greedy string tiling.

Both sides become words without case, punctuation, layout and markup. Runs of
`run` words shared with an item are the seeds; a document that shares too few
to reach the threshold is dropped before any tiling. For every remaining
(document, item) the longest unmarked common runs are marked one after another,
found by Karp-Rabin hashing, so reordered passages count as well; then the
words of common runs that overlap a tile are added, and the share decides.

Defined results: NULL, empty and very short texts are never a case; a repeated
document id is one row a pair; repeated items are reported each; further
columns are ignored. Seeds are few when there are few items: they are broadcast
only if counted to be at most `broadcast_seeds`, else shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import WORD

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words(text: Column) -> Column:
    """Lower-cased words; markup becomes space, and hyphens vanish, as those of hyphenation do.

    In scripts without spaces every letter is a word, so that a run of words is a run of letters there.
    """
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{1,10}|#\d{1,7});", " ")
    joined = F.regexp_replace(plain, r"[­​⁠﻿]|(?<=\p{L})[-\u2010\u2011]\s*(?=\p{L})|(?<=\p{L})['’](?=\p{L})", "")
    return F.regexp_extract_all(F.lower(joined), F.lit(WORD), F.lit(0))


def hashed(ws: Column) -> Column:
    """Each word as a number, so that a word is read once and not once for every run it is in."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def seeds(hs: Column, run: int) -> Column:
    """A hash of every `run` hashed words that follow each other."""
    last = F.size(hs) - run + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(hs, i, run)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _windows(ids: Sequence[int], marked: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """Start and rolling hash of every window of unmarked words."""
    top = pow(_BASE, length - 1, _MOD)
    h = n = 0
    for at, w in enumerate(ids):
        if marked[at]:
            h = n = 0
            continue
        if n == length:
            h = (h - ids[at - length] * top) % _MOD
            n -= 1
        h = (h * _BASE + w) % _MOD
        n += 1
        if n == length:
            yield at - length + 1, h


def tile(item: Sequence[str], doc: Sequence[str], run: int) -> int:
    """Words of `item` that stand in `doc` in common runs of at least `run` words: the greedy tiling, and the runs that overlap its tiles."""
    code = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a, b = [code[w] for w in item], [code.get(w, 0) for w in doc]
    used_a, used_b = bytearray(len(a)), bytearray(not w for w in b)  # words that are not the item's match nothing
    length = max(run, len(a))
    while length >= run:
        at_hash: dict[int, list[int]] = {}
        for i, h in _windows(a, used_a, length):
            at_hash.setdefault(h, []).append(i)
        longest, tiles = 0, []
        if at_hash:
            for j, h in _windows(b, used_b, length):
                for i in at_hash.get(h, ()):
                    if a[i : i + length] != b[j : j + length]:
                        continue
                    n = length
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                        n += 1
                    if n > longest:
                        longest, tiles = n, []
                    if n == longest:
                        tiles.append((i, j))
        if not longest:
            if length == run:
                break
            length = max(run, length // 2)
            continue
        if longest > 2 * length:  # a much longer match: look for its equals first
            length = longest
            continue
        for i, j in tiles:
            if not any(used_a[i : i + longest]) and not any(used_b[j : j + longest]):
                used_a[i : i + longest] = used_b[j : j + longest] = b"\x01" * longest
    # runs of which a part is marked already leave too few words for a tile, but their words count
    held = {tuple(b[j : j + run]) for j in range(len(b) - run + 1)}
    for i in range(len(a) - run + 1):
        if tuple(a[i : i + run]) in held:
            used_a[i : i + run] = b"\x01" * run
    return sum(used_a)


def leaked_items(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str,
    *, run: int = 6, share: float = 0.4, broadcast_seeds: int = 2_000_000,
) -> DataFrame:
    """``item_id, doc_id, covered, item_words`` for every document that holds at least `share` of an item in runs of `run` words."""
    item = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("iw")).where(F.size("iw") >= run)
    seed = item.select("item_id", F.size("iw").alias("n"), hashed(F.col("iw")).alias("hs"))
    seed = seed.select("item_id", "n", F.posexplode(seeds(F.col("hs"), run)).alias("at", "h"))
    if seed.count() <= broadcast_seeds:
        seed = F.broadcast(seed)
    doc = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    split = doc.select("doc_id", hashed(words(F.col("text"))).alias("hs"))  # once a text: used in every position below
    found = split.select("doc_id", F.explode(F.array_distinct(seeds(F.col("hs"), run))).alias("h")).join(seed, "h")
    # an upper bound of the coverage: a seed may cover all of its words
    hits = found.groupBy("doc_id", "item_id").agg(F.first("n").alias("n"), F.collect_set("at").alias("ats"))
    bound = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda i: F.sequence(i, i + run - 1)))))
    likely = hits.where(bound >= F.round(F.lit(share) * F.col("n"), 6)).select("doc_id", "item_id")
    pairs = likely.join(doc, "doc_id").select("doc_id", "item_id", words(F.col("text")).alias("dw")).join(item, "item_id")  # only texts that may hold an item are split again

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n = [tile(i.tolist(), d.tolist(), run) for i, d in zip(p["iw"], p["dw"], strict=True)]
            yield pd.DataFrame({"item_id": p["item_id"], "doc_id": p["doc_id"], "covered": n, "item_words": p["iw"].map(len)})

    types = dict(pairs.dtypes)
    out = pairs.mapInPandas(cover, f"item_id {types['item_id']}, doc_id {types['doc_id']}, covered int, item_words int")
    return out.where(F.col("covered") >= F.round(F.lit(share) * F.col("item_words"), 6)).groupBy("item_id", "doc_id").agg(
        F.max("covered").alias("covered"), F.max("item_words").alias("item_words")
    )
