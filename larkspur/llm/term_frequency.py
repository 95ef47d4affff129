"""Frequency of every term and n-gram, from a suffix array with common-prefix intervals.

Every position of a record's term sequences is a suffix that runs to the
sequence's end (in a sequence longer than `reach`, over `reach` terms, so that
a very long text stays linear; longer n-grams are not told apart). Spark sorts all suffixes by range, ties by record, so an n-gram
is one interval of neighbours that share their first n terms. One pass over the
sorted suffixes finds the maximal intervals: all n-grams between the prefix an
interval shares with what surrounds it and the prefix its own suffixes share
have the same occurrences, so one row stands for all of them, and n is not
bounded. An interval's length is the number of occurrences; less the suffixes
that share at least as many terms with the one before them in their own record,
it is the number of records.

The pass takes batches. Intervals that reach a batch's border are split into
their n-grams, added up by Spark and put together again, so a term in a third
of all records is counted in many tasks.

Defined results: NULL or empty sequences and NULL terms give no suffix; repeated
rows are repeated occurrences of the same record; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

INTERVAL = "field string, gram array<string>, shortest int, occurrences bigint, records bigint"


def common(a: list[str], b: list[str]) -> int:
    """Leading terms that two suffixes share."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def suffixes(df: DataFrame, field: str, record: str, terms: str, reach: int = 256) -> DataFrame:
    """``field, suffix, record, again``; `again`: leading terms shared with the suffix before it of the same record."""
    clean = df.select(F.col(field).alias("field"), F.col(record).alias("record"), F.filter(terms, lambda x: x.isNotNull()).alias("terms"))
    one = clean.where(F.size("terms") > 0).groupBy("field", "record").agg(F.collect_list("terms").alias("lists"))  # one record's own sequences

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, suffix, again = [], [], []
            for i, lists in enumerate(b.column(2).to_pylist()):
                last: list[str] = []
                for s in sorted(x[p : p + reach] for x in lists for p in range(len(x))):
                    at.append(i)
                    suffix.append(s)
                    again.append(common(last, s))
                    last = s
                    if len(at) >= 20_000:
                        yield pack(b, at, suffix, again)
                        at, suffix, again = [], [], []
            yield pack(b, at, suffix, again)

    def pack(b: pa.RecordBatch, at: list[int], suffix: list[list[str]], again: list[int]) -> pa.RecordBatch:
        rows = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(rows), pa.array(suffix, pa.list_(pa.string())), b.column(1).take(rows), pa.array(again, pa.int32())], names=["field", "suffix", "record", "again"]
        )

    return one.mapInArrow(cut_up, "field string, suffix array<string>, record string, again int")


def intervals(keys: list[tuple[str, list[str]]], again: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Of one batch of sorted suffixes: closed intervals ``field, gram, shortest, occurrences, records``, and the n-grams of open ones.

    `keys` are field and suffix. An interval is open if it holds the first or the last suffix.
    """
    n, closed, border = len(keys), [], []
    shared = [-1] + [common(a[1], b[1]) if a[0] == b[0] else -1 for a, b in zip(keys, keys[1:], strict=False)] + [-1]
    stack: list[tuple[int, int]] = []  # start and depth of the intervals that are open to the right

    def close(start: int, end: int, depth: int, above: int) -> None:
        if depth > max(above, 0) and start > 0 and end < n:
            twice = sum(a >= depth for a in again[start:end])
            closed.append((keys[start][0], keys[start][1][:depth], max(above, 0) + 1, end - start, end - start - twice))

    for i in range(n):
        start = i
        while stack and stack[-1][1] > shared[i]:
            start, depth = stack.pop()
            close(start, i, depth, max(shared[i], stack[-1][1] if stack else -1))
        if not stack or stack[-1][1] < shared[i]:
            if shared[i] > 0:
                stack.append((start if start < i else i - 1, shared[i]))
        if len(keys[i][1]) > max(shared[i], shared[i + 1], 0):
            stack.append((i, len(keys[i][1])))
    while stack:
        start, depth = stack.pop()
        close(start, n, depth, stack[-1][1] if stack else -1)
    for end, step in ((0, 1), (n - 1, -1)):
        field, suffix = keys[end]
        reach, at, twice = len(suffix), end, [0] * (len(suffix) + 2)
        runs = [0] * (len(suffix) + 2)
        while 0 <= at < n and reach > 0:
            runs[reach] += 1
            twice[min(again[at], reach)] += 1
            nxt = shared[at + 1] if step > 0 else shared[at]
            reach, at = min(reach, nxt), at + step
        count = dup = 0
        for depth in range(len(suffix), 0, -1):
            count, dup = count + runs[depth], dup + twice[depth]
            # what holds both ends was given with the first one
            if end == 0 or n - count > 0:
                border.append((field, suffix[:depth], count, count - dup))
        if n == 1:
            break
    return closed, border


def term_intervals(df: DataFrame, field: str, record: str, terms: str, partitions: int | None = None) -> DataFrame:
    """``field, gram, shortest, occurrences, records``: maximal intervals; the row stands for every prefix of `gram` of at least `shortest` terms."""
    order = ["field", "suffix", "record"]
    rows = suffixes(df, field, record, terms)
    rows = rows.repartitionByRange(*((partitions, *order) if partitions else order)).sortWithinPartitions(*order, "again")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            closed, border = intervals(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), b.column(3).to_pylist())
            rows = closed + [(f, g, 0, n, r) for f, g, n, r in border]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["field", "gram", "shortest", "occurrences", "records"])

    found = cut(rows.mapInArrow(scan, INTERVAL))
    # n-grams at borders: a few for every batch
    grams = found.where("shortest = 0").groupBy("field", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    grams = cut(grams)
    longer = grams.where(F.size("gram") > 1).select("field", F.slice("gram", F.lit(1), F.size("gram") - 1).alias("gram"), "occurrences")
    top = cut(grams.join(longer, ["field", "gram", "occurrences"], "left_anti"))
    prefix = top.select("field", F.col("gram").alias("whole"), F.explode(F.transform(F.sequence(F.lit(0), F.size("gram") - 1), lambda i: F.slice("gram", F.lit(1), i))).alias("gram"))
    above = prefix.where(F.size("gram") > 0).join(top.select("field", "gram"), ["field", "gram"]).groupBy("field", F.col("whole").alias("gram")).agg(F.max(F.size("gram")).alias("above"))
    opened = top.join(above, ["field", "gram"], "left").select("field", "gram", (F.coalesce("above", F.lit(0)) + 1).cast("int").alias("shortest"), "occurrences", "records")
    return found.where("shortest > 0").unionByName(opened)


def term_frequency(df: DataFrame, field: str, record: str, terms: str, longest: int = 1, partitions: int | None = None) -> DataFrame:
    """``field, n, gram, occurrences, records`` of every n-gram of up to `longest` terms, from the intervals of all lengths."""
    rows = term_intervals(df, field, record, terms, partitions).where(F.col("shortest") <= longest)
    each = F.explode(F.sequence("shortest", F.least(F.size("gram"), F.lit(longest)))).alias("n")
    return rows.select("field", "gram", "occurrences", "records", each).select("field", "n", F.slice("gram", F.lit(1), F.col("n")).alias("gram"), "occurrences", "records")


def banded(counts: DataFrame, totals: DataFrame, common: dict[str, float]) -> DataFrame:
    """Adds `band`: `rare` in one record, `common` in at least a field's share of its records, else NULL.

    `totals` has one row a field: ``field, total``.
    """
    share = F.create_map(*[F.lit(x) for kv in common.items() for x in kv])
    band = F.when(F.col("records") == 1, "rare").when(F.round(F.col("total") * share[F.col("field")], 6) <= F.col("records"), "common")
    return counts.join(F.broadcast(totals), "field").withColumn("band", band)
