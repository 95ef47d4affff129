"""The nearest vectors of a set of queries among all rows, exactly, in blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_path

FOUND = "query string, item string, sim double"
#: A kept row is one number: a million less its similarity in millionths, then its place among the ids; the smaller, the better.
PLACE = 40
NONE = np.iinfo(np.int64).max


def unit(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; a zero vector stays one, and one that is not finite becomes one."""
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(np.isfinite(n), x, 0.0) / np.where((n == 0) | ~np.isfinite(n), 1.0, n)


def _kind(df: DataFrame) -> type:
    return np.float32 if dict(df.dtypes)["v"] == "array<float>" else np.float64


def _stored(df: DataFrame, encode: Callable[[Column], Column] | None, more: str = "") -> str:
    """A new table ``id, v`` in the shared folder: each id once, in their order over all files, vectors as bytes; `more` is a further column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            ids, v = b.column(0), b.column(1)
            if not b.num_rows:
                continue
            new = np.concatenate([[ids[0].as_py() != last], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
            last = ids[-1].as_py()
            at = v.offsets.to_numpy().astype(np.int64)
            at = ((at - at[0]) * (v.type.value_type.bit_width // 8)).astype(np.int64)
            raw = pa.py_buffer(v.flatten().to_numpy(zero_copy_only=False).astype(v.type.value_type.to_pandas_dtype(), copy=False).tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), raw]).cast(pa.binary())
            keep = pa.array(new)
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (ids, packed, *b.columns[2:])], names=b.schema.names)

    also = [more] if more else []
    some = df.select("id", "v", *also).where("id IS NOT NULL AND v IS NOT NULL")
    if encode is None:
        some = some.where("size(v) > 0").withColumn("v", F.col("v").cast("array<float>" if _kind(df) is np.float32 else "array<double>"))
    rows = some.repartitionByRange("id").sortWithinPartitions("id")  # before encoding: texts are smaller than their vectors
    if encode is not None:
        rows = rows.select("id", encode(F.col("v")).cast("array<double>").alias("v"), *also)
    path = work_path(df.sparkSession, "vectors")
    rows.mapInArrow(pack, ", ".join(["id string, v binary", *[f"{c} {dict(df.dtypes)[c]}" for c in also]])).write.option("compression", "zstd").parquet(path)
    return path


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    local = re.sub(r"^file:/+", "/", path)
    fs, root = (pyarrow.fs.LocalFileSystem(), local) if local.startswith("/") else pyarrow.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return fs, sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.startswith("part-"))


def _blocks(path: str, width: int, kind: type, rows: int, columns: list[str]) -> Iterator[tuple[int, pa.Array | None, np.ndarray]]:
    """The stored rows of `width` bytes, some at a time: the place of the first, ids if asked for, and vectors."""
    for start, b, x in _batches(path, width, kind, rows, columns):
        yield start, b["id"] if "id" in columns else None, x


def _batches(path: str, width: int, kind: type, rows: int, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    fs, files = _files(path)
    start = 0
    for f in files:
        with fs.open_input_file(f) as file:
            for b in pq.ParquetFile(file).iter_batches(rows, columns=columns):
                b = b.filter(pc.equal(pc.binary_length(b["v"]), width))
                if b.num_rows:
                    v = b["v"]
                    first, end = v.offset, v.offset + len(v)
                    at = np.frombuffer(v.buffers()[1], np.int32)[first : end + 1]
                    x = np.frombuffer(v.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(v), -1)
                    yield start, b, x
                start += b.num_rows


def _rows(path: str, first: int, end: int, width: int) -> Iterator[pa.RecordBatch]:
    """``id, v`` of the stored rows from `first` to before `end`, counted over all files; those of `width` bytes only."""
    fs, files = _files(path)
    start = 0
    for f in files:
        if start >= end:
            return
        with fs.open_input_file(f) as file:
            read = pq.ParquetFile(file)
            n = read.metadata.num_rows
            if start + n > first:
                at = start
                for b in read.iter_batches(4096, columns=["id", "v"]):
                    if at < end and at + b.num_rows > first:
                        b = b.slice(max(first - at, 0), min(end, at + b.num_rows) - max(first, at)) if at < first or at + b.num_rows > end else b
                        at = max(at, first) + b.num_rows
                        yield b.filter(pc.equal(pc.binary_length(b["v"]), width))
                    else:
                        at += b.num_rows
                    if at >= end:
                        break
            start += n


def _hits(s: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where `s` is at least its row's limit; eight at a time, as few are."""
    over = s >= limit[:, None]
    if over.shape[1] % 8 or not over.flags.c_contiguous:
        return np.nonzero(over)
    eight = np.flatnonzero(over.reshape(-1).view(np.uint64))
    flat, bit = np.nonzero(over.reshape(-1, 8)[eight])
    return np.divmod(eight[flat] * 8 + bit, over.shape[1])


def nearest(
    queries: DataFrame, base: DataFrame, k: int | None = None, least: float | None = None, *,
    others: bool = False, block_rows: int = 2048, query_rows: int = 8192, encode: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``query, item, sim``: for every query the `k` rows of the highest cosine, or all of at least `least`, or both.

    `queries` and `base` have ``id, v``, a vector or what `encode` makes one of; `others` leaves out rows of the query's own id.
    Rows without a vector, or with one of another length than the longest of `base`, take no part; repeated ids count once;
    ties go to the smaller id. The vectors are written once to the shared folder. A task reads up to `query_rows` queries
    and all rows from there, `block_rows` at a time; so no vector is shuffled or copied for a pair of blocks and nothing is
    left to merge. Products in single precision, with room for their error, tell what may count; that is computed in double precision.
    """
    spark = base.sparkSession
    at = _stored(base, encode)
    asked = at if queries is base else _stored(queries, encode)
    kind, q_kind = (_kind(x) for x in (base, queries))  # what is encoded is kept as doubles
    rows = spark.read.schema("id string, v binary").parquet(at)
    dim = (rows.agg(F.max(F.length("v"))).first()[0] or 0) // np.dtype(kind).itemsize
    if not dim:
        return spark.createDataFrame([], FOUND)
    count = spark.read.schema("id string, v binary").parquet(asked).count()
    room = max(1, min(query_rows, max(256, (1 << 20) // (k or 1))))
    parts = max(min(spark.sparkContext.defaultParallelism, count), -(-count // room), 1)
    width, q_width = (dim * np.dtype(x).itemsize for x in (kind, q_kind))
    error = (dim + 4) * 2.0**-23

    def pairs(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = batch["id"].combine_chunks()
        x = _unit(np.frombuffer(b"".join(batch["v"].to_pylist()), q_kind).reshape(-1, dim).astype(np.float64))
        x32, every = x.astype(np.float32), np.arange(len(x))
        best = np.full((len(x), k or 1), NONE)
        floor = np.full(len(x), -2.0 if least is None else least - 1e-6)  # of the exact similarity that may still count
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            r, key = (np.concatenate(z) for z in zip(*wait, strict=True))
            by = np.argsort(r, kind="stable")
            r, key = r[by], key[by]
            mine, first = np.unique(r, return_index=True)
            for i, a, z in zip(mine, first, [*first[1:], len(r)], strict=True):
                best[i] = np.partition(np.concatenate([best[i], key[a:z]]), k - 1)[:k]
            wait.clear()
            raise_floor(mine)

        def raise_floor(some: np.ndarray) -> None:
            worst = best[some].max(axis=1)
            full = worst != NONE
            floor[some[full]] = np.maximum(floor[some[full]], (1_000_000 - (worst[full] >> PLACE)) / 1e6)

        for start, names, y in _blocks(at, width, kind, block_rows, ["id", "v"] if k is None or others else ["v"]):
            y = _unit(y.astype(np.float64))
            y32 = np.ascontiguousarray(y.astype(np.float32).T)
            own = np.full(len(x), -1)
            if others:
                mine = pc.index_in(names, value_set=ids).to_numpy(zero_copy_only=False)
                has = np.flatnonzero(~np.isnan(mine.astype(np.float64)))
                own[mine[has].astype(np.int64)] = has
            for a in range(0, len(x), 256):
                part = every[a : a + 256]
                if k is not None and floor[part].min() <= -2.0:
                    r = c = None
                else:
                    r, c = _hits(x32[part] @ y32, (floor[part] - error).astype(np.float32))
                if r is None or len(r) > len(part) * len(y) // 16:  # many: all of them
                    s = np.round(x[part] @ y.T, 6)
                    out = own[part] >= 0
                    s[np.flatnonzero(out), own[part][out]] = -2.0
                    ok = s > -2.0 if least is None else s >= least
                    if k is not None:
                        key = np.where(ok, (1_000_000 - np.rint(s * 1e6).astype(np.int64) << PLACE) + start + np.arange(len(y)), NONE)
                        best[part] = np.partition(np.concatenate([best[part], key], axis=1), k - 1, axis=1)[:, :k]
                        raise_floor(part)
                        continue
                    r, c = np.nonzero(ok)
                    r, s = part[r], s[r, c]
                else:
                    r = part[r]
                    s = np.round(np.einsum("ij,ij->i", x[r], y[c]), 6)
                    ok = (c != own[r]) & (s >= (-1.0 if least is None else least))
                    r, c, s = r[ok], c[ok], s[ok]
                if k is None:
                    if len(r):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), names.take(pa.array(c)), pa.array(s)], names=["query", "item", "sim"])
                elif len(r):
                    wait.append((r, (1_000_000 - np.rint(s * 1e6).astype(np.int64) << PLACE) + start + c))
            if sum(len(r) for r, _ in wait) > len(x) * max(k or 1, 16):
                settle()
        if k is None:
            return
        if wait:
            settle()
        r, c = np.nonzero(best != NONE)
        key = best[r, c]
        place = key & ((1 << PLACE) - 1)
        by = np.argsort(place, kind="stable")
        r, place, sim = r[by], place[by], (1_000_000 - (key[by] >> PLACE)) / 1e6
        for start, names, y in _blocks(at, width, kind, 1 << 14, ["id", "v"]):
            a, z = np.searchsorted(place, [start, start + len(y)])
            if z > a:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[a:z])), names.take(pa.array(place[a:z] - start)), pa.array(sim[a:z])], names=["query", "item", "sim"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():  # a part of the queries, at most `room`, read where they are stored
                mine = pa.Table.from_batches(_rows(asked, count * i // parts, count * (i + 1) // parts, q_width), pa.schema([("id", pa.string()), ("v", pa.binary())]))
                if mine.num_rows:
                    yield from pairs(mine)

    # only the numbers of the parts are dealt out; what is found is taken to be as small as these by the planner, also while it runs, so a join must be told not to broadcast it
    return spark.range(0, parts, 1, 1).repartition(parts).mapInArrow(search, FOUND).hint("merge")


class Linked:
    """Texts that a query finds through what both are linked to: nearest ones of a link, without a row for any other pair.

    `texts` has ``id, v``, `links` ``id, link``, `queries` ``id, v``; `encode` makes vectors of double precision of either. The vectors
    are written once to the shared folder, with the codes of their links, when first asked for.
    """

    def __init__(self, queries: DataFrame, texts: DataFrame, links: DataFrame, encode: Callable[[Column], Column], least: float, block_rows: int = 8192, query_rows: int = 16384) -> None:
        self.queries, self.texts, self.links, self.encode, self.least = queries, texts, links, encode, least
        self.block_rows, self.query_rows, self._at = block_rows, query_rows, ""

    def best(self, live: DataFrame, used: DataFrame | None, k: int) -> DataFrame:
        """``query, link, score, item, sim``: for every row ``query, link, score`` of `live` the `k` nearest texts of that link.

        Only similarities above 0 and of at least `least` count, and not the texts that `used` (``query, item``) names for the
        query; ties go to the smaller id. A task holds up to `query_rows` queries and reads all texts, but only pairs that
        share a link are compared, so the work is no more than all pairs and mostly far less, and at most `k` rows a link come out.
        """
        spark = self.texts.sparkSession
        if not self._at:
            codes = self.links.where("id IS NOT NULL AND link IS NOT NULL").distinct().groupBy("id").agg(F.collect_list(F.xxhash64("link")).alias("codes"))  # a text's own links
            self._at = _stored(self.texts.join(codes, "id"), self.encode, "codes")
        at, least, block_rows, room = self._at, max(self.least, 1e-6), self.block_rows, self.query_rows
        dim = (spark.read.schema("id string, v binary").parquet(at).agg(F.max(F.length("v"))).first()[0] or 0) // 8
        found = "query string, link string, score double, item string, sim double"
        if not dim:
            return spark.createDataFrame([], found)
        asked = live.groupBy(F.col("query").alias("id")).agg(F.collect_list(F.struct("link", "score", F.xxhash64("link").alias("code"))).alias("live"))  # a query's own few
        gone = F.array().cast("array<string>")
        if used is not None:
            asked = asked.join(used.groupBy(F.col("query").alias("id")).agg(F.collect_list("item").alias("gone")), "id", "left")
            gone = F.coalesce("gone", gone)
        q = self.queries.where("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id"]).join(asked.select("id", "live", gone.alias("gone")), "id")
        parts = max(spark.sparkContext.defaultParallelism, -(-asked.count() * 10 // (9 * room)))
        error = (dim + 4) * 2.0**-23

        def pairs(batch: pa.Table) -> Iterator[pa.RecordBatch]:
            batch = batch.combine_chunks()
            ids, v, own, gone = (batch[c].combine_chunks() for c in ("id", "v", "live", "gone"))
            x = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            x32 = x.astype(np.float32)
            of = np.repeat(np.arange(len(ids)), own.value_lengths().to_numpy())  # the query of each live row
            flat = own.flatten()
            code, links, scores = flat.field("code").to_numpy(), flat.field("link"), flat.field("score")
            by = np.argsort(code, kind="stable")
            known, first, times = np.unique(code[by], return_index=True, return_counts=True)
            names = gone.flatten().unique()
            out_of = np.repeat(np.arange(len(ids)), gone.value_lengths().to_numpy()).astype(np.int64)
            out = np.unique(out_of * max(len(names), 1) + pc.index_in(gone.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64))
            best, floor = np.full((len(of), k), NONE), np.full(len(of), least - 1e-6)

            for start, b, y in _batches(at, dim * 8, np.float64, block_rows, ["id", "v", "codes"] if len(names) else ["v", "codes"]):
                codes = b["codes"].flatten().to_numpy()
                where = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = np.flatnonzero(known[where] == codes)
                if not len(hit):
                    continue
                col = np.repeat(np.arange(len(y)), b["codes"].value_lengths().to_numpy())[hit]
                cols, col = np.unique(col, return_inverse=True)
                y = _unit(y[cols])
                y32 = y.astype(np.float32)
                taken = np.full(len(cols), -1)
                if len(names):
                    taken = pc.fill_null(pc.index_in(b["id"].take(pa.array(cols)), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                group = where[hit]
                order = np.argsort(group, kind="stable")
                group, col = group[order], col[order]
                heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                ends = np.append(heads[1:], len(group))

                def settle(rows: np.ndarray, right: np.ndarray) -> None:
                    for i in range(0, len(rows), 1 << 16):
                        r, c = rows[i : i + (1 << 16)], right[i : i + (1 << 16)]
                        s = np.round(np.einsum("ij,ij->i", x[of[r]], y[c]), 6)
                        ok = s >= least
                        if len(names):
                            ok &= (taken[c] < 0) | ~np.isin(of[r].astype(np.int64) * len(names) + taken[c], out)
                        r, key = r[ok], (1_000_000 - np.rint(s[ok] * 1e6).astype(np.int64) << PLACE) + start + cols[c[ok]]
                        if len(r):
                            mine = np.unique(r)
                            r, key = np.concatenate([r, np.repeat(mine, k)]), np.concatenate([key, best[mine].ravel()])
                            way = np.lexsort((key, r))
                            r, key = r[way], key[way]
                            rank = np.arange(len(r)) - np.searchsorted(r, r)
                            best[r[rank < k], rank[rank < k]] = key[rank < k]
                            full = mine[best[mine, k - 1] != NONE]
                            floor[full] = (1_000_000 - (best[full, k - 1] >> PLACE)) / 1e6 - 1e-6

                large = times[group[heads]] * (ends - heads) >= 4096
                for a, z in zip(heads[large], ends[large], strict=True):  # a hub: a product of matrices, some rows at a time
                    rows = by[first[group[a]] : first[group[a]] + times[group[a]]]
                    for i in range(0, len(rows), 512):
                        r, c = _hits(x32[of[rows[i : i + 512]]] @ y32[col[a:z]].T, (floor[rows[i : i + 512]] - error).astype(np.float32))
                        settle(rows[i : i + 512][r], col[a:z][c])
                few = np.repeat(~large, ends - heads)
                g, c = group[few], col[few]
                n = times[g]
                for i, z in _shares(n, 1 << 16):
                    m = n[i:z]
                    rows = by[np.repeat(first[g[i:z]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                    right = np.repeat(c[i:z], m)
                    s = np.einsum("ij,ij->i", x32[of[rows]], y32[right])
                    settle(rows[s >= floor[rows] - error], right[s >= floor[rows] - error])
            r, c = np.nonzero(best != NONE)
            key = best[r, c]
            place = key & ((1 << PLACE) - 1)
            way = np.argsort(place, kind="stable")
            r, place, sim = r[way], place[way], (1_000_000 - (key[way] >> PLACE)) / 1e6
            for start, b, y in _batches(at, dim * 8, np.float64, 1 << 14, ["id", "v"]):
                a, z = np.searchsorted(place, [start, start + len(y)])
                if z > a:
                    i = pa.array(r[a:z])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[r[a:z]])), links.take(i), scores.take(i), b["id"].take(pa.array(place[a:z] - start)), pa.array(sim[a:z])], names=["query", "link", "score", "item", "sim"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                while (n := sum(h.num_rows for h in held)) >= room:
                    whole = pa.Table.from_batches(held)
                    yield from pairs(whole.slice(0, room))
                    held = whole.slice(room).to_batches() if n > room else []
            if sum(h.num_rows for h in held):
                yield from pairs(pa.Table.from_batches(held))

        return q.repartition(parts, "id").select("id", self.encode(F.col("v")).cast("array<double>").alias("v"), "live", "gone").mapInArrow(search, found)


def _shares(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of `n` whose sums are about `most`."""
    if len(n):
        part = (np.cumsum(n) - n) // most
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        yield from zip(at, [*at[1:], len(n)], strict=True)
