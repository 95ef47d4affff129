"""The most similar vectors of every vector: one small-world graph per shard, shard results merged.

Rows are routed to shards by the nearest of some centroids. The centroids are
fitted on at most `sample_rows` rows (the documented bound); every row is
indexed. A row whose nearest centroids are about equally near is also looked up
in those other shards, so neighbours across a border are found. Equal vectors
are one row of the graphs, whatever their number, and take their ids back at the
end; the `k + 1` smallest ids of a vector answer for all. A centroid that draws
more rows than `shard_rows` is split again on the sample; if that cannot divide
it (nearly equal vectors), its rows are spread over several graphs by the hash
of the row and every one of them asks all of these graphs.

Defined results: NULL, empty, all-zero, NaN or wrongly sized vectors take no
part; repeated rows of an id count once; ties go to the smaller id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import packed
from .hnsw import Shard

SCHEMA = "id string, neighbour string, similarity float"
#: Of a graph; `key` instead of `id` is a vector of more ids than answer for it.
FOUND = "key binary, id string, neighbour string, similarity float"


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows and their row numbers."""
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = col.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), rows[good]


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    cent = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ cent.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(cent)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        cent = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), cent)
    return cent


def plan_shards(x: np.ndarray, rows: int, shard_rows: int, max_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and, for each, over how many graphs its rows are spread."""
    cent = fit_centroids(x, min(max_shards, -(-rows // shard_rows)))
    for _ in range(3):
        near = (x @ cent.T).argmax(axis=1)
        share = np.bincount(near, minlength=len(cent)) / len(x) * rows
        parts, grew = [], False
        for c in range(len(cent)):
            want = int(share[c] // shard_rows)
            if want > 2 and len(cent) + want <= max_shards:
                finer = np.unique(fit_centroids(x[near == c], want), axis=0)
                grew |= len(finer) > 1
                parts.append(finer)
            else:
                parts.append(cent[c : c + 1])
        cent = np.concatenate(parts)
        if not grew:
            break
    share = np.bincount((x @ cent.T).argmax(axis=1), minlength=len(cent)) / len(x) * rows
    return cent.astype(np.float32), np.maximum(1, np.ceil(share / (4 * shard_rows))).astype(np.int64)


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 5,
    min_similarity: float = -1.0,
    *,
    dim: int = 64,
    shard_rows: int = 4096,
    max_shards: int = 4096,
    sample_rows: int = 65536,
    border: float = 0.04,
    degree: int = 10,
    effort: int = 32,
) -> DataFrame:
    """``id, neighbour, similarity``: up to `k` rows a id, by cosine similarity of at least `min_similarity`.

    `effort` and `border` trade accuracy for time; recall against brute force is measured in the tests.
    """
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dim)
    )
    spark = df.sparkSession
    total, rows = src.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("v"))).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    shard_rows = max(shard_rows, -(-rows // max_shards))  # past `max_shards` shards these grow, not their number
    want = min(sample_rows, 200 * -(-rows // shard_rows))
    picked = src.select("v").where(F.rand(11) < min(1.0, 1.1 * want / total)).limit(want).toArrow()
    sample, _ = _matrix(picked["v"].combine_chunks(), dim) if picked.num_rows else (np.zeros((0, dim), np.float32), None)
    if not len(sample):  # tiny tables may give an empty sample
        sample, _ = _matrix(src.select("v").limit(64).toArrow()["v"].combine_chunks(), dim)
    if not len(sample):
        sample = np.eye(1, dim, dtype=np.float32)
    cent, spread = plan_shards(np.unique(sample, axis=0), rows, shard_rows, max_shards)
    first = np.concatenate([[0], np.cumsum(spread)[:-1]])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(1), dim)
            raw = (x + np.float32(0)).tobytes()  # no negative zeros
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), vec], names=["id", "vec"])

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # of a batch, no more rows of one vector than can matter
            code = pc.dictionary_encode(b.column(1)).indices.to_numpy()
            if b.num_rows and code[-1] + 1 == b.num_rows == len(np.unique(code)):
                yield b
                continue
            name = _ranks(b.column(0))
            by = np.lexsort((name, code))
            by = by[np.concatenate([[True], (np.diff(code[by]) != 0) | (np.diff(name[by]) != 0)])] if len(by) else by
            yield b.take(pa.array(by[_place(code[by]) < k + 2]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their vectors and ids: a vector's `k + 1` smallest ids, and whether there are more."""
        last, heads = None, []

        def batch(done: list[tuple[bytes, list[str]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([h[: k + 1] for _, h in done], pa.list_(pa.string())), pa.array([len(h) > k + 1 for _, h in done], pa.bool_()), pa.array([v for v, _ in done], pa.binary())],
                names=["head", "more", "vec"],
            )

        for b in batches:
            done = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if v != last:
                    if last is not None:
                        done.append((last, heads))
                    last, heads = v, [i]
                elif len(heads) < k + 2 and i != heads[-1]:
                    heads.append(i)
            yield batch(done)
        if last is not None:
            yield batch([(last, heads)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, key, vec = b.column(0), b.column(1), b.column(2)
            x = np.frombuffer(b"".join(vec.to_pylist()), dtype=np.float32).reshape(-1, dim)
            sim = x @ cent.T
            best = sim.max(axis=1, initial=-2.0)
            r, c = np.nonzero(sim >= (best - border)[:, None])
            home = c == sim.argmax(axis=1)[r] if len(r) else np.zeros(0, bool)
            # the graph of a spread cell in which a row is indexed follows from the row's hash
            part = b.column(3).to_numpy()
            copies = spread[c]
            rr, cc, hh = np.repeat(r, copies), np.repeat(c, copies), np.repeat(home, copies)
            g = np.arange(len(rr)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = hh & (g == part[rr] % spread[cc])
            idx = pa.array(rr)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first[cc] + g).astype(np.int32)), pa.array(own), head.take(idx), key.take(idx), vec.take(idx)],
                names=["shard", "own", "head", "key", "vec"],
            )

    def graph(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(_ranks(pc.list_element(group["head"].combine_chunks(), 0)), kind="stable")))  # ties go by the smallest id
        head, key = group["head"].combine_chunks(), group["key"].combine_chunks()
        x = np.frombuffer(b"".join(group["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
        own = group["own"].to_numpy(zero_copy_only=False)
        inside, asking = np.flatnonzero(own), np.flatnonzero(~own)
        a = b = np.zeros(0, np.int64)
        s = np.zeros(0, np.float32)
        if len(inside):
            index = Shard(x[inside], m=degree, ef=max(effort, 2 * k), batch=512)
            p, q, s = index.links()
            # rows that came later are found in the finished graph
            p2, q2, s2 = index.again(2 * k + 4)
            a, b, s = inside[np.concatenate([p, p2])], inside[np.concatenate([q, q2])], np.concatenate([s, s2])
            if len(asking):
                near, sim = index.search(x[asking], max(effort, 2 * k))
                r, c = np.nonzero((near >= 0) & (sim >= min_similarity))
                a, b, s = np.concatenate([a, asking[r]]), np.concatenate([b, inside[near[r, c]]]), np.concatenate([s, sim[r, c]])
        ok = s >= min_similarity
        a, b, s = np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]]), np.concatenate([s[ok], s[ok]])
        _, once = np.unique(a * len(x) + b, return_index=True)
        a, b, s = a[once], b[once], s[once]
        best = _top(a, b, s, k)  # row numbers follow the ids here
        a, b, s = a[best], b[best], s[best]
        # from vectors to their ids; the ids of one vector are near to each other
        flat, size = head.flatten(), head.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at, name = np.cumsum(size) - size, _ranks(flat)
        alike = np.flatnonzero(size > 1) if min_similarity <= 1 else np.zeros(0, np.int64)
        a, b, s = np.concatenate([a, alike]), np.concatenate([b, alike]), np.concatenate([s, np.ones(len(alike), np.float32)])
        a, s, j = np.repeat(a, size[b]), np.repeat(s, size[b]), _runs(at[b], size[b])
        i, t, m = _runs(at[a], size[a]), np.repeat(s, size[a]), np.repeat(j, size[a])
        other = name[i] != name[m]
        i, t, m = i[other], t[other], m[other]
        best = _top(i, name[m], t, k)
        i, t, m = i[best], t[best], m[best]
        # what further ids of a vector are near to
        large = np.flatnonzero(key.is_valid().to_numpy(zero_copy_only=False)[a])
        large = large[_top(a[large], name[j[large]], s[large], k + 1)]
        return pa.table(
            {
                "key": pa.concat_arrays([pa.nulls(len(i), pa.binary()), key.take(pa.array(a[large]))]),
                "id": pa.concat_arrays([flat.take(pa.array(i)), pa.nulls(len(large), pa.string())]),
                "neighbour": flat.take(pa.array(np.concatenate([m, j[large]]))),
                "similarity": pa.array(np.concatenate([t, s[large]]).astype(np.float32)),
            }
        )

    unit = src.mapInArrow(units, "id string, vec binary")
    # equal vectors meet once, in order, and go on as one row; no key goes with them, as the vector is it
    alike = unit.mapInArrow(fewer, "id string, vec binary").repartition("vec").sortWithinPartitions("vec", "id")
    distinct = alike.mapInArrow(fold, "head array<string>, more boolean, vec binary")
    key = F.unhex(F.md5("vec"))
    distinct = distinct.select("head", F.when(F.col("more"), key).alias("key"), "vec", F.pmod(F.xxhash64("vec"), F.lit(1 << 30)).alias("part"))
    shards = distinct.mapInArrow(route, "shard int, own boolean, head array<string>, key binary, vec binary")
    found = packed(shards.groupBy("shard").applyInArrow(graph, FOUND))  # read by both branches below
    near, lists = found.where("id IS NOT NULL").drop("key"), found.where("key IS NOT NULL").drop("id")
    if not lists.isEmpty():  # vectors of more than k + 1 ids: every further id takes the list of the vector
        lists = _best(lists, "key", k + 1).groupBy("key").agg(F.collect_list(F.struct("neighbour", "similarity")).alias("list"))
        shared = unit.select(key.alias("key"), "id").join(lists, "key").select("id", F.explode("list").alias("x")).select("id", "x.neighbour", "x.similarity")
        near = near.unionByName(shared.where("id <> neighbour"))
    return _best(near, "id", k)


def _ranks(names: pa.Array) -> np.ndarray:
    """The place of each name in their order; equal names share one."""
    return pc.rank(names, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _place(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group; groups stand together."""
    every = np.arange(len(group))
    start = np.concatenate([[True], np.diff(group) != 0]) if len(group) else np.zeros(0, bool)
    return every - np.maximum.accumulate(np.where(start, every, 0)) if len(group) else every


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each `start` on, as many as its `size`."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _top(group: np.ndarray, item: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the `k` best items of each group, each item once; ties go to the smaller one."""
    by = np.lexsort((item, -sim, group))
    pair = group[by] * (item.max(initial=0) + 1) + item[by]
    by = by[np.sort(np.unique(pair, return_index=True)[1])]
    return by[_place(group[by]) < k]


def _best(found: DataFrame, of: str, k: int) -> DataFrame:
    """The `k` best neighbours of each `of`, which meet in one shuffle."""
    rank = Window.partitionBy(of).orderBy(F.desc("similarity"), "neighbour")
    once = found.repartition(of).groupBy(of, "neighbour").agg(F.max("similarity").alias("similarity"))
    return once.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank")


def linked_pairs(neighbours: DataFrame, store: Column) -> DataFrame:
    """Unordered pairs of which at least one is among the other's most similar."""
    return neighbours.select(
        store.alias("store"),
        F.least("id", "neighbour").alias("hash_id_a"),
        F.greatest("id", "neighbour").alias("hash_id_b"),
    ).distinct()
