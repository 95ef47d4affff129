"""The neighbour prior: co-occurrence fused with similarity of entities, thresholded, a few per entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import min_max
from .nearest import nearest, unit


def cooccurrence(sentence_entity: DataFrame) -> DataFrame:
    """``src, dst, cnt``: distinct sentences with both, in both orders."""
    a = sentence_entity.select("sentence_id", F.col("entity_id").alias("src"))
    b = sentence_entity.select("sentence_id", F.col("entity_id").alias("dst"))
    half = a.join(b, "sentence_id").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt"))


def prune(counts: DataFrame) -> DataFrame:
    """The best tenth of each row, at least 1 and at most 200 partners."""
    row = Window.partitionBy("src")
    ranked = counts.withColumn("rn", F.row_number().over(row.orderBy(F.desc("cnt"), "dst"))).withColumn("n", F.count("*").over(row))
    return ranked.where(F.col("rn") <= F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.lit(200))).select("src", "dst", "cnt")


def _unit(df: DataFrame) -> DataFrame:
    return df.select("hash_id", "embedding").where("hash_id IS NOT NULL AND size(embedding) > 0").dropDuplicates(["hash_id"])


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["hash_id"].to_numpy(zero_copy_only=False), unit(table["embedding"])


def entity_knn(entities: DataFrame, k: int = 10, block_rows: int = 2048) -> DataFrame:
    """``src, dst, sim``: the k nearest other entities by true cosine, exactly; the work is the square of the rows, `lsh_knn` compares fewer pairs."""
    rows = entities.select(F.col("hash_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows, rows, k, others=True, block_rows=block_rows).toDF("src", "dst", "sim")


def dense_knn(entities: DataFrame, block_rows: int = 2048) -> DataFrame:
    """``src, dst, sim``: exact neighbours, a tenth of all entities, at least 1 and at most 200 of each."""
    n = entities.where("hash_id IS NOT NULL").select("hash_id").distinct().count()
    return entity_knn(entities, max(1, min(n // 10, 200)), block_rows)


def lsh_knn(entities: DataFrame, k: int = 10, dim: int = 64, tables: int = 24, bits: int = 6, seed: int = 5, block_rows: int = 4096) -> DataFrame:
    """``src, dst, sim``: approximate neighbours; rows meet where the signs of random projections agree in one of `tables`.

    All rows of a code are compared: one with more than `block_rows` is divided into parts and every two parts meet.
    Half of the tenth neighbours have a similarity of only 0.5, so codes are short and tables many.
    """
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits)
        for b in batches:
            ids, x = _block(pa.Table.from_batches([b]))
            code = ((x @ planes > 0).reshape(len(x), tables, bits) * power).sum(axis=2) + (np.arange(tables) << bits) if len(x) else np.zeros((0, tables), int)
            at = pa.array(np.repeat(np.arange(len(x)), tables))
            flat = pa.array(x.ravel().astype(np.float32))
            vec = pa.FixedSizeListArray.from_arrays(flat, dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(code.ravel().astype(np.int64)), pa.array(ids, pa.string()).take(at), vec.take(at)], names=["code", "hash_id", "v"])

    rows = _unit(entities).where(F.size("embedding") == dim)
    hashed = rows.mapInArrow(sign, "code bigint, hash_id string, v array<float>")

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("hash_id")
        ids = group["hash_id"].to_numpy(zero_copy_only=False)
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        side = group["side"].to_numpy(zero_copy_only=False)
        every, left, right = np.arange(len(ids)), np.flatnonzero(~side), np.flatnonzero(side)
        same = group["i"][0].as_py() == group["j"][0].as_py()
        out = []
        for a, b in [(every, every)] if same else [(left, right), (right, left)]:
            w = min(k, len(b) - same)
            for at in range(0, len(a) if w > 0 else 0, 512):
                part = a[at : at + 512]
                s = x[part] @ x[b].T
                if same:
                    s[np.arange(len(part)), part] = -2.0
                key = np.rint(s * 1e6).astype(np.int64) * len(b) - np.arange(len(b))  # equal ones in the order of their ids
                top = np.argpartition(-key, w - 1, axis=1)[:, :w]
                out.append((np.repeat(ids[part], w), ids[b[top]].ravel(), np.take_along_axis(s, top, axis=1).ravel()))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], object), np.array([], object), np.array([])]
        return pa.table({"src": pa.array(cols[0], pa.string()), "dst": pa.array(cols[1], pa.string()), "sim": pa.array(cols[2].astype(np.float64))})

    # a crowded code is divided by the row's id, so no group grows without bound, and every two of its parts meet
    crowd = hashed.groupBy("code").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    placed = hashed.join(F.broadcast(crowd), "code", "left").withColumn("p", F.pmod(F.xxhash64("hash_id"), parts).cast("int"))
    paired = placed.withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    paired = paired.select("code", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).alias("side"), "hash_id", "v")
    found = paired.groupBy("code", "i", "j").applyInArrow(meet, "src string, dst string, sim double").groupBy("src", "dst").agg(F.round(F.max("sim"), 6).alias("sim"))
    rank = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).select("src", "dst", "sim")


def fuse(counts: DataFrame, similar: DataFrame, alphas: Sequence[float], k: int = 5, threshold: float = 0.5, scale: str = "max") -> DataFrame:
    """``alpha, src, dst, w, rn``: the prior for all weights in one plan; `alpha` is a column.

    Candidates are the top k of either side. Similarities are min-max scaled; counts are divided by the row's largest, or
    min-max scaled as well with `scale` = `min_max`, as the matrix mode does.
    """
    by = Window.partitionBy("src")
    co = counts.withColumn("r", F.row_number().over(by.orderBy(F.desc("cnt"), "dst"))).where(F.col("r") <= k).drop("r")
    sim = similar.withColumn("r", F.row_number().over(by.orderBy(F.desc("sim"), "dst"))).where(F.col("r") <= k).drop("r")
    both = co.join(sim, ["src", "dst"], "full_outer").select(
        "src", "dst", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)).alias("sim")
    )
    most = F.max("cnt").over(by)
    co_n = F.when(most > 0, F.col("cnt") / most).otherwise(0.0) if scale == "max" else min_max(F.col("cnt").cast("double"), F.min("cnt").over(by), most)
    scaled = both.select("src", "dst", co_n.alias("co_n"), min_max(F.col("sim"), F.min("sim").over(by), F.max("sim").over(by)).alias("sim_n"))
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    w = F.round(F.col("alpha") * F.col("co_n") + (1 - F.col("alpha")) * F.col("sim_n"), 9)
    fused = scaled.select("*", grid).withColumn("w", w).where(F.col("w") >= threshold)
    rank = Window.partitionBy("alpha", "src").orderBy(F.desc("w"), "dst")
    return fused.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).select("alpha", "src", "dst", "w", "rn")


def neighbour_stats(prior: DataFrame, entity: DataFrame) -> DataFrame:
    """One row an alpha: entities, those with none, with fewer than 5 or 10 neighbours and their shares in percent, all links, and the mean."""
    alphas = prior.select("alpha").distinct()
    degree = prior.groupBy("alpha", "src").agg(F.count("*").alias("d"))
    grid = entity.select(F.col("entity_id").alias("src")).distinct().crossJoin(F.broadcast(alphas))  # a handful of weights
    d = F.coalesce("d", F.lit(0))
    return grid.join(degree, ["alpha", "src"], "left").groupBy("alpha").agg(
        F.count("*").alias("entities"), F.count_if(d == 0).alias("zero"), F.count_if(d < 5).alias("below_5"), F.count_if(d < 10).alias("below_10"),
        F.sum(d).alias("links"), F.round(F.sum(d) / F.count("*"), 6).alias("mean_links"),
        *[F.round(100 * F.count_if(d < n) / F.count("*"), 6).alias(c) for n, c in ((1, "zero_percent"), (5, "below_5_percent"), (10, "below_10_percent"))],
    )


def sparsity(**links: DataFrame) -> DataFrame:
    """``name, filled, sources, targets, share``: how full each link table is, as a matrix of its sources and targets."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("filled"), F.count_distinct(df.columns[0]).alias("sources"), F.count_distinct(df.columns[1]).alias("targets")) for name, df in links.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    cells = F.col("sources").cast("double") * F.col("targets")
    return rows.withColumn("share", F.round(F.col("filled") / F.nullif(cells, F.lit(0.0)), 9))
