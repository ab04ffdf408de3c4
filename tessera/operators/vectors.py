"""Nearest neighbours and placement (inventory C11, E4, E5, I8, I10, I15)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators.components import connected_components
from tessera.plans.ship import ensure

MAX_K, NEIGHBOURS = 200, 15
#: Query vectors that are held against the matrix at a time, and its rows in a unit where there are more.
BLOCK, ROWS = 4096, 16_384
#: Pairs that are looked at by one matrix product, and scored at a time.
CELLS, PAIRS = 1 << 22, 1 << 18


def similar(vectors: DataFrame, target_id: int, k: int) -> DataFrame:
    """The ``k`` vectors most alike to one (E4): ``id, similarity``, itself left out, negative
    cosines shown as 0 but ranked by sign, ties in order of id."""
    k = max(1, min(MAX_K, k))
    target = vectors.where(F.col("id") == target_id).limit(1).select(F.col("v").alias("t"))
    found = vectors.where(F.col("id") != target_id).crossJoin(F.broadcast(target)).select("id", scalar.cosine(F.col("v"), F.col("t")).alias("cos"))
    return found.orderBy(F.desc("cos"), "id").limit(k).select("id", F.greatest("cos", F.lit(0.0)).alias("similarity"))


def _summed(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sums of products in the order of the components, so that a pair has the same sum in every batch."""
    out = np.zeros(n)
    for a, b in pairs:
        out += a * b
    return out


def _nearest(queries: pd.DataFrame, k: int, metric: str):
    """Per-partition top k of a bounded block of queries.

    Matrix products only tell which pairs may be among the best: their last bits depend on where a
    row lies.  Those pairs are scored again component by component, so copies of a vector tie
    and go by id, and a distance of nothing is 0.
    """
    ids = queries["id"].to_numpy()
    q = np.stack(queries["v"].to_numpy()).astype(np.float64) if len(ids) else np.zeros((0, 1))
    qt = np.ascontiguousarray(q.T)
    q2 = _summed(zip(qt, qt, strict=True), len(ids))
    step, slack = max(64, CELLS // max(1, len(ids))), 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps

    def unit(x: np.ndarray, x2: np.ndarray) -> np.ndarray:
        return np.divide(x, np.sqrt(x2)[:, None], out=np.zeros_like(x), where=x2[:, None] != 0)

    def bounds(x: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a pair's key (negative cosine, squared distance) is at least, and by how much it may exceed that."""
        if metric == "cosine":
            low = unit(q, q2) @ unit(x, x2).T
            np.negative(low, out=low)
            return np.subtract(low, slack, out=low), np.full((1, 1), 2 * slack)
        low = q @ x.T
        low *= -2
        low += (q2 * (1 - slack))[:, None]
        low += (x2 * (1 - slack))[None, :]
        return low, 2 * slack * (q2.max(initial=0.0) + x2)[None, :]

    def scores(i: np.ndarray, j: np.ndarray, xt: np.ndarray, x2: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            size = np.sqrt(q2[i] * x2[j])
            dots = _summed(((a[i], b[j]) for a, b in zip(qt, xt, strict=True)), len(i))
            return np.clip(np.divide(dots, size, out=np.zeros(len(i)), where=size != 0), -1, 1)
        ways = (a[i] - b[j] for a, b in zip(qt, xt, strict=True))
        return np.sqrt(_summed(((w, w) for w in ways), len(i)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The best so far by query, key and id; the k-th of each query and a bound of its key.
        at, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        last, last_id, limit = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.inf)

        def key(s: np.ndarray) -> np.ndarray:
            """Smaller is better; what is not a number is the greatest, as in SQL."""
            return np.where(np.isnan(s), -np.inf, -s) if metric == "cosine" else np.where(np.isnan(s), np.inf, s)

        for batch in batches:
            for start in range(0, len(batch) if len(ids) else 0, step):
                some = batch.iloc[start : start + step]
                x = np.stack(some["v"].to_numpy()).astype(np.float64)
                own, xt = some["id"].to_numpy(), np.ascontiguousarray(x.T)
                x2 = _summed(zip(xt, xt, strict=True), len(own))
                low, more = bounds(x, x2)
                mine = ids[:, None] == own[None, :]
                if len(own) >= k and np.isinf(limit).any():
                    limit = np.fmin(limit, np.partition(np.where(mine, np.inf, low + more), k - 1, axis=1)[:, k - 1])
                may = low > limit[:, None]
                may |= mine
                i, j = np.nonzero(~may)
                found = [(at, other, score)]
                for cut in range(0, len(i), PAIRS):
                    ii, jj = i[cut : cut + PAIRS], j[cut : cut + PAIRS]
                    s = scores(ii, jj, xt, x2)
                    better = (key(s) < last[ii]) | ((key(s) == last[ii]) & (own[jj] < last_id[ii]))
                    found.append((ii[better], own[jj][better], s[better]))
                at, other, score = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((other, key(score), at))
                at, other, score = at[order], other[order], score[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                full = at[place == k - 1]
                last[full], last_id[full] = key(score[place == k - 1]), other[place == k - 1]
                limit[full] = np.fmin(limit[full], last[full] if metric == "cosine" else last[full] ** 2 * (1 + slack))
                at, other, score = at[place < k], other[place < k], score[place < k]
        yield pd.DataFrame({"query_id": ids[at], "id": other, "score": score})

    return work


def nearest(queries: DataFrame, vectors: DataFrame, k: int = NEIGHBOURS, metric: str = "cosine") -> DataFrame:
    """``query_id, id, score, rank``: the k best of ``vectors (id, v)`` for each query.

    At most BLOCK queries are sent to the vectors, one pass with a bounded top-k in every
    partition and a merge.  More queries are dealt out with the vectors to units of at most about
    4 BLOCK queries and ROWS vectors; nothing passes through the driver.  Score is the cosine (0 for
    a zero vector), or for ``euclid`` the distance.  Null vectors take no part.
    """
    spark = vectors.sparkSession
    ensure(spark)
    answer = "query_id long, id long, score double"
    queries, vectors = (d.select(F.col("id").cast("long"), "v").where("v is not null") for d in (queries, vectors))
    some = queries.limit(BLOCK + 1).collect()
    if len(some) <= BLOCK:
        block = pd.DataFrame([(r["id"], np.asarray(r["v"], np.float64)) for r in some], columns=["id", "v"]).astype({"id": "int64"})
        # A file may be one row group, which one task would read and work through alone.
        spread = vectors.repartition(max(spark.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions()), "id")
        out = spread.mapInPandas(_nearest(block, k, metric), answer)
    else:
        parts, blocks = -(-queries.count() // (4 * BLOCK)), -(-vectors.count() // ROWS)

        def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
            place, each = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            return rows.select("id", "v", place.alias(own), each.alias(other), F.lit(own == "part").alias("asks"))

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            asked, held = rows[rows["asks"]].reset_index(drop=True), rows[~rows["asks"]]
            return next(_nearest(asked, k, metric)(iter([held])))

        # One table, not a cogroup: that needs keys of one type on both sides and prunes columns that both have from one source.
        both = dealt(queries, "part", parts, "block", blocks).unionByName(dealt(vectors, "block", blocks, "part", parts))
        out = both.groupBy("part", "block").applyInPandas(solve, answer)
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), "id")
    # Pandas makes nulls of scores that are not numbers.
    return out.withColumn("score", F.coalesce("score", F.lit(float("nan")))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_pairs(queries: DataFrame, vectors: DataFrame, k: int, score: Column, best_first: bool = True) -> DataFrame:
    """Batch top-k with built-in functions only; ``score`` is over ``q.v`` and ``x.v``.

    Queries are broadcast BLOCK at a time.
    """
    parts = max(1, -(-queries.count() // BLOCK))
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    x = vectors.select("id", F.col("v").alias("x"))
    each = [q] if parts == 1 else [q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
    pairs = reduce(DataFrame.unionByName, [x.join(F.broadcast(some), F.col("id") != F.col("query_id")) for some in each])
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if best_first else F.asc("score"), "id")
    return pairs.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def barycentre(neighbours: DataFrame, key: str = "query_id") -> DataFrame:
    """Inverse-distance mean of ``distance, x, y`` for each key."""
    w = 1 / (F.greatest("distance", F.lit(0.0)) + scalar.NEAR)
    total = F.sum(w)
    fine = total.isNotNull() & ~F.isnan(total) & (F.abs(total) < float("inf"))
    return neighbours.groupBy(key).agg(*(F.when(fine, F.sum(w * F.col(a)) / total).otherwise(F.avg(a)).alias(a) for a in "xy"))


def place(newcomers: DataFrame, anchors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Coordinates ``id, x, y, z`` of vectors that have none, from their nearest placed ones.

    ``anchors`` are ``id, v, x, y``.  With fewer than two nothing can be placed.  Anchors are
    never written; colours of placed points stay null.
    """
    facts = anchors.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)).alias("extent")
    ).first()
    if facts["n"] < 2:
        return newcomers.where(F.lit(False)).select("id", *(F.lit(0.0).alias(c) for c in "xyz"))
    near = nearest(newcomers, anchors.select("id", "v"), min(k, facts["n"]), "euclid")
    near = near.withColumnRenamed("score", "distance").where(F.col("distance") < float("inf"))
    placed = barycentre(near.join(anchors.select("id", "x", "y"), "id"))
    dx, dy = scalar.jitter(F.col("query_id"), F.lit(float(facts["extent"] or 0.0)))
    return placed.select(F.col("query_id").alias("id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(0.0).alias("z"))


def newcomers(embedded: DataFrame, points: DataFrame, run_id: int) -> DataFrame:
    """Embedded samples without a coordinate in a run."""
    have = points.where(F.col("run_id") == run_id).select("sample_id")
    return embedded.join(have, "sample_id", "left_anti")


def n_components(ids: DataFrame, edges: DataFrame) -> int:
    """Connected components of an undirected neighbour graph (I8)."""
    found = connected_components(edges)
    alone = ids.join(found.select(F.col("node").alias("id")), "id", "left_anti").count()
    return alone + found.select("component").distinct().count()


def hit_rate(spatial: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of spatial neighbours ``query_id, id`` that are among the true ones."""
    marked = spatial.join(truth.select("query_id", "id", F.lit(1.0).alias("hit")), ["query_id", "id"], "left")
    return marked.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("hit_rate"))
