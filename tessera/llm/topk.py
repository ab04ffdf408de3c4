"""Exact top-k search by inner product as a Voronoi kNN join.

Rows go to the cell of their nearest pivot.  Each cell is summed up by its number of rows and
its radius r, so for a query q and a cell with pivot p no row of the cell can score more than
q.p + |q| r.  Every query is first solved in its own cell; its k-th score there bounds what is
still needed, and the query is sent only to cells whose bound reaches it.

Work is dealt out in units of a block of a cell and a part of the queries that need the cell;
both have a bounded size, so large cells (a third of all vectors may be equal) and cells that
many queries need become more units, not larger ones.  A unit holds its block and streams its
queries past it, so a row is sent once for each ``PART`` queries of its cell and a query once for
each block.  Pivots are rows of least hash, the square root of the number of rows but ``pivots``
at least, so cells have about as many rows as there are cells; the result does not depend on them.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do null ids; vectors of different lengths are not compared; empty ones score zero among
themselves; all rows with a query's
id are its own and no candidates; a repeated query row gives its list again; equal scores go by
smaller id.  Scores beyond 64 bits are clipped to that range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frame import Frame, map_batches, thinned
from tessera.plans.scratch import few, kept, staged

K = 5
PIVOTS = 96
#: Rows of a block, queries of a part, and queries held against a block at once.
BLOCK, PART, CHUNK = 16_384, 262_144, 2_048
EXACT = float(1 << 53)
TOP = (1 << 63) - 1


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v`` with whole-number components ``floor(scale * x)`` of all rows that take part."""
    frame = Frame(table)
    raw = frame.col(vector).cast("array<double>")
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = frame.df.where(frame.col(key).isNotNull() & raw.isNotNull() & fine)
    # Spark's floor gives a long; components beyond it stay doubles, which have no fraction there.
    whole = F.transform(raw, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return df.select(frame.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    lengths = np.diff(column.offsets.to_numpy())
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


class Pivots:
    def __init__(self, rows: list[list[float]]) -> None:
        self.of: dict[int, np.ndarray] = {}
        for n in {len(r) for r in rows}:
            self.of[n] = np.unique(np.array([r for r in rows if len(r) == n]), axis=0)

    def nearest(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance; rows of a length without pivots share cell -1."""
        p = self.of.get(m.shape[1])
        if p is None:
            return np.full(len(m), -1, np.int32), np.sqrt((m * m).sum(axis=1))
        square = (m * m).sum(axis=1)[:, None] - 2 * m @ p.T + (p * p).sum(axis=1)
        cell = square.argmin(axis=1).astype(np.int32)
        return cell, np.sqrt(((m - p[cell]) ** 2).sum(axis=1))


def _assign(pivots: Pivots):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            cell, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for at in _by_length(rows):
                cell[at], far[at] = pivots.nearest(_matrix(rows.take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["rid", "vec_id", "v", "cell", "far"])

    return work


def _route(pivots: Pivots, cells: dict[int, list[tuple[int, float]]]):
    """Query rows ``rid, vec_id, v, cell, least`` -> the other cells that may hold one of its best."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column(3).to_numpy(zero_copy_only=False)
            least = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            least = np.where(np.isnan(least), -np.inf, least)
            row, to = [], []
            for at in _by_length(batch.column(2)):
                m = _matrix(batch.column(2).take(pa.array(at)))
                norm = np.sqrt((m * m).sum(axis=1))
                for cell, radius in cells.get(m.shape[1], []):
                    middle = m @ pivots.of[m.shape[1]][cell] if cell >= 0 else 0.0
                    bound = middle + norm * radius
                    # A little more than rounding can take away.
                    need = at[(bound + 1e-9 * (np.abs(bound) + norm * radius) + 1 >= least[at]) & (home[at] != cell)]
                    row.append(need)
                    to.append(np.full(len(need), cell, np.int32))
            rows = np.concatenate(row) if row else np.zeros(0, np.int64)
            where = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(where) for i in range(3)] + [pa.array(np.concatenate(to) if to else np.zeros(0, np.int32))], ["rid", "vec_id", "v", "cell"]
            )

    return work


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of each query's k best rows; ``ids`` ascend."""
    if len(x) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if largest < EXACT:
        scores = q @ x.T
        low = -np.inf
    else:
        whole = [[int(c) for c in r] for r in q], [[int(c) for c in r] for r in x]
        scores = np.array([[max(-TOP - 1, min(TOP, sum(a * b for a, b in zip(r, s, strict=True)))) for s in whole[1]] for r in whole[0]], object)
        low = -(1 << 80)
    scores[own[:, None] == ids[None, :]] = low
    queries, found, values = [], [], []
    cut = max(len(x) - k, 0)
    edge = np.partition(scores, cut, axis=1)[:, cut] if len(x) > k else np.full(len(q), low)
    for i, (row, least) in enumerate(zip(scores, edge, strict=True)):
        at = np.flatnonzero((row >= least) & (row > low))
        if len(at) > k:
            above = at[row[at] > least]
            at = np.concatenate((above, at[row[at] == least][: k - len(above)]))
        queries.append(np.full(len(at), i))
        found.append(ids[at])
        values.append(row[at].astype(np.int64))
    return np.concatenate(queries), np.concatenate(found), np.concatenate(values)


def _solve(k: int):
    """Rows of units in order (candidates by id, then queries) -> local results."""

    def solved(block: dict[str, np.ndarray], asks: pa.RecordBatch) -> pa.RecordBatch:
        q, found, score = best(_matrix(asks.column(7)), asks.column(6).to_numpy(), block["m"], block["ids"], k)
        return pa.RecordBatch.from_arrays(
            [pa.array(asks.column(5).to_numpy()[q]), pa.array(asks.column(6).to_numpy()[q]), pa.array(found), pa.array(score)], ["rid", "query_id", "vec_id", "score"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, key = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1) if batch.num_rows else np.zeros((0, 5), np.int32)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                if (mine := tuple(keys[s, :4])) != key:
                    held, block, key = [], None, mine
                if not keys[s, 4]:
                    held.append(batch.slice(s, e - s))
                    continue
                if held and block is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    block, held = {"m": _matrix(rows.column("v").combine_chunks()), "ids": rows.column("vec_id").to_numpy()}, []
                if block is not None:
                    for at in range(s, e, CHUNK):
                        yield solved(block, batch.slice(at, min(CHUNK, e - at)))

    return work


def _spread(rows: DataFrame, needed: DataFrame, block: int, part: int) -> DataFrame:
    """Units of the rows of each cell and the queries that need it, in the order of ``_solve``."""
    many = rows.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("rows"))
    asked = needed.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("asks"))
    size = (
        staged(few(many.join(asked, ["n", "cell"]).select("n", "cell", F.ceil(F.col("rows") / block).cast("int").alias("blocks"), F.ceil(F.col("asks") / part).cast("int").alias("parts"))), "units")
    )

    def place(column: str, of: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    columns = ["n", "cell", "block", "part", "ask", "rid", "vec_id", "v"]
    asks = needed.join(size, ["n", "cell"]).withColumn("part", place("rid", "parts")).withColumn("block", each("blocks")).withColumn("ask", F.lit(1))
    held = rows.join(size, ["n", "cell"]).withColumn("block", place("rid", "blocks")).withColumn("part", each("parts")).withColumn("ask", F.lit(0))
    return (
        asks.select(*columns)
        .unionByName(held.select(*columns))
        .repartition("n", "cell", "block", "part")
        .sortWithinPartitions("n", "cell", "block", "part", "ask", "vec_id")
    )


def searched(table: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors`` that ``is_query`` (over
    ``vec_id``) picks, against all rows."""
    # Written with its numbers, so that nothing numbers the rows again.
    rows = staged(vectors(table).withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "v"), "vectors")
    total = rows.count()
    pivots = max(pivots, math.isqrt(total))
    few_rows = thinned(rows, F.col("vec_id"), pivots, total)
    sample = few_rows.orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)), "rid").limit(pivots).select("v").collect()
    fitted = Pivots([r["v"] for r in sample])
    placed = kept(map_batches(rows, _assign(fitted), "rid long, vec_id long, v array<double>, cell int, far double", 5_000).withColumn("n", F.size("v")))
    cells: dict[int, list[tuple[int, float]]] = {}
    for r in placed.groupBy("n", "cell").agg(F.max("far").alias("r")).collect():
        cells.setdefault(r["n"], []).append((r["cell"], r["r"]))
    queries = placed.where(is_query)
    answer = "rid long, query_id long, vec_id long, score long"
    near = kept(map_batches(_spread(placed, queries, block, part), _solve(k), answer, 5_000))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    least = near.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("rid", F.col("score").cast("double").alias("least"))
    ready = queries.join(least, "rid", "left").select("rid", "vec_id", "v", "cell", "least")
    needed = kept(map_batches(ready, _route(fitted, cells), "rid long, vec_id long, v array<double>, cell int", 1_000).withColumn("n", F.size("v")))
    far = map_batches(_spread(placed, needed, block, part), _solve(k), answer, 5_000)
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: The same for DuckDB.
ORACLE = r"""
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (
  select q.vec_id as query_id, x.vec_id, list_dot_product(q.v, x.v)::bigint as score
  from e q join e x on q.vec_id <> x.vec_id and len(q.v) = len(x.v) where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
