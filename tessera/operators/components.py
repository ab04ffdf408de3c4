"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each round is two
aggregations and two equi-joins over an edge table that never grows; rounds are written to
the shared folder, so no plan gets deeper than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.plans.scratch import few, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node on an edge; component is the smallest node reachable.

    Null endpoints, self loops and repeated edges add nothing.  Nodes without an edge are
    not returned: they are their own component.
    """
    def written(edges_: DataFrame, tag: str) -> tuple[DataFrame, dict]:
        """The table, and its number of rows and sum of hashes, seen while it is written."""
        seen = Observation()
        table = staged(few(edges_).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), tag)
        return table, seen.get

    now, mark = written(
        edges.select(F.greatest(F.col(src), F.col(dst)).alias("a"), F.least(F.col(src), F.col(dst)).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        if mark == before or not mark["n"]:
            break
        before = mark
        now, mark = written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
