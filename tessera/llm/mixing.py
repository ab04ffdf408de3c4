"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through up to ``epochs``
times.  A document's virtual finish time is the number of source words up to its end divided
by the source's target.  All queues are merged by a global range sort on finish times, and the
merged queue is cut where the running total reaches the budget.  A document in which its
source reaches its target is queued as two packets, so every source meets its target.

Both running totals (in a source, over all) are sums within range partitions plus offsets:
one number for each partition and source goes to the driver, rows never do, and no source
has to fit into a task.

Defined results: a null text has no words and is never taken; a null source is a source, the
last one; rows that are equal in id, source and text are interchangeable, each is a row of its
own; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frame import SPLIT, WHITE, Frame, let, local
from tessera.plans.scratch import kept, staged

WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: A mix names its sources one by one; more than this is no list of sources.
MAX_SOURCES = 100_000


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return let(bare, lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPLIT)))).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> dict[str | None, float]:
    """Words of each source: shares of all words by weight, in turn over the sources by code
    point (null last); what exceeds ``epochs`` times a source's size is shared out again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > epochs * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(epochs * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in order}


def whole(goal: dict[str | None, float]) -> dict[str | None, int]:
    """Targets as whole numbers with the same total: the largest remainders are rounded up."""
    floor = {s: int(t) for s, t in goal.items()}
    missing = round(sum(goal.values())) - sum(floor.values())
    for s in sorted(goal, key=lambda s: (floor[s] - goal[s], s is None, s or ""))[:missing]:
        floor[s] += 1
    return floor


def _prefix(df: DataFrame, order: list[Column], amount: str, group: list[str], out: str) -> DataFrame:
    """Adds the running total of ``amount`` in ``order`` within ``group``; the order has to
    begin with the group, so that a partition holds few groups."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part", *group).agg(F.sum(amount).alias("s")).orderBy("part").collect()
    seen: dict[tuple, int] = {}
    offsets = []
    for row in sums:
        key = tuple(row[g] for g in group)
        offsets.append((row["part"], *key, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + row["s"]
    kinds = dict(ranged.dtypes)
    schema = ", ".join(["p int", *(f"g{i} {kinds[g]}" for i, g in enumerate(group)), "before long"])
    known = local(spark, offsets, schema)
    on = F.col("part") == F.col("p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"g{i}"))
    within = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("within", F.sum(amount).over(within))
    return summed.join(F.broadcast(known), on).select(*df.columns, (F.col("before") + F.col("within")).alias(out))


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """``rid, doc_id, source, size`` -> the same with ``source_size, target, taken``."""
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["s"] for r in totals}
    goal = targets(sizes, weights, epochs)
    exact = whole(goal)
    sources = F.broadcast(
        local(spark, [(s, sizes[s], goal[s], exact[s]) for s in goal], "src string, source_size long, target double, words long")
    )
    known = rows.join(sources, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    # The queue of each source in shuffled order.
    queued = _prefix(
        known.where("size > 0").withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id")),
        [F.col("source"), F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("rid")],
        "size",
        ["source"],
        "upto",
    )
    # Packets: each document once for each epoch, split where its source reaches its target.
    turns = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    turns = turns.withColumn("end", F.col("epoch") * F.col("source_size") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    first = F.least(F.greatest(F.col("words") - F.col("start"), F.lit(0)), F.col("size"))
    packets = (
        turns.withColumn("cut", first)
        .withColumn(
            "packet",
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.col("cut").alias("n"), (F.col("start") + F.col("cut")).alias("done"), F.lit(0).alias("late")),
                        F.struct((F.col("size") - F.col("cut")).alias("n"), F.col("end").alias("done"), F.lit(1).alias("late")),
                    ),
                    lambda p: p["n"] > 0,
                )
            ),
        )
        .select(
            "rid",
            F.col("packet.n").alias("n"),
            "epoch",
            # A source that may take nothing has no finish time; its packets come last.
            F.when(F.col("words") > 0, F.col("packet.done") / F.col("words")).otherwise(F.lit(float("inf"))).alias("finish"),
            "shuffled",
        )
    )
    budget = sum(exact.values())
    order = [F.col("finish"), F.col("shuffled"), F.col("rid"), F.col("epoch")]
    merged = _prefix(packets, order, "n", [], "total")
    took = F.least(F.col("n"), F.greatest(F.lit(budget) - (F.col("total") - F.col("n")), F.lit(0)))
    taken = merged.withColumn("took", took).where("took > 0").groupBy("rid").agg(F.sum("took").alias("taken"))
    return known.join(taken, "rid", "left").select(
        "rid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed(documents: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The plan of a mix: one row for each row of ``documents`` with the words it takes."""
    frame = Frame(documents)
    rows = frame.df.select(
        frame.col("doc_id").cast("long").alias("doc_id"),
        frame.col("source").alias("source"),
        n_words(frame.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("rid"),
    )
    # Written with its numbers, so that nothing numbers the rows again.
    found = plan(staged(rows, "sizes"), weights, epochs, seed)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def first_words(text: Column, n: Column) -> Column:
    """A text up to its ``n``-th word, white space between words unchanged."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed documents themselves: a row for each full turn of a document, and one with
    its first words where the mix takes a part of it; all columns are carried."""
    frame = Frame(documents)
    table = staged(frame.df.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    rows = table.select(
        "rid", frame.col("doc_id").cast("long").alias("doc_id"), frame.col("source").alias("source"), n_words(frame.col("text")).alias("size")
    )
    found = plan(kept(rows), weights, epochs, seed).where("taken > 0").select("rid", "size", "taken")
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))
    taken = table.join(found, "rid").withColumn("turn", F.explode(turns))
    left = F.col("taken") - F.col("turn") * F.col("size")
    name = frame.name("text")
    partly = left < F.col("size")
    out = taken.withColumn(name, F.when(partly, first_words(F.col(name), left)).otherwise(F.col(name)))
    if "n_chars" in frame.names:
        chars = frame.name("n_chars")
        out = out.withColumn(chars, F.when(partly, F.length(F.col(name)).cast("long")).otherwise(F.col(chars)))
    return frame.restore(out)
