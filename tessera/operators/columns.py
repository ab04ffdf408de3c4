"""Column analytics behind a map (inventory D6-D16, E7-E9, G22-G24, C13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.plans.scratch import kept

# Ramps and the colour of a missing value.
MISSING = (0.3, 0.32, 0.38)
RAMPS: dict[str, list[tuple[float, float, float]]] = {
    "ember": [(0.18, 0.24, 0.48), (0.29, 0.35, 0.68), (0.55, 0.33, 0.62), (0.85, 0.36, 0.42), (0.98, 0.6, 0.27), (0.99, 0.9, 0.61)],
    "ice": [(0.13, 0.21, 0.39), (0.16, 0.36, 0.56), (0.16, 0.5, 0.63), (0.36, 0.72, 0.71), (0.72, 0.9, 0.83)],
    "wheel": [(0.91, 0.35, 0.4), (0.9, 0.62, 0.3), (0.68, 0.82, 0.36), (0.34, 0.79, 0.62), (0.36, 0.6, 0.9), (0.7, 0.44, 0.88), (0.91, 0.35, 0.4)],
    "binary": [(0.36, 0.6, 0.9), (0.95, 0.65, 0.32)],
}
DOMAINS = {"keyRoot": (0.0, 12.0), "keyMode": (0.0, 1.0), "keyConfidence": (0.0, 1.0), "bpmConfidence": (0.0, 1.0), "spectralFlatness": (0.0, 1.0)}
FEATURE_RAMPS = {"keyRoot": "wheel", "keyMode": "binary", "spectralCentroid": "ice", "spectralFlatness": "ice", "zeroCrossing": "ice"}
MAX_TRAIL = 100


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def at_rank(df: DataFrame, column: str, ranks: DataFrame) -> DataFrame:
    """``name, value`` of the values at given ranks (from 1) in ascending order.

    Distinct values are counted, sorted by range and summed up by partition, so that no
    column has to pass through one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # Kept, so that both uses see the same partitions.
    ranged = kept(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("s"))
    offset = sums.withColumn("before", F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(offset), "part").withColumn("upto", F.col("upto") + F.col("before"))
    return placed.join(F.broadcast(ranks), (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select("name", F.col("v").alias("value"))


def domain(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row ``low, high``: nearest-rank percentiles at round(q (n-1)); the extremes where
    those coincide, (0, 1) where there is no value (D11)."""
    value = df.select(F.col(column).cast("double").alias("x")).where(finite(F.col("x")))
    facts = value.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    pick = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.floor(F.lit(q) * (F.col("n") - 1) + 0.5) + 1).alias("rank")) for name, q in (("low", low), ("high", high)))))
    ranks = facts.where("n > 0").select(pick.alias("p")).select("p.name", "p.rank")
    picked = at_rank(value, "x", ranks).agg(F.max(F.when(F.col("name") == "low", F.col("value"))).alias("low"), F.max(F.when(F.col("name") == "high", F.col("value"))).alias("high"))
    both = facts.crossJoin(picked)
    spread = F.col("high") > F.col("low")
    return both.select(
        F.when(F.col("n") == 0, 0.0).when(spread, F.col("low")).otherwise(F.col("least")).alias("low"),
        F.when(F.col("n") == 0, 1.0).when(spread, F.col("high")).otherwise(F.col("most")).alias("high"),
    )


def coloured(df: DataFrame, column: str, bounds: DataFrame, ramp: str = "ember") -> DataFrame:
    """Adds ``r, g, b``: the ramp over the domain, its middle where the domain is a point, the
    missing colour for null and NaN (G22)."""
    v = F.col(column).cast("double")
    span = F.col("high") - F.col("low")
    t = F.when(span > 0, (v - F.col("low")) / span).otherwise(0.5)
    rgb = scalar.ramp(t, RAMPS[ramp])
    absent = v.isNull() | F.isnan(v)
    out = df.crossJoin(F.broadcast(bounds))
    return out.select(*df.columns, *(F.when(absent, F.lit(m)).otherwise(c).alias(n) for n, c, m in zip("rgb", rgb, MISSING, strict=True)))


def fitted_colours(points: DataFrame, fallback: tuple[float, float, float] = MISSING) -> DataFrame:
    """Colours that a fit stored, or the fallback for points without."""
    absent = F.col("r").isNull() | F.isnan("r")
    return points.select("sample_id", *(F.when(absent, F.lit(f)).otherwise(F.col(c)).alias(c) for c, f in zip("rgb", fallback, strict=True)))


def missing(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("missing"))


def mask(points: DataFrame, ids: DataFrame) -> DataFrame:
    """``sample_id, mask``: 1 where a point is among the ids."""
    hit = ids.select("sample_id").distinct().withColumn("hit", F.lit(1))
    return points.select("sample_id").join(hit, "sample_id", "left").select("sample_id", F.coalesce("hit", F.lit(0)).cast("tinyint").alias("mask"))


def viewport(points: DataFrame, x0: float, y0: float, x1: float, y1: float, limit: int) -> DataFrame:
    """Points in a box, nearest to its middle first."""
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return by_distance(inside, (x0 + x1) / 2, (y0 + y1) / 2).limit(limit)


def by_distance(points: DataFrame, x: float, y: float) -> DataFrame:
    """All points by distance from a place, ties by id."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("d2", d2).orderBy("d2", "sample_id")


def trail(visits: DataFrame, limit: int = MAX_TRAIL) -> DataFrame:
    """Newest transitions of each user: repeats in a row count once.

    ``visits`` are ``user_id, seq, item``."""
    order = Window.partitionBy("user_id").orderBy("seq")
    moved = visits.withColumn("before", F.lag("item").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("item")))
    newest = Window.partitionBy("user_id").orderBy(F.desc("seq"))
    return moved.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).select("user_id", "seq", "item", "place")


def bounding_box(points: DataFrame, axes: str = "xy") -> DataFrame:
    """Least and largest of each axis, the diagonal, centre and radius."""
    box = points.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))
    span = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]
    box = box.withColumn("diagonal", F.sqrt(reduce(lambda a, b: a + b, [s * s for s in span])))
    return box.select("*", *(((F.col(f"max_{a}") + F.col(f"min_{a}")) / 2).alias(f"centre_{a}") for a in axes), (F.col("diagonal") / 2).alias("radius"))


def displacement(new: DataFrame, old: DataFrame) -> DataFrame:
    """Upper median of the way that points moved between two layouts, and its share of the
    old extent, null where there is none (D10, D14)."""
    both = new.select("sample_id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(old.select("sample_id", "x", "y"), "sample_id")
    moved = both.select(F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2).alias("d"))
    ranks = moved.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("median").alias("name"), (F.floor(F.col("n") / 2) + 1).alias("rank"))
    median = at_rank(moved, "d", ranks).agg(F.max("value").alias("median"))
    extent = bounding_box(old).select(F.col("diagonal").alias("extent"))
    return median.crossJoin(extent).withColumn("relative", F.try_divide(F.col("median"), F.when(F.col("extent") > 0, F.col("extent"))))


def min_max(df: DataFrame, axes: list[str]) -> DataFrame:
    """Each axis to 0..1, 0.5 where it does not vary."""
    bounds = F.broadcast(df.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))))
    out = df.crossJoin(bounds)
    for a in axes:
        span = F.col(f"hi_{a}") - F.col(f"lo_{a}")
        out = out.withColumn(a, F.when(span > 0, (F.col(a) - F.col(f"lo_{a}")) / span).otherwise(0.5))
    return out.select(*df.columns)


def bucket_extremes(series: DataFrame, key: str, n: int) -> DataFrame:
    """``key, bucket, lo, hi``: least and largest of ``n`` buckets of each series ``pos, value,
    size`` with edges at whole-number division (G12)."""
    # The last bucket whose start does not lie behind a position.
    bucket = F.floor(((F.col("pos") + 1) * n - 1) / F.col("size")).cast("int")
    return series.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def moments(vectors: DataFrame) -> DataFrame:
    """``dim, mean, std`` over ``v``: population deviation, 1 where a dimension does not vary."""
    return vectors.select(F.posexplode(scalar.doubles(F.col("v"))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), scalar.safe_std(F.stddev_pop("x")).alias("std"))


def repeats_summary(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, least and largest over repeats, of each key if there are any."""
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))


def flux(frames: DataFrame) -> DataFrame:
    """Half-wave rectified difference to the frame before (G7): ``key, pos, value`` -> ``flux``."""
    order = Window.partitionBy("key").orderBy("pos")
    return frames.withColumn("flux", F.coalesce(F.greatest(F.col("value") - F.lag("value").over(order), F.lit(0.0)), F.lit(0.0)))


def onsets(series: DataFrame, gap: int = 5) -> DataFrame:
    """Candidates at least ``gap`` frames behind the onset before them (G8): ``key, pos, value``.

    Which candidate is kept depends on the one kept before it, so a series is folded in order.
    """
    found = onset_candidates(series).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c"))
    first = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(dict(found.dtypes)["c"]).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        take = s["last"].isNull() | (x["pos"] - s["last"] >= gap)
        return F.struct(F.when(take, x["pos"].cast("long")).otherwise(s["last"]).alias("last"), F.when(take, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return found.select("key", F.explode(F.aggregate("c", first, step, lambda s: s["kept"])).alias("o")).select("key", "o.pos", "o.value")


def onset_candidates(series: DataFrame) -> DataFrame:
    """Local maxima over 1.5 times the mean of +-10 frames and half the mean of all (G8, before
    the gap rule): ``key, pos, value``."""
    order = Window.partitionBy("key").orderBy("pos")
    local = F.avg("value").over(order.rowsBetween(-10, 10))
    whole = F.avg("value").over(Window.partitionBy("key"))
    out = series.select("*", F.lag("value").over(order).alias("before"), F.lead("value").over(order).alias("after"), local.alias("local"), whole.alias("whole"))
    peak = (F.col("value") > F.col("before")) & (F.col("value") >= F.col("after"))
    return out.where(peak & (F.col("value") > 1.5 * F.col("local")) & (F.col("value") > 0.5 * F.col("whole"))).select("key", "pos", "value")
