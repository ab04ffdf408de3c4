"""Join pruning with a broadcast of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most 2^20 bucket numbers are broadcast, whatever the size of the key table.
BITS = 20


def bucket(on: list[str], bits: int = BITS):
    return F.pmod(F.xxhash64(*on), F.lit(1 << bits)).cast("int")


def maybe_in(df: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose key may be in ``keys``: all that are, and a few others.

    Keys are hashed to 2^bits buckets and the used buckets are broadcast, so wide rows
    without a partner are dropped before a join shuffles them.  With more keys than buckets
    this prunes nothing and the join that follows does all the work.
    """
    used = F.broadcast(keys.select(bucket(on, bits).alias("_bucket")).distinct())
    return df.withColumn("_bucket", bucket(on, bits)).join(used, "_bucket", "left_semi").drop("_bucket")


def not_in(df: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """The other rows of ``df``: surely none of them has its key in ``keys``."""
    used = F.broadcast(keys.select(bucket(on, bits).alias("_bucket")).distinct())
    return df.withColumn("_bucket", bucket(on, bits)).join(used, "_bucket", "left_anti").drop("_bucket")
