"""What the corpus operators share: safe column handling, words, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.plans.ship import ensure

#: Fixed by the contract: a word is a run of anything but these six characters.
WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Frame:
    """A table whose columns have been renamed by position while an operator works on it.

    Extra columns, also with names that differ from ours in case only or that occur twice,
    are carried along and get their own names back in ``restore``.
    """

    def __init__(self, table: DataFrame) -> None:
        self.names = table.columns
        self.df = table.toDF(*(f"c{i}" for i in range(len(self.names))))

    def name(self, column: str) -> str:
        return f"c{self.names.index(column)}"

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*(f"c{i}" for i in range(len(self.names)))).toDF(*self.names)


def pick(table: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, as ``new=old`` with an optional ``:type``."""
    frame = Frame(table)
    out = []
    for new, old in columns.items():
        name, _, kind = old.partition(":")
        column = frame.col(name)
        out.append((column.cast(kind) if kind else column).alias(new))
    return frame.df.select(*out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPLIT)))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def local(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, as a part of the plan: rows that are given as Python objects
    would start further Python workers on the executors to be read."""
    kind = StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to_arrow_schema(kind))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kind.names), kind)


def thinned(df: DataFrame, key: Column, wanted: int, total: int) -> DataFrame:
    """About four times ``wanted`` rows of ``total`` by least hash of their key, so that taking
    the ``wanted`` first of them moves few rows from each partition."""
    share = 4 * wanted / max(total, 1)
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))


def give_back() -> None:
    """Give the memory that has been freed back to the machine: Arrow's pool and the C heap keep it,
    and a worker that waits for its next task holds it beside the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` over batches of at most ``rows`` rows.  The session's own limits of a batch,
    in rows and bytes, are left as they are; its batches are cut here."""
    ensure(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            del batch
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(cut(batches))
        give_back()

    return df.mapInArrow(run, schema)
