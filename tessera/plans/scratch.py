"""Tables shared by driver and executors that cut lineage.

A plan that is read more than once, or that iterates, is written as Parquet below the
folder named by ``spark.checkpoint.dir`` and read again.  Every executor sees that folder,
so a lost executor costs a re-run of its tasks, never of the finished table.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset and all runs in this process
    (tests), a folder of our own.  Other machines would not see that, so a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = getattr(spark, "_tessera_folder", None)
        if folder is None:
            folder = spark._tessera_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def kept(df: DataFrame) -> DataFrame:
    """A plan that is read more than once, with its rows on the executors' disks.

    The lineage stays, so blocks of a lost executor are computed again from the input.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def few(df: DataFrame) -> DataFrame:
    """Fewer partitions for a table that is small against what it was made from."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, parts // 8))


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    for name, kind in df.dtypes:
        if kind == "void":
            df = df.withColumn(name, F.col(f"`{name}`").cast("string"))
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
