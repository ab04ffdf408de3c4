"""Ingest as a batch and as a stream (inventory 2.J)."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import scalar, signal
from tessera.operators import catalog
from tessera.plans.scratch import drop, staged
from tessera.schemas import Busy, NotFound, complete
from tessera.sources import audio

BATCH = 1000


def standardized(analyzed: DataFrame) -> DataFrame:
    """Raw vectors to the vectors that are stored, with built-in functions."""
    mean = F.array(*map(F.lit, signal.MEAN.tolist()))
    std = F.array(*map(F.lit, signal.STD.tolist()))
    z = F.transform("raw", lambda x, i: scalar.standardize(x, F.get(mean, i), F.get(std, i)))
    return analyzed.withColumn("v", F.when(F.col("raw").isNotNull(), z).cast("array<float>"))


def _scan_batch(store: catalog.Store, part: DataFrame, now: int, embedding: bool) -> tuple[int, int]:
    """Hash, find twins, analyse and persist some listed files; how many were added and failed.

    Contents are read twice at most - for their hash, and again where they have to be analysed -
    and never leave the stage that reads them.  What an earlier batch or scan has finished with the
    same content is copied from there, equal contents of this batch are analysed once.
    """
    spark = store.spark
    samples, features, vectors = (store.read(t) for t in ("samples", "sample_features", "vectors"))
    part = staged(part, "scan-part")
    names = F.broadcast(part.select("path", "rel_path", "ext"))  # a batch at most
    paths = [r["path"] for r in part.where(F.col("size_bytes") <= audio.READABLE_BYTES).select("path").collect()]
    found = audio.hashes(audio.contents(spark, paths).join(names, "path"))
    planned = staged(catalog.twins(part.drop("content_hash").join(found, "rel_path", "left"), samples, embedding), "scan-plan")
    leaders = planned.where("plan = 'compute'").select("path").collect()
    wanted = audio.contents(spark, [r["path"] for r in leaders]).join(names, "path")
    done = staged(standardized(audio.analyze(wanted)).drop("rel_path", "raw").withColumnRenamed("content_hash", "h"), "scan-done")
    told = ["duration_ms", "sample_rate", "channels", "status", "error", "v", *signal.DESCRIPTORS]
    own = planned.join(done, F.col("content_hash") == F.col("h"), "left").where("plan <> 'existing'")
    lost = F.when(F.col("content_hash").isNull(), F.lit("the file can not be read")).otherwise(F.lit("the content changed while it was read"))
    own = own.withColumn("error", F.when(F.col("h").isNull(), lost).otherwise(F.col("error"))).withColumn("status", F.when(F.col("h").isNull(), "decode_failed").otherwise(F.col("status")))
    of_samples = samples.select(F.col("id").alias("twin_id"), "duration_ms", "sample_rate", "channels", F.lit("decoded").alias("status"), F.lit(None).cast("string").alias("error"), "vector_id")
    blocks = features.select(F.col("sample_id").alias("twin_id"), *signal.DESCRIPTORS)
    twin = planned.where("plan = 'existing'").join(of_samples, "twin_id").join(blocks, "twin_id", "left").withColumn("v", F.lit(None).cast("array<float>"))
    named = ["root_id", "rel_path", "filename", "ext", "size_bytes", "mtime", "content_hash"]
    rows = staged(own.withColumn("vector_id", F.lit(None).cast("long")).select(*named, *told, "vector_id").unionByName(twin.select(*named, *told, "vector_id")), "scan-rows")
    merged = staged(catalog.upsert_samples(samples, rows.select(*named, "duration_ms", "sample_rate", "channels", "status"), now), "scan-samples")
    keyed = staged(rows.join(merged.select(F.col("id").alias("sample_id"), "root_id", "rel_path"), ["root_id", "rel_path"]), "scan-keyed")
    distinct = keyed.where(F.col("v").isNotNull()).groupBy("content_hash").agg(F.min("sample_id").alias("leader"), F.first("v").alias("v"))
    fresh = staged(catalog.number(distinct, [F.col("leader")], catalog.next_id(vectors, "vector_id"), "vector_id"), "scan-vectors")
    if embedding:
        given = keyed.where(F.col("v").isNotNull()).select("sample_id", "content_hash").join(fresh.select("content_hash", "vector_id"), "content_hash").select("sample_id", "vector_id")
        merged = catalog.set_embeddings(merged, given.unionByName(keyed.where("vector_id is not null").select("sample_id", "vector_id")))
    merged = catalog.mark_failed(merged, keyed.where("error is not null").select("sample_id", "error"))
    tables = {"vectors": vectors.unionByName(catalog.checked_vectors(fresh.select("vector_id", "v"), signal.WIDTH))} if embedding else {}
    store.write(tables | {"sample_features": catalog.set_features(features, keyed.where("status = 'decoded'").select("sample_id", *signal.DESCRIPTORS)), "samples": merged})
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
    for table in (part, planned, done, rows, merged, keyed, fresh):
        drop(table)
    return total["n"] - total["failed"], total["failed"]


def scan_root(store: catalog.Store, root_id: int, now: int, embedding: bool = True, cancelled: Callable[[], bool] = lambda: False, batch: int = BATCH) -> dict[str, int]:
    """Scan one root: list, skip what is known, then hash, find twins, analyse and persist batch by
    batch (J1-J7).

    The run is on record as running from the start.  Each batch of ``batch`` files is one commit:
    vectors before the rows that refer to them, and one pointer that makes all of it visible; so
    what a cancelled or failed scan has finished stays, with a count of it.  Only files that are
    new or changed are read.  Failures are rows.
    """
    roots = store.read("library_roots")
    root = roots.where(F.col("id") == root_id).first()
    if root is None:
        raise NotFound(f"root {root_id}")
    begun, scan_id = catalog.start_scan(store.read("scan_runs"), root_id, now)
    store.write({"scan_runs": begun})
    tally = {"seen": 0, "added": 0, "skipped": 0, "failed": 0}

    def finish(status: str, error: str | None = None) -> dict[str, int]:
        store.write({"scan_runs": catalog.finish_scan(store.read("scan_runs"), scan_id, status, tally, error, now)})
        return {"scan_id": scan_id} | tally

    try:
        found = audio.audio_only(audio.listed(store.spark, root["path"])).withColumn("root_id", F.lit(root_id).cast("long"))
        todo = audio.changed(found, store.read("samples"), complete(F.col("status"), embedding))
        numbered = catalog.number(todo, [F.col("rel_path")], 0, "n").persist()
        wanted = numbered.count()
        tally["seen"] = found.count()
        tally["skipped"] = tally["seen"] - wanted
        for first in range(0, wanted, batch):
            if cancelled():
                return finish("cancelled")
            added, failed = _scan_batch(store, numbered.where(F.col("n").between(first, first + batch - 1)).drop("n"), now, embedding)
            tally["added"] += added
            tally["failed"] += failed
        numbered.unpersist()
    except Exception as e:
        finish("cancelled" if cancelled() else "failed", f"{type(e).__name__}: {e}"[:500])
        raise
    return finish("cancelled" if cancelled() else "completed")


def scan_all(store: catalog.Store, now: int, **options) -> list[dict[str, int]]:
    """All enabled roots, one after another."""
    return [scan_root(store, r["id"], now, **options) for r in store.read("library_roots").where("enabled").orderBy("added_at", "id").collect()]


# -- streams ----------------------------------------------------------------------------------------


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_content(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose content has not been seen within the watermark: those to compute."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def persist_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Micro-batches to a writer; a batch is written again under its number after a failure."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()


def progress(events: DataFrame, time: str, value: str, key: str, step: str = "100 milliseconds", ties: tuple[str, ...] = ()) -> DataFrame:
    """The last value of each job's steps, and only where it changed (J8, batch form)."""
    last = events.groupBy(key, F.window(time, step).alias("w")).agg(F.max_by(value, F.struct(time, *ties, value)).alias("last"))
    order = Window.partitionBy(key).orderBy("at")
    steps = last.select(key, F.col("w.start").alias("at"), "last").withColumn("before", F.lag("last").over(order))
    return steps.where(F.col("before").isNull() | (F.col("before") != F.col("last"))).select(key, "at", "last")


def progress_stream(stream: DataFrame, time: str, keys: list[str], step: str, late: str) -> DataFrame:
    """The last event of each key and step, once the step is over."""
    return stream.withWatermark(time, late).groupBy(F.window(time, step).alias("w"), *keys).agg(F.max_by(F.struct("*"), F.col(time)).alias("last"), F.count(F.lit(1)).alias("n"))


def debounced(stream: DataFrame, time: str, key: str, gap: str, value: str, late: str | None = None) -> DataFrame:
    """The last value of each burst: bursts end after ``gap`` without an event."""
    source = stream.withWatermark(time, late) if late else stream
    bursts = source.groupBy(key, F.session_window(time, gap).alias("w"))
    return bursts.agg(F.max_by(value, time).alias("last"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last", "n")


# -- jobs ----------------------------------------------------------------------------------------------


class Jobs:
    """One scan and one refit at a time; both can be cancelled by their number."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock, self._next = spark, threading.Lock(), 1
        self._running: dict[str, tuple[int, threading.Event]] = {}

    def run(self, kind: str, work: Callable[[int, Callable[[], bool]], object]) -> object:
        with self._lock:
            if kind in self._running:
                raise Busy(f"a {kind} is running")
            job, flag = self._next, threading.Event()
            self._next += 1
            self._running[kind] = job, flag
        sc = self.spark.sparkContext
        try:
            sc.setJobGroup(f"{kind}-{job}", kind, interruptOnCancel=True)
            return work(job, flag.is_set)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            with self._lock:
                del self._running[kind]

    def cancel(self, kind: str, job: int) -> None:
        with self._lock:
            running = self._running.get(kind)
            if running is None or running[0] != job:
                raise NotFound(f"{kind} {job}")
            running[1].set()
        self.spark.sparkContext.cancelJobGroup(f"{kind}-{job}")

    def any_running(self) -> bool:
        with self._lock:
            return bool(self._running)

