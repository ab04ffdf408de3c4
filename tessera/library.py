"""The command surface (inventory 2.K): one object over a store of tables.

Every method is a typed request on the catalogue.  Reads return DataFrames or column frames;
writes go through the store and are visible at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, filters, fulltext, projection, vectors
from tessera.operators.filters import QueryFilter, Tables
from tessera.schemas import TABLES
from tessera.sources import audio
from tessera.streaming import ingest


def now_ms() -> int:
    return time.time_ns() // 1_000_000


class Library:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], int] = now_ms) -> None:
        self.spark, self.clock = spark, clock
        self.store = catalog.Store(spark, folder)
        self.jobs = ingest.Jobs(spark)

    def _read(self, *names: str) -> list[DataFrame]:
        return [self.store.read(n) for n in names]

    # -- roots and scans

    def add_library_root(self, path: str, label: str | None = None) -> int:
        roots, new = catalog.add_root(self.store.read("library_roots"), path, label, self.clock())
        self.store.write({"library_roots": roots})
        return new

    def list_library_roots(self) -> DataFrame:
        return self.store.read("library_roots").orderBy("added_at", "id")

    def set_root_enabled(self, root_id: int, enabled: bool) -> None:
        self.store.write({"library_roots": catalog.enable_root(self.store.read("library_roots"), root_id, enabled)})

    def remove_library_root(self, root_id: int) -> None:
        names = ("library_roots", "samples", "sample_features", "sample_tags", "collection_members", "projections")
        tables = catalog.remove_root(dict(zip(names, self._read(*names), strict=True)), root_id)
        tables["collection_members"] = catalog.resequenced(tables["collection_members"])
        self.store.write(tables)

    def scan_library(self, root_id: int | None = None) -> list[dict[str, int]]:
        """Scan one root, or all enabled ones; only one scan runs at a time."""

        def work(_: int, cancelled: Callable[[], bool]) -> list[dict[str, int]]:
            if root_id is None:
                return ingest.scan_all(self.store, self.clock(), cancelled=cancelled)
            return [ingest.scan_root(self.store, root_id, self.clock(), cancelled=cancelled)]

        return self.jobs.run("scan", work)

    def cancel_scan(self, job: int) -> None:
        self.jobs.cancel("scan", job)

    # -- map and filters

    def _tables(self, text: str | None = None) -> Tables:
        samples, features, tagged, tags, members, runs, points = self._read(
            "samples", "sample_features", "sample_tags", "tags", "collection_members", "projection_runs", "projections"
        )
        index = None
        if text is not None and fulltext.parse(text) is not None:
            index = self.postings()
        return Tables(samples, features, tagged, tags, members, runs, points, index)

    def postings(self) -> DataFrame:
        """The full-text index (F15): written once for each version of its tables and named by
        them, so it can never be out of date; sorted by token, so a search reads few of its rows."""
        versions = self.store.pointers()
        path = f"{self.store.folder}/_index/{'-'.join(str(versions.get(t, 0)) for t in ('samples', 'tags', 'sample_tags'))}"
        if not self.store.exists(f"{path}/_SUCCESS"):
            self._indexed().repartition("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _indexed(self) -> DataFrame:
        samples, tagged, tags = self._read("samples", "sample_tags", "tags")
        named = tagged.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("sample_id", "name")
        docs = fulltext.searched_text(samples.withColumnRenamed("id", "sample_id"), named)
        return fulltext.postings(docs, ["filename", "path", "tags"])

    def query_samples(self, f: QueryFilter) -> DataFrame:
        return filters.sample_ids(self._tables(f.text), f)

    def search_samples(self, text: str, limit: int) -> DataFrame:
        """Ranked search; without anything to search for, nothing is found."""
        query = fulltext.parse(text)
        if query is None:
            return self.spark.createDataFrame([], "doc_id long, rank double")
        return fulltext.ranked(self.postings(), query, self.store.read("samples").count(), limit)

    def point_cloud(self) -> DataFrame:
        return filters.active_points(*self._read("projection_runs", "projections")).orderBy("sample_id")

    def get_point_cloud(self) -> bytes:
        return audio.encode_points(self.point_cloud())

    def get_point_colors(self) -> bytes:
        return audio.encode_colors(self.point_cloud())

    def get_feature_column(self, feature: str) -> bytes:
        return audio.encode_column(filters.feature_column(self._tables(), feature), "value")

    def get_query_result(self, f: QueryFilter) -> bytes:
        return audio.encode_ids(self.query_samples(f))

    def get_sample_detail(self, sample_id: int) -> DataFrame:
        samples, features, roots, tags, tagged = self._read("samples", "sample_features", "library_roots", "tags", "sample_tags")
        return catalog.detail(samples, features, roots, tags, tagged, sample_id)

    def get_similar(self, sample_id: int, k: int = 20) -> DataFrame:
        """``id, similarity, filename`` of the nearest embedded samples."""
        samples, vector = self._read("samples", "vectors")
        catalog.require(samples, F.col("id") == sample_id, f"sample {sample_id}")
        data = catalog.embedded(samples).join(vector, "vector_id").select(F.col("sample_id").alias("id"), "v")
        names = samples.select("id", "filename")
        return vectors.similar(data, sample_id, k).join(names, "id").orderBy(F.desc("similarity"), "id")

    def get_peaks(self, sample_id: int, buckets: int = 1024) -> bytes:
        """Waveform summary of a file with the milliseconds that it covers."""
        row = self.get_sample_detail(sample_id).select("absolute_path", "ext").first()
        content = self.spark.read.format("binaryFile").load(row["absolute_path"]).select("content").first()["content"]
        x = audio.decode(bytes(content), row["ext"])[0]
        return audio.encode_peaks(audio.signal.peaks(x, buckets), round(len(x) * 1000 / audio.signal.SAMPLE_RATE))

    # -- tags

    def set_tag(self, sample_id: int, name: str) -> None:
        samples, tags, tagged = self._read("samples", "tags", "sample_tags")
        catalog.named(name, "tag")
        catalog.require(samples, F.col("id") == sample_id, f"sample {sample_id}")
        tags, tagged = catalog.set_tag(tags, tagged, sample_id, name)
        self.store.write({"tags": tags, "sample_tags": tagged})

    def unset_tag(self, sample_id: int, name: str) -> None:
        tags, tagged = self._read("tags", "sample_tags")
        self.store.write({"sample_tags": catalog.unset_tag(tags, tagged, sample_id, catalog.named(name, "tag"))})

    def list_tags(self) -> DataFrame:
        return catalog.tag_counts(*self._read("tags", "sample_tags"))

    def set_tag_color(self, tag_id: int, color: str | None) -> None:
        self.store.write({"tags": catalog.edit_tag(self.store.read("tags"), tag_id, color=color)})

    def rename_tag(self, tag_id: int, name: str) -> None:
        self.store.write({"tags": catalog.edit_tag(self.store.read("tags"), tag_id, name)})

    def delete_tag(self, tag_id: int) -> None:
        tags, tagged = catalog.delete_tag(*self._read("tags", "sample_tags"), tag_id)
        self.store.write({"tags": tags, "sample_tags": tagged})

    # -- collections

    def create_collection(self, name: str, sample_ids: list[int] | None = None) -> int:
        collections, members, new = catalog.create_collection(*self._read("collections", "collection_members"), name, sample_ids or [], self.clock())
        self.store.write({"collections": collections, "collection_members": members})
        return new

    def list_collections(self) -> DataFrame:
        return catalog.collection_counts(*self._read("collections", "collection_members"))

    def get_collection(self, collection_id: int) -> DataFrame:
        collections, members, samples = self._read("collections", "collection_members", "samples")
        catalog.require(collections, F.col("id") == collection_id, f"collection {collection_id}")
        return catalog.collection_members(members, samples, collection_id)

    def _members(self, collection_id: int, change: Callable[[DataFrame], DataFrame]) -> None:
        collections, members = self._read("collections", "collection_members")
        catalog.require(collections, F.col("id") == collection_id, f"collection {collection_id}")
        self.store.write({"collection_members": change(members)})

    def add_to_collection(self, collection_id: int, sample_ids: list[int]) -> None:
        self._members(collection_id, lambda m: catalog.append_members(m, collection_id, sample_ids))

    def remove_from_collection(self, collection_id: int, sample_id: int) -> None:
        self._members(collection_id, lambda m: catalog.remove_member(m, collection_id, sample_id))

    def reorder_collection(self, collection_id: int, sample_ids: list[int]) -> None:
        self._members(collection_id, lambda m: catalog.reorder(m, collection_id, sample_ids))

    def rename_collection(self, collection_id: int, name: str) -> None:
        self.store.write({"collections": catalog.rename_collection(self.store.read("collections"), collection_id, name)})

    def delete_collection(self, collection_id: int) -> None:
        collections, members = catalog.delete_collection(*self._read("collections", "collection_members"), collection_id)
        self.store.write({"collections": collections, "collection_members": members})

    def export_collection(self, collection_id: int, path: str) -> None:
        members, samples, roots = self._read("collection_members", "samples", "library_roots")
        audio.export_paths(members, samples, roots, collection_id, path)

    # -- layouts

    def start_refit(self, algorithm: str = "tsne", colours: bool = False, align: bool = True, force_full: bool = False) -> projection.Refit:
        known = {"tsne": projection.Tsne, "umap": projection.Umap, "pca": projection.Pca}
        fallback = None if algorithm == "pca" else projection.Pca()
        return self.jobs.run(
            "refit",
            lambda _, cancelled: projection.refit(self.store, known[algorithm](), self.clock(), fallback, colours, align, force_full, cancelled),
        )

    def cancel_refit(self, job: int) -> None:
        self.jobs.cancel("refit", job)

    # -- settings

    def get_settings(self) -> dict[str, float]:
        return {"gain": catalog.gain(self.store.read("app_settings"))}

    def set_gain(self, value: float) -> None:
        if not 0 <= value < float("inf"):
            raise catalog.Invalid("a gain is a finite number from 0")
        self.store.write({"app_settings": catalog.set_setting(self.store.read("app_settings"), "gain", str(value))})

    def reset_database(self) -> None:
        """Empty all tables; refused while a job runs."""
        if self.jobs.any_running():
            raise catalog.Busy("a job is running")
        self.store.write({t: self.spark.createDataFrame([], c) for t, c in TABLES.items()})
        self.store.prune()
