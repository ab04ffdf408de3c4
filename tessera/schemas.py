"""Tables, enumerations and typed errors of the catalogue (inventory 1.2-1.4)."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 9


class CatalogError(Exception):
    """Base of the errors that an operator raises before it runs anything."""


class FilterTooLarge(CatalogError):
    """More values in one list of a filter than it may hold."""


class NotFound(CatalogError):
    """An id that an operator was given is not in its table."""


class Invalid(CatalogError):
    """A blank name, an unknown column, or members that do not match."""


class TooFewSamples(CatalogError):
    """A layout needs more vectors than there are."""


class RaggedDimensions(CatalogError):
    """Vectors of one layout differ in length."""


class Degenerate(CatalogError):
    """The vectors do not vary, so there is no axis."""


class Busy(CatalogError):
    """A job of this kind is running already."""


class Overflow(CatalogError):
    """An id does not fit the format."""


class SampleStatus(StrEnum):
    PENDING = "pending"
    DECODED = "decoded"
    EMBEDDED = "embedded"
    DECODE_FAILED = "decode_failed"
    MISSING = "missing"


class ScanStatus(StrEnum):
    RUNNING = "running"
    COMPLETED = "completed"
    CANCELLED = "cancelled"
    FAILED = "failed"


#: Filter and column names -> table and column; the only way from a name to a column.
FEATURES: dict[str, tuple[str, str]] = {
    "peakDb": ("features", "peak_db"),
    "rmsDb": ("features", "rms_db"),
    "lufsIntegrated": ("features", "lufs_integrated"),
    "spectralCentroid": ("features", "spectral_centroid"),
    "spectralFlatness": ("features", "spectral_flatness"),
    "zeroCrossing": ("features", "zero_crossing"),
    "onsetDensity": ("features", "onset_density"),
    "bpm": ("features", "bpm"),
    "bpmConfidence": ("features", "bpm_confidence"),
    "keyRoot": ("features", "key_root"),
    "keyMode": ("features", "key_mode"),
    "keyConfidence": ("features", "key_confidence"),
    "durationMs": ("samples", "duration_ms"),
}

TABLES: dict[str, str] = {
    "library_roots": "id long, path string, label string, enabled boolean, added_at long, last_scan_id long",
    "samples": "id long, root_id long, rel_path string, filename string, ext string, size_bytes long, mtime long, content_hash binary, "
    "duration_ms long, sample_rate long, channels long, status string, error string, vector_id long, first_seen_at long, updated_at long",
    "vectors": "vector_id long, v array<float>",
    "sample_features": "sample_id long, peak_db float, rms_db float, lufs_integrated float, spectral_centroid float, spectral_flatness float, "
    "zero_crossing float, onset_density float, bpm float, bpm_confidence float, key_root int, key_mode int, key_confidence float",
    "projection_runs": "id long, algorithm string, params_json string, sample_count long, created_at long, completed_at long, is_active boolean",
    "projections": "run_id long, sample_id long, x float, y float, z float, r float, g float, b float",
    "tags": "id long, name string, color string",
    "sample_tags": "sample_id long, tag_id long",
    "collections": "id long, name string, created_at long",
    "collection_members": "collection_id long, sample_id long, position long",
    "scan_runs": "id long, root_id long, started_at long, finished_at long, files_seen long, files_added long, files_skipped long, "
    "files_failed long, status string, error string",
    "app_settings": "key string, value string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def parse_status(column):
    """A status that is none of ours reads as pending."""
    known = [s.value for s in SampleStatus]
    return F.when(column.isin(known), column).otherwise(F.lit(SampleStatus.PENDING.value))


def complete(status, embedding_required: bool):
    """Whether a sample needs no more work."""
    done = [SampleStatus.EMBEDDED.value] if embedding_required else [SampleStatus.DECODED.value, SampleStatus.EMBEDDED.value]
    return status.isin(done)


def reembed(samples: DataFrame) -> DataFrame:
    """Data migration after a change of embedder: embedded rows go back to decoded (1.4)."""
    embedded = F.col("status") == SampleStatus.EMBEDDED.value
    return samples.withColumn("vector_id", F.when(~embedded, F.col("vector_id"))).withColumn(
        "status", F.when(embedded, SampleStatus.DECODED.value).otherwise(F.col("status"))
    )


def keep_newest_active(runs: DataFrame) -> DataFrame:
    """Data migration: of several active runs only the newest stays active."""
    newest = runs.where("is_active").agg(F.max(F.struct("created_at", "id")).alias("m")).select(F.col("m.id").alias("newest"))
    return runs.crossJoin(F.broadcast(newest)).withColumn("is_active", F.coalesce(F.col("id") == F.col("newest"), F.lit(False))).drop("newest")
