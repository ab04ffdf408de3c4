"""Directory scan, decoding and export (inventory A1-A7, A13-A17, G27)."""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.plans.ship import ensure
from tessera.schemas import Overflow

# What a scan takes for audio.
EXTENSIONS = ["wav", "wave", "aif", "aiff", "aifc", "caf", "flac", "mp3", "m4a", "m4b", "mp4", "aac", "ogg", "oga", "mka", "webm"]
MIN_BYTES, MAX_BYTES = 44, 4 << 30
#: Longer files are hashed by size, head and tail.
WHOLE_BYTES, SPAN_BYTES = 64 << 20, 1 << 20


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel_path, filename, ext, size_bytes, mtime`` of all files below a folder (A1, A3).

    Names that begin with a dot are left out at every level; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.split_part(F.regexp_replace("path", "^file:/+", "/"), F.lit(base + "/"), F.lit(-1)), "^/+", "")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        rel.alias("rel_path"),
        name.alias("filename"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"),
        F.col("length").alias("size_bytes"),
        F.coalesce(F.unix_millis("modificationTime"), F.lit(0)).alias("mtime"),
    ).where(~F.col("rel_path").rlike(r"(^|/)\."))


def audio_only(files: DataFrame) -> DataFrame:
    """Entries of a known extension and a plausible size (A2)."""
    return files.where(F.col("ext").isin(EXTENSIONS) & F.col("size_bytes").between(MIN_BYTES, MAX_BYTES))


def changed(files: DataFrame, samples: DataFrame, done) -> DataFrame:
    """Entries that are new, changed or not finished (A4): ``done`` picks the finished rows."""
    stamps = samples.where(done).select("root_id", "rel_path", "mtime", "size_bytes")
    return files.join(stamps, ["root_id", "rel_path", "mtime", "size_bytes"], "left_anti")


def content_hash(content: bytes) -> bytes:
    """Digest of a file: of all of it, or of its size, head and tail where it is long."""
    if len(content) <= WHOLE_BYTES:
        return hashlib.sha256(content).digest()
    return hashlib.sha256(b"sampled" + struct.pack("<Q", len(content)) + content[:SPAN_BYTES] + content[-SPAN_BYTES:]).digest()


#: Spark reads no file beyond this into a row.
READABLE_BYTES = (1 << 31) - 1


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of the named files and no others; what can not be read is left out."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    read = spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    try:
        return read.load(paths).select("path", "content")
    except AnalysisException:  # a file is gone since it was listed
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        there = [p for p in paths if (where := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(where)]
        return contents(spark, there) if len(there) < len(paths) else read.load(paths).select("path", "content")


def hashes(files: DataFrame) -> DataFrame:
    """``rel_path, content`` -> ``rel_path, content_hash``, in the stage that reads the files."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rel_path": batch["rel_path"], "content_hash": [content_hash(bytes(c)) for c in batch["content"]]})

    ensure(files.sparkSession)
    return files.select("rel_path", "content").mapInPandas(work, "rel_path string, content_hash binary")


class DecodeError(ValueError):
    pass


def read_wav(content: bytes, max_seconds: float | None = None) -> tuple[np.ndarray, int, int, int]:
    """Mono signal, rate, channels and whole frames of a WAV file: PCM of 8 to 32 bits or
    float; channels are averaged; what is cut off at the end is left out (A5)."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise DecodeError("no WAV header")
    f = io.BytesIO(content[12:])
    kind = None
    while len(head := f.read(8)) == 8:
        tag, size = head[:4], struct.unpack("<I", head[4:])[0]
        if tag == b"fmt ":
            body = f.read(size + size % 2)
            if len(body) < 16:
                raise DecodeError("short format block")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
        elif tag == b"data":
            if kind is None or not channels or not rate:
                raise DecodeError("data without a format")
            data = f.read(size)
            width = bits // 8
            data = data[: len(data) // (width * channels) * (width * channels)]
            if kind == 3 and bits in (32, 64):
                x = np.frombuffer(data, f"<f{width}").astype(np.float64)
            elif kind == 1 and bits == 8:
                x = (np.frombuffer(data, "u1").astype(np.float64) - 128) / 128
            elif kind == 1 and bits in (16, 32):
                x = np.frombuffer(data, f"<i{width}").astype(np.float64) / (1 << (bits - 1))
            elif kind == 1 and bits == 24:
                raw = np.frombuffer(data, "u1").reshape(-1, 3).astype(np.int32)
                x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / (1 << 23)
            else:
                raise DecodeError(f"format {kind} of {bits} bits")
            x = x.reshape(-1, channels)
            frames = len(x)
            if max_seconds is not None:
                x = x[: int(max_seconds * rate)]
            return x.mean(axis=1).astype(np.float32), rate, channels, frames
        else:
            f.seek(size + size % 2, 1)
    raise DecodeError("no data")


def resample(x: np.ndarray, rate: int, to: int = signal.SAMPLE_RATE) -> np.ndarray:
    """Windowed-sinc resampling: 64 taps, Blackman-Harris, 128 phases, linear between phases."""
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    taps, phases = 64, 128
    cut = min(1.0, to / rate) * 0.95
    t = (np.arange(taps * phases + 1) / phases) - taps / 2
    a = 2 * np.pi * np.arange(len(t)) / (len(t) - 1)
    window = 0.35875 - 0.48829 * np.cos(a) + 0.14128 * np.cos(2 * a) - 0.01168 * np.cos(3 * a)
    table = np.sinc(t * cut) * cut * window**2
    n = int(np.ceil(len(x) * to / rate))
    place = np.arange(n) * rate / to
    whole = np.floor(place).astype(int)
    padded = np.pad(np.asarray(x, np.float64), taps)
    out = np.zeros(n)
    for k in range(taps):
        at = whole - taps // 2 + 1 + k
        phase = (at - place + taps / 2) * phases
        low = np.clip(np.floor(phase).astype(int), 0, len(table) - 2)
        weight = table[low] + (table[low + 1] - table[low]) * (phase - low)
        out += weight * padded[np.clip(at + taps, 0, len(padded) - 1)]
    return out.astype(np.float32)


def decode(content: bytes, ext: str, max_output: int = signal.MAX_SAMPLES) -> tuple[np.ndarray, int, int, int, bool]:
    """48 kHz mono signal of at most ``max_output`` values, duration in ms, rate, channels and
    whether the window cut it (A5, A6). Only WAV can be read here."""
    if ext not in ("wav", "wave"):
        raise DecodeError(f"no decoder for {ext}")
    seconds = max_output / signal.SAMPLE_RATE
    # A few more source frames, so that the filter sees past the window's end.
    x, rate, channels, frames = read_wav(content, seconds + 0.01)
    full = frames * signal.SAMPLE_RATE / rate
    return resample(x, rate)[:max_output], round(frames * 1000 / rate), rate, channels, full > max_output


ANALYZED = (
    "rel_path string, content_hash binary, duration_ms long, sample_rate long, channels long, status string, error string, raw array<double>, "
    + ", ".join(f"{n} {'int' if n in ('key_root', 'key_mode') else 'float'}" for n in signal.DESCRIPTORS)
)


def analyze(files: DataFrame) -> DataFrame:
    """Decode and describe ``rel_path, ext, content`` rows in one stage; a failure becomes a row
    with its error and stops nothing (J5, I14)."""

    def one(rel_path: str, ext: str, content: bytes) -> dict:
        row: dict = {"rel_path": rel_path, "content_hash": content_hash(content)}
        try:
            x, ms, rate, channels, cut = decode(content, ext)
            row |= {"duration_ms": ms, "sample_rate": rate, "channels": channels, "status": "decoded"}
            row |= vars(signal.describe(x))
            row["raw"] = signal.raw_vector(x, signal.log_mel(x), cut).tolist()
        except Exception as e:  # noqa: BLE001  any bad file is quarantined
            row |= {"status": "decode_failed", "error": f"{type(e).__name__}: {e}"}
        return row

    columns = [c.split(" ")[0] for c in ANALYZED.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(*r) for r in batch[["rel_path", "ext", "content"]].itertuples(index=False)]
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns, dtype=object)

    ensure(files.sparkSession)
    return files.select("rel_path", "ext", "content").mapInPandas(work, ANALYZED)


def peak_summary(content: bytes, ext: str, buckets: int = 1024) -> list[tuple[float, float]]:
    """Waveform summary of a file."""
    return signal.peaks(decode(content, ext)[0], buckets)


# -- column sinks (A13, A14) --------------------------------------------------------------

# Magic, version and header of each frame.
FRAMES = {"points": b"ABPC", "column": b"ABFC", "colors": b"ABPX", "ids": b"ABQS", "peaks": b"ABPK"}
VERSION = 1
HEADER = struct.Struct("<4sIII")


def narrow(ids) -> np.ndarray:
    """Ids as 32-bit numbers, or an error."""
    a = np.asarray(ids, np.int64)
    if len(a) and (a.min() < 0 or a.max() > 0xFFFFFFFF):
        raise Overflow("an id does not fit 32 bits")
    return a.astype("<u4")


def frame(kind: str, count: int, *columns: np.ndarray, reserved: int = 0) -> bytes:
    return HEADER.pack(FRAMES[kind], VERSION, count, reserved) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def encode_points(points: DataFrame) -> bytes:
    t = points.select("sample_id", "x", "y", "z").orderBy("sample_id").toArrow().to_pandas()
    return frame("points", len(t), narrow(t["sample_id"]), *(t[c].to_numpy("<f4") for c in "xyz"))


def encode_column(values: DataFrame, column: str) -> bytes:
    t = values.select("sample_id", F.col(column).cast("float").alias("v")).orderBy("sample_id").toArrow().to_pandas()
    return frame("column", len(t), t["v"].to_numpy("<f4", na_value=np.nan))


def encode_colors(points: DataFrame) -> bytes:
    t = points.select("sample_id", "r", "g", "b").orderBy("sample_id").toArrow().to_pandas()
    return frame("colors", len(t), *(t[c].to_numpy("<f4", na_value=np.nan) for c in "rgb"))


def encode_ids(ids: DataFrame) -> bytes:
    t = ids.select("sample_id").orderBy("sample_id").toArrow().to_pandas()
    return frame("ids", len(t), narrow(t["sample_id"]))


def encode_peaks(pairs: list[tuple[float, float]], covered_ms: int) -> bytes:
    return frame("peaks", len(pairs), np.array(pairs, "<f4"), reserved=covered_ms)


def decode_frame(data: bytes) -> tuple[str, int, int, np.ndarray]:
    """Kind, count, reserved word and body as 32-bit values."""
    if len(data) < HEADER.size:
        raise ValueError("short frame")
    magic, version, count, reserved = HEADER.unpack(data[: HEADER.size])
    kind = {v: k for k, v in FRAMES.items()}.get(magic)
    if kind is None or version != VERSION:
        raise ValueError("unknown frame")
    body = np.frombuffer(data, "<u4", offset=HEADER.size)
    if len(body) != count * {"points": 4, "column": 1, "colors": 3, "ids": 1, "peaks": 2}[kind]:
        raise ValueError("body does not match its count")
    return kind, count, reserved, body


def export_paths(members: DataFrame, samples: DataFrame, roots: DataFrame, collection_id: int, path: str) -> None:
    """The absolute paths of a collection, one a line, in its order."""
    rows = (
        members.where(F.col("collection_id") == collection_id)
        .join(samples.select(F.col("id").alias("sample_id"), "root_id", "rel_path"), "sample_id")
        .join(roots.select(F.col("id").alias("root_id"), "path"), "root_id")
        .orderBy("position")
        .select(F.concat_ws("/", "path", "rel_path").alias("line"))
    )
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(r["line"] + "\n" for r in rows.toLocalIterator())


def dump_features(features: DataFrame, path: str) -> None:
    """Raw descriptors as CSV."""
    features.write.mode("overwrite").option("header", True).csv(path)
