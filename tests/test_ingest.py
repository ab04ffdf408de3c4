import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import catalog, projection
from tessera.sources import audio
from tessera.streaming import ingest


def wav(x, rate=48000, channels=1, kind="pcm"):
    if kind == "pcm":
        body, fmt, bits = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes(), 1, 16
    else:
        body, fmt, bits = np.asarray(x, "<f4").tobytes(), 3, 32
    size = bits // 8 * channels
    head = struct.pack("<HHIIHH", fmt, channels, rate, rate * size, size, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def sine(hz, seconds, rate=48000):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def test_decode():
    x, ms, rate, channels, cut = audio.decode(wav(sine(440, 0.5)), "wav")
    assert (len(x), ms, rate, channels, cut) == (24000, 500, 48000, 1, False)
    stereo = np.repeat(sine(440, 2.0, 44100), 2)
    x, ms, rate, channels, cut = audio.decode(wav(stereo, 44100, 2, "float"), "wav")
    assert (len(x), ms, rate, channels) == (96000, 2000, 44100, 2)
    assert np.abs(x[2000:-2000] - sine(440, 2.0)[2000:-2000]).max() < 0.01
    head = audio.decode(wav(stereo, 44100, 2, "float"), "wav", 1000)[0]
    assert np.allclose(head, x[:1000], atol=1e-6)
    with pytest.raises(audio.DecodeError):
        audio.decode(b"nothing", "wav")


@pytest.fixture
def library(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "low").mkdir(parents=True)
    (root / "high").mkdir()
    (root / "low/thud.wav").write_bytes(wav(sine(60, 0.5)))
    (root / "low/copy.WAV").write_bytes(wav(sine(60, 0.5)))
    (root / "high/pair.wav").write_bytes(wav(np.repeat(sine(440, 1.0, 44100), 2), 44100, 2, "float"))
    (root / "high/bad.wav").write_bytes(b"x" * 100)
    (root / "high/notes.txt").write_text("no audio" * 20)
    (root / ".hidden.wav").write_bytes(wav(sine(60, 0.1)))
    store = catalog.Store(spark, f"file://{tmp_path}/store")
    roots, _ = catalog.add_root(store.read("library_roots"), str(root), None, 1)
    store.write({"library_roots": roots})
    return store, root


def test_scan(library):
    store, root = library
    first = ingest.scan_root(store, 1, 10)
    assert {k: first[k] for k in ("seen", "added", "skipped", "failed")} == {"seen": 4, "added": 3, "skipped": 0, "failed": 1}
    rows = {r["rel_path"]: r for r in store.read("samples").collect()}
    assert set(rows) == {"low/thud.wav", "low/copy.WAV", "high/pair.wav", "high/bad.wav"}
    assert rows["low/thud.wav"]["vector_id"] == rows["low/copy.WAV"]["vector_id"] is not None
    assert rows["high/bad.wav"]["status"] == "decode_failed" and "DecodeError" in rows["high/bad.wav"]["error"]
    assert rows["high/pair.wav"]["status"] == "embedded" and rows["high/pair.wav"]["duration_ms"] == 1000
    assert store.read("vectors").count() == 2 and store.read("sample_features").count() == 3
    again = ingest.scan_root(store, 1, 20)
    assert again["added"] == 0 and again["skipped"] == 3 and again["failed"] == 1
    (root / "low/thud.wav").write_bytes(wav(sine(90, 0.7)))
    changed = ingest.scan_root(store, 1, 30)
    assert changed["added"] == 1
    new = {r["rel_path"]: r for r in store.read("samples").collect()}
    assert new["low/thud.wav"]["id"] == rows["low/thud.wav"]["id"]
    assert new["low/thud.wav"]["vector_id"] not in (None, rows["low/thud.wav"]["vector_id"])
    with pytest.raises(schemas.NotFound):
        ingest.scan_root(store, 9, 1)
    assert [r["status"] for r in store.read("scan_runs").orderBy("id").collect()] == ["completed"] * 3


def test_scan_copies_twins_of_earlier_scans(library, monkeypatch):
    store, root = library
    ingest.scan_root(store, 1, 10)
    before = {r["rel_path"]: r for r in store.read("samples").collect()}
    (root / "again.wav").write_bytes((root / "high/pair.wav").read_bytes())
    read = []
    whole = audio.contents
    monkeypatch.setattr(audio, "contents", lambda spark, paths: read.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or whole(spark, paths))
    assert ingest.scan_root(store, 1, 20)["added"] == 1
    # Only the new file and the one that failed are read, and no known content is analysed again.
    assert read == [["again.wav", "bad.wav"], ["bad.wav"]]
    after = {r["rel_path"]: r for r in store.read("samples").collect()}
    for c in ("vector_id", "status", "duration_ms", "sample_rate", "channels", "content_hash"):
        assert after["again.wav"][c] == before["high/pair.wav"][c], c
    assert store.read("vectors").count() == 2
    blocks = {r["sample_id"]: r for r in store.read("sample_features").collect()}
    assert blocks[after["again.wav"]["id"]]["bpm"] == blocks[after["high/pair.wav"]["id"]]["bpm"]


def test_scan_keeps_what_it_finished_before_it_was_cancelled(library):
    store, _ = library
    asked = []

    def cancelled():
        asked.append(store.read("scan_runs").select("status").first()[0])
        return len(asked) > 1

    got = ingest.scan_root(store, 1, 10, cancelled=cancelled, batch=2)
    assert asked[0] == "running" and got["seen"] == 4 and got["added"] + got["failed"] == 2
    run = store.read("scan_runs").first()
    assert (run["status"], run["files_seen"], run["files_added"] + run["files_failed"]) == ("cancelled", 4, 2)
    assert store.read("samples").count() == 2
    rest = ingest.scan_root(store, 1, 20, batch=1)
    assert store.read("samples").count() == 4 and rest["failed"] == 1
    rows = {r["rel_path"]: r for r in store.read("samples").collect()}
    assert rows["low/thud.wav"]["vector_id"] == rows["low/copy.WAV"]["vector_id"] is not None


def test_files_that_can_not_be_read_are_rows(library, monkeypatch):
    store, root = library
    listed = audio.listed

    def vanishing(spark, folder):
        rows = listed(spark, folder).collect()
        (root / "low/thud.wav").unlink()
        return spark.createDataFrame(rows, listed(spark, folder).schema)

    monkeypatch.setattr(audio, "listed", vanishing)
    monkeypatch.setattr(audio, "READABLE_BYTES", 150_000)
    got = ingest.scan_root(store, 1, 10)
    rows = {r["rel_path"]: r for r in store.read("samples").collect()}
    assert got["failed"] == 3 and got["added"] == 1
    assert rows["low/thud.wav"]["error"] == rows["high/pair.wav"]["error"] == "the file can not be read"


def test_refit(spark, tmp_path):
    store = catalog.Store(spark, f"file://{tmp_path}/store")
    rng = np.random.default_rng(0)
    v = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    s = spark.range(61).select(F.col("id"), F.lit("embedded").alias("status"), F.least(F.col("id"), F.lit(59)).alias("vector_id"))
    full = spark.createDataFrame([], schemas.schema("samples")).unionByName(s, allowMissingColumns=True)
    store.write({"vectors": spark.createDataFrame(v, "vector_id long, v array<float>"), "samples": full})
    one = projection.refit(store, projection.Umap(neighbours=1), 5, fallback=projection.Pca())
    assert (one.outcome, one.algorithm, one.placed) == ("full", "pca", 61)
    pts = {r["sample_id"]: r for r in store.read("projections").collect()}
    assert len(pts) == 61 and pts[59]["x"] != pts[60]["x"] and abs(pts[59]["x"] - pts[60]["x"]) < 0.1
    assert projection.refit(store, projection.Pca(), 6).outcome == "up_to_date"
    two = projection.refit(store, projection.Pca(), 7, force_full=True)
    assert two.run_id == 2 and two.relative_displacement < 1e-3
    more = full.unionByName(spark.createDataFrame([(61, "embedded", 3)], "id long, status string, vector_id long"), allowMissingColumns=True)
    store.write({"samples": more})
    three = projection.refit(store, projection.Pca(), 8)
    assert three.outcome == "incremental" and store.read("projections").where("sample_id = 61").count() == 1

    class Broken:
        name = "broken"

        def fit_transform(self, data):
            raise RuntimeError("no")

        def params_json(self):
            return "{}"

    before = store.pointers()
    with pytest.raises(RuntimeError):
        projection.refit(store, Broken(), 9, force_full=True)
    assert store.pointers() == before


def test_frames(spark):
    pts = spark.createDataFrame([(7, 1.0, 2.0, 0.0), (3, 4.0, 5.0, 0.0)], "sample_id long, x double, y double, z double")
    kind, n, _, body = audio.decode_frame(audio.encode_points(pts))
    assert (kind, n, body[:2].tolist(), body[2:].view("<f4").tolist()) == ("points", 2, [3, 7], [4.0, 1.0, 5.0, 2.0, 0.0, 0.0])
    col = spark.createDataFrame([(7, None), (3, 2.5)], "sample_id long, v double")
    values = audio.decode_frame(audio.encode_column(col, "v"))[3].view("<f4")
    assert values[0] == 2.5 and np.isnan(values[1])
    with pytest.raises(schemas.Overflow):
        audio.encode_ids(spark.createDataFrame([(1 << 33,)], "sample_id long"))
    with pytest.raises(ValueError):
        audio.decode_frame(b"nope" + bytes(12))


def test_streams(spark, tmp_path):
    rows = spark.sql("select id, timestamp_millis(id * 1000) as ts, id % 3 as k, concat('h', id % 4) as hash from range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    out = []
    stream = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
    ingest.persist_batches(ingest.first_of_content(stream, "hash", "ts", "1 hour"), lambda df, i: out.extend(df.collect()), str(tmp_path / "c1")).awaitTermination(120)
    assert len(out) == 4
    got = []
    bursts = ingest.debounced(ingest.file_stream(spark, str(tmp_path / "in"), rows.schema), "ts", "k", "2 seconds", "id", "1 second")
    ingest.persist_batches(bursts, lambda df, i: got.extend(df.collect()), str(tmp_path / "c2")).awaitTermination(120)
    assert {r["n"] for r in got} == {1}
    assert ingest.progress(rows.where("id < 5").withColumn("k", F.lit(1)), "ts", "k", "hash", "2 seconds").count() == 4


def test_jobs(spark):
    jobs = ingest.Jobs(spark)

    def work(job, cancelled):
        with pytest.raises(schemas.Busy):
            jobs.run("scan", lambda *_: None)
        with pytest.raises(schemas.NotFound):
            jobs.cancel("scan", job + 1)
        jobs.cancel("scan", job)
        return cancelled()

    assert jobs.run("scan", work) is True
    assert not jobs.any_running()
