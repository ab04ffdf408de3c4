import re
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, mixing, simhash
from tessera.llm.frame import map_batches


def _scattered(batches):
    """Frees 80 MB in blocks, a few of which stay, so that the C heap can't shrink by itself."""
    for batch in batches:
        blocks = [bytearray(8000) for _ in range(10_000)]
        sys.modules["tessera"].stay = blocks[::100]
        del blocks
        yield batch


def _held(batches):
    with open("/proc/self/smaps_rollup") as f:
        mb = int(re.search(r"Private_Dirty:\s+(\d+)", f.read())[1]) // 1024
    sys.modules["tessera"].stay = None
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([mb] * batch.num_rows, pa.int64())], ["id"])


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_idle_workers_hold_no_freed_memory(spark):
    rows = spark.range(0, 8, 1, 8)
    before = max(r["id"] for r in map_batches(rows, _held, "id long").collect())
    assert map_batches(rows, _scattered, "id long").count() == 8
    after = max(r["id"] for r in map_batches(rows, _held, "id long").collect())
    assert after < before + 40


def test_small_tables_start_no_python_worker(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 5, None if i % 3 else "a") for i in range(20)], "doc_id long, text string, source string").localCheckpoint()
    plan = mixing.mixed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and plan.count("LogicalRDD") == 0
    codes = spark.range(50).select(F.xxhash64("id").alias("fp"))
    factored = simhash._factor(*simhash._first_node(codes, 2), 2)[0]
    assert "LogicalRDD" not in factored._jdf.queryExecution().optimizedPlan().toString()


def test_local_tables(spark):
    from tessera.llm.frame import local

    rows = [(1, None, 0.5, True), (-(1 << 62), "é", None, None)]
    kind = "a long, b string, c double, d boolean"
    got = local(spark, rows, kind)
    assert got.schema == spark.createDataFrame(rows, kind).schema and sorted(map(tuple, got.collect()))[::-1] == rows
    assert local(spark, [], kind).count() == 0


def test_a_group_of_pairs_gives_links_only():
    """60 texts of one row, alike in two groups: links that join each, not the pairs."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:100] if k % 2 else words[100:]) + f" x{k} y{k}" for k in range(60)]
    rows = [(7, k, k + 1000, 98, b"\0" * 96, t.encode()) for k, t in enumerate(texts)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], list("abcdef")) for part in (rows[:25], rows[25:])]
    for size in (1, 1 << 23):
        found = [(a, b) for out in simhash._crossing(5, 0.8, 58, size=size)(iter(batches)) for a, b in zip(*out.to_pydict().values(), strict=True)]
        assert len(found) == 58 and all((a - b) % 2 == 0 for a, b in found)
        assert {x for pair in found for x in pair} == set(range(1000, 1060))


def test_classes_of_units_start_no_python_worker(spark):
    texts = spark.range(40).select(F.concat(F.lit("a b c d w"), F.col("id").cast("string")).cast("binary").alias("text"))
    trained = lm.train(texts, head=5, tails=4, classes=3, known=5)
    assert "LogicalRDD" not in trained.words._jdf.queryExecution().analyzed().toString()
    assert trained.words.count() == 4 + 40 + 1


def test_neighbours_hold_small_numbers():
    """What a worker holds for its events: 4 bytes for each, where it took 8."""
    seeds = type("Shared", (), {"value": lm.Seeds([lm.END, b"a"], 4, np.arange(6) % 3)})
    batch = pa.RecordBatch.from_arrays([pa.array([b" ".join(b"a" if k % 2 else b"w%d" % (k % 1000) for k in range(400_000))])], ["text"])
    list(lm._neighbours(seeds, 3)(iter([batch])))
    tracemalloc.start()
    out = list(lm._neighbours(seeds, 3)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b) for b in out) == 500 and most < 20_000_000
