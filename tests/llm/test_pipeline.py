import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, quality, simhash
from tessera.llm.queries import ORACLES, QUERIES
from tessera.plans.scratch import staged

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names, name
        out.write.parquet(f"{tmp_path}/{i}")
        before = spark.read.parquet(f"{tmp_path}/{i}")
    good = {r[0] for r in quality.judged(docs).where("kept").select("doc_id").collect()}
    found = [r["doc_id"] for r in before.select("doc_id").collect()]
    assert set(found) <= good and len(found) > 100
    assert "ids" in before.columns


def brute_kept(rows):
    """The smallest id of each group of near duplicates, by comparing all pairs."""
    texts = {i: (t or "").encode() for i, t in rows}
    codes = {i: simhash.fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingles = {}
    for i, t in texts.items():
        w = t.lower().split()
        shingles[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(shingles[i] & shingles[j])
            if (codes[i] ^ codes[j]).bit_count() <= 2 or both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {root(i) for i in ids}


def test_near_duplicate_stage_by_brute_force(spark):
    """On the table itself and on what the stages before leave of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = line_dedup.deduplicated(quality.keep_good(docs))
    for table in (docs, left):
        table = table.persist()
        got = {r["doc_id"] for r in simhash.one_of_each(table).select("doc_id").collect()}
        assert got == brute_kept([(r[0], r[1]) for r in table.select("doc_id", "text").collect()])


def test_stages_take_awkward_rows(spark):
    """Null, empty and repeated rows, clashing names and an empty table go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(30).unionByName(docs.limit(5))
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (7, None, "en", "src1", None)], docs.schema)
    odd = more.unionByName(nulls).select("*", F.lit(1).alias("T"), F.lit(2).alias("fp"), F.lit("x").alias("place"), F.lit(3).alias("rid"), F.lit(4).alias("k1"))
    for table in (odd, odd.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            names = table.columns
            table = staged(stage(spark, table, SF), "awkward")
            if i + 1 < len(corpus_pipeline.STAGES):
                assert table.columns == names, name
        found = table.count()
    assert found == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_oracles(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    assert sorted(map(str, got[key].astype(object).values.tolist())) == sorted(map(str, want[key].astype(object).where(want[key].notna(), None).values.tolist()))
