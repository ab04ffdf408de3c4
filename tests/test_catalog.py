import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import catalog, columns, filters, projection, vectors
from tessera.operators.filters import QueryFilter, Range, Tables


def table(spark, name, rows):
    return spark.createDataFrame(rows, schemas.schema(name))


def sample(i, **kw):
    base = dict(id=i, root_id=1, rel_path=f"d/{i}.wav", filename=f"{i}.wav", ext="wav", size_bytes=1024, mtime=5, content_hash=None, duration_ms=1500,
                sample_rate=48000, channels=2, status="pending", error=None, vector_id=None, first_seen_at=1, updated_at=1)
    return tuple((base | kw).values())


def test_upsert_clears_vector_and_keeps_what_is_not_known(spark):
    old = table(spark, "samples", [sample(7, status="embedded", vector_id=3, content_hash=b"a", error="x"), sample(8, status="embedded", vector_id=4)])
    new = spark.createDataFrame(
        [(1, "d/7.wav", "7.wav", "wav", 2048, 9, None, None, "decoded"), (1, "d/9.wav", "9.wav", "wav", 1, 9, b"c", 5, "decoded")],
        "root_id long, rel_path string, filename string, ext string, size_bytes long, mtime long, content_hash binary, duration_ms long, status string",
    )
    got = {r["id"]: r for r in catalog.upsert_samples(old, new, 100).collect()}
    assert set(got) == {7, 8, 9}
    assert got[7]["vector_id"] is None and got[7]["error"] is None and bytes(got[7]["content_hash"]) == b"a" and got[7]["duration_ms"] == 1500
    assert got[7]["size_bytes"] == 2048 and got[7]["first_seen_at"] == 1 and got[7]["updated_at"] == 100
    assert got[8]["vector_id"] == 4 and got[8]["updated_at"] == 1
    assert got[9]["first_seen_at"] == 100


def test_filters(spark):
    s = table(spark, "samples", [sample(1), sample(2, ext="aif", root_id=2), sample(3, duration_ms=None)])
    f = spark.createDataFrame([(1, 120.0), (2, None), (3, 90.0)], "sample_id long, bpm double")
    tags = table(spark, "tags", [(1, "Oak", None), (2, "Deep", None)])
    tagged = table(spark, "sample_tags", [(1, 1), (1, 2), (3, 1)])
    t = Tables(s, f, tagged, tags)

    def ids(q):
        return [r[0] for r in filters.sample_ids(t, q).collect()]

    assert ids(QueryFilter()) == [1, 2, 3]
    assert ids(QueryFilter(ranges=(Range("bpm", 60, 200),))) == [1, 3]
    assert ids(QueryFilter(ranges=(Range("bpm", 60, 200), Range("bpm", 100)))) == [1]
    assert ids(QueryFilter(ranges=(Range("durationMs", 0),))) == [1, 2]
    assert ids(QueryFilter(tags=("oak",))) == [1, 3]
    assert ids(QueryFilter(tags=("oak", "OAK", "deep"))) == [1]
    assert ids(QueryFilter(exts=(" .AIF ",))) == [2]
    assert ids(QueryFilter(limit=2)) == [1, 2]
    assert ids(QueryFilter(text="--- ...")) == [1, 2, 3]
    with pytest.raises(schemas.FilterTooLarge):
        filters.sample_ids(t, QueryFilter(root_ids=tuple(range(513))))
    with pytest.raises(schemas.Invalid):
        filters.sample_ids(t, QueryFilter(ranges=(Range("drop table"),)))


def test_tags(spark):
    tags, tagged = table(spark, "tags", []), table(spark, "sample_tags", [])
    tags, tagged = catalog.set_tag(tags, tagged, 1, " Oak ")
    tags, tagged = catalog.set_tag(tags, tagged, 2, "oak")
    tags, tagged = catalog.set_tag(tags, tagged, 2, "   ")
    assert [(r["name"]) for r in tags.collect()] == ["Oak"]
    assert sorted((r[0], r[1]) for r in tagged.collect()) == [(1, 1), (2, 1)]
    tagged = catalog.unset_tag(tags, tagged, 1, "OAK")
    assert [tuple(r) for r in tagged.collect()] == [(2, 1)]
    assert [(r["name"], r["n"]) for r in catalog.tag_counts(tags, tagged.limit(0)).collect()] == [("Oak", 0)]


def test_collections(spark):
    c, m = table(spark, "collections", []), table(spark, "collection_members", [])
    c, m, i = catalog.create_collection(c, m, " Set ", [5, 6, 5, 7], 1)
    def order(m):
        return [r["sample_id"] for r in m.where(F.col("collection_id") == i).orderBy("position").collect()]
    assert order(m) == [5, 6, 7]
    m = catalog.append_members(m, i, [6, 9, 8])
    assert order(m) == [5, 6, 7, 9, 8]
    m = catalog.remove_member(m, i, 6)
    assert order(m) == [5, 7, 9, 8] and [r[0] for r in m.select("position").orderBy("position").collect()] == [0, 1, 2, 3]
    m = catalog.reorder(m, i, [8, 9, 7, 5])
    assert order(m) == [8, 9, 7, 5]
    with pytest.raises(schemas.Invalid):
        catalog.reorder(m, i, [8, 9])
    with pytest.raises(schemas.Invalid):
        catalog.create_collection(c, m, "  ", [], 1)


def test_runs(spark):
    runs = table(spark, "projection_runs", [(1, "pca", "{}", 3, 1, 1, True), (2, "pca", "{}", 3, 2, None, False)])
    pts = spark.createDataFrame([(1, 1, 0.0), (2, 1, 1.0), (3, 1, 2.0)], "run_id long, sample_id long, x double")
    runs, three = catalog.begin_run(runs, "tsne", {}, 3, 5)
    runs, pts = catalog.activate(runs, pts, three, 9)
    got = {r["id"]: r for r in runs.collect()}
    assert set(got) == {2, 3} and got[3]["is_active"] and got[3]["completed_at"] == 9
    assert sorted(r["run_id"] for r in pts.collect()) == [2, 3]
    runs, pts = catalog.discard(runs, pts, 3)
    assert 3 in {r["id"] for r in runs.collect()}
    runs, pts = catalog.discard(runs, pts, 2)
    assert {r["id"] for r in runs.collect()} == {3}


def test_store_and_roots(spark, tmp_path):
    store = catalog.Store(spark, f"file://{tmp_path}/lib")
    assert store.read("tags").count() == 0
    roots, i = catalog.add_root(store.read("library_roots"), "/a", None, 1)
    roots, same = catalog.add_root(roots, "/a", "lab", 2)
    assert i == same
    store.write({"library_roots": roots, "samples": table(spark, "samples", [sample(1, root_id=i), sample(2, root_id=99)])})
    tables = {t: store.read(t) for t in ("library_roots", "samples", "sample_tags")}
    store.write(catalog.remove_root(tables, i))
    store.prune()
    assert [r["id"] for r in store.read("samples").collect()] == [2]
    assert store.pointers()["samples"] == 2
    settings = catalog.set_setting(store.read("app_settings"), "gain", "-3")
    assert catalog.gain(settings) == 1.0
    assert catalog.gain(catalog.set_setting(settings, "gain", "0.5")) == 0.5


def test_domain_and_colours(spark):
    flat = spark.createDataFrame([(1.0,), (1.0,), (None,), (float("nan"),)], "v double")
    assert tuple(columns.domain(flat, "v").first()) == (1.0, 1.0)
    assert tuple(columns.domain(flat.limit(0), "v").first()) == (0.0, 1.0)
    rgb = columns.coloured(flat, "v", columns.domain(flat, "v"), "binary").collect()
    assert rgb[0]["r"] == pytest.approx((0.36 + 0.95) / 2) and rgb[2]["r"] == 0.3 and rgb[3]["g"] == 0.32
    ramp = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert tuple(columns.domain(ramp, "v").first()) == (2.0, 98.0)


def test_zero_vector_and_placement(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0])], "id long, v array<double>")
    got = [(r["id"], r["similarity"]) for r in vectors.similar(v, 1, 10).collect()]
    assert got == [(4, 1.0), (2, 0.0), (3, 0.0)]
    anchors = v.where("id in (1, 3)").withColumns({"x": F.col("v")[0] * 10, "y": F.lit(0.0)})
    placed = vectors.place(v.where("id = 4"), anchors).first()
    assert 0 < placed["x"] < 10 and placed["z"] == 0
    assert vectors.place(v, anchors.limit(1)).count() == 0


def test_pca_and_procrustes(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 5)) * [9, 3, 1, 0.5, 0.1]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([[r["x"], r["y"]] for r in projection.Pca().fit_transform(v).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    w, e = np.linalg.eigh(np.cov(c.T))
    for k in range(2):
        axis = e[:, -1 - k] * np.sign(e[np.abs(e[:, -1 - k]).argmax(), -1 - k])
        assert np.allclose(got[:, k], c @ axis)
    with pytest.raises(schemas.TooFewSamples):
        projection.Pca().fit_transform(v.limit(3))
    with pytest.raises(schemas.Degenerate):
        projection.Pca().fit_transform(v.withColumn("v", F.array(F.lit(1.0), F.lit(2.0))))
    a, s = 0.7, 2.0
    old = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(got)], "id long, x double, y double")
    turned = old.select("id", (s * (F.col("x") * math.cos(a) - F.col("y") * math.sin(a)) + 3).alias("x"), (-s * (F.col("x") * math.sin(a) + F.col("y") * math.cos(a)) - 1).alias("y"))
    fit = projection.procrustes(turned, old)
    assert fit.reflected and fit.scale == pytest.approx(1 / s)
    back = fit.apply(turned).orderBy("id").collect()
    assert np.allclose([[r["x"], r["y"]] for r in back], got)
    assert projection.procrustes(turned.limit(3), old).scale == 1.0
    assert projection.plan(100, 99) == ("incremental", 1) and projection.plan(100, 90) == ("full", 10) and projection.plan(5, 9) == ("up_to_date", 0)


def test_layouts_keep_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(15, 8)) * 0.2 + c for c in np.eye(8)[:3] * 4])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for p in (projection.Tsne(epochs=300), projection.Umap(neighbours=44, epochs=100)):
        rows = p.fit_transform(v).orderBy("id").collect()
        y = np.array([[r["x"], r["y"]] for r in rows])
        assert np.isfinite(y).all() and all(r["z"] == 0 for r in rows)
    with pytest.raises(schemas.TooFewSamples):
        projection.Umap().fit_transform(v.limit(10))
    with pytest.raises(schemas.Degenerate):
        projection.Umap(neighbours=5).fit_transform(v)


def test_nearest_in_units(spark, monkeypatch):
    """More queries than are sent at once go through units, with the same result."""
    from tessera.functions import scalar
    from tessera.operators import vectors

    rng = __import__("numpy").random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=4).round(3).tolist()) for i in range(120)], "id long, v array<double>").persist()
    for metric in ("cosine", "euclid"):
        whole = sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.nearest(v, v, 3, metric).collect())
        with monkeypatch.context() as m:
            m.setattr(vectors, "BLOCK", 25)
            m.setattr(vectors, "ROWS", 50)
            assert sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.nearest(v, v, 3, metric).collect()) == whole
            if metric == "cosine":
                pairs = vectors.ranked_pairs(v, v, 3, scalar.cosine(F.col("q"), F.col("x"))).collect()
                assert sorted((r["query_id"], r["rank"], r["id"]) for r in pairs) == whole


def test_a_taken_tag_name_is_refused(spark):
    tags = spark.createDataFrame([(1, "Oak", None), (2, "pine", None)], "id long, name string, color string")
    with pytest.raises(schemas.Invalid):
        catalog.edit_tag(tags, 2, "OAK")
    assert {r["name"] for r in catalog.edit_tag(tags, 1, "OAK").collect()} == {"OAK", "pine"}


def unit_rows(n, dim, seed):
    x = __import__("numpy").random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    return [r.tolist() for r in x / (x * x).sum(axis=1, keepdims=True) ** 0.5]


def test_copies_of_a_vector_go_by_id(spark):
    """Copies tie wherever they lie, are at distance 0, and a query's copies count as others."""
    from tessera.operators import vectors

    base = unit_rows(40, 64, 3)
    v = spark.createDataFrame([(i, base[i % 40]) for i in range(2000)], "id long, v array<float>").repartition(7)
    for metric, best in (("euclid", 0.0), ("cosine", 1.0)):
        got = vectors.nearest(v.where("id % 100 = 3"), v, 6, metric).collect()
        assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {
            (q, n, i) for q in range(3, 2000, 100) for n, i in enumerate([i for i in range(q % 40, 2000, 40) if i != q][:6], 1)
        }
        assert all(abs(r["score"] - best) < (1e-12 if metric == "cosine" else 1e-300) for r in got)


def test_placement_beside_a_copy(spark, tmp_path):
    """A newcomer that equals one anchor keeps that anchor's full weight: distances come from differences."""
    import duckdb

    from tessera.queries import ORACLES, QUERIES

    base = unit_rows(2000, 64, 5)
    spark.createDataFrame([(i, base[i % 2000]) for i in range(6003)], "vec_id long, embedding array<float>").selectExpr("vec_id + vec_id div 2000 * 3 as vec_id", "embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("barycentre_placement", "euclid_topk_partitioned", "cosine_topk", "hit_rate_at_k"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(ORACLES[name]).fetchall()), name


def test_hit_rate_is_over_all_rows(spark, tmp_path, monkeypatch):
    """Each row asks for its neighbours, in one block and in units; two near rows whose ids 20 does not divide count."""
    import duckdb
    import numpy as np

    from tessera.operators import vectors
    from tessera.queries import ORACLES, QUERIES

    rows = unit_rows(300, 16, 11)
    rows[7] = rows[8]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.array(rows, dtype="float32").astype(float)
    own = 9 * np.eye(len(x))
    alike = (own - x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)).argsort(axis=1, kind="stable")[:, :15]
    close = (own + ((x[:, None, :2] - x[None, :, :2]) ** 2).sum(axis=2)).argsort(axis=1, kind="stable")[:, :5]
    want = round(float(np.mean([j in alike[i] for i in range(len(x)) for j in close[i]])), 6)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert db.execute(ORACLES["hit_rate_at_k"]).fetchall() == [(want,)]
    assert QUERIES["hit_rate_at_k"](spark, str(tmp_path)).collect() == [(want,)]
    monkeypatch.setattr(vectors, "BLOCK", 12)
    monkeypatch.setattr(vectors, "ROWS", 50)
    assert QUERIES["hit_rate_at_k"](spark, str(tmp_path)).collect() == [(want,)]


def test_vectors_that_are_null_or_not_numbers(spark):
    from tessera.operators import vectors

    nan = float("nan")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [nan, 1.0]), (3, None), (4, [1.0, 1.0])], "id long, v array<double>")
    order = {m: [r["id"] for r in sorted(vectors.nearest(v.where("id = 0"), v, 9, m).collect(), key=lambda r: r["rank"])] for m in ("cosine", "euclid")}
    assert order == {"cosine": [2, 4, 1], "euclid": [1, 4, 2]}


def test_units_meet_in_one_partition(spark, monkeypatch):
    """Without partitions being joined up behind the shuffle, each unit still gets its queries and its vectors."""
    from tessera.operators import vectors

    rows = unit_rows(400, 16, 7)
    v = spark.createDataFrame(list(enumerate(rows)), "id long, v array<float>").persist()
    x = __import__("numpy").array(rows, dtype="float32").astype(float)
    monkeypatch.setattr(vectors, "BLOCK", 12)
    monkeypatch.setattr(vectors, "ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for metric in ("cosine", "euclid"):
            got = sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.nearest(v.where("id % 4 = 0"), v, 3, metric).collect())
            far = 1 - x @ x.T + 9 * __import__("numpy").eye(400)
            assert got == [(q, n, int(i)) for q in range(0, 400, 4) for n, i in enumerate(far[q].argsort()[:3], 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
