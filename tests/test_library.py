import numpy as np
import pytest

from tessera import schemas
from tessera.functions import table
from tessera.library import Library
from tessera.operators.filters import QueryFilter, Range
from tessera.sources import audio
from tests.test_ingest import sine, wav


def test_commands(spark, tmp_path):
    root = tmp_path / "sounds"
    root.mkdir()
    for i in range(6):
        (root / f"tone {i}.wav").write_bytes(wav(sine(200 + 150 * i, 0.3 + 0.1 * i)))
    lib = Library(spark, f"file://{tmp_path}/store", clock=lambda: 1000)
    assert lib.add_library_root(str(root)) == lib.add_library_root(str(root), "mine") == 1
    assert lib.scan_library()[0]["added"] == 6
    ids = [r[0] for r in lib.query_samples(QueryFilter()).collect()]
    assert len(ids) == 6
    assert lib.query_samples(QueryFilter(ranges=(Range("durationMs", 500),))).count() == 4
    lib.set_tag(ids[0], "Warm")
    lib.set_tag(ids[1], "warm")
    assert [(r["name"], r["n"]) for r in lib.list_tags().collect()] == [("Warm", 2)]
    assert [r[0] for r in lib.query_samples(QueryFilter(text="warm", tags=("WARM",))).collect()] == ids[:2]
    assert lib.search_samples("tone", 3).count() == 3 and lib.search_samples("-", 3).count() == 0
    lib.rename_tag(1, "Cold")
    lib.set_tag_color(1, "red")
    lib.unset_tag(ids[1], "COLD")
    assert lib.get_sample_detail(ids[0]).first()["tags"] == ["Cold"]
    with pytest.raises(schemas.NotFound):
        lib.set_tag(999, "x")
    with pytest.raises(schemas.Invalid):
        lib.set_tag(ids[0], "  ")
    c = lib.create_collection("set", [ids[2], ids[0]])
    lib.add_to_collection(c, [ids[1], ids[0]])
    lib.remove_from_collection(c, ids[0])
    lib.reorder_collection(c, [ids[1], ids[2]])
    lib.rename_collection(c, "best")
    assert [r["sample_id"] for r in lib.get_collection(c).collect()] == [ids[1], ids[2]]
    assert [(r["name"], r["n"]) for r in lib.list_collections().collect()] == [("best", 2)]
    lib.export_collection(c, str(tmp_path / "out.txt"))
    lines = (tmp_path / "out.txt").read_text().splitlines()
    assert len(lines) == 2 and all(x.startswith(str(root)) for x in lines)
    near = lib.get_similar(ids[0], 3).collect()
    assert len(near) == 3 and near[0]["similarity"] >= near[1]["similarity"] and near[0]["filename"]
    done = lib.start_refit("pca")
    assert done.placed == 6
    kind, n, _, body = audio.decode_frame(lib.get_point_cloud())
    assert (kind, n, body[:6].tolist()) == ("points", 6, ids)
    values = audio.decode_frame(lib.get_feature_column("spectralCentroid"))[3].view("<f4")
    assert np.all(np.diff(values) > 0)
    assert np.isnan(audio.decode_frame(lib.get_point_colors())[3].view("<f4")).all()
    assert audio.decode_frame(lib.get_query_result(QueryFilter(projected_only=True)))[1] == 6
    assert audio.decode_frame(lib.get_peaks(ids[0], 16))[:3] == ("peaks", 16, 300)
    lib.set_gain(0.5)
    assert lib.get_settings() == {"gain": 0.5}
    lib.delete_tag(1)
    lib.delete_collection(c)
    lib.set_root_enabled(1, False)
    assert lib.scan_library() == []
    lib.remove_library_root(1)
    assert lib.query_samples(QueryFilter()).count() == 0
    lib.reset_database()
    assert lib.list_library_roots().count() == 0


def test_token_function(spark):
    table.register(spark)
    spark.createDataFrame([(1, "A b-c"), (2, None)], "id long, text string").createOrReplaceTempView("texts")
    rows = spark.sql("select id, pos, token from texts, lateral tokens(text) order by pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
