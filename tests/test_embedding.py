from tessera.operators import embedding


class Halves:
    width = 2

    def embed(self, inputs):
        assert len(inputs) <= 3
        if any(x[0] < 0 for x in inputs):
            raise RuntimeError("negative")
        return [x[:2] / 2 for x in inputs]


def test_batches_and_failures(spark):
    rows = [(i, [float(i), 1.0, 5.0]) for i in range(8)] + [(8, None), (9, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, input array<double>").coalesce(1)
    got = {r["id"]: (r["v"], r["error"]) for r in embedding.embedded(df, Halves(), batch=3).collect()}
    assert all(got[i] == ([i / 2, 0.5], None) for i in range(6))
    # 6, 7 and 9 are one batch; the row without an input is in none.
    assert got[8] == (None, None) and all(got[i] == (None, "RuntimeError: negative") for i in (6, 7, 9))


def test_wrong_width_is_an_error(spark):
    class Wide(Halves):
        width = 3

    got = embedding.embedded(spark.createDataFrame([(1, [1.0, 2.0])], "id long, input array<double>"), Wide()).first()
    assert got["v"] is None and "width 3" in got["error"]
    assert embedding.embedded(spark.createDataFrame([], "id long, input array<double>"), Halves()).count() == 0
