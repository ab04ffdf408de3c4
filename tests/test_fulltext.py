import sqlite3

import pytest

from tessera.operators import fulltext

REWRITES = [
    ("oa", '"oa"*'),
    ("oak pine", '"oak" "pine"*'),
    ("@north.star", '"north" "star"*'),
    ("tower.wav", '"tower" "wav"*'),
    ("Pine - Tower", '"Pine" "Tower"*'),
    ("42 NOT pine", '"42" NOT "pine"*'),
    ("oak and pine", '"oak" "and" "pine"*'),
    ("oak NOT", '"oak"*'),
    ("NOT oak", '"oak"*'),
    ("oak AND OR pine", '"oak" AND "pine"*'),
    ("NOT", None),
    ('"oak"', '"oak"'),
    ('"deep oak"', '"deep oak"'),
    ('"deep oak', '"deep oak"'),
    ('"deep oak"*', '"deep oak"*'),
    ("oa* pine", '"oa"* "pine"*'),
    ("", None),
    ("--- ... @", None),
]


@pytest.mark.parametrize(("typed", "want"), REWRITES)
def test_rewrites(typed, want):
    assert fulltext.rewritten(typed) == want


def test_nothing_typed_is_an_error():
    for typed in ["(oak", "oak)", '"unclosed', "* ", "^oak", "oak:pine", "a OR OR b", "---", "\"\"*", "* * *", "NOT NOT"]:
        fulltext.rewritten(typed)
        fulltext.parse(typed)


DOCS = [
    (1, "@north.star Pine - Tower.wav", "OLD GREEN WOOD SET/Pines/@north.star Pine - Tower.wav", ""),
    (2, "@north.star Oak - Ridge.wav", "OLD GREEN WOOD SET/Oaks/@north.star Oak - Ridge.wav", "deep oak"),
    (3, "café crème", "Über/ångström", "oak deep"),
    (4, "", "", ""),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, path string, tags string")
    return fulltext.postings(docs, ["filename", "path", "tags"]).persist()


@pytest.mark.parametrize("typed", ["oaks", "pines", "green", "@north.star Pine - Tower.wav", "oak NOT pine", '"deep oak"', "cafe", "angstrom uber", "oak OR tower", "oak NOT deep OR pine", "star NOT oak tower", "deep AND oak"])
def test_matches_and_ranks_like_sqlite(index, typed):
    db = sqlite3.connect(":memory:")
    db.execute('create virtual table t using fts5(filename, path, tags, tokenize = "unicode61 remove_diacritics 2")')
    for i, *fields in DOCS:
        db.execute("insert into t (rowid, filename, path, tags) values (?, ?, ?, ?)", (i, *fields))
    match = fulltext.rewritten(typed)
    want = dict(db.execute("select rowid, rank from t where t match ?", (match,)).fetchall())
    got = {r["doc_id"] for r in fulltext.matching(index, fulltext.parse(typed)).collect()}
    assert got == set(want)
    if "NOT" not in typed and "OR" not in typed:
        ranks = {r["doc_id"]: r["rank"] for r in fulltext.ranked(index, fulltext.parse(typed), n_docs=len(DOCS)).collect()}
        assert ranks == pytest.approx(want, rel=1e-6, abs=1e-9)
