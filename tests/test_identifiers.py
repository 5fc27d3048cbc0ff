"""Identifiers of several parts: the queries keep them whole, as their SQL does; the library cuts them unless told otherwise."""

import duckdb
import pytest

from folioscope.functions import text as T
from folioscope.operators import index, segments
from folioscope.plans import load

QUERIES, SQL = load()
KEY = "AKIA9J2Kx_Ab"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"Head line {i}\nkey {KEY} {'é̂ ' if i == 3 else ''}word{i % 2} some_name camelCase", "en", "s", 1) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, f"line {KEY} word1"), (1, "some name")], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", ["token_pages", "term_frequency", "term_lookup", "corpus_stats", "bm25f_topk", "bm25f_bounded_topk", "rrf_topk", "refreshed_frequency", "refreshed_postings", "search_hits", "snippets"])
def test_identifiers_are_whole_in_queries(spark, tables, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * REPLACE (nfc_normalize(text) AS text) FROM '{tables}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)
    rows = [[r[c] for c in columns] for r in df.collect()]
    assert plain(rows) == plain([r[names.index(c)] for c in columns] for r in result.fetchall())


def test_library_cuts_or_keeps(spark, tmp_path):
    texts = spark.createDataFrame([("one getName_x",), ("é getName_x",)], "t string")
    cut, whole = (["getname_x", "get", "name", "x"], ["getname_x"])
    assert [r["tokens"][1:] for r in T.with_tokens(texts, "t").collect()] == [cut, cut]
    assert [r["tokens"][1:] for r in T.with_tokens(texts, "t", parts=False).collect()] == [whole, whole]
    pages = spark.createDataFrame([("a", "getName", "b")], "slug string, title string, body string")
    terms = lambda ix: {r["term"] for r in ix.postings.collect()}
    for parts in (True, False, True):  # a stored index of the other kind is built anew
        assert terms(segments.kept(pages, str(tmp_path / "ix"), fingerprint="f", parts=parts)) == terms(index.build(pages, parts=parts))
    with pytest.raises(ValueError):
        index.merged(index.build(pages), index.build(pages, parts=False))
