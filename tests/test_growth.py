"""What the shared steps of ranking, judging and comparing send through shuffles."""

import re
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope import storage
from folioscope.llm import decontaminate
from folioscope.operators import gate, graph, imports, index, rank, rawtext, segments, similar
from folioscope.plans import retrieval, surface


def shuffled(df):
    """The keys of a frame's exchanges, each as the list of its columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [sorted(re.findall(r"(\w+)#\d+", keys)) for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(f"p{i}", f"t {i}", f"common words here and word{i} end of it") for i in range(40)], "slug string, title string, body string")


@pytest.mark.parametrize("score", [rank.bm25f, rank.fts_bm25, rank.term_count])
def test_pairs_of_query_and_page_are_not_shuffled(spark, pages, score):
    asked = spark.createDataFrame([(i, f"common word{i} words") for i in range(20)], "qid int, q string")
    found = score(index.build(pages), rank.query_terms(asked))
    assert ["qid", "slug"] not in shuffled(found) and found.count() == 20 * 40
    best = rank.top(found, 1).collect()
    assert {r["qid"]: r["slug"] for r in best} == {i: f"p{i}" for i in range(20)}


def test_texts_are_compared_where_they_are_read(spark, pages):
    asked = spark.createDataFrame([(1, "words here and word7 end"), (2, "here and word39 end"), (3, "and wor end of"), (4, "word3"), (5, "")], "qid int, q string")
    found = retrieval.containing(pages, asked)
    assert sorted(map(tuple, found.collect())) == [(1, "p7"), (2, "p39"), *sorted((4, f"p{i}") for i in (3, *range(30, 40)))]
    assert shuffled(retrieval.containing(pages, asked.where("qid < 4"))) == []


def test_too_many_queries_to_send(spark, pages, monkeypatch):
    asked = spark.createDataFrame([(1, "words here and word7 end"), (4, "word3")], "qid int, q string")
    want = sorted(map(tuple, retrieval.containing(pages, asked).collect()))
    monkeypatch.setattr(retrieval, "MAX_SENT", 0)
    assert sorted(map(tuple, retrieval.containing(pages, asked).collect())) == want


def test_cosines_send_no_pairs_and_take_counts(spark):
    docs = spark.createDataFrame([(d, w, 1 + d % 2) for d in range(30) for w in ("a", f"w{d % 5}", f"x{d}")], "id long, term string, tf long")
    asked = spark.createDataFrame([(-1 - q, w, 1) for q in range(5) for w in ("a", f"w{q}")], "id long, term string, tf long")
    ids = docs.select("id").union(asked.select("id")).agg(F.count_distinct("id").alias("n"))
    one, other = similar.cosines(asked, docs), similar.cosines(asked, docs, ids)
    assert ["i", "j"] not in shuffled(other) and sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() == 150
    scores = one.select(F.round("score", 6).alias("score"))
    counted = scores.groupBy("score").agg(F.count("*").alias("n"))
    assert similar.budgeted_threshold(scores, F.lit(150), 0.3).collect() == similar.budgeted_threshold(counted, F.lit(150), 0.3).collect()


def test_index_of_written_counts(spark, pages):
    whole = index.build(pages)
    again = index.of_counts(whole.postings.localCheckpoint(), whole.lengths.localCheckpoint())
    assert sorted(map(tuple, again.df.collect())) == sorted(map(tuple, whole.df.collect())) and again.stats.collect() == whole.stats.collect()


def test_first_slugs_of_words_give_the_first_of_queries(spark, pages):
    asked = rank.query_terms(spark.createDataFrame([(1, "ord3 end"), (2, "word39"), (3, "p2"), (4, "nowhere")], "qid int, q string"))
    whole = {}
    for r in rank.grep_or(pages, asked).collect():
        whole.setdefault(r["qid"], []).append(r["slug"])
    for k in (1, 3, 50):
        first = rank.grep_or(pages, asked, k)
        got = first.collect()
        assert sorted((r["qid"], r["slug"]) for r in got) == sorted((q, s) for q, own in whole.items() for s in sorted(own)[:k])
        assert ["word"] not in shuffled(first)  # words were brought down to their first pages before


def test_one_pass_over_the_graph_serves_all_caps(spark, monkeypatch):
    edges = spark.createDataFrame([(f"a{i}", f"b{i % 3}") for i in range(20)] + [("x", "y"), ("y", "x")], "src string, dst string")
    cited = spark.createDataFrame([(i % 4, f"{'ab'[i % 2]}{i % 7}") for i in range(30)], "slug int, source string")
    files = spark.createDataFrame([(f"a{i}",) for i in range(20)] + [(f"b{i}",) for i in range(5)] + [("x",), ("z",)], "path string")
    calls, own = [], graph.neighbours
    monkeypatch.setattr(graph, "neighbours", lambda *a: calls.append(a) or own(*a))
    got = graph.probe(files, edges, cited, (None, 6, 0)).collect()
    assert len(calls) == 1
    for row, cap in zip(sorted(got, key=lambda r: r["place"]), (None, 6, 0), strict=True):
        sizes = [r["n_pages"] for r in graph.reach(files, edges, cited, cap).collect()]
        found = [r["found"] for r in graph.leave_one_out(edges, cited, cap).collect()]
        some = [n for n in sizes if n]
        assert row["reach"] == pytest.approx(len(some) / len(sizes)) and row["median_group"] == (statistics.median(some) if some else 0)
        assert row["n_cases"] == len(found) and row["recall"] == pytest.approx(sum(found) / len(found))


def test_plain_index_of_what_is_asked(spark, pages):
    terms = spark.createDataFrame([(1, "common"), (2, "word7"), (2, "common"), (3, "none")], "qid int, term string")
    part, whole = rawtext.asked(pages, terms), rawtext.build(pages)
    assert {r["term"] for r in part.postings.collect()} == {"common", "word7"}
    assert part.stats.collect() == whole.stats.collect() and part.lengths.count() == 40
    assert sorted(map(tuple, rank.fts_bm25(part, terms).collect())) == sorted(map(tuple, rank.fts_bm25(whole, terms).collect()))
    assert "Aggregate" not in part.postings._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_pairs_of_queries_and_pages(spark, pages, monkeypatch):
    ix = index.build(pages)
    terms = rank.query_terms(spark.createDataFrame([(i, f"common word{i}") for i in range(20)], "qid int, q string"))
    want = sorted(map(tuple, rank.bm25f(ix, terms).collect()))
    monkeypatch.setattr(rank, "PAIRS", 10)
    many = rank.bm25f(ix, terms)
    assert many.rdd.getNumPartitions() >= 40 * 20 // 10 and sorted(map(tuple, many.collect())) == want


def test_long_texts_go_to_workers_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1_000).alias("text"))

    def largest(seeds):
        def run(batches):
            for batch in batches:
                yield pa.record_batch([pa.array([batch.nbytes]), pa.array([""])], names=["doc_id", "text"])

        return run

    sizes = [r["doc_id"] for r in decontaminate._passes(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"), 5, largest).collect()]
    assert sum(sizes) > 20_000_000 and max(sizes) < 1.1 * storage.BATCH


@pytest.mark.parametrize("operator", [lambda files: imports.statements(files), lambda files: gate.merged(files.select(F.col("path").alias("slug"), F.col("text").alias("old"), F.col("text").alias("new")))])
def test_operators_on_texts_bound_what_a_worker_gets(spark, operator):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert operator(spark.createDataFrame([("a.py", "import b\n")], "path string, text string")).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(storage.BATCH)


def test_terms_are_counted_within_a_page(spark):
    rows = spark.createDataFrame([("a", ["x", "b", "x"], ["b", "x", "c", "c"]), ("b", [], []), ("c", ["z"], []), ("d", [], ["z", "z"])], "slug string, title array<string>, body array<string>")
    got = rows.select("slug", index.counts(F.col("title"), F.col("body")).alias("terms"))
    assert {r["slug"]: [tuple(t) for t in r["terms"]] for r in got.collect()} == {"a": [("b", 1, 1), ("c", 0, 2), ("x", 2, 1)], "b": [], "c": [("z", 1, 0)], "d": [("z", 0, 2)]}
    assert shuffled(got) == []


def test_refreshes_have_tasks_by_size_and_send_no_whole_texts(spark, tmp_path, monkeypatch):
    own = spark.createDataFrame([(f"p{i}", f"t {i}", f"common words here and word{i}") for i in range(60)], "slug string, title string, body string")
    path, parts = str(tmp_path / "ix"), lambda version, part: len(list((tmp_path / "ix" / "segments").glob(f"{version['segments'][-1]['folder'].rsplit('/', 1)[-1]}/{part}/part-*")))
    monkeypatch.setattr(segments, "TEXT", 200)
    monkeypatch.setattr(segments, "TOKENS", 30)
    first = segments.refresh(own, path)
    assert first["n"] == 60 and parts(first, "pages") > 4 and parts(first, "postings") > 4  # more than the session's partitions
    want = sorted(map(tuple, index.build(own).postings.select("term", "slug", "title_tf", "body_tf", "title_len", "body_len").collect()))
    assert sorted(map(tuple, segments.opened(spark, first).postings.drop("tier").collect())) == want


@pytest.mark.parametrize("most", [(0, 100), (0, 0), (100, 100)])
def test_keys_too_many_to_send(spark, monkeypatch, most):
    monkeypatch.setattr(storage, "MAX_SENT", most[0])
    monkeypatch.setattr(storage, "MAX_DIGESTS", most[1])
    rows, some = spark.range(50).selectExpr("id as k", "repeat('x', 10) as text"), spark.range(40, 60).selectExpr("id as k", "1 as other")
    assert sorted(r["k"] for r in storage.where_in(rows, some, ["k"]).collect()) == list(range(40, 50))


def test_blocks_of_vectors_have_a_task_each(spark):
    vectors = spark.range(300).selectExpr("id", "array(cast(id as double), 1D) as v")
    found = similar.cosine_topk(vectors.where("id < 3").selectExpr("id as qid", "v"), vectors, 2)
    parts = 2 * spark.sparkContext.defaultParallelism
    assert f"hashpartitioning(a, b, {parts})" in re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString()) and found.count() == 6


def test_methods_that_rank_by_the_same_scores_share_them(spark, monkeypatch):
    calls, own = [], rank.bm25f
    monkeypatch.setattr(rank, "bm25f", lambda *a, **k: calls.append(a) or own(*a, **k))
    got = surface.touch_methods(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and sorted(r["method"] for r in got.collect()) == ["path as text", "touching"]
    assert not [keys for keys in shuffled(surface._touch(spark, "/root/testdata/sf0.001")[0]) if "doc_id" in keys]  # texts stay where they are
