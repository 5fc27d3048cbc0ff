"""Lists that skip what can't reach them equal those of everything scored; the plain analyser."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import cells, rank, rawtext, segments, similar, topk
from folioscope.storage import shared_dir

WORDS = ["the", "of", "and"] * 40 + [f"w{i}" for i in range(200)]


def corpus(spark, n, seed, rows=()):
    r = random.Random(seed)
    texts = [(f"p{seed}-{i}", " ".join(r.choices(WORDS, k=r.choice([0, 2, 4]))), " ".join(r.choices(WORDS, k=r.choice([1, 8, 60, 300])))) for i in range(n)]
    return spark.createDataFrame([*texts, *rows], "slug string, title string, body string")


def rows(df):
    return sorted((r["qid"], r["rank"], r["slug"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 500])
def test_bounded_lists(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "SEEDS", 5)
    place = f"{shared_dir(spark)}/bounded-{uuid.uuid4().hex}"
    copies = [(f"c{i}", "same the", "w1 w2 the the") for i in range(30)]  # ties
    first = corpus(spark, 120, 1, copies)
    segments.refresh(first, place)
    # pages go, change and come, of quite other lengths: bounds hold with the new means
    after = first.where(F.col("slug") != "p1-3").withColumn("body", F.when(F.col("slug") == "p1-5", "w1").otherwise(F.col("body"))).unionByName(corpus(spark, 40, 2))
    version = segments.refresh(after, place)
    index = segments.opened(spark, version)
    asked = [(1, "the w1"), (2, "the of and"), (3, "w1 w2 w3 w4 of"), (4, "the"), (5, "nowhere"), (6, ""), (7, "nowhere the w9")]
    terms = rank.query_terms(spark.createDataFrame(asked, "qid int, q string"))
    assert rows(topk.bm25f_top(index, terms, k)) == rows(rank.top(rank.bm25f(index, terms), k))
    assert rows(topk.fts_top(index, terms, k)) == rows(rank.top(rank.fts_bm25(index, terms), k))
    if k == 3:
        heavy = rank.bm25f(index, terms, title_weight=9.0)
        assert rows(topk.bm25f_top(index, terms, k, title_weight=9.0)) == rows(rank.top(heavy, k))
        most = index.postings.join(index.tiers, ["term", "tier"], "left").where("n is null").count()
        assert most == 0  # each row has its tier


def test_cells_equal_all_compared(spark, monkeypatch):
    r = np.random.default_rng(5)
    middles = r.normal(size=(12, 8))
    own = [(i, (middles[i % 12] * r.uniform(0.5, 3) + 0.05 * r.normal(size=8)).tolist()) for i in range(600)]
    own += [(1000 + i, middles[0].tolist()) for i in range(200)] + [(2000 + i, [0.0] * 8) for i in range(3)] + [(3000, None)]
    vectors = spark.createDataFrame(own, "id long, v array<double>")
    real = vectors.where("v is not null")
    queries = real.where("id % 50 = 0 or id = 2001").select(F.col("id").alias("qid"), "v")
    found = cells.build(vectors, rows=64)
    got = lambda df: sorted((x.qid, x.rank, x.id, round(x.sim, 6) + 0.0) for x in df.collect())
    for k in (1, 10):
        assert got(cells.cosine_topk(queries, found, k, per_block=7)) == got(similar.cosine_topk(queries, real, k))
    work = {x.qid: x.compared for x in cells.cosine_topk(queries, found, 10, work=True).collect()}
    assert work[50] < 400  # other directions are skipped
    assert found.members.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200  # copies are dealt out
    none = cells.build(vectors.limit(0))
    assert cells.cosine_topk(queries, none, 3).count() == 0


def test_plain_words(spark):
    rows = [("x-1", "Café_Größe useAgent", "naïve été ЙОД 3.5", None), ("y", None, "cafe", None)]
    pages = spark.createDataFrame(rows, "slug string, title string, body string, term string")
    got = pages.select("slug", rawtext.tokens(F.col("title")).alias("t"), rawtext.tokens(F.col("body")).alias("b")).orderBy("slug").collect()
    assert got[0]["t"] == ["cafe", "große", "useagent"] and got[0]["b"] == ["naive", "ete", "иод", "3", "5"]
    assert got[1]["t"] == [] and got[1]["b"] == ["cafe"]
    index = rawtext.build(pages)
    assert {r["term"]: r["df"] for r in index.df.collect()}["cafe"] == 2
    assert {(r["title_tf"], r["body_tf"]) for r in index.postings.where("term = 'x'").collect()} == {(0, 0)}
    terms = rawtext.query_terms(spark.createDataFrame([(1, "café cafe use_agent")], "qid int, q string"))
    assert sorted(r["term"] for r in terms.collect()) == ["agent", "cafe", "cafe", "use"]


def test_weak_words_and_candidates_meet_where_their_page_is_dealt_to(spark, monkeypatch):
    """Before, the weak words' rows were joined with the queries first, and pairs of query and page were shuffled."""
    monkeypatch.setattr(topk, "SEEDS", 5)
    place = f"{shared_dir(spark)}/bounded-{uuid.uuid4().hex}"
    index = segments.opened(spark, segments.refresh(corpus(spark, 60, 3), place))
    terms = rank.query_terms(spark.createDataFrame([(1, "the w1"), (2, "the of w2 w3")], "qid int, q string"))
    dealt, by_page = [], rank.by_page
    monkeypatch.setattr(rank, "by_page", lambda rows, *more: dealt.append(rows.columns) or by_page(rows, *more))
    assert topk.bm25f_top(index, terms, 1).count() == 2
    assert len(dealt) == 3 and "qid" in dealt[2]
