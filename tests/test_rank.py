import math
import random

from pyspark.sql import functions as F

from folioscope.operators import index, ireval, rank

PAGES = [("a", "Tab groups", "alpha beta gamma"), ("b", "Other", "tab tab tab groups groups and more words here"), ("c", "Third", "nothing of it"), ("d", "Fourth", None)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "slug string, title string, body string")


def test_bm25f_by_hand(spark):
    ix = index.build(frame(spark))
    got = {r["slug"]: r["score"] for r in rank.bm25f(ix, rank.query_terms(spark.createDataFrame([(1, "tab groups tab")], "qid int, q string"))).collect()}
    title = {"a": ["tab", "groups", "a"], "b": ["other", "b"], "c": ["third", "c"], "d": ["fourth", "d"]}
    body = {s: (b or "").split() for s, _, b in PAGES}
    at, ab = sum(map(len, title.values())) / 4, sum(map(len, body.values())) / 4
    want = {}
    for s in title:
        total = 0
        for t in ("tab", "groups"):
            df = sum(t in title[x] or t in body[x] for x in title)
            tf = 5 * title[s].count(t) / (0.25 + 0.75 * len(title[s]) / at) + body[s].count(t) / (0.25 + 0.75 * len(body[s]) / ab)
            total += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf / (1.2 + tf)
        if total:
            want[s] = total
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    assert got["a"] > got["b"]  # a title's match beats a repeated body


def test_top_and_empty(spark):
    ix = index.build(frame(spark))
    none = rank.query_terms(spark.createDataFrame([(1, "...")], "qid int, q string"))
    assert rank.bm25f(ix, none).count() == 0
    scored = spark.createDataFrame([(1, "x", 1.0), (1, "b", 2.0), (1, "a", 2.0)], "qid int, slug string, score double")
    assert [r["slug"] for r in rank.top(scored, 2).orderBy("rank").collect()] == ["a", "b"]
    assert rank.top(scored, 0).count() == 0
    empty = index.build(frame(spark, []))
    assert empty.stats.first().asDict() == {"n": 0, "avg_title": 1.0, "avg_body": 1.0}


def test_total_order(spark):
    rows = [(1, "a", 1.0, "2024-01-01", False), (1, "b", 1.0, "2024-02-01", False), (1, "c", 0.0, "", True), (1, "d", 1.0, "2024-02-01", False)]
    df = spark.createDataFrame(rows, "qid int, slug string, score double, updated string, touched boolean")
    assert [r["slug"] for r in rank.top(df, 9, rank.total_order()).orderBy("rank").collect()] == ["c", "b", "d", "a"]


def test_touching(spark):
    pages = spark.createDataFrame([("a", ["src/ui/x.py"]), ("b", ["src/uix/y.py"]), ("c", ["src/ui"])], "slug string, sources array<string>")
    wanted = spark.createDataFrame([(1, "src/ui/")], "qid int, path string")
    assert sorted(r["slug"] for r in rank.touching(pages, wanted).collect()) == ["a", "c"]


def sequential(hits):
    """One replacement moves up at a time until none stands below what it replaces."""
    hits = list(hits)
    for _ in range(len(hits) ** 2):
        for i, (_, to) in enumerate(hits):
            j = next((j for j, (s, _) in enumerate(hits) if s == to), None)
            if j is not None and j > i:
                hits.insert(i, hits.pop(j))
                break
        else:
            return [s for s, _ in hits]
    return [s for s, _ in hits]


def test_lift_equals_the_sequential_rule(spark):
    r = random.Random(5)
    rows, want = [], {}
    for q in range(150):
        n = r.randint(1, 8)
        names = [f"p{i}" for i in range(n)]
        order = names[:]
        r.shuffle(order)
        to = {s: (r.choice(names[i + 1 :] + ["outside", None]) if i + 1 < n else None) for i, s in enumerate(names)}
        hits = [(s, to[s]) for s in order]
        want[q] = sequential(hits)
        rows += [(q, s, k, t) for k, (s, t) in enumerate(hits, 1)]
    df = spark.createDataFrame(rows, "qid int, slug string, rank int, superseded_by string")
    got = {}
    for row in rank.lifted(df).orderBy("qid", "lifted").collect():
        got.setdefault(row["qid"], []).append(row["slug"])
    assert got == want


def test_lift_follows_chains_to_their_end(spark):
    """A chain of 70, oldest first in the list, a circle, and a hit that points nowhere."""
    n = 70
    rows = [(1, f"p{i}", i + 1, f"p{i + 1}" if i + 1 < n else None) for i in range(n)] + [(1, "z", n + 1, None), (2, "a", 1, "b"), (2, "b", 2, "a"), (2, "c", 3, "c")]
    got = rank.lifted(spark.createDataFrame(rows, "qid int, slug string, rank int, superseded_by string")).orderBy("qid", "lifted").collect()
    assert [r["slug"] for r in got if r["qid"] == 1] == [f"p{i}" for i in reversed(range(n))] + ["z"]
    assert sorted(r["slug"] for r in got if r["qid"] == 2) == ["a", "b", "c"]


def test_lift_of_a_replacement_far_down(spark, tmp_path):
    """The page is found by its name; the copy that replaces it ranks below 250 others."""
    from folioscope.plans import load

    text = "foo " + "with many other words " * 20
    rows = [(17, text), (900, text), *((i, f"foo foo foo {i}") for i in range(1000, 1250))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "17 foo")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = load()[0]["superseded_topk"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["slug"] for r in got][:2] == ["doc-900", "doc-17"] and len(got) == 10


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, slug string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid int, slug string, rank int")
    got = rank.fused(a, b).orderBy("rank").collect()
    assert [r["slug"] for r in got] == ["y", "x", "z"] and abs(got[0]["score"] - (1 / 61 + 1 / 62)) < 1e-12


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")], "qid int, rank int, slug string")
    rel = spark.createDataFrame([(1, "a"), (1, "c"), (2, "q")], "qid int, slug string")
    got = {r["qid"]: r for r in ireval.metrics(q, ranked, rel).collect()}
    assert abs(got[1]["ndcg"] - (1 + 0.5) / (1 + 1 / math.log2(3))) < 1e-9 and got[1]["rr"] == 1 and got[1]["r1"] == 1
    assert got[2]["ndcg"] == 0 and got[2]["rr"] == 0 and got[3]["ndcg"] == 0
    kinds = spark.createDataFrame([(1, "k"), (2, None)], "qid int, type string")
    assert {r["type"]: r["n"] for r in ireval.by_type(ireval.metrics(q, ranked, rel), kinds).collect()} == {"all": 3, "k": 1, "other": 2}


def test_lift_of_the_first_trees_equals_that_of_all_hits(spark):
    r = random.Random(12)
    up = {f"s{i}": r.choice([None, "", f"s{i}", f"s{r.randrange(60)}", f"s{i + 1}", "gone"]) for i in range(60)}
    rows = [(q, s, round(r.random(), 1), up[s], r.random() < 0.1, str(r.randrange(3))) for q in range(6) for s in up if r.random() < (1.0 if q == 0 else 0.6)]
    hits = spark.createDataFrame(rows, "qid int, slug string, score double, superseded_by string, touched boolean, updated string")
    roots = rank.tree_roots(spark.createDataFrame(list(up.items()), "slug string, superseded_by string"))
    for k in (1, 4, 100):
        want = rank.lifted(rank.top(hits, None, rank.total_order()), k).select("qid", "lifted", "slug").collect()
        assert sorted(rank.lifted_top(hits, k, rank.total_order(), roots).select("qid", "lifted", "slug").collect()) == sorted(want)
    assert rank.lifted_top(hits, 0, rank.total_order(), roots).count() == 0


def test_index_is_stored_with_its_version(spark, tmp_path):
    ix = index.build(frame(spark))
    index.store(ix, str(tmp_path / "ix"), fingerprint="f1", buckets=2)
    again = index.stored(spark, str(tmp_path / "ix"), fingerprint="f1")
    assert again is not None and again.postings.count() == ix.postings.count()
    assert index.stored(spark, str(tmp_path / "ix"), fingerprint="f2") is None
    assert index.stored(spark, str(tmp_path / "none"), fingerprint="f1") is None


def test_demotion(spark):
    got = spark.createDataFrame([(1.0, "x"), (1.0, None), (1.0, "")], "s double, by string").select(rank.demoted(F.col("s"), F.col("by")).alias("d")).collect()
    assert [r["d"] for r in got] == [0.5, 1.0, 1.0]


def test_hits_are_made_once(spark):
    from folioscope.operators import search

    seen = spark.sparkContext.accumulator(0)

    def read(slug):
        seen.add(1)
        return slug

    rows = [(q, f"p{i}", float(i % 7), [], False, False, "1", f"p{i + 1}" if i % 3 == 0 else None) for q in range(2) for i in range(20)]
    found = spark.createDataFrame(rows, "qid int, slug string, score double, touching array<string>, touched boolean, thin boolean, updated string, superseded_by string")
    assert search.hits(found.withColumn("slug", F.udf(read, "string")("slug")), 3).count() == 6
    assert seen.value == len(rows)
