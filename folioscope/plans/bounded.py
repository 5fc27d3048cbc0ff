"""Ranked lists that read only what can reach them, and the list of a plain full-text index beside the engine's own."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import cells, ireval, rank, rawtext, topk
from folioscope.plans import analytics, retrieval, surface
from folioscope.plans import sqltext as S
from folioscope.plans.registry import ORACLES, query
from folioscope.plans.retrieval import built, pages, queries, read
from folioscope.storage import materialised


@query("bm25f_bounded_topk", S.ranked(S.bm25f()))
def bm25f_bounded_topk(spark, sf_dir):
    """The list of ``bm25f_topk`` by tiers of postings."""
    return topk.bm25f_top(*built(spark, sf_dir), 10)


@query("fts_bounded_topk", S.ranked(S.FTS))
def fts_bounded_topk(spark, sf_dir):
    return topk.fts_top(*built(spark, sf_dir), 10)


@query("cosine_cells_topk", ORACLES["cosine_topk"])
def cosine_cells_topk(spark, sf_dir):
    """The list of ``cosine_topk`` by cells of vectors."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cells.cosine_topk(rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"), cells.build(rows), 10)


def _raw(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"


#: The index and the hits of the plain analyser, under names of their own.
RAW = f"""rows_ AS (SELECT 'doc-' || doc_id AS slug, {_raw("split_part(text, chr(10), 1)")} AS t, {_raw("text")} AS b, {_raw("'doc-' || doc_id")} AS s FROM documents),
reach_ AS (SELECT slug, unnest(t) AS term, 1 AS t, 0 AS b FROM rows_ UNION ALL SELECT slug, unnest(b), 0, 1 FROM rows_ UNION ALL SELECT slug, unnest(s), 0, 0 FROM rows_),
rawpost_ AS (SELECT term, slug, sum(t)::BIGINT AS title_tf, sum(b)::BIGINT AS body_tf FROM reach_ GROUP BY term, slug),
rawlen_ AS (SELECT slug, len(t) + len(s) AS title_len, len(b) AS body_len FROM rows_),
rawdf_ AS (SELECT term, count(*) AS df FROM rawpost_ GROUP BY term),
rawstats_ AS (SELECT count(*) AS n, coalesce(avg(title_len), 1.0) AS avg_title, coalesce(avg(body_len), 1.0) AS avg_body FROM rawlen_),
rawterms_ AS (SELECT qid, strip_accents(term) AS term FROM terms_ WHERE NOT contains(term, '_')),
rawhits_ AS (SELECT * FROM rawterms_ JOIN rawpost_ USING (term) JOIN rawdf_ USING (term) JOIN rawlen_ USING (slug) CROSS JOIN rawstats_)"""
_RAW_TOP = S.top(S.FTS.replace("hits_", "rawhits_"))


def _raw_best(spark, sf_dir):
    terms = materialised(rawtext.query_terms(queries(spark, sf_dir), parts=False), "raw-terms")
    found = rank.fts_bm25(rawtext.asked(pages(spark, sf_dir), terms), terms)
    return rank.top(found.withColumn("score", F.round("score", 6)), 10).select("qid", "rank", "slug", "score")


@query("raw_fts_topk", f"WITH {S.PAGES}, {RAW} {_RAW_TOP}")
def raw_fts_topk(spark, sf_dir):
    """The ten best pages of a plain full-text index: no marks, no parts of identifiers, slug without weight."""
    return _raw_best(spark, sf_dir)


@query("raw_terms", f"WITH {S.PAGES}, {RAW} SELECT term, df FROM rawdf_")
def raw_terms(spark, sf_dir):
    return rawtext.build(pages(spark, sf_dir)).df


_PER2 = re.sub(r"\b(m|n|per)_", r"\g<1>2_", retrieval._PER).replace("t_ t", "t2_ t")


@query("raw_delta", f"""WITH {S.PAGES}, {RAW}, t_ AS ({S.top(S.FTS)}), {retrieval._PER}, t2_ AS ({_RAW_TOP}), {_PER2},
v_ AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS place, per_.ndcg - per2_.ndcg AS value FROM per_ JOIN per2_ USING (qid) WHERE per_.n_rel > 0), {retrieval._DRAWS}""")
def raw_delta(spark, sf_dir):
    """What the engine's own words gain in nDCG over those of a plain index, query by query, with its interval."""
    relevant = materialised(retrieval.qrels(spark, sf_dir), "qrels")
    per = lambda ranked: ireval.metrics(queries(spark, sf_dir), ranked, relevant).where("n_rel > 0")
    own, raw = per(topk.fts_top(*built(spark, sf_dir), 10)), per(_raw_best(spark, sf_dir))
    both = own.select("qid", F.col("ndcg").alias("x")).join(raw.select("qid", F.col("ndcg").alias("y")), "qid")
    return retrieval._interval(ireval.placed(both, F.col("x") - F.col("y")))


_LISTS = "l_ AS (SELECT 'shipped' AS method, qid, rank, slug FROM a_ UNION ALL SELECT 'dense', qid, rank, slug FROM b_ UNION ALL SELECT 'hybrid', qid, rank, slug FROM z_ WHERE rank <= 10)"


@query("hybrid_by_type", f"""WITH {S.PAGES}, {surface._HYBRID}, {_LISTS},
n_ AS (SELECT qid, count(*) AS n FROM qrels_ GROUP BY qid), g_ AS (SELECT method, qid, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM l_ JOIN qrels_ USING (qid, slug) GROUP BY ALL)
SELECT method, coalesce(type, 'all') AS type, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr FROM (
  SELECT method, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'known' END AS type, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg, coalesce(1 / first, 0) AS rr
  FROM n_ CROSS JOIN (SELECT unnest(['shipped', 'dense', 'hybrid']) AS method) LEFT JOIN g_ USING (method, qid)) GROUP BY GROUPING SETS ((method, type), (method))""")
def hybrid_by_type(spark, sf_dir):
    """Words, vectors and both by kind of query, over the queries with relevant pages; words by tiers, vectors by cells."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.join(queries(spark, sf_dir).select(F.col("qid").alias("id")), "id", "left_semi").select(F.col("id").alias("qid"), "v")
    near = cells.cosine_topk(asked, cells.build(vectors.join(docs, "id", "left_semi")), 10)
    dense = materialised(near.select("qid", "rank", F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("slug")), "dense")
    shipped, relevant = materialised(topk.bm25f_top(*built(spark, sf_dir), 10), "shipped"), materialised(retrieval.qrels(spark, sf_dir), "qrels")
    kinds = relevant.groupBy("qid").agg(F.when(F.count("*") > 1, "ambiguous").otherwise("known").alias("type"))
    lists = {"shipped": shipped, "dense": dense, "hybrid": rank.fused(shipped, dense)}
    means = [ireval.by_type(ireval.metrics(kinds.select("qid"), x, relevant), kinds).select(F.lit(name).alias("method"), "type", "n", F.round("ndcg", 6).alias("ndcg"), F.round("rr", 6).alias("rr")) for name, x in lists.items()]
    return reduce(DataFrame.union, means)


assert analytics  # whose query of vectors has the same SQL
