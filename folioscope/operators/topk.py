"""The best k pages of each query without scoring all that its words meet.

Postings of a term fall into ``TIERS`` tiers by what they can contribute: the tier follows from the row alone (its weight with the
segment's mean lengths), so no term is ranked as a whole, and a frequent term's tiers lie in different files. What is stored of a
tier is its number of rows and their greatest weight, which times the change of the mean lengths bounds every row of it.

A query goes in two passes. The first reads a query's tiers with the highest bounds, up to ``SEEDS`` rows: the k-th sum found there
is a score that k pages reach at least. With it the query's words are split: words so weak that all of them together stay below that
score can't bring a page in. The second pass reads of the other words the tiers that can, and only the pages found there whose bound
still reaches the k-th score are looked up among the weak words. What is left out can't be among the best k, ties included, so the
result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import rank
from folioscope.operators.index import Index
from folioscope.storage import MAX_SENT, checked_broadcast, materialised

TIERS = 24
#: Rows of the first pass for each query; the tier that reaches it is read whole.
SEEDS = 1_000
#: Scores are compared with six decimals; what could be equal then is kept.
SLACK = 2e-6


def _norm(size: Column, mean: Column | float) -> Column:
    mean = F.lit(mean).cast("double") if isinstance(mean, float | int) else mean
    return 1 - rank.B + rank.B * F.when(mean > 0, size / mean).otherwise(1.0)


def with_tiers(postings: DataFrame, title: float, body: float) -> DataFrame:
    """postings with ``tier`` (0: the greatest contributions), ``most`` and ``flat``: a row's weights in the two formulas, given mean lengths."""
    fields = rank.TITLE * F.col("title_tf") / _norm(F.col("title_len"), title) + F.col("body_tf") / _norm(F.col("body_len"), body)
    flat = (rank.TITLE * F.col("title_tf") + F.col("body_tf")) / _norm(F.col("title_len") + F.col("body_len"), title + body)
    tier = F.floor(TIERS * (1 - F.col("most") / (rank.K1 + F.col("most"))))
    return postings.withColumns({"most": fields, "flat": flat}).withColumn("tier", F.least(F.lit(TIERS - 1), tier).cast("int"))


def growth(title: float, body: float, now_title: float, now_body: float) -> tuple[float, float]:
    """How much the two weights of any row can grow at most when the mean lengths become others."""

    def ratio(old: float, new: float) -> float:
        if old > 0 and new > 0:
            return max(1.0, new / old)
        return 1 / (1 - rank.B) if new > 0 else 1.0  # without a mean the norm was 1; without one now no row has the field

    return max(ratio(title, now_title), ratio(body, now_body)), ratio(title + body, now_title + now_body)


def _best(index: Index, terms: DataFrame, k: int, idf: Column, bound: str, part: Callable[[], Column], top: Callable[[Column], Column]) -> DataFrame:
    """(qid, slug, score) of pages whose score may be among the best k; part: a row's contribution for idf 1, top: that of a weight."""
    asked = terms.join(index.df.join(checked_broadcast(terms.select("term").distinct()), "term", "left_semi"), "term").join(F.broadcast(index.stats))  # one row
    asked = materialised(asked.select("qid", "term", idf.alias("idf")), "asked")
    tiers = index.tiers.join(checked_broadcast(asked), "term").select("qid", "term", "tier", "n", "idf", (F.col("idf") * top(F.col(bound))).alias("bound"))
    tiers = materialised(tiers, "tiers")
    rows = index.postings.join(F.broadcast(index.stats)).withColumn("_part", part())  # one row

    def sums(some: DataFrame, *, tiered: bool) -> DataFrame:
        on = ["term", "tier"] if tiered else ["term"]
        own = rows.join(checked_broadcast(some.select(on).distinct()), on, "left_semi").select("slug", *on, "_part")
        met = rank.by_page(own, index, some).join(checked_broadcast(some), on)
        return met.groupBy("qid", "slug").agg(F.sum(F.col("idf") * F.col("_part")).alias("score"))

    by = Window.partitionBy("qid").orderBy(F.desc("bound"), "term", "tier")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = tiers.withColumn("_before", before).where(F.col("_before") < max(SEEDS, k)).select("qid", "term", "tier", "idf")
    reached = materialised(rank.top(sums(seeds, tiered=True), k).where(F.col("rank") == k).select("qid", (F.col("score") - SLACK).alias("least")), "reached")

    words = tiers.groupBy("qid", "term", "idf").agg(F.max("bound").alias("word"))
    words = words.withColumn("weak", F.sum("word").over(Window.partitionBy("qid").orderBy("word", "term")))
    words = words.withColumn("all", F.sum("word").over(Window.partitionBy("qid"))).join(checked_broadcast(reached), "qid", "left")
    least = F.coalesce("least", F.lit(float("-inf")))
    words = materialised(words.select("qid", "term", "idf", "word", "all", least.alias("least"), (F.col("weak") < least).alias("weak")), "words")
    strong = tiers.join(checked_broadcast(words.where("not weak").select("qid", "term", "word", "all", "least")), ["qid", "term"])
    strong = strong.where(F.col("bound") + F.col("all") - F.col("word") >= F.col("least")).select("qid", "term", "tier", "idf")
    rest = words.groupBy("qid").agg(F.first("least").alias("least"), F.coalesce(F.sum(F.when(F.col("weak"), F.col("word"))), F.lit(0.0)).alias("rest"))
    found = sums(strong, tiered=True).join(checked_broadcast(rest), "qid").where(F.col("score") + F.col("rest") >= F.col("least")).select("qid", "slug", "score", "least")
    weak = words.where("weak").select("qid", "term", "idf")
    if weak.isEmpty():
        return found.select("qid", "slug", "score")
    found = materialised(found, "candidates")
    # the weak words' rows and the candidates meet where their page is dealt to: no pair of query and page is sent but the candidates
    met = rows.join(checked_broadcast(weak.select("term").distinct()), "term", "left_semi")
    pages = found.select("slug").distinct()
    if pages.limit(MAX_SENT + 1).count() <= MAX_SENT:
        met = met.join(F.broadcast(pages), "slug", "left_semi")  # counted just now; beyond, other pages fall out below
    met = met.select("slug", "term", "_part").unionByName(found.select("slug", "qid", "score"), allowMissingColumns=True)
    met = rank.by_page(met, index, terms).join(checked_broadcast(weak.withColumnRenamed("qid", "_qid")), "term", "left").withColumn("qid", F.coalesce("qid", "_qid"))
    both = met.groupBy("qid", "slug").agg(F.sum(F.coalesce("score", F.col("idf") * F.col("_part"))).alias("score"), F.max(F.col("term").isNull()).alias("_found"))
    return both.where("_found").select("qid", "slug", "score")


def bm25f_top(index: Index, terms: DataFrame, k: int, *, title_weight: float = rank.TITLE) -> DataFrame:
    """(qid, rank, slug, score): the same rows as the best k of ``rank.bm25f``.

    An index without tiers (one that isn't stored) is scored as a whole.
    """
    if index.tiers is None:
        return _ranked(rank.bm25f(index, terms, title_weight=title_weight), k)
    tf = lambda: title_weight * F.col("title_tf") / _norm(F.col("title_len"), F.col("avg_title")) + F.col("body_tf") / _norm(F.col("body_len"), F.col("avg_body"))
    heavier = max(1.0, title_weight / rank.TITLE)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _ranked(_best(index, terms, k, idf, "most", lambda: tf() / (rank.K1 + tf()), lambda w: w * heavier / (rank.K1 + w * heavier)), k)


def fts_top(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(qid, rank, slug, score): the same rows as the best k of ``rank.fts_bm25``."""
    if index.tiers is None:
        return _ranked(rank.fts_bm25(index, terms), k)
    tf = lambda: (rank.TITLE * F.col("title_tf") + F.col("body_tf")) / _norm(F.col("title_len") + F.col("body_len"), F.col("avg_title") + F.col("avg_body"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return _ranked(_best(index, terms, k, idf, "flat", lambda: tf() * (rank.K1 + 1) / (rank.K1 + tf()), lambda w: w * (rank.K1 + 1) / (rank.K1 + w)), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return rank.top(scored, k).select("qid", "rank", "slug", F.round("score", 6).alias("score"))
