"""The duplicate probe: pages that supersede each other are the known duplicates; how well a similarity tells them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.similar import best_match, budgeted_threshold
from folioscope.storage import materialised


def partners(pages: DataFrame) -> DataFrame:
    """(slug, partner) in both directions, of pages (slug, supersedes) and the pages there are that they supersede."""
    names = pages.select(F.col("slug").alias("partner")).distinct()
    forth = pages.select("slug", F.explode("supersedes").alias("partner")).join(names, "partner", "left_semi").select("slug", "partner")
    return forth.union(forth.select("partner", "slug")).distinct()


def per_pair(scores: DataFrame, positive: DataFrame, rate: float) -> DataFrame:
    """One row (threshold, recall, fpr): pairs (i, j, score) against the known ones (i, j), at most ``rate`` of the others reached."""
    rows = scores.join(positive.select("i", "j", F.lit(True).alias("_p")).distinct(), ["i", "j"], "left").withColumn("known", F.col("_p").isNotNull())
    others = rows.where("not known")
    total = others.count()
    at = budgeted_threshold(others.select("score"), F.lit(total), rate).select("threshold")
    share = lambda of: F.coalesce(F.try_divide(F.count_if(of & (F.col("score") >= F.col("threshold"))), F.count_if(of)), F.lit(0.0))
    return rows.join(F.broadcast(at)).groupBy("threshold").agg(share(F.col("known")).alias("recall"), share(~F.col("known")).alias("fpr"))  # one row


def per_write(scores: DataFrame, pages: DataFrame, known: DataFrame, rate: float) -> DataFrame:
    """One row of what a warning on each page's best match would be worth: threshold, recall, fpr and counts.

    scores (i, j, score) in both directions, pages (i), known partners (i, j).  A page is right if its best match is a
    partner; all others may warn falsely, for ``rate`` of the pages at most.
    """
    best = pages.select("i").join(best_match(scores), "i", "left").join(known.select("i", "j", F.lit(True).alias("_p")).distinct(), ["i", "j"], "left")
    rows = materialised(best.select("i", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("_p").isNotNull().alias("right")), "writes")
    n = rows.count()
    at = budgeted_threshold(rows.where("not right").select("score"), F.lit(n), rate).select("threshold")
    reached = F.col("score") >= F.col("threshold")
    out = rows.join(F.broadcast(at)).groupBy("threshold").agg(F.count_if(F.col("right") & reached).alias("true_count"), F.count_if(~F.col("right") & reached).alias("false_count"), F.count("*").alias("n_writes"))
    total = known.select("i").distinct().agg(F.count("*").alias("partner_count"))
    return out.join(F.broadcast(total)).withColumns({"recall": F.coalesce(F.try_divide("true_count", "partner_count"), F.lit(0.0)), "fpr": F.col("false_count") / F.col("n_writes")})


def verdict(results: DataFrame, floor: float = 0.5) -> DataFrame:
    """The measure (name, recall) of best recall, and whether it reaches the floor."""
    return results.groupBy().agg(F.max_by("name", F.col("recall")).alias("name"), F.max("recall").alias("recall")).withColumn("build", F.col("recall") >= floor)
