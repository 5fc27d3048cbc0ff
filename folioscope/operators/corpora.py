"""Corpora made for measurements: thin stubs beside real pages, pages repeated to a size, pages of an evaluation corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the share of stubs in the corpus that the gate was made for
STUBS = 104 / 495


def stubs(pages: DataFrame, *, share: float = STUBS) -> DataFrame:
    """Pages that only restate a title, one for each of the first round(n * share) pages (place from 0, slug, title)."""
    n = round(pages.count() * share)
    body = F.concat(F.lit("## Summary\n\nThis page documents "), F.lower("title"), F.lit(". See the implementation for details."))
    return pages.where(F.col("place") < n).select("place", F.concat("slug", F.lit("-summary")).alias("slug"), "title", body.alias("body"))


def stubs_for_share(template: DataFrame, n_pages: int, share: float) -> DataFrame:
    """As many stubs as make up a share of the store: the template's (place, slug, title, body) again and again, in rounds."""
    wanted, size = round(n_pages * share / (1 - share)), template.count()
    rounds = -(-wanted // size) if size else 0
    spark = template.sparkSession
    rows = template.join(F.broadcast(spark.range(rounds).withColumnRenamed("id", "_round")))  # as many rows as are wanted
    name = F.when(F.col("_round") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("_round").cast("string"), F.col("place").cast("string")))
    return rows.where(F.col("_round") * size + F.col("place") < wanted).select(name.alias("slug"), "title", "body")


def grown(pages: DataFrame, target: int) -> DataFrame:
    """Pages (place from 0, slug, title, body) repeated until there are ``target``, copies with the round behind their slug."""
    size = pages.count()
    rounds = -(-target // size) if size else 0
    rows = pages.join(F.broadcast(pages.sparkSession.range(rounds).withColumnRenamed("id", "_round")))  # as many rows as are wanted
    name = F.when(F.col("_round") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("_round").cast("string")))
    return rows.where(F.col("_round") * size + F.col("place") < target).select(name.alias("slug"), "title", "body")


def corpus_pages(entries: DataFrame, today: str) -> DataFrame:
    """Pages of an evaluation corpus (slug, title, kind, body, sources, supersedes) as a store has them, replaced ones stamped."""
    by = entries.select(F.col("slug").alias("_by"), F.explode("supersedes").alias("slug")).groupBy("slug").agg(F.min("_by").alias("superseded_by"))
    rows = entries.join(by, "slug", "left")
    return rows.select("slug", "title", "body", "kind", F.lit(today).alias("created"), F.lit(today).alias("updated"), F.when(F.col("superseded_by").isNotNull(), "superseded").alias("status"), "superseded_by", F.array_sort(F.array_distinct("sources")).alias("sources"), F.array_sort(F.array_distinct("supersedes")).alias("supersedes"))
