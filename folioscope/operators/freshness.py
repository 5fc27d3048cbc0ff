"""Staleness: sources that changed after the page that cites them, or are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_commits(commits: DataFrame) -> DataFrame:
    """(path, ct): the newest commit time of each path."""
    return commits.groupBy("path").agg(F.max("ct").alias("ct"))


def drift(pages: DataFrame, citations: DataFrame, commits: DataFrame | None, files: DataFrame) -> DataFrame:
    """(slug, changed, gone): sorted paths of sources newer than their page, strictly, and of those that don't exist.

    pages: slug, path, mtime; citations: slug, source.  A page's time is its last commit, else its mtime.  A source
    without commits never counts as changed.  commits is None where history can't be read: then nothing is told.
    """
    if commits is None:
        return pages.select("slug", F.array().cast("array<string>").alias("changed"), F.array().cast("array<string>").alias("gone")).limit(0)
    last = last_commits(commits)
    own = pages.join(last.withColumnRenamed("ct", "_page"), "path", "left").select("slug", F.coalesce("_page", "mtime").alias("page_ts"))
    there = files.select(F.col("path").alias("source")).distinct().withColumn("_there", F.lit(True))
    rows = citations.distinct().join(own, "slug").join(last.withColumnRenamed("path", "source").withColumnRenamed("ct", "source_ts"), "source", "left").join(there, "source", "left")
    gone = F.col("_there").isNull()
    changed = ~gone & F.coalesce(F.col("source_ts") > F.col("page_ts"), F.lit(False))
    out = rows.groupBy("slug").agg(F.array_sort(F.collect_set(F.when(changed, F.col("source")))).alias("changed"), F.array_sort(F.collect_set(F.when(gone, F.col("source")))).alias("gone"))
    return out.where((F.size("changed") > 0) | (F.size("gone") > 0))
