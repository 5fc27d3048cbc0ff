"""One-hop probes of an import graph: edges (src, dst) between files, citations (slug, source) of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.storage import materialised


def in_degree(edges: DataFrame) -> DataFrame:
    """(dst, degree): different importers."""
    return edges.where("src <> dst").select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, cap: int | None) -> DataFrame:
    """(file, other): undirected neighbours whose in-degree is at most the cap."""
    both = edges.where("src <> dst").select("src", "dst").union(edges.where("src <> dst").select("dst", "src")).distinct().toDF("file", "other")
    if cap is None:
        return both
    hubs = in_degree(edges).where(F.col("degree") > cap).select(F.col("dst").alias("other"))
    return both.join(hubs, "other", "left_anti").select("file", "other")


def reach(files: DataFrame, edges: DataFrame, citations: DataFrame, cap: int | None) -> DataFrame:
    """(file, n_pages): the pages that an uncited file's neighbours are cited by, 0 where there are none."""
    cited = citations.select(F.col("source").alias("other"), "slug").distinct()
    uncited = files.select(F.col("path").alias("file")).distinct().join(cited.select(F.col("other").alias("file")), "file", "left_anti")
    found = uncited.join(neighbours(edges, cap), "file").join(cited, "other").groupBy("file").agg(F.count_distinct("slug").alias("n_pages"))
    return uncited.join(found, "file", "left").select("file", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def leave_one_out(edges: DataFrame, citations: DataFrame, cap: int | None) -> DataFrame:
    """(slug, source, found): whether a page that cites two files or more is found from one through the neighbours it cites too."""
    cited = citations.select("slug", "source").distinct()
    several = cited.groupBy("slug").agg(F.count("*").alias("n")).where("n >= 2").select("slug")
    rows = cited.join(several, "slug", "left_semi")
    near = rows.join(neighbours(edges, cap), F.col("source") == F.col("file")).select("slug", "source", "other")
    hit = near.join(cited.select("slug", F.col("source").alias("other")), ["slug", "other"], "left_semi").select("slug", "source").distinct().withColumn("_f", F.lit(True))
    return rows.join(hit, ["slug", "source"], "left").select("slug", "source", F.coalesce("_f", F.lit(False)).alias("found"))


#: Hub caps that a probe tries in turn (None: no cap), and what a cap must reach to pass.
CAPS = (None, 10, 5)
REACH, RECALL, GROUP = 0.2, 0.5, 3


def median_and_p90(groups: DataFrame, size: str, times: str | None = None) -> DataFrame:
    """One row (n, median, p90) of sizes, by counts of equal ones; the last by the exclusive rule. ``times``: how often a row counts."""
    counts = groups.groupBy(F.col(size).alias("v")).agg((F.count("*") if times is None else F.sum(times)).alias("k"))
    ranked = counts.withColumn("upto", F.sum("k").over(Window.orderBy("v")))  # one row for each different size
    total = ranked.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n"))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
    n = F.col("n")
    place = F.greatest(F.lit(1.0), F.least(n.cast("double"), 0.9 * (n + 1)))
    low = F.floor(place)
    out = total.join(F.broadcast(ranked), how="left").groupBy("n").agg(at(F.floor((n + 1) / 2)).alias("m1"), at(F.floor((n + 2) / 2)).alias("m2"), at(low).alias("a"), at(F.least(low + 1, n)).alias("b"))
    none = F.col("n") == 0
    return out.select("n", F.when(none, 0.0).otherwise((F.col("m1") + F.col("m2")) / 2).alias("median"), F.when(none, 0.0).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (place - low)).alias("p90"))


def _least(edges: DataFrame, citations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, slug, low), (slug, source, low)): what ``reach`` and ``leave_one_out`` find, each with the least in-degree of a neighbour
    that leads there (null: none does). A cap finds what has a ``low`` of at most the cap, so one pass serves all caps."""
    cited = materialised(citations.select("slug", "source").distinct(), "cited")
    near = neighbours(edges, None).join(in_degree(edges).select(F.col("dst").alias("other"), "degree"), "other", "left").select("file", "other", F.coalesce("degree", F.lit(0)).alias("degree"))
    near = materialised(near, "neighbours")
    uncited = files.select(F.col("path").alias("file")).distinct().join(cited.select(F.col("source").alias("file")), "file", "left_anti")
    pages = near.join(cited.select(F.col("source").alias("other"), "slug"), "other").select("file", "slug", "degree")
    groups = uncited.join(pages, "file", "left").groupBy("file", "slug").agg(F.min("degree").alias("low"))
    several = cited.groupBy("slug").agg(F.count("*").alias("n")).where("n >= 2").select("slug")
    rows = cited.join(several, "slug", "left_semi")
    hit = rows.join(near, F.col("source") == F.col("file")).select("slug", "source", "other", "degree").join(cited.select("slug", F.col("source").alias("other")), ["slug", "other"], "left_semi")
    cases = rows.join(hit.groupBy("slug", "source").agg(F.min("degree").alias("low")), ["slug", "source"], "left")
    return groups, cases


def probe(files: DataFrame, edges: DataFrame, citations: DataFrame, caps: tuple = CAPS) -> DataFrame:
    """For each hub cap one row: coverage, reach, median and p90 of non-empty groups, leave-one-out recall and whether it passes.

    files: path; edges: src, dst; citations: slug, source (of current pages, sources that are files). Joins are made once for all caps.
    """
    cited = citations.select("source").distinct()
    shares = files.select("path").distinct().join(cited.withColumn("_c", F.lit(1)), F.col("path") == F.col("source"), "left").agg(F.coalesce(F.avg(F.coalesce("_c", F.lit(0))), F.lit(0.0)).alias("coverage"))
    within = lambda cap: F.col("low").isNotNull() if cap is None else F.coalesce(F.col("low") <= cap, F.lit(False))
    groups, cases = _least(edges, citations, files)
    groups = groups.groupBy("file").agg(*(F.count_if(within(cap)).alias(f"n{i}") for i, cap in enumerate(caps)))
    # what is left is one row for each combination of sizes
    groups = materialised(groups.groupBy(*(f"n{i}" for i in range(len(caps)))).agg(F.count("*").alias("_k")), "groups")
    found = materialised(cases.agg(F.count("*").alias("n_cases"), *(F.avg(within(cap).cast("double")).alias(f"r{i}") for i, cap in enumerate(caps))), "recall")
    shares, out = materialised(shares, "coverage"), None
    for i, cap in enumerate(caps):
        own = groups.select(F.col(f"n{i}").alias("n_pages"), "_k")
        sizes = median_and_p90(own.where("n_pages > 0"), "n_pages", "_k").select(F.col("median").alias("median_group"), F.col("p90").alias("p90_group"))
        reached = own.agg(F.coalesce(F.sum(F.when(F.col("n_pages") > 0, F.col("_k"))) / F.sum("_k"), F.lit(0.0)).alias("reach"))
        row = shares.join(reached).join(sizes).join(found.select("n_cases", F.col(f"r{i}").alias("recall"))).select(F.lit(i).alias("place"), F.lit("inf" if cap is None else str(cap)).alias("cap"), "coverage", "reach", "median_group", "p90_group", "n_cases", "recall")  # one row each
        out = row if out is None else out.union(row)
    passes = (F.col("reach") >= REACH) & (F.col("recall") >= RECALL) & (F.col("median_group") <= GROUP)
    return out.withColumn("passes", F.coalesce(passes, F.lit(False)))


def verdict(probed: DataFrame) -> DataFrame:
    """One row: the first cap that passes, or null."""
    return probed.agg(F.min_by("cap", F.when(F.col("passes"), F.col("place"))).alias("cap"), F.max("passes").alias("build")).select(F.when(F.col("build"), F.col("cap")).alias("cap"), "build")
