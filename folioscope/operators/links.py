"""Wiki links between pages: extraction outside of code, backlinks, dangling ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.markdown import links

@F.pandas_udf(T.ArrayType(T.StringType()))
def _links(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [] if b is None else links(b))


def edges(pages: DataFrame) -> DataFrame:
    """(src, pos, dst): one row per link; only bodies with an opening go to Python."""
    found = pages.where(F.contains("body", F.lit("[["))).select(F.col("slug").alias("src"), _links("body").alias("targets"))
    return found.select("src", F.posexplode("targets").alias("pos", "dst"))


def html_targets(html: Column) -> Column:
    """href values of a page's anchors, without the leading slash."""
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda x: x)


def backlinks(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(dst, n, sources): pages that others link to, with the sorted names of those, self-links apart."""
    real = edges.where("src <> dst").select("src", "dst").distinct().join(names.select(F.col("slug").alias("dst")).distinct(), "dst", "left_semi")
    return real.groupBy("dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("src")).alias("sources"))


def dangling(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, pos): targets that no page has, once each at their first place, self-links apart."""
    lost = edges.where("src <> dst").join(names.select(F.col("slug").alias("dst")).distinct(), "dst", "left_anti")
    return lost.groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def warnings(written: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, code, targets, line): links of written pages that no page has, in the text that results from writing, not only in what came in.

    written: what ``gate.upserted`` gives, of which rows with a mode were written; names: the store's pages and the new ones.
    Targets stand once each, in the order of their first places; pages without such links give no row.
    """
    lost = dangling(edges(written.where("mode is not null").select("slug", "body")), names)
    rows = lost.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("found"))
    targets = F.transform("found", lambda x: x["dst"])
    return rows.select(F.col("src").alias("slug"), F.lit("dangling_link").alias("code"), targets.alias("targets"), F.concat(F.lit("links to pages that don't exist: "), F.array_join(targets, ", ")).alias("line"))
