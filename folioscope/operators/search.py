"""Search as a user meets it: ranked hits with what is to be said of them, thin pages told apart, one page shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import effective_date, snippet
from folioscope.operators import links, rank
from folioscope.operators.gate import THIN, is_thin
from folioscope.operators.index import Index
from folioscope.storage import checked_broadcast

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def matches(index: Index, pages: DataFrame, queries: DataFrame, wanted: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """(qid, slug, score, touching, touched, thin, updated, superseded_by): all pages that a query's words or paths find.

    pages: slug, body (or thin, where that is known), updated, created, superseded_by and, where paths are wanted (qid, path), sources.  A page that a
    path touches is found without any word, at score 0; a query without words and paths finds nothing.
    scored: the queries' scores as ``rank.bm25f`` gives them, if they are known.
    """
    found = (rank.bm25f(index, rank.query_terms(queries, parts=index.parts)) if scored is None else scored).where("score > 0")
    if wanted is not None:
        found = found.join(rank.touched_paths(pages, wanted), ["qid", "slug"], "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        found = found.withColumn("touching", F.lit(None).cast(_NONE))
    thin = F.col("thin") if "thin" in pages.columns else is_thin(F.col("body"))
    own = pages.select("slug", thin.alias("thin"), effective_date(F.col("updated"), F.col("created")).alias("updated"), "superseded_by")
    rows = found.join(own, "slug").withColumn("touched", F.col("touching").isNotNull())
    return rows.withColumns({"touching": F.coalesce("touching", _empty()), "score": rank.demoted(F.col("score"), F.col("superseded_by"))})


def hits(found: DataFrame, k: int = 10, roots: DataFrame | None = None) -> DataFrame:
    """The first k hits of each query by the total order, replacements lifted; thin pages are none.

    roots: ``rank.tree_roots`` of the pages; without them they are taken from the hits' own pointers.
    """
    return rank.lifted_top(found.where(~F.col("thin")), k, rank.total_order(), roots).drop("rank").withColumnRenamed("lifted", "rank").select("qid", "rank", "slug", "score", "updated", "superseded_by", "touching")


def skipped(found: DataFrame) -> DataFrame:
    """(qid, n, slugs, line): the thin pages that a query found, and how it is told."""
    rows = found.where("thin").groupBy("qid").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("slug")).alias("slugs"))
    line = F.concat(F.lit("skipped "), F.col("n").cast("string"), F.lit(f" page(s) under {THIN} characters: "), F.array_join("slugs", ", "))
    return rows.withColumn("line", line)


def described(found: DataFrame, pages: DataFrame, terms: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """Hits with title, snippet, sources and, from ``freshness.drift``, stale_sources and gone_sources."""
    asked = terms.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    rows = pages.select("slug", "title", "body", F.coalesce("sources", _empty()).alias("sources")).join(checked_broadcast(found), "slug").join(checked_broadcast(asked), "qid", "left")
    rows = rows.withColumn("snippet", snippet(F.col("body"), F.coalesce("_terms", _empty()))).drop("body", "_terms")
    if drift is None:
        return rows.withColumns({"stale_sources": _empty(), "gone_sources": _empty()})
    rows = rows.join(drift.select("slug", "changed", "gone"), "slug", "left")
    return rows.withColumns({"stale_sources": F.coalesce("changed", _empty()), "gone_sources": F.coalesce("gone", _empty())}).drop("changed", "gone")


def line() -> Column:
    """A described hit as one line; its marks stand in a fixed order: touches, no sources, superseded, source changed, source gone."""
    listed = lambda c, mark: F.when(F.size(c) > 0, F.concat(F.lit(mark), F.array_join(c, ", ")))
    marks = F.concat_ws(
        "", listed("touching", "  ▸ touches "), F.when(F.size("sources") == 0, "  ⚠ no sources"), F.when(F.coalesce("superseded_by", F.lit("")) != "", F.concat(F.lit("  ⚠ superseded by "), F.col("superseded_by"))),
        listed("stale_sources", "  ⚠ source changed: "), listed("gone_sources", "  ⚠ source gone: "),
    )
    return F.concat(F.concat_ws("  —  ", "slug", "title", "snippet"), F.format_string("   [%.1f] ", "score"), F.col("updated"), marks)


def as_json() -> Column:
    """A described hit as JSON, its score rounded to three decimals."""
    return F.to_json(F.struct("slug", "title", F.round("score", 3).alias("score"), "updated", "superseded_by", "sources", "touching", "stale_sources", "gone_sources"), {"ignoreNullFields": "false"})


def cards(described: DataFrame) -> DataFrame:
    """(qid, rank, slug, title, snippet) in order."""
    return described.select("qid", "rank", "slug", "title", "snippet").orderBy("qid", "rank")


def shown(pages: DataFrame, wanted: DataFrame, edges: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """(slug, known, notices): what is said beside each wanted page (slug): its replacement, who links to it, sources that moved.

    pages: slug, superseded_by; edges: src, dst.  A slug that no page has is not known and has one notice.
    """
    own = pages.select("slug", "superseded_by").withColumn("known", F.lit(True))
    rows = wanted.select("slug").distinct().join(own, "slug", "left").join(links.backlinks(edges, pages).select(F.col("dst").alias("slug"), "sources"), "slug", "left")
    rows = rows.join(drift.select("slug", "changed", "gone"), "slug", "left") if drift is not None else rows.withColumns({"changed": _empty(), "gone": _empty()})
    listed = lambda c, mark: F.when(F.size(F.coalesce(c, _empty())) > 0, F.concat(F.lit(mark), F.array_join(c, ", ")))
    notices = F.array_compact(F.array(
        F.when(F.col("known").isNull(), F.concat(F.lit("no page is called "), F.col("slug"))),
        F.when(F.coalesce("superseded_by", F.lit("")) != "", F.concat(F.lit("superseded by "), F.col("superseded_by"), F.lit(": read that first"))),
        listed("sources", "linked from: "), listed("changed", "source changed: "), listed("gone", "source gone: "),
    ))
    return rows.select("slug", F.coalesce("known", F.lit(False)).alias("known"), notices.alias("notices"))


def removed(pages: DataFrame, gone: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """(pages that stay, events of those removed): gone has the slugs; those that no page has leave no event."""
    slugs = gone.select("slug").distinct()
    events = pages.join(slugs, "slug", "left_semi").select(F.lit(ts).alias("ts"), F.lit("remove").alias("event"), "slug")
    return pages.join(slugs, "slug", "left_anti").select(pages.columns), events


def edited(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slug, changed, thin): pages (slug, text, body) after an edit; thin ones are no longer found, and only changed ones say so."""
    rows = before.select("slug", F.col("text").alias("_old")).join(after, "slug")
    changed = ~F.col("_old").eqNullSafe(F.col("text"))
    return rows.select("slug", changed.alias("changed"), (changed & is_thin(F.col("body"))).alias("thin"))


def starting(pages: DataFrame, prefix: str) -> DataFrame:
    """Pages whose slug begins so, in order."""
    return pages.where(F.col("slug").startswith(prefix)).orderBy("slug")
