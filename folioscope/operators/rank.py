"""Ranking: BM25F, full-text BM25, baselines, the total order, lifts and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import BETWEEN, path_prefixes, with_tokens
from folioscope.operators.index import Index
from folioscope.storage import checked_broadcast, materialised

#: Letters of a term by which pages' words are looked up in substring search.
GRAM = 3
K1, B, TITLE = 1.2, 0.75, 5.0
DEMOTED = 0.5
#: Pairs of query and page that one task sums at most, so that its memory doesn't grow with the tables.
PAIRS = 2_000_000


def query_terms(queries: DataFrame, *, exact: bool = True, parts: bool = True) -> DataFrame:
    """(qid, term): the distinct terms of each query (qid, q)."""
    return with_tokens(queries.select("qid", "q"), "q", "terms", exact=exact, parts=parts).select("qid", F.explode(F.array_distinct("terms")).alias("term"))


def _summed(index: Index, terms: DataFrame, part: Column) -> DataFrame:
    """(qid, slug, score): what a query's terms contribute to a page, summed; ``part`` takes a posting, its df and the corpus averages.

    A posting is weighed once and goes to its page's task once, however many queries have its term. There it meets the
    queries, and a page's sums are made where they are: no pair of query and page is shuffled.
    """
    asked = index.df.join(checked_broadcast(terms.select("term").distinct()), "term", "left_semi")
    rows = index.postings.join(checked_broadcast(asked), "term").join(F.broadcast(index.stats)).select("slug", "term", part.alias("_part"))  # one row
    return by_page(rows, index, terms).join(checked_broadcast(terms), "term").groupBy("qid", "slug").agg(F.sum("_part").alias("score"))


def by_page(postings: DataFrame, index: Index, terms: DataFrame) -> DataFrame:
    """Postings dealt out by slug, to as many tasks as the pairs of the index's pages with the queries of terms (qid) need."""
    spark = postings.sparkSession
    most = -(-index.stats.first()["n"] * terms.select("qid").distinct().count() // PAIRS)
    return postings.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), most), "slug")


def bm25f(index: Index, terms: DataFrame, *, title_weight: float = TITLE) -> DataFrame:
    """(qid, slug, score): saturation once over the weighted fields, idf always positive."""
    norm = lambda size, mean: 1 - B + B * F.when(mean > 0, size / mean).otherwise(1.0)
    tf = title_weight * F.col("title_tf") / norm(F.col("title_len"), F.col("avg_title")) + F.col("body_tf") / norm(F.col("body_len"), F.col("avg_body"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _summed(index, terms, idf * tf / (K1 + tf))


def fts_bm25(index: Index, terms: DataFrame, *, title_weight: float = TITLE) -> DataFrame:
    """(qid, slug, score) of the full-text formula: one length over both fields, idf floored at 1e-6, factor k1 + 1."""
    tf = title_weight * F.col("title_tf") + F.col("body_tf")
    size = F.col("title_len") + F.col("body_len")
    mean = F.col("avg_title") + F.col("avg_body")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return _summed(index, terms, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))


def term_count(index: Index, terms: DataFrame) -> DataFrame:
    """(qid, slug, score): plain occurrences of the query's terms."""
    return _summed(index, terms, F.col("title_tf") + F.col("body_tf")).withColumn("score", F.col("score").cast("double"))


def grep_or(pages: DataFrame, terms: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, slug): pages that contain a term anywhere, as a substring of the lower-cased text; with ``k`` the first k slugs of each query.

    A term has no separators, so it stands within one of the page's words.  Words are looked up by the first GRAM letters
    of a term, of which each different word has few, and only then compared. A query's first k slugs are among the first k of
    its terms, and those among the first k of the words that hold the term: no word, term or query keeps more.
    """
    text = F.lower(F.concat_ws(" ", "title", "slug", "body"))
    words = pages.select("slug", F.explode(F.array_distinct(F.array_remove(F.split(text, BETWEEN), ""))).alias("word"))
    if k is not None:
        first = words.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("slug"))).where(F.col("_r") <= k)
        words = materialised(first.groupBy("word").agg(F.collect_list("slug").alias("slugs")), "words")
    length = F.least(F.length("term"), F.lit(GRAM))
    asked = terms.select("term").distinct().select("term", F.substr(F.col("term"), F.lit(1), length).alias("gram"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - n + 1)), lambda i: F.substr(F.col("word"), i, F.lit(n)))
    each = words if k is not None else words.select("word").distinct()
    by = each.select("*", F.explode(F.array_distinct(F.concat(*(grams(n) for n in range(1, GRAM + 1))))).alias("gram"))
    found = by.join(checked_broadcast(asked), "gram").where(F.contains("word", F.col("term")))
    if k is None:
        found = words.join(found.select("word", "term").distinct(), "word").select("slug", "term").distinct()
        return found.join(checked_broadcast(terms), "term").select("qid", "slug").distinct()
    found = found.select("term", F.explode("slugs").alias("slug")).distinct()
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy("slug"))).where(F.col("_r") <= k)
    return top(found.join(checked_broadcast(terms), "term").select("qid", "slug").distinct(), k, [F.asc("slug")]).select("qid", "slug")


def top(scored: DataFrame, k: int | None, order: list[Column] | None = None) -> DataFrame:
    """The k best per qid (None: all) with their rank; by default by score (six decimals, higher first), then slug."""
    by = Window.partitionBy("qid").orderBy(*(order or [F.desc(F.round("score", 6)), F.asc("slug")]))
    ranked = scored.withColumn("rank", F.row_number().over(by))
    return ranked if k is None else ranked.where(F.col("rank") <= max(k, 0))


def total_order() -> list[Column]:
    """Touched pages first, then score, then the newer, then the slug."""
    return [F.desc("touched"), F.desc(F.round("score", 6)), F.desc("updated"), F.asc("slug")]


def demoted(score: Column, superseded_by: Column) -> Column:
    return F.when(superseded_by.isNotNull() & (superseded_by != ""), score * DEMOTED).otherwise(score)


def touched_paths(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, slug, touching): the wanted paths (qid, path) that a page's sources are or lie below, sorted.

    A source is given with each directory above it, which makes the prefix test an equality and the join a hash join.
    """
    sources = pages.select("slug", F.explode("sources").alias("source")).select("slug", F.explode(path_prefixes(F.col("source"))).alias("_key")).distinct()
    asked = wanted.select("qid", "path", F.regexp_replace("path", "/+$", "").alias("_key"))
    return sources.join(asked, "_key").groupBy("qid", "slug").agg(F.array_sort(F.collect_set("path")).alias("touching"))


def touching(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, slug): pages one of whose sources is a wanted path (qid, path) or lies below it."""
    return touched_paths(pages, wanted).select("qid", "slug")


def chain_ends(pointers: DataFrame) -> DataFrame:
    """(slug, root): where the chain of pointers (slug, next) that begins at a page ends; pages of and before circles have none.

    Pointers double in length with each step, which is written to the shared folder.
    """
    state = materialised(pointers.select("slug", F.col("next").alias("root"), F.col("next").alias("jump")), "chains")
    for _ in range(state.count().bit_length() + 1):
        if state.where("jump is not null").isEmpty():
            break
        above = state.select(F.col("slug").alias("jump"), F.col("root").alias("_root"), F.col("jump").alias("_jump"))
        rows = state.join(above, "jump", "left")
        state = materialised(rows.select("slug", F.coalesce("_root", "root").alias("root"), F.when(F.col("_root").isNotNull(), F.col("_jump")).alias("jump")), "chains")
    ends = state.where("jump is null").select("slug", "root")
    return ends.union(ends.select(F.col("root").alias("slug"), "root").distinct().join(state.select("slug"), "slug", "left_anti"))


def tree_roots(pointers: DataFrame) -> DataFrame:
    """(slug, tree) of pages (slug, superseded_by): the newest page of the tree of replacements that a page is in, for pages in one.

    A tree here is one of all pages; what of it a query finds may fall into several. Pages of circles, and those that lead into
    one, are all in the tree "", so no tree is ever cut.
    """
    rows = materialised(pointers.select("slug", F.col("superseded_by").alias("next")).where("next <> '' and next <> slug"), "pointers")
    ends = chain_ends(rows)
    return rows.select("slug").union(rows.select("next")).distinct().join(ends, "slug", "left").select("slug", F.when(F.col("root").isNull(), "").otherwise(F.concat(F.lit("="), F.col("root"))).alias("tree"))


def lifted_top(hits: DataFrame, k: int, order: list[Column], roots: DataFrame | None = None) -> DataFrame:
    """The first k of hits (qid, slug, superseded_by and what the order takes) after the lift, with ``rank`` and ``lifted``; without a ranking of all hits.

    A tree's place is that of its best page, so the first k places go to trees that hold one of the first k hits. Those hits
    are found with k rows a query and task; of the others only what is in their trees (``roots``, as ``tree_roots`` gives them)
    is brought and ordered. Ranks beyond k are places among these. Hits are made once, and written. Without roots these are
    taken from the hits' own pointers.
    """
    if k < 1:
        return lifted(top(hits, 0, order), 0)
    hits = materialised(hits, "hits")
    roots = tree_roots(hits.select("slug", "superseded_by").distinct()) if roots is None else roots
    first = materialised(top(hits, k, order).select("qid", "slug"), "first")
    trees = first.join(roots, "slug").select("qid", "tree").distinct()  # a page without pointers is a tree of its own
    wanted = materialised(first.union(trees.join(roots, "tree").select("qid", "slug")).distinct(), "wanted")
    members = hits.join(checked_broadcast(wanted), ["qid", "slug"], "left_semi")
    return lifted(top(members, None, order), k)


def lifted(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """Hits (qid, slug, rank, superseded_by) in the order that puts a replacement just above what it replaces, as ``lifted``.

    In the hit list the pointers form a forest.  A hit's place is the least rank of all that lead to it, and within a
    tree its distance to the newest page comes next; pointers to pages outside the list end there.  Chains are followed
    to their end by doubling: each step, written to the shared folder, makes the pointers twice as long.  With ``k`` the
    first k of each query are returned, and only the trees are followed that hold one of the first k ranks: all that
    comes before them in the result holds one too.  Pointers in a circle have no newest page; they end after as many
    steps as a chain of all pointers would take.
    """
    ranked = materialised(ranked, "ranked")
    hits = ranked.select("qid", "slug", "rank")
    names = hits.select("qid", F.col("slug").alias("superseded_by"))
    links = ranked.where("superseded_by <> slug").join(names, ["qid", "superseded_by"], "left_semi").select("qid", "slug", F.col("rank").alias("low"), F.col("superseded_by").alias("jump"), F.lit(1).cast("long").alias("depth"))
    if k is not None:
        links = materialised(links, "links")
        ends = chain_ends(links.select("slug", F.col("jump").alias("next")).distinct())
        known = links.join(ends, "slug", "left")
        first = hits.where(F.col("rank") <= k).join(ends, "slug").select("qid", "root").distinct()
        links = known.join(first, ["qid", "root"], "left_semi").drop("root").unionByName(known.where("root is null").drop("root"))
    links = materialised(links, "links")
    ends = links.select("qid", F.col("jump").alias("slug")).distinct().join(links, ["qid", "slug"], "left_anti").join(hits, ["qid", "slug"])
    # low: the least rank of those less than so many steps below; jump: the page so many steps above; depth: steps to it, or to the end
    state = materialised(links.union(ends.select("qid", "slug", "rank", F.lit(None).cast("string"), F.lit(0).cast("long"))), "lift")
    for _ in range(links.count().bit_length() + 1):
        moving = state.where("jump is not null")
        if moving.isEmpty():
            break
        above = state.select("qid", F.col("slug").alias("jump"), F.col("jump").alias("_jump"), F.col("depth").alias("_depth"))
        below = moving.groupBy("qid", F.col("jump").alias("slug")).agg(F.min("low").alias("_low"))
        rows = state.join(above, ["qid", "jump"], "left").join(below, ["qid", "slug"], "left")
        state = materialised(rows.select("qid", "slug", F.least("low", "_low").alias("low"), F.col("_jump").alias("jump"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "lift")
    places = state.select("qid", "slug", F.col("low").alias("_key"), F.col("depth").alias("_depth"))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k).union(ranked.where(F.col("rank") > k).join(places, ["qid", "slug"], "left_semi").select(ranked.columns))
    out = ranked.join(places, ["qid", "slug"], "left")
    by = Window.partitionBy("qid").orderBy(F.coalesce("_key", "rank"), F.coalesce("_depth", F.lit(0)), "rank")
    out = out.withColumn("lifted", F.row_number().over(by)).drop("_key", "_depth")
    return out if k is None else out.where(F.col("lifted") <= k)


def fused(first: DataFrame, second: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, slug, rank from 1): the k best; ties by the first list's order."""
    a = first.select("qid", "slug", F.col("rank").alias("ra"))
    b = second.select("qid", "slug", F.col("rank").alias("rb"))
    both = a.join(b, ["qid", "slug"], "full")
    part = lambda r: F.coalesce(1 / (constant + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", part("ra") + part("rb"))
    return top(both, k, [F.desc(F.round("score", 9)), F.asc_nulls_last("ra"), F.asc_nulls_last("rb"), F.asc("slug")]).select("qid", "rank", "slug", "score")
