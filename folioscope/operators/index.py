"""The inverted index as DataFrames: postings, lengths, document frequencies, corpus averages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import let, with_tokens


@dataclass(frozen=True)
class Index:
    """postings (term, slug, title_tf, body_tf, title_len, body_len), lengths (slug, title_len, body_len), df (term, df), stats (one row).

    A stored index also has a column ``tier`` in its postings, and tiers (term, tier, n, most, flat); see ``topk``. ``parts`` tells whether
    identifiers bring their parts; queries' terms are to be cut likewise.
    """

    postings: DataFrame
    lengths: DataFrame
    df: DataFrame
    stats: DataFrame
    tiers: DataFrame | None = None
    parts: bool = True


def tokenised(pages: DataFrame, *, exact: bool = True, parts: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(slug, title_tokens, body_tokens) of pages (slug, title, body); the title field is title and slug."""
    rows = pages.select("slug", *keep, F.concat_ws(" ", "title", "slug").alias("_title"), F.coalesce("body", F.lit("")).alias("_body"))
    return with_tokens(rows, "_title", "title_tokens", exact=exact, parts=parts, body_tokens="_body").select("slug", *keep, "title_tokens", "body_tokens")


def counts(title: Column, body: Column) -> Column:
    """Array of (term, title_tf, body_tf): each token of two arrays once, in order, with its number in either.

    Both are sorted as one, and a term's place is where its run begins, so a page is counted within its row, in the time of a sort.
    """
    mark = lambda tokens, own: F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(own).alias("in_body")))

    def runs(s: Column) -> Column:
        term = lambda i: F.get(s, i)["term"]
        begin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))

        def of(b: Column) -> Column:
            size = lambda at, j: F.coalesce(F.get(b, j + 1), F.size(s)) - at
            in_title = lambda at, n: F.size(F.filter(F.slice(s, at + 1, n), lambda x: ~x["in_body"]))
            each = F.transform(b, lambda at, j: F.struct(term(at).alias("term"), in_title(at, size(at, j)).alias("title_tf"), size(at, j).alias("tf")))
            return F.transform(each, lambda x: F.struct(x["term"].alias("term"), x["title_tf"].alias("title_tf"), (x["tf"] - x["title_tf"]).alias("body_tf")))

        none = F.array().cast("array<struct<term: string, title_tf: int, body_tf: int>>")
        return F.when(F.size(s) == 0, none).otherwise(let(begin, of))

    return let(F.sort_array(F.concat(mark(title, False), mark(body, True))), runs)


def of_tokens(rows: DataFrame, *, parts: bool = True) -> Index:
    """The index of tokenised pages.

    Both fields are counted in one aggregation, so what is shuffled is (term, slug) counts, which the map side combines.
    """
    sized = rows.withColumns({"title_len": F.size("title_tokens").cast("long"), "body_len": F.size("body_tokens").cast("long")})
    lengths = sized.select("slug", "title_len", "body_len")
    each = sized.select("slug", "title_len", "body_len", F.posexplode(F.concat("title_tokens", "body_tokens")).alias("pos", "term"))
    in_title = F.count_if(F.col("pos") < F.col("title_len"))
    postings = each.groupBy("slug", "term").agg(in_title.alias("title_tf"), (F.count("*") - in_title).alias("body_tf"), F.max("title_len").alias("title_len"), F.max("body_len").alias("body_len"))
    return of_counts(postings, lengths, parts=parts)


def of_counts(postings: DataFrame, lengths: DataFrame, *, parts: bool = True) -> Index:
    """The index of postings and lengths that are known."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("title_len"), F.lit(1.0)).alias("avg_title"), F.coalesce(F.avg("body_len"), F.lit(1.0)).alias("avg_body"))
    return Index(postings, lengths, df, stats, parts=parts)


def build(pages: DataFrame, *, exact: bool = True, parts: bool = True) -> Index:
    """Index of pages (slug, title, body), built whenever it is read; ``segments`` stores and updates one."""
    return of_tokens(tokenised(pages, exact=exact, parts=parts), parts=parts)


def merged(first: Index, second: Index) -> Index:
    """The index of two sets of different pages, both with or both without parts of identifiers."""
    if first.parts != second.parts:
        raise ValueError("one index has parts of identifiers, the other has none")
    stats = first.stats.union(second.stats).agg(F.sum("n").alias("n"), *(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n")), F.lit(1.0)).alias(c) for c in ("avg_title", "avg_body")))
    return Index(first.postings.drop("tier").unionByName(second.postings.drop("tier")), first.lengths.unionByName(second.lengths), first.df.union(second.df).groupBy("term").agg(F.sum("df").alias("df")), stats, parts=first.parts)


def fingerprint(files: DataFrame) -> str:
    """One digest of (path, modificationTime, length) of all page files, whatever their order."""
    row = files.select(F.xxhash64("path", F.col("modificationTime").cast("long"), "length").cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def store(index: Index, path: str, *, fingerprint: str, buckets: int = 32) -> None:
    """Writes an index as the only segment of a new version; see ``segments``."""
    from folioscope.operators import segments

    segments.store(index, path, fingerprint=fingerprint, buckets=buckets)


def stored(spark, path: str, *, fingerprint: str) -> Index | None:
    """The stored index if it is of this tokenizer and fingerprint, else None; see ``segments``."""
    from folioscope.operators import segments

    return segments.stored(spark, path, fingerprint=fingerprint)
