"""A second analyser beside the engine's own: words as a plain full-text index cuts them.

Letters and numbers make words, all else (underscores too) separates them; case and marks are dropped, and identifiers keep no parts.
Slug, title and body are fields of their own: the slug's words count in frequencies and lengths but weigh nothing.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import with_tokens
from folioscope.operators.index import Index, of_counts
from folioscope.storage import checked_broadcast, materialised

BETWEEN = r"[^\p{L}\p{N}]+"


def _unmarked() -> tuple[str, str]:
    """Letters below U+2000 that decompose into one and its marks, and what is left of each."""
    pairs = {}
    for n in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(n))
        rest = "".join(c for c in whole if unicodedata.category(c) != "Mn")
        if len(rest) == 1 and rest != chr(n):
            pairs[chr(n)] = rest
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _unmarked()


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), BETWEEN), "")


def build(pages: DataFrame, wanted: DataFrame | None = None) -> Index:
    """The index of pages (slug, title, body): title_tf and body_tf of their own fields; title_len counts the slug's words too.

    A page that has a word only in its slug has a posting without weight, so frequencies count it. With ``wanted`` (term, each once)
    postings and frequencies are those of these terms; lengths and averages are of whole pages all the same.
    """
    rows = pages.select("slug", tokens(F.col("title")).alias("_t"), tokens(F.col("body")).alias("_b"), tokens(F.col("slug")).alias("_s"))
    size = lambda c: F.size(c).cast("long")
    rows = rows.select("slug", (size("_t") + size("_s")).alias("title_len"), size("_b").alias("body_len"), size("_t").alias("_n"), F.concat("_t", "_b", "_s").alias("_all"))
    lengths = rows.select("slug", "title_len", "body_len")
    each = rows.select("slug", "title_len", "body_len", "_n", F.posexplode("_all").alias("pos", "term"))
    each = each if wanted is None else each.join(checked_broadcast(wanted), "term", "left_semi")
    in_title, in_body = F.col("pos") < F.col("_n"), (F.col("pos") >= F.col("_n")) & (F.col("pos") < F.col("_n") + F.col("body_len"))
    postings = each.groupBy("slug", "term").agg(F.count_if(in_title).alias("title_tf"), F.count_if(in_body).alias("body_tf"), F.max("title_len").alias("title_len"), F.max("body_len").alias("body_len"))
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("title_len"), F.lit(1.0)).alias("avg_title"), F.coalesce(F.avg("body_len"), F.lit(1.0)).alias("avg_body"))
    return Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), stats)


def asked(pages: DataFrame, terms: DataFrame) -> Index:
    """The index of pages as far as terms (qid, term) need it: their postings and the lengths are written once, all else is counted from those."""
    part = build(pages, terms.select("term").distinct())
    return of_counts(materialised(part.postings, "raw-postings"), materialised(part.lengths, "raw-lengths"))


def query_terms(queries: DataFrame, *, exact: bool = True, parts: bool = True) -> DataFrame:
    """(qid, term): the engine's distinct terms of each query (qid, q) that are letters and numbers only, then without marks.

    Two terms that differ in marks only become the same term twice, and count twice.
    """
    each = with_tokens(queries.select("qid", "q"), "q", "terms", exact=exact, parts=parts).select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    return each.where(~F.col("term").rlike(BETWEEN)).select("qid", folded(F.col("term")).alias("term")).where("term <> ''")
