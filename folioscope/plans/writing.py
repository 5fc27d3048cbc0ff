"""Pages written over stored ones: who is stamped as superseded, and what the resulting texts link to in vain."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import gate, links
from folioscope.plans.registry import query
from folioscope.plans.retrieval import read


def _written(spark, sf_dir):
    """The documents' pages after a second round of writing.

    Stored are all but each fourth one, with a section that links to a lost page. All are written again with another section; each
    third one supersedes the page of the next number, where that is stored.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[#`\[\]~\s]+", " ").alias("text"))
    d, name = F.col("doc_id"), lambda n: F.concat(F.lit("doc-"), n.cast("string"))
    i, none = d.cast("string"), F.array().cast("array<string>")
    stored = docs.where(d % 4 != 0)
    next_one = stored.select((d - 1).alias("doc_id"), F.lit(True).alias("has_next"))
    base = [F.lit("a title").alias("title"), F.lit("bug").alias("kind"), F.array(F.lit("a.py")).alias("sources")]
    old = F.concat(F.lit("## Old\n\nsee [[lost-"), i, F.lit("]] and `[[code]]` "), F.col("text"), F.lit("\n"))
    new = F.concat(F.lit("## New\n\nsee [[gone-"), (d % 7).cast("string"), F.lit("|it]], [["), name(d), F.lit("]] and [[gone-"), (d % 7).cast("string"), F.lit("]]\n"))
    before = stored.select(name(d).alias("slug"), old.alias("body"), *base, none.alias("supersedes"), F.lit("then").alias("created"), F.lit("then").alias("updated"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("superseded_by"))
    coming = docs.join(next_one, "doc_id", "left").select(name(d).alias("slug"), new.alias("body"), *base, F.when((d % 3 == 0) & F.col("has_next"), F.array(name(d + 1))).otherwise(none).alias("supersedes"))
    return gate.upserted(before, coming, "now")


@query("stamped_pages", """SELECT 'doc-' || doc_id AS slug, CASE WHEN doc_id % 4 = 0 THEN 'create' ELSE 'merge' END AS mode, CASE WHEN by_ THEN 'superseded' END AS status, CASE WHEN by_ THEN 'doc-' || (doc_id - 1) END AS superseded_by
FROM (SELECT doc_id, doc_id % 3 = 1 AND doc_id % 4 <> 0 AND doc_id - 1 IN (SELECT doc_id FROM documents) AS by_ FROM documents)""")
def stamped_pages(spark, sf_dir):
    """Pages that others replace carry their replacement's name."""
    return _written(spark, sf_dir).select("slug", "mode", "status", "superseded_by")


@query("write_warnings", """SELECT 'doc-' || doc_id AS slug, 'dangling_link' AS code, 'links to pages that don''t exist: ' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'lost-' || doc_id || ', ' END || 'gone-' || (doc_id % 7) AS line FROM documents""")
def write_warnings(spark, sf_dir):
    """Dangling links of the merged texts: those of kept sections and those that came in."""
    written = _written(spark, sf_dir)
    return links.warnings(written, written.select("slug")).select("slug", "code", "line")
