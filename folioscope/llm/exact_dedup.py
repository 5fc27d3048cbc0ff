"""Exact duplicates with frequent texts taken out first: a digest that very many rows share never meets in one task.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most
code points in the original text stays, then that with the smallest id (a null one last), then the first row.

1. Each text is read once, for its digest (SHA-256 of the normalised text) and length; only these go on.
2. ``freqItems``, Spark's mergeable Misra-Gries counters, names at most ``1 / support`` digests, among them each that more than
   the share ``support`` of all rows has. Its counts are too low, so the candidates' rows are counted again, exactly, with the
   row that stays: partial sums in each task, one row for each candidate. Those that are as frequent as that are the winners.
3. The winners, at most ``1 / support`` rows of fixed width, are broadcast: rows with their digests are decided where they are.
4. The remaining digests, each on at most that share of the rows, are dealt out by digest and ordered by a window.

Everything is DataFrame functions. Nothing is dropped for speed: any ``support`` gives the same result.

Cases: null texts count as empty and so equal texts of white space alone; null ids come last among equals; of repeated rows
exactly one stays; an empty table gives an empty frame; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import SPACES, materialised, with_row_keys

#: Share of all rows from which a digest is frequent: at most 10,000 are broadcast, 3 MB at most. It's the least that freqItems takes.
SUPPORT = 1e-4


def normalised(text: Column) -> Column:
    """The text without the characters of SPACES; bytes that aren't UTF-8 stay as they are."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _digests(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """``_row, _id, _digest`` and ``_rank``, the least of which stays among equal digests."""
    rank = F.struct((-F.length(F.coalesce(F.col(text), F.lit("")))).alias("short"), F.col(id_column).isNull().alias("unnamed"), F.col(id_column).alias("id"), F.col("_row").alias("row"))
    return materialised(rows.select(F.sha2(normalised(F.col(text)), 256).alias("_digest"), rank.alias("_rank")), "digests")


def frequent(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The winners: ``_digest, _first`` (the rank of the row that stays), ``_size``, for each digest that more than the share ``support`` of the rows has."""
    candidates = digests.freqItems(["_digest"], support).select(F.explode("_digest_freqItems").alias("_digest"))
    counted = digests.join(F.broadcast(candidates), "_digest").groupBy("_digest").agg(F.min("_rank").alias("_first"), F.count("*").alias("_size"))
    return materialised(counted.where((F.col("_size") > support * digests.count()) & (F.col("_size") > 1)), "winners")


def _decided(digests: DataFrame, support: float) -> DataFrame:
    """``_digest, _rank, _first, _size`` of every row."""
    winners = frequent(digests, support)
    removed = digests.join(F.broadcast(winners), "_digest")
    rest = digests.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    equal = Window.partitionBy("_digest")
    first = F.first("_rank").over(equal.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return removed.unionByName(rest.select("_digest", "_rank", first.alias("_first"), F.count("*").over(equal).alias("_size")))


def exact_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """Per row: the id, ``keep_id`` (of the row that stays), ``group_size``, ``kept``, ``text_sha256`` of the normalised text."""
    rows = _decided(_digests(with_row_keys(docs, "_row"), id_column, text), support)
    return rows.select(
        F.col("_rank.id").alias(id_column), F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_rank.row") == F.col("_first.row")).alias("kept"), F.col("_digest").alias("text_sha256")
    )


def without_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with their own columns. Copies of frequent texts go in the scan; only the keys of the others are joined."""
    rows = with_row_keys(docs, "_row")
    digests = _digests(rows, id_column, text)
    winners = frequent(digests, support)
    scanned = rows.withColumn("_digest", F.sha2(normalised(F.col(text)), 256)).join(F.broadcast(winners.select("_digest", F.col("_first.row").alias("_stays"))), "_digest", "left")
    scanned = scanned.where("_stays is null or _stays = _row")
    rest = digests.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    copies = rest.withColumn("_place", F.row_number().over(Window.partitionBy("_digest").orderBy("_rank"))).where("_place > 1").select(F.col("_rank.row").alias("_row"))
    return scanned.join(copies, "_row", "left_anti").select(docs.columns)
