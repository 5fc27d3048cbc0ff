"""The summary of an activity log that grows: batches become parts that can be added, each batch counts once.

A batch's part is a table (kind, key, n): counts of searches, misses, writes and refusals, sessions and writing sessions by name,
writes by length. Parts of all batches, added by kind and key, give the same row as the summary of the whole log. A batch is
written aside and then named under its number, which no second file can take: batches that a restarted stream brings again, or
that two attempts write, count once. ``fold`` adds up what is there, so a reader adds few tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.logstats import ratio
from folioscope.storage import names_in, put_new_text, read_text

PART = "kind string, key string, n long"
COUNTED = ("searches", "misses", "writes", "rejects", "attributed_writes")


def parts(events: DataFrame, *, search: str = "search", write: str = "write", reject: str = "reject") -> DataFrame:
    """(kind, key, n) of events (event, session, hits, chars)."""
    event, session = F.col("event"), F.nullif(F.col("session").cast("string"), F.lit(""))
    searched, wrote = F.coalesce(event == search, F.lit(False)), F.coalesce(event == write, F.lit(False))
    one = lambda kind, when, key=None: F.when(when, F.struct(F.lit(kind).alias("kind"), (F.lit(None) if key is None else key).cast("string").alias("key")))
    entries = [
        one("searches", searched), one("misses", searched & (F.coalesce("hits", F.lit(0)) == 0)), one("writes", wrote), one("rejects", event == reject), one("attributed_writes", wrote & session.isNotNull()),
        one("session", session.isNotNull(), session), one("writer", wrote & session.isNotNull(), session), one("length", wrote, F.coalesce("chars", F.lit(0))),
    ]
    each = events.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return each.groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def added(part: DataFrame) -> DataFrame:
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def summary_of(part: DataFrame) -> DataFrame:
    """One row with the columns of ``logstats.summary`` of parts, added or not."""
    of = lambda kind: F.col("kind") == kind
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("n"))), F.lit(0)).alias(kind)
    length: Column = F.percentile(F.when(of("length"), F.col("key").cast("double")), 0.5, F.when(of("length"), F.col("n")).otherwise(F.lit(0)))
    out = added(part).agg(
        *(total(k) for k in COUNTED[:4]), F.count_if(of("session")).alias("sessions"), F.count_if(of("writer")).alias("writing_sessions"), total("attributed_writes"),
        F.coalesce(F.floor(length), F.lit(0)).cast("long").alias("median_chars"),
    )
    return out.withColumns({"miss_rate": ratio(F.col("misses"), F.col("searches")), "reject_rate": ratio(F.col("rejects"), F.col("writes") + F.col("rejects")), "writes_per_session": ratio(F.col("attributed_writes"), F.col("sessions"))})


# --- what is stored --------------------------------------------------------------------------


def _base(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The last fold: its number, its folder and the last batch it holds."""
    names = [n for n, _ in names_in(spark, f"{path}/folds") if n.endswith(".json")]
    return (int(names[-1].removesuffix(".json")), json.loads(read_text(spark, f"{path}/folds/{names[-1]}"))) if names else (0, {"folder": None, "upto": -1})


def _batches(spark: SparkSession, path: str, after: int) -> list[tuple[int, str]]:
    """Numbers and folders of the batches that count, beyond those in the base."""
    names = [n for n, _ in names_in(spark, f"{path}/batches") if n.endswith(".json") and int(n.removesuffix(".json")) > after]
    return [(int(n.removesuffix(".json")), read_text(spark, f"{path}/batches/{n}")) for n in names]


def add(events: DataFrame, number: int, path: str, **names: str) -> bool:
    """Adds a batch of events; False if its number was added before."""
    spark = events.sparkSession
    if number <= _base(spark, path)[1]["upto"] or any(n == f"{number:012d}.json" for n, _ in names_in(spark, f"{path}/batches")):
        return False
    folder = f"{path}/parts/{uuid.uuid4().hex}"
    parts(events, **names).write.parquet(folder)
    return put_new_text(spark, f"{path}/batches/{number:012d}.json", folder)


def stored_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all batches added so far."""
    base = _base(spark, path)[1]
    folders = [f for _, f in _batches(spark, path, base["upto"])] + ([base["folder"]] if base["folder"] else [])
    return spark.read.schema(PART).parquet(*folders) if folders else spark.createDataFrame([], PART)


def fold(spark: SparkSession, path: str) -> bool:
    """Adds up the batches without a gap after the base into a new base; False if there are none or another fold came first."""
    number, base = _base(spark, path)
    new, upto = [], base["upto"]
    for n, folder in _batches(spark, path, upto):
        if n != upto + 1:
            break
        new.append(folder)
        upto = n
    if not new:
        return False
    folder = f"{path}/parts/{uuid.uuid4().hex}"
    added(spark.read.schema(PART).parquet(*new, *([base["folder"]] if base["folder"] else []))).write.parquet(folder)
    return put_new_text(spark, f"{path}/folds/{number + 1:012d}.json", json.dumps({"folder": folder, "upto": upto}))


def adder(path: str, *, every: int = 16, **names: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds each batch and folds after so many."""

    def run(batch: DataFrame, number: int) -> None:
        add(batch, number, path, **names)
        if (number + 1) % every == 0:
            fold(batch.sparkSession, path)

    return run


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of all that was added so far, as ``logstats.summary`` gives it."""
    return summary_of(stored_parts(spark, path))
