"""Statistics of an activity log: rows with line_no (their order), ts (seconds), event, session and what an event carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Three decimals; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 3)


def median_floor(value: Column) -> Column:
    """The median rounded down; 0 of nothing."""
    return F.coalesce(F.floor(F.percentile(value, 0.5)), F.lit(0)).cast("long")


def repeats(events: DataFrame, within: int = 120) -> DataFrame:
    """The searches with ``repeat``: whether the same session had the same top result within so many seconds before.

    A missing session is one shared session, a missing top result never repeats.  So that a session with a great part of
    the log isn't one task's, its rows are dealt out by stretches of time: a repeat lies in a row's own stretch or the one
    before, whose rows come along as witnesses.
    """
    stretch = F.floor(F.col("ts") / F.lit(max(within, 1) * 16))
    rows = events.withColumns({"_stretch": stretch, "_own": F.lit(True)})
    late = F.col("ts") >= (F.col("_stretch") + 1) * F.lit(max(within, 1) * 16) - within
    witnesses = rows.where(late & F.col("top").isNotNull()).withColumns({"_stretch": F.col("_stretch") + 1, "_own": F.lit(False)})
    before = F.lag("ts").over(Window.partitionBy("session", "top", "_stretch").orderBy("ts", "line_no"))
    marked = rows.union(witnesses).withColumn("repeat", F.coalesce(F.col("top").isNotNull() & (F.col("ts") - before <= within), F.lit(False)))
    return marked.where("_own").drop("_stretch", "_own")


def most_common(events: DataFrame, code: Column, missing: str = "?") -> DataFrame:
    """(code, n, first_line): counts, the most common first, ties by first appearance."""
    return events.select(F.coalesce(code, F.lit(missing)).alias("code"), "line_no").groupBy("code").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")).orderBy(F.desc("n"), "first_line")


def via_breakdown(events: DataFrame) -> DataFrame:
    """(via, n): nothing if no record says where it came from, else also the unknown ones; cli, mcp, others, unknown."""
    counts = events.groupBy(F.coalesce("via", F.lit("unknown")).alias("via")).agg(F.count("*").alias("n"), F.max(F.col("via").isNotNull()).alias("some"))
    counts = counts.withColumn("some", F.max("some").over(Window.partitionBy(F.lit(1))))  # one row for each place
    order = F.when(F.col("via") == "cli", 0).when(F.col("via") == "mcp", 1).when(F.col("via") == "unknown", 3).otherwise(2)
    return counts.where("some").select("via", "n").orderBy(order, "via")


def searched_not_wrote(events: DataFrame, search: str, write: str) -> DataFrame:
    """Sessions (named ones) with searches and no write."""
    named = events.where("session is not null and cast(session as string) <> ''")
    return named.where(F.col("event") == search).select("session").distinct().join(named.where(F.col("event") == write).select("session").distinct(), "session", "left_anti")


def last(events: DataFrame, n: int = 15) -> DataFrame:
    """The last n rows in order of line; a limit by feature."""
    return events.orderBy(F.desc("line_no")).limit(n)


def span(events: DataFrame) -> DataFrame:
    """First and last timestamp in order of lines, and the number of rows."""
    return events.agg(F.min_by("ts", "line_no").alias("first_ts"), F.max_by("ts", "line_no").alias("last_ts"), F.count("*").alias("n"))


def summary(events: DataFrame, *, search: str = "search", write: str = "write", reject: str = "reject") -> DataFrame:
    """One row: counts by event, misses, ratios, sessions, median length of writes."""
    is_a = lambda e: F.col("event") == e
    named = F.when(F.col("session").isNotNull() & (F.col("session").cast("string") != ""), F.col("session"))
    miss = is_a(search) & (F.coalesce("hits", F.lit(0)) == 0)
    out = events.agg(
        F.count_if(is_a(search)).alias("searches"), F.count_if(miss).alias("misses"), F.count_if(is_a(write)).alias("writes"), F.count_if(is_a(reject)).alias("rejects"),
        F.count_distinct(named).alias("sessions"), F.count_distinct(F.when(is_a(write), named)).alias("writing_sessions"), F.count_if(is_a(write) & named.isNotNull()).alias("attributed_writes"),
        median_floor(F.when(is_a(write), F.coalesce("chars", F.lit(0)))).alias("median_chars"),
    )
    return out.withColumns({"miss_rate": ratio(F.col("misses"), F.col("searches")), "reject_rate": ratio(F.col("rejects"), F.col("writes") + F.col("rejects")), "writes_per_session": ratio(F.col("attributed_writes"), F.col("sessions"))})


def warning_codes(events: DataFrame, write: str = "write") -> DataFrame:
    """(code, n, first_line): warnings of writes (warnings: array), the most common first."""
    rows = events.where(F.col("event") == write).select("line_no", F.explode("warnings").alias("code"))
    return most_common(rows, F.col("code"))


def touching_counts(events: DataFrame, search: str = "search") -> DataFrame:
    """One row: searches with paths (touching), those of which it is known how many pages they touched, and those that touched none."""
    asked = (F.col("event") == search) & F.col("touching").isNotNull()
    return events.agg(F.count_if(asked).alias("touching_searches"), F.count_if(asked & F.col("touched").isNotNull()).alias("touching_measured"), F.count_if(asked & (F.col("touched") == 0)).alias("touching_misses"))


def modes(events: DataFrame, write: str = "write") -> DataFrame:
    """One row: writes by mode."""
    return events.where(F.col("event") == write).agg(*(F.count_if(F.col("mode") == m).alias(name) for name, m in (("creates", "create"), ("merges", "merge"), ("unchanged", "unchanged"))))
