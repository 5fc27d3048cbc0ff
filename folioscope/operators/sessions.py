"""Metrics of agent sessions: searches, repeats, order of first search and first edit, verdicts, group summaries, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.stats import fisher, mann_whitney, newcombe, significant, wilson
from folioscope.storage import checked_broadcast

#: Metrics that are rates, and metrics that are numbers.
RATES = ("searched", "correct", "endorses_obsolete", "searched_before_edit", "used_touching", "wrote_page", "grep_memory", "read_memory_file")
NUMBERS = ("n_searches", "repeats", "num_turns", "total_cost_usd")


def steps(tools: DataFrame) -> DataFrame:
    """Of ordered tool calls (session, pos, is_search, is_edit, top) one row per session: counts, repeats and what came first.

    A repeat is a search whose top result was seen before in the session, whenever that was.
    """
    seen = F.row_number().over(Window.partitionBy("session", "is_search", "top").orderBy("pos")) > 1
    rows = tools.withColumn("repeat", F.col("is_search") & F.col("top").isNotNull() & seen)
    first = lambda c: F.min(F.when(F.col(c), F.col("pos")))
    out = rows.groupBy("session").agg(F.count_if("is_search").alias("n_searches"), F.count_if("repeat").alias("repeats"), F.count_if("is_edit").alias("n_edits"), first("is_search").alias("_s"), first("is_edit").alias("_e"))
    return out.select("session", (F.col("n_searches") > 0).alias("searched"), "n_searches", "repeats", "n_edits", F.when(F.col("_e").isNotNull(), F.coalesce(F.col("_s") < F.col("_e"), F.lit(False))).alias("searched_first"))


def metrics(calls: DataFrame, events: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per session of answers (session, kind, abstained, current, obsolete: booleans, null where not asked for).

    calls: session, pos, is_search, is_edit, scans, reads; events: session, line_no, event, top, touching of the log.  A
    correct answer is the current one; of a question without one, that it abstained.
    """
    first = lambda c: F.min(F.when(F.col(c), F.col("pos")))
    did = calls.groupBy("session").agg(first("is_search").alias("_s"), first("is_edit").alias("_e"), F.max("scans").alias("grep_memory"), F.max("reads").alias("read_memory_file"))
    is_a = lambda name: F.col("event") == name
    again = F.row_number().over(Window.partitionBy("session", "event", "top").orderBy("line_no")) > 1
    log = events.withColumn("_again", is_a("search") & F.col("top").isNotNull() & again)
    said = log.groupBy("session").agg(F.count_if(is_a("search")).alias("n_searches"), F.count_if("_again").alias("repeats"), F.max(is_a("search") & F.col("touching").isNotNull()).alias("used_touching"), F.count_if(is_a("write")).alias("n_writes"), F.count_if(is_a("reject")).alias("n_rejects"))
    rows = answers.join(did, "session", "left").join(said, "session", "left").fillna(0, ["n_searches", "repeats", "n_writes", "n_rejects"]).fillna(False, ["grep_memory", "read_memory_file", "used_touching"])
    searched = F.col("n_searches") > 0
    return rows.select(
        "session", searched.alias("searched"), "n_searches", "repeats", "used_touching", F.col("_e").isNotNull().alias("edited"),
        F.when(F.col("_e").isNotNull(), searched & F.coalesce(F.col("_s") < F.col("_e"), F.lit(False))).alias("searched_before_edit"), "grep_memory", "read_memory_file",
        (F.col("n_writes") > 0).alias("wrote_page"), "n_writes", "n_rejects", F.coalesce("current", F.when(F.col("kind") == "unanswerable", F.col("abstained"))).alias("correct"), "abstained",
        F.col("obsolete").alias("mentions_obsolete"), F.when(F.col("obsolete").isNotNull(), F.col("obsolete") & ~F.coalesce("current", F.lit(False))).alias("endorses_obsolete"),
    )


def model_of(reported: Column, requested: Column) -> Column:
    """The model that ran, else the one asked for, else ?."""
    return F.coalesce(F.nullif(reported, F.lit("")), F.nullif(requested, F.lit("")), F.lit("?"))


def rate(flag: Column, name: str) -> list[Column]:
    """Share of true among graded rows (null: not graded) with its count and Wilson interval, as aggregates."""
    k, n = F.count_if(flag), F.count(flag)
    low, high = wilson(k, n)
    return [n.alias(f"{name}_n"), F.round(F.try_divide(k, n), 6).alias(f"{name}_rate"), F.round(low, 6).alias(f"{name}_low"), F.round(high, 6).alias(f"{name}_high")]


def group_summary(sessions: DataFrame, by: list[str]) -> DataFrame:
    """By group: sessions, rates with intervals, mean repeats and the median of searches."""
    return sessions.groupBy(*by).agg(F.count("*").alias("n"), *rate(F.col("searched"), "searched"), *rate(F.col("searched_first"), "first"), F.round(F.avg("repeats"), 6).alias("mean_repeats"), F.percentile("n_searches", 0.5).alias("median_searches"))


def summary(sessions: DataFrame, by: list[str], rates: tuple[str, ...] = RATES) -> DataFrame:
    """By group (model, arm, task): sessions, errors, each rate with its interval, medians that skip nulls, mean repeats."""
    failed = F.coalesce("is_error", F.lit(False)) | F.coalesce("timed_out", F.lit(False))
    medians = {"median_searches": "n_searches", "median_turns": "num_turns", "median_cost": "total_cost_usd"}
    return sessions.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), *(c for r in rates for c in rate(F.col(r), r)), *(F.percentile(c, 0.5).alias(name) for name, c in medians.items()), F.round(F.avg(F.coalesce("repeats", F.lit(0))), 6).alias("mean_repeats"))


def environment(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: of each column its different values as sorted text, a missing one as None."""
    return rows.agg(*(F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("None")))).alias(c) for c in columns))


def compared(a: DataFrame, b: DataFrame, by: list[str], rates: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """Sessions b against a for every group in both: (by, metric, kind, a, b, delta, low, high, p, significant).

    Rates with Newcombe's interval and Fisher's p; numbers by their medians and the rank test's p.
    """
    some = lambda s: s.select(*by).distinct()
    both = checked_broadcast(some(a).join(some(b), by))
    out = []
    for name in rates:
        side = lambda s, x, name=name: s.join(both, by, "left_semi").groupBy(*by).agg(F.count_if(F.col(name)).alias(f"k{x}"), F.count(name).alias(f"n{x}"))
        r = side(a, 1).join(side(b, 2), by)
        d, low, high = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
        p = fisher("k1", F.col("n1") - F.col("k1"), "k2", F.col("n2") - F.col("k2"))
        out.append(r.select(*by, F.lit(name).alias("metric"), F.lit("rate").alias("kind"), F.try_divide("k1", "n1").alias("a"), F.try_divide("k2", "n2").alias("b"), d.alias("delta"), low.alias("low"), high.alias("high"), p.alias("p")))
    for name in numbers:
        value = lambda s, first, name=name: s.join(both, by, "left_semi").select(*by, F.col(name).cast("double").alias("v"), F.lit(first).alias("_a"))
        rows = value(a, True).union(value(b, False))
        medians = rows.groupBy(*by).agg(F.percentile(F.when(F.col("_a"), F.col("v")), 0.5).alias("a"), F.percentile(F.when(~F.col("_a"), F.col("v")), 0.5).alias("b"))
        r = medians.join(mann_whitney(rows, "v", F.col("_a"), by).select(*by, "p"), by, "left")
        none = F.lit(None).cast("double")
        out.append(r.select(*by, F.lit(name).alias("metric"), F.lit("median").alias("kind"), "a", "b", (F.col("b") - F.col("a")).alias("delta"), none.alias("low"), none.alias("high"), "p"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows.withColumn("significant", significant(F.col("p")))


def changed(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, n): rows whose value differs between two scorings of the same keys, nulls being equal."""
    b = after.select(*keys, *(F.col(f).alias(f"_new_{f}") for f in fields))
    both = before.join(b, keys)
    counts = both.agg(*(F.count_if(~F.col(f).eqNullSafe(F.col(f"_new_{f}"))).alias(f) for f in fields))
    return counts.unpivot([], fields, "field", "n")


def rescored(stored: DataFrame, fresh: DataFrame, tasks: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sessions with the fresh metrics, one row of what differed): sessions (session, task, fields) of tasks unknown (task) keep their own."""
    known = tasks.select("task").distinct().withColumn("_known", F.lit(True))
    new = fresh.select("session", *(F.col(f).alias(f"_new_{f}") for f in fields), F.lit(True).alias("_fresh"))
    rows = stored.join(checked_broadcast(known), "task", "left").join(new, "session", "left").withColumn("_again", F.col("_known").isNotNull() & F.col("_fresh").isNotNull())
    differs = sum((F.when(F.col("_again") & ~F.col(f).eqNullSafe(F.col(f"_new_{f}")), 1).otherwise(0) for f in fields), F.lit(0))
    counts = rows.select("_again", differs.alias("_d")).agg(F.count("*").alias("sessions"), F.count_if(F.col("_d") > 0).alias("changed_sessions"), F.coalesce(F.sum("_d"), F.lit(0)).alias("changed_fields"), F.count_if(~F.col("_again")).alias("not_rescored"))
    own = [F.when(F.col("_again"), F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in stored.columns]
    return rows.select(*own), counts
