"""Retrieval metrics, resampling and calibration over ranked lists (qid, rank, slug) and judgements (qid, slug)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.storage import checked_broadcast, materialised


def judged(queries: DataFrame, ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, rank, hit): every query with its list, hit telling whether the page is relevant; rank is null without hits."""
    marks = qrels.select("qid", "slug").distinct().withColumn("_hit", F.lit(True))
    return queries.select("qid").join(ranked.select("qid", "rank", "slug"), "qid", "left").join(marks, ["qid", "slug"], "left").select("qid", "rank", F.coalesce("_hit", F.lit(False)).alias("hit"))


def metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query ndcg (binary gains, ideal of min(relevant, k)), rr, r1 and r3; 0 without relevant pages."""
    rel = qrels.select("qid", "slug").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    hit = F.col("hit") & (F.col("rank") <= k)
    per = judged(queries, ranked, qrels).groupBy("qid").agg(
        F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.max(F.when(hit & (F.col("rank") <= 1), 1).otherwise(0)).alias("r1"),
        F.max(F.when(hit & (F.col("rank") <= 3), 1).otherwise(0)).alias("r3"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    return per.join(rel, "qid", "left").select("qid", F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), "rr", "r1", "r3", F.coalesce("n_rel", F.lit(0)).alias("n_rel"))


def by_type(per: DataFrame, kinds: DataFrame) -> DataFrame:
    """Means over all queries and by their type (missing: other), the total under the type ``all``."""
    rows = per.join(kinds, "qid", "left").withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.lit("other")))
    means = [F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("ndcg", "rr", "r1", "r3"))]
    out = rows.groupingSets([["type"], []], "type").agg(*means, F.grouping("type").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("type")).alias("type"), "n", "ndcg", "rr", "r1", "r3")


def resampled(values: DataFrame, rounds: int = 1000) -> DataFrame:
    """Mean and 95 % bootstrap interval of values (place from 0 to n - 1, value): means of ``rounds`` resamples, sorted, at 25 and 974 thousandths.

    Draws come from integer arithmetic that any engine repeats, so intervals are those of this generator.  The number
    of judged queries is small by nature; each round draws by a join on the place, nothing is gathered. The values are written
    first, since several steps read them and what they come from may be a ranking of all pages.
    """
    values = materialised(values, "values")
    n = values.agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    spark = values.sparkSession
    draws = spark.range(rounds).withColumnRenamed("id", "rep").join(checked_broadcast(values.select(F.col("place").alias("draw")))).join(F.broadcast(n.select("n")))
    draws = draws.select("rep", F.pmod(F.pmod(F.col("rep") * 1103515245 + F.col("draw") * 2654435761 + 12345, F.lit(2147483647)) * 48271, F.lit(2147483647)).alias("x"), "n").select("rep", F.pmod("x", "n").alias("place"))
    means = draws.join(checked_broadcast(values), "place").groupBy("rep").agg(F.round(F.avg("value"), 9).alias("m"))
    ranks = means.withColumn("r", F.row_number().over(Window.orderBy("m", "rep")) - 1)
    low, high = int(rounds * 0.025), int(rounds * 0.975) - 1
    ends = ranks.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high"))
    return n.join(ends).select("n", "mean", "low", "high")


def placed(per: DataFrame, value: Column) -> DataFrame:
    """(place, value) of per-query values in order of qid."""
    return per.select((F.row_number().over(Window.orderBy("qid")) - 1).cast("long").alias("place"), value.alias("value"))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The frame with midrank, the average place of equal values."""
    w = Window.partitionBy(*(by or [])).orderBy(value)
    tied = Window.partitionBy(*(by or []), value)
    return df.withColumn("midrank", F.rank().over(w) + (F.count("*").over(tied) - 1) / 2)
