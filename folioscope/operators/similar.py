"""Similarity of pages: token sets, TF-IDF vectors, dense vectors, thresholds under a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import blocks
from folioscope.storage import checked_broadcast, materialised


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(i, j, score), i < j: all pairs of sets (id, tokens) of Jaccard similarity of ``percent`` hundredths or more.

    Elements that are common are counted block against block (see ``blocks``), so only pairs of the result leave a task. Ids are
    distinct; elements are told apart by 64 bits.
    """
    rows = sets.select("id", F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)).alias("t")).where(F.size("t") > 0)

    def test(both: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        union = m + n - both
        return (both > 0) & (100 * both >= percent * union), both / union

    kind = dict(sets.dtypes)["id"]
    return blocks.joined(blocks.dealt(rows, sets.count(), blocks.ROWS), blocks.pairs_where(test), f"i {kind}, j {kind}, score double")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, term, tf) of rows (id, term)."""
    return tokens.groupBy("id", "term").agg(F.count("*").alias("tf"))


def idfs(tf: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(term, idf) over all ids that have a term; n: one row with their number, if it is known."""
    n = tf.agg(F.count_distinct("id").alias("n")) if n is None else n
    return tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def cosines(asked: DataFrame, others: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(i, j, score): cosines of TF-IDF vectors of a stated query set with all others that share a term; both (id, term, tf).

    Products are made of the queries' terms only, which are few; all other terms count in the norms. Each posting of such a term
    goes to the task of its id once and meets the queries there, so no pair is shuffled. n: one row with the number of ids, if it is known.
    """
    spark = others.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    idf = materialised(idfs(asked.select("id", "term").union(others.select("id", "term")), n), "idf")
    idf = checked_broadcast(idf, 500_000)
    weight = F.col("tf") * F.col("idf")
    norms = lambda tf: tf.join(idf, "term").groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    mine = materialised(asked.join(idf, "term").select(F.col("id").alias("i"), "term", weight.alias("wi"), "idf"), "asked")
    own = others.join(checked_broadcast(mine.select("term", "idf").distinct()), "term").select(F.col("id").alias("j"), "term", weight.alias("wj"))
    dots = own.repartition(tasks, "j").join(checked_broadcast(mine), "term").groupBy("i", "j").agg(F.sum(F.col("wj") * F.col("wi")).alias("dot"))
    lengths = materialised(norms(others).toDF("j", "nj"), "norms")
    rows = dots.join(checked_broadcast(norms(asked).toDF("i", "ni")), "i").join(checked_broadcast(lengths).hint("shuffle_hash"), "j")
    return rows.select("i", "j", (F.col("dot") / (F.col("ni") * F.col("nj"))).alias("score"))


def best_match(scores: DataFrame) -> DataFrame:
    """(i, j, score): of (i, j, score) the best j, the lowest of equals; none where all scores are 0."""
    top = scores.where(F.round("score", 9) > 0).groupBy("i").agg(F.max_by(F.struct("j", "score"), F.struct(F.round("score", 9), -F.col("j"))).alias("b"))
    return top.select("i", "b.j", "b.score")


def budgeted_threshold(scores: DataFrame, total: Column, rate: float) -> DataFrame:
    """One row (threshold, above): the least score that floor(total * rate) of ``scores`` or fewer reach; equals stay together.

    Without scores 0; if not even the largest fits, just above it. Scores may come counted (score, n), each once.
    """
    counts = scores if "n" in scores.columns else scores.groupBy("score").agg(F.count("*").alias("n"))
    running = counts.withColumn("cum", F.sum("n").over(Window.orderBy(F.desc("score"))))
    limit = F.floor(total * rate)
    out = running.agg(F.min(F.when(F.col("cum") <= limit, F.col("score"))).alias("fit"), F.max("score").alias("top"), F.max(F.when(F.col("cum") <= limit, F.col("cum"))).alias("above"))
    return out.select(F.when(F.col("top").isNull(), F.lit(0.0)).when(F.col("fit").isNull(), F.col("top") + F.when(F.col("top") == 0, 1e-9).otherwise(F.abs("top") * 1e-9)).otherwise(F.col("fit")).alias("threshold"), F.coalesce("above", F.lit(0)).alias("above"))


def precision_recall(pairs: DataFrame, threshold: Column) -> DataFrame:
    """One row of pairs (score, is_positive): tp, fp, fn, precision, recall at a threshold."""
    hit = F.col("score") >= threshold
    out = pairs.agg(F.count_if(hit & F.col("is_positive")).alias("tp"), F.count_if(hit & ~F.col("is_positive")).alias("fp"), F.count_if(~hit & F.col("is_positive")).alias("fn"))
    return out.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})


#: Queries that go out at once, and vectors that meet such a block in one task.
BLOCK, ROWS = 512, 16_384


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, *, block: int = BLOCK) -> DataFrame:
    """(qid, rank, id, sim): the k vectors (id, v) nearest to each of a stated set of queries (qid, v), itself apart.

    Queries are dealt into blocks, and each block meets each block of vectors as one product of matrices, of which the
    best k a query go on.  Similarities are rounded to six decimals; of equal ones the greater id comes first.
    """
    n, m = queries.count(), vectors.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // ROWS), min(m, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    deal = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = queries.select("qid", "v", deal("qid", blocks).alias("a"), every(parts).alias("b"))
    b = vectors.select("id", "v", every(blocks).alias("a"), deal("id", parts).alias("b"))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), dtype=np.float64)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"qid": [], "id": [], "sim": []})
        sim = np.round(unit(asked["v"]) @ unit(rows["v"]).T, 6)
        ids, mine = rows["id"].to_numpy(), asked["qid"].to_numpy()
        sim[mine[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(-ids, sim.shape), -sim))[:, :k]
        top = np.take_along_axis(sim, order, 1)
        q, c = np.nonzero(np.isfinite(top))
        return pd.DataFrame({"qid": mine[q], "id": ids[order[q, c]], "sim": top[q, c]})

    tasks = blocks * parts  # stated, else small shuffles are put together and one task has the products of many blocks
    found = a.repartition(tasks, "a", "b").groupBy("a", "b").cogroup(b.repartition(tasks, "a", "b").groupBy("a", "b")).applyInPandas(best, "qid long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", "sim")
