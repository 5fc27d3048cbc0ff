"""Nearest vectors by cells: what lies too far from a query to count is skipped, and the result stays exact.

Each vector belongs to the nearest of some centres, which are a bounded sample of the vectors themselves; a cell's radius is the
greatest angle to its centre. The angle between two directions obeys the triangle inequality, so no vector of a cell is nearer to a
query than the angle to the centre less the radius. A query first meets its nearest cells, until they hold k vectors; the k-th
similarity found there decides which other cells can still hold a better one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.storage import checked_broadcast, materialised

#: Centres at most, and vectors of a cell that meet a block of queries in one task.
CENTRES, ROWS = 1_024, 16_384
#: Similarities are compared with six decimals; what could be equal then is kept.
SLACK = 2e-6
#: The cell of vectors without a direction: they are as similar to all queries, 0.
NOWHERE = -1


@dataclass(frozen=True)
class Cells:
    """members (id, v, cell, part), sizes (cell, n, parts, radius) and the centres' directions, a row each."""

    members: DataFrame
    sizes: DataFrame
    centres: np.ndarray


def _units(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def build(vectors: DataFrame, *, centres: int = CENTRES, rows: int = ROWS) -> Cells:
    """Cells of vectors (id long, v of one length, no nulls in it); rows without v are left out. An empty table has none.

    The centres are the square root of the number of vectors, at most ``centres``, the first ones by a hash of the id; all vectors
    get a cell. Cells of more than ``rows`` vectors, copies of one for instance, are dealt into parts, so no task has a whole one.
    """
    vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
    wanted = min(centres, int(vectors.count() ** 0.5))
    first = vectors.where(F.exists("v", lambda x: x != 0)).select("v", F.xxhash64("id").alias("h")).dropDuplicates(["v"]).orderBy("h").limit(wanted).collect()
    middle = _units(pd.Series([r["v"] for r in first])) if first else np.empty((0, 0))

    def place(batches):
        for b in batches:
            own = _units(b["v"])
            lost = ~own.any(axis=1)
            if len(middle):
                sim = own @ middle.T
                cell = sim.argmax(1)
                angle = np.arccos(np.clip(sim[np.arange(len(own)), cell], -1, 1))
            else:
                cell, angle = np.full(len(own), NOWHERE), np.zeros(len(own))
            yield b.assign(cell=np.where(lost, NOWHERE, cell), angle=np.where(lost, 0, angle))

    placed = materialised(vectors.mapInPandas(place, "id long, v array<double>, cell int, angle double"), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    sizes = materialised(sizes.select("cell", "n", F.ceil(F.col("n") / rows).cast("int").alias("parts"), "radius"), "sizes")
    members = placed.drop("angle").join(F.broadcast(sizes.select("cell", "parts")), "cell")  # a row for each centre
    return Cells(members.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), sizes, middle)


def _asked(queries: DataFrame, cells: Cells) -> DataFrame:
    """(qid, v, cell, nearest): each query against each cell, with the angle from which the cell may hold vectors."""
    sizes = {r["cell"]: r["radius"] for r in cells.sizes.collect()}  # a row for each centre
    names = np.array(sorted(sizes), dtype=np.int64)
    radius, middle = np.array([sizes[c] for c in names]), cells.centres

    def reach(batches):
        for b in batches:
            own = _units(b["v"])
            angle = np.full((len(own), len(names)), np.pi / 2)
            real = names >= 0
            if real.any():
                angle[:, real] = np.maximum(0, np.arccos(np.clip(own @ middle[names[real]].T, -1, 1)) - radius[real] - 1e-6)
                angle[np.ix_(~own.any(axis=1), real)] = np.pi / 2  # a query without a direction: 0 to all
            q, c = np.indices(angle.shape).reshape(2, -1)
            yield pd.DataFrame({"qid": b["qid"].to_numpy()[q], "cell": names[c], "nearest": angle[q, c]})

    return queries.select("qid", "v").mapInPandas(reach, "qid long, cell int, nearest double")


def _best(queries: DataFrame, pairs: DataFrame, cells: Cells, k: int, block: int) -> DataFrame:
    """(qid, id, sim): of each part of each cell the best k for the queries (qid, cell) that it meets, by blocks of queries."""
    met = pairs.join(F.broadcast(cells.sizes.select("cell", "parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.join(queries, "qid").withColumn("deal", F.pmod(F.xxhash64("qid"), F.lit(block)).cast("int")).select("qid", "v", "cell", "part", "deal")
    wanted = met.select("cell", "part", F.col("deal").alias("own")).distinct()
    rows = cells.members.join(checked_broadcast(wanted), ["cell", "part"]).select("id", "v", "cell", "part", F.col("own").alias("deal"))

    def best(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({"qid": [], "id": [], "sim": []})
        sim = np.round(_units(asked["v"]) @ _units(own["v"]).T, 6) + 0.0
        ids, mine = own["id"].to_numpy(), asked["qid"].to_numpy()
        sim[mine[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(-ids, sim.shape), -sim))[:, :k]
        top = np.take_along_axis(sim, order, 1)
        q, c = np.nonzero(np.isfinite(top))
        return pd.DataFrame({"qid": mine[q], "id": ids[order[q, c]], "sim": top[q, c]})

    keys = ("cell", "part", "deal")
    return met.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, "qid long, id long, sim double")


def cosine_topk(queries: DataFrame, cells: Cells, k: int, *, per_block: int = 512, work: bool = False) -> DataFrame:
    """(qid, rank, id, sim): the k vectors nearest to each of a stated set of queries (qid, v), itself apart; see ``similar.cosine_topk``.

    Queries have an id each and vectors of the cells' length. Similarities are rounded to six decimals; of equal ones the greater
    id comes first. With ``work`` (qid, compared): the vectors that each query met.
    """
    queries = materialised(queries.select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v")).where("v is not null"), "queries")
    block = max(1, -(-queries.count() // per_block))
    by = Window.partitionBy("qid").orderBy("nearest", "cell")
    pairs = _asked(queries, cells).join(F.broadcast(cells.sizes.select("cell", "n")), "cell")
    pairs = materialised(pairs.withColumn("_before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "pairs")
    near = F.col("_before") <= k  # one more than k, the query itself being apart
    first = materialised(_best(queries, pairs.where(near).select("qid", "cell"), cells, k, block), "first")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc("id")))
    least = first.withColumn("rank", place).where(F.col("rank") == k).select("qid", (F.col("sim") - SLACK).alias("least"))
    more = pairs.where(~near).join(checked_broadcast(least), "qid", "left").where(F.cos("nearest") >= F.coalesce("least", F.lit(-2.0)))
    if work:
        return pairs.where(near).select("qid", "n").union(more.select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("compared"))
    found = first.union(_best(queries, more.select("qid", "cell"), cells, k, block))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "rank", "id", "sim")
