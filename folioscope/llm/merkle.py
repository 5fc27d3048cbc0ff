"""Merkle manifest of a dataset: a hash of every row, one of every group, one of all, and for every row the proof that it belongs.

A row's leaf is the SHA-256 (lower-case hex, as are all hashes here) of its fields, each a dash if null, else the number of its
UTF-8 bytes, a colon and the value. The leaves of a group stand in ascending order; every run of ``arity`` neighbours (the last
one may be shorter, even a single node) becomes the hash of their hex texts, level by level until one node remains, the group's
root; a lone leaf is its own. The groups' roots, ordered by group, give the root of all in the same way.

A level is one window: partitioned by group and number of the parent, ordered, its full frame collected. That list of at most
``arity`` hashes is both what the parent hashes and, without the row's own, the row's siblings. One row of each run goes on as
the parent. The siblings then come down the levels again, so a parent's way to the root is sent once, not once for each leaf.

Nothing goes through one task: a group of any size is numbered by ranges (see ``numbered``), and no run exceeds ``arity``. Texts
are read once and never shuffled. Levels are tables in the shared folder; there are as many as the largest group has digits to
the base ``arity``.

Cases: a null group is a group of its own, the first; a null in the order column comes first; rows equal there are ordered by
leaf, and equal rows have equal leaves, each its own place; empty and very long texts are values as any; an empty table gives an
empty frame; columns that aren't named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialised, partitions, size_checked_broadcast

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to which the counts of groups by range are broadcast; beyond it they are joined by a shuffle.
MAX_SENT = 200_000


def leaf_hash(*values: Column) -> Column:
    """The leaf of a row with these fields."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``_i``, their place in their group from 0, and ``_n``, the group's size. The order must tell all rows apart.

    Rows are dealt out by ranges of group and order, so a group of any size takes as many tasks as it needs. A row's place is
    that in its range, plus the group's rows in the ranges before, of which there is one count for each range and group.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = materialised(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    counts, of_group = dealt.groupBy(group, "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first")), Window.partitionBy(group)
    counts = materialised(
        counts.select(group, "_range", "_first", (F.sum("_rows").over(of_group.orderBy("_range")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(of_group).alias("_n")), "counts"
    )
    return dealt.join(size_checked_broadcast(counts, MAX_SENT), [group, "_range"]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_i"), "_n")


def _with_runs(level: DataFrame, arity: int) -> DataFrame:
    """Every node with the number of its parent and the hashes of its run, in order."""
    run = Window.partitionBy("_group", "_up").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return level.withColumn("_up", F.expr(f"_i div {arity}")).withColumn("_run", F.collect_list("_hash").over(run))


def _levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """All groups' levels, from the leaves up: ``_group, _i, _n, _hash``. A group that has come down to one node goes no further."""
    levels, most = [leaves], leaves.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        first_of_run = _with_runs(levels[-1].where("_n > 1"), arity).where(F.col("_i") % arity == 0)
        parents = first_of_run.select("_group", F.col("_up").alias("_i"), F.expr(f"(_n + {arity - 1}) div {arity}").alias("_n"), F.sha2(F.array_join("_run", ""), 256).alias("_hash"))
        levels.append(materialised(parents, "level"))
        most = -(-most // arity)
    return levels


def _with_paths(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The lowest level with ``_subroot, _root`` and ``_path``, the siblings left and right at each step up to the root.

    ``above`` has for each group its root's way on: ``_group, _subroot, _root, _path``.
    """
    found = None
    for level in reversed(levels):
        own = [c for c in level.columns if c != "_n"]
        done = level.where("_n = 1").join(above, "_group").select(*own, "_subroot", "_root", "_path")
        if found is not None:
            up = found.select("_group", F.col("_i").alias("_up"), "_subroot", "_root", F.col("_path").alias("_rest"))
            place = (F.col("_i") % arity).cast("int")
            step = F.struct(F.array_join(F.slice("_run", F.lit(1), place), "").alias("left"), F.array_join(F.slice("_run", place + 2, F.lit(arity)), "").alias("right"))
            going = _with_runs(level.where("_n > 1"), arity).join(up, ["_group", "_up"])
            done = done.unionByName(going.select(*own, "_subroot", "_root", F.concat(F.array(step), "_rest").alias("_path")))
        found = done
    return found


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = ARITY, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """For every row: the order column, ``leaf``, ``subroot`` (its group's), ``root``, ``proof``, and the columns of ``carry``.

    ``proof`` is an array from the leaf's level to the root of ``struct<left, right>``: the hex texts of the siblings before and
    after, joined. ``carry`` has further expressions over ``docs``, computed where the leaves are.
    """
    carry = carry or {}
    leaves = docs.select(
        F.col(order).alias("_order"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_group"), leaf_hash(*(F.col(f) for f in fields)).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"), F.struct(*(e.alias(c) for c, e in carry.items()), F.lit(0).alias("_")).alias("_carried"),
    )
    leaves = materialised(numbered(materialised(leaves, "leaves"), "_group", ["_order", "_hash", "_row"]).drop("_row"), "numbered")
    levels = _levels(leaves, arity)

    tops = [level.where("_n = 1").select("_group", "_hash") for level in levels]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = materialised(numbered(subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_of"), "_hash"), "_group", ["_of"]), "subroots")
    upper = _levels(subroots, arity)
    root = upper[-1].select("_group", F.lit(None).cast("string").alias("_subroot"), F.col("_hash").alias("_root"), F.array().cast("array<struct<left:string,right:string>>").alias("_path"))
    above = materialised(_with_paths(upper, root, arity).select(F.col("_of").alias("_group"), F.col("_hash").alias("_subroot"), "_root", "_path"), "above")

    rows = _with_paths(levels, above, arity)
    return rows.select(F.col("_order").alias(order), F.col("_hash").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("proof"), *(F.col("_carried")[c].alias(c) for c in carry))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, joined."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")
