"""Merkle manifest, exact duplicates and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import centroids, exact_dedup, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _hash string, proof int"
ODD_TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b", "a  b", "ab", "a b", "É a", "é a", "A" * 300_000, "-", "3:abc", "日本", "a\u0085b", "x" * 17]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest --------------------------------------------------------------------------------


def leaf_of(row, lowered=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if lowered and row[1] is not None else row[1]
    fields = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes, arity):
    """Levels of one group, and each node's place."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def way(levels, i, arity):
    out = []
    for level in levels[:-1]:
        at = i - i % arity
        out.append(("".join(level[at:i]), "".join(level[i + 1 : at + arity])))
        i //= arity
    return out


def plain_manifest(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    low = lambda x: (x is not None, x if x is not None else 0)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf_of(r) for r in sorted(groups[g], key=lambda r: (low(r[0]), leaf_of(r)))], arity) for g in order}
    top, out = climb([trees[g][-1][0] for g in order], arity), []
    for at, g in enumerate(order):
        for i, row in enumerate(sorted(groups[g], key=lambda r: (low(r[0]), leaf_of(r)))):
            proof = way(trees[g], i, arity) + way(top, at, arity)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of(row, tampered)
            for left, right in proof:
                node = sha(left + node + right)
            out.append((row[0], leaf_of(row), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def random_docs(n, sources, seed):
    r = random.Random(seed)
    hot = lambda: sources[0] if r.random() < 0.4 else r.choice(sources)
    return [(r.choice([None, 5, *range(n)]), r.choice([*ODD_TEXTS[:9], f"Text {i}"]), r.choice([None, "en", ""]), hot(), r.choice([None, i]), "clash", "clash", 1) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (16, [None]), (17, ["b"]), (300, ["hot", None, "", "é", "z", "Z"]), (90, [f"s{i}" for i in range(40)])])
def test_manifest_equals_plain(spark, tmp_path, n, sources):
    rows = random_docs(n, sources, n)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(queries.op11_merkle_manifest(spark, str(tmp_path)).collect()) == ordered(plain_manifest(rows, 16))


def test_manifest_of_other_arity_with_repeats_and_long_texts(spark):
    rows = [(1, "same", "en", "s", 4, "", "", 0)] * 70 + [(i, t, "en", "t", 1, "", "", 0) for i, t in enumerate(ODD_TEXTS)]
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), arity=3).withColumn("at", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    want = plain_manifest(rows, 3)
    assert sorted((r.leaf, r.subroot, r.root) for r in found) == sorted(w[1:4] for w in want) and all(r["at"] == r.root for r in found)


def test_manifest_of_nothing(spark):
    found = merkle.manifest(spark.createDataFrame([], DOCS))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof"] and found.count() == 0


def test_numbers_of_a_group_need_no_single_task(spark):
    rows = spark.range(5_000).select(F.lit("g").alias("g"), F.hash("id").alias("o"), "id")
    found = merkle.numbered(rows, "g", ["o", "id"])
    values = [r for r in found.orderBy("o", "id").collect()]
    assert [r._i for r in values] == list(range(5_000)) and {r._n for r in values} == {5_000}


# --- exact duplicates ------------------------------------------------------------------------


def plain_duplicates(rows):
    """(id, keep_id, size, kept, hash), sorted; equal rows are told apart by their place."""
    groups = {}
    for place, row in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append((-len(row[1] or ""), row[0] is None, row[0] or 0, place, row[0]))
    return sorted(((m[4], min(g)[4], len(g), m == min(g), sha(text)) for text, g in groups.items() for m in g), key=str)


@pytest.mark.parametrize("support", [1e-4, 0.02, 0.5])
def test_duplicates_equal_plain(spark, support):
    r = random.Random(8)
    rows = [(r.choice([None, 7, i]), r.choice([*ODD_TEXTS, "hot text", "hot  text", "hot text ", f"rare {i // 3}", f"rare\t{i // 3}"]), "x", "y", 1, "", "", 0) for i in range(400)]
    rows += [(900, "hot text", "", "", 1, "", "", 0)] * 200
    docs = spark.createDataFrame(rows, DOCS).withColumn("text_sha256", F.lit("clash")).withColumn("_digest", F.lit("clash")).repartition(5)
    found = exact_dedup.exact_duplicates(docs, support=support)
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain_duplicates(rows)
    kept = exact_dedup.without_duplicates(docs, support=support)
    want = [d for d in plain_duplicates(rows) if d[3]]
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, sha(re.sub(r"[\x20\x09-\x0D]", "", x.text or ""))) for x in kept.where("doc_id is not null").collect()) == sorted((d[0], d[4]) for d in want if d[0] is not None)
    assert kept.count() == len(want)


def test_frequent_digests_are_found_and_counted_exactly(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 50 == 1 else f"t{i}", "", "", 1, "", "", 0) for i in range(3_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    digests = exact_dedup._digests(docs.withColumn("_row", F.col("doc_id").cast("string")), "doc_id", "text")
    found = {r._digest: (r._size, r._first.id) for r in exact_dedup.frequent(digests, 0.01).collect()}
    warm = [r[0] for r in rows if r[1] == "warm"]
    assert found == {sha("hot"): (1_000, 0), sha("warm"): (len(warm), min(warm))}


def test_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(docs).count() == 0 and exact_dedup.without_duplicates(docs).count() == 0


# --- clusters --------------------------------------------------------------------------------


def plain_clusters(rows, n=64, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    at = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        chosen = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), c in zip(kept, chosen) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    limit = lambda d: d if d < 1 << 63 else None
    total = [sum(d for _, d, c in found if c == j) for j in range(len(at))]
    whole = [limit(t) if all(d < 1 << 63 for _, d, c in found if c == j) else None for j, t in enumerate(total)]
    every = limit(sum(total)) if all(d < 1 << 63 for _, d, _ in found) else None
    return sorted(((i, j, limit(d), whole[j], every, sha(",".join(map(str, at[j])))) for i, d, j in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, _vector int")


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters_equal_plain(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(150)] + [(r.choice([None, 4]), [round(r.random(), 1)] * 64) for _ in range(20)]
    rows += [(500, [0.25] * 64)] * 60  # a common vector
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [None] + [1.0] * 63), (605, [math.nan] + [1.0] * 63), (606, [math.inf] + [1.0] * 63), (607, [-math.inf] * 64)]
    found = centroids.clusters_with_inertia(vectors(spark, rows).repartition(3))
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain_clusters(as_floats(rows))


@pytest.mark.parametrize("far", [2e4, 7e4, 1e12, 3e38])
def test_clusters_of_very_large_components(spark, far):
    r = random.Random(5)
    rows = [(i, [r.choice([far, -far, 0.5, 1.0]) * r.random() for _ in range(64)]) for i in range(40)]
    found = centroids.clusters_with_inertia(vectors(spark, rows), rounds=3)
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain_clusters(as_floats(rows), rounds=3)


def test_few_vectors_and_none(spark):
    for rows in ([], [(1, None)], [(1, [1.0] * 64)], [(1, [1.0] * 64), (1, [1.0] * 64), (2, [2.0] * 64)]):
        found = centroids.clusters_with_inertia(vectors(spark, rows), rounds=2) if any(v for _, v in rows) else centroids.cluster(vectors(spark, rows))[0]
        assert sorted((tuple(x) for x in found.collect()), key=str) == plain_clusters(rows, rounds=2)


def test_screening_keeps_the_nearest_and_decides_ties_by_number():
    r = np.random.default_rng(2)
    at = [tuple(int(x) for x in r.integers(-3000, 3000, 64)) for _ in range(6)]
    at += [at[2], tuple(x + (i == 0) for i, x in enumerate(at[1]))]  # a tie, and a difference of one in one component
    screen, x = centroids.Screen(at, 1), r.integers(-3000, 3000, (3_000, 64)).astype(np.float64)
    x[:1000] = np.array(at[1]) + r.integers(-1, 2, (1000, 64))
    x[1000:1500] = at[2]
    chosen, whole, large, _ = screen.nearest(x)
    exact = ((x[:, None, :].astype(np.int64) - np.array(at)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (chosen == exact).all() and not large and (whole == x).all()
    assert 500 <= screen.recomputed < 3_000  # ties need integers; most vectors don't
