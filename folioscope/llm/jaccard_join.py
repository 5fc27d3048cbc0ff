"""N-gram Jaccard join in a metric space: pivots, Voronoi regions, windows, regions joined recursively and exactly.

Jaccard distance is a metric on the documents' sets of five-word shingles.  Random documents lie at distance
close to 1 from each other, so a few sampled pivots would put every document into every window.  Pivots are
therefore found in two levels:

* The first level has the one-shingle sets as pivots.  A document's own shingles are its nearest pivots, all at the
  same distance; one global order (rare before frequent, then by hash) breaks the ties.  Two sets of Jaccard
  similarity t or more share an element of the first ``n - ceil(t * n) + 1`` in that order, so that many nearest
  pivots are the window into which a document is replicated.  The order changes cost, never results.
* In each cell of the first level the smallest member is its pivot.  A document's home region is the pivot that it
  meets most often.  Regions are joined in memory (``region_links``): distances to the pivot are exact, members
  stand in order of that distance, the triangle inequality leaves a window of them to compare, and further pivots
  are taken from what isn't connected yet until one class is left or every other member has been a pivot.
* Before sets are sent anywhere, sizes and counts by hash class bound the distance from below (``may_link``).
* Cells that still hold members of more than one class form regions again, now with all members that the windows
  put there, and are joined the same way.  A pair that links shares a cell; either its classes were joined before
  or it is compared here, so no link between classes is missed.

Equal sets are one node throughout.  Nodes are 56-bit digests of sets and their sizes' codes, shingles are 64-bit hashes; two different
sets would have to collide within a pair to change a decision.  Large regions are dealt out in slices by weight,
so no task holds a whole hot group, and documents of frequent shingles reach their pivots without being gathered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, materialised, partitions, shingle_set, size_checked_broadcast, texts, with_row_keys
from folioscope.storage import small_batches

#: Shingles gathered in a task before frequent ones are looked for.
CHUNK = 1_000_000
#: A shingle is called frequent if its counts, of this many or more in one chunk, sum to HOT.
LOCAL, HOT = 3, 48
#: At most so many of the most frequent shingles are ordered last (the rest keep their place by hash).
MAX_HOT = 1_000_000
#: A slice of a region: members, shingles.
SLICE, SLICE_WEIGHT = 256, 1_000_000
#: Bytes of window entries in one range of hashes.
RANGE = 32 << 20
#: Nodes that may be broadcast; beyond it a shuffled join takes their place.
MAX_SENT = 1_000_000


PROFILE = ["doc_id", "row", "key", "n", "hash", "count"]
#: Sizes are coded in eight bits, in steps of this ratio.
STEP = 1.06


def size_code(n: int) -> int:
    return min(255, int(math.log(n) / math.log(STEP)))


def digest(shingles: np.ndarray) -> int:
    """A node: 56 bits of the set's digest, and the code of its size in the lowest eight."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=7).digest(), "little", signed=True) << 8 | size_code(len(shingles))


def code_reach(percent: int) -> int:
    """Codes of similar sets differ by so much at most."""
    return int(math.log(100 / percent) / math.log(STEP)) + 1


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Counts of the shingles by the first bits of their hashes, as many classes as leave two to four in each.

    The sum of absolute differences of two sketches (the finer one folded) is at most the size of the sets' symmetric
    difference: a lower bound of distance, as distances to common pivots give.
    """
    bits = max(3, (len(shingles) - 1).bit_length() - 2)
    return np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed(counts: np.ndarray) -> bytes:
    """A sketch in half a byte for each class; in four bytes if one of them is too large, which evenly spread hashes hardly ever give."""
    if counts.max() > 15:
        return counts.astype(np.uint32).tobytes()
    pairs = counts.astype(np.uint8).reshape(-1, 2)
    return (pairs[:, 0] | pairs[:, 1] << 4).tobytes()


def unpacked(sketch: bytes, n: int) -> np.ndarray:
    """The packed sketch of a set of n."""
    if len(sketch) > 1 << max(3, (n - 1).bit_length() - 2):
        return np.frombuffer(sketch, np.uint32)
    pairs = np.frombuffer(sketch, np.uint8)
    return np.stack((pairs & 15, pairs >> 4), 1).ravel()


def _coarser(x: np.ndarray, width: int) -> np.ndarray:
    return x.reshape(*x.shape[:-1], width, -1).sum(-1, dtype=np.int64) if x.shape[-1] > width else x.astype(np.int64)


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """Whether the sketches a and b of sets of na and nb leave it possible that the sets link."""
    width = min(len(a), len(b))
    return (100 + percent) * int(np.abs(_coarser(a, width) - _coarser(b, width)).sum()) <= (100 - percent) * (na + nb)


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list[tuple], list[int], list[np.ndarray]]]:
    """Other columns, digests and sets of the rows, whose text is the last column, CHUNK shingles at a time; texts without words get digest 0 and an empty set."""
    ids, keys, sets, size = [], [], [], 0
    for batch in batches:
        *others, last = batch.columns
        for *row, text in zip(*(c.to_pylist() for c in others), texts(last), strict=True):
            found = shingle_set(text, n)
            ids.append(row)
            keys.append(digest(found) if len(found) else 0)
            sets.append(found)
            size += len(found)
            if size >= CHUNK:
                yield ids, keys, sets
                ids, keys, sets, size = [], [], [], 0
    if ids:
        yield ids, keys, sets


def _distinct(keys: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    one = {k: s for k, s in zip(keys, sets, strict=True) if len(s)}
    return np.fromiter(one, dtype=np.int64, count=len(one)), list(one.values())


def _profile(n: int):
    """Of each document its digest and size; of each chunk the frequent shingles, with a document that has them."""

    def run(batches):
        for ids, keys, sets in _chunks(batches, n):
            none = [None] * len(ids)
            columns = [r[0] for r in ids], [r[1] for r in ids], [k if len(s) else None for k, s in zip(keys, sets, strict=True)], [len(s) for s in sets], none, none
            yield pa.record_batch([pa.array(x, pa.string() if c == "row" else pa.int64()) for c, x in zip(PROFILE, columns, strict=True)], names=PROFILE)
            nodes, own = _distinct(keys, sets)
            del ids, keys, sets, columns
            if len(own) >= LOCAL:
                yield _frequent(nodes, own)
            del nodes, own

    return run


def _frequent(nodes: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """The shingles that LOCAL or more of the sets have, with their counts and the smallest node of each."""
    every = np.concatenate(sets)
    order = np.argsort(every)
    every = every[order]
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    count = np.diff(np.concatenate((start, [len(every)])))
    often = count >= LOCAL
    start, count = start[often], count[often]
    hashes = every[start].view(np.int64)
    del every
    whose = nodes[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]]]
    least = np.minimum.reduceat(whose, np.cumsum(count) - count) if len(count) else whose
    none = pa.nulls(len(count), pa.int64())
    return pa.record_batch([none, pa.nulls(len(count), pa.string()), pa.array(least), none, pa.array(hashes), pa.array(count.astype(np.int64))], names=PROFILE)


def window_length(n: int, percent: int) -> int:
    """How many elements of a set of n, in the global order, a similar set must meet."""
    return n - -(-percent * n // 100) + 1


def _cells(n: int, percent: int, ranges: int, hot):
    """The windows of all documents, by range of the shingles' hashes; those of frequent shingles with their pivots, dealt out by document."""

    def run(batches):
        frequent, rank, pivot = hot.value
        for _, keys, sets in _chunks(batches, n):
            nodes, own = _distinct(keys, sets)
            del keys, sets
            cold_h, cold_k, hot_rows = [], [], {}
            for key, s in zip(nodes.tolist(), own, strict=True):
                k = window_length(len(s), percent)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    is_hot = frequent[at] == s
                    cold = s[~is_hot][:k]
                    if len(cold) < k:
                        mine = at[is_hot]
                        mine = mine[np.argsort(rank[mine])][: k - len(cold)]
                        hot_rows.setdefault(key % ranges, []).append((key, mine))
                else:
                    cold = s[:k]
                cold_h.append(cold)
                cold_k.append(np.full(len(cold), key, dtype=np.int64))
            rows = []
            del own
            if cold_h:
                h, w = np.concatenate(cold_h), np.concatenate(cold_k)
                del cold_h, cold_k
                order = np.argsort(h)
                h, w = h[order], w[order]
                cut = np.searchsorted(((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
                rows += [(r, h[a:b].tobytes(), w[a:b].tobytes(), None) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                del h, w, order
            for r, found in hot_rows.items():
                at = np.concatenate([x for _, x in found])
                rows.append((r, frequent[at].tobytes(), np.repeat(np.array([k for k, _ in found]), [len(x) for _, x in found]).tobytes(), pivot[at].tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=["r", "hashes", "keys", "pivots"])

    return run


def _members(percent: int):
    """The cells' members (cell, node, pivot) that have another one of similar size beside them."""
    reach = code_reach(percent)

    def run(batches):
        yield from _found(batches, reach)

    return run


def _found(batches, reach: int):
    names = ["cell", "node", "pivot"]
    h, w = [], []
    for batch in batches:
        for a, b, p in zip(batch.column("hashes"), batch.column("keys"), batch.column("pivots"), strict=True):
            cell, node = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
            if p.is_valid:
                yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(node.view(np.int64)), pa.array(np.frombuffer(p.as_buffer(), dtype=np.int64))], names=names)
            else:
                h.append(cell.copy())
                w.append(node >> np.uint64(8) | node << np.uint64(56))  # the size's code leads
        del batch
    if not h:
        return
    h = np.concatenate(h)
    w = np.concatenate(w)
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    del order
    code = (w >> np.uint64(56)).astype(np.int16)
    same = h[1:] == h[:-1]
    new = np.concatenate(([True], ~same | (w[1:] != w[:-1])))  # equal documents of several chunks
    h, w, code = h[new], w[new], code[new]
    beside = (h[1:] == h[:-1]) & (code[1:] - code[:-1] <= reach)
    near = np.concatenate(([False], beside)) | np.concatenate((beside, [False]))
    h, w = h[near], w[near]
    del code, same, new, beside, near
    if not len(h):
        return
    w = (w << np.uint64(8) | w >> np.uint64(56)).view(np.int64)
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    pivot = np.repeat(np.minimum.reduceat(w, start), np.diff(np.concatenate((start, [len(h)]))))
    for a in range(0, len(h), 1 << 18):
        yield pa.record_batch([pa.array(x[a : a + (1 << 18)]) for x in (h.view(np.int64), w, pivot)], names=names)


def region_links(sets: list[np.ndarray], classes: list[int], first: int, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that, with the classes given, join all of these sets that links join.

    The set ``first`` is the region's pivot.  Later pivots see only the window that the triangle inequality leaves.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    members: dict[int, list[int]] = {}
    for i, c in enumerate(classes):
        members.setdefault(c, []).append(i)
    if len(members) < 2:
        return []
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(local.max()) + 1, dtype=bool)
    first_at = np.concatenate(([0], np.cumsum(size)))
    links: list[tuple[int, int]] = []

    def shared(i: int, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own = local[first_at[i] : first_at[i + 1]]
        mark[own] = True
        got = np.add.reduceat(mark[tokens], starts, dtype=np.int64)
        mark[own] = False
        return got

    def join(i: int, near: np.ndarray) -> None:
        for j in near.tolist():
            a, b = root(classes[i]), root(classes[j])
            if a != b:
                links.append((i, j))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                parent[b] = a
                members[a] += members.pop(b)

    both = shared(first, local, first_at[:-1])
    away = 1 - both / (size + size[first] - both)
    join(first, np.flatnonzero(100 * both >= percent * (size + size[first] - both)))
    order = np.argsort(away, kind="stable")  # the region by distance from its pivot
    tokens = np.concatenate([local[first_at[i] : first_at[i + 1]] for i in order])
    starts = np.concatenate(([0], np.cumsum(size[order])))
    away, ranked = away[order], size[order]
    reach = (100 - percent) / 100 + 1e-9
    used = np.zeros(m, dtype=bool)
    used[first] = True
    while len(members) > 1:
        largest = max(members, key=lambda c: len(members[c]))
        i = next((i for c in members if c != largest for i in members[c] if not used[i]), None)
        if i is None:
            break
        used[i] = True
        at = 1 - both[i] / (size[i] + size[first] - both[i])
        a, b = np.searchsorted(away, [at - reach, at + reach])
        if b - a > 1:
            got = shared(i, tokens[starts[a] : starts[b]], starts[a:b] - starts[a])
            join(i, order[a:b][100 * got >= percent * (ranked[a:b] + size[i] - got)])
    return links


def _join_regions(percent: int):
    """Over rows sorted by region and slice, the pivot's own row first: the links."""

    def run(batches):
        at, sets, nodes, classes = None, [], [], []

        def found():
            links = region_links(sets, classes, 0, percent) if len(sets) > 1 else []
            return pa.record_batch([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for region, piece, node, group, blob in zip(*(batch.column(c).to_pylist() for c in ("pivot", "slice", "node", "class")), batch.column("shingles"), strict=True):
                if (region, piece) != at:
                    if at:
                        yield found()
                    at, sets, nodes, classes = (region, piece), [], [], []
                if node not in nodes[:1]:  # the pivot may stand among the members too
                    sets.append(np.frombuffer(blob.as_buffer(), dtype=np.uint64))
                    nodes.append(node)
                    classes.append(group)
        if at:
            yield found()

    return run


def _sketched_pairs(percent: int):
    """Of rows with the sketches of node and pivot those that may link."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("n", "sketch", "pivot_n", "pivot_sketch")]
            keep = [may_link(unpacked(a, na), na, unpacked(b, nb), nb, percent) for na, a, nb, b in zip(*cols, strict=True)]
            yield batch.select(["node", "pivot"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sketched_regions(percent: int):
    """Over rows sorted by region and slice: the rows that may link to one of another class in the slice, by size and sketch."""

    def near(rows: list) -> list[bool]:
        m = len(rows)
        size = np.array([r[4] for r in rows])
        group = np.array([r[3] for r in rows])
        sketches = [unpacked(r[5], r[4]) for r in rows]
        width = np.array([len(x) for x in sketches])
        order = np.argsort(size, kind="stable")
        keep = np.zeros(m, dtype=bool)
        kinds, counts = np.unique(group, return_counts=True)
        largest = kinds[counts.argmax()]
        stacks: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(width).tolist():
            at = order[width[order] == w]
            for coarse in (w, w // 2):
                stacks[w, coarse] = _coarser(np.stack([sketches[i] for i in at]), coarse) if coarse else None
            stacks[w, -1] = at
        for i in np.flatnonzero(group != largest).tolist():
            w = int(width[i])
            for other in (w // 2, w, 2 * w):
                if (other, -1) not in stacks:
                    continue
                at = stacks[other, -1]
                sizes = size[at]
                a, b = np.searchsorted(sizes, [-(-percent * size[i] // 100), 100 * size[i] // percent + 1])
                if a >= b:
                    continue
                common = min(w, other)
                away = np.abs(stacks[other, common][a:b] - _coarser(sketches[i], common)).sum(1)
                ok = ((100 + percent) * away <= (100 - percent) * (sizes[a:b] + size[i])) & (group[at[a:b]] != group[i])
                if ok.any():
                    keep[i] = True
                    keep[at[a:b][ok]] = True
        return keep.tolist()

    def run(batches):
        at, rows = None, []

        def found():
            kept = [r for r, k in zip(rows, near(rows), strict=True) if k] if len(rows) > 1 else []
            return pa.record_batch([pa.array([r[i] for r in kept], pa.int64()) for i in range(4)], names=["node", "pivot", "slice", "class"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "pivot", "slice", "class", "n", "sketch")), strict=True):
                if row[1:3] != at:
                    if at:
                        yield found()
                    at, rows = row[1:3], []
                rows.append(row)
        if at:
            yield found()

    return run


def _sorted_regions(rows: DataFrame) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "pivot", "slice").sortWithinPartitions("pivot", "slice", F.desc("first"), "node")


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(size_checked_broadcast(rows, MAX_SENT), "node")


def _slices(homes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each region the number of slices, so that each has SLICE members and SLICE_WEIGHT shingles or so."""
    per = homes.join(sizes, "node").groupBy("pivot").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    return per.select("pivot", F.greatest(F.ceil(F.col("m") / SLICE), F.ceil(F.col("w") / SLICE_WEIGHT)).cast("long").alias("slices"))


def components(links: DataFrame) -> DataFrame:
    """(node, class) of the connected components of links (a, b), the class being the smallest node: large and small stars in turn."""
    edges = materialised(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialised(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialised(small.where("u != v").distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
        before = state


def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 75, row: str | None = None) -> DataFrame:
    """Classes of documents that are linked, directly or through others, by Jaccard similarity of ``percent`` or more.

    docs: doc_id, text; other columns are ignored, but for the one that ``row`` names, which no two rows share.  Returns
    doc_id, row (string, null without that column), n_shingles (long), component_id (the smallest doc_id of the class)
    and representative, one row per row of docs.  Of each class one row is representative, that of the smallest doc_id
    and then row; without a column for rows all that have this doc_id.
    A null or wordless text has no shingles and is a class of its own.  Repeated doc_ids are kept as rows.
    An empty table gives an empty result.  A null doc_id counts as larger than all others within its class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs if row else with_row_keys(docs, "_jaccard_row")
    text = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row or "_jaccard_row").cast("string").alias("row"), F.col("text").cast("string").alias("text"))
    profile = materialised(text.mapInArrow(lean(_profile(n)), "doc_id long, row string, key long, n long, hash long, count long"), "profile")
    known = profile.where("hash is null").select("doc_id", "row", F.col("key").alias("node"), "n")
    frequent = profile.where("hash is not null").groupBy("hash").agg(F.sum("count").alias("c"), F.min("key").alias("pivot")).where(F.col("c") >= HOT)
    hot = frequent.orderBy(F.desc("c"), "hash").limit(MAX_HOT).toPandas()
    table = (hot["hash"].to_numpy(np.int64).view(np.uint64), -np.arange(len(hot)), hot["pivot"].to_numpy(np.int64))
    order = np.argsort(table[0])
    hot = spark.sparkContext.broadcast(tuple(x[order] for x in table))  # ranks: the rarer of the frequent come first

    total = known.agg(F.sum("n")).first()[0] or 0
    ranges = max(partitions(spark), int(total * 4 // RANGE) + 1)  # a window has a fourth of the shingles, with 16 bytes each
    cells = text.drop("row").mapInArrow(lean(_cells(n, percent, ranges, hot)), "r int, hashes binary, keys binary, pivots binary")
    members = materialised(cells.repartitionById(ranges, F.col("r")).mapInArrow(lean(_members(percent)), "cell long, node long, pivot long"), "cells")

    # home regions: the pivot that a node meets most often
    met = members.where("node != pivot").groupBy("node", "pivot").count()
    homes = met.groupBy("node").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("pivot"))
    sizes = known.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("row").alias("row"))
    nodes = members.select("node").union(members.select("pivot")).distinct()
    needed = materialised(sizes.join(nodes, "node"), "nodes")
    one = size_checked_broadcast(needed.select("row"), MAX_SENT)

    def with_sets(batches):
        for _, keys, sets in _chunks(batches, n):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([packed(sketch(s)) if len(s) else b"" for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "sketch", "shingles"])

    # one row of each node that is needed: copies and repeated rows must not meet in a region
    sets = materialised(text.join(one, "row", "left_semi").select("doc_id", "text").mapInArrow(lean(with_sets), "node long, n long, sketch binary, shingles binary"), "sets")
    sizes = needed.select("node", "n")
    sketches, shingles = sets.select("node", "n", "sketch"), sets.select("node", "shingles")
    of_pivot = sketches.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
    homes = materialised(homes.join(sketches, "node").join(of_pivot, "pivot").mapInArrow(lean(_sketched_pairs(percent)), "node long, pivot long"), "near")

    per = materialised(_slices(homes, sizes), "slices")
    rows = homes.join(per, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), "slices").alias("slice"), F.lit(False).alias("first"))
    rows = rows.union(per.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(True)))
    rows = _with_sets(rows, shingles).withColumn("class", F.col("node"))
    links = materialised(_sorted_regions(rows).mapInArrow(lean(_join_regions(percent)), "a long, b long"), "links")
    classes = materialised(components(links), "classes")

    # cells with members of several classes: regions again, with all that the windows put there
    of_class = members.join(size_checked_broadcast(classes, MAX_SENT), "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = of_class.groupBy("cell").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("cell")
    window = materialised(of_class.join(mixed, "cell", "left_semi").groupBy("pivot", "node").agg(F.first("class").alias("class")), "windows")
    rows = _sorted_regions(_blocks(window, sizes).join(sketches, "node"))
    rows = materialised(rows.mapInArrow(lean(_sketched_regions(percent)), "node long, pivot long, slice long, class long"), "candidates")
    rows = _with_sets(rows.withColumn("first", F.lit(False)), shingles)
    more = _sorted_regions(rows).mapInArrow(lean(_join_regions(percent)), "a long, b long")
    merged = components(links.union(more))

    owner = known.join(merged, "node", "left").withColumn("class", F.coalesce("class", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    several = owner.where("class is not null").groupBy("class").agg(first.alias("first"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    several = materialised(several, "firsts")
    out = owner.join(size_checked_broadcast(several, MAX_SENT), "class", "left")
    chosen = F.col("first").isNull() | F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    chosen, named = (chosen & (F.col("first").isNull() | (F.col("first.row") == F.col("row"))), F.col("row")) if row else (chosen, F.lit(None).cast("string"))
    return out.select("doc_id", named.alias("row"), F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), chosen.alias("representative"))


def _blocks(window: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of the second regions in slices such that every pair of different classes meets in one.

    In each region the members of its largest class need no comparing among themselves: they are dealt out once for
    each slice of the others, the others once for each slice of them and for each pair of their own slices.
    """
    counts = window.join(sizes, "node").groupBy("pivot", "class").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    regions = counts.groupBy("pivot").agg(F.max_by("class", F.struct("m", "class")).alias("major"), F.max("m").alias("big"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max_by("w", F.struct("m", "class")).alias("big_w"))
    pieces = lambda m, w: F.greatest(F.ceil(m / SLICE), F.ceil(w / SLICE_WEIGHT)).cast("long")
    regions = materialised(regions.select("pivot", "major", pieces(F.col("big"), F.col("big_w")).alias("ka"), pieces(F.col("m") - F.col("big"), F.col("w") - F.col("big_w")).alias("kb")), "regions")
    rows = window.join(regions, "pivot").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("class") == F.col("major"), F.col("ka")).otherwise(F.col("kb"))))
    long = lambda x: F.lit(x).cast("long")
    to_others = F.transform(F.sequence(long(0), F.col("kb") - 1), lambda j: F.col("own") * F.col("kb") + j)  # (major slice, other slice)
    to_major = F.transform(F.sequence(long(0), F.col("ka") - 1), lambda i: i * F.col("kb") + F.col("own"))
    pair = lambda j: (F.col("ka") + F.least(j, F.col("own"))) * F.col("kb") + F.greatest(j, F.col("own"))
    among = F.when(F.col("kb") > 1, F.transform(F.sequence(long(0), F.col("kb") - 1), pair)).otherwise(F.array().cast("array<long>"))
    rows = rows.where("kb > 0").withColumn("slice", F.explode(F.when(F.col("class") == F.col("major"), to_others).otherwise(F.concat(to_major, among))))
    return rows.select("node", "pivot", "slice", F.lit(False).alias("first"), "class")
