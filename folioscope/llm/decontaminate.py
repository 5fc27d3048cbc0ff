"""Benchmark decontamination by greedy string tiling.

Five-word windows that a document shares with a benchmark item are seeds, found by Karp-Rabin hashes.  Seeds that follow
each other on both sides form matches.  The longest match whose words are all unmarked is marked as a tile, again and
again, until none of ``least`` words is left; so passages count whatever their order in the document.  A document is
contaminated if the tiles cover enough of an item's words.

Each document is judged alone, in one pass without any shuffle.  The benchmark goes to the executors in slices of at
most SLICE_WORDS words, which bounds what is sent; a larger benchmark takes more passes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, materialised, plain_words, texts, window_hashes
from folioscope.storage import small_batches

#: Words of benchmark items that are sent at once.
SLICE_WORDS = 500_000
_MARKS = b".,;:!?\"'()[]{}*#%&$|<>-_"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without the marks around them; words of marks only are left out."""
    return [x for w in plain_words(text) if (x := w.strip(_MARKS))]


def tiles(pairs: np.ndarray, least: int, n_doc: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of seeds (doc position, item position): tiles (doc position, item position, length).

    Longer tiles first; of equal ones the earliest in the item, then in the document.
    """
    order = np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))
    i, j = pairs[order, 0], pairs[order, 1]
    new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(i - j) != 0)))
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(i)]))) + least - 1
    heap = [(-n, b, a) for n, b, a in zip(size.tolist(), j[start].tolist(), i[start].tolist(), strict=True)]
    heapq.heapify(heap)
    of_doc, of_item = np.zeros(n_doc, dtype=bool), np.zeros(n_item, dtype=bool)
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        taken = of_doc[a : a + n] | of_item[b : b + n]
        if not taken.any():
            of_doc[a : a + n] = of_item[b : b + n] = True
            out.append((a, b, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is left of it
            if y - x >= least:
                heapq.heappush(heap, (x - y, b + x, a + x))
    return out


class Seeds:
    """The items' windows, sorted by hash."""

    def __init__(self, items: list[tuple[int, list[bytes]]], least: int) -> None:
        hashes = [window_hashes(w, least) for _, w in items]
        self.least, self.ids, self.words = least, [i for i, _ in items], [w for _, w in items]
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])[order] if hashes else np.empty(0, np.int64)
        self.at = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.empty(0, np.int64)

    def pairs(self, words: list[bytes]) -> np.ndarray:
        """(item, document position, item position) of all seeds."""
        own = window_hashes(words, self.least)
        if not len(own) or not len(self.hash):
            return np.empty((0, 3), np.int64)
        low = np.searchsorted(self.hash, own)
        hit = np.flatnonzero(self.hash[np.minimum(low, len(self.hash) - 1)] == own)
        if not len(hit):
            return np.empty((0, 3), np.int64)
        count = np.searchsorted(self.hash, own[hit], "right") - low[hit]
        doc = np.repeat(hit, count)
        entry = np.repeat(low[hit], count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        return np.column_stack((self.item[entry], doc, self.at[entry]))

    def coverage(self, words: list[bytes], coverage: float) -> list[tuple[int, float]]:
        """(item id, covered share) of the items whose share is at least ``coverage``."""
        found = self.pairs(words)
        out = []
        for k in np.unique(found[:, 0]).tolist():
            item = self.words[k]
            own = found[found[:, 0] == k, 1:]
            most = np.zeros(len(item) + 1, dtype=np.int64)  # no tiling covers more than all seeds together
            at = np.unique(own[:, 1])
            most[at] += 1
            np.subtract.at(most, at + self.least, 1)
            if (np.cumsum(most)[:-1] > 0).sum() < coverage * len(item):
                continue
            own = own[[words[i : i + self.least] == item[j : j + self.least] for i, j in own.tolist()]]
            share = sum(n for _, _, n in tiles(own, self.least, len(words), len(item))) / len(item) if len(own) else 0.0
            if share >= coverage:
                out.append((self.ids[k], share))
        return out


def _slices(benchmark: DataFrame, least: int) -> Iterator[tuple[Seeds, bool]]:
    """The benchmark's seeds in slices of SLICE_WORDS words or so, one at a time, and whether more follow."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = max(1, math.ceil(1.2 * size / SLICE_WORDS))
    for k in range(slices):
        own = [(r["item_id"], words_of(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()]
        yield Seeds([x for x in own if len(x[1]) >= least], least), k + 1 < slices


def _passes(rows: DataFrame, benchmark: DataFrame, least: int, step) -> DataFrame:
    """Rows after step(seeds) for each slice; between slices they are written, so only one slice is anywhere at a time."""
    small_batches(rows.sparkSession)
    for seeds, more in _slices(benchmark, least):
        sent = rows.sparkSession.sparkContext.broadcast(seeds)
        rows = rows.mapInArrow(lean(step(sent)), rows.schema)
        if more:
            rows = materialised(rows, "slice")
            sent.destroy()
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, *, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """Which documents contain benchmark items.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.  Returns, one row per row of docs, doc_id,
    contaminated, kept (its opposite), item_id (the item covered most, the smallest of equals; null if none), coverage
    (double, of that item, 0 if none) and n_items (long, how many items).  Null and empty texts are clean; items of fewer
    than ``least`` words cannot be found; with an empty benchmark all is clean; repeated rows are judged alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("_share"), F.lit(None).cast("long").alias("_item"), F.lit(0).cast("long").alias("_items"))
    rows = _passes(rows, benchmark, least, lambda seeds: _judge(seeds, coverage))  # each pass adds what its slice finds
    return rows.select("doc_id", (F.col("_items") > 0).alias("contaminated"), (F.col("_items") == 0).alias("kept"), F.col("_item").alias("item_id"), F.col("_share").alias("coverage"), F.col("_items").alias("n_items"))


def _judge(seeds, coverage: float):
    def run(batches):
        for batch in batches:
            ids, column, shares, items, counts = batch.columns
            top, more = [], []
            for text, share, item in zip(texts(column), shares.to_pylist(), items.to_pylist(), strict=True):
                found = seeds.value.coverage(words_of(text), coverage)
                top.append(min([(-c, i) for i, c in found] + ([(-share, item)] if item is not None else []), default=(0.0, None)))
                more.append(len(found))
            yield pa.record_batch([ids, column, pa.array([-c for c, _ in top], pa.float64()), pa.array([i for _, i in top], pa.int64()), pa.array([n + k for n, k in zip(counts.to_pylist(), more, strict=True)], pa.int64())], names=batch.schema.names)

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that contain no benchmark item; see ``contamination``."""

    def step(seeds):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not seeds.value.coverage(words_of(t), coverage) for t in texts(batch.column("text"))], pa.bool_()))

        return run

    return _passes(docs, benchmark, least, step)
