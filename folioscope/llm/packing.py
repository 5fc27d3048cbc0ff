"""Order-preserving packing of documents into sequences by dynamic programming.

The documents of a partition, in their order, are one row of tokens.  Windows of at most ``room`` tokens are cut from it
so that padding plus penalties for cuts is least: nothing for a cut between documents, ``SENTENCE`` at the end of a
sentence, ``WITHIN`` elsewhere, which is only offered in sentences longer than ``LONG`` tokens, every STRIDE tokens.
With f(j) the least cost of windows that end at j, f(j) = penalty(j) + room + min f(i) over i in [j - room, j), up to a
constant; a monotone queue holds the minimum of that sliding range, so the work is linear.

The row is packed in stretches of STRETCH tokens whose last, unfinished window is carried over.  At the end of a
partition the remainder is cut into powers of two, which need no padding.  Partitions are independent: there is no
shuffle, and a lost task gives the same sequences again.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import WordBpe, loaded

SENTENCE, WITHIN, LONG, STRIDE = 4, 48, 256, 64
STRETCH = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(ends: np.ndarray, penalties: np.ndarray, room: int) -> list[int]:
    """Cut positions, ascending, from candidates ``ends`` (ascending, at most room apart): those of least cost.

    The last cut is the candidate from which no further full window is needed; what lies behind it stays open.
    """
    cost, back = [0], [-1]
    at = [0, *ends.tolist()]
    queue: deque[int] = deque([0])
    for k, (j, penalty) in enumerate(zip(at[1:], penalties.tolist(), strict=True), 1):
        while at[queue[0]] < j - room:
            queue.popleft()
        best = queue[0]
        c = cost[best] + penalty + room
        cost.append(c)
        back.append(best)
        while queue and cost[queue[-1]] > c:
            queue.pop()
        queue.append(k)
    total = at[-1]
    # the last window is open: of the candidates within reach of the end the one with the least cost per token
    last = min((k for k in range(len(at) - 1, -1, -1) if total - at[k] <= room), key=lambda k: (cost[k] - at[k], -k))
    out = []
    while last > 0:
        out.append(at[last])
        last = back[last]
    return out[::-1]


def _candidates(ids: np.ndarray, bounds: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end: documents' ends, ends of sentences, and places in long sentences; and their penalties."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int64)
    penalty[np.flatnonzero(stops[np.minimum(ids, len(stops) - 1)]) + 1] = SENTENCE
    penalty[bounds] = 0
    penalty[len(ids)] = max(penalty[len(ids)], 0)
    at = np.concatenate(([0], np.flatnonzero(penalty[1:] >= 0) + 1))
    wide = np.flatnonzero(np.diff(at) > LONG)
    for k in wide.tolist():
        penalty[at[k] + STRIDE : at[k + 1] : STRIDE] = WITHIN
    ends = np.flatnonzero(penalty[1:] >= 0) + 1
    return ends, penalty[ends]


class Packer:
    """Takes documents in their order and gives rows of pieces."""

    def __init__(self, room: int, stops: np.ndarray, first_sequence: int) -> None:
        self.room, self.stops, self.sequence = room, stops, first_sequence
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.begun = 0  # tokens of the first document that are packed already
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids))
        self.size += len(ids)
        return self._pack(last=False) if self.size >= STRETCH else []

    def close(self) -> list[tuple]:
        return self._pack(last=True) if self.docs else []

    def _pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate([x for _, x in self.docs])[self.begun :]
        bounds = np.cumsum([len(x) for _, x in self.docs]) - self.begun
        ends = cuts(*_candidates(ids, bounds, self.stops), self.room)
        if last:  # what is left goes into powers of two, unless it fills a sequence but for a cut's penalty
            at = ends[-1] if ends else 0
            while (left := len(ids) - at) > 0:
                at = len(ids) if left <= self.room and (left & (left - 1) == 0 or self.room - left <= WITHIN) else at + min(self.room, 1 << (left.bit_length() - 1))
                ends.append(at)
        rows, k, used = [], 0, self.begun
        start = 0
        for end in ends:
            offset = 0
            while start < end:
                doc_id, own = self.docs[k]
                n = min(end - start, len(own) - used)
                if n:
                    piece = own[used : used + n]
                    rows.append((doc_id, used, n, zlib.crc32(piece.astype("<u4").tobytes()), len(own), self.sequence, offset))
                start, offset, used = start + n, offset + n, used + n
                if used == len(own):
                    k, used = k + 1, 0
            self.sequence += 1
        self.docs, self.begun = self.docs[k:], used
        self.size = sum(len(x) for _, x in self.docs) - used
        return rows


def pack(docs: DataFrame, *, tokenizer: str, room: int = 4096, end_id: int = 2) -> DataFrame:
    """All documents as pieces of sequences of at most ``room`` tokens.

    docs: doc_id, text; other columns are ignored.  tokenizer: path of the word-level BPE file, the same on all
    executors.  Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or
    empty text is its end token alone.  Repeated rows are packed as they come, each with all its tokens; an empty table
    gives an empty result.  A document may be longer than a sequence.
    """

    def run(batches):
        bpe = loaded(WordBpe, tokenizer)
        stops = np.zeros(max(bpe.stops, default=0) + 2, dtype=bool)
        stops[list(bpe.stops)] = True
        packer = Packer(room, stops, TaskContext.get().partitionId() << 40)

        def rows(found):
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), bpe.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    found = packer.add(doc_id, np.append(ids, np.int32(end_id)))
                    if found:
                        yield rows(found)
        yield rows(packer.close())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
