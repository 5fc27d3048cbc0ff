"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only a region.

A document's pre-tokens lie in leaves of LEAF or so; a leaf keeps its length in characters and its tokens, and a heap of
partial sums over the leaves gives counts of whole documents and of prefixes.  An edit replaces characters [start, end)
by other text.  Pre-tokens before the edit stay, except those next to it, whose cut may depend on what follows; after
it they stay from the first place where the new cut and the old one meet again.  Only the leaves between are cut and
encoded anew, and only the sums above them are computed again.  Counts are those of encoding the edited text afresh.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import ByteBpe, loaded

LEAF = 32
#: Pre-tokens before an edit whose cut may change with it: white space looks one character ahead, contractions three.
BACK = 3
TREE = "doc_id long, text string, chars array<int>, tokens array<int>, sums array<long>"


class Tree:
    """Leaves (characters, tokens) and the heap of sums: node 1 is the root, node i has the children 2i and 2i + 1."""

    __slots__ = ("chars", "tokens", "sums", "width")

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = chars, tokens
        self.rebuild()

    def rebuild(self) -> None:
        self.width = 1 << max(0, (len(self.tokens) - 1).bit_length())
        self.sums = [0] * self.width + self.tokens + [0] * (self.width - len(self.tokens))
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def prefix(self, leaves: int) -> int:
        """Tokens of the first so many leaves."""
        out, i = 0, leaves + self.width
        if leaves >= self.width:
            return self.total
        while i > 1:
            if i & 1:
                out += self.sums[i - 1]
            i >>= 1
        return out

    def splice(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves [first, last) replaced; sums are updated along the changed leaves if their number stays."""
        same = len(tokens) == last - first
        self.chars[first:last], self.tokens[first:last] = chars, tokens
        if not same:
            self.rebuild()
            return
        level = set()
        for k in range(first, last):
            self.sums[self.width + k] = self.tokens[k]
            level.add((self.width + k) >> 1)
        while level and 0 not in level:
            for i in level:
                self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            level = {i >> 1 for i in level}


def _leaves(pieces: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    return [sum(map(len, pieces[i : i + LEAF])) for i in range(0, len(pieces), LEAF)], [sum(counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]


def build(text: str, bpe: ByteBpe) -> Tree:
    pieces = bpe.pieces(text)
    return Tree(*_leaves(pieces, bpe.count(pieces)))


def edit(text: str, tree: Tree, start: int, end: int, new: str, bpe: ByteBpe) -> tuple[str, int]:
    """The edited text, and how many of its characters were cut and encoded again; the tree is updated in place.

    start and end are clipped to the text; the region grows leaf by leaf until both cuts meet at a leaf's end.
    """
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    out = text[:start] + new + text[end:]
    at, first, last, a = 0, 0, 0, 0
    starts = []
    for k, n in enumerate(tree.chars):
        starts.append(at)
        if at + n <= start:
            first = k + 1
        at += n
    first = max(0, min(first, len(starts)) - 1)  # the leaf before holds the context
    while first > 0 and start - starts[first] < 64:
        first -= 1
    a = starts[first] if starts else 0
    shift = len(new) - (end - start)
    last = first
    while last < len(starts) and starts[last] < end:
        last += 1
    extra = 1
    while True:
        stop = min(len(starts), last + extra)  # the first leaf that stays
        b = starts[stop] if stop < len(starts) else len(text)
        ahead = out[a : b + shift + 64] if stop < len(starts) else out[a:]
        pieces, done = [], 0
        for p in bpe.pieces(ahead):
            if stop < len(starts) and done >= b + shift - a:
                break
            pieces.append(p)
            done += len(p)
        if stop == len(starts) or done == b + shift - a:
            break
        extra *= 2
    # before the edit the old cut must hold at a: it does if the pieces up to the edit are the old ones
    counts = bpe.count(pieces)
    tree.splice(first, stop, *_leaves(pieces, counts))
    return out, done


def _batch(ids, texts, trees):
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int64()))], names=["doc_id", "text", "chars", "tokens", "sums"]
    )


def token_trees(docs: DataFrame, *, tokenizer: str) -> DataFrame:
    """The tree of every document: doc_id, text, chars, tokens, sums; sums[1] is the document's count.

    A null text counts as empty.  Repeated rows give repeated trees; other columns are ignored.
    """

    def run(batches):
        bpe = loaded(ByteBpe, tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield _batch(batch.column(0), texts, [build(t, bpe) for t in texts])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TREE)


def edited_trees(trees: DataFrame, edits: DataFrame, *, tokenizer: str) -> DataFrame:
    """Trees after edits (doc_id, seq, start, end, replacement), applied in order of seq to each document.

    Returns the columns of trees and re_encoded (long), the characters cut again.  Edits for unknown documents are
    ignored, documents without edits stay.  Null positions stand for the text's ends, a null replacement for "".
    """
    each = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    return _apply(trees.join(each, "doc_id", "left"), tokenizer)


def _apply(rows: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches):
        bpe = loaded(ByteBpe, tokenizer)
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("doc_id", "text", "chars", "tokens", "edits")}
            texts, trees, work = [], [], []
            for text, chars, tokens, edits in zip(cols["text"], cols["chars"], cols["tokens"], cols["edits"], strict=True):
                tree, again = Tree(chars, tokens), 0
                for e in edits or []:
                    size = len(text)
                    text, n = edit(text, tree, e["start"] if e["start"] is not None else 0, e["end"] if e["end"] is not None else size, e["replacement"] or "", bpe)
                    again += n
                texts.append(text)
                trees.append(tree)
                work.append(again)
            done = _batch(cols["doc_id"], texts, trees)
            yield pa.record_batch([*done.columns, pa.array(work, pa.int64())], names=[*done.schema.names, "re_encoded"])

    return rows.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(run, TREE + ", re_encoded long")


def revised_counts(docs: DataFrame, *, tokenizer: str, edits: list[tuple]) -> DataFrame:
    """Counts of every document before and after the same edits everywhere.

    edits: (start, end, replacement) with start and end as SQL expressions of ``n``, the length of the text before all
    edits.  Returns doc_id, n_chars, n_tokens, n_leaves, n_chars_edited, n_tokens_edited, re_encoded (long).
    """
    trees = token_trees(docs, tokenizer=tokenizer).withColumn("n", F.length("text"))
    own = F.array(*(F.struct(F.lit(k).alias("seq"), F.expr(a).cast("long").alias("start"), F.expr(b).cast("long").alias("end"), F.lit(new).alias("replacement")) for k, (a, b, new) in enumerate(edits)))
    rows = trees.withColumn("edits", own)

    def run(batches):
        bpe = loaded(ByteBpe, tokenizer)
        for batch in batches:
            out = []
            for doc_id, text, chars, tokens, todo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "chars", "tokens", "edits")), strict=True):
                tree, again, before = Tree(chars, tokens), 0, len(text)
                row = [doc_id, before, tree.total, len(tree.tokens)]
                for e in todo:
                    text, n = edit(text, tree, e["start"], e["end"], e["replacement"], bpe)
                    again += n
                out.append((*row, len(text), tree.total, again))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=["doc_id", "n_chars", "n_tokens", "n_leaves", "n_chars_edited", "n_tokens_edited", "re_encoded"])

    return rows.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_leaves long, n_chars_edited long, n_tokens_edited long, re_encoded long")
