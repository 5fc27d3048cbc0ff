"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled by two models, one of the toxic and one of the ordinary labelled documents.  The next letter after the
last ORDER - 1 ones has the class's own discounted count, and what the discount takes is given out by lower orders that
both classes share: numbers of different words of the whole corpus (not of their occurrences) that hold the letters.
A word's log ratio is the sum over its letters; rare and unseen words are judged by the expressions they are built of.
A document is judged by the ratio normalised by its length, over all its words and over its most telling ones; a
logistic function of these, fitted on labelled documents that the models of that fit haven't seen, is the score.

Counting and scoring are one pass each over all documents.  The models hold contexts of the toxic class only (in others
both classes back off alike), so their size is bounded by the labelled sample, of SAMPLE documents at most.  They are
sorted arrays; runs of letters are known by 64 bits of a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import _splitmix, lean, materialised, mix, texts
from folioscope.storage import small_batches

ORDER = 8
DISCOUNT = 0.75
#: A context is modelled if the toxic documents have it so often, in the words of each document.
SEEN = 2
#: Labelled documents from which the models are fitted unless told otherwise (those of least hash, if there are more).
SAMPLE = 15_000
#: Words counted in a task before they are passed on, letters that are hashed at once, characters of texts that are judged at once.
MEMORY, LETTERS, TEXTS = 300_000, 200_000, 2_000_000
#: How many of a document's most telling words are looked at, beside all of them; a word's ratio counts up to MOST.
TOP, MOST = (1, 2, 3, 5), 12.0
FEATURES = 2 + len(TOP)
COUNTS = ("toxic_a", "plain_a", "toxic_b", "plain_b")

_WORD = re.compile(r"[^\W\d_]+")


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: What stands before a word's first letter, and behind its last.
BEFORE, BEHIND = "^" * (ORDER - 1), "$"


def spelled(word: str) -> str:
    return BEFORE + word + BEHIND


_FACTORS = _splitmix(29, ORDER + 1)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spelled words' letters in a row, the places at which runs end that are counted, and the word of each place."""
    whole = BEFORE + (BEHIND + BEFORE).join(words) + BEHIND
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(word)) + (word + 1) * (ORDER - 1)
    return codes, at, word


def _run(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k letters that end at each place."""
    out = np.full(len(at), k, dtype=np.uint64) * _FACTORS[ORDER]
    for j in range(k):
        out += codes[at - j] * _FACTORS[j]
    return mix(out)


class Keys:
    """Sorted 64-bit hashes, with the places at which those of each beginning start."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, len(keys).bit_length() + 2)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted ones are there, and where."""
        head = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[head], self.start[head + 1]
        some = np.flatnonzero(at < end)
        at, end, wanted = at[some], end[some], wanted[some]
        found = []
        while len(some):
            hit = self.keys[at] == wanted
            found.append((some[hit], at[hit]))
            at += 1
            more = np.flatnonzero(~hit & (at < end))
            some, at, end, wanted = some[more], at[more], end[more], wanted[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2


def _parts(words: list[str]):
    """The words in lists of about LETTERS letters."""
    total = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER)
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LETTERS, "right")))
        yield words[a:b]
        a = b


class Model:
    """Log ratios of letters in context: of those seen, and of contexts for letters not seen."""

    def __init__(self, grams: np.ndarray, contexts: np.ndarray, toxic: np.ndarray, plain: np.ndarray, shares: np.ndarray) -> None:
        """Of each run of ORDER letters: its hash and its context's, counts of both classes, the last letter's share by the lower orders."""
        own, of = np.unique(contexts, return_inverse=True)
        total = [np.bincount(of, n, len(own)) for n in (toxic, plain)]
        kinds = [np.bincount(of, n > 0, len(own)) for n in (toxic, plain)]
        left = [np.where(t > 0, DISCOUNT * k / np.maximum(t, 1), 1.0) for t, k in zip(total, kinds, strict=True)]
        known = total[0] > 0
        self.contexts, self.unseen = Keys(own[known]), np.log(left[0][known] / left[1][known])
        a, b = (np.maximum(n - DISCOUNT, 0) / np.maximum(t[of], 1) + rest[of] * shares for n, t, rest in zip((toxic, plain), total, left, strict=True))
        rows = np.flatnonzero(known[of])
        rows = rows[np.argsort(grams[rows])]
        self.grams, self.seen = Keys(grams[rows]), np.log(a[rows] / b[rows])

    def ratios(self, words: list[str]) -> np.ndarray:
        """The log ratio of each word."""
        out = [np.zeros(0)]
        for part in _parts(words):
            codes, at, word = _letters(part)
            x = np.zeros(len(at))
            for keys, values, run in ((self.contexts, self.unseen, _run(codes, at - 1, ORDER - 1)), (self.grams, self.seen, _run(codes, at, ORDER))):
                i, j = keys.find(run)
                x[i] = values[j]
            out.append(np.bincount(word, x, len(part)))
        return np.concatenate(out)

    def _features(self, texts: list[list[str]]) -> np.ndarray:
        """Of each text's words: the ratios normalised by length, per word, per root of the words, and per word of the most telling ones."""
        size = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), FEATURES))
        if not size.sum():
            return out
        coded = pa.array(list(chain.from_iterable(texts)), pa.string()).dictionary_encode()
        ratio = np.minimum(self.ratios(coded.dictionary.to_pylist()), MOST)
        of, word = np.repeat(np.arange(len(texts)), size), coded.indices.to_numpy()
        total, some = np.bincount(of, ratio[word], len(texts)), np.maximum(size, 1)
        out[:, 0], out[:, 1] = total / some, total / np.sqrt(some)
        by = np.argsort(-ratio)
        rank = np.empty_like(by)
        rank[by] = np.arange(len(by))
        told = np.sort(of * len(by) + rank[word])
        of, word = np.divmod(told[np.append(True, told[1:] != told[:-1])], len(by))  # a word that is repeated tells once
        own = ratio[by[word]]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        for k, n in enumerate(TOP, 2):
            first = place < n
            out[:, k] = np.bincount(of[first], own[first], len(texts)) / n
        return out

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """A row of features for each text; words are spelled for many texts at once."""
        out: list[np.ndarray] = []
        part: list[list[str]] = []
        size = 0
        for text in texts:
            part.append(words_of(text or ""))
            size += len(text or "")
            if size > TEXTS:
                out.append(self._features(part))
                part, size = [], 0
        out.append(self._features(part))
        return np.concatenate(out)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last one constant) of a ridge logistic regression by Newton's method, on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge * len(x) / 10 + 1e-3)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w[:-1] / scale
    return np.append(out, w[-1] - out @ mean)


def _grams(word: str, k: int) -> set[str]:
    """The runs of k letters of a spelled word that end in it or at its end mark."""
    s = spelled(word)
    return {s[i : i + k] for i in range(ORDER - k, len(s) - k + 1)}


def _count_words(batches):
    """Of each word of the batches: how many labelled documents of each kind have it."""
    every: set[str] = set()
    found: dict[str, list[int]] = {}

    def out():
        every.difference_update(found)
        counts = np.zeros((len(found) + len(every), 4), dtype=np.int64)
        if found:
            counts[: len(found)] = list(found.values())
        return pa.record_batch([pa.array([*found, *every], pa.string()), *(pa.array(counts[:, i]) for i in range(4))], names=["word", *COUNTS])

    for batch in batches:
        for text, kind in zip(texts(batch.column("text")), batch.column("kind").to_pylist(), strict=True):
            words = words_of(text or "")
            if kind is None:
                every.update(words)
            else:
                for w in set(words):
                    found.setdefault(w, [0, 0, 0, 0])[kind] += 1
            if len(every) + len(found) > MEMORY:
                yield out()
                every.clear()
                found.clear()
    yield out()


def _labelled_grams(batches):
    for batch in batches:
        found: dict[str, list[int]] = {}
        for word, *counts in zip(batch.column("word").to_pylist(), *(batch.column(c).to_pylist() for c in COUNTS), strict=True):
            for g in _grams(word, ORDER):
                c = found.setdefault(g, [0, 0, 0, 0])
                for i in range(4):
                    c[i] += counts[i]
        yield pa.record_batch([pa.array(list(found), pa.string()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in range(4))], names=["gram", *COUNTS])


def _lower_grams(wanted):
    def run(batches):
        grams, contexts = ([Keys(x) for x in own] for own in wanted.value)
        for batch in batches:
            for words in _parts(batch.column("word").to_pylist()):
                codes, at, word = _letters(words)
                for k in range(1, ORDER):
                    before = _run(codes, at - 1, k - 1)
                    own, _ = contexts[k - 1].find(before)
                    if len(own):
                        key = _run(codes, at[own], k)
                        by = np.argsort(key, kind="stable")  # of equal ones each word's are together
                        key, own = key[by], own[by]
                        of = word[own]
                        first = np.append(True, key[1:] != key[:-1])
                        once = np.append(True, of[1:] != of[:-1]) | first  # a word that has the letters twice counts once
                        first = np.flatnonzero(first)
                        n = np.add.reduceat(once.astype(np.int64), first)
                        key, before = key[first], before[own[first]]
                        known = np.zeros(len(key), dtype=bool)
                        known[grams[k - 1].find(key)[0]] = True
                        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(before.view(np.int64)), pa.array(n), pa.array(known)], names=["gram", "context", "n", "wanted"])

    return run


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of longs, the first of which are hashes, in their order."""
    columns = [c.to_numpy() for c in df.toArrow().columns]
    by = np.argsort(columns[0].view(np.uint64))
    return [columns[0].view(np.uint64)[by], *(c[by].astype(np.float64) for c in columns[1:])]


def _shares(codes: np.ndarray, at: np.ndarray, lower: DataFrame) -> np.ndarray:
    """Of each run of ORDER letters the last one's share after the others, by the lower orders."""
    contexts, total, kinds = _arrays(lower.groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")))
    grams, n = _arrays(lower.where("wanted").select("gram", "n"))
    out = np.full(len(at), 1 / 5000)  # of all letters there are
    contexts, grams = Keys(contexts), Keys(grams)
    for k in range(1, ORDER):
        known, i = contexts.find(_run(codes, at - 1, k - 1))
        seen, j = grams.find(_run(codes, at, k))
        own = np.zeros(len(at))
        own[seen] = n[j]
        out[known] = np.maximum(own[known] - DISCOUNT, 0) / total[i] + DISCOUNT * kinds[i] / total[i] * out[known]
    return out


def _fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model of all labelled documents of the sample, and the weights of its features."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(fold != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    kind = F.when(fold == 3, 2).otherwise(0) + F.when(F.col("toxic") == 1, 0).otherwise(1)
    known = materialised(known.select("doc_id", kind.alias("kind")), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id", "left")  # as many rows as the sample
    counted = rows.select("text", "kind").mapInArrow(lean(_count_words), "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    words = materialised(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)), "words")
    labelled = words.where(" + ".join(COUNTS) + " > 0").mapInArrow(lean(_labelled_grams), "gram string, " + ", ".join(f"{c} long" for c in COUNTS))
    grams = labelled.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumn("context", F.substring("gram", 1, ORDER - 1))
    grams = materialised(grams, "grams")
    often = grams.groupBy("context").agg(F.sum(F.col("toxic_a") + F.col("toxic_b")).alias("_n")).where(F.col("_n") >= SEEN).select("context")
    kept = grams.join(often, "context").select("gram", *COUNTS).toArrow()  # bounded by the sample
    codes = np.concatenate([np.empty(0, dtype=np.uint64), *(np.frombuffer("".join(c.to_pylist()).encode("utf-32-le"), dtype=np.uint32) for c in kept["gram"].chunks)], dtype=np.uint64)
    at = np.arange(ORDER - 1, len(codes), ORDER)
    toxic_a, plain_a, toxic_b, plain_b = (kept[c].to_numpy().astype(np.float64) for c in COUNTS)
    del kept
    suffixes, contexts = ([np.unique(_run(codes, at - j, k - j)) for k in range(1, ORDER)] for j in (0, 1))
    sent = spark.sparkContext.broadcast((suffixes, contexts))
    lower = words.select("word").mapInArrow(lean(_lower_grams(sent)), "gram long, context long, n long, wanted boolean")
    lower = materialised(lower.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted")), "lower")
    sent.destroy()
    own = _run(codes, at, ORDER), _run(codes, at - 1, ORDER - 1)
    shares = _shares(codes, at, lower)
    first = spark.sparkContext.broadcast(Model(*own, toxic_a, plain_a, shares))
    found = rows.where("kind >= 2").select("doc_id", "text", "kind").mapInArrow(lean(_features(first)), "doc_id long, kind int, features array<double>")
    found = found.groupBy("doc_id").agg(F.min("kind").alias("kind"), F.min("features").alias("features")).collect()  # an id that is repeated counts once
    y = np.array([r["kind"] == 2 for r in found], dtype=float)
    if len(set(y.tolist())) < 2:
        weights = np.array([0.0] * FEATURES + [-30.0 if not y.sum() else 30.0])
        counts = known.groupBy("kind").count().collect()
        toxic, plain = (sum(r["count"] for r in counts if r["kind"] % 2 == k) for k in (0, 1))
        if toxic and plain:  # both classes are there, but not where the weights would be fitted
            weights[1], weights[-1] = 0.5, np.log(toxic / plain)
    else:
        weights = logistic(np.array([r["features"] for r in found]), y)
    first.destroy()
    return Model(*own, toxic_a + toxic_b, plain_a + plain_b, shares), weights


def _features(model):
    def run(batches):
        for batch in batches:
            found = model.value.features(texts(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("kind"), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["doc_id", "kind", "features"])

    return run


def _scores(model: Model, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.features(texts(column)) @ weights[:-1] + weights[-1], -500, 500)))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """A score of toxicity for every document.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1, null: not labelled); other columns are ignored.  Labels are
    learnt from documents whose crc32(doc_id as text) mod 4 isn't 2, at most ``sample`` of them.  Returns, one row per row
    of docs, doc_id, held_out (that remainder is 2), score (0 to 1), predicted (1 from the threshold on).  A null or empty
    text has no words and gets the constant part of the score.  Repeated rows get equal scores; a labelled id that is
    repeated counts once for the weights.  Without labels of both classes all scores are those of the one class there is,
    0 without any.  A null doc_id is in no fold and isn't held out.
    """
    model, weights = _fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            score = _scores(*sent.value, batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array([i is not None and fold_of(i) == 2 for i in ids], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score stays below the threshold; see ``toxicity``."""
    model, weights = _fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(*sent.value, batch.column("text")) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
