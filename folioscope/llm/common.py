"""Helpers shared by the operators of this subpackage: tables, the shared folder, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words here: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


#: Bytes that a task gathers before it writes them as a row group.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which is set here only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_keys(docs: DataFrame, name: str) -> DataFrame:
    """The frame with a string column that no two rows share: file and place of a row.

    Rows that don't come from files are written first, since numbers that Spark gives them would change if a lost executor
    changed the splits.
    """
    key = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    try:
        return docs.withColumn(name, key)
    except AnalysisException:
        return materialised(docs, "rows").withColumn(name, key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Python workers --------------------------------------------------------------------------


def texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of a column, one by one; bytes that aren't UTF-8 become U+FFFD."""
    for x in column:
        try:
            yield x.as_py()
        except UnicodeDecodeError:
            yield x.as_buffer().to_pybytes().decode("utf-8", "replace")


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when it ends: workers are reused by tasks of other kinds."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


# --- word hashes -----------------------------------------------------------------------------

_M64 = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix(11, 256)
_BASE = 0x5851F42D4C957F2D
_CHUNK = 1 << 18
_power = _unpower = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    global _power, _unpower
    if len(_power) < n:
        n = min(max(n, 2 * len(_power), 1 << 14), max(n, _CHUNK))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _power, _unpower = both
    return _power, _unpower


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text, being what SPACES separate, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def window_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit number for each run of n words: a polynomial over the bytes of the run, words joined by one space.

    Long texts go in pieces that overlap by n - 1 words, which bounds the byte arrays.
    """
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(joined) > _CHUNK and len(words) > 2 * n:
        half = len(words) // 2
        return np.concatenate((window_hashes(words[: half + n - 1], n), window_hashes(words[half:], n)))
    b = np.frombuffer(joined, dtype=np.uint8)
    power, unpower = _powers(len(b))
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    gap = np.flatnonzero(b == 32)
    start = np.concatenate(([0], gap + 1))[: len(words) - n + 1]
    end = np.concatenate((gap, [len(b)]))[n - 1 :]
    return mix((total[end] - total[start]) * unpower[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence counts as one; without words none."""
    words = plain_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return mix(window_hashes(words, len(words)) + np.uint64(len(words)))
    found = window_hashes(words, n)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def size_checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the frame, counted first, has at most so many rows; else the frame as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
