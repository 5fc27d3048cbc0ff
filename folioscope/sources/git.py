"""What a git repository says, as Python data sources: its files, and which paths each commit touched and when.

The driver asks for the newest commit and the number of commits only. History is cut into ranges of commits, each of which a task
reads from a git process of its own as it comes, in Arrow batches; filters on paths go to git as its own path filters. The
repository must lie where all machines reach it.
"""

from __future__ import annotations

import posixpath
import subprocess
import unicodedata
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from folioscope.storage import materialised

#: Commits that a task reads, and that a search for the newest of some paths reads first.
RANGE, FIRST = 2_000, 8_000
#: Rows of an Arrow batch.
BATCH = 10_000
#: Paths up to which a filter goes to git; beyond it all names are read and filtered by Spark.
PATHS = 2_000


def _command(repo: str, *words: str) -> list[str]:
    return ["git", "-C", repo, "-c", "core.quotePath=false", *words]


def _answer(repo: str, *words: str, timeout: float | None = None) -> str | None:
    """A short answer of git; None where it can't give one."""
    try:
        return subprocess.run(_command(repo, *words), capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace").strip()
    except (OSError, subprocess.SubprocessError):
        return None


@contextmanager
def _records(repo: str, *words: str):
    """What git writes, as texts that NUL ends, while it writes; a failure is raised at the end, not if the reader stops before."""
    process = subprocess.Popen(_command(repo, *words), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def each() -> Iterator[str]:
        rest = b""
        while chunk := process.stdout.read(1 << 16):
            *whole, rest = (rest + chunk).split(b"\0")
            yield from (x.decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")
        if process.wait():
            raise OSError(f"git failed in {repo}")

    try:
        yield each()
    finally:
        process.kill()
        process.stdout.close()
        process.wait()


def _key(path: str) -> str:
    """A path's spelling for comparison, that of ``functions.text.path_key``."""
    return posixpath.normpath(unicodedata.normalize("NFC", path.replace("\\", "/")))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema, strict=True)], schema=schema)


@dataclass
class _Range(InputPartition):
    skip: int
    n: int


class _LogReader(DataSourceReader):
    schema = pa.schema([("path", pa.string()), ("ct", pa.int64())])

    def __init__(self, options: dict):
        self.repo, self.head = options["path"], options["head"]
        self.skip, self.n, self.step = int(options.get("skip", 0)), int(options["n"]), int(options.get("range") or RANGE)
        self.wanted: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) and f.attribute == ("path",) else list(f.value) if isinstance(f, In) and f.attribute == ("path",) else None
            if values is not None and len(values) <= PATHS and self.wanted is None:
                # git compares bytes: names may be stored decomposed
                self.wanted = sorted({unicodedata.normalize(form, v) for v in values if v is not None for form in ("NFC", "NFD")})
            yield f  # names are compared once more by Spark

    def partitions(self) -> list[_Range]:
        return [_Range(a, min(self.step, self.skip + self.n - a)) for a in range(self.skip, self.skip + self.n, self.step)] if self.wanted != [] else []

    def _rows(self, part: _Range) -> Iterator[tuple[str, int]]:
        # the range is taken of all commits; which of them touch the paths is asked of that range alone
        with _records(self.repo, "rev-list", f"--skip={part.skip}", f"--max-count={part.n}", self.head) as found:
            commits = "".join(found)
        names = ["--", *(f":(literal){w}" for w in self.wanted)] if self.wanted else []
        process = subprocess.Popen(_command(self.repo, "diff-tree", "--stdin", "-z", "-r", "--root", "--no-renames", "--relative", "--name-only", "--format=%x01%ct", *names), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        text = process.communicate(commits.encode())[0].decode("utf-8", "replace")
        if process.returncode:
            raise OSError(f"git failed in {self.repo}")
        for block in text.split("\x01")[1:]:
            time, *paths = block.split("\0")
            yield from ((_key(p.lstrip("\n")), int(time.strip())) for p in paths if p.strip("\n"))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _batches(self._rows(partition), self.schema)


class GitLog(DataSource):
    """(path, ct) of the commits of ``head`` from ``skip`` on, ``n`` of them; each path of each commit below the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "path string, ct long"

    def reader(self, schema) -> _LogReader:
        return _LogReader(self.options)


class _FilesReader(DataSourceReader):
    schema = pa.schema([("path", pa.string())])

    def __init__(self, options: dict):
        self.repo, self.parts = options["path"], int(options.get("parts", 4))

    def partitions(self) -> list[_Range]:
        return [_Range(i, self.parts) for i in range(self.parts)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with _records(self.repo, "ls-files", "-z") as names:
            yield from _batches(((n,) for n in names if n and zlib.crc32(n.encode()) % partition.n == partition.skip), self.schema)


class GitFiles(DataSource):
    """(path) of the files under version control below the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> _FilesReader:
        return _FilesReader(self.options)


def use(spark: SparkSession) -> None:
    """Makes both sources known to a session and lets filters go to them."""
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tracked_files(spark: SparkSession, repo: str) -> DataFrame:
    """(path) of the files under version control; none where git can't answer."""
    use(spark)
    if _answer(repo, "rev-parse", "--is-inside-work-tree") is None:
        return spark.createDataFrame([], "path string")
    return spark.read.format("git_files").load(repo)


def _history(root: str, timeout: float) -> tuple[str, int] | None:
    """The newest commit and the number of all; None where git can't answer."""
    head = _answer(root, "rev-parse", "--verify", "HEAD", timeout=timeout)
    n = _answer(root, "rev-list", "--count", head, timeout=timeout) if head else None
    return (head, int(n)) if n else None


def commits(spark: SparkSession, root: str, *, timeout: float = 10, step: int = RANGE) -> DataFrame | None:
    """(path, ct): each path of each commit below a folder with the commit's time; paths in the form ``path_key`` gives.

    None where git can't answer (no repository, no git, no answer in time), which ``freshness.drift`` takes to mean that
    nothing can be told. Filters on ``path`` go to git; a task reads ``step`` commits.
    """
    use(spark)
    found = _history(root, timeout)
    if found is None:
        return None
    return spark.read.format("git_log").option("head", found[0]).option("n", found[1]).option("range", step).load(root)


def newest(spark: SparkSession, root: str, wanted: DataFrame, *, timeout: float = 10, first: int = FIRST) -> DataFrame | None:
    """(path, ct): when each wanted path (path, in the form of ``path_key``) was last committed; no row for those that never were.

    History is read from its newest end, twice as far each time, until all are found or it ends, so recent files cost recent
    commits only. Commits that a later stretch holds count as older, whatever their clocks said. None as for ``commits``.
    """
    use(spark)
    history = _history(root, timeout)
    if history is None:
        return None
    head, n = history
    left, found, skip = materialised(wanted.select("path").where("path is not null").distinct(), "wanted"), None, 0
    while skip < n and not left.isEmpty():
        some = [r["path"] for r in left.limit(PATHS + 1).collect()]
        rows = spark.read.format("git_log").option("head", head).option("skip", skip).option("n", min(first, n - skip)).load(root)
        rows = rows.where(F.col("path").isin(some)) if len(some) <= PATHS else rows.join(left, "path", "left_semi")
        rows = materialised(rows.groupBy("path").agg(F.max("ct").alias("ct")), "commits")
        found = rows if found is None else found.unionByName(rows)
        left, skip, first = materialised(left.join(rows, "path", "left_anti"), "wanted"), skip + first, 2 * first
    return spark.createDataFrame([], "path string, ct long") if found is None else found
