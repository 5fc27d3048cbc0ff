"""Tables in the folder that driver and executors share, broadcasts of checked size, scans spread over the cores."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task gathers before it writes them as a row group.
ROW_GROUP = 16 << 20
#: Bytes of the rows that go to a Python worker at once.
BATCH = 4 << 20
#: Rows up to which a side may be broadcast unless told otherwise.
MAX_SENT = 200_000
#: Digests of 64 bits up to which a side may be broadcast as such.
MAX_DIGESTS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which is set here only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    """A name in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of change (milliseconds) in a folder, in order; none where there is no folder."""
    folder, files = _path(spark, path)
    return sorted((x.getPath().getName(), x.getModificationTime()) for x in files.listStatus(folder)) if files.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    file, files = _path(spark, path)
    stream = files.open(file)
    try:
        scanner = spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
        return scanner.next() if scanner.hasNext() else ""
    finally:
        stream.close()


def put_new_text(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small text file in place whole, unless there is one of this name already; False then."""
    target, files = _path(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(temporary)
    stream.write(text.encode())
    stream.close()
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(temporary), files.makeQualified(target), none)
    except Py4JJavaError as e:
        files.delete(temporary, False)
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def checked_broadcast(df: DataFrame, rows: int = MAX_SENT) -> DataFrame:
    """A broadcast hint if the frame, counted first, has at most so many rows; else the frame as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def where_in(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose keys ``some`` has, without a shuffle of all rows: keys too many to be sent go as digests first, and what these let through is joined."""
    n, keys, digest = some.count(), some.select(on), F.xxhash64(*on)
    if n > MAX_SENT and n <= MAX_DIGESTS:
        rows = rows.withColumn("_digest", digest).join(F.broadcast(keys.select(digest.alias("_digest"))), "_digest", "left_semi").drop("_digest")
    return rows.join(F.broadcast(keys) if n <= MAX_SENT else keys, on, "left_semi")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by bytes, not only 10,000 at a time, which with long texts are as large as the texts are; a setting of the session's own stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, BATCH)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan dealt out by keys if it has fewer tasks than two for each core: small files have one row group, one task."""
    wanted = 2 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted, *keys) if scan.rdd.getNumPartitions() < wanted else scan
