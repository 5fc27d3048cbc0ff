"""Page files appear together or not at all."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from folioscope.operators import corpora
from folioscope.sources import pages, sink

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def frame(spark, n, text="body"):
    return spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("slug"), F.concat(F.lit(f"{text} "), F.col("id").cast("string")).alias("text")).repartition(4)


def files(folder):
    return {n: (folder / n).read_text() for n in sorted(os.listdir(folder))}


def test_pages_are_added_and_replaced(spark, tmp_path):
    sink.use(spark)
    store = tmp_path / "store"
    write = lambda df: df.write.format("page_files").mode("append").save(str(store))
    write(frame(spark, 10))
    write(frame(spark, 3, "new"))
    write(frame(spark, 0))
    assert files(store) == {f"p{i}.md": f"{'new' if i < 3 else 'body'} {i}" for i in range(10)}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    sink.use(spark)
    store = tmp_path / "store"
    store.mkdir()
    (store / "p1.md").write_text("old")
    bad = frame(spark, 50).unionByName(spark.createDataFrame([("a/b", "x")], "slug string, text string"))
    with pytest.raises(Exception, match="not a slug"):
        bad.write.format("page_files").mode("append").save(str(store))
    assert files(store) == {"p1.md": "old"}


FAILS_ONCE = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from folioscope.sources import sink
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
sink.use(spark)
@F.udf("string")
def text(i):
    if i == 7 and TaskContext.get().attemptNumber() == 0:
        raise OSError("lost")
    return f"body {i}"
spark.range(20).repartition(3).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("slug"), text("id").alias("text")).write.format("page_files").mode("append").save(sys.argv[1])
"""


def test_a_task_that_fails_once(tmp_path):
    store = tmp_path / "store"
    done = subprocess.run([sys.executable, "-c", FAILS_ONCE, str(store)], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert files(store) == {f"p{i}.md": f"body {i}" for i in range(20)}


def test_corpus_to_store_and_back(spark, tmp_path):
    entries = spark.createDataFrame([("a", "A", "fact", "text a", ["x.py"], []), ("b", "B", "fact", "text b", ["y.py", "x.py", "x.py"], ["a"])], "slug string, title string, kind string, body string, sources array<string>, supersedes array<string>")
    pages.write_pages(corpora.corpus_pages(entries, "2024-01-02"), str(tmp_path / "store"))
    back = {r.slug: r for r in pages.read_pages(spark, str(tmp_path / "store")).collect()}
    assert back["a"].status == "superseded" and back["a"].superseded_by == "b" and back["b"].sources == ["x.py", "y.py"] and back["b"].supersedes == ["a"]
    assert back["a"].body.strip() == "text a" and back["b"].created == "2024-01-02"
