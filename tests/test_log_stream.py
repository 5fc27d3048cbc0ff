"""The summary of a growing log against the summary of the whole; text search for short queries."""

import random

from pyspark.sql import functions as F

from folioscope.operators import logstats
from folioscope.plans.retrieval import containing
from folioscope.streaming import summary

SCHEMA = "line_no long, event string, session string, hits int, chars int"


def events(r, n):
    return [(i, r.choice(["search", "write", "reject", "other", None]), r.choice([None, "", "s1", "s2", f"s{i % 9}"]), r.choice([None, 0, 3]), r.choice([None, 5, 80, i])) for i in range(n)]


def one(df):
    return df.first().asDict()


def test_added_batches_equal_the_whole(spark, tmp_path):
    r, path, rows = random.Random(4), str(tmp_path / "sums"), []
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    assert one(summary.summary(spark, path)) == one(logstats.summary(frame([])))
    for n, size in enumerate([40, 0, 25, 70, 1]):
        batch = events(r, size)
        rows += batch
        assert summary.add(frame(batch), n, path)
        assert not summary.add(frame(batch), n, path)  # replayed
        if n == 2:
            assert summary.fold(spark, path) and not summary.fold(spark, path) and not summary.add(frame(batch), 1, path)
        assert one(summary.summary(spark, path)) == one(logstats.summary(frame(rows)))
    assert summary.fold(spark, path) and one(summary.summary(spark, path)) == one(logstats.summary(frame(rows)))


def test_a_restarted_stream_counts_no_batch_twice(spark, tmp_path):
    r, source, rows = random.Random(9), tmp_path / "log", []
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.writeStream.foreachBatch(summary.adder(str(tmp_path / "sums"), every=3)).option("checkpointLocation", str(tmp_path / "stream")).trigger(availableNow=True).start().awaitTermination()

    for _ in range(2):
        rows += (batch := events(r, 60))
        spark.createDataFrame(batch, SCHEMA).repartition(2).write.mode("append").parquet(str(source))
        run()
        # as if the stream had died before it noted the last batch: it brings that one again
        last = max((tmp_path / "stream" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        run()
        assert one(summary.summary(spark, str(tmp_path / "sums"))) == one(logstats.summary(spark.createDataFrame(rows, SCHEMA)))


def test_short_queries_are_found_within_words(spark):
    pages = {"a": "alpha beta gammas delta", "b": "x alphabet\nbeta  gamma", "c": "", "d": None, "e": "one two three four", "f": "one two  three four", "g": "the e mu"}
    asked = {1: "alpha", 2: "beta gamma", 3: "one two three", 4: "a", 5: "e two three f", 6: "zz", 7: "mu", 8: "ta\\nb", 9: "t\nbeta"}
    own = spark.createDataFrame(list(pages.items()), "slug string, body string")
    found = containing(own, spark.createDataFrame(list(asked.items()), "qid int, q string"))
    assert sorted((r.qid, r.slug) for r in found.collect()) == sorted((q, s) for q, t in asked.items() for s, b in pages.items() if b is not None and t in b)
    assert found.select(F.col("qid")).distinct().count() > 4
