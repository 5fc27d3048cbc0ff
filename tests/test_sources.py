import json
import os

from pyspark.sql import functions as F

from folioscope.operators import ireval, sessions
from folioscope.sources import logs, pages
from folioscope.streaming import repeats as stream

PAGE = """---
slug: tab-groups
title: "Tab groups"
kind: concept
created: 2024-01-01
# a comment
sources:
  - src/a.py
  - 'src/b.py'
supersedes: [old-page, other]
owner: me
no colon here
---

Body [[x]]
"""


def store(tmp_path):
    s = tmp_path / ".memory"
    (s / "archive").mkdir(parents=True)
    (s / "tab-groups.md").write_text(PAGE)
    (s / "plain-page.md").write_bytes(b"no front matter \xff here")
    (s / "one.md").write_text("---\nsources: src/x.py\n---\nz")
    (s / "archive" / "gone.md").write_text(PAGE)
    (s / "folder.md").mkdir()
    (s / "broken.md").symlink_to(s / "nothing")
    outside = tmp_path / "outside.md"
    outside.write_text("secret")
    (s / "escape.md").symlink_to(outside)
    os.mkfifo(s / "pipe.md")
    return s


def test_reading(spark, tmp_path):
    s = store(tmp_path)
    rows = {r["slug"]: r for r in pages.read_pages(spark, str(s)).collect()}
    assert rows.keys() == {"tab-groups", "plain-page", "one"}
    r = rows["tab-groups"]
    assert (r["title"], r["kind"], r["sources"], r["supersedes"], r["extra"], r["body"]) == ("Tab groups", "concept", ["src/a.py", "src/b.py"], ["old-page", "other"], {"owner": ["me"]}, "Body [[x]]\n")
    assert rows["plain-page"]["title"] == "plain page" and "�" in rows["plain-page"]["body"]
    assert rows["one"]["sources"] == ["src/x.py"]
    assert pages.read_pages(spark, str(tmp_path / "none")).count() == 0
    assert pages.find_store(str(s / "archive")) == s and pages.store_problem(s / "one.md")


def test_writing_gives_the_same_pages(spark, tmp_path):
    s = store(tmp_path)
    own = pages.read_pages(spark, str(s))
    pages.write_pages(own, str(tmp_path / "copy"))
    again = pages.read_pages(spark, str(tmp_path / "copy"))
    key = lambda df: sorted((r["slug"], r["title"], r["body"].strip(), tuple(r["sources"]), tuple(r["supersedes"]), tuple(sorted((k, tuple(v)) for k, v in r["extra"].items()))) for r in df.collect())
    assert key(own) == key(again)
    assert pages.find_page(own, "one").count() == 1 and pages.find_page(own, "two").count() == 0


def test_retarget_and_list(spark):
    rows = [("a", ["x", "y", "x2"], None, "2024", ""), ("b", ["x"], "a", "", "2025"), ("c", [], None, "2024", "")]
    df = spark.createDataFrame(rows, "slug string, sources array<string>, superseded_by string, updated string, created string")
    moves = spark.createDataFrame([("x", "n"), ("x2", "n")], "old string, new string")
    assert {r["slug"]: r["sources"] for r in pages.retargeted(df, moves).collect()} == {"a": ["n", "y"], "b": ["x"], "c": []}
    assert [r["slug"] for r in pages.listed(df).collect()] == ["b", "c", "a"]


def test_log(spark, tmp_path):
    lines = [json.dumps({"ts": "2024-01-02", "event": "search", "hits": 0}), "", "[1]", "{torn", json.dumps({"event": "x"}), json.dumps({"ts": 5}), json.dumps({"ts": "2024-01-01", "event": "write", "via": "cli"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = logs.read_log(spark, str(tmp_path / "log.jsonl")).orderBy("line_no").collect()
    assert [(r["line_no"], r["event"]) for r in got] == [(0, "search"), (6, "write")]
    assert logs.read_log(spark, str(tmp_path / "log.jsonl"), since="2024-01-02").count() == 1
    events = spark.createDataFrame([("2024", "search")], "ts string, event string")
    logs.append_log(events, str(tmp_path / "out"))
    logs.append_log(events, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_tool_calls_and_steps(spark):
    say = lambda *b: json.dumps({"type": "assistant", "message": {"content": list(b)}})
    rows = [("s", 0, '{"type":"system"}'), ("s", 1, say({"type": "tool_use", "id": "1", "name": "search", "input": {"q": "a"}}, {"type": "text"}, {"type": "tool_use", "id": "2", "name": "Edit", "input": {}})), ("s", 2, say({"type": "tool_result", "tool_use_id": "2", "is_error": True})), ("s", 3, "torn")]
    got = logs.tool_calls(spark.createDataFrame(rows, "session string, line_no int, value string")).orderBy("pos").collect()
    assert [(r["name"], r["error"]) for r in got] == [("search", None), ("Edit", True)]
    tools = spark.createDataFrame([("s", 0, True, False, "p"), ("s", 1, False, True, None), ("s", 2, True, False, "p"), ("t", 0, True, False, None)], "session string, pos int, is_search boolean, is_edit boolean, top string")
    out = {r["session"]: r for r in sessions.steps(tools).collect()}
    assert (out["s"]["repeats"], out["s"]["searched_first"], out["t"]["searched_first"]) == (1, True, None)
    assert sessions.group_summary(sessions.steps(tools), []).first()["first_n"] == 1


def test_streamed_repeats_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{(i * 13 % 3600) // 60:02d}:{i * 13 % 60:02d}", f"u{i % 3}", f"t{i % 2}") for i in range(90)]
    rows.sort(key=lambda r: r[1])
    df = spark.createDataFrame(rows, "event_id long, ts string, session string, top string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    streamed = stream.repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = streamed.writeStream.format("memory").queryName("repeats_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["repeat"] for r in spark.sql("select * from repeats_out").collect()}
    from folioscope.operators import logstats

    want = {r["line_no"]: r["repeat"] for r in logstats.repeats(df.select(F.col("event_id").alias("line_no"), F.unix_timestamp("ts").cast("double").alias("ts"), "session", "top")).collect()}
    assert got == want and any(want.values())


def test_midranks(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int")
    assert sorted(r["midrank"] for r in ireval.average_ranks(df, "v").collect()) == [1.0, 2.5, 2.5, 4.0]
