"""Activity logs and session files: one JSON object per line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.storage import checked_broadcast

EVENT = (
    "ts string, event string, session string, query string, hits int, top string, via string, touching array<string>, touched int, skipped int, slug string, kind string, mode string, chars int, "
    "replaced array<string>, supersedes array<string>, warnings array<string>, code string, reason string"
)
SILENT = "FOLIOSCOPE_NO_LOG"


def read_log(spark: SparkSession, path: str, since: str | None = None, *, timed: bool = True) -> DataFrame:
    """Events with line_no, in which blank, torn and foreign lines are left out, and with ``timed`` those without a text ts.

    A log may be one file or what ``append_log`` wrote: line_no puts lines in order of files (by time, then name), the
    blocks they are read in, and place; in a file of one block it is the number of the line.
    """
    block = ["file_modification_time", "file_path", "file_block_start"]
    lines = spark.read.text(path).select("value", *(F.col(f"_metadata.{c}") for c in block), F.monotonically_increasing_id().alias("_place"))
    ranks = lines.select(*block).distinct().withColumn("_block", F.row_number().over(Window.orderBy(*block)).cast("long") - 1)
    lines = lines.join(checked_broadcast(ranks), block).select((F.shiftleft("_block", 33) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("line_no"), "value")
    events = lines.where(F.get_json_object("value", "$").startswith("{")).select("line_no", "value", F.from_json("value", EVENT).alias("e"))
    if timed:
        events = events.where(F.col("e.ts").isNotNull() & F.col("value").rlike(r'"ts"\s*:\s*"'))
    rows = events.select("line_no", "e.*")
    return rows.where(F.col("ts") >= since) if since else rows


def append_log(events: DataFrame, path: str) -> None:
    """One line per event; nothing where logging is switched off."""
    if not os.environ.get(SILENT):
        events.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(headers, sessions) of a result file; rows of other types and torn ones are in neither."""
    rows = spark.read.schema(schema).json(path)
    return rows.where("type = 'header'"), rows.where("type = 'session'")


def stream_summary(stream: DataFrame) -> DataFrame:
    """Of an event stream (session, line_no, value: JSON text) one row per session: what its first init and its last result say."""
    fields = "type string, subtype string, model string, claude_code_version string, skills array<string>, plugins array<string>, agents array<string>, result string, num_turns long, duration_ms long, total_cost_usd double, is_error boolean"
    rows = stream.select("session", "line_no", F.from_json("value", fields).alias("e"))
    init, last = (F.col("e.type") == "system") & (F.col("e.subtype") == "init"), F.col("e.type") == "result"
    out = rows.groupBy("session").agg(F.min_by("e", F.when(init, F.col("line_no"))).alias("i"), F.max_by("e", F.when(last, F.col("line_no"))).alias("r"), F.max(init).alias("_i"), F.max(last).alias("_r"))
    begun = lambda c: F.when(F.col("_i"), F.col(f"i.{c}"))
    ended = lambda c: F.when(F.col("_r"), F.col(f"r.{c}"))
    counts = [F.coalesce(F.size(begun(c)), F.lit(0)).alias(f"n_{c}") for c in ("skills", "plugins", "agents")]
    return out.select("session", begun("model").alias("model"), begun("claude_code_version").alias("claude_code_version"), *(F.greatest(c, F.lit(0)).alias(n) for c, n in zip(counts, ("n_skills", "n_plugins", "n_agents"), strict=True)), F.coalesce(ended("result"), F.lit("")).alias("answer"), *(ended(c).alias(c) for c in ("num_turns", "duration_ms", "total_cost_usd", "is_error")))


def tool_calls(stream: DataFrame) -> DataFrame:
    """Of an event stream (session, line_no, value: JSON text) the tool calls (session, pos, id, name, input, error).

    Calls keep their order and find their results by id; a call without a result has no error.
    """
    block = "array<struct<type string, id string, name string, input map<string,string>, tool_use_id string, is_error boolean>>"
    rows = stream.select("session", "line_no", F.from_json("value", f"type string, message struct<content {block}>").alias("e")).where("e.message.content is not null")
    each = rows.select("session", "line_no", F.posexplode("e.message.content").alias("k", "b"))
    calls = each.where("b.type = 'tool_use'").select("session", "line_no", "k", "b.id", "b.name", "b.input")
    results = each.where("b.type = 'tool_result'").groupBy("session", F.col("b.tool_use_id").alias("id")).agg(F.max(F.coalesce("b.is_error", F.lit(False))).alias("error"))
    return calls.join(results, ["session", "id"], "left").withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("line_no", "k")) - 1).select("session", "pos", "id", "name", "input", "error")


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of an evaluation corpus, each as its own frame."""
    whole = spark.read.option("multiLine", "true").json(path)
    out = {}
    for field in whole.schema.fields:
        rows = whole.select(F.posexplode(field.name).alias("place", "x"))
        out[field.name] = rows.select("place", "x.*") if "struct" in rows.schema["x"].dataType.typeName() else rows
    return out
