"""Queries of tool calls read from event streams, whose shell lines are made of the documents' own titles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.shell import commands
from folioscope.operators import toolcalls
from folioscope.plans.registry import query
from folioscope.plans.retrieval import read
from folioscope.sources import logs

#: What a document's line does goes by its number: the command, where it looks, how its pattern (the title) is quoted.
VERBS = ["grep -rn", "grep -n", "rg --hidden", "rg", "git grep", "cat", "find"]
PATHS = [".memory/notes", "src", ".", "", "/p/.memory"]


def _pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, failed, title, line): a shell line for each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.regexp_replace(F.substring_index("text", "\n", 1), r"\p{Cntrl}", " ").alias("title"))
    single = F.concat(F.lit("'"), F.replace(F.col("title"), F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    double = F.concat(F.lit('"'), F.regexp_replace("title", r'([\\"$`])', r"\\$1"), F.lit('"'))
    quoted = F.replace(F.when(F.col("doc_id") % 3 == 0, double).otherwise(single), F.lit("<<"), F.lit("<"))
    verb, path = _pick(VERBS, F.col("n_chars")), _pick(PATHS, F.col("doc_id"))
    own = F.when(verb == "cat", F.concat_ws(" ", verb, path)).when(verb == "find", F.concat_ws(" ", verb, path, F.lit("-name '*.md' -newer"), quoted)).otherwise(F.concat_ws(" ", verb, quoted, path))
    line = F.concat(F.when(F.col("doc_id") % 2 == 0, "A=1 ").otherwise("echo 'x; y' && "), own, F.lit(" | wc -l\necho done"))
    return docs.select("doc_id", (F.col("doc_id") % 4 == 0).alias("failed"), F.replace("title", F.lit("<<"), F.lit("<")).alias("title"), line.alias("line"))


def stream(rows: DataFrame) -> DataFrame:
    """The lines as an agent's event stream: a line with the call, then one with its result."""
    key = F.col("doc_id").cast("string")
    call = F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), key.alias("id"), F.lit("Bash").alias("name"), F.struct(F.col("line").alias("command")).alias("input"))).alias("content")).alias("message"))
    result = F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), key.alias("tool_use_id"), F.col("failed").alias("is_error"))).alias("content")).alias("message"))
    both = F.posexplode(F.array(F.to_json(call), F.to_json(result))).alias("place", "value")
    return rows.select((F.col("doc_id") % 97).cast("string").alias("session"), "doc_id", both).select("session", (2 * F.col("doc_id") + F.col("place")).alias("line_no"), "value")


_AT = "CASE doc_id % 5 WHEN 0 THEN 'store' WHEN 1 THEN 'src' WHEN 2 THEN 'root' WHEN 3 THEN 'root' ELSE 'store' END AS place"


@query("shell_calls", f"""SELECT doc_id, doc_id % 4 = 0 AS failed, v <> 5 AND (place = 'store' OR place = 'root' AND v IN (0, 2, 6)) AS scans, v = 5 AND place = 'store' AS reads, false AS is_search, false AS is_edit
FROM (SELECT doc_id, n_chars % 7 AS v, {_AT} FROM documents)""")
def shell_calls(spark, sf_dir):
    """Calls are read from the stream and judged; results find their calls by id."""
    called = toolcalls.classified(logs.tool_calls(stream(lines(spark, sf_dir))))
    return called.select(F.col("id").cast("long").alias("doc_id"), F.col("error").alias("failed"), "scans", "reads", "is_search", "is_edit")


_PLACE = "CASE doc_id % 5 WHEN 0 THEN ['.memory/notes'] WHEN 1 THEN ['src'] WHEN 2 THEN ['.'] WHEN 3 THEN [] ELSE ['/p/.memory'] END"
_TITLE = r"replace(regexp_replace(split_part(text, chr(10), 1), '[\x00-\x1f\x7f]', ' ', 'g'), '<<', '<')"


@query("shell_words", f"""WITH w_ AS (SELECT doc_id, {_TITLE} AS t, {_PLACE} AS p, n_chars % 7 AS v FROM documents),
c_ AS (SELECT doc_id, CASE v WHEN 0 THEN ['grep', '-rn', t] WHEN 1 THEN ['grep', '-n', t] WHEN 2 THEN ['rg', '--hidden', t] WHEN 3 THEN ['rg', t] WHEN 4 THEN ['git', 'grep', t] WHEN 5 THEN ['cat'] ELSE ['find'] END || p || CASE WHEN v = 6 THEN ['-name', '*.md', '-newer', t] ELSE [] END AS c FROM w_)
SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END + 2)::INTEGER AS n_commands, array_to_string(c, '|') AS words FROM c_""")
def shell_words(spark, sf_dir):
    """The command that looks for the title, word for word: quoting must give the title back."""
    cut = lines(spark, sf_dir).select("doc_id", commands(F.col("line")).alias("c"))
    return cut.select("doc_id", F.size("c").alias("n_commands"), F.array_join(F.element_at("c", -3), "|").alias("words"))
