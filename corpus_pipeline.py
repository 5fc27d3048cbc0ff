"""From raw documents to training sequences, in stages that each keep what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialised, size_checked_broadcast, table, with_row_keys
from folioscope.llm.decontaminate import without_contaminated
from folioscope.llm.jaccard_join import MAX_SENT, jaccard_components
from folioscope.llm.packing import pack
from folioscope.llm.pii import pseudonymise
from folioscope.llm.queries import WORD_BPE, pseudonym_key
from folioscope.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays, the first one with the smallest doc_id."""
    rows = with_row_keys(docs, "_row")
    gone = materialised(jaccard_components(rows, row="_row").where("not representative").select(F.col("row").alias("_row")), "gone")
    return rows.join(size_checked_broadcast(gone, MAX_SENT), "_row", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms."""
    return pseudonymise(docs, key=pseudonym_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack(docs, tokenizer=WORD_BPE)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: SQL expresses neither the learnt scores nor the tokens; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
