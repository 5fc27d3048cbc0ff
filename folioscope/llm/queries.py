"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import sql
from folioscope.llm.centroids import clusters_with_inertia
from folioscope.llm.common import table
from folioscope.llm.decontaminate import contamination
from folioscope.llm.divergence import quality
from folioscope.llm.exact_dedup import exact_duplicates
from folioscope.llm.html_text import extract
from folioscope.llm.jaccard_join import jaccard_components
from folioscope.llm.merkle import FIELDS, folded, leaf_hash, manifest, proof_text
from folioscope.llm.packing import pack
from folioscope.llm.pii import pseudonymise
from folioscope.llm.secrets import scan
from folioscope.llm.token_counts import revised_counts
from folioscope.llm.toxicity import toxicity
from folioscope.llm.url_templates import judge_urls

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
_DRAWN = secrets.token_hex(16)
BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
#: The revision that op2 counts: a cut in the first third, an insertion in the second, a new end.
REVISION = [("n div 3", "n div 3 + 17", ""), ("2 * (n div 3)", "2 * (n div 3)", " (revised), it's new "), ("greatest(n - 5, 0)", "n + 100", " end.")]


def pseudonym_key(spark: SparkSession) -> str:
    """The key of pseudonyms: spark.folioscope.pseudonym.key, else FOLIOSCOPE_PSEUDONYM_KEY, else one drawn for this process."""
    return spark.conf.get("spark.folioscope.pseudonym.key", None) or os.environ.get("FOLIOSCOPE_PSEUDONYM_KEY") or _DRAWN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key=pseudonym_key(spark)).select("doc_id", "text", "n_replaced")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revised_counts(table(spark, sf_dir, "documents"), tokenizer=BYTE_BPE, edits=REVISION)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=WORD_BPE)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), block=BLOCK, allow=ALLOW).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_hash(*(lowered if f == "text" else F.col(f) for f in FIELDS)))
    found = manifest(table(spark, sf_dir, "documents"), carry={"tampered": tampered})
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_with_inertia(table(spark, sf_dir, "embeddings"), n=64, k=8, rounds=10, scale=1024, start="3:")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_token_counts, op3_decontaminate, op4_html_text, op5_divergence, op6_jaccard_join, op7_packing, op8_secrets, op9_toxicity, op10_url_templates, op11_merkle_manifest, op12_exact_dedup,
        op13_centroids,
    )
}
ORACLES: dict[str, str] = dict(sql.ORACLES)

