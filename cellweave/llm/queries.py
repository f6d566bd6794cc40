"""The registered queries of this subpackage and their SQL: thin calls of the operators on whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import codes, fingerprints, language, ledger, merkle, mixing, near_dedup, packing, pii, quality, substrings, toxicity, vectors
from cellweave.llm.store import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def tokenizer_path() -> str:
    """Where the public byte-level vocabulary lies on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold="0.85")


def pii_key(spark: SparkSession) -> str:
    """The secret key named in spark.cellweave.pii.key; without one, a random key for this call, which nobody can undo."""
    return spark.conf.get("spark.cellweave.pii.key", None) or secrets.token_hex(32)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op10_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verdicts(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_rows(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_order_minhash, op3_toxicity_neighbours, op4_best_fit_packing, op5_minhash_near_dedup, op6_pseudonyms, op7_mix_sources, op8_rotated_codes, op9_language_filters, op10_prefix_free_repeats, op11_vector_codes, op12_rule_ledger, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_mix_sources": mixing.ORACLE, "op11_vector_codes": codes.ORACLE, "op12_rule_ledger": ledger.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
