"""The registered queries over the test tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.byte_bpe import encode_decode
from ledgerlens.llm.clusters import cluster_vectors
from ledgerlens.llm.common import documents
from ledgerlens.llm.decontaminate import contamination
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.filter_audit import audit_documents
from ledgerlens.llm.hyperminhash import near_duplicates
from ledgerlens.llm.language_id import identify_language
from ledgerlens.llm.licenses import scan_licenses
from ledgerlens.llm.oracle import ORACLES
from ledgerlens.llm.secrets import scan_secrets
from ledgerlens.llm.sharding import kd_shards
from ledgerlens.llm.simhash import simhash_groups
from ledgerlens.llm.suffix_dedup import remove_repeats
from ledgerlens.llm.token_counts import token_counts


def tokenizer(name: str) -> str:
    """Where the public tokenizer files are; imported here since only these queries need them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), depth=100)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir), words=4, distance=4)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), limit=4096)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), n_shards=24)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), n_clusters=40, dims=64, rounds=5, seed=2).drop("centroid")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


LLM_QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_kd_shards": op10_kd_shards,
    "op11_minhash": op11_minhash,
    "op12_clusters": op12_clusters,
    "op13_filter_audit": op13_filter_audit,
}


def llm_oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
