"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosenpath, decontaminate, merkle, mixing, pii, qualityrules, secrets, substrings, tokenfiles, toxicity, warc, whitening
from . import oracles as sql
from .tokencount import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).drop("kept_text")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return qualityrules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source", "copies")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.find(docs)
    return secrets.scan(found, secrets.learn(docs, found))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, folder, "documents")))


def op10_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digest(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "op4_warc": op4_warc,
        "op5_quality_rules": op5_quality_rules,
        "op6_mix_sources": op6_mix_sources,
        "op7_ngram_join": op7_ngram_join,
        "op8_secret_scan": op8_secret_scan,
        "op9_pii": op9_pii,
        "op10_benchmark_hits": op10_benchmark_hits,
        "op11_token_files": op11_token_files,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_whitening": op13_whitening,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_substring_dedup": sql.SUBSTRINGS,
        "op4_warc": warc.ORACLE,
        "op7_ngram_join": sql.NEAR,
        "op9_pii": pii.ORACLE,
        "op10_benchmark_hits": sql.BENCHMARK,
        "op12_merkle_manifest": merkle.ORACLE,
    }
