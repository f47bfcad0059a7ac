"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, mixing, packing, pii, quality, secret_scan, simhash, token_files, toxicity
from .common import read_table


#: Where a public tokenizer's file lies, by name; a parameter, so that other places can be set.
TOKENIZER = "word_bpe_49k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: The key of the pseudonyms in the query; a deployment passes its own.
PSEUDONYM_KEY = "public example key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return quality.judged(read_table(spark, sf_dir, "documents")).select(*columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

SQL: dict[str, str] = {
    "op5_mixing": mixing.oracle_sql(),
    "op6_licenses": licenses.oracle_sql(),
}
