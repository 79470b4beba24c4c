"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, suffix_array, suffix_tree
from .bpe_trie import encode_documents
from .common import hex64
from .mixing import mix
from .multi_index import nearest
from .pseudonyms import pseudonymize
from .quality import quality
from .secrets import BASE_RULES, RULES, listed, scan
from .simhash import near_duplicates
from .toxicity import score, train

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = os.environ.get("PSEUDONYM_KEY", "public test key")
    return pseudonymize(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_values")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("secret_spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, i)) for i in range(len(BASE_RULES))]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{rule.kind}") for n, rule in zip(counts, BASE_RULES)]
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def coded_digests(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_digests(encode_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0).select("vec_id"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": oracles.OP1, "op3_mixing": oracles.OP3, "op4_suffix_array": oracles.OP4, "op7_secret_scan": oracles.secrets_sql(RULES, len(BASE_RULES)), "op9_suffix_tree": oracles.OP9}
