"""The contract queries: thin (spark, sf_dir) functions over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_tree, kd_shards, language_id, licenses, lm_score, merkle, mixing, near_dup, packing, quality_rules, simhash, tokenizer_pairs, url_rules
from .common import table

#: (action, rule) of the contract.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good (quality 1) and not toxic; background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def url_rule_table(spark: SparkSession) -> DataFrame:
    rules = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in URL_RULES))
    return spark.range(1).select(F.explode(rules).alias("r")).select("r.*")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), url_rule_table(spark))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train_on(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    found = language_id.identify(docs.select("doc_id", "text"), model, carried=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train_on(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model, carried=["doc_id"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_epochs(table(spark, sf_dir, "documents")).drop("epochs", "same")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_pairs.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.leaves_of(table(spark, sf_dir, "documents")))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.jaccard_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_score, op2_url_filters, op3_minhash_near_dedup, op4_language_id, op5_quality_rules, op6_packing, op7_document_fingerprints, op8_mixing, op9_license_scans, op10_sharding, op11_tokenizer_alignment, op12_merkle_manifest, op13_ngram_jaccard)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
