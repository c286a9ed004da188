"""The registered query of each operator, with production parameters, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, licenses, media, merkle, mixing, neardup, oracle, quality, sharding, trie, urls, wavelet

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.read_back(wavelet.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(_table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, RULES, urls.fit(urls.weakly_labelled(pages))).select("page_id", "host", "path", "rule", "verdict", "score")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold() != 2)
    held = docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return langid.predicted(held, model, keep=("held_out",))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(_table(spark, sf_dir, "labels")), 3)
    return quality.rated(docs.select("doc_id", "text"), model).drop("text")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(_table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = _table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    some = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    out = merkle.manifest(docs, columns, keep={"changed": F.when(some, tampered)})
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    shared = F.crc32(F.encode(c.cast("string"), "UTF-8")) % 9
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), base=c - c % 5, shared=shared, most=8)


QUERIES = {f.__name__: f for f in (op1_wavelet, op2_licenses, op3_media, op4_mixing, op5_urls, op6_langid, op7_quality, op8_decontam, op9_neardup, op10_sharding, op11_bpe, op12_merkle, op13_trie)}

ORACLE = {"op4_mixing": oracle.mixing_sql(), "op10_sharding": oracle.SHARDING, "op12_merkle": oracle.MERKLE, "op13_trie": oracle.TRIE}
