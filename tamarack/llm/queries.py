"""The registered queries opN_<name> over whole tables, with production parameters; the digests they return
are derived from the operators' real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, gam, jaccard, mixing, pii, quality, suffix, tokenfile, warc
from .sql import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.train(docs, _table(spark, sf_dir, "labels"))
    found = gam.score(docs, model).select("doc_id", gam.held_out().alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.connect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return jaccard.labelled(found).select("doc_id", "n_shingles", "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    counts = (count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"), carried=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"), "places")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"), least=0)
    return warc.read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokenfile.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"quality.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


QUERIES = {f.__name__: f for f in (op1_quality, op2_ann, op3_suffix_dedup, op4_bpe, op5_jaccard, op6_pii, op7_mixing, op8_warc, op9_token_file, op10_quality_rules)}
