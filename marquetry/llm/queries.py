"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm import infill, jaccard, licenses, packing, pieces, quality, repeats, secrets, sharding, topk, toxicity, urlrules, variants
from marquetry.llm.common import table


#: Where op6 finds its vocabulary.
TOKENIZER = os.environ.get("MARQUETRY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_join(docs)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, pieces.load_pieces(TOKENIZER), check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.license_scan(docs)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.suffix_dedup(docs)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    evidence = F.transform("neighbours", lambda x: x["id"].cast("long")).alias("evidence")
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", evidence)


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.spelling_groups(variants.corpus_words(docs))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = infill.fill_in_middle(docs)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict:
    found = (op1_best_fit_packing, op2_quality_rules, op3_exact_topk, op4_jaccard_join, op5_secret_scans, op6_pieces, op7_url_filters, op8_license_scans, op9_suffix_dedup, op10_sharding)
    found += (op11_toxicity, op12_spelling_groups, op13_fill_in_middle)
    return {f.__name__: f for f in found}
