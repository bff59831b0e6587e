"""The corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, secret scans, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm import jaccard, packing, quality, repeats, secrets
from marquetry.llm.common import discard, materialize


# Every stage takes tables with nulls in any column, repeated rows and keys, empty tables and further columns, which it
# hands on as they are.


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; rows are judged one by one, so repeated ones fare alike."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts one row: that of least doc_id (null last), then digest; texts without words each stay.

    Of rows that repeat a doc_id and its text one stays, the least by a hash of its other columns. Rows of one doc_id with different
    texts are judged apart.
    """
    found = materialize(jaccard.jaccard_join(docs.select("doc_id", "text"), heads=True).where("is_head").groupBy("doc_id", "digest").agg(F.count("*").alias("_rows")), "heads")
    heads = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_rows")
    marked = docs.withColumn("_own", F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = marked.join(heads, marked["doc_id"].eqNullSafe(heads["_id"]) & (marked["_own"] == heads["_digest"]))
    if not found.where("_rows > 1").head(1):
        return kept.select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in others], F.lit(0)), F.monotonically_increasing_id())
    one = kept.where("_rows > 1").withColumn("_order", order).groupBy("doc_id", "_own").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "_order").alias("_row"))
    return kept.where("_rows = 1").select(*docs.columns).unionByName(one.select("_row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the strings of 50 bytes that a smaller doc_id has; n_chars follows. Null texts become empty."""
    source = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_own"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    cut = repeats.suffix_dedup(docs.select("doc_id", "text"), keep_text=True)
    cut = cut.select(F.col("doc_id").alias("_id"), "digest", "kept_text").dropDuplicates(["_id", "digest"])
    out = source.join(cut, source["doc_id"].eqNullSafe(cut["_id"]) & (source["_own"] == cut["digest"]))
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a mark; n_chars follows. Null texts stay null."""
    out = secrets.secret_scan(docs, redact=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, bin_id, bin_capacity, bin_offset.

    Texts without words, null ones too, have one piece of no length and no bin; rows of one doc_id have pieces of their own.
    """
    return packing.pack(docs.select("doc_id", "text"))


#: (name, stage). Each stage takes (spark, docs, sf_dir) and all but the last return the columns of documents.
STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL cannot express best-fit packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # nothing reads the stage before the last any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
