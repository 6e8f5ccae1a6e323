"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from chronoweave.llm import audit, html, licenses, lm, minhash, mixing, pieces, pii, quality, repair, sharding, topk, urls
from chronoweave.llm.common import read

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
# The given pages come without a list; the URLs of pages below these host labels are the listed ones.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), MODEL_FILE)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract of this query asks for shingles of four words
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.split(urls.url_host(F.col("url")), r"\.")
    listed = pages.filter(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in LISTED_LABELS]))).select("url")
    return urls.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_failed_lines", "lost_percent", "kept",
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths; a layout of directories follows from their ids
    digits = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(digits, F.lit(".txt")))
    up = F.concat_ws("/", "source", (F.col("doc_id") / 1000).cast("long").cast("string"))
    deep = F.concat_ws("/", up, (F.col("doc_id") % 100 / 10).cast("long").cast("string"))
    path = F.concat_ws("/", F.when(F.col("doc_id") % 50 == 0, up).otherwise(deep), name)
    files = read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licenses.scan_licenses(files).select("doc_id", "path", "licence", "cosine", "origin", "licence_dir")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs).withColumn("_base", pii.base_only(F.col("spans")))
    counts = [pii.count_kind(F.col("_base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text(F.col("_base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs).select("doc_id", "source", "seq", "block", "release", "deadline", "slot", "in_mix")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


def damaged(turns: DataFrame) -> DataFrame:
    """One turn in twenty is lost, emptied, robbed of its sentence ends, said twice or given to the user, by its checksum."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("_d"),
    )
    hurt = F.col("_d")
    text = F.when(hurt == 1, "").when(hurt == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(hurt == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    left = rows.filter(hurt != 0).select("conv_id", "turn", F.when(hurt == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return left.drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair.repair_conversations(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    joined = every.join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(repair.NOTHING)).alias("repaired_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit.audit_filters(docs, read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_license_scan": op7_license_scan,
    "op8_personal_data": op8_personal_data,
    "op9_mix_sources": op9_mix_sources,
    "op10_context_mixing": op10_context_mixing,
    "op11_sharding": op11_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}
