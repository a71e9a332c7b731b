"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.llm import (
    collocations,
    decontaminate,
    exact_dedup,
    language,
    license_scan,
    line_dedup,
    mixture,
    near_dedup,
    packing,
    quality,
    sharding,
    spelling,
    toxicity,
)
from citescope.llm.checks import CHECKS, NOTICES
from citescope.llm.shared import in_fold

__all__ = ["CHECKS", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets have a similarity of 0.8 or more."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses and keeps when lines of five or more documents go."""
    rows = line_dedup.cleaned(_table(spark, sf_dir, "documents"), min_length=40, min_docs=5)
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", kept.alias("kept_sha256")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in each document."""
    templates = spark.createDataFrame(NOTICES, "template_id string, text string")
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"), templates, n=5, per_cent=80)
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.transform("matches", lambda m: m["template_id"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["per_cent"])), F.lit(0)).cast("long").alias("best_per_cent"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and the row of each that stays."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in each document."""
    found = decontaminate.scan(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13
    )
    items = F.array_join("items", ",").cast("binary")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        decontaminate.contaminated(5).alias("contaminated"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from labels outside the fold held out."""
    scores = quality.quality(
        _table(spark, sf_dir, "documents"),
        _table(spark, sf_dir, "labels"),
        usable=~in_fold("doc_id", 3, 1),
    )
    return scores.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from documents outside the fold held out."""
    found = language.languages(_table(spark, sf_dir, "documents"), usable=~in_fold("doc_id", 4, 2))
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from labels outside the fold held out."""
    scores = toxicity.toxicity(
        _table(spark, sf_dir, "documents"),
        _table(spark, sf_dir, "labels"),
        usable=~in_fold("doc_id", 5, 0),
    )
    return scores.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of near equal bytes, equal texts together."""
    rows = sharding.shard_groups(_table(spark, sf_dir, "documents"), shards=24)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens from whole documents."""
    import public_tokenizers

    return packing.pack_sequences(
        _table(spark, sf_dir, "documents"),
        tokenizer=str(public_tokenizers.path("word_bpe_49k.json")),
        capacity=2048,
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, the common form one edit away that each rare one has, and where forms lead."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, typo_every=199)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), max_words=3, min_count=10, subsumed_percent=50, top=2000)


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, each with every source's share of all tokens."""
    import public_tokenizers

    rows = mixture.pack_mixture(_table(spark, sf_dir, "documents"), tokenizer=str(public_tokenizers.path("byte_bpe_50k.json")), capacity=2048)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_line_dedup, op3_license_scan, op4_exact_dedup, op5_quality, op6_decontaminate, op7_language, op8_toxicity, op9_sharding, op10_best_fit_packing, op11_spelling, op12_collocations, op13_mixture_packing)
}
