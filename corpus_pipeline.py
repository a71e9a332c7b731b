"""Documents made ready for training, in five stages.

Each stage is a function of ``(spark, docs, sf_dir)`` over everything its predecessor kept.
All but the last return the columns of ``docs``, whatever else these hold and however they are named; the last
returns packed sequences.  Each stage takes an empty table, and then returns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from citescope.llm.shared import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject, learned from all labels.

    Null and empty texts have the score of a text without words, which is not toxic unless
    most labels are; rows without a number, and each of repeated rows, are judged by their
    text.  A score of exactly a half rejects."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 characters and more that stand in five or more.

    A document that consists of such lines stays, with an empty text, and one whose text is null
    keeps null.  The largest number keeps a line; rows that share it all do.  ``n_chars`` is
    counted anew where lines went."""
    rows = line_dedup.cleaned(docs, min_length=40, min_docs=5)
    changed = {
        "text": F.col("kept_text"),
        "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None,
    }
    return rows.select(
        *[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    )


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8.

    The smallest number of a group stays.  Null and empty texts link with nothing and stay, as do
    rows without a number; rows that share a number go only together."""
    return near_dedup.drop_near_duplicates(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than a twentieth of the words are of benchmark passages.

    Null and empty texts have no words and stay; each of repeated rows is judged by its text;
    with an empty benchmark all stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, per_cent=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens.

    A null text is empty, and packed as its end alone; each of repeated rows is packed.
    Pieces of equal length are interchangeable, so ties change no length of a sequence."""
    import public_tokenizers

    return packing.pack_sequences(docs, tokenizer=str(public_tokenizers.path("word_bpe_49k.json")), capacity=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: A trained score decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written, and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
