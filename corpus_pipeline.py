"""Corpus pipeline: language, near duplicates, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)``, reads the columns of documents and
works on all rows that its predecessor kept. All but the last return those
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import language_id, near_duplicates, packing, substring_dedup
from llm.queries import held_out, vocabulary
from llm.scratch import new_folder

#: Set operators and searches are tested against brute force instead.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that are in none of the learned languages and set ``lang`` of the others to the one found.

    Rejected are null texts and texts that have no letter, and ambiguous ones unless their own label agrees with what was found. So a
    missing or wrong label is put right and a doubtful text of unknown origin goes. Without a labelled row outside of the held-out
    part nothing is learned, and all rows pass as they are. Rows that repeat an id are judged each by its text.
    """
    model = language_id.train(docs.filter(~held_out()))
    if not model.languages:
        return docs
    own = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score", "ambiguous")}
    judged = language_id.predict(docs.withColumnsRenamed(own), model)
    sure = ~F.col("ambiguous") | F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(False))
    kept = judged.filter((F.col("lang_pred") != language_id.UNDETERMINED) & sure).withColumn("lang", F.col("lang_pred"))
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, 80 % alike or more.

    Texts without words and rows with a null id stay; rows that repeat the id of a document that stays do too.
    """
    return near_duplicates.representatives(docs, shingle=5, percent=80).select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages seen earlier go; n_chars follows. Texts without repeats stay as they are, white space too."""
    cut = substring_dedup.remove_repeats(docs, columns=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_words")).otherwise(F.col("text"))
    fresh = cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return fresh.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids. Null and empty texts give the end id alone; repeated rows are packed each."""
    return packing.pack_sequences(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
