"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import archives, chat_format, fingerprints, language_id, license_scan, near_duplicates, packing, ranked_search
from llm import search, sentencepieces, substring_dedup, token_alignment, url_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("key"),
        F.col("url"),
        F.lit(None).cast("string").alias("date"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    return archives.round_trip(pages).select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_key").cast("long").alias("refers_to"),
    )


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), shingle=3, percent=85)


def substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_words", "UTF-8"), 256).alias("kept_sha256"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.train(docs.filter(~held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.labelled_urls(spark)).drop("url")


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    encoded = sentencepieces.encode(_table(spark, folder, "documents"), path)
    return sentencepieces.decode(encoded, path).select(
        "doc_id", "n_ids", "ids_crc32", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")
    )


def bm25(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.filter(F.col("doc_id") % 100 == 0))


def chat(spark: SparkSession, folder: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_conversations(rows))


def spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_pairs(_table(spark, folder, "documents"))


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(_table(spark, folder, "documents"))
    return found.withColumn("n_spans", F.size("spans")).drop("spans")


def alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return token_alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc,
        "op2_minhash": minhash,
        "op3_sentencepiece": pieces,
        "op4_search": bm25,
        "op5_chat": chat,
        "op6_substrings": substrings,
        "op7_languages": languages,
        "op8_urls": urls,
        "op9_spotsigs": spotsigs,
        "op10_packing": packed,
        "op11_licenses": licenses,
        "op12_alignment": alignment,
        "op13_ranked": ranked,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from llm import oracle

    return oracle.SQL
