"""A training-data pipeline over the documents table: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language import UNKNOWN, held_out, predict_language
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_text import near_duplicates
from tidemark.llm.queries import TOKENIZERS
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.sentencepiece import encode_and_check
from tidemark.llm.store import own_tables, staged

#: Words of a passage that is removed where it repeats.
PASSAGE = 50
#: How often the scarcest source may be used for each use of the most plentiful.
REPEATS = 1.5
BROADCAST_IDS = 500_000
#: Bytes of rows that Spark hands to a Python worker at a time.  Its own bound is 10,000 rows, of whatever length, and the buffers on both sides grow by doubling.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """From now on batches are bounded by bytes; stages are read lazily, so the session keeps the setting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; a missing lang is filled with the predicted one."""
    bounded(spark)
    found = predict_language(docs, docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = found.where(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the one with the smallest doc_id.

    Of several rows with that doc_id one stays, the first by text, lang, source and n_chars; rows without a doc_id all stay.
    """
    bounded(spark)
    marks = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = staged(marks.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    again = staged(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    order = F.struct(*(F.col(c).cast("string") for c in ("text", "lang", "source", "n_chars")))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; a document that loses all its words goes."""
    bounded(spark)
    cut = remove_repeats(docs, length=PASSAGE)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    cut = cut.where(~(changed & (F.col("n_removed") == F.col("n_words"))))
    return cut.withColumn("n_chars", size).withColumn("text", text).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and sources below their target weight partly again."""
    bounded(spark)
    return mix_sources(docs, repeats=REPEATS).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they give the text back."""
    bounded(spark)
    out = encode_and_check(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables(spark) as tables:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = staged(docs, f"stage{k}")
                tables.close(keep=1)  # what the stage and the one before it left
    return docs


#: Language identification, exchange of components and byte-pair merging are not expressible in SQL; tests/llm holds a plain version.
ORACLE_SQL = None
