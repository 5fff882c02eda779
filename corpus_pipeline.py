"""From raw documents to token ids: language identification, near and exact deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import language_id, minhash, mixing, sentencepiece_viterbi, suffix_array
from kmerloom.llm.common import prepare, release, spool, table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without text or without letters go."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != "und").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Rows of one doc_id and text are one document; of their other columns the smallest values stay. Rows without doc_id are linked with none and stay.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)
    twice = spool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*COLUMNS[2:])).alias("row"))
    return left.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "text", "row.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without strings of 100 bytes that start earlier; characters that a cut splits go with it."""
    kept = suffix_array.suffix_array_dedup(docs, length=100, carry=("lang", "source"), text=True)
    kept = kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; those that it doesn't take go. Rows without doc_id or with a repeated one are rows like others."""
    return mixing.take(docs.select(*COLUMNS), COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: their count and checksum, and the digest of the text that they decode to."""
    return sentencepiece_viterbi.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
#: None: models, hash signatures and random rounding aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, spool(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
