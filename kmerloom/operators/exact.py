"""Exact location of query k-mers in concatenated references, without fragments."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.functions.records import ratio

TRANSCRIPT = ["transcript_name", "transcript_id"]


def transcript_kmers(transcripts: DataFrame, k: int) -> DataFrame:
    """(transcript_name, transcript_id, k_size, kmer, transcript_kmer_count): k-mers of ACGT alone and how often each occurs."""
    seq = F.translate(S.normalize(F.col("seq"), k), "N", "")
    found = transcripts.select(*TRANSCRIPT, F.explode(S.kmers(seq, k)).alias("kmer")).where(S.pure(F.col("kmer")))
    return found.groupBy(*TRANSCRIPT, "kmer").agg(F.count("*").alias("transcript_kmer_count")).withColumn("k_size", F.lit(k))


def concatenated_kmers(references: DataFrame, k: int) -> DataFrame:
    """(ref_id, pos, kmer): k-mers of all records of a reference taken as one sequence without N, pos from 1 in it.

    Each record is extended by the first k - 1 bases that follow it, over as many short records as that takes; whole
    sequences don't enter the window, only heads of k - 1 bases and lengths.
    """
    rows = references.select("ref_id", "rec_idx", F.translate(S.normalize(F.col("seq"), k), "N", "").alias("seq")).where(F.length("seq") > 0)
    short = rows.select("ref_id", "rec_idx", F.length("seq").cast("long").alias("n"), F.substring("seq", 1, max(1, k - 1)).alias("head"))
    order = Window.partitionBy("ref_id").orderBy("rec_idx")
    offset = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.substring(F.array_join(F.collect_list("head").over(order.rowsBetween(1, max(1, k - 1))), ""), 1, k - 1) if k > 1 else F.lit("")
    placed = rows.join(short.select("ref_id", "rec_idx", offset.alias("offset"), tail.alias("tail")), ["ref_id", "rec_idx"])
    # records are cut to pieces before k-mers are made, so that a long one spreads over rows of bounded size
    piece = 1 << 12
    whole = F.concat("seq", "tail")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / piece).cast("int")), lambda i: F.struct((i * piece).alias("at"), S.pieces(whole, i * piece + 1, piece + k - 1).alias("bases")))
    pieces = placed.select("ref_id", "offset", F.explode(cut).alias("p")).select("ref_id", (F.col("offset") + F.col("p.at")).alias("offset"), "p.bases")
    return pieces.select("ref_id", "offset", F.posexplode(S.kmers(F.col("bases"), k)).alias("i", "kmer")).select("ref_id", (F.col("offset") + F.col("i") + 1).alias("pos"), "kmer")


def locations(kmers: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(ref_id, kmer, pos) of every occurrence of a wanted k-mer; k-mers that nobody asked for leave before any shuffle of the large side."""
    return concatenated_kmers(references, k).join(kmers.select("kmer").distinct(), "kmer")


def detail(kmers: DataFrame, found: DataFrame, references: DataFrame) -> DataFrame:
    """Each transcript k-mer with each reference: how often it occurs there and where; 0 and '.' where it doesn't."""
    listed = found.groupBy("ref_id", "kmer").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: F.concat(F.lit("whole_reference:"), p.cast("string"))), ";").alias("where"))
    grid = kmers.crossJoin(references.select("ref_id").distinct())
    out = grid.join(listed, ["ref_id", "kmer"], "left")
    return out.select("ref_id", *TRANSCRIPT, "k_size", "kmer", "transcript_kmer_count", F.coalesce("n", F.lit(0)).alias("reference_hit_count"), F.coalesce("where", F.lit(".")).alias("reference_hits"))


def summary(details: DataFrame) -> DataFrame:
    """Per reference and transcript: windows and those matched (with multiplicity), distinct k-mers and those found, ratios, and all occurrences."""
    hit = F.col("reference_hit_count") > 0
    out = details.groupBy("ref_id", *TRANSCRIPT, "k_size").agg(
        F.sum("transcript_kmer_count").alias("total_kmer_windows"),
        F.sum(F.when(hit, F.col("transcript_kmer_count")).otherwise(0)).alias("matched_kmer_windows"),
        F.count("*").alias("unique_kmers"),
        F.count_if(hit).alias("unique_kmers_found"),
        F.sum("reference_hit_count").alias("reference_hit_sum"),
    )
    out = out.withColumn("matched_kmer_ratio", ratio(F.col("matched_kmer_windows"), F.col("total_kmer_windows")))
    return out.withColumn("unique_kmer_ratio", ratio(F.col("unique_kmers_found"), F.col("unique_kmers")))
