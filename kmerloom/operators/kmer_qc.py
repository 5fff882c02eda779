"""From hits to per-transcript, per-gene and per-k summaries. Long tables throughout; pivots belong to sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.records import kmer_status, ratio

STATUSES = ("PASS_STRICT_KMER", "PASS_BASIC_KMER", "LOW_KMER")
META = ["transcript_name", "gene_name", "gene_id", "transcript_id", "transcript_length", "total_kmers"]


def matched_by_query(hits: DataFrame, grid: DataFrame) -> DataFrame:
    """(query_index, ref_id, total_kmers, matched_kmers, matched_kmer_ratio): positions with a hit, neither their hits nor their distinct k-mers."""
    found = hits.where("hits > 0").groupBy("query_index", "ref_id").agg(F.count("*").alias("matched_kmers"))
    out = grid.join(found, ["query_index", "ref_id"], "left").na.fill(0, ["matched_kmers"])
    return out.select("query_index", "ref_id", "total_kmers", "matched_kmers", ratio(F.col("matched_kmers"), F.col("total_kmers")).alias("matched_kmer_ratio"))


def statuses(matched: DataFrame, strict: float = 0.95, basic: float = 0.80) -> DataFrame:
    return matched.withColumn("status", kmer_status(F.col("matched_kmer_ratio"), strict, basic))


def pass_counts(matched: DataFrame, strict: float = 0.95, basic: float = 0.80) -> DataFrame:
    """Per k and transcript, over its references: how many pass, and the least, mean and greatest ratio. matched has k_size and META."""
    r = F.col("matched_kmer_ratio")
    return matched.groupBy("k_size", *META).agg(
        F.count("*").alias("genome_count"),
        F.count_if(r >= strict).alias("strict_pass_count"),
        F.count_if(r >= basic).alias("basic_pass_count"),
        F.min(r).alias("min_matched_kmer_ratio"),
        F.avg(r).alias("mean_matched_kmer_ratio"),
        F.max(r).alias("max_matched_kmer_ratio"),
    )



def _shared(kind: str):
    return F.col(f"{kind}_pass_count") == F.col("genome_count")


def summary_by_k(counts: DataFrame, strict: float = 0.95, basic: float = 0.80) -> DataFrame:
    """Per k: transcripts and genes, and those that pass in every reference."""
    return counts.groupBy("k_size").agg(
        F.count("*").alias("total_transcripts"),
        F.count_distinct("gene_name").alias("total_unique_gene_names"),
        F.max("genome_count").alias("genome_count"),
        F.lit(strict).alias("strict_threshold"),
        F.lit(basic).alias("basic_threshold"),
        F.count_if(_shared("strict")).alias("strict_shared_transcripts_all_genomes"),
        F.count_if(_shared("basic")).alias("basic_shared_transcripts_all_genomes"),
        F.count_distinct(F.when(_shared("strict"), F.col("gene_name"))).alias("strict_shared_unique_gene_names"),
        F.count_distinct(F.when(_shared("basic"), F.col("gene_name"))).alias("basic_shared_unique_gene_names"),
    )


def gene_summary(counts: DataFrame) -> DataFrame:
    """Per k and gene: its ids in order, its transcripts, and whether any passes in every reference."""
    out = counts.groupBy("k_size", "gene_name").agg(
        F.array_join(F.array_sort(F.collect_set("gene_id")), ",").alias("associated_gene_ids"),
        F.count("*").alias("total_transcripts"),
        F.count_if(_shared("strict")).alias("strict_shared_transcripts_all_genomes"),
        F.count_if(_shared("basic")).alias("basic_shared_transcripts_all_genomes"),
    )
    for kind in ("strict", "basic"):
        out = out.withColumn(f"{kind}_shared_gene_all_genomes", F.col(f"{kind}_shared_transcripts_all_genomes") > 0)
    return out


def status_counts(table: DataFrame, statuses: tuple[str, ...] = STATUSES, by: tuple[str, ...] = ("k_size", "ref_id")) -> DataFrame:
    """Rows of each status for each group, zeros included."""
    names = F.explode(F.array(*[F.lit(s) for s in statuses])).alias("status")
    grid = table.select(*by).distinct().select(*by, names)
    found = table.groupBy(*by, "status").agg(F.count("*").alias("transcript_count"))
    return grid.join(found, [*by, "status"], "left").na.fill(0, ["transcript_count"])


def edge_statistics(counts: DataFrame) -> DataFrame:
    """Per k: transcripts without k-mers, perfect ones, imperfect ones that still pass everywhere, failures, and the least ratio of those with k-mers."""
    least, none = F.col("min_matched_kmer_ratio"), F.col("total_kmers") == 0
    return counts.groupBy("k_size").agg(
        F.count_if(none).alias("zero_kmer_transcripts"),
        F.count_if(least == 1.0).alias("perfect_all_genomes"),
        F.count_if((least < 1.0) & _shared("strict") & ~none).alias("subperfect_but_strict_shared"),
        F.count_if(~_shared("strict")).alias("strict_failed_transcripts"),
        F.count_if(~_shared("basic")).alias("basic_failed_transcripts"),
        F.min(F.when(~none, least)).alias("lowest_nonzero_min_ratio"),
    )


def report_by_k(summary: DataFrame, statistics: DataFrame) -> DataFrame:
    """The summary by k with its edge statistics, the fractions retained and the transcripts that aren't."""
    out = summary.join(statistics, "k_size", "left")
    for kind in ("strict", "basic"):
        kept = F.col(f"{kind}_shared_transcripts_all_genomes")
        out = out.withColumn(f"{kind}_retention_fraction", ratio(kept, F.col("total_transcripts"))).withColumn(f"{kind}_not_retained", F.col("total_transcripts") - kept)
    return out


def edge_cases(counts: DataFrame) -> DataFrame:
    """Transcripts without k-mers, imperfect ones and those that fail somewhere, with the reason."""
    least, none = F.col("min_matched_kmer_ratio"), F.col("total_kmers") == 0
    kind = F.when(none, "no_valid_kmers").when(_shared("strict") & (least < 1.0), "subperfect_but_shared").otherwise("not_shared_all_genomes")
    return counts.where(none | (least < 1.0) | (F.col("strict_pass_count") < F.col("genome_count"))).withColumn("edge_case", kind)
