"""Alignment records: per-record metrics, per-sample quality, status grids and what all samples share.

Input rows have sample, row_no (their order), the eleven fixed columns of an alignment record and `tags`, the array of optional ones.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import records as R

STATUSES = ("PASS_STRICT", "PASS_BASIC", "LOW_QC", "UNMAPPED", "MISSING")


class Limits:
    """Least coverage, identity and mapping quality of the two levels, and the length from which a contig is large."""

    def __init__(self, coverage: float = 80, identity: float = 80, mapq: int = 10, strict_identity: float = 90, strict_mapq: int = 30, large_contig: int = 10_000_000):
        self.coverage, self.identity, self.mapq = coverage, identity, mapq
        self.strict_identity, self.strict_mapq, self.large_contig = strict_identity, strict_mapq, large_contig


def _measured(rows: DataFrame, length: Column, last_tag: bool) -> DataFrame:
    """Adds mapped, kinds, length, aligned and clipped bases, coverage, identity and the tags to records."""
    flag = F.col("flag")
    divergence = R.tag(F.col("tags"), "de:f:", last_tag).cast("double")
    out = rows.withColumn("mapped", ~R.has_flag(flag, 4)).withColumn("secondary", R.has_flag(flag, 256)).withColumn("supplementary", R.has_flag(flag, 2048)).withColumn("query_length", F.coalesce(length, F.lit(0)))
    cigar = F.when(F.col("mapped"), F.col("cigar"))
    out = out.withColumn("aligned_query_bases", R.cigar_bases(cigar, "MI=X")).withColumn("softclip_bases", R.cigar_bases(cigar, "S"))
    out = out.withColumn("query_coverage_pct", R.percent(F.col("aligned_query_bases"), F.col("query_length"))).withColumn("softclip_pct", R.percent(F.col("softclip_bases"), F.col("query_length")))
    out = out.withColumn("divergence_pct", F.when(F.col("mapped"), F.lit(100.0) * divergence)).withColumn("identity_pct", F.when(F.col("mapped"), F.lit(100.0) * (F.lit(1.0) - divergence)))
    return out.withColumn("sa_tag", R.tag(F.col("tags"), "SA:Z:", last_tag))


def record_metrics(rows: DataFrame, limits: Limits | None = None, supplementary: bool = False) -> DataFrame:
    """The 28 columns of each primary (or supplementary) record; secondary records go."""
    x = limits or Limits()
    header = R.header_fields(F.col("qname"), fallback=False)
    out = _measured(rows, R.last_number(F.col("qname")), last_tag=False).where(~F.col("secondary")).where("supplementary" if supplementary else "not supplementary")
    mapped, args = F.col("mapped"), (F.col("query_coverage_pct"), F.col("identity_pct"), F.when(F.col("mapped"), F.col("mapq")).otherwise(0))
    out = out.withColumn("header", header)
    return out.select(
        "sample", "row_no", "qname", "header.transcript_id", "header.gene_id", "header.transcript_name", "header.gene_name", "query_length", "flag",
        F.when(F.col("supplementary"), "supplementary").otherwise("primary").alias("alignment_type"), "mapped",
        F.when(mapped, F.col("rname")).alias("reference"), F.when(mapped, F.col("pos")).alias("position"), F.when(R.has_flag(F.col("flag"), 16), "-").otherwise("+").alias("strand"),
        args[2].alias("mapq"), F.when(mapped, F.col("cigar")).alias("cigar"), "aligned_query_bases", "query_coverage_pct", "softclip_bases", "softclip_pct", "identity_pct", "divergence_pct",
        R.tag(F.col("tags"), "NM:i:").alias("nm"), R.tag(F.col("tags"), "AS:i:").alias("as_score"), F.col("sa_tag").isNotNull().alias("has_sa_tag"), "sa_tag",
        R.passes(mapped, *args, x.coverage, x.identity, x.mapq).alias("pass_basic"), R.passes(mapped, *args, x.coverage, x.strict_identity, x.strict_mapq).alias("pass_strict"),
        R.fail_reasons(mapped, *args, x.coverage, x.identity, x.mapq).alias("fail_reasons"),
    )


def sample_quality(rows: DataFrame, contigs: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """One row a sample. contigs: (sample, contig, length). Shares are of all primary records, means and mapping qualities of the mapped
    ones, supplementary records per 100 mapped; identity's mean is over records that have it."""
    x = limits or Limits()
    rows = _measured(rows, R.length_before_last(F.col("qname"), F.col("seq")), last_tag=True)
    if contigs is None:
        rows, sizes = rows.withColumn("on_large", F.lit(False)), None
    else:
        large = contigs.where(F.col("length") >= x.large_contig).select("sample", F.col("contig").alias("rname")).distinct()
        sizes = large.groupBy("sample").agg(F.count("*").alias("large_contigs"))
        rows = rows.join(large.withColumn("on_large", F.lit(True)), ["sample", "rname"], "left").na.fill(False, ["on_large"])
    primary = ~F.col("secondary") & ~F.col("supplementary")
    placed = primary & F.col("mapped")
    args = (F.col("query_coverage_pct"), F.col("identity_pct"), F.col("mapq"))
    count = lambda c, name: F.count_if(c).alias(name)
    mean = lambda c: F.coalesce(F.avg(F.when(placed, c)), F.lit(0.0))
    out = rows.groupBy("sample").agg(
        count(primary, "total_transcripts"), count(placed, "primary_mapped"), count(primary & ~F.col("mapped"), "unmapped"), count(F.col("supplementary"), "supplementary"),
        count(placed & (F.col("mapq") == 0), "mq0"), count(placed & (F.col("mapq") >= 10), "ge10"), count(placed & (F.col("mapq") >= 30), "ge30"),
        mean(F.col("mapq").cast("double")).alias("mean_mapq"), mean(F.col("query_coverage_pct")).alias("mean_query_coverage_pct"), mean(F.col("identity_pct")).alias("mean_identity_pct"), mean(F.col("softclip_pct")).alias("mean_softclip_pct"),
        count(placed & R.passes(placed, *args, x.coverage, x.identity, x.mapq), "pass_cov80_id80_mapq10"), count(placed & R.passes(placed, *args, x.coverage, x.strict_identity, x.strict_mapq), "pass_cov80_id90_mapq30"),
        count(placed & F.col("sa_tag").isNotNull(), "primary_with_sa_tag"), count(placed & F.col("on_large"), "on_large"),
    )
    total, mapped = F.col("total_transcripts"), F.col("primary_mapped")
    share = lambda n, d, name: R.percent(F.col(n), d).alias(name)
    if sizes is not None:
        out = out.join(sizes, "sample", "left").na.fill(0, ["large_contigs"])
    else:
        out = out.withColumn("large_contigs", F.lit(0).cast("long"))
    return out.select(
        "sample", "total_transcripts", "primary_mapped", share("primary_mapped", total, "primary_mapped_pct"), "unmapped", share("unmapped", total, "unmapped_pct"),
        "supplementary", (F.lit(100.0) * F.col("supplementary") / F.greatest(mapped, F.lit(1))).alias("supplementary_per_100_primary"), "mq0", share("mq0", mapped, "mq0_pct"), share("ge10", mapped, "mapq_ge10_pct"), share("ge30", mapped, "mapq_ge30_pct"),
        "mean_mapq", "mean_query_coverage_pct", "mean_identity_pct", "mean_softclip_pct", "pass_cov80_id80_mapq10", share("pass_cov80_id80_mapq10", total, "pass_cov80_id80_mapq10_pct"),
        "pass_cov80_id90_mapq30", share("pass_cov80_id90_mapq30", total, "pass_cov80_id90_mapq30_pct"), "primary_with_sa_tag", share("primary_with_sa_tag", mapped, "primary_with_sa_tag_pct"),
        F.lit(x.large_contig).alias("large_contig_bp_threshold"), "large_contigs", share("on_large", mapped, "mapped_on_large_contigs_pct"),
    )


def last_cells(metrics: DataFrame) -> DataFrame:
    """(transcript_id, sample, status, query_coverage_pct, identity_pct): the last record of each cell."""
    kind = R.alignment_status(F.col("mapped"), F.col("pass_basic"), F.col("pass_strict"))
    cell = F.struct(kind.alias("status"), "query_coverage_pct", "identity_pct")
    return metrics.groupBy("transcript_id", "sample").agg(F.max_by(cell, "row_no").alias("cell")).select("transcript_id", "sample", "cell.*")


def status_grid(metrics: DataFrame, samples: list[str]) -> DataFrame:
    """(transcript_id, gene_id, transcript_name, gene_name, sample, status) of every transcript with every sample; MISSING without a record.

    A transcript's names are those of its first record.
    """
    names = metrics.groupBy("transcript_id").agg(F.min_by(F.struct("gene_id", "transcript_name", "gene_name"), "row_no").alias("n")).select("transcript_id", "n.*")
    grid = names.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    return grid.join(last_cells(metrics), ["transcript_id", "sample"], "left").withColumn("status", F.coalesce("status", F.lit("MISSING")))


def matrix(grid: DataFrame, samples: list[str], value: str) -> DataFrame:
    """Transcripts by samples, from status_grid(); value is status, query_coverage_pct or identity_pct."""
    return grid.groupBy("transcript_id", "gene_id", "transcript_name", "gene_name").pivot("sample", samples).agg(F.first(value))


def pass_counts(grid: DataFrame) -> DataFrame:
    """Per transcript: samples in which it passes strictly, at all, and how many there are. A strict pass is a basic one too."""
    return grid.groupBy("transcript_id", "gene_id", "transcript_name", "gene_name").agg(
        F.count_if(F.col("status") == "PASS_STRICT").alias("strict_pass_count"),
        F.count_if(F.col("status").isin("PASS_STRICT", "PASS_BASIC")).alias("basic_pass_count"),
        F.count("*").alias("genome_count"),
        F.bool_and(F.col("status") == "UNMAPPED").alias("unmapped_in_all"),
    )


def shared(counts: DataFrame, kind: str = "strict") -> DataFrame:
    """Transcripts that pass in every sample."""
    return counts.where(F.col(f"{kind}_pass_count") == F.col("genome_count"))


def shared_summary(counts: DataFrame) -> DataFrame:
    """(metric, count, percent_of_transcripts): all transcripts and those shared by all samples."""
    own = lambda kind: F.count_if(F.col(f"{kind}_pass_count") == F.col("genome_count"))
    one = counts.agg(F.count("*").alias("n"), own("strict").alias("s"), own("basic").alias("b"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).alias("count"), F.col("n")) for name, c in (("total_transcripts", "n"), ("strict_shared_all_genomes", "s"), ("basic_shared_all_genomes", "b"))]))
    return one.select(rows.alias("r")).select("r.metric", "r.count", R.percent(F.col("r.count"), F.col("r.n")).alias("percent_of_transcripts"))
