"""The pipelines around the search, as functions and as commands: each reads files, runs operators and writes tables into a folder.

    python -m kmerloom exact GENOMES TRANSCRIPTS K [GENE] [-o OUT]
    python -m kmerloom kmer-matches -f TRANSCRIPTS -k K -i LISTS -o OUT
    python -m kmerloom kmer-qc -i TABLES -o OUT [-s 0.95] [-b 0.80]
    python -m kmerloom kmer-report -i TABLES -o OUT
    python -m kmerloom alignment-qc LIST OUT [limits]
    python -m kmerloom shared-transcripts MATRIX OUT
    python -m kmerloom alignment-report MATRIX OUT [--top-intersections N] [--strip-gene-version] [--genes A,B]
    python -m kmerloom regions HITS TRANSCRIPTS OUT [-g]
    python -m kmerloom region-report CLUSTERS MEMBERS OUT [--top-genes N] [--top-n N]
    python -m kmerloom data-summary FOLDER OUT
"""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import records as R
from kmerloom.operators import align_qc, exact, kmer_qc, regions, report
from kmerloom.plans.storage import spool
from kmerloom.sources import fasta, sinks, tables


def exact_locations(spark: SparkSession, genomes: str, transcripts: str, k: int, gene: str | None, out: str) -> DataFrame:
    """Where the k-mers of a gene's transcripts are in every reference of a folder: detail and summary. Returns the summary."""
    if k < 1:
        raise ValueError("k must be a positive integer")
    own = fasta.transcripts(fasta.read(spark, transcripts), gene)
    if own.isEmpty():
        raise ValueError(f"no {gene or ''} transcripts in {transcripts}")
    references = fasta.read(spark, fasta.references(spark, genomes))
    kmers = spool(exact.transcript_kmers(own, k), "kmers")
    details = spool(exact.detail(kmers, exact.locations(kmers, references, k), references), "detail")
    sinks.exact_detail(details, f"{out}/detail")
    summary = exact.summary(details)
    sinks.exact_summary(summary, f"{out}/summary")
    return summary


def kmer_matches(spark: SparkSession, transcripts: str, k: int, lists: str, out: str) -> DataFrame:
    """Matched k-mers of every transcript in every reference, from the search's k-mer lists: wide, and by reference. Returns the long table."""
    meta = fasta.transcript_metadata(fasta.read(spark, transcripts), k)
    hits = tables.kmer_lists(spark, lists)
    matched = R.positive_pairs(F.col("kmer_indices"), F.col("kmer_counts"))
    rows = meta.join(hits.select("ref_id", "query_index", matched.alias("matched_kmers")), "query_index")
    rows = spool(rows.withColumn("matched_kmer_ratio", R.ratio(F.col("matched_kmers"), F.col("total_kmers"))), "matched")
    refs = [r[0] for r in rows.select("ref_id").distinct().orderBy("ref_id").collect()]  # one a file
    sinks.matched_wide(rows, refs, f"{out}/combined")
    sinks.per_genome_summaries(rows, f"{out}/genomes")
    return rows


def _by_k(spark: SparkSession, folder: str) -> DataFrame:
    """Long form of a folder's per-k tables; k_size is text, so that files without digits in their names have one too."""
    paths = tables.list_tables(spark, folder)
    if not paths:
        raise ValueError(f"no tables in {folder}")
    return spool(tables.combined_by_k(spark, paths).withColumn("k_size", F.col("k_label")).drop("k_label"), "by-k")


def kmer_quality(spark: SparkSession, folder: str, out: str, strict: float = 0.95, basic: float = 0.80) -> DataFrame:
    """Pass counts, summaries by k and gene, those shared by all references, and status matrices. Returns the pass counts."""
    matched = _by_k(spark, folder)
    counts = spool(kmer_qc.pass_counts(matched, strict, basic), "counts")
    refs = [r[0] for r in matched.select("ref_id").distinct().orderBy("ref_id").collect()]
    sinks.write_tsv(counts.orderBy("k_size", "transcript_name", "transcript_id"), f"{out}/pass_counts_by_k")
    sinks.write_tsv(kmer_qc.summary_by_k(counts, strict, basic).orderBy("k_size"), f"{out}/summary_by_k")
    sinks.write_tsv(kmer_qc.gene_summary(counts).orderBy("k_size", "gene_name"), f"{out}/gene_summary_by_k")
    for kind in ("strict", "basic"):
        sinks.by_k(counts.where(F.col(f"{kind}_pass_count") == F.col("genome_count")), f"{out}/{kind}_shared")
    status = kmer_qc.statuses(matched, strict, basic)
    keys = ["k_size", "transcript_name", "gene_name", "gene_id", "transcript_id"]
    sinks.by_k(status.groupBy(*keys).pivot("ref_id", refs).agg(F.first("status")), f"{out}/status_matrix")
    return counts


def kmer_report(spark: SparkSession, folder: str, out: str, strict: float = 0.95, basic: float = 0.80) -> DataFrame:
    """Retention and edge cases by k, status counts with zeros and the trend of ratios. Returns the report by k."""
    matched = _by_k(spark, folder)
    counts = spool(kmer_qc.pass_counts(matched, strict, basic), "counts")
    by_k = kmer_qc.report_by_k(kmer_qc.summary_by_k(counts, strict, basic), kmer_qc.edge_statistics(counts))
    sinks.write_tsv(by_k.orderBy("k_size"), f"{out}/report_by_k")
    sinks.write_tsv(report.edge_case_order(kmer_qc.edge_cases(counts)), f"{out}/edge_cases")
    sinks.write_tsv(kmer_qc.status_counts(kmer_qc.statuses(matched, strict, basic)).orderBy("k_size", "ref_id", "status"), f"{out}/status_counts")
    sinks.write_tsv(report.ratio_trend(matched, ["ref_id", "k_size"]).orderBy("ref_id", "k_size"), f"{out}/ratio_trend")
    return by_k


def alignment_quality(spark: SparkSession, listed: str, out: str, limits: align_qc.Limits | None = None, supplementary: bool = False) -> DataFrame:
    """Records, sample quality and matrices of the alignment texts that a list names. Returns the status grid."""
    files = tables.alignment_files(spark, listed)
    if not files:
        raise ValueError(f"no alignment files in {listed}")
    suffix = next((s for s in (".sorted.sam", ".sam") if files[0].endswith(s)), "")
    rows = spool(tables.sam(spark, files, suffix), "records")
    limits = limits or align_qc.Limits()
    metrics = spool(align_qc.record_metrics(rows, limits), "metrics")
    samples = sorted({tables.sample_name(f) for f in files})
    grid = spool(align_qc.status_grid(metrics, samples), "grid")
    quality = align_qc.sample_quality(rows, tables.sam_contigs(spark, files, suffix), limits)
    others = align_qc.record_metrics(rows, limits, supplementary=True) if supplementary else None
    sinks.alignment_tables(metrics, quality, grid, samples, out, others)
    return grid


def shared_transcripts(spark: SparkSession, matrix: str, out: str) -> DataFrame:
    """What all samples of a status matrix share. Returns the long form of the matrix."""
    rows = tables.status_matrix(spark, matrix)
    samples = [r[0] for r in rows.select("sample").distinct().orderBy("sample").collect()]
    sinks.shared_transcripts(rows, samples, out)
    return rows


def alignment_report(spark: SparkSession, matrix: str, out: str, top: int = 25, strip_version: bool = False, genes: list[str] = ()) -> DataFrame:
    """Overview, gene rollup, status counts and set intersections of a status matrix, and the named genes. Returns the rollup."""
    rows = tables.status_matrix(spark, matrix)
    if strip_version:
        rows = rows.withColumn("gene_id", R.strip_version(F.col("gene_id")))
    rows = spool(rows, "matrix")
    counts = spool(align_qc.pass_counts(rows), "counts")
    rollup = report.gene_rollup(counts)
    sinks.write_tsv(report.overview(counts), f"{out}/overview")
    sinks.write_tsv(rollup.orderBy("gene_name"), f"{out}/genes")
    sinks.write_tsv(kmer_qc.status_counts(rows, align_qc.STATUSES, ("sample",)).orderBy("sample", "status"), f"{out}/status_counts")
    sets = report.intersections(rows.withColumn("passes", F.col("status").isin("PASS_STRICT", "PASS_BASIC")))
    sinks.write_tsv(report.top_pinned(sets, rows.select("sample").distinct().count(), top), f"{out}/intersections")
    if genes:
        sinks.write_tsv(report.gene_presence(rows, counts, list(genes)).orderBy("gene_name"), f"{out}/selected_genes")
        sinks.write_tsv(report.selected_genes(rows, list(genes)).orderBy("gene_name", "sample"), f"{out}/selected_gene_counts")
    return rollup


def shared_regions(spark: SparkSession, hits: str, transcripts: str, out: str, keep_same_gene: bool = False) -> dict[str, int]:
    """Families of the regions of a hit table: clusters, members, their bases and a run summary. Returns the counts of the summary."""
    found, records = tables.hits(spark, hits), fasta.by_id(fasta.read(spark, transcripts))
    kept = spool(regions.filter_hits(found, keep_same_gene), "kept")
    families = regions.families(kept)
    clusters, members = spool(regions.cluster_summary(families), "clusters"), spool(regions.member_table(families), "members")
    sinks.region_tables(clusters, members, out)
    sinks.member_fasta(regions.member_sequences(members, records), f"{out}/regions_fasta")
    counted = {"input_transcripts": records, "raw_local_hits": found, "filtered_local_hits": kept, "shared_region_clusters": clusters, "shared_region_member_intervals": members}
    return sinks.run_summary({"input_fasta": transcripts, "hits": hits, "outdir": out, "local_keep_same_gene": int(keep_same_gene)}, counted, spark, f"{out}/run_summary")


def region_report(spark: SparkSession, clusters: str, members: str, out: str, top_genes: int = 10, top: int = 30) -> DataFrame:
    """Clusters with statistics of their members and size buckets, the largest ones, and their rank series. Returns the statistics."""
    known = tables.region_clusters(spark, clusters)
    rows = report.with_rank(regions.overlap_report(known, tables.region_members(spark, members), top_genes)).withColumn("size_bucket", R.size_bucket(F.col("n_transcripts")))
    rows = spool(rows, "report")
    sinks.write_tsv(rows.orderBy("rank"), f"{out}/clusters")
    sinks.write_tsv(report.top_clusters(known, top).orderBy("rank"), f"{out}/top_clusters")
    sinks.write_tsv(rows.groupBy("size_bucket").agg(F.count("*").alias("clusters")).orderBy("size_bucket"), f"{out}/size_buckets")
    return rows


def data_summary(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Records, bases and N content of every sequence file below a folder. Returns the statistics by file."""
    files = fasta.list_files(spark, folder, recursive=True)
    if not files:
        raise ValueError(f"no sequence files in {folder}")
    records = fasta.read(spark, files)
    statistics = spool(report.file_statistics(records), "statistics")
    sinks.write_tsv(report.category_statistics(statistics, "genomes"), f"{out}/data_summary_count")
    sinks.write_tsv(sinks.two_decimals(report.n_content(records)).orderBy("ref_id"), f"{out}/n_content")
    return statistics


def _limits(o) -> align_qc.Limits:
    return align_qc.Limits(o.min_cov, o.min_id, o.min_mapq, o.strict_min_id, o.strict_min_mapq, o.large_contig_bp)


COMMANDS = {
    "exact": lambda spark, o: exact_locations(spark, o.genomes, o.transcripts, o.k, o.gene, o.out),
    "kmer-matches": lambda spark, o: kmer_matches(spark, o.transcripts, o.k, o.lists, o.out),
    "kmer-qc": lambda spark, o: kmer_quality(spark, o.tables, o.out, o.strict, o.basic),
    "kmer-report": lambda spark, o: kmer_report(spark, o.tables, o.out, o.strict, o.basic),
    "alignment-qc": lambda spark, o: alignment_quality(spark, o.list, o.out, _limits(o), o.supplementary),
    "shared-transcripts": lambda spark, o: shared_transcripts(spark, o.matrix, o.out),
    "alignment-report": lambda spark, o: alignment_report(spark, o.matrix, o.out, o.top_intersections, o.strip_gene_version, [g for g in o.genes.split(",") if g]),
    "regions": lambda spark, o: shared_regions(spark, o.hits, o.transcripts, o.out, o.keep_same_gene),
    "region-report": lambda spark, o: region_report(spark, o.clusters, o.members, o.out, o.top_genes, o.top_n),
    "data-summary": lambda spark, o: data_summary(spark, o.folder, o.out),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("kmerloom")
    top.add_argument("--threads", type=int, default=0)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        out = commands.add_parser(name)
        for place in places:
            out.add_argument(place)
        return out

    c = command("exact", "genomes", "transcripts")
    c.add_argument("k", type=int)
    c.add_argument("gene", nargs="?")
    c.add_argument("-o", "--out", default=".")
    c = command("kmer-matches")
    c.add_argument("-f", "--transcripts", required=True)
    c.add_argument("-k", type=int, default=15)
    c.add_argument("-i", "--lists", required=True)
    c.add_argument("-o", "--out", required=True)
    for name in ("kmer-qc", "kmer-report"):
        c = command(name)
        c.add_argument("-i", "--tables", required=True)
        c.add_argument("-o", "--out", required=True)
        c.add_argument("-s", "--strict", type=float, default=0.95)
        c.add_argument("-b", "--basic", type=float, default=0.80)
    c = command("alignment-qc", "list", "out")
    for name, value in (("--min-cov", 80.0), ("--min-id", 80.0), ("--min-mapq", 10), ("--strict-min-id", 90.0), ("--strict-min-mapq", 30), ("--large-contig-bp", 10_000_000)):
        c.add_argument(name, type=type(value), default=value)
    c.add_argument("--supplementary", action="store_true")
    command("shared-transcripts", "matrix", "out")
    c = command("alignment-report", "matrix", "out")
    c.add_argument("--top-intersections", type=int, default=25)
    c.add_argument("--strip-gene-version", action="store_true")
    c.add_argument("--genes", default="")
    c = command("regions", "hits", "transcripts", "out")
    c.add_argument("-g", "--keep-same-gene", action="store_true")
    c = command("region-report", "clusters", "members", "out")
    c.add_argument("--top-genes", type=int, default=10)
    c.add_argument("--top-n", type=int, default=30)
    command("data-summary", "folder", "out")
    return top
