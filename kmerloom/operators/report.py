"""Rollups behind the reports: file statistics, gene summaries, set intersections, method comparison."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.records import percent
from kmerloom.functions.sequence import n_count
from kmerloom.plans import numbering


def file_statistics(records: DataFrame, by: str = "ref_id") -> DataFrame:
    """(by, records, total_bp, longest_bp) per file."""
    n = F.length("seq").cast("long")
    return records.groupBy(by).agg(F.count("*").alias("records"), F.sum(n).alias("total_bp"), F.max(n).alias("longest_bp"))


def category_statistics(statistics: DataFrame, category: str, count_type: str = "records") -> DataFrame:
    """(category, name, count_type, count, total_bp): one row of the number of files and one a file."""
    total = statistics.agg(F.lit(category).alias("category"), F.lit("total").alias("name"), F.lit("files").alias("count_type"), F.count("*").alias("count"), F.sum("total_bp").alias("total_bp"))
    each = statistics.select(F.lit(category).alias("category"), F.col("ref_id").alias("name"), F.lit(count_type).alias("count_type"), F.col("records").alias("count"), "total_bp")
    return total.unionByName(each)


def n_content(records: DataFrame, by: str = "ref_id") -> DataFrame:
    """(by, total_bases, n_bases, n_percent, has_n) per file."""
    out = records.groupBy(by).agg(F.sum(F.length("seq").cast("long")).alias("total_bases"), F.sum(n_count(F.col("seq"))).alias("n_bases"))
    return out.withColumn("n_percent", percent(F.col("n_bases"), F.col("total_bases"))).withColumn("has_n", F.when(F.col("n_bases") > 0, "yes").otherwise("no"))


def gene_rollup(counts: DataFrame) -> DataFrame:
    """Per gene name (null is a group too) of align_qc.pass_counts(): ids, transcripts, how many are shared by all samples or unmapped in all."""
    strict, basic = (F.col(f"{k}_pass_count") == F.col("genome_count") for k in ("strict", "basic"))
    out = counts.groupBy("gene_name").agg(
        F.array_join(F.array_sort(F.collect_set(F.nullif("gene_id", F.lit("")))), ",").alias("associated_gene_ids"),
        F.count_distinct("transcript_id").alias("n_transcripts"),
        F.count_if(strict).alias("strict_shared_transcripts"),
        F.count_if(basic).alias("basic_shared_transcripts"),
        F.count_if(F.col("unmapped_in_all")).alias("unmapped_all_genomes_transcripts"),
        F.max("strict_pass_count").alias("max_strict_pass_count"),
        F.max("basic_pass_count").alias("max_basic_pass_count"),
    )
    return out.withColumn("strict_shared_gene", F.col("strict_shared_transcripts") > 0).withColumn("basic_shared_gene", F.col("basic_shared_transcripts") > 0)


def overview(counts: DataFrame) -> DataFrame:
    """(metric, value) over all transcripts; null and empty gene names don't count."""
    gene = F.nullif("gene_name", F.lit(""))
    strict, basic = (F.col(f"{k}_pass_count") == F.col("genome_count") for k in ("strict", "basic"))
    one = counts.agg(
        F.count_distinct("transcript_id").alias("total_transcripts"),
        F.count_distinct(gene).alias("total_unique_gene_names"),
        F.count_if(strict).alias("strict_shared_transcripts_all_genomes"),
        F.count_if(basic).alias("basic_shared_transcripts_all_genomes"),
        F.count_distinct(F.when(strict, gene)).alias("strict_shared_unique_gene_names"),
        F.count_distinct(F.when(basic, gene)).alias("basic_shared_unique_gene_names"),
        F.count_if("unmapped_in_all").alias("transcripts_unmapped_in_all_genomes"),
        F.count_distinct(F.when(F.col("unmapped_in_all"), gene)).alias("unique_gene_names_with_transcripts_unmapped_in_all_genomes"),
        F.max("genome_count").alias("genome_count"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def intersections(cells: DataFrame, member: str = "gene_name", group: str = "sample") -> DataFrame:
    """(intersection, n_genomes, gene_count): members counted by the exact set of groups that `passes` is true in; those in none go."""
    sets = cells.where("passes").groupBy(member).agg(F.array_sort(F.collect_set(group)).alias("groups"))
    out = sets.groupBy("groups").agg(F.count("*").alias("gene_count"))
    return out.select(F.array_join("groups", "&").alias("intersection"), F.size("groups").alias("n_genomes"), "gene_count")


def top_pinned(table: DataFrame, groups: int, top: int = 25) -> DataFrame:
    """The set of all groups first, then the largest others, `top` rows in all; none left out if top is 0 or less."""
    ordered = table.withColumn("all_genomes_shared", F.col("n_genomes") == groups).orderBy(F.desc("all_genomes_shared"), F.desc("gene_count"), F.desc("n_genomes"), "intersection")
    return ordered if top <= 0 else ordered.limit(top)


def selected_genes(grid: DataFrame, genes: list[str]) -> DataFrame:
    """(gene_name, sample, strict_count, basic_count) of the named genes, from align_qc.status_grid()."""
    rows = grid.where(F.col("gene_name").isin(genes))
    return rows.groupBy("gene_name", "sample").agg(F.count_if(F.col("status") == "PASS_STRICT").alias("strict_count"), F.count_if(F.col("status").isin("PASS_STRICT", "PASS_BASIC")).alias("basic_count"))


def gene_presence(grid: DataFrame, counts: DataFrame, genes: list[str]) -> DataFrame:
    """Per named gene: transcripts, those shared by all samples, and in how many samples any passes."""
    cells = selected_genes(grid, genes).groupBy("gene_name").agg(F.count_if(F.col("strict_count") > 0).alias("strict_detected_genomes"), F.count_if(F.col("basic_count") > 0).alias("basic_detected_genomes"), F.count("*").alias("samples"))
    rolled = gene_rollup(counts.where(F.col("gene_name").isin(genes)))
    out = rolled.join(cells, "gene_name", "left")
    return out.select(
        "gene_name", "associated_gene_ids", F.col("n_transcripts").alias("total_transcripts"), F.col("strict_shared_transcripts").alias("strict_shared_transcripts_all_genomes"), F.col("basic_shared_transcripts").alias("basic_shared_transcripts_all_genomes"),
        "strict_detected_genomes", "basic_detected_genomes", (F.col("strict_detected_genomes") == F.col("samples")).alias("strict_shared_gene_all_genomes"), (F.col("basic_detected_genomes") == F.col("samples")).alias("basic_shared_gene_all_genomes"),
    )


def method_comparison(alignment: DataFrame, kmer: DataFrame) -> DataFrame:
    """Alignment pass counts per transcript beside median, least and mean over the k of its k-mer pass counts."""
    keys = ["gene_name", "transcript_id", "transcript_name"]
    found = kmer.groupBy(*keys).agg(F.median("strict_pass_count").alias("kmer_strict_pass_median"), F.min("strict_pass_count").alias("kmer_strict_pass_min"), F.avg("mean_matched_kmer_ratio").alias("kmer_mean_ratio_mean"), F.min_by("transcript_length", "k_size").alias("transcript_length"))
    own = alignment.select(*keys, *[F.col(c).alias(f"alignment_{c}") for c in ("strict_pass_count", "basic_pass_count", "genome_count")])
    return own.join(found, keys, "left")


def method_totals(comparison: DataFrame) -> DataFrame:
    """(gene_name, method, full, partial, total): transcripts that pass in all samples or in fewer, by either method."""
    full = F.max("alignment_genome_count").alias("g")
    sized = comparison.join(comparison.groupBy("gene_name").agg(full), "gene_name")
    parts = []
    for method, column in (("Alignment strict", "alignment_strict_pass_count"), ("K-mer strict", "kmer_strict_pass_min")):
        parts.append(sized.groupBy("gene_name").agg(F.lit(method).alias("method"), F.count_if(F.col(column) == F.col("g")).alias("full"), F.count_if(F.col(column) < F.col("g")).alias("partial"), F.count_distinct("transcript_id").alias("total")))
    return parts[0].unionByName(parts[1])


def ratio_trend(matched: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and greatest matched ratio by the given columns, such as gene and k or reference and k."""
    r = F.col("matched_kmer_ratio")
    return matched.groupBy(*by).agg(F.avg(r).alias("mean_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"))


# --- orders of report tables


def by_ratio(rows: DataFrame, ratio: str = "matched_kmer_ratio", name: str = "transcript_name") -> DataFrame:
    """Falling ratio, then name."""
    return rows.orderBy(F.col(ratio).desc_nulls_last(), name)


def edge_case_order(rows: DataFrame) -> DataFrame:
    """Edge cases by k, kind, rising least ratio and transcript."""
    return rows.orderBy("k_size", "edge_case", F.col("min_matched_kmer_ratio").asc_nulls_first(), "transcript_name")


def by_place(rows: DataFrame, names: list[str], column: str = "genome") -> DataFrame:
    """The order of a given list of names; others come after it by name."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(names) + 1), column)


def top_clusters(clusters: DataFrame, top: int = 30) -> DataFrame:
    """The clusters of most sequences (ties: by id), with `rank` from 1; the report's size is `top`."""
    best = clusters.orderBy(F.desc("n_transcripts"), "region_cluster_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_transcripts"), "region_cluster_id")))


def with_rank(clusters: DataFrame) -> DataFrame:
    """All clusters with `rank`, 1 for that of most sequences: the series of a rank plot, numbered range by range."""
    return numbering.numbered(clusters, F.desc("n_transcripts"), "region_cluster_id", name="rank")


def of_genes(rows: DataFrame, names: list[str] = (), prefixes: list[str] = (), column: str = "gene_name") -> DataFrame:
    """Rows whose gene is one of `names` or begins with one of `prefixes`."""
    wanted = F.col(column).isin(list(names))
    for prefix in prefixes:
        wanted = wanted | F.col(column).startswith(prefix)
    return rows.where(wanted)
