"""Writers. Wide shapes and number formats are made here and nowhere before. A Spark commit publishes a folder whole or not at all.

What is written in an order is dealt to tasks by ranges of that order, so a folder's files, by name, follow each other.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.functions.records import six_digits
from kmerloom.operators import align_qc, search


def write_tsv(df: DataFrame, path: str, **options) -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "")
    writer.options(**options).csv(path)


def combined_results(results: DataFrame, refs: list[str], path: str) -> None:
    """One row a query, four columns a reference: count, unique k-mers, pass as 1 or 0, fraction with four decimals."""
    shaped = search.wide(results, refs)
    pct = [F.format_string("%.4f", F.col(f"`{r}_pct`")).alias(f"{r}_pct") for r in refs]
    columns = [c for r, p in zip(refs, pct, strict=True) for c in (*(F.col(f"`{r}_{x}`") for x in ("count", "ibf_unique_kmer", "pass")), p)]
    write_tsv(shaped.select("query_index", *columns).orderBy("query_index"), path)


def per_reference_results(results: DataFrame, path: str) -> None:
    """The same columns, one folder ref_id=... a reference."""
    rows = results.select("ref_id", "query_index", "count", F.col("unique_kmers").alias("ibf_unique_kmer"), F.col("pass").cast("int").alias("pass"), F.format_string("%.4f", "pct").alias("pct"))
    rows.repartitionByRange("ref_id", "query_index").sortWithinPartitions("ref_id", "query_index").write.mode("overwrite").partitionBy("ref_id").option("sep", "\t").option("header", True).csv(path)


def unique_kmer_table(unique: DataFrame, path: str) -> None:
    """Distinct k-mers of one bin in order of first position; a query without any has a row with an empty k-mer."""
    rows = unique.select("ref_id", "query_index", F.coalesce("unique_kmer", F.lit("")).alias("ibf_unique_kmer"), "first_pos")
    rows = rows.repartitionByRange("ref_id", "query_index").sortWithinPartitions("ref_id", "query_index", "first_pos").drop("first_pos")
    rows.write.mode("overwrite").partitionBy("ref_id").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def kmer_list_table(lists: DataFrame, path: str) -> None:
    rows = lists.select("ref_id", "query_index", "kmer_indices", "kmer_counts").repartitionByRange("ref_id", "query_index").sortWithinPartitions("ref_id", "query_index")
    rows.write.mode("overwrite").partitionBy("ref_id").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def fragment_fasta(fragments: DataFrame, path: str) -> None:
    """Fragments as FASTA, numbered over all records of a reference: a record's first number is the count of fragments before it."""
    counts = fragments.groupBy("ref_id", "rec_idx").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ref_id").orderBy("rec_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = fragments.join(counts.select("ref_id", "rec_idx", before.alias("first")), ["ref_id", "rec_idx"])
    text = F.format_string(">%s_frag%d\n%s", "ref_id", F.col("first") + F.col("frag_idx"), "frag")
    rows.select("ref_id", "rec_idx", "frag_idx", text.alias("value")).repartitionByRange("ref_id", "rec_idx", "frag_idx").sortWithinPartitions("ref_id", "rec_idx", "frag_idx").select("ref_id", "value").write.mode("overwrite").partitionBy("ref_id").text(path)


def save_index(index: DataFrame, path: str) -> None:
    index.repartition("ref_id", F.pmod(F.xxhash64("kmer"), F.lit(16))).sortWithinPartitions("kmer").write.mode("overwrite").partitionBy("ref_id").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kmer string, n_bins long, ref_id string").parquet(path).select("ref_id", "kmer", "n_bins")


def remove(spark: SparkSession, path: str) -> None:
    from kmerloom.plans import storage

    storage.remove(spark, path)


def exact_detail(details: DataFrame, path: str) -> None:
    write_tsv(details.orderBy("ref_id", "transcript_name", "kmer"), path)


def exact_summary(summary: DataFrame, path: str) -> None:
    ratios = {c: six_digits(F.col(c)) for c in ("matched_kmer_ratio", "unique_kmer_ratio")}
    write_tsv(summary.withColumns(ratios).orderBy("ref_id", "transcript_name"), path)


def matched_wide(matched: DataFrame, refs: list[str], path: str) -> None:
    """Per transcript, matched k-mers and their ratio (six decimals) of each reference, side by side."""
    keys = ["transcript_name", "gene_name", "gene_id", "transcript_id", "transcript_length", "total_kmers"]
    cells = matched.groupBy(*keys).pivot("ref_id", refs).agg(F.first("matched_kmers").alias("matched_kmers"), F.first(F.format_string("%.6f", "matched_kmer_ratio")).alias("matched_kmer_ratio"))
    write_tsv(cells, path)


def per_genome_summaries(matched: DataFrame, path: str) -> None:
    """The rows behind the wide table, one folder ref_id=... a reference: matched and total k-mers and their ratio (six decimals)."""
    keys = ["transcript_name", "gene_name", "gene_id", "transcript_id", "transcript_length", "total_kmers"]
    rows = matched.select("ref_id", *keys, "matched_kmers", F.format_string("%.6f", "matched_kmer_ratio").alias("matched_kmer_ratio"))
    rows = rows.repartitionByRange("ref_id", "transcript_name", "transcript_id").sortWithinPartitions("ref_id", "transcript_name", "transcript_id")
    rows.write.mode("overwrite").partitionBy("ref_id").option("sep", "\t").option("header", True).csv(path)


def by_k(df: DataFrame, path: str) -> None:
    """One folder a k."""
    df.write.mode("overwrite").partitionBy("k_size").option("sep", "\t").option("header", True).csv(path)


def two_decimals(df: DataFrame) -> DataFrame:
    """Every double as text with two decimals, flags as 1 and 0: the form of alignment tables."""
    shape = {"double": lambda c: F.format_string("%.2f", c), "boolean": lambda c: F.col(c).cast("int")}
    return df.select(*[shape[t](c).alias(c) if t in shape else F.col(c) for c, t in df.dtypes])


def alignment_tables(records: DataFrame, quality: DataFrame, grid: DataFrame, samples: list[str], path: str, supplementary: DataFrame | None = None) -> None:
    """alignment_info, sample_qc, the three matrices and, if given, supplementary records: folders of `path`, in the form of alignment tables."""
    write_tsv(two_decimals(records).orderBy("sample", "row_no"), f"{path}/alignment_info")
    write_tsv(two_decimals(quality).orderBy("sample"), f"{path}/sample_qc")
    for name, value in (("status", "status"), ("coverage", "query_coverage_pct"), ("identity", "identity_pct")):
        write_tsv(two_decimals(align_qc.matrix(grid, samples, value)).orderBy("transcript_id"), f"{path}/{name}_matrix")
    if supplementary is not None:
        write_tsv(two_decimals(supplementary).orderBy("sample", "row_no"), f"{path}/supplementary")


def shared_transcripts(grid: DataFrame, samples: list[str], path: str) -> None:
    """Transcripts with their status in every sample and pass counts; those that all samples share strictly and basically; the counts of both."""
    counts = align_qc.pass_counts(grid)
    keys = ["transcript_id", "gene_id", "transcript_name", "gene_name"]
    kept = ["transcript_id", "strict_pass_count", "basic_pass_count", "genome_count"]
    wide = align_qc.matrix(grid, samples, "status").join(counts.select(*kept), "transcript_id").select(*keys, *[f"`{s}`" for s in samples], *kept[1:])
    write_tsv(wide.orderBy("transcript_id"), f"{path}/transcript_pass_counts")
    for kind in ("strict", "basic"):
        write_tsv(wide.where(F.col(f"{kind}_pass_count") == F.col("genome_count")).orderBy("transcript_id"), f"{path}/{kind}_shared_all_genomes")
    write_tsv(two_decimals(align_qc.shared_summary(counts)), f"{path}/shared_summary")


def region_tables(clusters: DataFrame, table: DataFrame, path: str) -> None:
    """Clusters and their members (a BED-like table: starts from 0, ends excluded), both in the order of the cluster's number."""
    write_tsv(clusters.drop("family").orderBy("region_cluster_id"), f"{path}/region_clusters")
    write_tsv(table.orderBy("region_cluster_id", "transcript_id", "start0"), f"{path}/region_members")


def run_summary(parameters: dict[str, object], tables: dict[str, DataFrame], spark: SparkSession, path: str) -> dict[str, int]:
    """A run's parameters and the count of each table's rows as key=value lines; returns the counts."""
    counts = {name: table.count() for name, table in tables.items()}
    key_values({**parameters, **counts}, spark, path)
    return counts


def member_fasta(sequences: DataFrame, path: str) -> None:
    """Members' bases in lines of 60 under headers that name family, sequence, gene, place and length."""
    head = F.format_string(">%s|%s|%s|%d-%d|len=%d\n", "region_cluster_id", "transcript_id", F.coalesce("gene_id", F.lit("")), F.col("start0") + 1, F.col("end1"), F.length("bases"))
    sequences.select(F.concat(head, S.wrapped(F.col("bases"))).alias("value")).write.mode("overwrite").text(path)


def key_values(values: dict[str, object], spark: SparkSession, path: str) -> None:
    """A run's parameters and counters as key=value lines."""
    spark.createDataFrame([(f"{k}={v}",) for k, v in values.items()], "value string").coalesce(1).write.mode("overwrite").text(path)
