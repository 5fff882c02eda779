"""Tab-separated tables and alignment text as DataFrames, with checks of the columns that are asked for."""

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS = "query string, target string, pident double, alnlen int, mismatch int, gapopen int, qstart int, qend int, tstart int, tend int, evalue double, bits double, qlen int, tlen int, qcov double, tcov double"


log = logging.getLogger("kmerloom")


def required(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tsv(spark: SparkSession, paths, *columns: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return required(reader.csv(paths), *columns)


def file_stem(suffix: str = ""):
    """Name of the row's file without folders and suffix."""
    return F.regexp_replace(F.col("_metadata.file_name"), suffix.replace(".", r"\.") + "$", "")


def kmer_lists(spark: SparkSession, folder: str, suffix: str = "_kmers.tsv") -> DataFrame:
    """(ref_id, query_index, kmer_indices, kmer_counts) of every file of a folder that ends in suffix."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("query_index long, kmer_indices string, kmer_counts string").option("pathGlobFilter", f"*{suffix}").csv(folder)
    return rows.select(file_stem(suffix).alias("ref_id"), "query_index", "kmer_indices", "kmer_counts")


def combined_by_k(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Long form of per-k wide tables: metadata, k_size and k_label, ref_id, matched_kmers, matched_kmer_ratio.

    k_size are the digits of the file's name, null if it has none; k_label is the same as text, the file's stem if it has none.

    From the seventh column on, each pair of columns is one reference; files may have different ones, so each is unpivoted by its own header.
    """
    from kmerloom.operators.kmer_qc import META

    out = None
    for path in paths:
        rows = required(spark.read.option("sep", "\t").option("header", True).csv(path), *META)
        names = [c.removesuffix("_matched_kmers") for c in rows.columns if c.endswith("_matched_kmers")]
        cells = F.array(*[F.struct(F.lit(n).alias("ref_id"), F.col(f"`{n}_matched_kmers`").cast("long").alias("matched_kmers"), F.col(f"`{n}_matched_kmer_ratio`").cast("double").alias("matched_kmer_ratio")) for n in names])
        digits = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1), F.lit(""))
        rows = rows.select(digits.cast("int").alias("k_size"), F.coalesce(digits, file_stem(".tsv")).alias("k_label"), *[F.col(c).cast("int" if c == "transcript_length" else "long" if c == "total_kmers" else "string").alias(c) for c in META], F.explode(cells).alias("c")).select("k_size", "k_label", *META, "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def list_tables(spark: SparkSession, folder: str, suffix: str = ".tsv") -> list[str]:
    """Tables of a folder in order of name; a table that Spark wrote is itself a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise ValueError(f"no such folder: {folder}")
    found = system.listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().endswith(suffix))


def status_matrix(spark: SparkSession, path: str, first: int = 4) -> DataFrame:
    """Long form of a status matrix: its first columns, sample, status."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    keep, samples = rows.columns[:first], [c for c in rows.columns[first:] if c not in ("strict_pass_count", "basic_pass_count", "genome_count")]
    return rows.unpivot(keep, samples, "sample", "status")


def hits(spark: SparkSession, path: str) -> DataFrame:
    """A table of local hits, with the genes (second header field) of both sides."""
    rows = required(spark.read.option("sep", "\t").option("header", True).csv(path), "query", "target", "qstart", "qend", "tstart", "tend")
    kinds = dict(x.rsplit(" ", 1) for x in HITS.split(", "))
    rows = rows.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in rows.columns])
    gene = lambda c: F.coalesce(F.try_element_at(F.split(c, r"\|"), F.lit(2)), F.lit(""))
    return rows.withColumn("qgene", gene("query")).withColumn("tgene", gene("target"))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Lines of a list file without blank ones and those that begin with '#'."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v != '' and not startswith(v, '#')")
    return [r.v for r in rows.collect()]


def alignment_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a list that exist; the others are warned of and left out."""
    out = []
    for name in listed(spark, path):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            out.append(name)
        else:
            log.warning("alignment file not found: %s", name)
    return out


def sample_name(path: str, suffixes: tuple[str, ...] = (".sorted.bam", ".sorted.sam", ".bam", ".sam")) -> str:
    """A sample's name: its alignment file's without folders and the first of the suffixes that it has."""
    name = path.rsplit("/", 1)[-1]
    return next((name.removesuffix(s) for s in suffixes if name.endswith(s)), name)


CLUSTERS = "region_cluster_id string, n_raw_intervals long, n_merged_member_intervals long, n_transcripts long, n_genes long, total_member_bp long, representative_transcript string, representative_start long, representative_end long, representative_len long"
MEMBERS = "region_cluster_id string, transcript_id string, gene_id string, start0 long, end1 long, length long"
COUNTS = "category string, name string, count_type string, count long, total_bp long"


def _typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table whose header must have the schema's columns, in any order and among others; values are cast to its types."""
    kinds = [c.split(" ") for c in schema.split(", ")]
    rows = required(spark.read.option("sep", "\t").option("header", True).csv(path), *[n for n, _ in kinds])
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in kinds])


def region_clusters(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, CLUSTERS)


def region_members(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, MEMBERS)


def data_summary(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, COUNTS)


def read_rows(spark: SparkSession, path: str, schema: str, predicate=None) -> DataFrame:
    """Named columns of a large table, with a predicate: no pass over the file to guess types, and other columns aren't parsed further."""
    rows = _typed(spark, path, schema)
    return rows if predicate is None else rows.where(predicate)


def labelled_summaries(spark: SparkSession, pattern: str, expression: str, labels: dict[str, str]) -> DataFrame:
    """Tables of many folders with `genome`, taken from the file's name by a pattern, and `label` and `place` from a fixed map (its order)."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(pattern)
    rows = rows.withColumn("genome", F.regexp_extract(F.col("_metadata.file_name"), expression, 1))
    name = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map()
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("genome")) if labels else F.lit(0)
    return rows.withColumn("label", F.coalesce(F.try_element_at(name, F.col("genome")), F.col("genome")) if labels else F.col("genome")).withColumn("place", place)


def sam(spark: SparkSession, paths, suffix: str = ".sam") -> DataFrame:
    """(sample, row_no, the eleven fixed columns, tags) of alignment text; header lines go."""
    raw = spark.read.text(paths).select(file_stem(suffix).alias("sample"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.split("value", "\t").alias("c"), "value")
    rows = raw.where(~F.col("value").startswith("@") & (F.size("c") >= 11))
    names = ("qname", "flag int", "rname", "pos int", "mapq int", "cigar", "rnext", "pnext int", "tlen int", "seq", "qual")
    cast = [F.col("c")[i].cast(n.split()[1] if " " in n else "string").alias(n.split()[0]) for i, n in enumerate(names)]
    return rows.select("sample", F.col("id").alias("row_no"), *cast, F.slice("c", 12, 1 << 30).alias("tags"))


def sam_contigs(spark: SparkSession, paths, suffix: str = ".sam") -> DataFrame:
    """(sample, contig, length) from header lines."""
    rows = spark.read.text(paths).select(file_stem(suffix).alias("sample"), "value").where(F.col("value").startswith("@SQ"))
    return rows.select("sample", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("length"))
