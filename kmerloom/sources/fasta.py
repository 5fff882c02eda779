"""Sequence files as tables. Plain and gzip-compressed files are read by Spark's text source, so any store it reads will do."""

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions.records import header_fields
from kmerloom.functions.sequence import normalize, total_kmers

#: Suffixes of reference files, case-sensitive; any of them may be followed by .gz.
SUFFIXES = (".fa", ".fna", ".fasta")
#: Suffixes that a recursive, case-insensitive search takes.
LOOSE_SUFFIXES = (".fa", ".fna", ".fasta", ".fas")


def is_fasta(name: str, suffixes: tuple[str, ...] = SUFFIXES) -> bool:
    return name.removesuffix(".gz").endswith(suffixes)


def ref_id(path: str) -> str:
    """File name without its sequence suffix and .gz."""
    name = os.path.basename(path).removesuffix(".gz")
    return next((name.removesuffix(s) for s in sorted(SUFFIXES, key=len, reverse=True) if name.endswith(s)), name)


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """Sequence files of a folder in order of name; a recursive search ignores case and hidden resource files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise ValueError(f"no such folder: {folder}")
    found, walk = [], system.listFiles(path, recursive)
    while walk.hasNext():
        file = walk.next().getPath()
        name = file.getName()
        if is_fasta(name) if not recursive else is_fasta(name.lower(), LOOSE_SUFFIXES) and not name.startswith("._"):
            found.append(file.toString())
    return sorted(found)


def references(spark: SparkSession, folder: str) -> list[str]:
    """Reference files of a folder; raises if there are none or two would have one ref_id."""
    files = list_files(spark, folder)
    if not files:
        raise ValueError(f"no reference files in {folder}")
    ids = [ref_id(f) for f in files]
    if twice := {i for i in ids if ids.count(i) > 1}:
        raise ValueError(f"reference ids that occur twice: {', '.join(sorted(twice))}")
    return files


def read(spark: SparkSession, paths: list[str] | str, lines: bool = False) -> DataFrame:
    """(file, ref_id, rec_idx, header, seq), rec_idx from 0 in the file's order; carriage returns and blanks in sequences go.

    A file is split at line ends followed by '>'. Compressed files can't be split that way, so with `lines`, and for every .gz,
    lines are read instead and gathered to records by a running count. An empty file has no record.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    packed = [p for p in paths if p.endswith(".gz") or lines]
    parts = [p for p in paths if p not in packed]
    out = None
    for some, reader in ((parts, _by_record), (packed, _by_line)):
        if some:
            out = reader(spark, some) if out is None else out.unionByName(reader(spark, some))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.gz$", "")
    return out.withColumn("ref_id", F.regexp_replace(F.url_decode(name), "(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$", "")).select("file", "ref_id", "rec_idx", "header", "seq")


def _by_record(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    raw = raw.where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    text = F.regexp_replace("value", "^>", "")
    end = F.instr(text, "\n")
    header = F.when(end > 0, F.substring(text, F.lit(1), end - 1)).otherwise(text)
    seq = F.when(end > 0, F.regexp_replace(F.substr(text, end + 1), r"\s", "")).otherwise("")
    # sequences are sorted within their block of the file only; how many records the blocks before have is one row a block
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    rows = raw.select("file", "block", place.cast("long").alias("place"), F.rtrim(F.regexp_replace(header, "\r", "")).alias("header"), seq.alias("seq"))
    rows = rows.join(counts.select("file", "block", before.alias("before")), ["file", "block"])
    return rows.select("file", "header", "seq", (F.col("before") + F.col("place")).alias("rec_idx"))


def _by_line(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.text(paths).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    order = Window.partitionBy("file").orderBy("block", "id")
    rows = raw.withColumn("rec_idx", F.sum(F.when(F.col("value").startswith(">"), 1).otherwise(0)).over(order) - 1).where("rec_idx >= 0")
    line = F.struct("block", "id", "value")
    rows = rows.groupBy("file", "rec_idx").agg(F.min_by("value", F.struct("block", "id")).alias("first"), F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.array_join(F.transform(F.slice("lines", 2, 1 << 30), lambda x: x["value"]), "")
    return rows.select("file", F.rtrim(F.substr("first", F.lit(2))).alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"), F.col("rec_idx").cast("long").alias("rec_idx"))


def queries(records: DataFrame) -> DataFrame:
    """(query_index, header, seq): row identity is the record's place in its file."""
    return records.select(F.col("rec_idx").alias("query_index"), "header", "seq")


def transcripts(records: DataFrame, gene: str | None = None) -> DataFrame:
    """(transcript_name, transcript_id, seq) of records with transcript headers, of one gene if named; bases without N, none empty."""
    rows = records.select(header_fields(F.split("header", r"\s")[0]).alias("h"), F.translate(normalize(F.col("seq"), 1), "N", "").alias("seq"))
    rows = rows if gene is None else rows.where(F.col("h.gene_name") == gene)
    return rows.where(F.length("seq") > 0).select("h.transcript_name", "h.transcript_id", "seq")


def transcript_metadata(records: DataFrame, k: int) -> DataFrame:
    """(query_index, names and ids, transcript_length, total_kmers) from headers alone; the sequence column is never read."""
    h = header_fields(F.split("header", r"\s")[0])
    rows = records.select(F.col("rec_idx").alias("query_index"), h.alias("h"))
    length = F.coalesce("h.transcript_length", F.lit(0))
    return rows.select("query_index", "h.transcript_name", "h.gene_name", "h.gene_id", "h.transcript_id", length.alias("transcript_length"), total_kmers(length, k).alias("total_kmers"))


def by_id(records: DataFrame) -> DataFrame:
    """(seq_id, seq): the id is the header up to its first blank."""
    return records.select(F.split("header", r"\s")[0].alias("seq_id"), "seq")
