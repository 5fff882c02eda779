"""k-mer containment search: fragment index, probe and aggregation.

Tables: references (ref_id, rec_idx, seq), queries (query_index, seq), both with raw sequences; index (ref_id, kmer,
n_bins); hits (ref_id, query_index, pos, kmer, hits), sparse (absent: no hit); results (query_index, ref_id, count,
unique_kmers, pass, pct), dense.

The index is exact. It holds how many fragments (bins) of a reference contain a k-mer, not how often it occurs; k-mers that
straddle a fragment's end beyond the overlap aren't in it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.plans.storage import spool


def fragment_table(references: DataFrame, k: int, size: int, overlap: int = S.OVERLAP) -> DataFrame:
    """(ref_id, rec_idx, frag_idx, frag): every fragment of every record. Whole sequences travel no further than this projection."""
    seq = references.select("ref_id", "rec_idx", S.normalize(F.col("seq"), k).alias("seq"))
    return seq.select("ref_id", "rec_idx", F.posexplode(S.fragments(F.col("seq"), size, overlap)).alias("frag_idx", "frag"))


def query_kmers(queries: DataFrame, k: int) -> DataFrame:
    """(query_index, pos, kmer): every k-mer of every query, pos from 1."""
    seq = queries.select("query_index", S.normalize(F.col("seq"), k).alias("seq"))
    return seq.select("query_index", F.posexplode(S.kmers(F.col("seq"), k)).alias("pos", "kmer")).withColumn("pos", F.col("pos") + 1)


def build_index(fragments: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """(ref_id, kmer, n_bins). `only` (kmer) restricts it to k-mers that will be asked for, before anything is shuffled.

    k-mers are made distinct within a fragment as an array in its row, so the count needs no distinct over the table: one
    aggregation, combined before its shuffle, is all that moves. `only` is stored, so that Spark knows its size and broadcasts it or not by that.
    """
    found = fragments.select("ref_id", F.explode(F.array_distinct(S.kmers(F.col("frag"), k))).alias("kmer"))
    if only is not None:
        found = found.join(spool(only.select("kmer").distinct(), "wanted"), "kmer", "left_semi")
    return found.groupBy("ref_id", "kmer").agg(F.count("*").alias("n_bins"))


def probe(kmers: DataFrame, index: DataFrame) -> DataFrame:
    """Sparse hits: positions whose k-mer is in a reference's index."""
    return kmers.join(index, "kmer").select("ref_id", "query_index", "pos", "kmer", F.col("n_bins").alias("hits"))


def pairs(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(query_index, total_kmers, ref_id): every query with every reference, which is the size of the result."""
    sized = queries.select("query_index", S.total_kmers(F.length(S.normalize(F.col("seq"), k)), k).alias("total_kmers"))
    return sized.crossJoin(references.select("ref_id").distinct())


def aggregate(hits: DataFrame, grid: DataFrame, threshold: int = 0) -> DataFrame:
    """Results of every pair of the grid: sum of hits, distinct k-mers in one bin only, pass flag and fraction (may exceed 1).

    Hits are summed by (pair, k-mer) first, which makes the distinct count a plain sum.
    """
    each = hits.groupBy("query_index", "ref_id", "kmer").agg(F.sum("hits").alias("s"), F.max("hits").alias("h"))
    summed = each.groupBy("query_index", "ref_id").agg(F.sum("s").alias("count"), F.sum(F.when(F.col("h") == 1, 1).otherwise(0)).alias("unique_kmers"))
    out = grid.join(summed, ["query_index", "ref_id"], "left").na.fill(0, ["count", "unique_kmers"])
    pct = F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("total_kmers").cast("double")), F.lit(0.0))
    return out.select("query_index", "ref_id", F.col("count").cast("long").alias("count"), F.col("unique_kmers").cast("long").alias("unique_kmers"), (F.col("count") >= threshold).alias("pass"), pct.alias("pct"))


def hits_of(references: DataFrame, queries: DataFrame, k: int, size: int, overlap: int = S.OVERLAP) -> DataFrame:
    kmers = query_kmers(queries, k)
    return probe(kmers, build_index(fragment_table(references, k, size, overlap), k, only=kmers))


def search(references: DataFrame, queries: DataFrame, k: int, size: int, threshold: int = 0, overlap: int = S.OVERLAP) -> DataFrame:
    """The dense result table of the whole search."""
    return aggregate(hits_of(references, queries, k, size, overlap), pairs(queries, references, k), threshold)


def unique_kmers(hits: DataFrame, grid: DataFrame) -> DataFrame:
    """(query_index, ref_id, unique_kmer, first_pos): distinct k-mers in one bin only, with a null row for pairs that have none."""
    found = hits.where("hits = 1").groupBy("query_index", "ref_id", F.col("kmer").alias("unique_kmer")).agg(F.min("pos").alias("first_pos"))
    return grid.select("query_index", "ref_id").join(found, ["query_index", "ref_id"], "left")


def hit_lists(hits: DataFrame, grid: DataFrame) -> DataFrame:
    """(query_index, ref_id, kmer_indices, kmer_counts): parallel slash lists in order of position, empty without hits.

    A list is as long as its query at most.
    """
    listed = hits.groupBy("query_index", "ref_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hits"))).alias("p"))
    joined = lambda name: F.coalesce(F.array_join(F.transform("p", lambda x: x[name].cast("string")), "/"), F.lit(""))
    return grid.select("query_index", "ref_id").join(listed, ["query_index", "ref_id"], "left").select("query_index", "ref_id", joined("pos").alias("kmer_indices"), joined("hits").alias("kmer_counts"))


def wide(results: DataFrame, refs: list[str]) -> DataFrame:
    """One row a query, four columns a reference; the references are given, so no job looks for them."""
    shaped = results.groupBy("query_index").pivot("ref_id", refs).agg(F.first("count").alias("count"), F.first("unique_kmers").alias("ibf_unique_kmer"), F.first(F.col("pass").cast("int")).alias("pass"), F.first("pct").alias("pct"))
    return shaped.select("query_index", *[F.col(f"`{r}_{c}`") for r in refs for c in ("count", "ibf_unique_kmer", "pass", "pct")])
