"""Families of local regions: hits to islands, islands to connected components, components to merged members and summaries.

Hits: query, target, qstart, qend, tstart, tend, qgene, tgene (positions from 1, both ends inside).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.records import header_fields, region_id
from kmerloom.operators.graph import components
from kmerloom.operators.intervals import GROUP, islands, largest_group, normalized
from kmerloom.plans import numbering
from kmerloom.plans.storage import release, spool


def filter_hits(hits: DataFrame, keep_same_gene: bool = False) -> DataFrame:
    """Drops hits of a sequence with itself and, unless kept, those within one gene; an unknown gene is no one's."""
    out = hits.where("query != target")
    same = (F.coalesce("qgene", F.lit("")) != "") & (F.col("qgene") == F.col("tgene"))
    return out if keep_same_gene else out.where(~F.coalesce(same, F.lit(False)))


def families(hits: DataFrame) -> DataFrame:
    """(seq, gene, start, end, island, family): both intervals of every hit, with the family they belong to.

    Intervals of a sequence that share a base are one island; a hit links two islands; a family is a connected component. Islands,
    not intervals, are the graph's nodes. family is the smallest island key of the component.
    """
    side = lambda p, s, e, g: hits.select(F.col(p).alias("seq"), F.col(g).alias("gene"), F.col(s).cast("long").alias("start"), F.col(e).cast("long").alias("end"), "hit")
    hits = spool(hits.withColumn("hit", F.monotonically_increasing_id()), "hits")
    ends = normalized(side("query", "qstart", "qend", "qgene").withColumn("side", F.lit(0)).unionByName(side("target", "tstart", "tend", "tgene").withColumn("side", F.lit(1))))
    # the key of an island is the place of its first base: unique and stable from run to run
    placed = islands(ends, ["seq"], spread=largest_group(ends, ["seq"]) > GROUP)
    first = F.min("start").over(Window.partitionBy("seq", "island"))
    placed = spool(placed.withColumn("node", F.concat_ws(":", "seq", F.format_string("%012d", first))), "placed")
    left, right = (placed.where(F.col("side") == i).select("hit", F.col("node").alias(n)) for i, n in ((0, "src"), (1, "dst")))
    edges = spool(left.join(right, "hit").select("src", "dst").distinct(), "edges")
    out = placed.drop("side", "hit").join(components(edges), "node").withColumnRenamed("component", "family")
    out = spool(out.select("seq", "gene", "start", "end", "island", "family"), "families")
    release(hits, placed, edges)
    return out


def members(rows: DataFrame) -> DataFrame:
    """(family, seq, gene, start, end, length): each family's merged intervals."""
    out = rows.groupBy("family", "seq", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("gene").alias("gene"))
    return out.select("family", "seq", "gene", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def numbered(rows: DataFrame) -> DataFrame:
    """(family, region_cluster_id): numbers by falling count of sequences, then by the family's key, given range by range."""
    sized = rows.groupBy("family").agg(F.count_distinct("seq").alias("n"))
    return numbering.numbered(sized, F.desc("n"), "family").select("family", region_id(F.col("number")).alias("region_cluster_id"))


def cluster_summary(rows: DataFrame) -> DataFrame:
    """One row a family: raw and merged intervals, sequences, genes, bases, and its longest member (ties: first by sequence and start)."""
    raw = rows.groupBy("family").agg(F.count("*").alias("n_raw_intervals"), F.count_distinct(F.when(F.col("gene") != "", F.col("gene"))).alias("n_genes"))
    longest = F.min_by(F.struct("seq", "start", "end", "length"), F.struct(-F.col("length"), "seq", "start"))
    merged = members(rows).groupBy("family").agg(F.count("*").alias("n_merged_member_intervals"), F.count_distinct("seq").alias("n_transcripts"), F.sum("length").alias("total_member_bp"), longest.alias("r"))
    out = raw.join(merged, "family").join(numbered(rows), "family")
    return out.select("family", "region_cluster_id", "n_raw_intervals", "n_merged_member_intervals", "n_transcripts", "n_genes", "total_member_bp", F.col("r.seq").alias("representative_transcript"), F.col("r.start").alias("representative_start"), F.col("r.end").alias("representative_end"), F.col("r.length").alias("representative_len"))


def member_table(rows: DataFrame) -> DataFrame:
    """(region_cluster_id, transcript_id, gene_id, start0, end1, length), starts from 0 and ends excluded."""
    return members(rows).join(numbered(rows), "family").select("region_cluster_id", F.col("seq").alias("transcript_id"), F.col("gene").alias("gene_id"), (F.col("start") - 1).alias("start0"), F.col("end").alias("end1"), "length")


def member_sequences(table: DataFrame, records: DataFrame) -> DataFrame:
    """Each member's bases, cut from records (seq_id, seq); members without a record go."""
    return table.join(records, F.col("transcript_id") == F.col("seq_id")).select("region_cluster_id", "transcript_id", "gene_id", "start0", "end1", F.substring("seq", F.col("start0") + 1, F.col("length")).alias("bases"))


def overlap_report(clusters: DataFrame, table: DataFrame, top: int = 10) -> DataFrame:
    """Cluster rows with statistics of their members: distinct ids, lengths' mean, median and range, and the `top` gene symbols.

    Clusters without members have zeros and 'NA'. Symbols of one count come in their own order.
    """
    info = table.withColumn("h", header_fields(F.col("transcript_id"), fallback=False))
    info = info.select("region_cluster_id", "length", F.col("h.transcript_id").alias("t"), F.coalesce(F.nullif("gene_id", F.lit("")), F.col("h.gene_id")).alias("g"), F.col("h.gene_name").alias("symbol"))
    stats = info.groupBy("region_cluster_id").agg(
        F.count("*").alias("n_member_intervals"), F.count_distinct("t").alias("member_transcripts"), F.count_distinct("g").alias("member_genes"), F.count_distinct("symbol").alias("n_gene_symbols"), F.sum("length").alias("member_bp"),
        F.avg("length").alias("mean_member_len"), F.median("length").alias("median_member_len"), F.min("length").alias("min_member_len"), F.max("length").alias("max_member_len"),
    )
    counted = info.where("symbol is not null").groupBy("region_cluster_id", "symbol").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("region_cluster_id").orderBy(F.desc("n"), "symbol"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("region_cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "symbol", F.col("n").cast("string")).alias("s")))).alias("l"))
    best = best.select("region_cluster_id", F.array_join(F.transform("l", lambda x: x["s"]), ";").alias("top_gene_symbols"))
    zeros = ["n_member_intervals", "member_transcripts", "member_genes", "n_gene_symbols", "member_bp", "mean_member_len", "median_member_len", "min_member_len", "max_member_len"]
    out = clusters.join(stats, "region_cluster_id", "left").join(best, "region_cluster_id", "left").na.fill(0, zeros).na.fill("NA", ["top_gene_symbols"])
    h = header_fields(F.col("representative_transcript"), fallback=False)
    return out.withColumn("h", h).select("*", F.col("h.transcript_id").alias("representative_transcript_id"), F.col("h.gene_id").alias("representative_gene_id"), F.col("h.transcript_name").alias("representative_transcript_name"), F.col("h.gene_name").alias("representative_gene_symbol"), F.col("h.transcript_length").alias("representative_transcript_length")).drop("h")


def shared_blocks(kmers: DataFrame, k: int) -> DataFrame:
    """Exact blocks that two sequences share, from (seq, pos, kmer): k-mer matches on one diagonal whose positions touch.

    An extension: it makes hits where no external aligner's are at hand. Pairs are ordered, query before target.
    """
    a, b = (kmers.select(F.col("seq").alias(s), F.col("pos").cast("long").alias(p), "kmer") for s, p in (("query", "qpos"), ("target", "tpos")))
    matches = a.join(b, "kmer").where("query < target").select("query", "target", "qpos", (F.col("qpos") - F.col("tpos")).alias("diagonal"), F.col("qpos").alias("start"), (F.col("qpos") + k - 1).alias("end"))
    blocks = islands(matches, ["query", "target", "diagonal"]).groupBy("query", "target", "diagonal", "island").agg(F.min("start").alias("qstart"), F.max("end").alias("qend"))
    return blocks.select("query", "target", "qstart", "qend", (F.col("qstart") - F.col("diagonal")).alias("tstart"), (F.col("qend") - F.col("diagonal")).alias("tend"))
