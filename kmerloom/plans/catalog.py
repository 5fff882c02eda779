"""Queries of the sequence engine over the driver's tables, each with an equivalent SQL statement.

The tables have no bases, so prose is mapped to them letter by letter: documents by source are the references, benchmark
passages the queries. Alignment records and local hits are made from lineitem and orders by arithmetic that both sides share.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import records as R
from kmerloom.functions import sequence as S
from kmerloom.operators import align_qc, exact, intervals, kmer_qc, regions, report, search
from kmerloom.plans import storage

K, SIZE, THRESHOLD, LONG_K = 12, 400, 15, 28
SEVERAL_K = (8, 10, 12)
SAMPLES = [f"s{i}" for i in range(5)]
GENES = ["GENE1", "GENE7", "GENE13"]
LIMITS = align_qc.Limits(coverage=20, identity=92, mapq=10, strict_identity=95, strict_mapq=30)

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def references(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("source").alias("ref_id"), F.col("doc_id").alias("rec_idx"), S.letters_to_bases(F.col("text")).alias("seq"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_index"), S.letters_to_bases(F.col("text")).alias("seq"))


BASES_SQL = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{S.LETTERS}', '{S.BASES}')"


def _bases(four: bool = False) -> str:
    seq = f"replace({BASES_SQL}, 'N', '')" if four else BASES_SQL
    return f"ref AS (SELECT source AS ref_id, doc_id AS rec_idx, {seq} AS seq FROM documents), qry AS (SELECT item_id AS query_index, {seq} AS seq FROM benchmark)"


def _fragments(size: int = SIZE) -> str:
    step = size - S.OVERLAP
    return f"frag AS (SELECT ref_id, rec_idx, i AS frag_idx, substr(seq, i * {step} + 1, {size}) AS frag FROM (SELECT *, unnest(range(0, CAST(ceil(length(seq) / {step}.0) AS BIGINT))) AS i FROM ref WHERE length(seq) > 0))"


def _hits(k: int, suffix: str = "") -> str:
    """CTEs of query k-mers, index and dense hits for one k."""
    return f"""qk{suffix} AS (SELECT query_index, i AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM qry WHERE length(seq) >= {k})),
idx{suffix} AS (SELECT ref_id, kmer, count(*) AS n_bins FROM (SELECT DISTINCT ref_id, rec_idx, frag_idx, substr(frag, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(frag) - {k} + 2)) AS i FROM frag WHERE length(frag) >= {k})) GROUP BY ref_id, kmer),
hit{suffix} AS (SELECT ref_id, query_index, pos, kmer, n_bins AS hits FROM qk{suffix} JOIN idx{suffix} USING (kmer)),
grid{suffix} AS (SELECT query_index, ref_id, greatest(length(seq) - {k} + 1, 0) AS total_kmers FROM qry, (SELECT DISTINCT ref_id FROM ref))"""


BASE = f"WITH {_bases()}, {_fragments()}"
HITS = f"{BASE}, {_hits(K)}"


def _results(threshold: int) -> str:
    return f"""SELECT g.query_index, g.ref_id, CAST(coalesce(sum(hits), 0) AS BIGINT) AS "count", count(DISTINCT CASE WHEN hits = 1 THEN kmer END) AS unique_kmers, coalesce(sum(hits), 0) >= {threshold} AS "pass",
CASE WHEN total_kmers > 0 THEN CAST(coalesce(sum(hits), 0) AS DOUBLE) / total_kmers ELSE 0.0::DOUBLE END AS pct
FROM grid g LEFT JOIN hit h ON g.query_index = h.query_index AND g.ref_id = h.ref_id GROUP BY g.query_index, g.ref_id, total_kmers"""


@query(f"{HITS} {_results(THRESHOLD)}")
def search_results(spark, folder):
    return search.search(references(spark, folder), passages(spark, folder), K, SIZE, THRESHOLD)


@query(f"WITH {_bases()} SELECT ref_id, rec_idx, seq AS five, replace(seq, 'N', '') AS four FROM ref")
def normalized_sequences(spark, folder):
    return references(spark, folder).select("ref_id", "rec_idx", S.normalize(F.col("seq"), K).alias("five"), S.normalize(F.col("seq"), LONG_K).alias("four"))


@query(f"{BASE} SELECT ref_id, rec_idx, CAST(frag_idx AS INT) AS frag_idx, frag FROM frag")
def fragments(spark, folder):
    return search.fragment_table(references(spark, folder), K, SIZE)


@query(f"{HITS} SELECT query_index, CAST(pos AS INT) AS pos, kmer FROM qk")
def query_kmers(spark, folder):
    return search.query_kmers(passages(spark, folder), K)


@query(f"{HITS} SELECT ref_id, n_bins, count(*) AS kmers FROM idx GROUP BY ref_id, n_bins")
def index_bins(spark, folder):
    index = search.build_index(search.fragment_table(references(spark, folder), K, SIZE), K)
    return index.groupBy("ref_id", "n_bins").agg(F.count("*").alias("kmers"))


def _hits_and_grid(spark, folder, k=K):
    refs, qry = references(spark, folder), passages(spark, folder)
    return search.hits_of(refs, qry, k, SIZE), search.pairs(qry, refs, k)


@query(f"{HITS} SELECT g.query_index, g.ref_id, h.kmer AS unique_kmer, CAST(min(h.pos) AS INT) AS first_pos FROM grid g LEFT JOIN (SELECT * FROM hit WHERE hits = 1) h ON g.query_index = h.query_index AND g.ref_id = h.ref_id GROUP BY ALL")
def unique_kmers(spark, folder):
    return search.unique_kmers(*_hits_and_grid(spark, folder))


@query(f"{HITS} SELECT g.query_index, g.ref_id, coalesce(string_agg(CAST(pos AS VARCHAR), '/' ORDER BY pos), '') AS kmer_indices, coalesce(string_agg(CAST(hits AS VARCHAR), '/' ORDER BY pos), '') AS kmer_counts FROM grid g LEFT JOIN hit h ON g.query_index = h.query_index AND g.ref_id = h.ref_id GROUP BY g.query_index, g.ref_id")
def kmer_hit_lists(spark, folder):
    return search.hit_lists(*_hits_and_grid(spark, folder))


@query(f"""{HITS}, res AS ({_results(THRESHOLD)}), cells AS (SELECT query_index, ref_id, "count", unique_kmers AS ibf_unique_kmer, CAST("pass" AS INT) AS "pass", pct FROM res)
PIVOT cells ON ref_id USING first("count") AS "count", first(ibf_unique_kmer) AS ibf_unique_kmer, first("pass") AS "pass", first(pct) AS pct GROUP BY query_index""")
def wide_results(spark, folder):
    refs = [r[0] for r in references(spark, folder).select("ref_id").distinct().orderBy("ref_id").collect()]  # one a reference
    return search.wide(search_results(spark, folder), refs)


@query(f"WITH {_bases(True)}, {_fragments()}, {_hits(LONG_K)} {_results(1)}")
def four_letter_search(spark, folder):
    return search.search(references(spark, folder), passages(spark, folder), LONG_K, SIZE, 1)


# --- exact location


def _transcripts(spark, folder):
    qry = passages(spark, folder)
    return qry.select(F.concat(F.lit("T-"), F.col("query_index").cast("string")).alias("transcript_name"), F.concat(F.lit("T"), F.col("query_index").cast("string")).alias("transcript_id"), "seq")


def _exact(spark, folder):
    refs, kmers = references(spark, folder), exact.transcript_kmers(_transcripts(spark, folder), K)
    return exact.detail(kmers, exact.locations(kmers, refs, K), refs)


_EXACT = f"""WITH {_bases(True)}, tk AS (SELECT query_index, substr(seq, i, {K}) AS kmer, count(*) AS n FROM (SELECT *, unnest(range(1, length(seq) - {K} + 2)) AS i FROM qry WHERE length(seq) >= {K}) GROUP BY ALL),
chars AS (SELECT ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY rec_idx, i) AS pos, substr(seq, i, 1) AS c FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM ref)),
win AS (SELECT ref_id, pos, string_agg(c, '') OVER (PARTITION BY ref_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING) AS kmer FROM chars),
loc AS (SELECT ref_id, kmer, count(*) AS n_hits, string_agg('whole_reference:' || pos, ';' ORDER BY pos) AS hits FROM win WHERE kmer IN (SELECT kmer FROM tk) GROUP BY ref_id, kmer),
det AS (SELECT r.ref_id, 'T-' || query_index AS transcript_name, 'T' || query_index AS transcript_id, {K} AS k_size, tk.kmer, n AS transcript_kmer_count, coalesce(n_hits, 0) AS reference_hit_count, coalesce(hits, '.') AS reference_hits FROM tk CROSS JOIN (SELECT DISTINCT ref_id FROM ref) r LEFT JOIN loc ON loc.ref_id = r.ref_id AND loc.kmer = tk.kmer)"""


@query(f"{_EXACT} SELECT * FROM det")
def exact_detail(spark, folder):
    return _exact(spark, folder)


@query(f"""{_EXACT} SELECT ref_id, transcript_name, transcript_id, k_size, CAST(sum(transcript_kmer_count) AS BIGINT) AS total_kmer_windows, CAST(sum(CASE WHEN reference_hit_count > 0 THEN transcript_kmer_count ELSE 0 END) AS BIGINT) AS matched_kmer_windows,
count(*) AS unique_kmers, count(*) FILTER (reference_hit_count > 0) AS unique_kmers_found, CAST(sum(reference_hit_count) AS BIGINT) AS reference_hit_sum,
CAST(sum(CASE WHEN reference_hit_count > 0 THEN transcript_kmer_count ELSE 0 END) AS DOUBLE) / CAST(sum(transcript_kmer_count) AS DOUBLE) AS matched_kmer_ratio, CAST(count(*) FILTER (reference_hit_count > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS unique_kmer_ratio
FROM det GROUP BY ref_id, transcript_name, transcript_id, k_size""")
def exact_summary(spark, folder):
    return exact.summary(_exact(spark, folder))


# --- k-mer quality


def _meta(spark, folder):
    q = F.col("query_index")
    return passages(spark, folder).select("query_index", F.concat(F.lit("T-"), q.cast("string")).alias("transcript_name"), F.concat(F.lit("GENE"), (q % 7).cast("string")).alias("gene_name"), F.concat(F.lit("G"), (q % 11).cast("string")).alias("gene_id"), F.concat(F.lit("T"), q.cast("string")).alias("transcript_id"), F.length("seq").alias("transcript_length"))


def _matched(spark, folder):
    """Matched k-mers for several k: references are cut to fragments once, and the result is stored, as reports read it several times."""
    refs, qry = references(spark, folder), passages(spark, folder)
    fragments = storage.spool(search.fragment_table(refs, max(SEVERAL_K), SIZE), "fragments")
    names = storage.spool(refs.select("ref_id").distinct(), "names")
    out = None
    for k in SEVERAL_K:
        kmers = search.query_kmers(qry, k)
        hits = search.probe(kmers, search.build_index(fragments, k, only=kmers))
        rows = kmer_qc.matched_by_query(hits, search.pairs(qry, names, k)).withColumn("k_size", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    out = storage.spool(out, "matched")
    storage.release(fragments, names)
    return out


def _counts(spark, folder):
    return kmer_qc.pass_counts(_matched(spark, folder).join(_meta(spark, folder), "query_index"))


_MATCHED = f"{BASE}, " + ", ".join(_hits(k, str(k)) for k in SEVERAL_K) + ", mat AS (" + " UNION ALL ".join(
    f"SELECT g.query_index, g.ref_id, g.total_kmers, count(pos) AS matched_kmers, CASE WHEN g.total_kmers > 0 THEN CAST(count(pos) AS DOUBLE) / g.total_kmers ELSE 0.0::DOUBLE END AS matched_kmer_ratio, {k} AS k_size FROM grid{k} g LEFT JOIN hit{k} h ON g.query_index = h.query_index AND g.ref_id = h.ref_id GROUP BY g.query_index, g.ref_id, g.total_kmers" for k in SEVERAL_K
) + ")"
_COUNTS = f"""{_MATCHED}, meta AS (SELECT query_index, 'T-' || query_index AS transcript_name, 'GENE' || query_index % 7 AS gene_name, 'G' || query_index % 11 AS gene_id, 'T' || query_index AS transcript_id, CAST(length(seq) AS INT) AS transcript_length FROM qry),
cnt AS (SELECT k_size, transcript_name, gene_name, gene_id, transcript_id, transcript_length, total_kmers, count(*) AS genome_count, count(*) FILTER (matched_kmer_ratio >= 0.95) AS strict_pass_count, count(*) FILTER (matched_kmer_ratio >= 0.8) AS basic_pass_count,
min(matched_kmer_ratio) AS min_matched_kmer_ratio, avg(matched_kmer_ratio) AS mean_matched_kmer_ratio, max(matched_kmer_ratio) AS max_matched_kmer_ratio FROM mat JOIN meta USING (query_index) GROUP BY ALL)"""


@query(f"{_MATCHED} SELECT * FROM mat")
def kmer_match_by_query(spark, folder):
    return _matched(spark, folder)


@query(f"{_COUNTS} SELECT * REPLACE (round(mean_matched_kmer_ratio, 9) AS mean_matched_kmer_ratio) FROM cnt")
def kmer_qc_pass_counts(spark, folder):
    return _counts(spark, folder).withColumn("mean_matched_kmer_ratio", F.round("mean_matched_kmer_ratio", 9))


_SUMMARY = """SELECT k_size, count(*) AS total_transcripts, count(DISTINCT gene_name) AS total_unique_gene_names, max(genome_count) AS genome_count, 0.95::DOUBLE AS strict_threshold, 0.8::DOUBLE AS basic_threshold,
count(*) FILTER (strict_pass_count = genome_count) AS strict_shared_transcripts_all_genomes, count(*) FILTER (basic_pass_count = genome_count) AS basic_shared_transcripts_all_genomes,
count(DISTINCT CASE WHEN strict_pass_count = genome_count THEN gene_name END) AS strict_shared_unique_gene_names, count(DISTINCT CASE WHEN basic_pass_count = genome_count THEN gene_name END) AS basic_shared_unique_gene_names FROM cnt GROUP BY k_size"""


@query(f"{_COUNTS} {_SUMMARY}")
def kmer_qc_summary_by_k(spark, folder):
    return kmer_qc.summary_by_k(_counts(spark, folder))


@query(f"""{_COUNTS}, g AS (SELECT k_size, gene_name, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS associated_gene_ids, count(*) AS total_transcripts, count(*) FILTER (strict_pass_count = genome_count) AS strict_shared_transcripts_all_genomes, count(*) FILTER (basic_pass_count = genome_count) AS basic_shared_transcripts_all_genomes FROM cnt GROUP BY k_size, gene_name)
SELECT *, strict_shared_transcripts_all_genomes > 0 AS strict_shared_gene_all_genomes, basic_shared_transcripts_all_genomes > 0 AS basic_shared_gene_all_genomes FROM g""")
def kmer_gene_summary(spark, folder):
    return kmer_qc.gene_summary(_counts(spark, folder))


@query(f"""{_MATCHED}, st AS (SELECT k_size, ref_id, CASE WHEN matched_kmer_ratio >= 0.95 THEN 'PASS_STRICT_KMER' WHEN matched_kmer_ratio >= 0.8 THEN 'PASS_BASIC_KMER' ELSE 'LOW_KMER' END AS status FROM mat)
SELECT a.k_size, a.ref_id, b.status, count(st.status) AS transcript_count FROM (SELECT DISTINCT k_size, ref_id FROM st) a CROSS JOIN (VALUES ('PASS_STRICT_KMER'), ('PASS_BASIC_KMER'), ('LOW_KMER')) b(status) LEFT JOIN st ON st.k_size = a.k_size AND st.ref_id = a.ref_id AND st.status = b.status GROUP BY ALL""")
def kmer_status_counts(spark, folder):
    return kmer_qc.status_counts(kmer_qc.statuses(_matched(spark, folder)))


_EDGE = "CASE WHEN total_kmers = 0 THEN 'no_valid_kmers' WHEN strict_pass_count = genome_count AND min_matched_kmer_ratio < 1 THEN 'subperfect_but_shared' ELSE 'not_shared_all_genomes' END"


@query(f"{_COUNTS} SELECT * REPLACE (round(mean_matched_kmer_ratio, 9) AS mean_matched_kmer_ratio), {_EDGE} AS edge_case FROM cnt WHERE total_kmers = 0 OR min_matched_kmer_ratio < 1 OR strict_pass_count < genome_count")
def kmer_edge_cases(spark, folder):
    return kmer_qc.edge_cases(_counts(spark, folder)).withColumn("mean_matched_kmer_ratio", F.round("mean_matched_kmer_ratio", 9))


@query(f"""{_COUNTS}, s AS ({_SUMMARY}), e AS (SELECT k_size, count(*) FILTER (total_kmers = 0) AS zero_kmer_transcripts, count(*) FILTER (min_matched_kmer_ratio = 1) AS perfect_all_genomes, count(*) FILTER (min_matched_kmer_ratio < 1 AND strict_pass_count = genome_count AND total_kmers > 0) AS subperfect_but_strict_shared,
count(*) FILTER (strict_pass_count <> genome_count) AS strict_failed_transcripts, count(*) FILTER (basic_pass_count <> genome_count) AS basic_failed_transcripts, min(min_matched_kmer_ratio) FILTER (total_kmers > 0) AS lowest_nonzero_min_ratio FROM cnt GROUP BY k_size)
SELECT s.*, e.* EXCLUDE (k_size), CAST(strict_shared_transcripts_all_genomes AS DOUBLE) / total_transcripts AS strict_retention_fraction, CAST(basic_shared_transcripts_all_genomes AS DOUBLE) / total_transcripts AS basic_retention_fraction, total_transcripts - strict_shared_transcripts_all_genomes AS strict_not_retained, total_transcripts - basic_shared_transcripts_all_genomes AS basic_not_retained FROM s JOIN e USING (k_size)""")
def kmer_report_by_k(spark, folder):
    counts = _counts(spark, folder)
    return kmer_qc.report_by_k(kmer_qc.summary_by_k(counts), kmer_qc.edge_statistics(counts))


@query(f"{_MATCHED} SELECT ref_id, k_size, round(avg(matched_kmer_ratio), 9) AS mean_ratio, min(matched_kmer_ratio) AS min_ratio, max(matched_kmer_ratio) AS max_ratio FROM mat GROUP BY ref_id, k_size")
def kmer_ratio_trend(spark, folder):
    return report.ratio_trend(_matched(spark, folder), ["ref_id", "k_size"]).withColumn("mean_ratio", F.round("mean_ratio", 9))


# --- files


@query(f"WITH {_bases()} SELECT ref_id, count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS total_bp, CAST(max(length(seq)) AS BIGINT) AS longest_bp FROM ref GROUP BY ref_id")
def fasta_stats(spark, folder):
    return report.file_statistics(references(spark, folder))


@query(f"WITH {_bases()}, s AS (SELECT ref_id, count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS total_bp FROM ref GROUP BY ref_id) SELECT 'genomes' AS category, 'total' AS name, 'files' AS count_type, count(*) AS \"count\", CAST(sum(total_bp) AS BIGINT) AS total_bp FROM s UNION ALL SELECT 'genomes', ref_id, 'records', records, total_bp FROM s")
def data_summary(spark, folder):
    return report.category_statistics(report.file_statistics(references(spark, folder)), "genomes")


@query(f"WITH {_bases()} SELECT ref_id, CAST(sum(length(seq)) AS BIGINT) AS total_bases, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS n_bases, 100.0::DOUBLE * CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS DOUBLE) / CAST(sum(length(seq)) AS DOUBLE) AS n_percent, CASE WHEN sum(length(seq) - length(replace(seq, 'N', ''))) > 0 THEN 'yes' ELSE 'no' END AS has_n FROM ref GROUP BY ref_id")
def n_content(spark, folder):
    return report.n_content(references(spark, folder))


# --- alignment records made from lineitem

_NAME = "concat('T', l_partkey % 400, '|G', l_partkey % 50, '.2|-|-|T-', l_partkey % 400, '|GENE', l_partkey % 50, '|1000|lncRNA')"
_FLAG = "CAST(CASE WHEN l_orderkey % 17 = 0 THEN 4 WHEN l_orderkey % 13 = 0 THEN 2048 WHEN l_orderkey % 11 = 0 THEN 256 WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END AS INT)"
_CIGAR = "concat(l_partkey % 30, 'S', 100 + l_orderkey % 900, 'M', l_linenumber, 'I5D', l_suppkey % 7, 'X')"


def _sam(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(
        "concat('s', l_suppkey % 5) AS sample", "l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(l_quantity AS INT) * 1000000 + CAST(round(l_discount * 100) AS INT) * 10000 + l_partkey % 10000 AS row_no", f"{_NAME} AS qname", f"{_FLAG} AS flag", "concat('chr', l_suppkey % 25) AS rname", "CAST(l_orderkey AS INT) AS pos", "CAST(l_quantity AS INT) AS mapq",
        f"{_CIGAR} AS cigar", "'*' AS seq", "filter(array(concat('NM:i:', l_linenumber), concat('AS:i:', l_orderkey % 900), CASE WHEN l_orderkey % 19 != 0 THEN concat('de:f:', l_discount) END, CASE WHEN l_partkey % 23 = 0 THEN concat('SA:Z:chr', l_partkey % 25) END), x -> x IS NOT NULL) AS tags",
    )
    return rows


def _contigs(spark):
    names = spark.range(25)
    return names.crossJoin(spark.createDataFrame([(s,) for s in SAMPLES], "sample string")).select("sample", F.concat(F.lit("chr"), F.col("id").cast("string")).alias("contig"), ((F.col("id") + 1) * 1_000_000).alias("length"))


_SAM = f"""WITH raw AS (SELECT 's' || l_suppkey % 5 AS sample, l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(l_quantity AS INT) * 1000000 + CAST(round(l_discount * 100) AS INT) * 10000 + l_partkey % 10000 AS row_no, {_NAME} AS qname, {_FLAG} AS flag, 'chr' || l_suppkey % 25 AS rname, CAST(l_orderkey AS INT) AS pos, CAST(l_quantity AS INT) AS mapq, {_CIGAR} AS cigar, CASE WHEN l_orderkey % 19 <> 0 THEN l_discount END AS de,
CAST(l_linenumber AS VARCHAR) AS nm, CAST(l_orderkey % 900 AS VARCHAR) AS as_score, CASE WHEN l_partkey % 23 = 0 THEN 'chr' || l_partkey % 25 END AS sa_tag, (l_partkey % 30) AS clip, (100 + l_orderkey % 900 + l_linenumber + l_suppkey % 7) AS aligned, 'T' || l_partkey % 400 AS transcript_id, 'G' || l_partkey % 50 || '.2' AS gene_id, 'T-' || l_partkey % 400 AS transcript_name, 'GENE' || l_partkey % 50 AS gene_name, l_suppkey FROM lineitem),
m0 AS (SELECT *, flag & 4 = 0 AS mapped, flag & 2048 <> 0 AS supp, flag & 256 <> 0 AS secondary FROM raw),
m AS (SELECT *, CASE WHEN mapped THEN CAST(aligned AS INT) ELSE 0 END AS aq, CASE WHEN mapped THEN CAST(clip AS INT) ELSE 0 END AS sc, CASE WHEN mapped THEN 100.0::DOUBLE * CAST(aligned AS DOUBLE) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS cov, CASE WHEN mapped THEN 100.0::DOUBLE * CAST(clip AS DOUBLE) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS scp, CASE WHEN mapped THEN 100.0::DOUBLE * (1.0::DOUBLE - de) END AS ident, CASE WHEN mapped THEN 100.0::DOUBLE * de END AS diverg FROM m0),
rec AS (SELECT *, coalesce(mapped AND cov >= {LIMITS.coverage} AND ident >= 92 AND mapq >= 10, false) AS pass_basic, coalesce(mapped AND cov >= {LIMITS.coverage} AND ident >= 95 AND mapq >= 30, false) AS pass_strict FROM m WHERE NOT secondary)"""


@query(f"""{_SAM} SELECT sample, row_no, qname, transcript_id, gene_id, transcript_name, gene_name, 1000 AS query_length, flag, 'primary' AS alignment_type, mapped, CASE WHEN mapped THEN rname END AS reference, CASE WHEN mapped THEN pos END AS position, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand,
CASE WHEN mapped THEN mapq ELSE 0 END AS mapq, CASE WHEN mapped THEN cigar END AS cigar, aq AS aligned_query_bases, cov AS query_coverage_pct, sc AS softclip_bases, scp AS softclip_pct, ident AS identity_pct, diverg AS divergence_pct, nm, as_score, sa_tag IS NOT NULL AS has_sa_tag, sa_tag, pass_basic, pass_strict,
CASE WHEN NOT mapped THEN 'unmapped' ELSE concat_ws(',', CASE WHEN cov < {LIMITS.coverage} THEN 'low_coverage' END, CASE WHEN ident IS NULL OR ident < 92 THEN 'low_identity' END, CASE WHEN mapq < 10 THEN 'low_mapq' END) END AS fail_reasons FROM rec WHERE NOT supp""")
def align_records(spark, folder):
    return align_qc.record_metrics(_sam(spark, folder), LIMITS)


def _pct(n: str, d: str, name: str) -> str:
    return f"CASE WHEN {d} > 0 THEN 100.0::DOUBLE * CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0.0::DOUBLE END AS {name}"


_MEANS = ("mean_mapq", "mean_query_coverage_pct", "mean_identity_pct", "mean_softclip_pct")


@query(f"""{_SAM}, a AS (SELECT sample, count(*) FILTER (NOT secondary AND NOT supp) AS tot, count(*) FILTER (NOT secondary AND NOT supp AND mapped) AS pm, count(*) FILTER (NOT secondary AND NOT supp AND NOT mapped) AS un, count(*) FILTER (supp) AS su, count(*) FILTER (NOT secondary AND NOT supp AND mapped AND mapq = 0) AS mq0,
count(*) FILTER (NOT secondary AND NOT supp AND mapped AND mapq >= 10) AS g10, count(*) FILTER (NOT secondary AND NOT supp AND mapped AND mapq >= 30) AS g30, round(coalesce(avg(CAST(mapq AS DOUBLE)) FILTER (NOT secondary AND NOT supp AND mapped), 0), 6) AS mean_mapq, round(coalesce(avg(cov) FILTER (NOT secondary AND NOT supp AND mapped), 0), 6) AS mean_query_coverage_pct,
round(coalesce(avg(ident) FILTER (NOT secondary AND NOT supp AND mapped), 0), 6) AS mean_identity_pct, round(coalesce(avg(scp) FILTER (NOT secondary AND NOT supp AND mapped), 0), 6) AS mean_softclip_pct, count(*) FILTER (NOT secondary AND NOT supp AND mapped AND cov >= {LIMITS.coverage} AND ident >= 92 AND mapq >= 10) AS pb, count(*) FILTER (NOT secondary AND NOT supp AND mapped AND cov >= {LIMITS.coverage} AND ident >= 95 AND mapq >= 30) AS ps,
count(*) FILTER (NOT secondary AND NOT supp AND mapped AND sa_tag IS NOT NULL) AS sa, count(*) FILTER (NOT secondary AND NOT supp AND mapped AND l_suppkey % 25 >= 9) AS lg FROM m GROUP BY sample)
SELECT sample, tot AS total_transcripts, pm AS primary_mapped, {_pct("pm", "tot", "primary_mapped_pct")}, un AS unmapped, {_pct("un", "tot", "unmapped_pct")}, su AS supplementary, 100.0::DOUBLE * su / greatest(pm, 1) AS supplementary_per_100_primary, mq0, {_pct("mq0", "pm", "mq0_pct")}, {_pct("g10", "pm", "mapq_ge10_pct")}, {_pct("g30", "pm", "mapq_ge30_pct")},
mean_mapq, mean_query_coverage_pct, mean_identity_pct, mean_softclip_pct, pb AS pass_cov80_id80_mapq10, {_pct("pb", "tot", "pass_cov80_id80_mapq10_pct")}, ps AS pass_cov80_id90_mapq30, {_pct("ps", "tot", "pass_cov80_id90_mapq30_pct")}, sa AS primary_with_sa_tag, {_pct("sa", "pm", "primary_with_sa_tag_pct")}, 10000000 AS large_contig_bp_threshold, CAST(16 AS BIGINT) AS large_contigs, {_pct("lg", "pm", "mapped_on_large_contigs_pct")} FROM a""")
def align_sample_qc(spark, folder):
    out = align_qc.sample_quality(_sam(spark, folder), _contigs(spark), LIMITS)
    return out.withColumns({c: F.round(c, 6) for c in _MEANS})


def _grid(spark, folder):
    return align_qc.status_grid(align_qc.record_metrics(_sam(spark, folder), LIMITS), SAMPLES)


_GRID = f"""{_SAM}, pr AS (SELECT *, CASE WHEN NOT mapped THEN 'UNMAPPED' WHEN pass_strict THEN 'PASS_STRICT' WHEN pass_basic THEN 'PASS_BASIC' ELSE 'LOW_QC' END AS st FROM rec WHERE NOT supp),
cell AS (SELECT transcript_id, sample, max_by(st, row_no) AS status, max_by(cov, row_no) AS cov, max_by(coalesce(ident, -1), row_no) AS ident FROM pr GROUP BY transcript_id, sample),
nam AS (SELECT transcript_id, min_by(gene_id, row_no) AS gene_id, min_by(transcript_name, row_no) AS transcript_name, min_by(gene_name, row_no) AS gene_name FROM pr GROUP BY transcript_id),
grid AS (SELECT n.transcript_id, n.gene_id, n.transcript_name, n.gene_name, s.sample, coalesce(status, 'MISSING') AS status, cov AS query_coverage_pct, nullif(ident, -1) AS identity_pct FROM nam n CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in SAMPLES)}) s(sample) LEFT JOIN cell c ON c.transcript_id = n.transcript_id AND c.sample = s.sample)"""
_ROWS = f"""{_GRID}, cnt AS (SELECT transcript_id, gene_id, transcript_name, gene_name, count(*) FILTER (status = 'PASS_STRICT') AS strict_pass_count, count(*) FILTER (status IN ('PASS_STRICT', 'PASS_BASIC')) AS basic_pass_count, count(*) AS genome_count, bool_and(status = 'UNMAPPED') AS unmapped_in_all FROM grid GROUP BY ALL)"""


@query(f"{_GRID} SELECT * FROM grid")
def align_status(spark, folder):
    return _grid(spark, folder).select("transcript_id", "gene_id", "transcript_name", "gene_name", "sample", "status", "query_coverage_pct", "identity_pct")


def _matrix_sql(value: str) -> str:
    cells = ", ".join(f"max(CASE WHEN sample = '{s}' THEN {value} END) AS {s}" for s in SAMPLES)
    return f"{_GRID} SELECT transcript_id, gene_id, transcript_name, gene_name, {cells} FROM grid GROUP BY ALL"


@query(_matrix_sql("status"))
def align_status_matrix(spark, folder):
    return align_qc.matrix(_grid(spark, folder), SAMPLES, "status")


@query(_matrix_sql("query_coverage_pct"))
def align_coverage_matrix(spark, folder):
    return align_qc.matrix(_grid(spark, folder), SAMPLES, "query_coverage_pct")


@query(_matrix_sql("identity_pct"))
def align_identity_matrix(spark, folder):
    return align_qc.matrix(_grid(spark, folder), SAMPLES, "identity_pct")


@query(f"{_ROWS} SELECT * FROM cnt")
def align_pass_counts(spark, folder):
    return align_qc.pass_counts(_grid(spark, folder))


@query(f"{_ROWS} SELECT * FROM cnt WHERE basic_pass_count = genome_count")
def shared_all_samples(spark, folder):
    return align_qc.shared(align_qc.pass_counts(_grid(spark, folder)), "basic")


@query(f"""{_ROWS}, o AS (SELECT count(*) AS n, count(*) FILTER (strict_pass_count = genome_count) AS s, count(*) FILTER (basic_pass_count = genome_count) AS b FROM cnt)
SELECT metric, v AS "count", 100.0::DOUBLE * CAST(v AS DOUBLE) / CAST(n AS DOUBLE) AS percent_of_transcripts FROM (SELECT 'total_transcripts' AS metric, n AS v, n FROM o UNION ALL SELECT 'strict_shared_all_genomes', s, n FROM o UNION ALL SELECT 'basic_shared_all_genomes', b, n FROM o)""")
def shared_summary(spark, folder):
    return align_qc.shared_summary(align_qc.pass_counts(_grid(spark, folder)))


_STATUS_VALUES = ", ".join(f"('{s}')" for s in align_qc.STATUSES)


@query(f"{_GRID} SELECT a.sample, b.status, count(g.status) AS transcript_count FROM (SELECT DISTINCT sample FROM grid) a CROSS JOIN (VALUES {_STATUS_VALUES}) b(status) LEFT JOIN grid g ON g.sample = a.sample AND g.status = b.status GROUP BY ALL")
def align_status_counts(spark, folder):
    return kmer_qc.status_counts(_grid(spark, folder), align_qc.STATUSES, ("sample",))


_ROLLUP = """SELECT gene_name, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS associated_gene_ids, count(DISTINCT transcript_id) AS n_transcripts, count(*) FILTER (strict_pass_count = genome_count) AS strict_shared_transcripts, count(*) FILTER (basic_pass_count = genome_count) AS basic_shared_transcripts, count(*) FILTER (unmapped_in_all) AS unmapped_all_genomes_transcripts, max(strict_pass_count) AS max_strict_pass_count, max(basic_pass_count) AS max_basic_pass_count FROM cnt GROUP BY gene_name"""


@query(f"{_ROWS}, g AS ({_ROLLUP}) SELECT *, strict_shared_transcripts > 0 AS strict_shared_gene, basic_shared_transcripts > 0 AS basic_shared_gene FROM g")
def align_gene_rollup(spark, folder):
    return report.gene_rollup(align_qc.pass_counts(_grid(spark, folder)))


_METRICS = {
    "total_transcripts": "count(DISTINCT transcript_id)",
    "total_unique_gene_names": "count(DISTINCT gene_name)",
    "strict_shared_transcripts_all_genomes": "count(*) FILTER (strict_pass_count = genome_count)",
    "basic_shared_transcripts_all_genomes": "count(*) FILTER (basic_pass_count = genome_count)",
    "strict_shared_unique_gene_names": "count(DISTINCT CASE WHEN strict_pass_count = genome_count THEN gene_name END)",
    "basic_shared_unique_gene_names": "count(DISTINCT CASE WHEN basic_pass_count = genome_count THEN gene_name END)",
    "transcripts_unmapped_in_all_genomes": "count(*) FILTER (unmapped_in_all)",
    "unique_gene_names_with_transcripts_unmapped_in_all_genomes": "count(DISTINCT CASE WHEN unmapped_in_all THEN gene_name END)",
    "genome_count": "max(genome_count)",
}


@query(f"{_ROWS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({e} AS BIGINT) AS \"value\" FROM cnt" for m, e in _METRICS.items()))
def align_overview(spark, folder):
    return report.overview(align_qc.pass_counts(_grid(spark, folder)))


def _upset(spark, folder):
    return report.intersections(_grid(spark, folder).withColumn("passes", F.col("status").isin("PASS_STRICT", "PASS_BASIC")))


_UPSET = f"""{_GRID}, s AS (SELECT gene_name, string_agg(DISTINCT sample, '&' ORDER BY sample) AS intersection, count(DISTINCT sample) AS n FROM grid WHERE status IN ('PASS_STRICT', 'PASS_BASIC') GROUP BY gene_name), u AS (SELECT intersection, CAST(n AS INT) AS n_genomes, count(*) AS gene_count FROM s GROUP BY ALL)"""


@query(f"{_UPSET} SELECT * FROM u")
def upset_intersections(spark, folder):
    return _upset(spark, folder)


@query(f"{_UPSET} SELECT *, n_genomes = {len(SAMPLES)} AS all_genomes_shared FROM u ORDER BY 4 DESC, gene_count DESC, n_genomes DESC, intersection LIMIT 10")
def upset_top_pinned(spark, folder):
    return report.top_pinned(_upset(spark, folder), len(SAMPLES), 10)


_GENES = ", ".join(f"'{g}'" for g in GENES)


@query(f"{_GRID} SELECT gene_name, sample, count(*) FILTER (status = 'PASS_STRICT') AS strict_count, count(*) FILTER (status IN ('PASS_STRICT', 'PASS_BASIC')) AS basic_count FROM grid WHERE gene_name IN ({_GENES}) GROUP BY ALL")
def selected_genes(spark, folder):
    return report.selected_genes(_grid(spark, folder), GENES)


@query(f"""{_ROWS}, g AS ({_ROLLUP}), c AS (SELECT gene_name, sample, count(*) FILTER (status = 'PASS_STRICT') AS s, count(*) FILTER (status IN ('PASS_STRICT', 'PASS_BASIC')) AS b FROM grid GROUP BY ALL), d AS (SELECT gene_name, count(*) FILTER (s > 0) AS sd, count(*) FILTER (b > 0) AS bd, count(*) AS n FROM c GROUP BY ALL)
SELECT gene_name, associated_gene_ids, n_transcripts AS total_transcripts, strict_shared_transcripts AS strict_shared_transcripts_all_genomes, basic_shared_transcripts AS basic_shared_transcripts_all_genomes, sd AS strict_detected_genomes, bd AS basic_detected_genomes, sd = n AS strict_shared_gene_all_genomes, bd = n AS basic_shared_gene_all_genomes FROM g JOIN d USING (gene_name) WHERE gene_name IN ({_GENES})""")
def gene_presence(spark, folder):
    grid = _grid(spark, folder)
    return report.gene_presence(grid, align_qc.pass_counts(grid), GENES)


# --- methods side by side: alignment rows carry the same keys as the k-mer rows


def _alignment_side(spark, folder):
    """Alignment-like pass counts of the passages, by arithmetic on their number."""
    q = F.col("query_index")
    return _meta(spark, folder).select("gene_name", "transcript_id", "transcript_name", (q % 21).alias("strict_pass_count"), F.greatest(q % 21, F.lit(10)).alias("basic_pass_count"), F.lit(20).cast("long").alias("genome_count"))


_METHOD = f"""{_COUNTS}, al AS (SELECT gene_name, transcript_id, transcript_name, query_index % 21 AS alignment_strict_pass_count, greatest(query_index % 21, 10) AS alignment_basic_pass_count, CAST(20 AS BIGINT) AS alignment_genome_count FROM meta),
km AS (SELECT gene_name, transcript_id, transcript_name, median(strict_pass_count) AS kmer_strict_pass_median, min(strict_pass_count) AS kmer_strict_pass_min, round(avg(mean_matched_kmer_ratio), 9) AS kmer_mean_ratio_mean, arg_min(transcript_length, k_size) AS transcript_length FROM cnt GROUP BY ALL),
cmp AS (SELECT * FROM al LEFT JOIN km USING (gene_name, transcript_id, transcript_name))"""


@query(f"{_METHOD} SELECT * FROM cmp")
def method_comparison(spark, folder):
    return report.method_comparison(_alignment_side(spark, folder), _counts(spark, folder)).withColumn("kmer_mean_ratio_mean", F.round("kmer_mean_ratio_mean", 9))


@query(f"""{_METHOD}, t AS (SELECT *, max(alignment_genome_count) OVER (PARTITION BY gene_name) AS g FROM cmp) SELECT gene_name, 'Alignment strict' AS "method", count(*) FILTER (alignment_strict_pass_count = g) AS "full", count(*) FILTER (alignment_strict_pass_count < g) AS partial, count(DISTINCT transcript_id) AS total FROM t GROUP BY gene_name
UNION ALL SELECT gene_name, 'K-mer strict', count(*) FILTER (kmer_strict_pass_min = g), count(*) FILTER (kmer_strict_pass_min < g), count(DISTINCT transcript_id) FROM t GROUP BY gene_name""")
def method_totals(spark, folder):
    return report.method_totals(report.method_comparison(_alignment_side(spark, folder), _counts(spark, folder)))


# --- intervals and regions


def _events(spark, folder):
    return table(spark, folder, "events").selectExpr("user_id", "event_id", "CAST(floor(value) AS BIGINT) AS start", "CAST(floor(value) AS BIGINT) + event_id % 5 AS end")


_EVENTS = """WITH e AS (SELECT user_id, event_id, CAST(floor("value") AS BIGINT) AS "start", CAST(floor("value") AS BIGINT) + event_id % 5 AS "end" FROM events),
f AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e),
i AS (SELECT user_id, event_id, "start", "end", CAST(sum(n) OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS UNBOUNDED PRECEDING) AS INT) AS island FROM f)"""


@query(f"{_EVENTS} SELECT * FROM i")
def interval_islands(spark, folder):
    return intervals.islands(_events(spark, folder), ["user_id"])


@query(f"""{_EVENTS} SELECT user_id, island, min("start") AS "start", max("end") AS "end", count(*) AS n_intervals, max("end") - min("start") + 1 AS length FROM i GROUP BY user_id, island""")
def interval_merge(spark, folder):
    return intervals.merged(_events(spark, folder), ["user_id"])


_HIT_COLUMNS = {
    "query": "concat('S', o_orderkey % 3000, '|G', (o_orderkey % 3000) % 97, '|-|-|N', o_orderkey % 3000, '|SYM', (o_orderkey % 3000) % 97, '|9000')",
    "target": "concat('S', (o_orderkey * 7 + o_custkey) % 3000, '|G', ((o_orderkey * 7 + o_custkey) % 3000) % 97, '|-|-|N', (o_orderkey * 7 + o_custkey) % 3000, '|SYM', ((o_orderkey * 7 + o_custkey) % 3000) % 97, '|9000')",
    "qstart": "CAST((o_orderkey * 31) % 8009 + 1 AS INT)",
    "qend": "CAST((o_orderkey * 31) % 8009 + 80 + o_custkey % 40 AS INT)",
    "tstart": "CAST((o_custkey * 17 + o_orderkey) % 8009 + 90 + o_orderkey % 50 AS INT)",
    "tend": "CAST((o_custkey * 17 + o_orderkey) % 8009 + 1 AS INT)",
    "qgene": "concat('G', (o_orderkey % 3000) % 97)",
    "tgene": "concat('G', ((o_orderkey * 7 + o_custkey) % 3000) % 97)",
}


def _local_hits(spark, folder):
    """One hit an order; targets run backwards."""
    return table(spark, folder, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _HIT_COLUMNS.items()])


_HIT_ROWS = "hits0 AS (SELECT o_orderkey AS hit, " + ", ".join(f'{e} AS "{c}"' for c, e in _HIT_COLUMNS.items()) + " FROM orders), hits AS (SELECT * FROM hits0 WHERE \"query\" <> target AND qgene <> tgene)"
_FAMILIES = f"""WITH RECURSIVE {_HIT_ROWS},
node AS (SELECT hit, 0 AS side, "query" AS seq, qgene AS gene, CAST(least(qstart, qend) AS BIGINT) AS s, CAST(greatest(qstart, qend) AS BIGINT) AS e FROM hits UNION ALL SELECT hit, 1, target, tgene, least(tstart, tend), greatest(tstart, tend) FROM hits),
fl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY seq ORDER BY s, e, hit, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM node),
isl AS (SELECT *, sum(n) OVER (PARTITION BY seq ORDER BY s, e, hit, side ROWS UNBOUNDED PRECEDING) AS island FROM fl),
keyed AS (SELECT *, seq || ':' || lpad(CAST(min(s) OVER (PARTITION BY seq, island) AS VARCHAR), 12, '0') AS nd FROM isl),
edge AS (SELECT DISTINCT a.nd AS u, b.nd AS v FROM keyed a JOIN keyed b ON a.hit = b.hit AND a.side <> b.side),
walk(v, l) AS (SELECT DISTINCT nd, nd FROM keyed UNION SELECT edge.v, walk.l FROM walk JOIN edge ON edge.u = walk.v WHERE walk.l < edge.v),
fam AS (SELECT v AS nd, min(l) AS family FROM walk GROUP BY v),
placed AS (SELECT family, seq, gene, s, e, island FROM keyed JOIN fam USING (nd)),
mem AS (SELECT family, seq, max(gene) AS gene, min(s) AS "start", max(e) AS "end", max(e) - min(s) + 1 AS length FROM placed GROUP BY family, seq, island),
num AS (SELECT family, 'SR' || lpad(CAST(row_number() OVER (ORDER BY n DESC, family) AS VARCHAR), 7, '0') AS region_cluster_id FROM (SELECT family, count(DISTINCT seq) AS n FROM placed GROUP BY family)),
cl AS (SELECT r.family, region_cluster_id, n_raw_intervals, n_merged_member_intervals, n_transcripts, n_genes, total_member_bp, rep.seq AS representative_transcript, rep."start" AS representative_start, rep."end" AS representative_end, rep.length AS representative_len
FROM (SELECT family, count(*) AS n_raw_intervals, count(DISTINCT gene) AS n_genes FROM placed GROUP BY family) r JOIN (SELECT family, count(*) AS n_merged_member_intervals, count(DISTINCT seq) AS n_transcripts, CAST(sum(length) AS BIGINT) AS total_member_bp FROM mem GROUP BY family) m USING (family)
JOIN (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY family ORDER BY length DESC, seq, "start") = 1) rep USING (family) JOIN num USING (family))"""


def _families(spark, folder):
    return regions.families(regions.filter_hits(_local_hits(spark, folder)))


@query(f"WITH {_HIT_ROWS} SELECT * EXCLUDE (hit) FROM hits")
def hit_filter(spark, folder):
    return regions.filter_hits(_local_hits(spark, folder))


@query(f'{_FAMILIES} SELECT family, seq, gene, s AS "start", e AS "end" FROM placed')
def region_components(spark, folder):
    return _families(spark, folder).select("family", "seq", "gene", "start", "end")


@query(f"{_FAMILIES} SELECT * FROM cl")
def region_summary(spark, folder):
    return regions.cluster_summary(_families(spark, folder))


@query(f'{_FAMILIES} SELECT region_cluster_id, seq AS transcript_id, gene AS gene_id, "start" - 1 AS start0, "end" AS end1, length FROM mem JOIN num USING (family)')
def region_members(spark, folder):
    return regions.member_table(_families(spark, folder))


@query(f"""{_FAMILIES}, inf AS (SELECT region_cluster_id, length, split_part(seq, '|', 1) AS t, gene AS g, split_part(seq, '|', 6) AS symbol FROM mem JOIN num USING (family)),
st AS (SELECT region_cluster_id, count(*) AS n_member_intervals, count(DISTINCT t) AS member_transcripts, count(DISTINCT g) AS member_genes, count(DISTINCT symbol) AS n_gene_symbols, CAST(sum(length) AS BIGINT) AS member_bp, round(avg(length), 6) AS mean_member_len, median(length) AS median_member_len, min(length) AS min_member_len, max(length) AS max_member_len FROM inf GROUP BY region_cluster_id),
sy AS (SELECT region_cluster_id, symbol, count(*) AS n FROM inf GROUP BY ALL), tp AS (SELECT region_cluster_id, string_agg(symbol || ':' || n, ';' ORDER BY n DESC, symbol) AS top_gene_symbols FROM (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY region_cluster_id ORDER BY n DESC, symbol) <= 10) GROUP BY region_cluster_id)
SELECT cl.*, st.* EXCLUDE (region_cluster_id), top_gene_symbols, split_part(representative_transcript, '|', 1) AS representative_transcript_id, split_part(representative_transcript, '|', 2) AS representative_gene_id, split_part(representative_transcript, '|', 5) AS representative_transcript_name, split_part(representative_transcript, '|', 6) AS representative_gene_symbol, 9000 AS representative_transcript_length,
CASE WHEN n_transcripts BETWEEN 2 AND 5 THEN '2-5' WHEN n_transcripts BETWEEN 6 AND 20 THEN '6-20' WHEN n_transcripts BETWEEN 21 AND 100 THEN '21-100' WHEN n_transcripts BETWEEN 101 AND 1000 THEN '101-1000' WHEN n_transcripts > 1000 THEN '>1000' END AS size_bucket FROM cl JOIN st USING (region_cluster_id) JOIN tp USING (region_cluster_id)""")
def region_member_stats(spark, folder):
    rows = _families(spark, folder)
    out = regions.overlap_report(regions.cluster_summary(rows), regions.member_table(rows))
    return out.withColumn("mean_member_len", F.round("mean_member_len", 6)).withColumn("size_bucket", R.size_bucket(F.col("n_transcripts")))
