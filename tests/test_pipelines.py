"""The pipelines from files to files, by their commands, and the readers, writers and orders that they use."""

import logging

import pytest
from pyspark.sql import functions as F

from kmerloom import __main__ as cli
from kmerloom import pipelines
from kmerloom.operators import regions, report
from kmerloom.plans import numbering
from kmerloom.sources import config, fasta, sinks, tables
from kmerloom.streaming import search as streaming

HEAD = "transcript_name\tgene_name\tgene_id\ttranscript_id\ttranscript_length\ttotal_kmers"
TRANSCRIPTS = ">T1|G1|-|-|N1|HAR|12|lncRNA\nACGTNACGTTTT\n>T2|G2|-|-|N2|XIST|6|lncRNA\nGGGGGG\n"


def read(spark, path):
    return spark.read.option("sep", "\t").option("header", True).csv(str(path))


def run(spark, *arguments):
    options = pipelines.parser().parse_args([str(a) for a in arguments])
    return pipelines.COMMANDS[options.command](spark, options)


@pytest.fixture
def genomes(tmp_path):
    (tmp_path / "genomes").mkdir()
    (tmp_path / "genomes/a.fa").write_text(">1\nACGTA\n>2\nCGTN\n")
    (tmp_path / "genomes/b.fna").write_text(">1\nTTTT\n")
    (tmp_path / "t.fa").write_text(TRANSCRIPTS)
    return tmp_path


def test_exact(spark, genomes):
    run(spark, "exact", genomes / "genomes", genomes / "t.fa", 4, "HAR", "-o", genomes / "out")
    detail = {(r.ref_id, r.kmer): (r.transcript_kmer_count, r.reference_hit_count, r.reference_hits) for r in read(spark, genomes / "out/detail").collect()}
    # ACGTACGTTTT against ACGTACGT and TTTT
    assert detail["a", "ACGT"] == ("2", "2", "whole_reference:1;whole_reference:5")
    assert detail["b", "TTTT"] == ("1", "1", "whole_reference:1") and detail["b", "ACGT"] == ("2", "0", ".")
    summary = {r.ref_id: (r.total_kmer_windows, r.matched_kmer_windows, r.matched_kmer_ratio) for r in read(spark, genomes / "out/summary").collect()}
    assert summary == {"a": ("8", "5", "0.625"), "b": ("8", "1", "0.125")}
    with pytest.raises(ValueError, match="no NONE transcripts"):
        run(spark, "exact", genomes / "genomes", genomes / "t.fa", 4, "NONE", "-o", genomes / "none")


def test_kmer_chain(spark, genomes):
    (genomes / "lists").mkdir()
    (genomes / "lists/g1_kmers.tsv").write_text("query_index\tkmer_indices\tkmer_counts\n0\t1/2/3/4/5/6/7/8/9\t1/1/1/1/1/1/1/1/1\n1\t1\t4\n")
    (genomes / "lists/g2_kmers.tsv").write_text("query_index\tkmer_indices\tkmer_counts\n0\t1/2\t1/0\n1\t\t\n")
    run(spark, "kmer-matches", "-f", genomes / "t.fa", "-k", 4, "-i", genomes / "lists", "-o", genomes / "m")
    wide = {r.transcript_id: r.asDict() for r in read(spark, genomes / "m/combined").collect()}
    assert (wide["T1"]["g1_matched_kmers"], wide["T1"]["g1_matched_kmer_ratio"], wide["T1"]["g2_matched_kmer_ratio"], wide["T2"]["g1_matched_kmer_ratio"]) == ("9", "1.000000", "0.111111", "0.333333")
    assert {(r.ref_id, r.transcript_id, r.matched_kmers) for r in read(spark, genomes / "m/genomes").collect()} == {("g1", "T1", "9"), ("g1", "T2", "1"), ("g2", "T1", "1"), ("g2", "T2", "0")}
    (genomes / "tables").mkdir()
    header = f"{HEAD}\tg1_matched_kmers\tg1_matched_kmer_ratio\tg2_matched_kmers\tg2_matched_kmer_ratio\n"
    (genomes / "tables/k15.tsv").write_text(header + "N1\tHAR\tG1\tT1\t12\t9\t9\t1.0\t9\t1.0\nN2\tXIST\tG2\tT2\t6\t3\t3\t1.0\t0\t0.0\n")
    (genomes / "tables/plain.tsv").write_text(header + "N1\tHAR\tG1\tT1\t12\t9\t9\t0.97\t9\t0.96\n")
    run(spark, "kmer-qc", "-i", genomes / "tables", "-o", genomes / "qc")
    assert {(r.k_size, r.total_transcripts, r.strict_shared_transcripts_all_genomes) for r in read(spark, genomes / "qc/summary_by_k").collect()} == {("15", "2", "1"), ("plain", "1", "1")}
    assert {(r.k_size, r.transcript_id) for r in read(spark, genomes / "qc/strict_shared").collect()} == {("15", "T1"), ("plain", "T1")}
    assert {(r.k_size, r.transcript_id, r.g1, r.g2) for r in read(spark, genomes / "qc/status_matrix").collect()} >= {("15", "T2", "PASS_STRICT_KMER", "LOW_KMER")}
    run(spark, "kmer-report", "-i", genomes / "tables", "-o", genomes / "rep")
    edges = [(r.k_size, r.transcript_id, r.edge_case) for r in read(spark, genomes / "rep/edge_cases").collect()]
    assert edges == [("15", "T2", "not_shared_all_genomes"), ("plain", "T1", "subperfect_but_shared")]


SAM = "@SQ\tSN:chr1\tLN:20000000\nT1|G1.2|-|-|N1|HAR|100|lncRNA\t0\tchr1\t5\t60\t100M\t*\t0\t0\t*\t*\tde:f:0.0\nT2|G2.1|-|-|N2|XIST|100|lncRNA\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nT1|G1.2|-|-|N1|HAR|100|lncRNA\t2048\tchr1\t5\t60\t50M\t*\t0\t0\t*\t*\tde:f:0.0\n"


def test_alignment_chain(spark, tmp_path, caplog):
    for name in ("s1", "s2"):
        (tmp_path / f"{name}.sorted.sam").write_text(SAM)
    (tmp_path / "list").write_text(f"# samples\n{tmp_path}/s1.sorted.sam\n{tmp_path}/gone.sorted.sam\n{tmp_path}/s2.sorted.sam\n")
    with caplog.at_level(logging.WARNING, "kmerloom"):
        run(spark, "alignment-qc", tmp_path / "list", tmp_path / "qc", "--supplementary")
    assert "gone.sorted.sam" in caplog.text
    assert {(r.transcript_id, r.s1, r.s2) for r in read(spark, tmp_path / "qc/status_matrix").collect()} == {("T1", "PASS_STRICT", "PASS_STRICT"), ("T2", "UNMAPPED", "UNMAPPED")}
    assert read(spark, tmp_path / "qc/alignment_info").count() == 4 and read(spark, tmp_path / "qc/supplementary").count() == 2
    assert {r.query_coverage_pct for r in read(spark, tmp_path / "qc/alignment_info").where("mapped = 1").collect()} == {"100.00"}
    run(spark, "shared-transcripts", tmp_path / "qc/status_matrix", tmp_path / "shared")
    assert [(r.transcript_id, r.strict_pass_count, r.genome_count) for r in read(spark, tmp_path / "shared/strict_shared_all_genomes").collect()] == [("T1", "2", "2")]
    assert {(r.metric, r["count"], r.percent_of_transcripts) for r in read(spark, tmp_path / "shared/shared_summary").collect()} >= {("strict_shared_all_genomes", "1", "50.00")}
    run(spark, "alignment-report", tmp_path / "shared/transcript_pass_counts", tmp_path / "rep", "--strip-gene-version", "--genes", "HAR,OTHER")
    assert {(r.gene_name, r.associated_gene_ids) for r in read(spark, tmp_path / "rep/genes").collect()} == {("HAR", "G1"), ("XIST", "G2")}
    assert [(r.intersection, r.gene_count, r.all_genomes_shared) for r in read(spark, tmp_path / "rep/intersections").collect()] == [("s1&s2", "1", "true")]
    assert [r.gene_name for r in read(spark, tmp_path / "rep/selected_genes").collect()] == ["HAR"]


def test_region_chain(spark, genomes):
    (genomes / "h.tsv").write_text("query\ttarget\tqstart\tqend\ttstart\ttend\nT1|G1|-|-|N1|HAR|12|lncRNA\tT2|G2|-|-|N2|XIST|6|lncRNA\t1\t4\t6\t3\nT1|G1|-|-|N1|HAR|12|lncRNA\tT1|G1|-|-|N1|HAR|12|lncRNA\t1\t4\t1\t4\n")
    counts = run(spark, "regions", genomes / "h.tsv", genomes / "t.fa", genomes / "r")
    assert counts == {"input_transcripts": 2, "raw_local_hits": 2, "filtered_local_hits": 1, "shared_region_clusters": 1, "shared_region_member_intervals": 2}
    assert "shared_region_clusters=1" in {r.value for r in spark.read.text(str(genomes / "r/run_summary")).collect()}
    assert {(r.region_cluster_id, r.start0, r.end1) for r in tables.region_members(spark, str(genomes / "r/region_members")).collect()} == {("SR0000001", 0, 4), ("SR0000001", 2, 6)}
    assert {r.value for r in spark.read.text(str(genomes / "r/regions_fasta")).collect()} >= {"ACGT", "GGGG"}
    run(spark, "region-report", genomes / "r/region_clusters", genomes / "r/region_members", genomes / "rr")
    row = read(spark, genomes / "rr/clusters").first()
    assert (row["rank"], row.n_transcripts, row.size_bucket, row.top_gene_symbols) == ("1", "2", "2-5", "HAR:1;XIST:1")
    assert [r["rank"] for r in read(spark, genomes / "rr/top_clusters").collect()] == ["1"]
    (genomes / "bad.tsv").write_text("region_cluster_id\tlength\nx\t1\n")
    with pytest.raises(ValueError, match="missing columns: transcript_id"):
        tables.region_members(spark, str(genomes / "bad.tsv"))


def test_data_summary(spark, genomes, capsys):
    run(spark, "data-summary", genomes / "genomes", genomes / "d")
    rows = {(r.category, r.name): (r.count_type, r["count"], r.total_bp) for r in tables.data_summary(spark, str(genomes / "d/data_summary_count")).collect()}
    assert rows == {("genomes", "total"): ("files", 2, 13), ("genomes", "a"): ("records", 2, 9), ("genomes", "b"): ("records", 1, 4)}
    assert {(r.ref_id, r.n_bases, r.n_percent) for r in read(spark, genomes / "d/n_content").collect()} == {("a", "1", "11.11"), ("b", "0", "0.00")}
    assert cli.main(["data-summary", str(genomes / "nothing"), str(genomes / "x")]) == 1


def test_orders(spark):
    df = spark.createDataFrame([("b", 1.0, 3), ("a", 1.0, 5), ("c", 0.5, 5)], "transcript_name string, matched_kmer_ratio double, n_transcripts long")
    assert [r[0] for r in report.by_ratio(df).collect()] == ["a", "b", "c"]
    clusters = df.withColumn("region_cluster_id", F.col("transcript_name"))
    assert [(r.region_cluster_id, r["rank"]) for r in report.top_clusters(clusters, 2).collect()] == [("a", 1), ("c", 2)]
    assert {(r.region_cluster_id, r["rank"]) for r in report.with_rank(clusters).collect()} == {("a", 1), ("c", 2), ("b", 3)}
    named = df.withColumn("genome", F.col("transcript_name"))
    assert [r.genome for r in report.by_place(named, ["c", "a"]).collect()] == ["c", "a", "b"]
    genes = spark.createDataFrame([("HAR1A",), ("XIST",), ("MIAT",)], "gene_name string")
    assert {r[0] for r in report.of_genes(genes, ["XIST"], ["HAR1"]).collect()} == {"HAR1A", "XIST"}


def test_numbers_of_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(9)
    got = numbering.numbered(rows, F.desc("x")).collect()
    assert {r.x: r.number for r in got} == {i: 5000 - i for i in range(5000)}
    assert numbering.numbered(rows.limit(0), "x").collect() == []


def test_readers(spark, tmp_path):
    (tmp_path / "x.fa").write_text(TRANSCRIPTS)
    assert {(r.seq_id, r.seq) for r in fasta.by_id(fasta.read(spark, str(tmp_path / "x.fa"))).collect()} == {("T1|G1|-|-|N1|HAR|12|lncRNA", "ACGTNACGTTTT"), ("T2|G2|-|-|N2|XIST|6|lncRNA", "GGGGGG")}
    for i, name in enumerate(("gB", "gA")):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}/HAR_{name}_k33.summary.tsv").write_text("transcript_id\tmatched_kmer_ratio\nT1\t0.5\n")
    rows = tables.labelled_summaries(spark, str(tmp_path / "run*/*.summary.tsv"), "HAR_(.+)_k33", {"gA": "Ape", "gB": "Baboon"}).orderBy("place").collect()
    assert [(r.genome, r.label, r.matched_kmer_ratio) for r in rows] == [("gA", "Ape", 0.5), ("gB", "Baboon", 0.5)]
    (tmp_path / "big.tsv").write_text("a\tb\tc\n1\tx\t9\n2\ty\t8\n")
    assert [tuple(r) for r in tables.read_rows(spark, str(tmp_path / "big.tsv"), "c long, a int", F.col("a") > 1).collect()] == [(8, 2)]
    assert [tables.sample_name(x) for x in ("/d/s1.sorted.bam", "s2.sam", "s3.txt")] == ["s1", "s2", "s3.txt"]


def test_index_is_cleaned_up(spark, genomes):
    text = f'ref_dir = "{genomes}/genomes"\nquery_file = "{genomes}/t.fa"\noutput_dir = "{genomes}/o"\nfragment_size = 10\nkmer_size = 4\nstore_index = true\ncleanup_index = true\n'
    (genomes / "c.toml").write_text(text)
    cli.run(spark, config.load(str(genomes / "c.toml")))
    assert not (genomes / "o/index").exists() and (genomes / "o/kmers").exists()


def test_windowed_hits(spark, tmp_path):
    schema = "ts timestamp, ref_id string, hits long"
    rows = [("2024-01-01 00:00:05", "r", 2), ("2024-01-01 00:00:50", "r", 3), ("2024-01-01 00:01:10", "r", 4)]
    spark.createDataFrame(rows, "ts string, ref_id string, hits long").select(F.to_timestamp("ts").alias("ts"), "ref_id", "hits").write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_hits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.window.start.minute, r.ref_id, r.hits, r.positions) for r in spark.table("windows").collect()) == [(0, "r", 5, 2), (1, "r", 4, 1)]


def test_families_are_numbered_by_size(spark):
    rows = spark.createDataFrame([("f1", "s1"), ("f2", "s1"), ("f2", "s2"), ("f0", "s9")], "family string, seq string")
    assert {(r.family, r.region_cluster_id) for r in regions.numbered(rows).collect()} == {("f2", "SR0000001"), ("f0", "SR0000002"), ("f1", "SR0000003")}


def test_writers_keep_the_order(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("r"), F.col("id") % 2).alias("ref_id"), F.col("id").alias("query_index"), F.lit("1").alias("kmer_indices"), F.lit("1").alias("kmer_counts")).repartition(7)
    sinks.kmer_list_table(rows, str(tmp_path / "k"))
    for ref in ("r0", "r1"):
        got = []
        for file in sorted((tmp_path / f"k/ref_id={ref}").glob("*.csv")):
            got += [int(line.split("\t")[0]) for line in file.read_text().splitlines()[1:]]
        assert got == sorted(got) and len(got) == 1500
