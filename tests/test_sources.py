"""Files, configuration, sinks, the command line and streaming."""

import gzip

import pytest
from pyspark.sql import functions as F

from kmerloom import __main__ as cli
from kmerloom.operators import align_qc, regions, search
from kmerloom.sources import config, fasta, sinks, tables
from kmerloom.streaming import search as streaming

CONFIG = """
hit_threshold = 2 # kept as general
[general]
ref_dir = "refs"
query_file = "q.fa"
fragment_size = 100
kmer_size = 20
store_index = true
[ibf]
fpr = 0.02
[hibf]
tmax = 64
"""


def test_config():
    c = config.parse(CONFIG)
    assert (c.ref_dir, c.query_file, c.fragment_size, c.kmer_size, c.hit_threshold, c.store_index, c.ibf.fpr, c.hibf.tmax, c.single_results_writer) == ("refs", "q.fa", 100, 20, 2, True, 0.02, 64, True)


@pytest.mark.parametrize(
    ("old", "new", "error"),
    [
        ('ref_dir = "refs"', "", "ref_dir"),
        ("fragment_size = 100", "fragment_size = 3", "fragment_size must be >= 4"),
        ("fragment_size = 100", "fragment_size = 10", "kmer_size must be > 0 and <="),
        ("kmer_size = 20", "kmer_size = 33", "kmer_size"),
        ("kmer_size = 20", "kmer_size = -1", "kmer_size"),
        ("kmer_size = 20", 'kmer_size = "20"', "kmer_size"),
        ("fpr = 0.02", "fpr = 0.6", "ibf.fpr"),
        ("tmax = 64", "other = 1", "unknown key"),
        ("[hibf]", "[else]", "unknown section"),
        ("[general]", "[general]\nhit_threshold = 1", "duplicate key"),
        ("store_index = true", 'index_method = "x"', "index_method"),
    ],
)
def test_config_errors(old, new, error):
    with pytest.raises(ValueError, match=error):
        config.parse(CONFIG.replace(old, new))


RECORDS = ">one |x\r\nACGTA\r\nAAcg\r\n\r\n>two > half\nAGC\nTNU\n>three\n>four\nA C\tG"


def test_fasta(spark, tmp_path):
    (tmp_path / "x.1.fna").write_text(RECORDS, newline="")
    with gzip.open(tmp_path / "y.fa.gz", "wt", newline="") as f:
        f.write(RECORDS)
    (tmp_path / "empty.fasta").write_text("")
    (tmp_path / "no.fas").write_text(">z\nA")
    files = fasta.references(spark, str(tmp_path))
    assert [fasta.ref_id(f) for f in files] == ["empty", "x.1", "y"]
    rows = fasta.read(spark, files).orderBy("ref_id", "rec_idx").collect()
    expected = [("one |x", "ACGTAAAcg"), ("two > half", "AGCTNU"), ("three", ""), ("four", "ACG")]
    assert [(r.ref_id, r.rec_idx, r.header, r.seq) for r in rows] == [(ref, i, h, s) for ref in ("x.1", "y") for i, (h, s) in enumerate(expected)]
    assert len(fasta.list_files(spark, str(tmp_path), recursive=True)) == 4
    (tmp_path / "y.fna").write_text(">z\nA")
    with pytest.raises(ValueError, match="twice"):
        fasta.references(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no reference"):
        (tmp_path / "sub").mkdir()
        fasta.references(spark, str(tmp_path / "sub"))


def test_record_order_over_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "a.fa").write_text("".join(f">r{i}\n{'ACGT' * (i % 7)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = fasta.read(spark, str(tmp_path / "a.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.rec_idx: r.header for r in rows} == {i: f"r{i}" for i in range(n)}


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.fa").write_text(">T1.1|G1.2|-|-|N-201|N|1234|lncRNA|\nacgnt\n>T2|G2|-|-||M|7x|\nNN\n>T3 more\nAC\n")
    records = fasta.read(spark, str(tmp_path / "t.fa"))
    assert [tuple(r) for r in fasta.transcripts(records, "N").collect()] == [("N-201", "T1.1", "ACGT")]
    assert fasta.transcripts(records).count() == 2
    rows = fasta.transcript_metadata(records, 1000).orderBy("query_index").collect()
    assert [tuple(r)[1:] for r in rows] == [("N-201", "N", "G1.2", "T1.1", 1234, 235), ("T2", "M", "G2", "T2", 0, 0), ("T3", None, None, "T3", 0, 0)]


@pytest.mark.parametrize("single", [True, False])
def test_command(spark, tmp_path, single, capsys):
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs/test.fasta").write_text(">one\nACGTAAACGTAAAAA\n>two\nAGCTAAACCCCCAAAGGG\n")
    (tmp_path / "q.fa").write_text(">q\nACGTCCCCCCCCCCCC\n>short\nAC\n")
    text = f'ref_dir = "{tmp_path}/refs"\nquery_file = "{tmp_path}/q.fa"\noutput_dir = "{tmp_path}/out"\nfragment_size = 80000\nkmer_size = 5\nhit_threshold = 1\nstore_fragments = true\nstore_index = true\nsingle_results_writer = {str(single).lower()}\n'
    (tmp_path / "c.toml").write_text(text)
    assert cli.run(spark, config.load(str(tmp_path / "c.toml"))) is None
    read = lambda p: spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / p))
    if single:
        assert [tuple(r) for r in read("results.tsv").orderBy("query_index").collect()] == [("0", "8", "1", "1", "0.6667"), ("1", "0", "0", "0", "0.0000")]
    else:
        assert {tuple(r) for r in read("results").collect()} == {("0", "8", "1", "1", "0.6667", "test"), ("1", "0", "0", "0", "0.0000", "test")}
    assert {(r.query_index, r.ibf_unique_kmer) for r in read("unique_mers").collect()} == {("0", "CCCCC"), ("1", None)}
    assert read("kmers").where("query_index = 0").first().kmer_indices == "5/6/7/8/9/10/11/12"
    assert spark.read.text(str(tmp_path / "out/fragments")).where(F.col("value").startswith(">")).count() == 2
    assert sinks.load_index(spark, str(tmp_path / "out/index")).where("kmer = 'CCCCC'").first().n_bins == 1
    assert cli.main([str(tmp_path / "missing.toml")]) == 1


def test_kmer_list_files_and_wide_tables(spark, tmp_path):
    (tmp_path / "g1_kmers.tsv").write_text("query_index\tkmer_indices\tkmer_counts\n0\t1/2/3\t1/0/2\n1\t\t\n2\t5/6\t1/1/1\n")
    from kmerloom.functions.records import positive_pairs

    rows = tables.kmer_lists(spark, str(tmp_path)).withColumn("n", positive_pairs(F.col("kmer_indices"), F.col("kmer_counts"))).orderBy("query_index").collect()
    assert [(r.ref_id, r.n) for r in rows] == [("g1", 2), ("g1", 0), ("g1", 2)]
    (tmp_path / "k15.tsv").write_text("transcript_name\tgene_name\tgene_id\ttranscript_id\ttranscript_length\ttotal_kmers\ta.1_matched_kmers\ta.1_matched_kmer_ratio\tb_matched_kmers\tb_matched_kmer_ratio\nn\tg\ti\tt\t30\t16\t16\t1.0\t8\t0.5\n")
    rows = tables.combined_by_k(spark, [str(tmp_path / "k15.tsv")]).collect()
    assert {(r.k_size, r.ref_id, r.matched_kmers, r.matched_kmer_ratio) for r in rows} == {(15, "a.1", 16, 1.0), (15, "b", 8, 0.5)}


SAM = "\n".join(
    [
        "@SQ\tSN:chrBig\tLN:20000000",
        "@SQ\tSN:chrSmall\tLN:100",
        "T1|G1|-|-|N1|G|100|lncRNA\t16\tchrBig\t5\t60\t10S50M2I3D5N40=1X4H\t*\t0\t0\t*\t*\tNM:i:1\tde:f:0.05\tAS:i:9",
        "T2|G2|-|-|N2|G|100|lncRNA\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*",
        "T3|G3|-|-|N3|H|100|lncRNA\t256\tchrBig\t5\t60\t100M\t*\t0\t0\t*\t*\tde:f:0.0",
        "T1|G1|-|-|N1|G|100|lncRNA\t2048\tchrBig\t5\t60\t50M\t*\t0\t0\t*\t*\tde:f:0.0\tSA:Z:x",
        "T4|G4|-|-|N4|H|100|lncRNA\t0\tchrSmall\t5\t10\t100M\t*\t0\t0\t*\t*\tSA:Z:y",
    ]
)


def test_alignment_text(spark, tmp_path):
    (tmp_path / "s1.sam").write_text(SAM)
    rows = tables.sam(spark, str(tmp_path / "s1.sam"))
    metrics = {r.transcript_id: r for r in align_qc.record_metrics(rows).collect()}
    assert set(metrics) == {"T1", "T2", "T4"}
    a = metrics["T1"]
    assert (a.aligned_query_bases, a.softclip_bases, a.strand, a.identity_pct, a.nm, a.as_score, a.pass_basic, a.pass_strict, a.fail_reasons) == (93, 10, "-", 95.0, "1", "9", True, True, "")
    assert (metrics["T2"].fail_reasons, metrics["T2"].mapq, metrics["T2"].reference) == ("unmapped", 0, None)
    assert (metrics["T4"].fail_reasons, metrics["T4"].pass_basic, metrics["T4"].sa_tag) == ("low_identity", False, "y")
    assert align_qc.record_metrics(rows, supplementary=True).count() == 1
    q = align_qc.sample_quality(rows, tables.sam_contigs(spark, str(tmp_path / "s1.sam"))).first()
    assert (q.sample, q.total_transcripts, q.primary_mapped, q.unmapped, q.supplementary, q.large_contigs, q.mapped_on_large_contigs_pct, q.mean_identity_pct, q.primary_with_sa_tag) == ("s1", 3, 2, 1, 1, 1, 50.0, 95.0, 1)
    grid = align_qc.status_grid(align_qc.record_metrics(rows), ["s1", "s2"])
    assert {(r.transcript_id, r.sample): r.status for r in grid.collect()} == {("T1", "s1"): "PASS_STRICT", ("T2", "s1"): "UNMAPPED", ("T4", "s1"): "LOW_QC", ("T1", "s2"): "MISSING", ("T2", "s2"): "MISSING", ("T4", "s2"): "MISSING"}
    sinks.write_tsv(sinks.two_decimals(align_qc.record_metrics(rows).drop("row_no")), str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).where("transcript_id = 'T1'").first().query_coverage_pct == "93.00"


def test_hits_table_and_member_fasta(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("query\ttarget\tqstart\tqend\ttstart\ttend\tbits\nS1|G1\tS2|G2\t1\t70\t90\t21\t5.5\nS1|G1\tS1|G1\t1\t9\t1\t9\t1\nS1|G1\tS3|G1\t1\t9\t1\t9\t1\n")
    hits = tables.hits(spark, str(tmp_path / "h.tsv"))
    kept = regions.filter_hits(hits)
    assert kept.count() == 1 and regions.filter_hits(hits, keep_same_gene=True).count() == 2
    table = regions.member_table(regions.families(kept))
    records = spark.createDataFrame([("S1|G1", "ACGT" * 30)], "seq_id string, seq string")
    sinks.member_fasta(regions.member_sequences(table, records), str(tmp_path / "fa"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "fa")).collect()]
    assert lines == [">SR0000001|S1|G1|G1|1-70|len=70", ("ACGT" * 30)[:60], ("ACGT" * 30)[60:70]]
    with pytest.raises(ValueError, match="missing columns"):
        tables.required(records, "seq", "nothing")
    (tmp_path / "list").write_text("# no\n\n a.bam \nb.bam")
    assert tables.listed(spark, str(tmp_path / "list")) == ["a.bam", "b.bam"]


def test_stream(spark, tmp_path):
    refs = spark.createDataFrame([("r", 0, "ACGTACGTTT")], "ref_id string, rec_idx long, seq string")
    index = search.build_index(search.fragment_table(refs, 3, 8), 3)
    spark.createDataFrame([(0, "ACGT"), (1, "GGGG")], "query_index long, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_index long, seq string").parquet(str(tmp_path / "in"))
    run = streaming.stream_results(stream, index, refs, 3, str(tmp_path / "out"), str(tmp_path / "check"), 1)
    run.processAllAvailable()
    run.stop()
    got = {r.query_index: (r["count"], r["pass"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.query_index: (r["count"], r["pass"]) for r in search.search(refs, spark.createDataFrame([(0, "ACGT"), (1, "GGGG")], "query_index long, seq string"), 3, 8, 1).collect()}
