"""Components, islands and families against loops; reports on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import records as R
from kmerloom.operators import regions, report
from kmerloom.operators.graph import components
from kmerloom.operators.intervals import islands, merged


def union_find(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(600), rng.randrange(600)) for _ in range(400)],
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(200)],
        "empty": [],
        "loops": [(4, 4), (1, 2), (2, 1), (1, 2)],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union_find(edges)


def test_islands(spark):
    rows = [("s", 1, 10), ("s", 3, 4), ("s", 10, 20), ("s", 21, 30), ("s", 25, 26), ("t", 5, 9)]
    df = spark.createDataFrame(rows, "seq string, start long, end long")
    assert {(r.seq, r.start): r.island for r in islands(df, ["seq"]).collect()} == {("s", 1): 1, ("s", 3): 1, ("s", 10): 1, ("s", 21): 2, ("s", 25): 2, ("t", 5): 1}
    assert {(r.seq, r.start, r.end, r.n_intervals, r.length) for r in merged(df, ["seq"]).collect()} == {("s", 1, 20, 3, 20), ("s", 21, 30, 2, 10), ("t", 5, 9, 1, 5)}


def test_families(spark):
    hits = [("a|g1", "b|g2", 1, 50, 100, 60, "g1", "g2"), ("a|g1", "c|g3", 40, 90, 1, 30, "g1", "g3"), ("d|g4", "e|", 1, 5, 1, 5, "g4", "")]
    df = spark.createDataFrame(hits, "query string, target string, qstart int, qend int, tstart int, tend int, qgene string, tgene string")
    rows = regions.families(df)
    clusters = regions.cluster_summary(rows).orderBy("region_cluster_id").collect()
    assert [(c.region_cluster_id, c.n_raw_intervals, c.n_merged_member_intervals, c.n_transcripts, c.n_genes, c.total_member_bp, c.representative_transcript, c.representative_len) for c in clusters] == [("SR0000001", 4, 3, 3, 3, 161, "a|g1", 90), ("SR0000002", 2, 2, 2, 1, 10, "d|g4", 5)]


def test_shared_blocks(spark):
    block = "ACGTTGCAAC"
    rows = [("a", "TT" + block + "GG"), ("b", "C" + block)]
    kmers = [(s, i + 1, seq[i : i + 4]) for s, seq in rows for i in range(len(seq) - 3)]
    got = regions.shared_blocks(spark.createDataFrame(kmers, "seq string, pos int, kmer string"), 4).where("qend - qstart >= 5").collect()
    assert [tuple(r) for r in got] == [("a", "b", 3, 12, 2, 11)]


def test_pinned_and_buckets(spark):
    table = spark.createDataFrame([("a", 1, 9), ("b", 1, 7), ("a&b", 2, 1)], "intersection string, n_genomes int, gene_count long")
    assert [r.intersection for r in report.top_pinned(table, 2, 2).collect()] == ["a&b", "a"]
    assert [r.intersection for r in report.top_pinned(table, 2, 0).collect()] == ["a&b", "a", "b"]
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 100, 1000, 1001)], "n int").select(R.size_bucket(F.col("n")).alias("b")).collect()
    assert [r.b for r in sizes] == [None, "2-5", "2-5", "6-20", "21-100", "101-1000", ">1000"]
    row = spark.createDataFrame([(0.120233, 12345678.0, "ENSG1.12", "HN_GCF_1_genomic")], "r double, n double, g string, s string")
    got = row.select(R.six_digits(F.col("r")), R.human_number(F.col("n")), R.strip_version(F.col("g")), R.short_label(F.col("s"), ("HN_",), labels={"GCF_1": "one"})).first()
    assert tuple(got) == ("0.120233", "12.3M", "ENSG1", "one")


def test_islands_spread_over_ranges(spark):
    import random

    from kmerloom.operators import intervals

    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), s, s + rng.choice([0, 1, 3, 40]), i) for i in range(1500) for s in [rng.randint(0, 6000)]]
    df = spark.createDataFrame(rows, "seq string, start long, end long, i long").repartition(5)
    one, many = ({r.i: (r.seq, r.start, r.end, r.island) for r in intervals.islands(df, ["seq"], spread=x).collect()} for x in (False, True))
    assert one == many and len({(v[0], v[3]) for v in one.values()}) > 100
    assert intervals.islands(df.limit(0), ["seq"], spread=True).collect() == []
    assert intervals.largest_group(df, ["seq"]) > 500
