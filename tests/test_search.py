"""Golden cases and brute force for sequences, search and exact location."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.operators import exact, search


def references(spark, rows):
    return spark.createDataFrame(rows, "ref_id string, rec_idx long, seq string")


def queries(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "query_index long, seq string")


def cut(seq, size, step):
    return [seq[i : i + size] for i in range(0, len(seq), step)]


@pytest.mark.parametrize(("seq", "size", "expected"), [("ACGTACGTAA", 5, ["ACGTA", "GTACG", "ACGTA", "GTAA", "AA"]), ("AACCGGTT", 4, cut("AACCGGTT", 4, 1)), ("", 5, []), ("A", 5, ["A"])])
def test_golden_fragments(spark, seq, size, expected):
    rows = search.fragment_table(references(spark, [("r", 0, seq)]), 5, size).orderBy("frag_idx").collect()
    assert [r.frag for r in rows] == expected


def test_random_fragments_and_kmers(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(seqs)), "i long, s string")
    for size, k in ((4, 1), (7, 3), (20, 20), (50, 32)):
        for i, frags, kmers in df.select("i", S.fragments(F.col("s"), size), S.kmers(F.col("s"), k)).collect():
            assert frags == cut(seqs[i], size, size - 3)
            assert kmers == [seqs[i][j : j + k] for j in range(len(seqs[i]) - k + 1)]


def test_alphabets(spark):
    df = spark.createDataFrame([("acgunRyk*",)], "s string")
    assert tuple(df.select(S.normalize(F.col("s"), 27), S.normalize(F.col("s"), 28)).first()) == ("ACGTNNNNN", "ACGT")


def test_golden_hits(spark):
    index = search.build_index(spark.createDataFrame([("r", 0, 0, "ACGTA"), ("r", 0, 1, "CGTAC")], "ref_id string, rec_idx long, frag_idx int, frag string"), 3)
    qry = queries(spark, ["ACGTAC"])
    hits = search.probe(search.query_kmers(qry, 3), index)
    grid = search.pairs(qry, spark.createDataFrame([("r",)], "ref_id string"), 3)
    assert tuple(search.hit_lists(hits, grid).select("kmer_indices", "kmer_counts").first()) == ("1/2/3/4", "1/2/2/1")
    assert [r.unique_kmer for r in search.unique_kmers(hits, grid).orderBy("first_pos").collect()] == ["ACG", "TAC"]


def test_golden_run(spark):
    refs = references(spark, [("test", 0, "ACGTAAACGTAAAAA"), ("test", 1, "AGCTAAACCCCCAAAGGG")])
    qry = queries(spark, ["ACGTCCCCCCCCCCCC"])
    r = search.search(refs, qry, 5, 80000, 1).first()
    assert (r["count"], r.unique_kmers, r["pass"], round(r.pct, 4)) == (8, 1, True, 0.6667)
    grid = search.pairs(qry, refs, 5)
    hits = search.hits_of(refs, qry, 5, 80000)
    assert tuple(search.hit_lists(hits, grid).select("kmer_indices", "kmer_counts").first()) == ("5/6/7/8/9/10/11/12", "/".join("1" * 8))
    assert search.fragment_table(refs, 5, 80000).count() == 2


@pytest.mark.parametrize(("k", "size"), [(1, 4), (3, 5), (4, 9), (9, 30), (27, 40), (28, 40), (32, 33)])
def test_search_equals_brute_force(spark, k, size):
    rng = random.Random(k)
    letters = "ACGTN"
    core = "".join(rng.choice("ACGT") for _ in range(60))
    records = [(f"r{i % 3}", i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) + core[rng.randint(0, 20) :]) for i in range(9)]
    qs = ["", "A", core, core[5:50].lower(), "".join(rng.choice(letters) for _ in range(40)) + core]
    clean = lambda s: s.upper() if k <= 27 else s.upper().replace("N", "")
    bins = defaultdict(Counter)
    for ref, _, seq in records:
        for frag in cut(clean(seq), size, size - 3):
            bins[ref].update({frag[i : i + k] for i in range(len(frag) - k + 1)})
    expected = {}
    for qi, q in enumerate(map(clean, qs)):
        kmers = [q[i : i + k] for i in range(len(q) - k + 1)]
        for ref in bins:
            hits = [bins[ref][x] for x in kmers]
            unique = {x for x, h in zip(kmers, hits, strict=True) if h == 1}
            expected[qi, ref] = (sum(hits), len(unique), sum(hits) >= 3, sum(hits) / len(kmers) if kmers else 0.0)
    got = search.search(references(spark, records), queries(spark, qs), k, size, 3).collect()
    assert {(r.query_index, r.ref_id): (r["count"], r.unique_kmers, r["pass"], r.pct) for r in got} == expected
    assert len(got) == len(expected)


def test_wide(spark):
    results = spark.createDataFrame([(0, "a", 3, 1, True, 0.5), (0, "b.1", 0, 0, False, 0.0), (1, "a", 2, 2, False, 0.25), (1, "b.1", 9, 0, True, 1.5)], 'query_index long, ref_id string, count long, unique_kmers long, pass boolean, pct double')
    rows = search.wide(results, ["a", "b.1"]).orderBy("query_index").collect()
    assert tuple(rows[1]) == (1, 2, 2, 0, 0.25, 9, 0, 1, 1.5)


@pytest.mark.parametrize("k", [1, 4, 7])
def test_exact_location_over_record_seams(spark, k):
    rng = random.Random(k)
    records = [(f"r{i % 2}", i, "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 2, 3, 30])))) for i in range(40)]
    whole = {r: "".join(s for ref, _, s in records if ref == r).replace("N", "") for r in ("r0", "r1")}
    transcripts = [("t1", "T1", whole["r0"][3:25] + "N" + whole["r1"][:20]), ("t2", "T2", "ACG")]
    kmers = exact.transcript_kmers(spark.createDataFrame(transcripts, "transcript_name string, transcript_id string, seq string"), k)
    refs = references(spark, records)
    got = exact.detail(kmers, exact.locations(kmers, refs, k), refs).collect()
    for r in got:
        s = transcripts[0 if r.transcript_id == "T1" else 1][2].replace("N", "")
        assert r.transcript_kmer_count == sum(s[i : i + k] == r.kmer for i in range(len(s) - k + 1))
        places = [i + 1 for i in range(len(whole[r.ref_id]) - k + 1) if whole[r.ref_id][i : i + k] == r.kmer]
        assert r.reference_hit_count == len(places)
        assert r.reference_hits == (";".join(f"whole_reference:{p}" for p in places) or ".")
    summary = exact.summary(exact.detail(kmers, exact.locations(kmers, refs, k), refs)).collect()
    assert all(r.matched_kmer_windows <= r.total_kmer_windows and 0 <= r.matched_kmer_ratio <= 1 for r in summary)


def test_bloom_bits():
    assert S.bloom_bits(10, 5, 3, 0.01) == 1024 and S.bloom_bits(0, 5, 3, 0.01) == 1024
    assert S.bloom_bits(80_000, 15, 3, 0.01) == 988_961
