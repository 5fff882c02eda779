"""Language identification, top-k search, the pipeline and the registry."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kmerloom.llm import language_id, mixing, queries, topk

from test_text_operators import linked

SYLLABLES = {"en": ["the", "ing", "ou", "th", "er"], "de": ["sch", "ung", "ei", "der", "ü"], "fr": ["eau", "que", "é", "ou", "les"], "es": ["ción", "os", "ñ", "que", "el"], "xx": ["zzk", "qwx", "vv"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(5, 60)), lang) for i in range(500) for lang in [rng.choice(list(SYLLABLES))]]
    truth = {i: lang for i, _, lang in rows}
    blank = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "en"), (1003, text(rng, "de", 9000), None)]
    df = spark.createDataFrame(rows + blank, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert got[1000].score == 0
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    # labels of held-out rows and any but doc_id, text and lang change nothing
    other = df.selectExpr("doc_id", "text", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 'yy', lang) AS lang", "'s' AS source")
    assert {r.doc_id: tuple(r) for r in language_id.identify(other).collect()} == {i: tuple(r) for i, r in got.items()}


def test_language_odd(odd, empty, spark):
    assert language_id.identify(odd).count() == 7
    assert language_id.identify(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id.identify(unlabelled).collect()] == [("und", 0.0)]


def best(rows, every, k, scale=256):
    out = {}
    vectors = {i: [int(np.floor(scale * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)}
    for q, a in vectors.items():
        if q % every == 0:
            score = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors.items() if i != q and len(a) == len(b))
            out |= {(q, rank + 1): (i, -s) for rank, (s, i) in enumerate(score[:k])}
    return out


@pytest.mark.parametrize(("n", "chunk", "block"), [(400, 32, 3), (400, 2048, 1024), (4, 2, 2)])
def test_top_products(spark, monkeypatch, n, chunk, block):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SEEDS", 40)
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 5])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[1][1]) for i in range(30)] + [(10_000, [0.0] * 8), (10_001, None), (10_002, [None] + [1.0] * 7), (10_003, [float("nan")] * 8), (10_004, [float("inf")] * 8), (10_010, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_products(df, 10, 5).collect()}
    assert got == best(rows, 10, 5)


def test_top_products_odd(spark):
    schema = "vec_id long, embedding array<float>, norm string, score string"
    assert topk.top_products(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [1.0], "a", "b"), (0, [2.0], "a", "b"), (0, [2.0], "a", "b"), (1, [3.0], "a", "b"), (2, [1e12], "a", "b"), (3, [-3e38], "a", "b"), (50, [], "a", "b")]
    got = [tuple(r) for r in topk.top_products(spark.createDataFrame(rows, schema), 50, 5).orderBy("query_id", "rank").collect()]
    big = int(256 * float(np.float32(1e12)))
    assert got == [(0, 1, 2, 512 * big), (0, 2, 1, 512 * 768), (0, 3, 3, -(1 << 63))]


def without_repeats(texts, n):
    """Texts without the bytes of strings of n bytes that start earlier, and without what is left of split characters."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        raw = (texts[doc_id] or "").encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            else:
                seen.add(raw[i : i + n])
        pieces, lo = [], 0
        for i in range(len(raw) + 1):
            if i == len(raw) or gone[i]:
                pieces.append(raw[lo:i].decode("utf-8", "ignore"))
                lo = i + 1
        out[doc_id] = "".join(pieces)
    return out


def test_split_characters_go_and_others_stay(spark):
    """A text's own replacement character stays where a cut splits another character; bytes of two cuts aren't joined to one."""
    from kmerloom.llm import suffix_array

    passage = "\u00e9" * 60  # 120 bytes of two-byte characters
    rows = [(1, "\ufffd" + passage + " one"), (2, "\ufffd x" + "\u00c3" + passage + "\u00a9 two")]
    got = {r.doc_id: r.kept_text for r in suffix_array.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 101, text=True).collect()}
    assert got == without_repeats(dict(rows), 101)
    assert got[2].startswith("\ufffd x")


def test_pipeline(spark, texts, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    before = {r[0]: r[1] for r in texts}
    kept, now = {r[0] for r in texts}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        ids = {r.doc_id for r in now.collect()}
        assert ids <= kept
        if i < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS)
        if name == "language_id":
            assert kept - ids == {r[0] for r in texts if not any(c.isalpha() for c in r[1] or "")}
        rows = {r.doc_id: r.text for r in now.collect()} if i < 4 else {}
        if name == "near_dedup":
            assert ids == {d for d, (_, _, first) in linked(sorted(before.items()), 5, 80).items() if first}
            assert all(rows[d] == before[d] for d in ids)
        if name == "suffix_dedup":
            assert rows == without_repeats(before, 100)
            assert all(r.n_chars == len(r.text) for r in now.collect())
        kept, before = ids, rows
    direct = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert direct == sorted(map(tuple, now.collect()))


def test_pipeline_keeps_odd_rows(spark, odd, tmp_path):
    """Rows without doc_id, or with a repeated one, pass every stage; the mix takes each by its own number of copies."""
    import corpus_pipeline

    now, ids = odd, {None, 1, 2}
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(map(tuple, now.select(*corpus_pipeline.COLUMNS).collect()))
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        rows = now.collect()
        if name == "mixing":
            assert set(map(tuple, rows)) <= set(before)
        assert {r.doc_id for r in rows} <= ids
        assert any(r.doc_id is None for r in rows)


def test_mixing_stage_takes_what_the_mix_says(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(rng.choice([None, i, i // 4]), text(rng, "en", rng.randint(0, 30)), "en", rng.choice([None, "a", "b"]), 1) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    words = {r: len(r[1].split()) for r in rows}
    got = Counter(map(tuple, corpus_pipeline.mixed(spark, df, "").collect()))
    expected = Counter()
    for r in mixing.mix_sources(df).collect():
        expected[r.doc_id, r.size, r.source_size] += r.copies
    size = Counter()
    for r in rows + rows[:20]:
        size[r[3]] += words[r]
    found = Counter()
    for r, n in got.items():
        found[r[0], words[r], size[r[3]]] += n
    assert found == +expected
    assert got == Counter(map(tuple, corpus_pipeline.mixed(spark, df.repartition(5), "").collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(tuple, df.select(*[f"`{c}`" for c in found.columns]).collect())) == sorted(found.fetchall())


def test_many_languages_are_all_learned(spark):
    """More languages than families: those without a named one share families, and each can be predicted."""
    rng = random.Random(3)
    langs = [f"q{i}" for i in range(45)] + ["en", "de"]
    rows = []
    for n, lang in enumerate(langs):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        rows += [(100 * n + i, " ".join(rng.choice(syllables) for _ in range(40)), lang) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(model.names) <= language_id.MOST_FAMILIES and sorted(x for own in model.langs for x in own) == sorted(langs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert np.mean([got[d] == lang for d, _, lang in rows]) > 0.95
    few = language_id.fit(df, most_rows=100)
    assert sorted(x for own in few.langs for x in own) == sorted(langs)


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
