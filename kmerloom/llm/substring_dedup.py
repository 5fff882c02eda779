"""Operator 2, substring dedup by De Bruijn compaction.

The words of a document are the symbols. A window of `window` words is an edge of the De Bruijn graph between the
(window - 1)-grams at its two ends, its nodes, so a document is a walk. Repeated edges are found and compacted:

1. A scan cuts each walk into runs of consecutive edges with one anchor (see anchors.py), each with the nodes at its ends. Equal edges
   lie in runs with the same anchor. Runs whose anchor lies in one document only hold no repeated edge and are left out by a join.
2. Equal runs are folded to one edge of the graph, which keeps its earliest place. Where an anchor has several variants the graph
   may branch inside the run: one representative of each is cut into its single edges, which are folded over all documents.
3. The degrees of a node are counted over the different edges that begin and end there. Edges that follow each other through nodes
   with one edge in and one out, from one document's earliest places, are joined to a nonbranching path.
4. What later documents walk of a path is one long span. Its words are compared with those at the source's coordinates
   (see coordinates.py), and the words of confirmed spans are removed.

A path never leaves the document that has its edges first, so its edges follow each other by their source coordinates: they are
joined with the branching nodes and cut there by one ordered pass, which takes the place of rounds of pointer doubling.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import repeated, runs_of, variants_of
from .common import POLY_A, POLY_B, U64, i64, merge_spans, mix, prepare, ranges, release, spool, text_slices, word_hashes, words
from .coordinates import cell_rows, confirmable, confirmed, spans

GRAM = 12
#: Words of a source that one digest covers at most.
GRID = 512
RUNS = "m long, h long, u long, v long, doc long, at long"


def _nodes(prefix: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes at the two ends of the runs of `size` edges from `first` on."""
    return tuple(POLY_A.spans(prefix, x, x + window - 1) for x in (first, first + size))


def _runs(window: int, k: int):
    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            start, stop, bounds = words(data, offsets)
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            symbols = word_hashes(data, start, stop)
            prefix = POLY_A.prefix(symbols)
            m, h, doc, first, size = runs_of(symbols, prefix, bounds, window, k, POLY_A)
            u, v = _nodes(prefix, first, size, window)
            yield pa.RecordBatch.from_arrays([i64(m), i64(h), i64(u), i64(v), i64(ids[doc]), i64((first - bounds[doc]) << 16 | size)], ["m", "h", "u", "v", "doc", "at"])

    return scan


def _edges(window: int):
    """Single edges of the runs in `ats`, one row per document: a hash of all their words, their nodes, document, place."""

    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            start, stop, bounds = words(data, offsets)
            symbols = word_hashes(data, start, stop)
            prefix, other = POLY_A.prefix(symbols), POLY_B.prefix(symbols)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ats = batch.column(2)
            flat = ats.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), ats.value_lengths().to_numpy(zero_copy_only=False))
            begin, size = bounds[doc] + (flat >> 16), flat & 0xFFFF
            whole = begin + size + window - 1 <= bounds[doc + 1]  # rows that share an id may have other texts
            begin, size, doc = begin[whole], size[whole], doc[whole]
            at = ranges(begin, size)
            doc = np.repeat(doc, size)
            e = mix(POLY_B.spans(other, at, at + window) ^ mix(POLY_A.spans(prefix, at, at + window)))
            u, v = _nodes(prefix, at, np.ones(len(at), np.int64), window)
            yield pa.RecordBatch.from_arrays([i64(e), i64(u), i64(v), i64(ids[doc]), i64(at - bounds[doc])], ["e", "u", "v", "doc", "at"])

    return scan


def compacted(edges: DataFrame) -> DataFrame:
    """Adds `path` to the different repeated edges (u, v, source, from, n): the place in `source` at which their nonbranching path begins.

    Edges follow each other if the one ends where the other begins, in their source and at a node that no other edge enters or leaves.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")).unionAll(edges.select("v", F.lit(1), F.lit(0)))
    degrees = ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"))
    forks = spool(degrees.where("into > 1 or out > 1").select(F.col("node").alias("u"), F.lit(True).alias("fork")), "forks")
    order = Window.partitionBy("source").orderBy("from", "n")
    follows = (F.lag(F.col("from") + F.col("n")).over(order) == F.col("from")) & F.col("fork").isNull()
    begins = F.when(~F.coalesce(follows, F.lit(False)), F.col("from"))
    out = spool(edges.join(forks, "u", "left").withColumn("path", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fork"), "paths")
    release(forks)
    return out


def _cells(batches):
    for batch, data, offsets in text_slices(batches):
        start, stop, bounds = words(data, offsets)
        raw, place = joined_words(data, start, stop)
        yield cell_rows(batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), bounds, raw, place)


def joined_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, a blank after each, and where each begins (one more entry than words)."""
    length = stop - start + 1
    place = np.r_[0, np.cumsum(length)]
    out = np.append(data, np.uint8(32))[ranges(start, length)]
    out[place[1:] - 1] = 32
    return out.tobytes(), place


def repeated_spans(docs: DataFrame, window: int = 50, k: int = GRAM) -> DataFrame:
    """Cells (doc, at, whole, part, size, digest) of the spans of `docs` (doc_id, text) whose windows also start in a document with a smaller doc_id.

    at and whole are a span's first word and its words, part and size the cell's, digest that of the source's words: see
    coordinates.py. Null texts and documents of fewer than `window` words have none; rows without doc_id take no part; rows that share a
    doc_id count as one document, so they don't repeat each other. Of several equal windows the smallest doc_id's is kept, in that document at every place.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    prepare(docs.sparkSession)
    runs = spool(docs.mapInArrow(_runs(window, min(k, window)), RUNS), "runs")
    again = repeated(runs, across_documents=True)
    release(runs)
    known = variants_of(again, F.first("u").alias("u"), F.first("v").alias("v"))
    # single edges of one representative of each variant
    heads = again.select("m", "h", "doc", "at").join(known.where("variants > 1").select("m", "h", "first"), ["m", "h"]).where("doc = first.doc").groupBy("doc").agg(F.collect_set("at").alias("ats"))
    cut = docs.join(heads.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "ats").mapInArrow(_edges(window), "e long, u long, v long, doc long, at long")
    cut = spool(cut, "edges")
    single = spool(cut.groupBy("e").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("last"), F.first("u").alias("u"), F.first("v").alias("v")).where("first.doc < last").drop("last"), "single")
    # the graph of repeated edges: folded runs, and single edges where runs vary
    place = lambda x: (F.col("first.doc").alias("source"), F.shiftright("first.at", 16).alias("from") if x else F.col("first.at").alias("from"))
    folded = known.where("first.doc < last").select("m", "h", "u", "v", *place(True), F.col("first.at").bitwiseAND(0xFFFF).alias("n"))
    loose = single.select(F.lit(None).cast("long").alias("m"), F.col("e").alias("h"), "u", "v", *place(False), F.lit(1).cast("long").alias("n"))
    paths = compacted(folded.unionByName(loose))
    walked = again.select("m", "h", "doc", "at").join(paths.where("m is not null").select("m", "h", "source", "from", "path"), ["m", "h"])
    walked = walked.select("doc", F.shiftright("at", 16).alias("at"), F.col("at").bitwiseAND(0xFFFF).alias("n"), "source", "from", "path")
    stepped = cut.select("e", "doc", "at").join(paths.where("m is null").select(F.col("h").alias("e"), "source", "from", "path"), "e")
    stepped = stepped.select("doc", "at", F.lit(1).cast("long").alias("n"), "source", "from", "path")
    out = confirmable(spans(walked.unionByName(stepped).where("doc > source"), window, "path"), docs, _cells, GRID)
    release(again, known, cut, single, paths)
    return out


def _keep():
    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            start, stop, bounds = words(data, offsets)
            raw, place = joined_words(data, start, stop)
            counts, removed, shas, texts = [], [], [], []
            for found, lo, hi in zip(batch.column(2).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at, size = confirmed(found, lo, hi - lo, raw, place)
                a, b = merge_spans(at, at + size, hi - lo)
                edges = place[lo + np.r_[0, np.stack([a, b], axis=1).ravel(), hi - lo]].tolist()
                text = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])[:-1]
                counts.append(hi - lo)
                removed.append(int((b - a).sum()))
                shas.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return scan


def substring_dedup(docs: DataFrame, window: int = 50, k: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): every document without the words of windows that a smaller doc_id has too.

    Kept words are joined by one blank. Null and empty texts have no words. A row without doc_id loses nothing; rows that share a doc_id are one
    document, so equal windows in them stay. A text of any length is one row and is treated whole in one task. Other columns are ignored; an empty table gives an empty result.
    """
    cells = repeated_spans(docs, window, k)
    cells = cells.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("at", "whole", "part", "size", "digest")).alias("cells"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(cells.hint("shuffle_hash"), "doc_id", "left")
    return rows.select("doc_id", "text", "cells").mapInArrow(_keep(), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
