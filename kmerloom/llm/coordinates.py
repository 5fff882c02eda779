"""Repeated stretches of documents, confirmed at the coordinates of their source.

An occurrence (doc, at, n, source, from) says that n windows of `doc` from symbol `at` on are equal to those of document `source`
from symbol `from` on, as far as hashes tell. Occurrences that continue each other on one path are one span. A span's symbols are
compared with the source's own: both are cut at multiples of `grid` of the source's symbols, so many copies ask for few
cells, and each cell's digest (128 bits) is made from the symbols themselves on both sides.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import i64, release, spool

CELLS = "source long, origin long, size long, digest binary"


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _merged(window: int):
    """Sorted rows (doc, at, n, source, from, path) to spans (doc, at, size, source, origin); the last span of a batch waits for the next one."""

    def scan(batches):
        held = np.zeros((0, 6), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(6)], axis=1)])
            doc, at, n, source, origin, path = rows.T
            new = np.ones(len(rows), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (path[1:] != path[:-1]) | ((at - origin)[1:] != (at - origin)[:-1]) | (at[1:] > (at + n)[:-1])
            first = np.flatnonzero(new)
            stop = np.maximum.reduceat(at + n, first)
            # the open span as one row
            last = first[-1]
            held = np.array([[doc[last], at[last], stop[-1] - at[last], source[last], origin[last], path[last]]])
            if len(first) > 1:
                yield _span_rows(rows[first[:-1]], stop[:-1], window)
        if len(held):
            yield _span_rows(held, held[:, 1] + held[:, 2], window)

    return scan


def _span_rows(rows: np.ndarray, stop: np.ndarray, window: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([i64(x) for x in (rows[:, 0], rows[:, 1], stop - rows[:, 1] + window - 1, rows[:, 3], rows[:, 4])], ["doc", "at", "size", "source", "origin"])


def spans(occurrences: DataFrame, window: int, path: str | None = None) -> DataFrame:
    """(doc, at, size, source, origin): maximal stretches of symbols covered by occurrences that continue each other (on one `path`, if named).

    One pass over the occurrences in the order of their documents; it holds one batch.
    """
    count = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = occurrences.select("doc", "at", "n", "source", "from", (F.col(path) if path else F.lit(0)).cast("long").alias("path"))
    rows = rows.repartition(count, "doc").sortWithinPartitions("doc", "at", "source", "from")
    return rows.mapInArrow(_merged(window), "doc long, at long, size long, source long, origin long")


def confirmable(found: DataFrame, docs: DataFrame, cells_of, grid: int) -> DataFrame:
    """(doc, at, part, size, digest): the cells of spans, each with its place `part` in the document and the digest of the source's symbols.

    at is the span's, so that a span can be told by all its cells. cells_of(batches) digests rows (doc_id, text, cells), cells being an array of (origin,
    size). A cell that has no digest (its source isn't there) is left out; the span then lacks it and isn't confirmed.
    """
    found = spool(found, "found")
    last = F.floor((F.col("origin") + F.col("size") - 1) / grid)
    cut = found.select("*", F.explode(F.sequence(F.floor(F.col("origin") / grid), last)).alias("cell"))
    begin = F.greatest(F.col("origin"), F.col("cell") * grid)
    stop = F.least(F.col("origin") + F.col("size"), (F.col("cell") + 1) * grid)
    cut = cut.select("doc", "at", F.col("size").alias("whole"), "source", begin.alias("begin"), (stop - begin).alias("size"), (F.col("at") + begin - F.col("origin")).alias("part"))
    asked = cut.groupBy("source", F.col("begin").alias("origin"), "size").agg(F.lit(1).alias("one")).groupBy("source").agg(F.collect_list(F.struct("origin", "size")).alias("cells"))
    sources = docs.join(asked.withColumnRenamed("source", "doc_id").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "cells")
    known = spool(sources.mapInArrow(cells_of, CELLS).distinct(), "cells")
    cut = cut.withColumnRenamed("begin", "origin").join(known, ["source", "origin", "size"])
    out = spool(cut.select("doc", "at", "whole", "part", "size", "digest"), "confirmable")
    release(found, known)
    return out


def cell_rows(ids: np.ndarray, cells: pa.ListArray, bounds: np.ndarray, raw: bytes, place: np.ndarray) -> pa.RecordBatch:
    """Digests of the asked cells of a slice of documents; symbol i of the slice is raw[place[i]:place[i + 1]], bounds are each document's first symbols."""
    row = np.repeat(np.arange(len(ids)), cells.value_lengths().to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    origin, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    begin = bounds[row] + origin
    whole = begin + size <= bounds[row + 1]  # rows that share an id may have other texts
    row, origin, size, begin = row[whole], origin[whole], size[whole], begin[whole]
    marks = [digest(raw[a:b]) for a, b in zip(place[begin].tolist(), place[begin + size].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([i64(ids[row]), i64(origin), i64(size), pa.array(marks, pa.binary())], ["source", "origin", "size", "digest"])


def confirmed(found: list[dict] | None, lo: int, count: int, raw: bytes, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the spans of a document that hold: those without digests, and those whose every cell is equal to its source.

    found: (at, whole, part, size, digest); the document's symbols are those of cell_rows from `lo` on, `count` of them. Rows that share an id may have
    several sources: a cell holds if any of their digests is its own.
    """
    good: dict[tuple[int, int], dict[int, int]] = {}
    for x in found or []:
        at, whole, part, size, mark = x["at"], x["whole"], x["part"], x["size"], x["digest"]
        if at + whole <= count and (mark is None or mark == digest(raw[place[lo + part] : place[lo + part + size]])):
            good.setdefault((at, whole), {})[part] = size
    keys = [key for key, parts in good.items() if sum(parts.values()) == key[1]]
    return np.array([a for a, _ in keys], np.int64), np.array([n for _, n in keys], np.int64)
