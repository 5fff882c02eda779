"""Operator 9, suffix-array dedup by two-stage sorting.

The suffixes of a text that are smaller than their successors are sorted directly; scans over the first symbols' buckets
induce the order of all others; common prefixes of adjacent suffixes then show every repeated string.

One suffix array of a whole corpus doesn't fit one machine, so the corpus is cut so that equal strings meet:

1. A scan cuts each text into runs of windows (strings of `length` bytes) with one anchor (see anchors.py); runs whose
   anchor occurs once in the corpus hold no repeated string and are left out by a join.
2. Equal runs are folded to the earliest; each string of a later one is repeated. The aggregation is combined before its
   shuffle, so that thousands of copies cost one segment.
3. The segments (run with the bytes that its windows span) of each anchor with several variants go to one group. Groups are
   concatenated to texts of bounded size, and each such text gets its suffix array. Anchors with so many variants that a text can't hold
   them are cut by window, and equal windows folded like runs before any byte travels: however many contexts a
   passage has, its windows come to a suffix array once, and those of one context alone don't come at all.
4. Suffixes whose adjacent common prefixes reach `length` are equal strings; all but the earliest are removed.
5. What folding alone found equal (whole runs, windows of hot anchors) is compared, by digests of its bytes, with its source at the source's
   coordinates (see coordinates.py) before it is removed.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import RUNS, repeated, runs_of, variants_of
from .common import _BYTE_SEEDS, POLY_A, POLY_B, U64, i64, merge_spans, mix, prepare, ranges, release, spool, text_slices
from .coordinates import cell_rows, confirmable, confirmed, spans

GRAM = 32
#: Symbols of one suffix array, and folded windows of one anchor in a group.
TEXT_SYMBOLS, GROUP_WINDOWS = 1 << 19, 4096
#: Symbols (257 values, so 9 bits) in one comparison key.
STEP = 7
#: Bytes of a source that one digest covers at most.
GRID = 4096


def _keys(text: np.ndarray) -> np.ndarray:
    """For each place, its next STEP symbols as one integer (zeros beyond the end)."""
    padded = np.zeros(len(text) + STEP, U64)
    padded[: len(text)] = text
    out = np.zeros(len(text), U64)
    for j in range(STEP):
        out = out << U64(9) | padded[j : j + len(text)]
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a symbol later; the last, followed by nothing, isn't."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    place = np.arange(n)
    turn = np.where(np.r_[text[:-1] != text[1:], True], place, n)  # the last symbol of each run of equal symbols
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    after = np.r_[text, np.uint16(0)]
    return after[turn] < after[turn + 1]


def _sort_directly(keys: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `which`, sorted by their first `depth` symbols; only ties go on to the next STEP symbols."""
    n = len(keys)
    order = which[np.argsort(keys[which], kind="stable")]
    key = keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = key[1:] == key[:-1]
    for at in range(STEP, depth, STEP):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(~same)[rows]
        place = order[rows] + at
        key = np.where(place < n, keys[np.minimum(place, n - 1)], U64(0))
        by = np.lexsort((key, group))
        order[rows], key = order[rows][by], key[by]
        alike = np.zeros(len(rows), bool)
        alike[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        same[rows] = alike
    return order


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of `text` (symbols 0 to 256; 0 ends a segment) in the order of the first `depth` symbols.

    Ties at that depth stay adjacent. Empty text: empty array.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    ends = text == 0
    direct = small & ~ends
    order = _sort_directly(_keys(text), np.flatnonzero(direct), depth)
    top = 257
    bucket = np.searchsorted(text[order], np.arange(top + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(top)]
    out: list[np.ndarray] = []
    by_induction = ~small & ~ends

    def induce(found: np.ndarray, symbol: int) -> np.ndarray:
        """Passes on the suffixes one symbol longer; returns those that belong to the bucket being scanned."""
        before = found[found > 0] - 1
        before = before[by_induction[before]]
        head = text[before]
        by = np.argsort(head, kind="stable")
        before, head = before[by], head[by]
        values, begin = np.unique(head, return_index=True)
        same = before[:0]
        for value, part in zip(values.tolist(), np.split(before, begin[1:]), strict=True) if len(values) else ():
            if value == symbol:
                same = part
            else:
                induced[value].append(part)
        return same

    for symbol in range(top):
        if not symbol:
            part = np.flatnonzero(ends)
            out.append(part)
            induce(part, 0)
            if not ends[-1]:  # the last suffix follows on the empty one
                induced[int(text[-1])].insert(0, np.array([n - 1]))
            continue
        while induced[symbol]:
            parts, induced[symbol] = induced[symbol], []
            part = np.concatenate(parts)
            while len(part):
                out.append(part)
                part = induce(part, symbol)
        part = order[bucket[symbol] : bucket[symbol + 1]]
        if len(part):
            out.append(part)
            induce(part, symbol)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """Length, `limit` at most, of the prefix that each suffix has in common with the one before it in the array (0 for the first)."""
    n = len(text)
    out = np.zeros(len(suffixes), np.int64)
    padded = np.r_[text.astype(np.int32), np.arange(-1, -1 - limit - STEP, -1, dtype=np.int32)]
    keys = _keys(text)
    live = np.arange(1, len(suffixes))
    while len(live):
        x, y = suffixes[live] + out[live], suffixes[live - 1] + out[live]
        inside = (x < n) & (y < n) & (out[live] + STEP <= limit)
        equal = inside.copy()
        equal[inside] = keys[x[inside]] == keys[y[inside]]
        equal &= (x + STEP <= n) & (y + STEP <= n)
        out[live[equal]] += STEP
        rest = live[~equal]
        for _ in range(STEP):
            rest = rest[out[rest] < limit]
            x, y = suffixes[rest] + out[rest], suffixes[rest - 1] + out[rest]
            more = (x < n) & (y < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
            rest = rest[more]
            out[rest] += 1
        live = live[equal]
    return out


def repeated_places(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Index of the class of equal strings for each place of the segments (data, bounds) at which `length` bytes of one segment begin; -1 elsewhere."""
    sizes = np.diff(bounds)
    text = np.zeros(len(data) + len(sizes), np.uint16)
    at = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = data.astype(np.uint16) + 1
    left = np.repeat(bounds[1:], sizes) - np.arange(len(data))
    source = np.full(len(text), -1)
    source[at] = np.where(left >= length, np.arange(len(data)), -1)
    array = two_stage(text, length)
    array = array[source[array] >= 0]
    out = np.full(len(data), -1)
    out[source[array]] = np.cumsum(common_prefixes(text, array, length) < length)
    return out


def _runs(length: int, k: int):
    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m, h, doc, first, size = runs_of(_BYTE_SEEDS[data], POLY_A.prefix(data), offsets, length, k, POLY_A)
            yield pa.RecordBatch.from_arrays([i64(m), i64(h), i64(ids[doc]), i64((first - offsets[doc]) << 16 | size)], ["m", "h", "doc", "at"])

    return scan


def _asked(batch: pa.RecordBatch, offsets: np.ndarray, length: int, fields: int):
    """Ids of a slice's documents; then row, fields and first byte of each run asked for, as far as it lies inside its row's text."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    heads = batch.column(2)
    row = np.repeat(np.arange(len(ids)), heads.value_lengths().to_numpy(zero_copy_only=False))
    columns = [heads.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(fields)]
    at = columns[1]
    begin = offsets[row] + (at >> 16)
    whole = begin + (at & 0xFFFF) + length - 1 <= offsets[row + 1]  # rows that share an id may have other texts
    return ids, row[whole], [x[whole] for x in columns], begin[whole]


def _windows(length: int):
    """Each window of the runs in `heads` (anchor, at): anchor, a hash of its bytes, document, start."""

    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            ids, row, (m, at), begin = _asked(batch, offsets, length, 2)
            size = at & 0xFFFF
            one, two = POLY_A.prefix(data), POLY_B.prefix(data)
            places, owner = ranges(begin, size), np.repeat(np.arange(len(m)), size)
            w = mix(POLY_B.spans(two, places, places + length) ^ mix(POLY_A.spans(one, places, places + length)))
            yield pa.RecordBatch.from_arrays([i64(m[owner]), i64(w), i64(ids[row[owner]]), i64(places - offsets[row[owner]])], ["m", "w", "doc", "start"])

    return scan


def _segments(length: int):
    """The bytes of each run in `heads` (anchor, at, salt); runs of one anchor and salt that touch are one."""

    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            ids, row, (m, at, salt), begin = _asked(batch, offsets, length, 3)
            by = np.lexsort((begin, salt, m, row))
            row, m, at, salt, begin = (x[by] for x in (row, m, at, salt, begin))
            stop = begin + (at & 0xFFFF)
            new = np.ones(len(m), bool)
            new[1:] = (row[1:] != row[:-1]) | (m[1:] != m[:-1]) | (salt[1:] != salt[:-1]) | (begin[1:] != stop[:-1])
            first = np.flatnonzero(new)
            stop = (np.maximum.reduceat(stop, first) if len(first) else stop) + length - 1
            row, m, at, salt, begin = (x[first] for x in (row, m, at, salt, begin))
            raw = data.tobytes()
            for lo in range(0, len(m), 20_000):
                hi = lo + 20_000
                parts = [raw[x:y] for x, y in zip(begin[lo:hi].tolist(), stop[lo:hi].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([i64(m[lo:hi]), i64(salt[lo:hi]), i64(ids[row[lo:hi]]), i64(at[lo:hi] >> 16), pa.array(parts, pa.binary())], ["m", "salt", "doc", "start", "segment"])

    return scan


def _sorted_groups(length: int):
    """Suffix arrays over whole groups of (m, salt), as many as fit a text; rows come sorted by group."""

    def found(tables):
        whole = pa.Table.from_batches(tables)
        segments = whole.column("segment").combine_chunks()
        segments = segments.chunk(0) if isinstance(segments, pa.ChunkedArray) else segments
        sizes = np.asarray([len(x) for x in segments.to_pylist()], np.int64)
        bounds = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(segments.to_pylist()), np.uint8)
        classes = repeated_places(data, bounds, length)
        doc, start = (np.asarray(whole.column(x).to_numpy()) for x in ("doc", "start"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        places = np.flatnonzero(classes >= 0)
        doc, start, kind = doc[owner[places]], start[owner[places]] + places - bounds[owner[places]], classes[places]
        by = np.lexsort((start, doc, kind))
        doc, start, kind = doc[by], start[by], kind[by]
        later = np.zeros(len(kind), bool)
        later[1:] = (kind[1:] == kind[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
        # a place may come once a class; equal places beside each other are one
        first = np.maximum.accumulate(np.where(np.r_[True, kind[1:] != kind[:-1]], np.arange(len(kind)), 0)) if len(kind) else later
        later &= (doc != doc[first]) | (start != start[first])
        doc, start = doc[later], start[later]
        by = np.lexsort((start, doc))
        doc, start = doc[by], start[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
        edge = np.flatnonzero(new)
        size = start[np.r_[edge[1:], len(doc)] - 1] - start[edge] + length if len(doc) else start
        return pa.RecordBatch.from_arrays([i64(doc[edge]), i64(start[edge]), i64(size)], ["doc", "at", "size"])

    def scan(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            new = np.flatnonzero(np.r_[last != (key[0, 0], key[1, 0]), (key[:, 1:] != key[:, :-1]).any(axis=0)])
            cuts = [0, *new.tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if lo in new and size >= TEXT_SYMBOLS:
                        yield found(held)
                        held, size = [], 0
                    part = batch.slice(lo, hi - lo)
                    held.append(part)
                    size += part.column(4).nbytes
            last = (key[0, -1], key[1, -1])
        if held:
            yield found(held)

    return scan


def _cells(batches):
    for batch, data, offsets in text_slices(batches):
        yield cell_rows(batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), offsets, data.tobytes(), np.arange(len(data) + 1))


def repeated_spans(docs: DataFrame, length: int = 100, k: int = GRAM, hot: int | None = None) -> DataFrame:
    """(doc, at, whole, part, size, digest): stretches of bytes of `docs` (doc_id, text) covered by strings of `length` bytes that also start earlier.

    at and whole are a stretch's first byte and its bytes. Those that a suffix array found have no digest; others come as cells (part, size) with the digest
    of the source's bytes. Earlier: in a smaller doc_id, or before in the same document; of strings that are equal the earliest is kept. Null texts and those
    shorter than `length` have none; rows without doc_id take no part; rows that share a doc_id count as one document's text laid on top of each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    # a run spans less than twice the length: an anchor with more variants than this may not fit a text
    hot = TEXT_SYMBOLS // (2 * length) if hot is None else hot
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = spool(docs.mapInArrow(_runs(length, min(k, length)), RUNS), "runs")
    again = repeated(runs, across_documents=False)
    release(runs)
    known = variants_of(again)
    place = [F.col("first.doc").alias("source"), F.shiftright("first.at", 16).alias("from")]
    copies = again.join(known.select("m", "h", "first"), ["m", "h"]).where("doc != first.doc or at != first.at")
    copies = copies.select("doc", F.shiftright("at", 16).alias("at"), F.col("at").bitwiseAND(0xFFFF).alias("n"), *place)
    heads = known.where("variants > 1").select(F.col("first.doc").alias("doc"), "m", F.col("first.at").alias("at"), "variants")

    def of_documents(asked: DataFrame, *fields) -> DataFrame:
        """docs (doc_id, text) with `heads`, the runs asked for."""
        return docs.join(asked.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct(*fields)).alias("heads")).hint("shuffle_hash"), "doc_id").select("doc_id", "text", "heads")

    windows = of_documents(heads.where(F.col("variants") > hot), "m", "at").mapInArrow(_windows(length), "m long, w long, doc long, start long")
    windows = spool(windows, "windows")
    firsts = windows.groupBy("m", "w").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = spool(firsts.select("m", "w", F.col("first.doc").alias("source"), F.col("first.start").alias("from")), "firsts")
    again_here = windows.join(firsts, ["m", "w"]).where("doc != source or start != from")
    again_here = again_here.select("doc", F.col("start").alias("at"), F.lit(1).cast("long").alias("n"), "source", "from")
    # one window of each content that comes again; no two of them are equal, so any deal into groups will do
    groups = firsts.groupBy("m").agg(F.ceil(F.count("*") / GROUP_WINDOWS).alias("groups"))
    salt = F.pmod(F.xxhash64("source"), F.col("groups")) + 1
    salted = firsts.join(groups, "m").select(F.col("source").alias("doc"), "m", F.shiftleft("from", 16).bitwiseOR(F.lit(1)).alias("at"), salt.alias("salt"))
    plain = heads.where(F.col("variants") <= hot).select("doc", "m", "at", F.lit(0).cast("long").alias("salt"))
    segments = of_documents(plain.unionByName(salted), "m", "at", "salt").mapInArrow(_segments(length), "m long, salt long, doc long, start long, segment binary")
    later = segments.repartition(parts, "m", "salt").sortWithinPartitions("m", "salt").mapInArrow(_sorted_groups(length), "doc long, at long, size long")
    later = later.select("doc", "at", F.col("size").alias("whole"), F.col("at").alias("part"), "size", F.lit(None).cast("binary").alias("digest"))
    cells = confirmable(spans(copies.unionByName(again_here), length), docs, _cells, GRID)
    out = spool(cells.unionByName(later), "spans")
    release(again, known, windows, firsts, cells)
    return out


def _keep(text: bool):
    """Rows (doc_id, text, cells, others): the digest columns, the kept bytes or text, and the others as they are."""

    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            raw, place = data.tobytes(), range(len(data) + 1)
            sizes, removed, spans, shas, kept = [], [], [], [], []
            for found, lo, hi in zip(batch.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                at, size = confirmed(found, lo, hi - lo, raw, place)
                a, b = merge_spans(at, at + size, hi - lo)
                edges = [lo, *(lo + np.stack([a, b], axis=1).ravel()).tolist(), hi]
                parts = [raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                whole = b"".join(parts)
                sizes.append(hi - lo)
                removed.append(hi - lo - len(whole))
                spans.append(len(a))
                shas.append(hashlib.sha256(whole).hexdigest())
                kept.append("".join([x.decode("utf-8", "ignore") for x in parts]) if text else whole)
            new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string() if text else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, *batch.columns[3:]], ["doc_id", *KEPT, "kept_text" if text else "kept_bytes", *batch.schema.names[3:]])

    return scan


KEPT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_array_dedup(docs: DataFrame, length: int = 100, k: int = GRAM, carry: tuple[str, ...] = (), hot: int | None = None, text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, carry): every document without the bytes of strings that start earlier too.

    Kept bytes may begin or end inside a character; with `text` they come as kept_text, without what is left of split characters. Null and empty texts are empty. A row without doc_id loses nothing; of rows that share a
    doc_id, each loses what any of them repeats, as far as it lies in its own text and, where folding found it, has the same bytes there. A text of any length is one row and is treated whole in one task. Columns that `carry`
    doesn't name are ignored; those it names may be called anything but doc_id, text or a result column. An empty table gives an empty result.
    """
    cells = repeated_spans(docs, length, k, hot)
    cells = cells.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("at", "whole", "part", "size", "digest")).alias("cells"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).join(cells.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "cells", *carry)
    new = T.StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, {'kept_text string' if text else 'kept_bytes binary'}")
    return rows.mapInArrow(_keep(text), T.StructType([rows.schema.fields[0], *new.fields, *rows.schema.fields[3:]]))
