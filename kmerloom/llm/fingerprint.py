"""Operator 8, document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: it is cut at every line end and, within lines, at the blank after a sentence's mark. The line end or
blank isn't part of the paragraph before it, so the last paragraph is equal to the same one elsewhere; these terminators are
items of their own, and nothing is left out. Each item is hashed to a wide vector and a text's fingerprint is the sum of its items'
vectors, lane by lane modulo a power of two. So the order of paragraphs doesn't matter, equal multisets have equal
fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts: DENSE lanes of 64 random bits (sums modulo 2**64), which tell different multisets apart, and SIGNS
lanes of +1 or -1 (sums modulo 2**16), whose differences estimate how many paragraphs two texts don't share: the mean square of
the difference is the size of the multisets' difference, weighted by the square of how often each occurs. Terminators
count in the dense lanes alone: there are as many as paragraphs and all are alike.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POLY_A, POLY_B, SLICE_BYTES, U64, mix, prepare
from .ranges import bounds, part_of

DENSE, SIGNS = 8, 128
BYTES = DENSE * 8 + SIGNS * 2
_LANES = mix(np.arange(1, DENSE + SIGNS // 64 + 1, dtype=U64) * U64(0xA0761D6478BD642F))
_LINE, _BLANK, _MARKS = 10, 32, np.isin(np.arange(256), [33, 46, 63])


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop byte of each paragraph, and whether a line end (1), a blank (2) or the text's end (0) follows it; paragraphs may be empty."""
    n = len(data)
    ends = data == _LINE
    ends[1:] |= (data[1:] == _BLANK) & _MARKS[data[:-1]]
    ends[offsets[:-1][np.diff(offsets) > 0]] = data[offsets[:-1][np.diff(offsets) > 0]] == _LINE  # a mark of the text before ends nothing here
    after = np.flatnonzero(ends)
    first = np.zeros(n + 1, bool)
    first[after + 1] = True
    first[offsets] = True
    start = np.flatnonzero(first[:n])
    stop = np.r_[start[1:], n] if len(start) else start
    closed = ends[stop - 1] if len(start) else np.zeros(0, bool)
    kind = np.where(closed, np.where(data[stop - 1] == _LINE, 1, 2), 0) if len(start) else start
    return start, stop - closed, kind


def vectors(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Vectors of the paragraphs data[start:stop]: DENSE lanes of 64 bits, then the bits of the signs."""
    size = (stop - start).astype(U64)
    a = mix(POLY_A.spans(POLY_A.prefix(data), start, stop) + size)
    b = mix(POLY_B.spans(POLY_B.prefix(data), start, stop) ^ size)
    return mix((a[:, None] + _LANES) ^ mix(b[:, None] * _LANES))


def _signs(lanes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(lanes[:, DENSE:]).view(np.uint8), axis=1)
    return bits.astype(np.int16) * 2 - 1


#: What a line end and a blank after a mark add to the dense lanes.
_TERMINATORS = np.concatenate([np.zeros((1, DENSE), U64), mix(_LANES[None, :DENSE] ^ mix(np.array([[1], [2]], U64) * U64(0xE7037ED1A0B428DB)))])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of BYTES bytes for each text; an empty text has no paragraph, so zeros."""
    out = np.zeros((len(texts), BYTES), np.uint8)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    if not len(data):
        return out
    start, stop, kind = paragraphs(data, offsets)
    full = stop > start
    lanes = vectors(data, start, stop)
    signs = _signs(lanes) * full[:, None].astype(np.int16)
    dense = np.where(full[:, None], lanes[:, :DENSE], U64(0)) + _TERMINATORS[kind]
    edges = np.searchsorted(start, offsets)
    rows = np.flatnonzero(np.diff(edges))
    out[rows, : DENSE * 8] = np.add.reduceat(dense, edges[rows], axis=0).astype("<u8").view(np.uint8)
    out[rows, DENSE * 8 :] = np.add.reduceat(signs, edges[rows], axis=0, dtype=np.int16).astype("<i2").view(np.uint8)
    return out


def _parts(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = np.ascontiguousarray(prints)
    return np.ascontiguousarray(prints[:, : DENSE * 8]).view("<u8"), np.ascontiguousarray(prints[:, DENSE * 8 :]).view("<i2")


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of the multisets a + b, or a - b with sign -1."""
    (da, sa), (db, sb) = _parts(a), _parts(b)
    dense, signs = (da + db, sa + sb) if sign > 0 else (da - db, sa - sb)
    return np.concatenate([dense.astype("<u8").view(np.uint8), signs.astype("<i2").view(np.uint8)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each pair of rows: 1 less the estimated size of the difference over the size of both; 1 for equal fingerprints only."""
    sa, sb = (_parts(x)[1].astype(np.float64) for x in (a, b))
    apart = np.square((sa - sb + 32768) % 65536 - 32768).sum(axis=1)
    both = np.square(sa).sum(axis=1) + np.square(sb).sum(axis=1)
    same = (np.ascontiguousarray(a) == np.ascontiguousarray(b)).all(axis=1)
    return np.where(same, 1.0, np.clip(1 - apart / np.maximum(both, 1), 0, 1 - 1e-9))


def _slices(column: list, most: int = SLICE_BYTES):
    """(first, last + 1) of stretches of about `most` characters, a row at least."""
    lo, held = 0, 0
    for i, text in enumerate(column):
        held += len(text or "")
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(column):
        yield lo, len(column)


def _compare():
    """Rows (part, carry, doc_id, text) by part and ascending id; each but the carried ones is compared with the row before, which comes next in descending order."""

    def scan(batches):
        part, last, last_print = None, "", None
        for batch in batches:
            parts, carry, ids = (batch.column(i).to_pylist() for i in range(3))
            column = batch.column(3).to_pylist()
            for lo, hi in _slices(column):
                texts = [x or "" for x in column[lo:hi]]
                prints = fingerprints([t.encode() for t in texts])
                if last_print is None:
                    last_print = prints[:1] * 0
                before = np.concatenate([last_print, prints[:-1]])
                edited = []
                for i, text in enumerate(texts):
                    other = texts[i - 1] if i else last
                    if parts[lo + i] != part:  # only a carried row begins a part, and it isn't returned
                        part = parts[lo + i]
                    cut = len(text) // 3
                    edited.append((text[: len(text) - cut] + other[:cut]).encode())
                last, last_print = texts[-1], prints[-1:]
                other = fingerprints(edited)
                keep = [i for i in range(hi - lo) if not carry[lo + i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[lo + i] for i in keep], pa.int64()),
                        pa.array([len(texts[i]) for i in keep], pa.int64()),
                        pa.array([hashlib.sha256(edited[i]).hexdigest() for i in keep], pa.string()),
                        pa.array([prints[i].tobytes().hex() for i in keep], pa.string()),
                        pa.array([other[i].tobytes().hex() for i in keep], pa.string()),
                        pa.array(likeness(prints, other)[keep]),
                        pa.array(likeness(prints, before)[keep]),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return scan


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of docs (doc_id, text), fingerprint as lowercase hex. Null text: empty. Other columns are ignored."""
    prepare(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            prints = fingerprints([(x or "").encode() for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes().hex() for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fingerprint string")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document, in descending order of doc_id (after the last: the first).

    The edited text is the text with its last n_chars // 3 code points replaced by as many first ones, or all, of the next
    document. Null text: empty. Rows of one doc_id are ordered by their text; null doc_ids come after all others
    in that order. A single document is its own next. An empty table gives an empty result.

    Documents are dealt to ranges of ids; each range but the lowest gets the last row of the ranges below it as a carried row, the lowest
    the highest row of all, so only the bounds of ranges and one row a range travel twice.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = bounds(docs.select("doc_id"), "doc_id", parts)
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part_of("doc_id", cuts)).cast("int"))
    # the highest row of each range; a row a range at most
    tops = [(r.part, r.top) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()]
    if not tops:
        return rows.withColumn("carry", F.lit(False)).select("part", "carry", "doc_id", "text").mapInArrow(_compare(), OUT)
    order = [p for p, _ in tops]
    above = {p: q for p, q in zip(order, order[1:] + order[:1], strict=True)}
    goes = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    highest = F.max_by(F.struct("text"), F.struct(F.col("text").isNotNull(), F.col("text")))
    is_top = F.coalesce(F.col("doc_id"), F.lit(0)) == F.element_at(F.create_map(*[F.lit(x) for p, t in tops for x in (p, 0 if t is None else t)]), F.col("part"))
    carried = rows.where(is_top).groupBy("part", "doc_id").agg(highest.alias("row")).select(F.element_at(goes, F.col("part")).alias("part"), F.lit(True).alias("carry"), "doc_id", F.col("row.text").alias("text"))
    both = rows.select("part", F.lit(False).alias("carry"), "doc_id", "text").unionByName(carried)
    both = both.repartition(parts, "part").sortWithinPartitions("part", F.desc("carry"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return both.mapInArrow(_compare(), OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
