"""Operator 7, token ids in files of shuffled bit or byte planes.

A file holds the ids of consecutive documents. Ids are cut into blocks of a fixed size; each block is transposed into
planes (plane i of kind byte holds byte i of every id, plane i of kind bit holds bit i), each plane is compressed with
zstandard, and an index at the end tells where every plane lies, so that any id can be read by opening one block.

    magic 'KLBP' | planes of block 0 | planes of block 1 | ... | documents (zstandard) | index (zstandard) | trailer

The index has for each block its ids and the sizes of its planes; the trailer has the sizes of both tables, the count of
ids, the width and kind of planes and the block size. All integers are little-endian.
"""

import math
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_path, prepare, release, remove, shared_path, spool
from .wordcache import WordTokenizer

MAGIC, TRAILER = b"KLBP", struct.Struct("<4sQQQIII")
BLOCK = 1 << 16
#: Bytes of text that one file has at most on average.
PART_BYTES = 1 << 30
KINDS = {"byte": 0, "bit": 1}


def shuffle(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def unshuffle(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8, count) for p in planes], axis=1).copy().view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u4").ravel()


class Writer:
    """Writes ids to a file block by block; holds one block and the documents' lengths in memory."""

    def __init__(self, file, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.file, self.kind, self.block = file, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.size, self.total = [], 0, 0
        self.index, self.docs = [], []
        file.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        at = 0
        while len(flat) - at >= least and at < len(flat):
            part = flat[at : at + self.block]
            planes = [self.pack(p) for p in shuffle(part, self.kind)]
            for p in planes:
                self.file.write(p)
            self.index.append([len(part), *map(len, planes)])
            self.total += len(part)
            at += len(part)
        self.held, self.size = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(1)
        docs = self.pack(np.array(self.docs, "<i8").tobytes())
        index = self.pack(np.array(self.index, "<u4").tobytes())
        self.file.write(docs)
        self.file.write(index)
        self.file.write(TRAILER.pack(MAGIC, len(docs), len(index), self.total, KINDS[self.kind], self.block, len(self.index)))


class Reader:
    """Reads a file of Writer; `file` needs read, seek and tell."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, os.SEEK_END)
        file.seek(end - TRAILER.size)
        magic, docs, index, self.total, kind, self.block, blocks = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of shuffled planes")
        self.kind = next(k for k, v in KINDS.items() if v == kind)
        unpack = zstandard.ZstdDecompressor().decompress
        file.seek(end - TRAILER.size - index - docs)
        self.docs = np.frombuffer(unpack(file.read(docs)), "<i8").reshape(-1, 2)
        self.index = np.frombuffer(unpack(file.read(index)), "<u4").reshape(blocks, 5 if self.kind == "byte" else 33).astype(np.int64)
        sizes = self.index[:, 1:].sum(axis=1)
        self.places = len(MAGIC) + np.cumsum(sizes) - sizes
        self.unpack = unpack

    def blocks(self, first: int = 0):
        """Ids of block `first` and those after it."""
        self.file.seek(int(self.places[first]) if first < len(self.index) else 0)
        for count, *sizes in self.index[first:].tolist():
            yield unshuffle([self.unpack(self.file.read(s)) for s in sizes], count, self.kind)

    def read(self, start: int, count: int) -> np.ndarray:
        """`count` ids from place `start`; opens only the blocks that hold them."""
        first, parts, at = start // self.block, [], start // self.block * self.block
        if count > 0:
            for ids in self.blocks(first):
                parts.append(ids[max(0, start - at) : start + count - at])
                at += len(ids)
                if at >= start + count:
                    break
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self):
        """(doc_id, ids) of each document, one block in memory at a time besides the document."""
        blocks, held = self.blocks(), np.zeros(0, "<u4")
        for doc_id, count in self.docs.tolist():
            parts = [held]
            size = len(held)
            while size < count:
                parts.append(next(blocks))
                size += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:count]
            held = held[count:]


def _open(path: str, mode: str):
    if "://" not in path:
        return open(local_path(path), mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner) if mode == "rb" else system.open_output_stream(inner)


def _write(path: str, end_id: int, folder: str, kind: str, block: int):
    """Encodes the rows (doc_id, text) of one range, in their order, into one file, which is named by the range's number."""

    def scan(batches):
        encode, part = WordTokenizer.of(path).encode, TaskContext.get().partitionId()
        name = f"{folder}/part-{part:08d}.klbp"
        # an attempt of its own name, so that a task that runs twice leaves one whole file
        attempt, writer = f"{name}.{os.getpid()}-{os.urandom(4).hex()}", None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    file = _open(attempt, "wb")
                    writer = Writer(file, kind, block)
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                writer.add(NULL_ID if doc_id is None else doc_id, ids)
        if writer is None:
            return
        writer.close()
        file.close()
        if "://" not in folder:
            os.replace(local_path(attempt), local_path(name))
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(attempt)
            system.move(inner, fs.FileSystem.from_uri(name)[1])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.total], pa.int64())], ["part", "path", "docs", "ids"])

    return scan


#: Stands for a null doc_id in files.
NULL_ID = -(1 << 63)


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str, kind: str = "byte", block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text), appends end_id to each, and writes files in ascending doc_id order into `folder`, a shared one.

    Returns the manifest (part, path, docs, ids, start): start counts the ids in the files before. Null texts are empty;
    null doc_ids come last; rows of one doc_id follow each other in the order of a hash of their texts. A text of any length is one document.
    Other columns are ignored. An empty table writes no file.

    Rows are dealt to ranges of (doc_id, hash), so many rows of one doc_id, or without one, are many ranges; a task encodes its range row by
    row into one file. There are as many ranges as shuffle partitions, or more, so that a range has PART_BYTES of text at most on average.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    files = spool(rows.mapInArrow(_write(path, end_id, folder, kind, block), "part int, path string, docs long, ids long"), "manifest")
    # one row a file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _read():
    def scan(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path, "rb") as file:
                    rows = []
                    for doc_id, ids in Reader(file).documents():
                        rows.append((None if doc_id == NULL_ID else doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return scan


def _rows(rows):
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(manifest: DataFrame, parts: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest, read from the files alone."""
    return manifest.select("path", "start").repartition(parts).mapInArrow(_read(), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Writes the files into a fresh shared folder and returns read_ids() of them."""
    spark = prepare(docs.sparkSession)
    folder = shared_path(spark, "ids")
    folder = folder[5:] if folder.startswith("file:") else folder
    folder = "/" + folder.lstrip("/") if "://" not in folder else folder
    manifest = write_ids(docs, path, end_id, folder, kind, block)
    out = spool(read_ids(manifest, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ids-read")
    remove(spark, folder)
    release(manifest)
    return out
