"""Shared plumbing of the training-data operators: shared folder, spooled tables, Arrow helpers and numpy text kernels."""

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kmerloom.plans.storage import release, remove, shared_dir, shared_path, spool  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])
U64 = np.uint64
#: Bytes of text that a kernel treats at once (one longer document is treated alone).
SLICE_BYTES = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, has them give freed memory back, and bounds the rows of an Arrow batch.

    Workers live as long as their executor: what their allocators kept would add up over the stages of a pipeline.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MALLOC_ARENA_MAX"):
        env.setdefault(name, "1")
    # kernels work on arrays of a few MB: an allocator that returns each at once spends more time on page faults than on sums
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 25))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(1 << 26))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; every machine has the same installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_path(path: str) -> str:
    """A mounted path for Python's open(); shared folders of other schemes go through pyarrow.fs."""
    return path[5:] if path.startswith("file:") else path


def text_slices(batches, text: int = 1):
    """(record batch, data bytes as uint8, offsets as int64) of at most SLICE_BYTES of text (or one row); null texts are empty."""
    for batch in batches:
        col = batch.column(text)
        if col.type != pa.large_string():
            col = col.cast(pa.large_string())
        n = len(col)
        if not n:
            continue
        bufs = col.buffers()
        offsets = np.frombuffer(bufs[1], np.int64, n + 1 + col.offset)[col.offset :]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        if col.null_count:
            null = np.asarray(col.is_null())
            if sizes[null].any():
                col = pa.array([x or "" for x in col.to_pylist()], pa.large_string())
                bufs = col.buffers()
                offsets, data = np.frombuffer(bufs[1], np.int64, n + 1), np.frombuffer(bufs[2], np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Rolling:
    """Hashes of every k consecutive symbols, modulo 2**64: they choose anchors and order rows, never tell contents apart."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = 1 << max(10, n - 1).bit_length()
        with np.errstate(over="ignore"):
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def grams(self, symbols: np.ndarray, k: int) -> np.ndarray:
        """Hash of every k consecutive symbols, from running sums of symbol * base**i, scaled back by base**-start."""
        n = len(symbols) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        self._powers(len(symbols))
        sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * self.up[: len(symbols)], out=sums[1:])
        return (sums[k:] - sums[:n]) * self.down[:n]


PRIME = (1 << 61) - 1
_P, _M31, _M30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, below it."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U64(31), a & _M31, b >> U64(31), b & _M31
    middle = a0 * b1 + a1 * b0
    return _reduced(((a1 * b1) << U64(1)) + (middle >> U64(30)) + ((middle & _M30) << U64(31)) + a0 * b0)


class Polynomial:
    """Hashes of any span of a sequence of symbols: the polynomial of its symbols modulo the prime 2**61 - 1, at a fixed place.

    Two different spans of n symbols are equal at n - 1 places of 2**61 at most. Symbols are bytes (each counts as its value plus 1) or numbers of
    64 bits. Hashes come from running sums of symbol * base**i, scaled back by base**-start.
    """

    STEP = 1 << 14

    def __init__(self, base: int):
        self.base = base % PRIME
        self.up = self.down = self.low = self.high = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = 1 << max(10, n - 1).bit_length()
        for name, base in (("up", self.base), ("down", pow(self.base, -1, PRIME))):
            p = np.ones(size, U64)
            done = 1
            while done < size:
                p[done : 2 * done] = _times(p[:done], U64(pow(base, done, PRIME)))
                done *= 2
            setattr(self, name, p)
        self.low, self.high = self.up & _M31, self.up >> U64(31)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        self._powers(n + 1)
        out = np.zeros(n + 1, U64)
        for lo in range(0, n, self.STEP):
            hi = min(n, lo + self.STEP)
            part = symbols[lo:hi]
            if part.dtype == np.uint8:
                part = part.astype(U64) + U64(1)
                low, high = np.cumsum(part * self.low[lo:hi]), np.cumsum(part * self.high[lo:hi])
            else:
                part = _times(_reduced(part), self.up[lo:hi])
                low, high = np.cumsum(part & _M31), np.cumsum(part >> U64(31))
            out[lo + 1 : hi + 1] = _reduced((high >> U64(30)) + ((high & _M30) << U64(31)) + low + out[lo])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        apart = prefix[stop] + (_P - prefix[start])
        return _times(np.where(apart >= _P, apart - _P, apart), self.down[start])


ROLL = Rolling(0x9E3779B97F4A7C15)
POLY_A, POLY_B = Polynomial(0x1B2F8A6D5C3E9741), Polynomial(0x0D4C83F1A7E2965B)
_BYTE_SEEDS = mix(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))
#: Word separators of every contract: blank and the control characters 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offset at which each document begins (one more entry than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= SEPARATOR[data[:-1]] | cut[1:n]
    last = inside.copy()
    last[:-1] &= SEPARATOR[data[1:]] | cut[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every word."""
    if not len(start):
        return np.zeros(0, U64)
    return mix(POLY_A.spans(POLY_A.prefix(data), start, stop) ^ ((stop - start).astype(U64) << U64(61)))


def sliding_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of every `width` consecutive values (blocks' prefix and suffix minima, two per window)."""
    n = len(order)
    if n < width:
        return np.zeros(0, np.int64)
    bits = max(1, (n - 1).bit_length())
    key = (order >> U64(bits)) << U64(bits) | np.arange(n, dtype=U64)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(U64).max, U64)
    full[:n] = key
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (best & U64((1 << bits) - 1)).astype(np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - begin, length)


def merge_spans(start: np.ndarray, stop: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted, maximal spans that cover the given ones, clipped to [0, limit)."""
    start, stop = np.clip(start, 0, limit), np.clip(stop, 0, limit)
    keep = stop > start
    start, stop = start[keep], stop[keep]
    if not len(start):
        return start, stop
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate(stop[by])
    new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    return start[new], np.r_[stop[new[1:] - 1], stop[-1]]


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))
