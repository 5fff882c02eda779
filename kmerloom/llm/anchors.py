"""Content-defined anchors: runs of consecutive windows that share their smallest k-gram.

Every window of `window` symbols contains `window - k + 1` k-grams; the leftmost with the smallest hash order is its
anchor, so equal windows have the same anchor at the same place. Consecutive windows with one anchor form a run, and
only runs (about one per (window - k + 2) / 2 symbols) travel through Spark, not windows. A run's row holds the anchor
`m`, a hash `h` of all symbols that its windows span together with the anchor's place in it, the document and
`at` = start << 16 | number of windows.

Anchors only bring together what may be equal, so their hash may be any; `h` is a polynomial modulo a prime, and what it finds
equal is compared symbol by symbol afterwards (see coordinates.py).
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLL, U64, Polynomial, mix, release, sliding_argmin, spool

RUNS = "m long, h long, doc long, at long"


def runs_of(symbols: np.ndarray, prefix: np.ndarray, bounds: np.ndarray, window: int, k: int, poly: Polynomial):
    """(anchor, span hash, document index, first window, windows) of every run.

    symbols: 64 bits each; prefix: poly's running sums over the symbols or what they stand for; bounds: where each document's symbols begin.
    """
    none = tuple(np.zeros(0, x) for x in (U64, U64, np.int64, np.int64, np.int64))
    if len(symbols) < window:
        return none
    grams = mix(ROLL.grams(symbols, k))
    anchor = sliding_argmin(grams, window - k + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    inside = np.arange(len(anchor)) + window <= bounds[doc + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    # a run ends where the next window is new or not inside
    ends = np.flatnonzero(np.r_[new[1:] | ~inside[1:], True] & inside)
    size = ends - first + 1
    at = anchor[first]
    span = poly.spans(prefix, first, first + size + window - 1)
    shape = (size.astype(U64) << U64(20)) ^ (at - first).astype(U64)
    return grams[at], mix(span ^ mix(shape)), doc[first], first, size


def repeated(runs: DataFrame, across_documents: bool) -> DataFrame:
    """The runs whose anchor occurs again (in another document, if across_documents). Counts are combined before the shuffle; the
    anchors found are a table of their own, so that the join may split a frequent anchor's runs over tasks."""
    seen = runs.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    again = spool(seen.where("lo < hi" if across_documents else "n > 1").select("m"), "again")
    out = spool(runs.join(again, "m"), "repeated")
    release(again)
    return out


def variants_of(runs: DataFrame, *more) -> DataFrame:
    """Spooled (m, h, first, last, more, variants): every different run with its earliest place (document, at), its last document, and how many different runs its anchor has."""
    found = spool(runs.groupBy("m", "h").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("last"), *more), "variants")
    several = spool(found.groupBy("m").agg(F.count("*").alias("variants")), "several")
    out = spool(found.join(several, "m"), "known")
    release(found, several)
    return out
