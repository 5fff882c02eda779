"""Column expressions over nucleotide sequences. All are native Spark expressions; positions are 1-based."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that neighbouring fragments share, whatever k is.
OVERLAP = 3
#: Longest k for which N stays a letter; longer k-mers are cut from sequences without it.
LAST_FIVE_LETTER_K = 27


def normalize(seq: Column, k: int) -> Column:
    """Upper case, U as T, every other letter N; for k above LAST_FIVE_LETTER_K, N is taken out and its flanks join."""
    five = F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")
    return five if k <= LAST_FIVE_LETTER_K else F.translate(five, "N", "")


def pieces(seq: Column, start: Column, length: int) -> Column:
    """`length` letters from `start` (from 1) on. Sequences are ASCII, so bytes are cut: a string's letters would be counted from its beginning each time."""
    return F.substring(seq.cast("binary"), start, F.lit(length)).cast("string")


def fragments(seq: Column, size: int, overlap: int = OVERLAP) -> Column:
    """Array of the fragments of a sequence: each begins size - overlap after the one before; the tail may be short. Empty: none."""
    step = size - overlap
    count = F.ceil(F.length(seq) / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: pieces(seq, i * step + 1, size))
    return F.when(F.length(seq) > 0, cut).otherwise(F.array().cast("array<string>"))


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers in order of position; none if the sequence is shorter than k."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: pieces(seq, i, k))
    return F.when(F.length(seq) >= k, cut).otherwise(F.array().cast("array<string>"))


def total_kmers(length: Column, k: int) -> Column:
    return F.greatest(length - (k - 1), F.lit(0)).cast("long")


def pure(kmer: Column) -> Column:
    """Whether a k-mer has no letter but A, C, G and T."""
    return kmer.rlike("^[ACGT]+$")


def n_count(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "Nn", ""))).cast("long")


def wrapped(seq: Column, width: int = 60) -> Column:
    """The sequence in lines of `width`."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def letters_to_bases(text: Column) -> Column:
    """A fixed mapping of prose to bases: letters a to z become ACGT in turn, z N, all else goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 6 + "AN"


def bloom_bits(longest_fragment: int, k: int, hashes: int, rate: float) -> int:
    """Bits of one bin of a Bloom filter that holds the longest fragment's k-mers at a false-positive rate; 1024 at least."""
    n = max(0, longest_fragment - k + 1)
    if not n:
        return 1024
    return max(1024, math.ceil(-hashes * n / math.log(1 - rate ** (1 / hashes))))
