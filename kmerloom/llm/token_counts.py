"""Operator 4, token counts by an exact length histogram.

Documents are aggregated by encoded length. From the histogram, suffix sums answer for every context limit how many
documents and tokens there are, how many documents are longer, and how many tokens are left when each is truncated.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, spool

#: Lengths in one block of the histogram; a block's sums are added within it, and the blocks' among themselves.
SPAN = 1024


class RankCounter:
    """Tokens of whole texts under a tiktoken rank file, one per worker and file."""

    _by_path: dict = {}

    @classmethod
    def of(cls, path: str) -> "RankCounter":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length. Null texts are empty."""
    prepare(docs.sparkSession)

    def scan(batches):
        counter = RankCounter.of(path)
        for batch in batches:
            lengths, docs = np.unique(np.array([counter.count(x or "") for x in batch.column(0).to_pylist()], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(docs.astype(np.int64))], ["n_tokens", "docs"])

    rows = docs.select("text").mapInArrow(scan, "n_tokens long, docs long")
    return rows.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds docs_longer, tokens_longer (documents above the length and their tokens), docs_total, tokens_total and
    truncated_total (tokens left if every document is cut to the length) to (n_tokens, docs).

    Sums run within blocks of SPAN lengths and, over the blocks, among one row a block.
    """
    rows = spool(counts.withColumn("block", F.floor(F.col("n_tokens") / SPAN)), "lengths")
    tokens = F.col("n_tokens") * F.col("docs")
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("di", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("ti", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
    out = rows.join(blocks, "block").select("n_tokens", "docs", (F.col("d") + F.col("di")).alias("docs_longer"), (F.col("t") + F.col("ti")).alias("tokens_longer"), "docs_total", "tokens_total")
    return out.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"))


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """One row for each encoded length that occurs: the histogram with its suffix sums and `quantile`, the share of documents
    of at most that length. An empty table gives no row; null and empty texts have length 0; repeated rows count each, rows without doc_id like others;
    a text of any length is encoded whole, in one task. Only the column text is read, whatever others there are."""
    return with_suffix_sums(histogram(docs, path)).withColumn("quantile", 1 - F.col("docs_longer") / F.col("docs_total"))


def at_limit(lengths: DataFrame, limit: int) -> DataFrame:
    """docs_total, tokens_total, docs_longer and truncated_total for any context limit, from length_histogram()'s rows.

    The row of the longest length that isn't above the limit has the suffix sums asked for; below the shortest, all are longer.
    """
    row = lengths.agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"), F.max_by(F.struct("docs_longer", "tokens_longer"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))).alias("s"))
    longer, tokens = F.coalesce("s.docs_longer", "docs_total"), F.coalesce("s.tokens_longer", "tokens_total")
    return row.select("docs_total", "tokens_total", longer.alias("docs_longer"), (F.col("tokens_total") - tokens + longer * limit).alias("truncated_total"))
