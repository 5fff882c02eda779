"""Search of a stream of queries against a stored index: a stateless join of a stream with a table.

Each row of the stream is one query. Its k-mers are exploded, joined with the index and, per micro-batch, aggregated like a batch of
queries; a query never spans batches, so no state is kept.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators import search


def stream_hits(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Sparse hits of a streaming table (query_index, seq) against a static index."""
    return search.probe(search.query_kmers(queries, k), index)


def stream_results(queries: DataFrame, index: DataFrame, references: DataFrame, k: int, path: str, checkpoint: str, threshold: int = 0):
    """Starts a query that appends the dense results of every micro-batch to a Parquet folder; returns it."""
    refs = references.select("ref_id").distinct()

    def write(batch: DataFrame, number: int) -> None:
        found = search.aggregate(search.probe(search.query_kmers(batch, k), index), search.pairs(batch, refs, k), threshold)
        # a batch that runs again overwrites its own folder, so results are written once
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_hits(hits: DataFrame, time: str = "ts", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Hits by reference in windows of event time, with a watermark for late queries; hits must carry the time column."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window), "ref_id").agg(F.sum("hits").alias("hits"), F.count("*").alias("positions"))
