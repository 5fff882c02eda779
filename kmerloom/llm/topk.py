"""Operator 6, exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped to buckets of similar length, longest first, and each bucket is dealt to chunks of bounded size. Queries
are grouped to blocks by the length that a candidate needs to reach their threshold, so those of a block meet the same buckets.

1. A bounded number of the longest vectors gives each query a first threshold: the k-th best product among them.
2. A query meets a bucket only if its own length times the bucket's greatest reaches the threshold. Candidates travel only to the
   blocks that have a query which meets their bucket.
3. Threshold, divided by both lengths, is the cosine that a candidate of the bucket must reach. Where that is high, the query's
   largest coordinate bounds the same coordinate of every candidate that can reach it; where it is low, the
   candidates' own lengths, sorted, bound how many of them can.
4. What is left is verified by integer products; only products that reach the threshold leave the chunk.

Bounds are widened by a relative 1e-9, far above rounding, so nothing is lost to it. Chunks and blocks grow with the square root of
the table, up to ROOM bytes of vectors: each vector then travels to the fewest groups that bounded memory allows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, release, spool

BUCKETS, CHUNK, BLOCK, SEEDS = 32, 2048, 1024, 1024
#: Bytes of vectors in a chunk or block at most, and cuts of the queries by the length that they need.
ROOM, REACHES = 1 << 24, 64
#: Cosine from which the coordinate bound is used.
STEEP = 0.5
SLACK = 1e-9
#: Components below this are multiplied as 64-bit integers, or as doubles where these are exact; others as unbounded integers.
WIDE = 1 << 26
LONG = (1 << 63) - 1

QUANTISED = "vec_id long, dim int, norm double, vec binary"


def _quantise(scale: int):
    def scan(batches):
        for batch in batches:
            ids, dims, norms, vecs = [], [], [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(scale * np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64))
                if not np.isfinite(v).all():
                    continue
                ids.append(vec_id)
                dims.append(len(v))
                norms.append(float(np.sqrt(np.square(v / (1 << 20)).sum()) * (1 << 20)))
                vecs.append(v.astype("<f8").tobytes())  # whole numbers, exact as doubles
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "norm", "vec"])

    return scan


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b (whole numbers as doubles), held to the range of a long."""
    top = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    if top[0] * top[1] * max(1, a.shape[1]) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if max(top) < WIDE and a.shape[1] <= 1024:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LONG - 1, LONG).astype(np.int64)


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def kth_best(queries: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product of each query with the others but itself; -inf if there are fewer."""
    if len(others) < k:
        return np.full(len(ids), -np.inf)
    score = products(queries, others).astype(np.float64)
    score[ids[:, None] == other_ids[None, :]] = -np.inf
    return np.partition(score, len(others) - k, axis=1)[:, len(others) - k]


def feasible(unit: np.ndarray, units: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors can have that cosine with `unit`, by the bounds of its largest coordinate alone."""
    at = int(np.abs(unit).argmax())
    spread = math.sqrt(max(0.0, 1 - cosine**2) * max(0.0, 1 - unit[at] ** 2))
    low = unit[at] * cosine - spread
    high = unit[at] * cosine + spread
    # beyond the bound on the query's own side the cosine only has to be reached, so that side is open
    x = units[:, at]
    reach = x >= low - 1e-7 if unit[at] >= 0 else x <= high + 1e-7
    return reach


def search_chunk(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query row, vector id, score) of the k best of a chunk for each query that reach its threshold, ties to smaller ids."""
    by = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
    vectors, ids = vectors[by], ids[by]
    lengths = np.linalg.norm(vectors, axis=1)
    units = vectors / np.maximum(lengths, 1e-300)[:, None]
    own = np.linalg.norm(queries, axis=1)
    longest = lengths[0] if len(lengths) else 0.0
    bound = own * longest
    cosine = np.where((least > 0) & (bound > 0), least / np.where(bound > 0, bound, 1), -1.0)
    out = []

    def keep(row: int, score: np.ndarray, found: np.ndarray) -> None:
        ok = (ids[found] != query_ids[row]) & (score >= least[row])
        score, found = score[ok], found[ok]
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), row), ids[found[best]], score[best]))

    steep = np.flatnonzero((cosine >= STEEP) & (cosine <= 1 + SLACK))
    for row in steep.tolist():
        can = np.flatnonzero(feasible(queries[row] / own[row], units, min(1.0, float(cosine[row]) * (1 - SLACK))))
        if len(can):
            keep(row, products(queries[row : row + 1], vectors[can])[0], can)
    flat = np.flatnonzero(cosine < STEEP)
    if len(flat):
        # candidates shorter than threshold / own length can't reach it; queries of a like reach are multiplied together
        need = np.where((least[flat] > 0) & (own[flat] > 0), least[flat] / np.maximum(own[flat], 1e-300) * (1 - SLACK), 0.0)
        reach = np.searchsorted(-lengths, -need, "right")
        order = np.argsort(-reach, kind="stable")
        for lo in range(0, len(order), 64):
            rows = flat[order[lo : lo + 64]]
            most = int(reach[order[lo]])
            if not most:
                break
            found = np.arange(most)
            for row, score in zip(rows.tolist(), products(queries[rows], vectors[:most]), strict=True):
                keep(row, score, found)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))


def _search(k: int):
    """Rows (dim, bucket, chunk, block, kind, vec_id, least, vec), sorted by the first five; kind 0: query, 1: candidate."""

    def scan(batches):
        held, key = [], None

        def flush():
            rows = pa.Table.from_batches(held)
            kind = rows.column("kind").to_numpy()
            split = int((kind == 0).sum())
            if not split or split == len(kind):
                return None
            left, right = rows.slice(0, split), rows.slice(split)
            ids = left.column("vec_id").to_numpy()
            row, found, score = search_chunk(_matrix(left.column("vec")), ids, left.column("least").to_numpy(), _matrix(right.column("vec")), right.column("vec_id").to_numpy(), k)
            return pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[lo])
                if now != key and held:
                    if (out := flush()) is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held and (out := flush()) is not None:
            yield out

    return scan


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query with all other rows, ties to smaller vec_id.

    vectors: vec_id, embedding; components become floor(scale * x). Queries are the rows whose vec_id is divisible by `every`.
    Rows without vec_id, null vectors and those with null or non-finite components take no part. Only vectors of one
    dimension are compared. Rows that repeat a vec_id and its vector count once; a query isn't compared with rows of its own
    vec_id. Products beyond a long are held to its range, components whose multiple is beyond a double count as non-finite. Fewer than k
    candidates: all of them. Other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = whole = spool(rows.mapInArrow(_quantise(scale), QUANTISED).dropDuplicates(["vec_id", "vec"]), "vectors")
    facts = rows.agg(F.count("*"), F.max("dim")).first()
    room, growth = max(1, ROOM // (8 * max(1, facts[1] or 1))), max(1, math.isqrt(facts[0]) // 4096)
    most_chunk, most_block = (min(room, least * growth) for least in (CHUNK, BLOCK))
    cuts = sorted(set(rows.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.002)), reverse=True) if facts[0] else []
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + F.when(F.col("norm") < cut, 1).otherwise(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # BUCKETS rows for each dimension
    sizes = rows.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"), F.ceil(F.count("*") / most_chunk).cast("int").alias("chunks"))
    sizes = spool(sizes, "buckets")
    seeds = rows.where("norm is not null").orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "dim", "vec").collect()
    by_dim: dict[int, tuple] = {}
    for dim in {r.dim for r in seeds}:
        own = [r for r in seeds if r.dim == dim]
        by_dim[dim] = (np.frombuffer(b"".join(bytes(r.vec) for r in own), "<f8").reshape(len(own), dim), np.array([r.vec_id for r in own]))
    held = spark.sparkContext.broadcast(by_dim)

    def first(batches):
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            least = np.full(len(ids), -np.inf)
            for dim in set(dims.tolist()) & held.value.keys():
                at = np.flatnonzero(dims == dim)
                least[at] = kth_best(_matrix(batch.column(3).take(pa.array(at))), ids[at], *held.value[dim], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(least), batch.column(3)], ["vec_id", "dim", "norm", "least", "vec"])

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "dim", "norm", "vec").mapInArrow(first, "vec_id long, dim int, norm double, least double, vec binary")
    queries = spooled = spool(queries, "queries")
    asked = queries.count()
    blocks = max(1, math.ceil(asked / most_block))
    # the length that a candidate must have; queries without a threshold need none
    need = F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm")).otherwise(0.0)
    queries = queries.withColumn("need", need)
    reaches = min(blocks, REACHES)
    steps = sorted(set(queries.approxQuantile("need", [i / reaches for i in range(1, reaches)], 0.005))) if reaches > 1 else []
    reach = F.lit(0)
    for step in steps:
        reach = reach + F.when(F.col("need") >= step, 1).otherwise(0)
    deep = math.ceil(blocks / (len(steps) + 1))
    block = (reach * deep + F.pmod(F.xxhash64("vec_id"), F.lit(deep))).cast("int")
    met = queries.withColumn("block", block).join(F.broadcast(sizes), "dim").where(F.col("norm") * F.col("longest") * (1 + SLACK) >= F.col("least"))
    met = met_table = spool(met.select("dim", "bucket", "chunks", "block", "vec_id", "least", "vec"), "met")
    # blocks that a bucket's candidates have to travel to: a row each at most, of BUCKETS times blocks
    meets = spool(met.groupBy("dim", "bucket", "chunks").agg(F.sort_array(F.collect_set("block")).alias("blocks")), "meets")
    met = met.select("dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", F.lit(0).alias("kind"), "vec_id", "least", "vec")
    chunk = F.pmod(F.xxhash64(F.lit(3), F.col("vec_id"), F.col("vec")), F.col("chunks")).cast("int")
    dealt = rows.join(F.broadcast(meets), ["dim", "bucket"]).select("dim", "bucket", chunk.alias("chunk"), F.explode("blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", F.lit(0.0).alias("least"), "vec")
    both = met.unionByName(dealt).repartition(parts, "dim", "bucket", "chunk", "block").sortWithinPartitions("dim", "bucket", "chunk", "block", "kind")
    found = both.mapInArrow(_search(k), "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = spool(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    release(whole, spooled, sizes, met_table, meets)
    return out
