"""Operator 10, mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order (null last) have weights that repeat; they share `share` times all sizes, no source
more than `most` times its own size, the excess reshared by weight. So each source's target is the smaller of its cap and
its weight times one common level.

Copies: every document of a source has the same fractional number of copies, target / source size. Its whole part is
taken; the fraction is rounded by pivots. Two documents with fractions meet; a random amount of words moves from one to the
other, such that neither's expectation changes, until one fraction is 0 or 1; the other goes on. So the words taken of a
source stay at its target, but for one last fraction.

Distribution: documents are dealt to leaves by a hash, about LEAF to a leaf; a leaf leaves at most one fraction a source. Those
residuals meet in the next level of a reduction tree, FAN leaves to a node, up to one node a source, the root. Every random number is a
hash of the ids that meet, so reruns agree whatever the number of tasks.

The root: about POOL documents of each class of lengths (powers of two) don't go to leaves but wait at their source's root, where they
meet the last residuals, the longest first. So a residual meets documents of its own length, and shorter ones after them, and what
is left at the end is mostly as short as the source's shortest. That last fraction is rounded by chance, and the words that this takes too
many or too few are given back by turning settled documents of the root over, the longest that fits first. Of the two ways to round, one
that can't be given back is not taken: a document longer than all words that its source has to give can't be taken whatever its fraction says.
Apart from these few documents every expectation is kept.
"""

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, release, spool

LEAF, FAN, POOL = 512, 64, 128
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-12


def draw(*key) -> float:
    """A number in [0, 1) that depends on the key alone."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """Moves words between two (key, size, fraction) until one fraction is 0 or 1; returns (settled, remaining).

    p moves by t / size on one side and by -t / size on the other, up or down with odds that keep both expectations.
    """
    (ka, sa, pa_), (kb, sb, pb) = a, b
    up = min((1 - pa_) * sa, pb * sb)
    down = min(pa_ * sa, (1 - pb) * sb)
    if draw(seed, ka, kb) * (up + down) < down:
        first = (1 - pa_) * sa <= pb * sb
        pa_, pb = (1.0, pb - up / sb) if first else (pa_ + up / sa, 0.0)
    else:
        first = pa_ * sa <= (1 - pb) * sb
        pa_, pb = (0.0, pb + down / sb) if first else (pa_ - down / sa, 1.0)
    a, b = (ka, sa, pa_), (kb, sb, pb)
    return (a, b) if first else (b, a)


def settle(rows: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """Rounds (key, size, fraction) one after the other; returns those settled and the one, if any, that still has a fraction.

    Documents without words have nothing to take and settle at 0.
    """
    done, held = [], None
    for row in rows:
        if row[1] == 0 or row[2] <= EDGE or row[2] >= 1 - EDGE:
            done.append((row[0], row[1], float(row[1] > 0 and row[2] > 0.5)))
        elif held is None:
            held = row
        else:
            out, held = pivot(held, row, seed)
            done.append(out)
            if held[2] <= EDGE or held[2] >= 1 - EDGE:
                done.append((held[0], held[1], float(held[2] > 0.5)))
                held = None
    return done, held


def mend(rows: list[tuple], goal: float, fixed) -> tuple[list[tuple], float]:
    """Turns settled (key, size, 0 or 1) over until their words are near `goal`; the key `fixed` stays. Returns the rows and the gap left.

    Documents that close the gap are taken from the longest that fits down; then the shortest that closes more than the gap is turned over too, and the
    gap that this opens on the other side is closed in the same way, as long as that leaves less.
    """
    order = sorted((i for i, r in enumerate(rows) if r[1] > 0 and r[0] != fixed), key=lambda i: (-rows[i][1], rows[i][0]))
    state = [r[2] for r in rows]
    gap = goal - sum(n * q for (_, n, _), q in zip(rows, state, strict=True))
    best, found = abs(gap), list(state)
    for _ in range(16):
        side = 0.0 if gap > 0 else 1.0
        for i in order:
            if state[i] == side and rows[i][1] <= abs(gap):
                state[i] = 1.0 - side
                gap -= rows[i][1] if side == 0.0 else -rows[i][1]
        if abs(gap) < best:
            best, found = abs(gap), list(state)
        over = [i for i in order if state[i] == side and rows[i][1] > abs(gap)]
        if best < 1 or not over:
            break
        i = over[-1]
        state[i] = 1.0 - side
        gap -= rows[i][1] if side == 0.0 else -rows[i][1]
        if abs(gap) < best:
            best, found = abs(gap), list(state)
    return [(k, n, q) for (k, n, _), q in zip(rows, found, strict=True)], best


def finish(rows: list[tuple], seed: int) -> list[tuple]:
    """Rounds all (key, size, fraction) of a source's root, the longest first, and gives back what the last fraction takes or leaves."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    goal = sum(n * p for _, n, p in rows)
    done, rest = settle(rows, seed)
    if rest is None:
        return done
    up, down = (mend([*done, (rest[0], rest[1], q)], goal, rest[0]) for q in (1.0, 0.0))
    shortest = min((n for _, n, _ in rows if n > 0), default=0)
    if max(up[1], down[1]) <= shortest:
        return (up if draw(seed, "last", rest[0]) < rest[2] else down)[0]
    return (up if up[1] < down[1] else down)[0]


ROW = "source_no int, node long, doc_id long, size long, content long, turn long, fraction double"


def _settle_groups(seed: int, last: bool):
    """Rows (ROW) that come sorted by source and node, as they are, with `settled`; what a node leaves isn't settled, unless it is the last."""

    def scan(batches):
        held, key = [], None

        def flush():
            items = [((-1 if doc is None else doc, size, content, turn, doc is None), size, p) for doc, size, content, turn, p in held]
            done, rest = (finish(items, seed), None) if last else settle(items, seed)
            rows = [(*k, p, True) for k, _, p in done] + ([(*rest[0], rest[2], False)] if rest else [])
            doc, size, content, turn, none, p, settled = zip(*rows, strict=True)
            n = len(rows)
            values = [[key[0]] * n, [key[1]] * n, [None if x else d for d, x in zip(doc, none, strict=True)], size, content, turn, p, settled]
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["source_no", "node", "doc_id", "size", "content", "turn", "fraction", "settled"])

        for batch in batches:
            for source, node, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (source, node) != key:
                    if held:
                        yield flush()
                    held, key = [], (source, node)
                held.append(row)
        if held:
            yield flush()

    return scan


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_no, source_size, target) from (source, source_size), one row a source.

    The level is found where the sources, sorted by cap / weight, are capped up to a point and the rest take weight * level.
    A source without words has target 0.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # code-point order is the order of UTF-8 bytes, Spark's own
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("source_no", number.cast("int")).withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    rows = rows.withColumn("below", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("heavier", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("goal", F.sum("source_size").over(everything) * float(share))
    # at the first source that isn't capped, what the capped ones leave is shared by the weights from it on
    level = (F.col("goal") - F.col("below")) / F.col("heavier")
    rows = rows.withColumn("level", F.first(F.when(level * F.col("weight") <= F.col("cap"), level), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_no", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs (doc_id, text, source).

    size counts the words of the text (null: 0); source_size and target are those of the row's source, null being a source of
    its own; copies is how often the mix takes the document and taken its words, size * copies, at most ceil(most) * size.
    Rows that share a doc_id, and rows without one, are documents of their own; rows equal in doc_id, source and text are numbered.
    A long text is one document like others. Other columns are ignored. An empty table gives an empty result.
    """
    return _copies(docs, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, carry: tuple[str, ...], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Columns `carry` of every row of docs (doc_id, text, source), each row as often as mix_sources takes it.

    Rows equal in doc_id (or without), source and text take their copies in the order of `carry`.
    """
    # plain keys for what may be null, so that the window and the join need one exchange of the texts
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("key_id"), F.isnull(F.col("doc_id").cast("long")).alias("key_no_id"), F.coalesce("source", F.lit("")).alias("key_source"), F.isnull("source").alias("key_no_source")]
    names = ["key_id", "key_no_id", "key_source", "key_no_source", "key_size", "key_content"]
    copies = _copies(docs, weights, share, most, seed).select(*keys, F.col("size").alias("key_size"), F.col("content").alias("key_content"), "turn", "copies")
    copies = copies.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "copies"))), lambda x: x["copies"]).alias("key_copies"))
    rows = docs.select(*keys, _size().alias("key_size"), _content().alias("key_content"), F.struct(*carry).alias("row"))
    rows = rows.withColumn("key_turn", F.row_number().over(Window.partitionBy(*names).orderBy("row")))
    taken = rows.join(copies.hint("shuffle_hash"), names).withColumn("key_times", F.element_at("key_copies", F.col("key_turn"))).where("key_times > 0")
    return taken.withColumn("key_time", F.explode(F.sequence(F.lit(1), F.col("key_times")))).select("row.*")


def _size():
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _content():
    """Tells texts apart where rows share a doc_id or have none."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _copies(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """(doc_id, source, size, content, turn, source_size, target, copies) of every row of docs; turn counts, from 1, rows alike in the four before it."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"), _content().alias("content"))
    rows = spool(rows.groupBy("doc_id", "source", "size", "content").agg(F.count("*").alias("alike")), "sizes")
    length = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")))).otherwise(-1)
    classes = spool(rows.groupBy("source", length.alias("stratum")).agg(F.sum(F.col("size") * F.col("alike")).alias("words"), F.sum("alike").alias("docs")), "classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    goal = targets(sizes.select("source", "source_size"), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = spool(goal.withColumn("whole", F.floor(ratio + EDGE)).withColumn("fraction", ratio - F.floor(ratio + EDGE)), "targets")
    leaves = max(1, math.ceil((sizes.agg(F.max("docs")).first()[0] or 0) / LEAF))
    # the root of each source gets about POOL documents of each class of lengths
    pooled = goal.join(classes, goal.source.eqNullSafe(classes.source)).select(goal.source.alias("of_source"), "stratum", "source_no", "fraction", (POOL * 1e6 / F.col("docs")).alias("rate"))
    known = rows.join(pooled, F.col("source").eqNullSafe(F.col("of_source")) & (length == F.col("stratum")))
    known = known.select("source_no", "doc_id", "size", "content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))).alias("turn"), "fraction", "rate")
    chance = F.xxhash64(F.lit(seed), "doc_id", "size", "content", "turn")
    waits = F.pmod(F.shiftright(chance, 20), F.lit(1_000_000)) < F.col("rate")
    state = known.select("source_no", F.when(waits, F.lit(-1)).otherwise(F.pmod(chance, F.lit(leaves))).cast("long").alias("node"), "doc_id", "size", "content", "turn", "fraction")
    names = ["source_no", "node", "doc_id", "size", "content", "turn", "fraction"]

    def rounded(state: DataFrame, last: bool) -> DataFrame:
        dealt = state.select(*names).repartition(parts, "source_no", "node").sortWithinPartitions("source_no", "node", F.desc("size"), "doc_id", "content", "turn")
        return spool(dealt.mapInArrow(_settle_groups(seed, last), f"{ROW}, settled boolean"), "settled")

    state = spool(state, "state")
    root, state, nodes, settled = state.where("node = -1"), state.where("node >= 0"), leaves, []
    while True:
        state = rounded(state, False)
        settled.append(state.where("settled"))
        state = state.where("not settled")
        if nodes == 1:
            break
        nodes = math.ceil(nodes / FAN)
        state = state.withColumn("node", F.col("node") % nodes)
    settled.append(rounded(root.select(*names).unionByName(state.select(*names)).withColumn("node", F.lit(0).cast("long")), True))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.drop("node", "settled").withColumnRenamed("fraction", "extra").join(goal.drop("fraction"), "source_no")
    out = out.withColumn("copies", (F.col("whole") + F.when(F.col("extra") > 0.5, 1).otherwise(0)).cast("int"))
    out = spool(out.select("doc_id", "source", "size", "content", "turn", "source_size", "target", "copies"), "copies")
    release(rows, classes, goal)
    return out
