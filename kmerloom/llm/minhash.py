"""Operator 3, MinHash near-dedup by an LSH forest.

Each document's set of word shingles gets a signature of minimum hashes. Each tree of the forest sorts the documents by
its own few signature values, so neighbours in a tree's order share a prefix:

1. Documents with equal sets are one class; only a class's smallest document goes on.
2. All trees' orders are one sorted table, dealt to tasks by ranges. A pass over it finds each document's longest common prefix with its
   neighbours. A region is a maximal stretch with a common prefix of DEPTH values, however many documents it has: a longer one would lose
   pairs, so depth adapts only to where a region is cut. A region of more than `crowd` documents is cut to parts where neighbours' common
   prefixes are shortest, so that its dense stretches, of a longer prefix, stay whole; its parts meet again in step 4.
3. Within a region or part, neighbours are the first candidates: they are compared by their whole signatures, and those of a
   similarity that may reach the threshold (far below it, so chance doesn't lose a pair) are linked. Documents that are not linked yet
   are then compared with all others of the region.
4. Parts of one region are compared over a few pivots of the region, and what is still outside its main component with every part.
5. Candidates of all trees are joined to blocks, and each block compares full sets of shingles, made of the words themselves. A search from
   each document that isn't yet linked tests all documents not yet reached, so copies of one text cost one round, and every linked pair of
   the block is found or implied. Blocks of more than `crowd` documents, or as many shingles as those have, are dealt to parts like regions.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.graph import components

from .common import LOWER, POLY_A, POLY_B, U64, i64, mix, prepare, release, spool, text_slices, word_hashes, words
from .substring_dedup import joined_words

#: A tree orders documents by VALUES of a signature's values; DEPTH of them make a region.
TREES, DEPTH, VALUES, CROWD = 20, 4, 6, 800
#: Shingles that weigh as much as one document where a block's size is bounded.
SHINGLES = 1000
_RNG = np.random.default_rng(20240607)
_FLIP = _RNG.integers(0, 1 << 32, TREES * VALUES, np.uint32)
_SPIN = _RNG.integers(0, 1 << 32, TREES * VALUES, np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin."""
    data = LOWER[data]
    start, stop, bounds = words(data, offsets)
    hashes = word_hashes(data, start, stop)
    counts = np.diff(bounds)
    prefix, other = POLY_A.prefix(hashes), POLY_B.prefix(hashes)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes))
    whole = place + size <= bounds[doc + 1] if len(doc) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    begin = np.r_[place[whole], bounds[short]]
    end = np.r_[place[whole] + size, bounds[short + 1]]
    owner = np.r_[doc[whole], short]
    value = mix(POLY_A.spans(prefix, begin, end) ^ mix(POLY_B.spans(other, begin, end)) ^ (end - begin).astype(U64)) if len(begin) else np.zeros(0, U64)
    by = np.lexsort((value, owner))
    owner, value = owner[by], value[by]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[first], value[first]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of TREES * VALUES minimum hashes for each non-empty set."""
    folded = (values >> U64(32)).astype(np.uint32)
    out = np.empty((TREES * VALUES, len(bounds) - 1), np.uint32)
    work = np.empty_like(folded)
    for i in range(TREES * VALUES):
        np.bitwise_xor(folded, _FLIP[i], out=work)
        np.multiply(work, _SPIN[i], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        np.minimum.reduceat(work, bounds[:-1], out=out[i])
    return out.T


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, signature binary, orders array<binary>"


def _sketch(size: int):
    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            values, bounds = shingle_sets(data, offsets, size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            sig: list = [None] * len(n)
            orders: list = [None] * len(n)
            if len(full):
                cut = np.r_[bounds[full], bounds[-1]]
                k1[full] = np.add.reduceat(mix(values), cut[:-1])
                k2[full] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), cut[:-1])
                rows = signatures(values, cut)
                keys = np.empty((len(full), TREES, 1 + 4 * VALUES), np.uint8)
                keys[:, :, 0] = np.arange(TREES)
                keys[:, :, 1:] = np.ascontiguousarray(rows.astype(">u4")).view(np.uint8).reshape(len(full), TREES, 4 * VALUES)
                for i, x, y in zip(full.tolist(), keys, rows.astype(np.uint8), strict=True):
                    orders[i], sig[i] = [k.tobytes() for k in x], y.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), i64(n), i64(k1), i64(k2), pa.array(sig, pa.binary()), pa.array(orders, pa.list_(pa.binary()))], ["doc_id", "n_shingles", "k1", "k2", "signature", "orders"])

    return scan


def shared_values(keys: np.ndarray) -> np.ndarray:
    """Length of the common prefix, in values, of each key with the one before it (0 for the first, and where the tree is another)."""
    out = np.zeros(len(keys), np.int64)
    same = keys[1:] == keys[:-1]
    values = same[:, 1:].reshape(len(same), VALUES, 4).all(axis=2)
    out[1:] = np.where(same[:, 0], np.cumprod(values, axis=1).sum(axis=1), 0)
    return out


def cuts(shared: np.ndarray, most: int) -> np.ndarray:
    """Where a region's rows are cut to parts of `most` at most: of the places in the last half of a part, one with the shortest common prefix."""
    out, lo = [0], 0
    while len(shared) - lo > most:
        tail = shared[lo + most // 2 + 1 : lo + most + 1]
        lo += most // 2 + 1 + int(len(tail) - 1 - tail[::-1].argmin())
        out.append(lo)
    return np.array(out)


def _stretches(most: int):
    """Sorted rows (key, doc_id) of one range to rows (block, part, spot, doc_id): its regions, cut to parts of `most` at most.

    Documents alone in a region are left out, but not at the range's ends, where a region may go on. What is held is a batch and some parts.
    """

    def scan(batches):
        keys, docs = np.zeros((0, 1 + 4 * VALUES), np.uint8), np.zeros(0, np.int64)
        base, open_start = TaskContext.get().partitionId() << 40, True

        def regions(stop: int, open_end: bool) -> pa.RecordBatch:
            """The first `stop` rows; a region at an open end may have more documents elsewhere."""
            shared = shared_values(keys[:stop])
            edge = shared < DEPTH
            start, region = np.flatnonzero(edge), np.cumsum(edge) - 1
            size = np.diff(np.r_[start, stop])
            cut = edge.copy()
            for i in np.flatnonzero(size > most).tolist():
                cut[start[i] + cuts(shared[start[i] : start[i] + size[i]], most)] = True
            several = size > 1
            several[0] |= open_start
            several[-1] |= open_end
            head = np.ascontiguousarray(keys[start, : 1 + 4 * DEPTH])
            whole = np.ascontiguousarray(head[:, 1:]).view(U64)
            block = mix(mix(whole[:, 0] ^ (head[:, 0].astype(U64) << U64(32))) + whole[:, 1])
            spot = base + np.arange(stop)
            part = np.maximum.accumulate(np.where(cut, spot, 0))
            kept = several[region]
            return pa.RecordBatch.from_arrays([i64(x[kept]) for x in (block[region], part, spot, docs[:stop])], ["block", "part", "spot", "doc_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys, docs = np.concatenate([keys, more]), np.concatenate([docs, batch.column(1).to_numpy()])
            shared = shared_values(keys)
            stop, going = int(np.flatnonzero(shared < DEPTH)[-1]), False
            if not stop and len(keys) > 4 * most:
                stop, going = int(cuts(shared, most)[-1]), True
            if stop:
                yield regions(stop, going)
                keys, docs, base, open_start = keys[stop:], docs[stop:], base + stop, going
        if len(keys):
            yield regions(len(keys), True)

    return scan


def _groups(batches, key: int = 0):
    """Tables of the rows of each value of the column `key`, by which the rows come sorted."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if values[lo] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _reach(n: int, alike, known: np.ndarray | None = None) -> np.ndarray:
    """Component of each of n items; alike(i, others) tells which of `others` are linked with i.

    Items already reached aren't tested again. `known` names components that are known: an item that is reached brings all of its own.
    """
    label, rest = np.full(n, -1), np.arange(n)
    known = np.arange(n) if known is None else known
    while len(rest):
        root = rest[0]
        found = known[rest] == known[root]
        todo, rest = rest[found].tolist(), rest[~found]
        label[todo] = root
        while todo and len(rest):
            hit = alike(todo.pop(), rest)
            if hit.any():
                hit = np.isin(known[rest], known[rest[hit]])
                label[rest[hit]] = root
                todo.extend(rest[hit].tolist())
                rest = rest[~hit]
    return label


def _candidates(least: float):
    """Links (src, dst) within groups of rows (block, doc_id, signature) in a tree's order, by signatures; neighbours are compared first."""

    def scan(batches):
        for group in _groups(batches):
            docs = group.column("doc_id").to_numpy()
            at = np.sort(np.unique(docs, return_index=True)[1])
            docs = docs[at]
            if len(docs) < 2:
                continue
            sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(group.num_rows, -1)[at]
            need = least * sig.shape[1]
            apart = (sig[1:] == sig[:-1]).sum(axis=1) < need
            label = _reach(len(docs), lambda i, others: (sig[others] == sig[i]).sum(axis=1) >= need, np.r_[0, np.cumsum(apart)])  # noqa: B023
            moved = label != np.arange(len(docs))
            yield pa.RecordBatch.from_arrays([i64(docs[label[moved]]), i64(docs[moved])], ["src", "dst"])

    return scan


def loose(percent: int) -> float:
    """Share of equal signature values from which full sets are compared: the threshold less five standard deviations of the share."""
    same = min(100, percent) / 100
    return max(0.0, same - 5 * math.sqrt(same * (1 - same) / (TREES * VALUES)))


def _regions(reps: DataFrame, trees: int, crowd: int) -> DataFrame:
    """(block, part, spot, doc_id, size, docs): every region of two or more documents, in the order of its tree."""
    count = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spool(reps.select(F.explode(F.slice("orders", 1, trees)).alias("key"), "doc_id"), "orders")
    forest = rows.repartitionByRange(count, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    spots = spool(forest.mapInArrow(_stretches(max(2, crowd // 2)), "block long, part long, spot long, doc_id long"), "spots")
    several = [F.count("*").alias("size"), F.count("*").alias("docs")]
    sizes = spool(spots.groupBy("block").agg(*several).where("size > 1"), "sizes")
    shared = spool(spots.join(sizes, "block"), "shared")
    release(rows, spots, sizes)
    return shared


def _plain(batches):
    """The text of (doc_id, text, others) as lower-cased words with a blank after each."""
    for batch, data, offsets in text_slices(batches):
        data = LOWER[data]
        start, stop, bounds = words(data, offsets)
        raw, place = joined_words(data, start, stop)
        edges = place[bounds].tolist()
        parts = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(3), batch.column(4), pa.array(parts, pa.binary())], ["block", "doc_id", "size", "docs", "members"])


def exact_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the different shingles of each text (words with a blank after each), text by text, and where each text's begin.

    Equal numbers are equal shingles: they are made of the words, not of hashes. A text of fewer than `size` words is one shingle.
    """
    vocabulary: dict[bytes, int] = {}
    split = [t.split(b" ")[:-1] for t in texts]
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in split for w in ws), np.int64)
    counts = np.array([len(ws) for ws in split], np.int64)
    edges = np.r_[0, np.cumsum(counts)]
    doc = np.repeat(np.arange(len(texts)), counts)
    begin = np.flatnonzero(np.arange(len(ids)) + size <= edges[1:][doc]) if len(ids) else np.zeros(0, np.int64)
    width = max(1, len(vocabulary).bit_length())
    code, bits = ids[begin], width
    for j in range(1, size):
        if bits + width > 62:
            code = np.unique(code, return_inverse=True)[1]
            bits = max(1, int(code.max(initial=0)).bit_length())
        code, bits = code << width | ids[begin + j], bits + width
    code = np.unique(code, return_inverse=True)[1]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole: dict[tuple, int] = {}
    top = len(code)
    owner = np.r_[doc[begin], short]
    code = np.r_[code, np.array([top + whole.setdefault(tuple(split[i]), len(whole)) for i in short.tolist()], np.int64)]
    by = np.lexsort((code, owner))
    owner, code = owner[by], code[by]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[first], np.searchsorted(owner[first], np.arange(len(texts) + 1))


def linked(texts: list[bytes], shingle: int, percent: int) -> np.ndarray:
    """Index of the component of each text under 100 * intersection >= percent * union of their sets of shingles."""
    ids, start = exact_sets(texts, shingle)
    size, start = np.diff(start), start[:-1]
    mark = np.zeros(len(ids) and int(ids.max()) + 1, bool)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        fits = np.flatnonzero((100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])) & (size[others] > 0))
        if not len(fits):
            return out
        mine = ids[start[i] : start[i] + size[i]]
        mark[mine] = True
        for lo in range(0, len(fits), 256):
            part = others[fits[lo : lo + 256]]
            length = size[part]
            edges = np.cumsum(length) - length
            flat = mark[ids[np.arange(length.sum()) + np.repeat(start[part] - edges, length)]]
            both = np.add.reduceat(flat, edges, dtype=np.int64)
            out[fits[lo : lo + 256]] = 100 * both >= percent * (size[i] + length - both)
        mark[mine] = False
        return out

    return _reach(len(texts), alike)


def _links(shingle: int, percent: int):
    def scan(batches):
        for group in _groups(batches):
            docs = group.column("doc_id").to_numpy()
            label = linked(group.column("members").to_pylist(), shingle, percent)
            least = np.full(len(docs), np.iinfo(np.int64).max)
            np.minimum.at(least, label, docs)
            yield pa.RecordBatch.from_arrays([i64(least[label]), i64(docs)], ["src", "dst"])

    return scan


def _link(members: DataFrame, payload: str, scan, crowd: int) -> DataFrame:
    """(src, dst) links within each block of members (block, part, spot, doc_id, size, docs, payload). scan links the rows of whole groups, which come sorted by spot.

    size is what a block weighs, docs how many documents it has. Blocks that weigh more than `crowd` are linked without a task that holds a whole one, and no pair
    is left out: each comes in parts of about half of that, and a few pivots go to every part. Links within parts, with pivots and in small blocks join most
    of a block of copies to one component, its main. Pairs within the main need no test any more. What is outside it (the
    rest) is cut to bounded pieces, and each piece meets each part of the block, the rest's own parts included.
    """
    count = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(rows: DataFrame) -> DataFrame:
        dealt = rows.select("block", "doc_id", payload, "spot").repartition(count, "block").sortWithinPartitions("block", "spot")
        return dealt.select("block", "doc_id", payload).mapInArrow(scan, "src long, dst long")

    links, large = spool(compare(members.where(F.col("size") <= crowd)), "links"), members.where(F.col("size") > crowd)
    large = spool(large, "large")
    if large.isEmpty():
        return links
    half = max(2, crowd // 2)
    parts = spool(large.select("block", "part").distinct(), "parts")
    pivots = large.where(F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.col("docs")) < 16).drop("part").join(parts, "block")
    meet = large.unionByName(pivots).dropDuplicates(["block", "part", "doc_id", payload])
    first = spool(compare(meet.withColumn("block", F.xxhash64("block", "part"))), "links")
    known = large.select("block", "doc_id").distinct().join(components(first.union(links)).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    main = known.groupBy("block", "component").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = spool(known.join(main, "block").where("component != main").select("block", "doc_id"), "outside")
    share = F.count("*") * F.max("size") / F.max("docs")  # what the rest weighs, were its documents like the others
    sized = outside.join(large.select("block", "size", "docs").distinct(), "block").groupBy("block").agg(F.ceil(share / half).cast("int").alias("pieces"))
    rest = large.join(outside, ["block", "doc_id"], "left_semi").join(sized, "block")
    piece = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.col("pieces")).cast("int")
    left = rest.withColumn("piece", piece).drop("part").join(parts, "block")
    right = large.join(sized, "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    columns = ["block", "part", "piece", "doc_id", payload, "spot"]
    pairs = left.select(columns).union(right.select(columns)).dropDuplicates(["block", "part", "piece", "doc_id", payload])
    second = spool(compare(pairs.withColumn("block", F.xxhash64("block", "part", "piece"))), "links")
    release(parts, outside, large)
    return links.union(first).union(second)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked if 100 * intersection >= percent * union of their shingle sets.

    Words are lower-cased (A-Z) runs without blanks; fewer than `shingle` words make one shingle. Null and empty texts have
    no shingles and no link. A text of any length is one set, made in one task. component_id is the smallest doc_id reachable over links, kept marks it. Rows that share a
    doc_id are one node with several sets; each row is returned. Rows without doc_id are returned unlinked (component null, kept). Other columns are ignored; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = spool(docs.mapInArrow(_sketch(shingle), SKETCH), "sketch")
    known = sketch.where("doc_id is not null and n_shingles > 0")
    classes = spool(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    heads = known.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "n_shingles"), ["doc_id", "k1", "k2", "n_shingles"], "left_semi")
    heads = spool(heads.select("doc_id", "signature", "orders"), "heads")
    regions = _regions(heads, trees, crowd)
    spots = regions.join(heads.select("doc_id", "signature"), "doc_id")
    near = spool(_link(spots, "signature", _candidates(loose(percent)), crowd).distinct(), "near")
    release(regions, heads)
    blocks = components(near)
    # a block weighs its documents, or its shingles by SHINGLES if that is more
    weights = blocks.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sizes = weights.groupBy("component").agg(F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / SHINGLES)).alias("size"), F.count("*").alias("docs"))
    placed = blocks.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("block"), "size", "docs")
    members = docs.join(placed.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "block", "size", "docs")
    members = spool(members.mapInArrow(_plain, "block long, doc_id long, size long, docs long, members binary"), "members")
    part = F.pmod(F.xxhash64("block", "doc_id"), F.ceil(F.col("size") / max(2, crowd // 2)))
    links = spool(_link(members.withColumn("part", part).withColumn("spot", F.col("doc_id")), "members", _links(shingle, percent), crowd), "links")
    release(near, members)
    same = components(links)
    found = classes.join(same.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(found, ["k1", "k2", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
