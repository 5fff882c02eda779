"""Operator 1, language identification by hierarchical discrimination.

A text is first assigned to a language family, then to a language of that family; both steps are votes of one-versus-one
linear support vector machines over frequencies of byte trigrams. A family of one language needs no second step, and a
single family no first.

Families are named for the codes in FAMILIES; any other language is a family of its own, as long as there are no more than MOST_FAMILIES.
Beyond that, languages without a named family are grouped by their mean frequencies, so that L languages need about L ** 1.5 machines.

Features: the lower-cased text as UTF-8, everything but letters turned to blanks, each three consecutive bytes
hashed to one of DIM places; frequencies are divided by the places' spread over the training rows. The decisions are
linear, so a whole text is scored by sums of looked-up weights, without a histogram, and only by the machines of its family.

Training takes at most about `per_language` labelled rows of each language, and about `most_rows` of all, chosen by a hash of doc_id; every
language takes part. The rows reach the driver as frequencies (16 KB each); each machine is then trained by a task. Prediction
reads the text and nothing else.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_slices

DIM, PER_LANGUAGE, MOST_ROWS, MOST_FAMILIES = 1 << 12, 400, 16_000, 32
#: Families of ISO 639-1 codes; a language that isn't named makes a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(data: np.ndarray) -> np.ndarray:
    """Place in [0, DIM) of the trigram that begins at each byte but the last two."""
    b = _CLASS[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - 12)).astype(np.int32)


def _lower(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with one more column, its text (the second) between blanks and lower-cased."""
    text = pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
    blank = pa.scalar(" ", pa.large_string())
    return batch.append_column("lower", pc.binary_join_element_wise(blank, text, blank, pa.scalar("", pa.large_string())))


def _histograms():
    def scan(batches):
        for batch, data, offsets in text_slices(map(_lower, batches), 2):
            place = features(data)
            rows = []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                counts = np.bincount(place[lo : max(lo, hi - 2)], minlength=DIM)
                rows.append((counts / max(1, counts.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])

    return scan


def train_pair(x: np.ndarray, sign: np.ndarray, rounds: int = 200, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge loss, each side weighing the same) by accelerated gradient steps."""
    n, d = x.shape
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    rate = 1 / (2 * strength * float((weight * (np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1)).sum()) + 1e-3)
    w, b, pw, pb = np.zeros(d), 0.0, np.zeros(d), 0.0
    for i in range(rounds):
        m = i / (i + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        gap = np.maximum(0, 1 - sign * (x @ vw.astype(x.dtype) + vb)) * weight * sign * 2 * strength
        pw, pb = w, b
        w, b = vw + rate * (gap.astype(x.dtype) @ x - 1e-3 * vw), vb + rate * gap.sum()
    return w, b


def families(langs: list[str], means: np.ndarray) -> dict[str, str]:
    """Family of each language; languages without a named one share families, by the cosine of their means, if there were more than MOST_FAMILIES."""
    out = {x: family_of(x) for x in langs}
    alone = [i for i, x in enumerate(langs) if out[x] == x]
    room = max(1, MOST_FAMILIES - len({f for x, f in out.items() if f != x}))
    if len(alone) <= room:
        return out
    unit = means[alone] / np.maximum(np.linalg.norm(means[alone], axis=1, keepdims=True), 1e-30)
    heads, close = [0], unit @ unit[0]
    while len(heads) < room:  # the language that is least like any head is the next one
        heads.append(int(close.argmin()))
        close = np.maximum(close, unit @ unit[heads[-1]])
    for i, head in zip(alone, (unit @ unit[heads].T).argmax(axis=1), strict=True):
        out[langs[i]] = langs[alone[heads[head]]]
    return out


class Model:
    """Machines as (group, i, j), group -1 for families, with weights and offsets. names: families; langs: those of each family."""

    def __init__(self, names: list[str], langs: list[list[str]], machines: list[tuple[int, int, int]], tables: np.ndarray, offsets: np.ndarray):
        self.names, self.langs, self.tables, self.offsets = names, langs, tables, offsets
        self.of_group: dict[int, list[tuple[int, int, int]]] = {}
        for c, (g, i, j) in enumerate(machines):
            self.of_group.setdefault(g, []).append((c, i, j))

    def margins(self, data: np.ndarray, offsets: np.ndarray, machines: list[int], rows: np.ndarray) -> np.ndarray:
        """Margin of each of the machines (column) for each of the texts `rows` (row)."""
        place = np.append(features(data), np.zeros(min(2, len(data)) + 1, np.int32))
        n = np.diff(offsets)[rows]
        out = np.zeros((len(n), len(machines)))
        full = np.flatnonzero(n > 2)
        if len(full):
            # pairs of bounds, so that places between the texts aren't summed
            edges = np.stack([offsets[rows[full]], offsets[rows[full] + 1] - 2], axis=1).ravel()
            for c, machine in enumerate(machines):
                out[full, c] = np.add.reduceat(self.tables[machine][place], edges, dtype=np.float64)[::2] / (n[full] - 2) + self.offsets[machine]
        return out

    def decide(self, data: np.ndarray, offsets: np.ndarray, group: int, size: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the group's votes on the texts `rows` (ties: the larger sum of margins, then the first) and the probability given to it."""
        machines = self.of_group.get(group, [])
        margins = self.margins(data, offsets, [c for c, _, _ in machines], rows)
        n = len(rows)
        votes, total = np.zeros((n, size)), np.zeros((n, size))
        for c, (_, i, j) in enumerate(machines):
            first = margins[:, c] >= 0
            votes[:, i] += first
            votes[:, j] += ~first
            total[:, i] += margins[:, c]
            total[:, j] -= margins[:, c]
        best = (votes + np.tanh(total) * 0.49).argmax(axis=1)
        least = np.full(n, np.inf)
        for c, (_, i, j) in enumerate(machines):
            least = np.where(best == i, np.minimum(least, margins[:, c]), np.where(best == j, np.minimum(least, -margins[:, c]), least))
        return best, 1 / (1 + np.exp(-np.clip(4 * least, -60, 60)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self.decide(data, offsets, -1, len(self.names), np.arange(len(offsets) - 1))
        langs = np.empty(len(family), object)
        for g in np.unique(family).tolist():
            rows = np.flatnonzero(family == g)
            best, p = self.decide(data, offsets, g, len(self.langs[g]), rows)
            langs[rows] = np.array(self.langs[g], object)[best]
            score[rows] *= p
        return langs, score


def train(spark: SparkSession, x: np.ndarray, langs: list[str]) -> Model:
    """Machines for the training rows x, which are scaled in place: the driver's largest object. Each machine is one task's row."""
    lang = np.array(langs)
    known = sorted(set(langs))
    family = families(known, np.array([x[lang == v].mean(axis=0) for v in known]))
    names = sorted(set(family.values()))
    members = [sorted(v for v in known if family[v] == f) for f in names]
    spread = np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x))
    scale = (np.where(spread > 0, 1 / np.maximum(spread, 1e-4), 0) / np.sqrt(DIM)).astype(np.float32)
    x *= scale
    pairs = [(-1, i, j) for i, j in itertools.combinations(range(len(names)), 2)]
    pairs += [(g, i, j) for g, own in enumerate(members) for i, j in itertools.combinations(range(len(own)), 2)]
    # for both steps, the number of each row's class
    step = np.array([names.index(family[v]) for v in known])[np.searchsorted(known, lang)]
    own = np.array([members[names.index(family[v])].index(v) for v in known])[np.searchsorted(known, lang)]
    held = spark.sparkContext.broadcast((x, step, own))

    def machines(batches):
        x, step, own = held.value
        for batch in batches:
            rows = []
            for g, i, j in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                kind = step if g < 0 else np.where(step == g, own, -1)
                chosen = np.flatnonzero((kind == i) | (kind == j))
                w, b = train_pair(x if len(chosen) == len(x) else x[chosen], np.where(kind[chosen] == i, 1.0, -1.0))
                rows.append((w.astype(np.float32).tobytes(), b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w for w, _ in rows], pa.binary()), pa.array([float(b) for _, b in rows], pa.float64())], ["g", "i", "j", "w", "b"])

    trained = []
    if pairs:
        tasks = min(len(pairs), int(spark.conf.get("spark.sql.shuffle.partitions")))
        todo = spark.createDataFrame(pairs, "g int, i int, j int").repartition(tasks)
        trained = sorted(todo.mapInArrow(machines, "g int, i int, j int, w binary, b double").collect(), key=lambda r: (r.g, r.i, r.j))
    held.destroy()
    tables = np.array([np.frombuffer(bytes(r.w), np.float32) * scale for r in trained], np.float32).reshape(-1, DIM)
    return Model(names, members, [(r.g, r.i, r.j) for r in trained], tables, np.array([r.b for r in trained]))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    """Fits on at most about per_language rows for each lang of labelled (doc_id, text, lang), and most_rows of all langs; None if there are no rows."""
    spark = prepare(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min(place).alias("least")).collect()
    if not counts:
        return None
    wanted = min(per_language, max(2, most_rows // len(counts)))
    # one row a language: the first in the order of the hash is always taken, so none is left out
    rate = spark.createDataFrame([(r["lang"], max(r["least"] + 1.0, 1e6 * min(1.0, wanted / r["rows"]))) for r in counts], "lang string, below double")
    chosen = rows.join(F.broadcast(rate), "lang").where(place < F.col("below"))
    got = chosen.select("lang", "text").mapInArrow(_histograms(), "lang string, x binary").toArrow().combine_chunks().sort_by([("lang", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return None
    x = np.empty((got.num_rows, DIM), np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), "<f4")
    langs = got.column("lang").to_pylist()
    del got
    return train(spark, x, langs)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to docs (doc_id, text and any others but these): `und` and 0 where the text is null or has no letter, or nothing was learned."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in docs.columns if c not in ("doc_id", "text", "lang_pred", "score")])
    width = len(docs.columns)
    held = spark.sparkContext.broadcast(model)

    def scan(batches):
        model = held.value
        for batch, data, offsets in text_slices(map(_lower, batches), width):
            letters = np.asarray(pc.match_substring_regex(batch.column(width), r"\p{L}"))
            if model is None:
                langs, score = np.full(len(letters), "und", object), np.zeros(len(letters))
            else:
                langs, score = model.predict(data, offsets)
                langs[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(langs.tolist(), pa.string()), pa.array(score)], [*batch.schema.names[:width], "lang_pred", "score"])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(column: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its doc_id as text, modulo 5, is 0 (null doc_ids aren't)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang), learned from those not held out.

    Null texts and those without a letter are `und` with score 0, whatever their length else; a long text is one row, scored whole. Rows with a null lang
    or doc_id are predicted like others. An empty table gives an empty result; other columns are ignored; repeated rows are predicted each. Ties
    go to the language with the larger sum of margins, then to the first by name.
    """
    model = fit(docs.where(~held_out()), per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
