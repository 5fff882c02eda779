"""Operator 5, SentencePiece encoding and decoding by an Aho-Corasick automaton that drives a single-pass Viterbi search.

The model file's pieces are the automaton's patterns. The automaton reads a text once; at each position the output links name every piece
that ends there, and each relaxes the best score of a segmentation up to that position. The best path back gives the pieces.

The score of a segmentation is the sum of its pieces' scores in the model file, and the segmentation returned is the one with the highest;
ties go to the longer last piece. A character that no piece has is spelled as its UTF-8 bytes, at a score below all
pieces. Ties and bytes apart, that is the library's rule for unigram models. For BPE models (the public file is one) the library
merges greedily instead, so its ids may differ from these; decoding is the same for both and gives back the text.

No piece of such a file goes on past a blank, so a text is cut before each run of blanks that follows other characters: scores add up, so the
best paths of the cuts make the best path of the text. Cuts seen before are looked up.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

BLANK = "▁"
#: Words and cuts kept in a worker; when full, all are dropped and kept anew.
KEPT = 150_000
PLAIN, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """Pieces, scores and kinds of a model file, with the automaton over them."""

    _by_path: dict = {}

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._by_path:
            cls._by_path[path] = cls.load(path)
        return cls._by_path[path]

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = []
        for i in range(sp.get_piece_size()):
            kind = BYTE if sp.is_byte(i) else CONTROL if sp.is_control(i) else UNKNOWN if sp.is_unknown(i) else PLAIN
            rows.append((sp.id_to_piece(i), sp.get_score(i), kind))
        return cls(rows)

    def __init__(self, rows: list[tuple[str, float, int]]):
        import ahocorasick

        self.rows = rows
        self.automaton = ahocorasick.Automaton()
        plain = [(p, s, i) for i, (p, s, kind) in enumerate(rows) if kind == PLAIN]
        for piece, score, i in plain:
            self.automaton.add_word(piece, (len(piece), score, i))
        if plain:
            self.automaton.make_automaton()
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(rows) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(rows) if kind == UNKNOWN), 0)
        self.lowest = min((s for _, s, _ in plain), default=0.0) - 10
        self.cuts_hold = not any(BLANK in p.lstrip(BLANK) for p, _, _ in plain)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        values = {i: p.replace(BLANK, " ").encode() for p, _, i in plain} | {i: bytes([v]) for v, i in self.bytes.items()}
        self.values = [values.get(i, b"") for i in range(len(rows))]

    def spell(self, character: str) -> list[int]:
        """Ids of a character that no piece has."""
        raw = character.encode()
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation; blanks are written as BLANK."""
        n = len(text)
        if not n:
            return []
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        at = 0  # positions up to this one have their final score

        def finish(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                score = best[at - 1] + self.lowest
                if best[at] is None or back[at][0] > 1 and best[at] < score:
                    best[at], back[at] = score, (1, -1)

        for end, (length, score, i) in self.automaton.iter(text) if len(self.automaton) else ():
            finish(end)
            begin = end + 1 - length
            total = best[begin] + score
            if best[end + 1] is None or total > best[end + 1] or total == best[end + 1] and length > back[end + 1][0]:
                best[end + 1], back[end + 1] = total, (length, i)
        finish(n)
        out, at = [], n
        while at:
            length, i = back[at]
            out.append([i] if i >= 0 else self.spell(text[at - length : at]))
            at -= length
        return [i for ids in reversed(out) for i in ids]

    def _word(self, word: str) -> bytes:
        """Ids of a word and the one blank before it."""
        found = np.array(self.segment(BLANK + word), "<u4").tobytes()
        if len(word) <= 64 and self.cuts_hold and BLANK not in word:
            if len(self.words) >= KEPT:
                self.words.clear()
            self.words[word] = found
        return found

    def _cut(self, cut: str) -> bytes:
        found = self.known.get(cut)
        if found is None:
            found = np.array(self.segment(cut), "<u4").tobytes()
            if len(cut) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[cut] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: a blank is put before it, as the library does, if it isn't empty."""
        if not text:
            return np.zeros(0, "<u4")
        try:  # all words known, single blanks between them
            known = self.words
            return np.frombuffer(b"".join([known[w] for w in text.split(" ")]), "<u4")
        except KeyError:
            pass
        text = text.replace(" ", BLANK)
        if not self.cuts_hold:
            return np.array(self.segment(BLANK + text), "<u4")
        out, blanks = [], BLANK
        for word in text.split(BLANK):  # an empty word is one more blank
            if word and blanks is BLANK:
                out.append(self.words.get(word) or self._word(word))
            elif word:
                out.append(self._cut(blanks + word))
                blanks = BLANK
            else:
                blanks += BLANK
        if len(blanks) > 1:
            out.append(self._cut(blanks[:-1]))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The text of ids; the blank put before it is taken off, ids of control pieces and beyond the file give nothing."""
        values, n = self.values, len(self.values)
        raw = b"".join([values[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids) if 0 <= i < n])
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encode(path: str):
    def scan(batches):
        pieces = Pieces.of(path)
        for batch in batches:
            ids = [pieces.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return scan


def _decode(path: str):
    def scan(batches):
        pieces = Pieces.of(path)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            texts = [pieces.decode(np.frombuffer(x, "<u4")) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_crc32", "decoded"])

    return scan


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text); ids are little-endian 32-bit integers. Null texts are empty. Repeated rows are encoded each."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded) of encode()'s rows."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(path), "doc_id long, n_tokens long, ids_crc32 long, decoded string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256): each whole text encoded, and the SHA-256 of what its ids decode to.

    Null texts are empty; repeated rows, and rows that share a doc_id or have none, are encoded each; a text of any length is encoded whole, in one
    task; of segmentations with one score the first found, that of the longest last piece, is taken. Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def scan(batches):
        # both passes in one worker, so that a task holds the pieces once
        for batch in _decode(path)(_encode(path)(batches)):
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()]
            yield batch.set_column(3, "decoded_sha256", pa.array(digests, pa.string()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
