"""Whole-text encoding by a tokenizers file, with ids kept for words seen before.

Texts are cut at blanks, where these tokenizers never join anything: their normaliser turns blanks to one and their
pre-tokenizer drops them. cut_safe() verifies that of a file; other files are encoded text by text.
"""

import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words kept in a worker; when full, all are dropped and kept anew.
KEPT = 600_000


def cut_safe(spec: dict) -> bool:
    """Whether a tokenizer of this specification encodes a text as its blank-separated words one after the other."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = pre and pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
    blanks = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} for s in steps)
    plain = all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in steps)
    whole = spec.get("post_processor") is None and all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return bool(drops and blanks and plain and whole and pre[1].get("add_prefix_space") is False)


class WordTokenizer:
    _by_path: dict = {}

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            self.safe = cut_safe(json.load(f))
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, letters: str) -> bytes:
        """Ids of lower-case ASCII letters, one pre-token: the library's model alone."""
        found = self.cores.get(letters)
        if found is None:
            if len(self.cores) >= KEPT:
                self.cores.clear()
            found = self.cores[letters] = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a word: its ASCII letters by the model, what stands around them or any other word by the whole library."""
        if word.isascii():
            if word.isalpha():
                return self._core(word.lower())
            stem = word.rstrip(".,;:!?")
            if stem.isalpha():
                return self._core(stem.lower()) + self._tail(word[len(stem) :])
        return self._whole(word)

    def _tail(self, marks: str) -> bytes:
        found = self.cores.get(marks)
        if found is None:
            found = self.cores[marks] = self._whole(marks)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, equal to the library's with add_special_tokens=False."""
        if not self.safe or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return np.frombuffer(self._whole(text), "<u4")
        words, known = text.split(), self.words
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), "<u4")
        except KeyError:
            pass
        if len(known) >= KEPT:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")
