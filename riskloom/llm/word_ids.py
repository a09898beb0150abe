"""Ids of whole texts for vocabularies that drop white space, with a memo of words.

Such a vocabulary never joins characters across white space, so a text's ids
are its words' ids in a row; a word met before costs one dictionary look-up.
Plain words are split once more, into letters and the marks behind them.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Letters whose lower-casing and composition need no table, then closing marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Byte-level vocabularies write a byte that can't be shown as the next character from 256 on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = dict(zip(sorted(set(range(256)) - SHOWN), map(chr, range(256, 512))))
MEMO_WORDS = 1_200_000
LONG_WORD = 64
_ENCODERS: dict = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> "WordEncoder":
    """The worker's encoder for a vocabulary file; its memo lives as long as the worker."""
    if (path, memo_words) not in _ENCODERS:
        _ENCODERS[path, memo_words] = WordEncoder(path, memo_words)
    return _ENCODERS[path, memo_words]


class _Words(dict):
    """Serialized ids by word; a word that is missing is encoded, and kept unless it is very long."""

    def __init__(self, owner: "WordEncoder") -> None:
        self.owner = owner

    def __missing__(self, word: bytes) -> bytes:
        found = self.owner.encode_word(word.decode())
        if len(word) <= LONG_WORD:
            if len(self) >= self.owner.memo_words:
                self.clear()
            self[word] = found
        return found


class WordEncoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)["normalizer"]["normalizers"]
        if not any(p.get("pattern") == {"Regex": "\\s+"} and p.get("content") == " " for p in parts):
            raise ValueError("this vocabulary keeps white space: words cannot be encoded one by one")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo_words = memo_words
        self.words = _Words(self)
        self.runs: dict[str, bytes] = {}

    def _pieces(self, run: str) -> bytes:
        """Ids of lower-case letters, or of marks, that form one pre-token: the model alone is asked."""
        shown = run.encode().decode("latin-1").translate(BYTE_SIGNS)
        found = array(self.code, [x.id for x in self.model.tokenize(shown)]).tobytes()
        if len(self.runs) >= self.memo_words:
            self.runs.clear()
        if len(run) <= LONG_WORD:
            self.runs[run] = found
        return found

    def encode_word(self, text: str) -> bytes:
        """Serialized ids of text without white space."""
        plain = PLAIN.fullmatch(text)
        if not plain:
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        letters, marks = plain[1].lower(), plain[2]
        runs = self.runs
        found = runs.get(letters) or self._pieces(letters)
        return found + (runs.get(marks) or self._pieces(marks)) if marks else found

    def serialized(self, texts: list[str | None]):
        """Yield each text's ids as little-endian bytes; nulls count as empty."""
        get = self.words.__getitem__
        for text in texts:
            yield b"".join(map(get, (text or "").encode().split()))

    def ids(self, texts: list[str | None], end_id: int | None = None):
        """Yield each text's ids as an array, followed by ``end_id``."""
        tail = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        for data in self.serialized(texts):
            yield np.frombuffer(data + tail, self.kind)
