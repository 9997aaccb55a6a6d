"""Ids of texts from the word-BPE tokenizer, encoding each piece of text once.

Its pieces never cross white space. Where a text has only code points up to U+00FF and no special token, normalising is
lower-casing; each new stretch between white space is cut into the pre-tokenizer's pieces by a plain pattern, and the
library's model encodes each new piece. Other texts are cut at white space and the library encodes each new word whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What Unicode calls white space. str.split() also splits at U+001C to U+001F.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer's rule for lower-cased text up to U+00FF: letters, one digit, contractions, anything else.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{_LETTERS}{_DIGITS}]+")
_WORDS, _ODD, _WIDE = re.compile(f"[^{SPACE}]+"), re.compile("[\x1c-\x1f]"), re.compile("[^\0-\xff]|<\\|")


def words(text: str) -> list[str]:
    return _WORDS.findall(text) if _ODD.search(text) else text.split()


class _Known(dict):
    """What encode gave for each key; at most `most` keys of at most 64 characters are kept."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, key: str) -> bytes:
        out = self.encode(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class WordEncoder:
    _made: dict[int, WordEncoder] = {}

    def __init__(self, model: str, most: int = 600_000):
        from tokenizers import Tokenizer

        from tidemark.llm.bpe import byte_letters

        whole = Tokenizer.from_str(model)
        whole.no_padding()
        whole.no_truncation()
        core, letter = whole.model, {b: c for c, b in byte_letters().items()}
        self.vocab_size = max(whole.get_vocab(with_added_tokens=True).values()) + 1
        self.width = width = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        packed = lambda ids: np.array(ids, width).tobytes()
        self.pieces = _Known(lambda p: packed([t.id for t in core.tokenize(p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(letter))]), most)
        self.stretches = _Known(lambda w: b"".join(map(self.pieces.__getitem__, _PIECES.findall(w))), most)
        self.words = _Known(lambda w: packed(whole.encode(w, add_special_tokens=False).ids), most)

    @classmethod
    def of(cls, model: str) -> WordEncoder:
        """One for each model in a worker, as workers are used for many tasks."""
        if (key := hash(model)) not in cls._made:
            cls._made = {key: cls(model)}
        return cls._made[key]

    def encode(self, text: str) -> bytes:
        """The text's ids, width bytes each."""
        if not text.isascii() and _WIDE.search(text) or "<|" in text:
            return b"".join(map(self.words.__getitem__, words(text)))
        return b"".join(map(self.stretches.__getitem__, words(text.lower())))
