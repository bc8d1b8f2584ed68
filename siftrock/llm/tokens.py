"""Encoding of whole texts with the tokenizers library, by cached parts; the ids are those of a plain call of the library.

Most of a corpus is repeated words, and the library spends its time on each of them anew. Where a
tokenizer's pre-tokenizer always breaks at certain spaces, a text's ids are those of the parts between
them, one after another; each worker keeps the ids of parts it has met lately, within a bound of bytes. A new part that is a plain word,
perhaps with sentence marks, or two such around a line feed, falls into pre-tokens in one way only, and
these go straight to the library's model; any other new part goes through the whole library. A text that may
hold a special token's string goes through the library whole, which makes that string the token's id.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: "dropped": white space never reaches a token and letters are lower-cased, so any ASCII space or line feed is a border.
#: "leading": a space before a visible character always opens a token. "whole": no such border is known.
#: Both rules take runs of letters, and runs of marks, as pre-tokens of byte-level models.
SPACE_RULES = ("dropped", "leading", "whole")
_LEADING = re.compile(r" (?=\S)")
_WORD, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"  # the apostrophe opens pre-tokens of its own
_PLAIN = re.compile(f"({_WORD})({_MARKS})?(?:(\n)({_WORD})({_MARKS})?)?")
#: Bytes that a kept part takes beside its characters, about: two objects and a place in a table.
ENTRY_BYTES = 190
_cache: dict[tuple, PieceEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Known(dict):
    """Ids by part; a part that isn't there is encoded and, if short, kept, until all take ``keep_bytes``. What is met first is mostly what
    is met often. When more than half of the parts of late weren't there, all are forgotten and others take their place."""

    def __init__(self, tokenizer, spaces: str, code: str, keep_bytes: int):
        super().__init__()
        self.tokenizer, self.tokenize, self.code, self.keep_bytes = tokenizer, tokenizer.model.tokenize, code, keep_bytes
        self.prefix, self.lower = " " if spaces == "leading" else "", spaces == "dropped"
        self.letters, self.inner, self.held, self.missed = byte_letters(), {}, 0, 0

    def turn(self, parts: int) -> None:
        """After a batch of so many parts."""
        if self.held >= self.keep_bytes and self.missed > parts // 2:
            self.clear()
            self.inner.clear()
            self.held = 0
        self.missed = 0

    def keep(self, table: dict, part: str, ids: bytes) -> bytes:
        if len(part) <= 32 and self.held < self.keep_bytes:
            table[part] = ids
            self.held += ENTRY_BYTES
        return ids

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token."""
        form = (text.lower() if self.lower else text).encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(form)]).tobytes()

    def later(self, text: str) -> bytes:
        """Those of a pre-token that opens no part: marks, and words after a line feed."""
        ids = self.inner.get(text)
        return self.keep(self.inner, text, self.piece(text)) if ids is None else ids

    def __missing__(self, part: str) -> bytes:
        self.missed += 1
        found = _PLAIN.fullmatch(part)
        if found is None:
            return self.keep(self, part, self.whole(self.prefix + part))
        first, *rest = found.groups()
        rest = [x for x in rest if x is not None]
        return self.keep(self, part, self[first] + b"".join(map(self.later, rest)) if rest else self.piece(self.prefix + first))


class PieceEncoder:
    def __init__(self, path: str, spaces: str = "whole", keep_bytes: int = 160_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if spaces not in SPACE_RULES:
            raise ValueError(f"spaces must be one of {SPACE_RULES}")
        self.spaces, self.tokenizer = spaces, Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known = Known(self.tokenizer, spaces, self.dtype.char, keep_bytes)

    def encode_one(self, text: str) -> bytes:
        get = self.known.__getitem__
        if self.spaces == "whole" or self.special is not None and self.special.search(text):
            return self.known.whole(text)
        if self.spaces == "dropped":
            if text.isascii():
                text = text.lower()  # as the tokenizer would; beyond ASCII that is left to it
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        first, *parts = _LEADING.split(text)
        return self.known.whole(first) + b"".join(map(get, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned integers of ``dtype``."""
        out = [self.encode_one(t) for t in texts]
        self.known.turn(sum(t.count(" ") + 1 for t in texts))
        return out


def encoder(path: str, spaces: str) -> PieceEncoder:
    """This worker's encoder. A worker keeps one only, so that what it holds is bounded by one encoder's ``keep_bytes``."""
    if (path, spaces) not in _cache:
        _cache.clear()
        _cache[path, spaces] = PieceEncoder(path, spaces)
    return _cache[path, spaces]

