"""Token ids of a public byte-level BPE, by the tokenizers library.

The pre-tokenizer cuts a text into pieces that are merged on their own, so the ids of a text are
those of its pieces in order. The encoder asks the library for each distinct piece and keeps a
memo, bounded in entries and in a piece's length; texts with characters on which regular expression engines may differ, or with a
special token's string, go to the library whole. So do all texts where the library's own pre-tokenizer
isn't the byte-level one with that pattern, or where it normalises texts first.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, filterfalse
from operator import itemgetter

import numpy as np

#: The pre-tokenizer's pattern for texts that ODD accepts, whose letters are these.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s\w]+|\s+(?!\S)|\s+")
#: Characters outside: whole text to the library. ASCII without underscore and separators, Latin letters, common punctuation.
ODD = re.compile(r"[^\t\n\r\x20-\x5e\x60-\x7e¡§©«»¿À-ɏ–—‘-„…€]")
#: Entries of the memo, and characters of a piece that is kept in it.
MEMO, LONGEST = 700_000, 64

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.by_pieces = self._cuts_as_expected()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the byte alphabet's space

    def _cuts_as_expected(self) -> bool:
        """Whether PIECES is this tokenizer's way to cut: by what it says of itself, and on a sample."""
        cut = self.library.pre_tokenizer
        if type(cut).__name__ != "ByteLevel" or cut.add_prefix_space or not cut.use_regex or self.library.normalizer is not None:
            return False
        sample = "It's 12 o'clock: we'll  see\n\n what\tthe naïve \u2013 café (50%) did... 'Tis!"
        return [a for _, a in cut.pre_tokenize_str(sample)] == [m.span() for m in PIECES.finditer(sample)]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        spaced, others = [], []
        for p in pieces:
            (spaced if p[0] == " " and p[-1].isalpha() else others).append(p)  # a piece of letters ends in one
        if spaced:  # side by side they stay pieces of their own, and only a first id holds the space
            ids = np.array(self.library.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, "<u4")
            self._keep(spaced, ids, np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        if others:
            encoded = self.library.encode(others, is_pretokenized=True, add_special_tokens=False)
            of = np.array(encoded.word_ids, np.int64)
            self._keep(others, np.array(encoded.ids, "<u4"), np.searchsorted(of, np.arange(len(others) + 1)))

    def _keep(self, pieces: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        raw, memo, at = ids.tobytes(), self.memo, (cuts * 4).tolist()
        if len(at) != len(pieces) + 1:
            raise ValueError("the vocabulary doesn't cut text at spaces")
        for piece, a, b in zip(pieces, at, at[1:]):
            memo[piece] = raw[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null gives none."""
        cut = [
            None if not text or not self.by_pieces or ODD.search(text) or any(s in text for s in self.special) else PIECES.findall(text)
            for text in texts
        ]
        every = chain.from_iterable(filter(None, cut))
        lacking = set(filterfalse(self.memo.__contains__, every))
        if len(self.memo) + len(lacking) > MEMO:
            self.memo.clear()
            lacking = set().union(*filter(None, cut))
        if lacking:
            self._learn(list(lacking))
        out = [
            (b"".join(itemgetter(*pieces)(self.memo)) if len(pieces) > 1 else self.memo[pieces[0]])
            if pieces is not None else self.whole(text) if text else b""
            for text, pieces in zip(texts, cut)
        ]
        for piece in lacking:
            if len(piece) > LONGEST:
                del self.memo[piece]
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
