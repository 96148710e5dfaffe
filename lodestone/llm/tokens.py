"""Encoding whole texts by a public tokenizer, through a bounded cache of pieces of words.

word_bpe_49k drops white space, lower-cases, and never joins a letter with a following mark, so a text's
ids are those of its pieces, one after another: words between ASCII white space, cut again between an
ASCII letter and a following mark of CUT. Everything inside a piece is left to the tokenizer. Pieces of
ASCII letters alone are looked up lower-cased.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import Words, tokenizer_path

WORD_TOKENIZER = "word_bpe_49k.json"
#: Marks before which a piece may end; those of contractions and special tokens are left out.
CUT = b'.,!?;:*$&%#"()'
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(CUT, np.uint8)] = True


class Pieces(Words):
    """Words cut before marks; hashes are of lower-cased bytes for pieces of ASCII letters alone."""

    def __init__(self, column: pa.Array):
        super().__init__(column, hashed=False)
        data = self.data
        letter = _LETTER[data]
        cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
        first = self.off[1:-1]
        if len(first):  # no piece reaches from one text into the next
            cut = cut[~np.isin(cut, first)]
        self.start = np.sort(np.concatenate([self.start, cut]), kind="stable")
        self.end = np.sort(np.concatenate([self.end, cut]), kind="stable")
        self.doc_off = np.searchsorted(self.start, self.off)
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(letter, out=total[1:])
        plain = total[self.end] - total[self.start] == self.end - self.start
        upper = np.flatnonzero(_UPPER[data])
        upper = upper[plain[np.searchsorted(self.start, upper, side="right") - 1]]
        self.data = data.copy()
        self.data[upper] |= 32
        self.hash = self._hashes(False)


class WordEncoder:
    """Ids of texts. The cache holds at most cache_pieces pieces and begins anew when full."""

    def __init__(self, path: str | None = None, cache_pieces: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(WORD_TOKENIZER))
        self.limit = cache_pieces
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text and how many; letters alone go many at a time, as each then ends in one word-end token."""
        alpha = np.fromiter((t.isalpha() for t in texts), bool, len(texts))
        groups: list[tuple[list[int], bool]] = []
        on = np.flatnonzero(alpha).tolist()
        groups += [(on[k : k + 2000], True) for k in range(0, len(on), 2000)]
        off = np.flatnonzero(~alpha).tolist()
        groups += [(off, False)] if off else []
        sizes, parts, order = np.zeros(len(texts), np.int64), [], []
        while groups:
            members, joined = groups.pop()
            if joined:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in members])], add_special_tokens=False)[0].ids, np.uint16)
                last = np.flatnonzero(self.ends[ids])
                if len(last) != len(members):  # some letters fall apart when lower-cased
                    groups.append((members, False))
                    continue
                sizes[members] = np.diff(last, prepend=-1)
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in members], add_special_tokens=False)]
                sizes[members] = [len(f) for f in found]
                ids = np.array([i for f in found for i in f], np.uint16)
            parts.append(ids)
            order += members
        first = np.zeros(len(texts), np.int64)
        own = sizes[order]
        first[order] = np.cumsum(own) - own
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.stack([first, sizes])

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids, (first, sizes) = self._ids_of(texts)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first + len(self.ids))
        self.size = np.insert(self.size, at, sizes)
        self.ids = np.concatenate([self.ids, ids])

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, Pieces]:
        """All ids (unsigned 16-bit), each text's number of ids, and the pieces."""
        pieces = Pieces(column)
        own, inverse, index = _unique(pieces.hash)
        at, there = self._at(own)
        if not there.all():
            missing = np.flatnonzero(~there)
            if len(self.known) + len(missing) > self.limit:
                self._empty()
                missing = np.arange(len(own))
            raw = pieces.data.tobytes()
            pick = index[missing]
            texts = [raw[a:b].decode() for a, b in zip(pieces.start[pick].tolist(), pieces.end[pick].tolist(), strict=True)]
            self._learn(own[missing], texts)
            at, _ = self._at(own)
        first, size = self.first[at][inverse], self.size[at][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[pieces.doc_off]), pieces


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of each value among them, and a first index of each."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse, order[new]


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """One for each process and file, so that a worker's later tasks find the cache filled."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
