"""Token ids by the tokenizers library, with repeated words looked up instead of encoded again.

Both supported kinds of vocabulary split a text at white space before merging (the byte-level kind keeps a
space with the word that follows), so a text's ids are those of its words in order. A worker keeps the ids
of the words it has met in numpy arrays, found by their 64-bit hashes. Texts with other white space or
control characters, and for the byte-level kind texts where more than one space or line feed stands between
two words or any at an end, are encoded whole, and so are texts that hold one of the vocabulary's control strings:
by the library's default it becomes its id, with ``special_as_text`` it is text like any other.
"""

from __future__ import annotations

import os

import numpy as np

from .words import Words, mix, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Slots of a worker's table of words; it starts anew when half of them are in use.
SLOTS = 1 << 22
U64 = np.uint64
#: First bytes of characters that may be white space, zero-width or combining, and all control bytes but the line feed.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(0x00, 0x0A), *range(0x0B, 0x20), 0x7F, 0xC2, 0xCC, 0xCD, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _odd(buf: np.ndarray) -> np.ndarray:
    """Where a character begins that may be white space to a tokenizer, or is a control or combining character."""
    at = np.flatnonzero(_SUSPECT[buf])
    after = np.r_[buf, np.zeros(2, np.uint8)]
    a, b, c = buf[at], after[at + 1], after[at + 2]
    plain = (a == 0xC2) & (b > 0xA0) | (a == 0xCD) & (b > 0xAF) | (a == 0xE1) & (b != 0x9A) & (b != 0xA0)
    plain |= (a == 0xE2) & (((b == 0x80) & (c >= 0x90) & (c != 0xA8) & (c != 0xA9) & (c != 0xAF)) | (b > 0x81)) | (a == 0xE3) & ((b != 0x80) | (c != 0x80)) | (a == 0xEF) & (b != 0xBB)
    return at[~plain]


class Encoder:
    """Ids of texts as little-endian bytes, two or four a token."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [x for x in self.tokenizer.get_added_tokens_decoder().values() if not (x.special and special_as_text)]
        self.control = [x.content.encode() for x in added] + [x.content.lower().encode() for x in added if x.normalized]
        self.folded = any(x.normalized for x in added)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.spaced = self.tokenizer.normalizer is None
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.known = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32), 0
        self.pool, self.filled = np.zeros(1 << 20, self.kind), 0
        self.begin = np.zeros(1 << 16, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each known word, -1 for others."""
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _learn(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Adds words of distinct new hashes."""
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), self.kind, int(n.sum()))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while self.known + len(h) + 1 > len(self.begin):
            self.begin = np.r_[self.begin, np.zeros_like(self.begin)]
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.begin[self.known + 1 : self.known + 1 + len(h)] = self.filled + np.cumsum(n)
        self.filled += len(flat)
        number, left = np.arange(self.known, self.known + len(h)), np.arange(len(h))
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = h[free], number[free]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.known += len(h)

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        w = Words(texts)
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(w.begin, _odd(w.buf), "right") - 1] = False
        for d, t in enumerate(texts):
            if any(x in t for x in self.control) or (self.folded and any(x in t.lower() for x in self.control)):
                plain[d] = False
        h = w.hashes()
        if self.spaced:
            before = np.where(w.start > 0, w.buf[w.start - 1], 0)  # texts are held apart by a space that is none of theirs
            opens = np.zeros(len(h), bool)
            opens[w.first[:-1][w.n > 0]] = True
            before[opens] = 0
            h = mix(h + before.astype(U64))
            lengths = np.diff(w.begin) - 1
            gaps = lengths - np.diff(np.r_[0, np.cumsum(w.end - w.start)][w.first])
            some = np.flatnonzero(w.n)
            whole = np.zeros(len(texts), bool)
            whole[some] = (w.start[w.first[some]] == w.begin[some]) & (w.end[w.first[some + 1] - 1] == w.begin[some] + lengths[some])
            single = np.ones(len(h), bool)
            single[1:] = (w.start[1:] - w.end[:-1] == 1) | opens[1:]
            many = np.bincount(np.repeat(np.arange(len(texts)), w.n)[~single], minlength=len(texts))
            plain &= (whole & (many == 0)) | ((w.n == 0) & (gaps == 0))
        h[h == 0] = U64(1)
        used = np.repeat(plain, w.n)
        number = np.full(len(h), -1, np.int64)
        number[used] = self._find(h[used])
        new = np.flatnonzero(used & (number < 0))
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            first = new[at]
            back = (before[first] > 0) if self.spaced else np.zeros(len(first), np.int64)
            strings = [w.buf[i:j].tobytes().decode() for i, j in zip(w.start[first] - back, w.end[first])]
            if self.known + len(keys) > SLOTS // 2:
                self._clear()
                number[used] = -1
                return self._slice_anew(texts)
            self._learn(keys, self._encode(strings))
            number[new] = self._find(h[new])
        n = np.where(used, self.begin[number + 1] - self.begin[number], 0)
        end = np.cumsum(n)
        at = np.repeat(self.begin[number] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
        ids, cuts = self.pool[at], np.r_[0, end][w.first]
        out = [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
        others = np.flatnonzero(~plain)
        for d, x in zip(others, self._encode([texts[d].decode() for d in others])):
            out[d] = np.array(x, self.kind).tobytes()
        return out

    def _slice_anew(self, texts: list[bytes]) -> list[bytes]:
        """After the table was cleared; a slice whose words alone don't fit is halved."""
        if len(texts) == 1:
            return [np.array(x, self.kind).tobytes() for x in self._encode([texts[0].decode()])]
        half = len(texts) // 2
        return self._slice(texts[:half]) + self._slice(texts[half:])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        texts = [t or b"" for t in texts]
        return [x for part in slices([len(t) for t in texts]) for x in self._slice(texts[part])]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker, path and way with control strings."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
