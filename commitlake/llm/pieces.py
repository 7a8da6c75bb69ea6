"""Encoding of whole texts by pieces, over arrays.

A byte-level tokenizer cuts a text into pieces by a fixed rule (contractions; words, numbers and runs of other
characters, each with one space before it; white space), and never merges across a cut.  The cuts of many texts are
found at once over an array of their code points, each distinct piece of a worker goes through the library's model
once, and ids are gathered from there.  A piece of up to 16 bytes is looked up by those bytes themselves, in a table of
open addressing; longer ones by a dictionary.  Nothing is compared by hash alone.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

MAX_PIECES = 900_000
CHUNK = 1 << 18  # code points that are worked on at once
MAX_IDS = 1 << 24
_SLOTS = 1 << 21
#: characters on which this cutting agrees with the tokenizer's own
_PLAIN = re.compile("[\t\n\r -~¡-¬®-±´-¸º»¿-ɏ‐-‧]*")
_LETTER, _NUMBER, _OTHER, _SPACE, _END = range(5)
_KIND = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
_CLASS = np.array([_KIND.get(unicodedata.category(chr(x))[0], _OTHER) for x in range(0x2028)], dtype=np.uint8)
_CLASS[[9, 10, 13]] = _SPACE
_CLASS[0] = _END  # stands after each text
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def cuts(codes: np.ndarray) -> np.ndarray:
    """Where pieces start, for texts that each end in code 0; that end is a piece of its own."""
    kind = _CLASS[codes]
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    word = np.flatnonzero(start[1:] & (kind[1:] < _SPACE)) + 1
    word = word[kind[word - 1] == _SPACE]
    start[word - 1] = True  # the last white space before a word is apart from those before it
    start[word[codes[word - 1] == 32]] = False  # and belongs to the word if it is a space
    quote = np.flatnonzero(codes == 39)
    quote = quote[start[quote]]
    if len(quote):
        a, b = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return np.flatnonzero(start)


class Pieces:
    """Ids of the pieces that a worker has met."""

    def __init__(self, tok, end_id: int):
        self._tokenize = tok.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level characters stand for bytes
        rest = [b for b in range(256) if b not in shown]
        self._shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self._end_id = end_id
        self.clear()

    def clear(self) -> None:
        self._low, self._high = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self._at = np.full(_SLOTS, -1, np.int32)
        self._long: dict[bytes, int] = {}
        self._pool, self._first, self._size = np.zeros(1 << 22, np.uint16), np.zeros(MAX_PIECES + 1, np.int64), np.zeros(MAX_PIECES + 1, np.int64)
        self._count = self._used = 0
        self._add([[self._end_id]])
        self._place(np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int32))

    def _add(self, found: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint16, int(sizes.sum()))
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros_like(self._pool)))
        self._pool[self._used : self._used + len(flat)] = flat
        here = slice(self._count, self._count + len(sizes))
        self._first[here], self._size[here] = self._used + np.cumsum(sizes) - sizes, sizes
        self._used += len(flat)
        self._count += len(sizes)
        return np.arange(here.start, here.stop, dtype=np.int32)

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + high * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)

    def _place(self, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> None:
        """Distinct new keys take the first free slot from their own on."""
        slot = self._slot(low, high)
        while len(at):
            free = np.flatnonzero(self._at[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            take = free[one]
            self._low[slot[take]], self._high[slot[take]], self._at[slot[take]] = low[take], high[take], at[take]
            left = np.ones(len(at), bool)
            left[take] = False
            low, high, at, slot = low[left], high[left], at[left], slot[left] + 1 & _SLOTS - 1

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self._slot(low, high)
        at = self._at[slot]
        off = np.flatnonzero((at >= 0) & ((self._low[slot] != low) | (self._high[slot] != high)))
        while len(off):
            slot[off] = slot[off] + 1 & _SLOTS - 1
            s = slot[off]
            at[off] = self._at[s]
            off = off[(at[off] >= 0) & ((self._low[s] != low[off]) | (self._high[s] != high[off]))]
        return at

    def _model(self, raw: list[bytes]) -> list[list[int]]:
        shown, tokenize = self._shown, self._tokenize
        return [[t.id for t in tokenize(r.decode("latin-1").translate(shown))] for r in raw]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each end in code 0, whose place the end id takes; and how many each text has with it."""
        codes, raw = np.frombuffer(text.encode("utf-32-le"), np.uint32), text.encode()
        first = cuts(codes)
        if len(raw) > len(codes):
            width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF)
            first = (np.cumsum(width) - width)[first]
        size = np.diff(np.append(first, len(raw)))
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        eight = np.ndarray(len(raw) + 8, "<u8", padded, strides=(1,))
        low = eight[first] & _KEEP[np.minimum(size, 8)]
        high = eight[np.minimum(first + 8, len(raw))] & _KEEP[np.clip(size - 8, 0, 8)]
        at = self._find(low, high)
        big = np.flatnonzero(size > 16)
        new = np.flatnonzero((at < 0) & (size <= 16))
        if self._count + len(new) + len(big) > MAX_PIECES or self._used > MAX_IDS:
            self.clear()
            at = self._find(low, high)
            new = np.flatnonzero((at < 0) & (size <= 16))
        if len(new):
            _, one, back = np.unique(np.stack((low[new], high[new]), axis=1), axis=0, return_index=True, return_inverse=True)
            a, n = first[new[one]].tolist(), size[new[one]].tolist()
            made = self._add(self._model([raw[x : x + y] for x, y in zip(a, n, strict=True)]))
            self._place(low[new[one]], high[new[one]], made)
            at[new] = made[back.ravel()]
        for i in big.tolist():
            piece = raw[first[i] : first[i] + size[i]]
            if piece not in self._long:
                self._long[piece] = int(self._add(self._model([piece]))[0])
            at[i] = self._long[piece]
        n = self._size[at]
        ends = np.cumsum(n)
        ids = self._pool[np.repeat(self._first[at] - ends + n, n) + np.arange(int(ends[-1]))]
        return ids, np.diff(ends[at == 0], prepend=0)


def plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def chunks(text: str):
    """Parts of a text: each ends before white space that follows a word, so no piece crosses a cut."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max((m for m in (text.rfind(c, at, at + CHUNK) for c in " \n\t\r") if m > at), default=-1)
        while cut > at and text[cut - 1] in " \n\t\r":
            cut -= 1
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]
