"""Hashes of words and of spans of words, for many texts at a time without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

#: Odd multipliers of the polynomial hashes: of bytes in a word, of words in a span, and of words in a span once more.
_BYTES, _WORDS, _AGAIN = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Bytes of a text that are hashed at a time, and bytes of texts that are taken together: what is made of them stays in a core's cache.
_PART, GROUP = 1 << 16, 1 << 18
_BLANK, _MARK, _ALNUM = np.zeros((3, 256), bool)
_BLANK[[9, 32]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".!?")] = True


class Powers:
    """The powers of an odd number modulo 2^64, and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones((2, 1), np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up, self.down


_of_bytes, _of_words, _of_again = Powers(_BYTES), Powers(_WORDS), Powers(_AGAIN)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each value with its bits spread over the whole."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Sums:
    """Prefix sums of a polynomial, from which the hash of any span is one subtraction and one product."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return mixed((self.sums[after] - self.sums[first]) * self.down[first])


class Places:
    """A hash table from 64-bit hashes (not 0) to places (not 0), asked for many at a time."""

    def __init__(self, slots: int):
        self.keys, self.places = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place, or 0."""
        out, at, todo = np.zeros(len(h), np.int32), (h >> np.uint64(32)).astype(np.int64) % len(self.keys), np.arange(len(h))
        while len(todo):
            there = self.keys[at]
            hit = there == h[todo]
            out[todo[hit]] = self.places[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) % len(self.keys)
        return out

    def insert(self, h: np.ndarray, places: np.ndarray) -> None:
        """Different hashes that aren't there yet; there must be room."""
        at = (h >> np.uint64(32)).astype(np.int64) % len(self.keys)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = free & (self.keys[at] == h)  # of several for one slot the last one has it
            self.places[at[mine]] = places[mine]
            h, places, at = h[~mine], places[~mine], (at[~mine] + 1) % len(self.keys)


def sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """The smallest or largest of each ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


class Texts:
    """Some texts: ``starts``, ``ends`` and ``hashes`` of all their words in turn, ``first`` word and ``n`` words of each text.

    A word is a run of bytes other than ASCII white space; with ``marks`` one of these bytes at a word's end, after a letter or
    digit, is a word by itself. Very long texts are hashed a part at a time, so that what is held for them is a few numbers for each word.
    """

    def __init__(self, texts: list[bytes], marks: bytes = b""):
        self.data = b"\n".join([*texts, b""])
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
        space = (self.bytes == 32) | (self.bytes - np.uint8(9) <= 4)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        edges = edges if space[0] else np.append(0, edges)
        self.starts, self.ends = edges[::2], edges[1::2]
        if marks and len(self.starts):
            last = self.bytes[self.ends - 1]
            ended = np.flatnonzero(np.isin(last, np.frombuffer(marks, np.uint8)) & (self.ends - self.starts > 1))
            ended = ended[_ALNUM[self.bytes[self.ends[ended] - 2]]]
            after = self.ends[ended] - 1
            self.starts, self.ends = np.insert(self.starts, ended + 1, after), np.insert(self.ends, ended, after)
        self.hashes = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + _PART, "right")))
            sums = Sums(self.bytes[at : self.ends[j - 1]].astype(np.uint64) + np.uint64(1), _of_bytes)
            self.hashes[i:j] = sums.of(self.starts[i:j] - at, self.ends[i:j] - at)
            i = j
        bounds = np.searchsorted(self.starts, self.offsets)
        self.first, self.n = bounds[:-1], np.diff(bounds)

    @cached_property
    def sums(self) -> Sums:
        return Sums(self.hashes, _of_words)

    @cached_property
    def sums_again(self) -> Sums:
        return Sums(self.hashes, _of_again)

    @cached_property
    def text(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    @cached_property
    def breaks(self) -> np.ndarray:
        """Where line breaks are."""
        return np.flatnonzero(self.bytes == 10)

    @cached_property
    def sentence_ends(self) -> np.ndarray:
        """Whether each word ends a sentence: its last byte is a mark that a blank follows."""
        return _MARK[self.bytes[self.ends - 1]] & _BLANK[self.bytes[self.ends]]

    def line_ends(self) -> np.ndarray:
        """Whether each word is its line's last: a line ends at a line break and with a sentence."""
        out = self.sentence_ends.copy()
        after = np.searchsorted(self.starts, self.breaks)
        out[after[after > 0] - 1] = True
        return out

    def line_counts(self) -> np.ndarray:
        """How many lines each text has, blank ones too; an empty text has one."""
        at, stops, some = self.offsets[:-1], self.offsets[1:] - 1, self.n > 0
        sentences = np.bincount(self.text[self.sentence_ends], minlength=len(self.n))
        ended = np.searchsorted(self.breaks, stops) - np.searchsorted(self.breaks, at)
        last = (self.first + self.n - 1)[some]
        closed = (stops > at) & (self.bytes[stops - 1] == 10)
        other = np.flatnonzero((self.bytes >= 10) & (self.bytes <= 13))
        blank = np.searchsorted(other, stops[some]) == np.searchsorted(other, self.ends[last])
        closed[some] |= self.sentence_ends[last] & blank
        return sentences + ended + ~closed


def grouped(texts: list[bytes], marks: bytes = b"") -> Iterator[tuple[int, Texts]]:
    """``(number of the first text, texts)`` of texts of a bounded size in all, or of a single text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= GROUP or i == len(texts) - 1:
            yield first, Texts(texts[first : i + 1], marks)
            first, held = i + 1, 0
