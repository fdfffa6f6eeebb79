"""Words of texts as spans of their UTF-8 bytes, found, hashed and numbered in numpy.

A text of millions of words never becomes millions of Python objects: Arrow's bytes are scanned as
they are, and words are told apart by their bytes in 64-bit lanes. Null texts are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Zero bytes after the last text, so that lanes can be read there.
_PAD = 40
_LANES = 3
#: Longer words are kept as Python bytes.
_SHORT = 8 * _LANES - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

#: ASCII white space: 09 to 0D and 20.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4
#: Second bytes of the UTF-8 letters from U+00C0 to U+00FF.
_LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


def classes(other: bytes) -> np.ndarray:
    """The class of each byte, 0 for white space; OTHER for those given and all that are not ASCII."""
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = SIGN
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    out[48:58] = DIGIT
    out[[*other]] = OTHER
    out[SPACE] = 0
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _M[2]
    h ^= h >> np.uint64(29)
    return h


def joined(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The hash of what ``h`` stands for with ``x`` after it."""
    return (h ^ (h >> np.uint64(29))) * _M[0] + x * _M[1]


class Texts:
    """Texts of an Arrow column: their bytes in a row, and ``bounds``, where each begins and the last ends."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        self.bounds = at - at[0]
        self.size = int(self.bounds[-1])
        self.buf = np.zeros(self.size + _PAD, np.uint8)
        if self.size:
            self.buf[: self.size] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]

    def edges(self) -> np.ndarray:
        """True at each byte where a text begins, and after the last one."""
        out = np.zeros(self.size + 1, bool)
        out[self.bounds] = True
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words between white space begin and end."""
        inside = np.zeros(self.size + 2, bool)
        np.logical_not(SPACE[self.buf[: self.size]], out=inside[1:-1])
        before, after, edge = inside[:-1], inside[1:], self.edges()
        return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))

    def kinds(self, of: np.ndarray) -> np.ndarray:
        """The class of each byte: LETTER for Latin-1 letters too, OTHER for all of a word that holds such a byte."""
        buf, kind = self.buf, of[self.buf[: self.size]]
        lead = np.flatnonzero(buf[: self.size] == 0xC3)
        lead = lead[_LATIN[buf[lead + 1]]]
        kind[lead] = kind[lead + 1] = LETTER
        bad = np.flatnonzero(kind == OTHER)
        if len(bad):
            starts, ends = self.words()
            word = np.unique(np.searchsorted(starts, bad, "right") - 1)
            lens = ends[word] - starts[word]
            upto = np.cumsum(lens)
            kind[np.repeat(starts[word] - (upto - lens), lens) + np.arange(upto[-1])] = OTHER
        return kind

    def runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of one class in words begin and end; each digit is a run."""
        around = np.zeros(self.size + 2, np.uint8)
        around[1:-1] = kind
        before, after = around[:-1], around[1:]
        cut = (before != after) | (before == DIGIT) | self.edges()
        return np.flatnonzero(cut & (after > 0)), np.flatnonzero(cut & (before > 0))

    def held(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ascending ``starts`` lie in each text."""
        return np.diff(np.searchsorted(starts, self.bounds))


def parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, Texts]]:
    """The column in slices of about ``most`` bytes, of one text at least: the first row and the texts of each."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, Texts(column.slice(low, high - low))
        low = high


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    view, lens = _eights(buf), ends - starts
    out = lens.astype(np.uint64) * _M[1]
    live, at = np.arange(len(starts)), starts
    left = np.where(lens > 256, 0, lens)
    while len(live):
        out[live] = joined(out[live], view[at] & _LOW_BYTES[np.minimum(left, 8)])
        keep = left > 8
        live, at, left = live[keep], at[keep] + 8, left[keep] - 8
    for i in np.flatnonzero(lens > 256).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return mixed(out)


class _Table:
    """An open-addressing table from keys of one or more 64-bit lanes to numbers; slots hold places of keys that lie in a row."""

    def __init__(self, lanes: int):
        self.entries = 0
        self._slots = np.full(1 << 12, -1, np.int32)
        self._keys, self._value = [np.zeros(1 << 11, np.uint64) for _ in range(lanes)], np.zeros(1 << 11, np.int32)

    @staticmethod
    def hash(keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * _M[1]
        for lane in keys[1:]:
            h = joined(h, lane)
        return mixed(h)

    def _same(self, e: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        same = e >= 0
        for there, own in zip(self._keys, keys, strict=True):
            same &= there[e] == own
        return same

    def find(self, keys: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for those that aren't there."""
        mask = len(self._slots) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        e = self._slots[slot]
        same = self._same(e, keys)
        out = np.where(same, self._value[e], -1)
        todo = np.flatnonzero(~same & (e >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            e = self._slots[slot]
            same = self._same(e, [lane[todo] for lane in keys])
            out[todo[same]] = self._value[e[same]]
            on = ~same & (e >= 0)
            todo, slot = todo[on], slot[on]
        return out

    def _place(self, h: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self._slots) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = entries[free]  # of several entries one stays
            left = self._slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def add(self, keys: list[np.ndarray], h: np.ndarray, values: np.ndarray) -> None:
        first, to = self.entries, self.entries + len(h)
        while to > len(self._value):
            self._keys = [np.concatenate([lane, np.zeros_like(lane)]) for lane in self._keys]
            self._value = np.concatenate([self._value, np.zeros_like(self._value)])
        for there, own in zip(self._keys, keys, strict=True):
            there[first:to] = own
        self._value[first:to] = values
        self.entries = to
        if 2 * to > len(self._slots):
            self._slots = np.full(len(self._slots) << (2 * to // len(self._slots)).bit_length(), -1, np.int32)
            self._place(self.hash([lane[:to] for lane in self._keys]), np.arange(to))
        else:
            self._place(h, np.arange(first, to))


class Numbers:
    """Numbers 0, 1, 2, ... of the distinct words that were seen, by their whole bytes.

    Words of up to 7 bytes, most of a text, are keys of one lane, words of up to 23 bytes keys of three; longer ones are
    keys of a dictionary. A key holds its word's length, which tells zero bytes from none.
    """

    def __init__(self) -> None:
        self.clear()

    @property
    def entries(self) -> int:
        return sum(t.entries for t in self._tables)

    def clear(self) -> None:
        self.count = self.long_bytes = 0
        self._tables = [_Table(1), _Table(_LANES)]
        self._long: dict[bytes, int] = {}

    @staticmethod
    def _lanes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, lanes: int) -> list[np.ndarray]:
        view = _eights(buf)
        if lanes == 1:
            out = [view[starts] & _LOW_BYTES[lens]]
        else:
            out = [view[starts + 8 * k] & _LOW_BYTES[np.clip(lens - 8 * k, 0, 8)] for k in range(lanes)]
        out[-1] |= lens.astype(np.uint64) << np.uint64(56)
        return out

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[np.ndarray, list[bytes]], None]) -> np.ndarray:
        """The number of each word. ``learn`` gets the new words, which are numbered from ``count`` on, and where in ``starts`` one of each is."""
        lens = ends - starts
        out = np.empty(len(starts), np.int64)
        brief = lens < 8
        for table, lanes, own in zip(self._tables, (1, _LANES), (np.flatnonzero(brief), np.flatnonzero(~brief & (lens <= _SHORT))), strict=True):
            keys = self._lanes(buf, starts[own], lens[own], lanes)
            h = table.hash(keys)
            found = table.find(keys, h)
            while len(missing := np.flatnonzero(found < 0)):  # again only where two words have one hash
                first = missing[np.unique(h[missing], return_index=True)[1]]
                reps = own[first]
                learn(reps, [buf[a:b].tobytes() for a, b in zip(starts[reps].tolist(), ends[reps].tolist(), strict=True)])
                table.add([lane[first] for lane in keys], h[first], np.arange(self.count, self.count + len(first)))
                self.count += len(first)
                found[missing] = table.find([lane[missing] for lane in keys], h[missing])
            out[own] = found
        long = np.flatnonzero(lens > _SHORT).tolist()
        if long:
            words = [buf[starts[i] : ends[i]].tobytes() for i in long]
            new = {w: i for w, i in zip(words, long, strict=True) if w not in self._long}
            if new:
                learn(np.array([*new.values()]), [*new])
                self._long.update(zip(new, range(self.count, self.count + len(new)), strict=True))
                self.count += len(new)
                self.long_bytes += sum(map(len, new))
            out[long] = [self._long[w] for w in words]
        return out
