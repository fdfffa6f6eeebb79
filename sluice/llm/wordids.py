"""Identifiers of whole texts by a tokenizers file, with the ids of recurring words kept in a bounded pool.

Holds for tokenizers that lower-case, drop white space, and part letters, single digits and other
signs, such as ``word_bpe_49k.json``. A text is cut at ASCII white space. Chunks of ASCII, but for
apostrophes and ``<``, and of Latin-1 letters are parted into letters, digits and signs here, as the
library's pattern does; other chunks are encoded by the library whole. Each distinct part is
encoded once by the library.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from .spans import LETTER, LOWER, OTHER, Numbers, Texts, classes
from .util import claim

#: Distinct parts, pooled ids and bytes of long parts of a worker; beyond any of them the pool starts anew.
MAX_PARTS, MAX_IDS, MAX_LONG = 1 << 20, 8_000_000, 4_000_000
_JOINED = 2048
#: Apostrophes begin words of their own, < special tokens.
_CLASS = classes(b"'<")
#: Second bytes of the capitals from U+00C0 to U+00DE.
_CAPITAL = np.isin(np.arange(256), [b for b in range(0x80, 0x9F) if b != 0x97])


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte but the space in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest) if b != 32}


class WordIds:
    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(file) as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(file)
        model = spec["model"]
        split = json.dumps(spec["pre_tokenizer"])
        if model.get("end_of_word_suffix") != "</w>" or "Removed" not in split or "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError("only tokenizers with word ends that drop white space and case are supported")
        #: The same merges for words that are already normalised, parted and mapped to byte letters.
        bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}}
        self.words = Tokenizer.from_str(json.dumps(bare))
        self.letters = _byte_letters()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        self.numbers = Numbers()
        self._clear()

    def _clear(self) -> None:
        self.numbers.clear()
        self.entries = self.used = 0
        self.starts, self.lens = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)

    def _append(self, ids: np.ndarray, lens: np.ndarray) -> None:
        """Pool the ids of the next entries, which have the given lengths and lie one after another."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.entries + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        to = self.entries + len(lens)
        self.pool[self.used : self.used + len(ids)] = ids
        self.lens[self.entries : to] = lens
        self.starts[self.entries : to] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.entries = to

    def _plain(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lines = [b" ".join(parts[i : i + _JOINED]).decode("latin-1").translate(self.letters) for i in range(0, len(parts), _JOINED)]
        found = [np.asarray(e.ids, np.int64) for e in self.words.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int64), *found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the vocabulary has no word end for some word")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, parts: list[bytes], other: np.ndarray) -> None:
        """Pool the ids of parts; those marked other are encoded as they are."""
        ids, lens = self._plain([p for p, o in zip(parts, other.tolist(), strict=True) if not o])
        if other.any():
            texts = [p.decode("utf-8", "replace") for p, o in zip(parts, other.tolist(), strict=True) if o]
            found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            more = np.array([len(x) for x in found], np.int64)
            every = np.empty(len(parts), np.int64)
            every[~other], every[other] = lens, more
            own = np.repeat(~other, every)
            both = np.empty(int(every.sum()), np.int64)
            both[own], both[~own] = ids, np.fromiter(chain.from_iterable(found), np.int64, int(more.sum()))
            ids, lens = both, every
        self._append(ids, lens)

    @staticmethod
    def _lowered(texts: Texts, kind: np.ndarray) -> np.ndarray:
        """The bytes in lower case, but for words that the library must part."""
        low = LOWER[texts.buf]
        lead = np.flatnonzero((texts.buf[: texts.size] == 0xC3) & (kind == LETTER))
        low[lead[_CAPITAL[texts.buf[lead + 1]]] + 1] += 32
        other = np.flatnonzero(kind == OTHER)
        low[other] = texts.buf[other]
        return low

    def encode(self, texts: Texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with ``end`` after it, and the number of ids of each text."""
        if self.numbers.entries > MAX_PARTS or self.used > MAX_IDS or self.numbers.long_bytes > MAX_LONG:
            self._clear()
        kind = texts.kinds(_CLASS)
        low = self._lowered(texts, kind)
        starts, ends = texts.runs(kind)
        at = self.numbers.of(low, starts, ends, lambda reps, parts: self._learn(parts, kind[starts[reps]] == OTHER))
        lens = self.lens[at]
        upto = np.cumsum(lens, dtype=np.int64)
        place = np.repeat(self.starts[at] - (upto - lens), lens)
        place += np.arange(len(place))
        ids = self.pool[place].astype(np.uint32)
        at_end = np.append(0, upto)[np.searchsorted(starts, texts.bounds[1:])]
        counts = np.diff(at_end, prepend=0)
        if end is not None:
            ids = np.insert(ids, at_end, end)
            counts += 1
        return ids, counts


_made: dict[str, WordIds] = {}


def word_ids(file: str) -> WordIds:
    """The worker's own encoder for a file."""
    claim("wordids", _made.clear)
    if file not in _made:
        _made[file] = WordIds(file)
    return _made[file]
