"""WordPiece tokens: clean, part, and match greedily against a vocabulary."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import gotext

ENCODING = "ids array<int>, mask array<int>, type_ids array<int>, tokens array<string>"
_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32())), ("type_ids", pa.list_(pa.int32())), ("tokens", pa.list_(pa.string()))])
#: Blocks of ideographs that stand alone (fixed values).
CJK = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)


#: Words whose pieces are kept, and the length of the longest ones.
CACHE, CACHED = 200_000, 32
#: Characters of a text cut into words at once, at least.
CHUNK = 1 << 16
#: Pieces in one Arrow array, unless one text has more. A piece takes some 20 times a letter's space, so whole batches of texts don't do.
PIECES = 1 << 18


def _space(c: str) -> bool:
    return c in " \t\n\r" or ord(c) >= 0x80 and (unicodedata.category(c) in ("Zs", "Zl", "Zp") or c == "\x85")


def _dropped(c: str) -> bool:
    return c not in "\t\n\r" and (ord(c) == 0xFFFD or unicodedata.category(c) in ("Cc", "Cf"))


def _mark(c: str) -> bool:
    return c.isascii() and c.isprintable() and not c.isalnum() and c != " " or unicodedata.category(c).startswith("P")


class _Table(dict):
    """What each character becomes, worked out when it is first seen."""

    def __init__(self, becomes: Callable[[str], str]):
        self.becomes = becomes

    def __missing__(self, code: int) -> str:
        self[code] = out = self.becomes(chr(code))
        return out


def _clean(c: str) -> str:
    return "" if _dropped(c) else " " if _space(c) else f" {c} " if any(a <= ord(c) <= b for a, b in CJK) else c


def _apart(c: str) -> str:
    return f" {c} " if _mark(c) else c


_CLEANED, _APART = _Table(_clean), _Table(_apart)
_BARE = _Table(lambda c: "" if unicodedata.category(c) == "Mn" else _apart(c))


def cleaned(text: str) -> str:
    return text.translate(_CLEANED)


def _lower(text: str) -> str:
    """In lower case, each letter for itself, and decomposed."""
    if text.isascii():
        return text.lower()
    alone = "\u0130" in text or "\u03a3" in text
    return unicodedata.normalize("NFD", "".join(c.lower() if ord(c) != 0x130 else "i" for c in text) if alone else text.lower())


@dataclass(frozen=True)
class Encoding:
    ids: list[int]
    mask: list[int]
    type_ids: list[int]
    tokens: list[str]


class WordPiece:
    def __init__(self, vocab: Mapping[str, int], lowercase: bool = True, max_len: int = 0, max_chars_per_word: int = 100,
                 special_tokens: tuple[str, str, str] = ("[UNK]", "[CLS]", "[SEP]")):
        if not vocab:
            raise ValueError("wordpiece: vocab is empty")
        if max_len and max_len < 2:
            raise ValueError(f"wordpiece: max length {max_len} leaves no room for [CLS] and [SEP]")
        if max_chars_per_word < 1:
            raise ValueError(f"wordpiece: max chars per word {max_chars_per_word} must be positive")
        for what, token in zip(("unknown", "classify", "separator"), special_tokens, strict=True):
            if token not in vocab:
                raise ValueError(f"wordpiece: vocab missing {what} token {gotext.quote(token)}")
        self.vocab, self.lowercase, self.max_len, self.max_chars = dict(vocab), lowercase, max_len, max_chars_per_word
        self.unknown, self.begin, self.end = special_tokens
        self.names = list(self.vocab)
        self.place = {t: i for i, t in enumerate(self.names)}
        self.further = {t[2:]: i for t, i in self.place.items() if t.startswith("##")}
        self.lengths = [sorted({*map(len, d)} - {0}, reverse=True) for d in (self.place, self.further)]
        self.cache: dict[str, bytes] = {}

    @classmethod
    def parse(cls, lines: Iterable[str], **options) -> WordPiece:
        """A vocabulary of one token a line; the line's number is the id, the first of equal lines counts."""
        vocab: dict[str, int] = {}
        for i, line in enumerate(lines):
            vocab.setdefault(line.removesuffix("\n").rstrip("\r"), i)
        return cls(vocab, **options)

    @classmethod
    def load(cls, path: str, **options) -> WordPiece:
        try:
            with open(path, encoding="utf-8", newline="\n") as f:
                return cls.parse(f, **options)
        except OSError as e:
            raise ValueError(f"wordpiece: open {path}: {e.strerror}") from e

    def words(self, text: str) -> list[str]:
        """The words and punctuation marks; one pass a step, as a text has many words that no other has."""
        text = cleaned(text)
        return [w for w in (_lower(text).translate(_BARE) if self.lowercase else text.translate(_APART)).split(" ") if w]

    def pieces(self, word: str) -> list[str]:
        return [self.names[i] for i in self._matched(word)]

    def _matched(self, word: str) -> array:
        """The pieces of a word by their places in the vocabulary."""
        unknown, size = array("i", [self.place[self.unknown]]), len(word)
        if size > self.max_chars:
            return unknown
        out, at, known, lengths = array("i"), 0, self.place, self.lengths[0]
        while at < size:
            for n in lengths:
                if n <= size - at and (found := known.get(word[at : at + n])) is not None:
                    out.append(found)
                    at += n
                    break
            else:
                return unknown
            known, lengths = self.further, self.lengths[1]
            if lengths == [1]:
                rest = [*map(known.get, word[at:])]
                return unknown if None in rest else array("i", [*out, *rest])
        return out

    def _known(self, word: str) -> bytes:
        """The places of a new word's pieces, kept in a cache of bounded size."""
        found = self._matched(word).tobytes()
        if len(word) <= CACHED:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = found
        return found

    def places(self, text: str) -> np.ndarray:
        """The tokens of a text by their places in the vocabulary."""
        most = self.max_len - 2 if self.max_len else None
        chunk = CHUNK if most is None else min(CHUNK, 8 * self.max_len)
        text = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
        found, n, at, get, known = [], 0, 0, self.cache.get, self._known
        while at < len(text) and (most is None or n < most):
            end = text.find(" ", at + chunk)
            end = len(text) if end < 0 else end
            found.append(b"".join([get(w) or known(w) for w in self.words(text[at:end])]))
            n, at = n + len(found[-1]) // 4, end
        inner = np.frombuffer(b"".join(found), np.int32)[:most]
        return np.concatenate([[self.place[self.begin]], inner, [self.place[self.end]]], dtype=np.int32)

    def encode(self, text: str) -> Encoding:
        tokens = [self.names[i] for i in self.places(text)]
        return Encoding([self.vocab[t] for t in tokens], [1] * len(tokens), [0] * len(tokens), tokens)

    def encode_batches(self, batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
        """The encodings of the texts in order, in arrays of at most ``PIECES`` pieces or of one text; null texts have null ones."""
        ids, names = np.fromiter(self.vocab.values(), np.int32), pa.array(self.names, pa.string())

        def column(rows: list[np.ndarray | None]) -> pa.Array:
            flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
            offsets = pa.array(np.cumsum([0, *(0 if r is None else len(r) for r in rows)]), pa.int32())
            values = (ids[flat], np.ones(len(flat), np.int32), np.zeros(len(flat), np.int32), names.take(pa.array(flat)))
            lists = [pa.ListArray.from_arrays(offsets, v if isinstance(v, pa.Array) else pa.array(v)) for v in values]
            return pa.StructArray.from_arrays(lists, fields=list(_ARROW), mask=pa.array([r is None for r in rows], pa.bool_()))

        for batch in batches:
            rows, n = [], 0
            for text in batch:
                row = self.places(text.as_py()) if text.is_valid else None
                size = 0 if row is None else len(row)
                if rows and n + size > PIECES:
                    yield column(rows)
                    rows, n = [], 0
                rows.append(row)
                n += size
            if rows:
                yield column(rows)


def encode_column(df: DataFrame, tokenizer: WordPiece, text: str, column: str = "encoding") -> DataFrame:
    """Add the encoding of a text column; the vocabulary is broadcast. Null texts have a null encoding."""
    sent = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf(f"struct<{ENCODING.replace(' array', ': array')}>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sent.value.encode_batches(texts)

    value: Column = encode(F.col(text))
    return df.withColumn(column, value)
