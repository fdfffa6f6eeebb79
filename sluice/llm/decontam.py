"""Benchmark decontamination by template windows.

Texts become templates: numbers, units of measure and names are typed placeholders, other words are in lower case.
Whether a word of the benchmark is a name is settled once for all texts, whatever its case there: it is one if it is
capitalised inside sentences (not all in capitals, not a single letter) more often than written small. Other words are
names where they are capitalised inside a sentence, and at its begin if the text holds them so elsewhere. Neighbouring
names are one. Windows of ``WINDOW`` template tokens of the benchmark items are hash-joined with all windows of all documents.
Where an item's windows are found, each is paired with one window of the document by its shift,
and the values that stand in its slots are compared: one value of the item must always correspond
to one value of the document. A shift whose own slots conflict is no leak; hits at other shifts
that conflict, as an item that repeats a template makes with itself, are left out. A document leaks an item if it
holds at least ``MIN_COVERAGE`` of the item's windows, or ``LONG_RUN`` of them, with consistent slots; ``kind`` is
``verbatim`` if all slots hold the item's own values, else ``reparameterised``.

Items go to the executors in blocks of bounded size, one pass over the documents for each block; a block
settles the names of its own items.
An item shorter than a window is one window of its own length; windows of placeholders alone are
not used; an item without a usable window can't be found. Null and empty texts leak nothing;
repeated rows and items are judged each for itself; empty tables give no leaks. Columns other
than keys and texts are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Numbers, Texts, classes, joined, mixed, parts
from .util import claim, mapped

WINDOW = 6
MIN_COVERAGE = 0.3
#: Windows that make a leak whatever the item's length: 45 words in a row.
LONG_RUN = 40
#: Text bytes of benchmark items that are broadcast at a time.
BLOCK_BYTES = 8_000_000
#: Pieces of text, their words and bytes of long ones of a worker; beyond any of them its tables start anew.
_MAX_PIECES, _MAX_WORDS, _MAX_LONG = 1 << 20, 3_000_000, 4_000_000
#: Numbers and words with apostrophes are looked at whole.
_CLASS = classes(b"0123456789'<")

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Words for numbers and unambiguous units.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNIT_WORDS = frozenset(
    "kg km cm mm ml lb lbs oz mph kmh gb mb kb hz khz mhz kwh percent gram grams kilogram kilograms meter meters metre metres "
    "kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros "
    "pound pounds degree degrees".split()
)
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?:;\n]")


def _named(word: str) -> bool:
    """Whether a word looks like a name where no sentence begins."""
    return len(word) > 1 and word[0].isupper() and not word.isupper()


def _fixed(word: str, vocabulary: dict[str, bool]) -> str | None:
    """The token of a word that is the same everywhere; None where its case and place tell."""
    if word[0].isdigit():
        return NUMBER
    low = word.lower()
    if low in NUMBER_WORDS:
        return NUMBER
    if low in UNIT_WORDS:
        return UNIT
    name = vocabulary.get(low)
    return None if name is None else NAME if name else low


def chunks(text: str | None) -> list[str]:
    """White-space chunks; a line break ends a sentence, as a full stop does."""
    return (text or "").replace("\n", " . ").split()


def _parse(chunk: str) -> tuple[list[tuple[str, bool]], bool | None]:
    """Words with True where a sentence begins within the chunk before them; whether a sentence ends after the last (None: as before)."""
    words, at, stop = [], 0, False
    for m in _TOKEN.finditer(chunk):
        stop = bool(_STOP.search(chunk, at, m.start()))
        words.append((m[0], stop))
        at = m.end()
    ends = bool(_STOP.search(chunk, at))
    return words, ends if words or ends else None


def words_of(text: str | None) -> list[tuple[str, bool]]:
    """The words of a text, with True where a sentence begins."""
    out, initial = [], True
    for c in chunks(text):
        words, ends = _parse(c)
        for word, stop in words:
            out.append((word, initial or stop))
            initial = False
        if ends is not None:
            initial = ends
    return out


def vocabulary_of(texts: Iterable[str | None]) -> dict[str, bool]:
    """Whether each word of the texts, in lower case, is a name."""
    names: dict[str, int] = {}
    for text in texts:
        for word, initial in words_of(text):
            low = word.lower()
            names[low] = names.get(low, 0) + (0 if initial or word.isupper() else 1 if _named(word) else -1)
    return {low: n > 0 for low, n in names.items()}


def template(text: str | None, vocabulary: dict[str, bool]) -> tuple[list[str], list[str]]:
    """Template tokens and the values that stand at each."""
    words = words_of(text)
    own = {w.lower() for w, initial in words if not initial and _named(w)}
    tokens, values = [], []
    for word, initial in words:
        low = word.lower()
        kind = _fixed(word, vocabulary) or (NAME if _named(word) and (not initial or low in own) else low)
        if kind == NAME and tokens and tokens[-1] == NAME:
            values[-1] += " " + low
        else:
            tokens.append(kind)
            values.append(low)
    return tokens, values


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


_NAME_HASH = np.uint64(_hash(NAME))


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    h = np.full(max(0, len(tokens) - length + 1), length, np.uint64)
    for i in range(length):
        h = joined(h, tokens[i : i + len(h)])
    return mixed(h)


class TemplateHashes:
    """Hashes of the template tokens of many texts; what a piece of text gives is kept in tables of bounded size."""

    def __init__(self, vocabulary: dict[str, bool]):
        self.vocabulary, self.numbers = vocabulary, Numbers()
        self._clear()

    def _clear(self) -> None:
        self.numbers.clear()
        # of each piece: its words, whether a sentence ends after it (2: as before), the place of its first word below
        self.counts, self.ends, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
        # of each word: its token inside a sentence and its word's, whether case tells, whether a sentence begins
        self.inner, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.cased, self.stop = np.zeros(0, bool), np.zeros(0, bool)

    def _learn(self, new: list[bytes]) -> None:
        counts, ends, inner, low, cased, stops = [], [], [], [], [], []
        for c in new:
            words, end = _parse(c.decode("utf-8", "replace"))
            counts.append(len(words))
            ends.append(2 if end is None else int(end))
            for word, stop in words:
                fixed = _fixed(word, self.vocabulary)
                token = _hash(fixed or word.lower())
                by_case = fixed is None and _named(word)
                inner.append(int(_NAME_HASH) if by_case else token)
                low.append(token)
                cased.append(by_case)
                stops.append(stop)
        lens = np.array(counts, np.int64)
        self.starts = np.concatenate([self.starts, len(self.inner) + np.cumsum(lens) - lens])
        self.counts, self.ends = np.concatenate([self.counts, lens]), np.concatenate([self.ends, np.array(ends, np.int8)])
        self.inner, self.low = np.concatenate([self.inner, np.array(inner, np.uint64)]), np.concatenate([self.low, np.array(low, np.uint64)])
        self.cased, self.stop = np.concatenate([self.cased, np.array(cased, bool)]), np.concatenate([self.stop, np.array(stops, bool)])

    def tokens(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' tokens in a row, and the number of tokens of each text."""
        if self.numbers.count > _MAX_PIECES or len(self.inner) > _MAX_WORDS or self.numbers.long_bytes > _MAX_LONG:
            self._clear()
        # runs of letters and of signs by themselves, so that there are fewer different ones; other words whole
        starts, stops = texts.runs(texts.kinds(_CLASS))
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(texts.bounds) - 1, np.int64)
        at = self.numbers.of(texts.buf, starts, stops, lambda _, new: self._learn(new))
        bounds = np.searchsorted(starts, texts.bounds)
        index = np.arange(len(at))
        # a sentence begins with a text and after a line break or a piece that ends one
        lines = np.flatnonzero(texts.buf[: texts.size] == 10)
        broken = np.searchsorted(lines, starts) > np.searchsorted(lines, np.append(0, stops[:-1]))
        broken[bounds[:-1][bounds[:-1] < len(at)]] = True
        since = np.maximum.accumulate(np.where(broken, index, -1))
        ends = self.ends[at]
        last = np.append(-1, np.maximum.accumulate(np.where(ends < 2, index, -1))[:-1])
        initial = (last < since) | (ends[np.maximum(last, 0)] == 1)
        lens = self.counts[at]
        upto = np.cumsum(lens)
        word = np.repeat(self.starts[at] - (upto - lens), lens)
        word += np.arange(len(word))
        begins = self.stop[word]
        begins[(upto - lens)[initial & (lens > 0)]] = True
        out = self.inner[word]
        cased = np.flatnonzero(self.cased[word])
        if len(cased):
            first = cased[begins[cased]]
            bounds_of = np.append(0, upto)[bounds]
            mark = lambda x: self.low[word[x]] ^ (np.searchsorted(bounds_of, x, "right").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = np.isin(mark(first), mark(cased[~begins[cased]]))
            out[first[~own]] = self.low[word[first[~own]]]
        upto = np.append(0, upto)[bounds]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != _NAME_HASH) | (out[:-1] != _NAME_HASH)
        keep[upto[:-1][upto[:-1] < len(out)]] = True
        kept = np.append(0, np.cumsum(keep))[upto]
        return out[keep], np.diff(kept)


class Items:
    """A block of benchmark items: their templates and the index of their windows."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.vocabulary = vocabulary_of(text for _, text in rows)
        self.keys, self.tokens, self.values, self.windows, self.lengths = [], [], [], [], []
        index: dict[int, list[tuple[int, int, int]]] = {}
        for key, text in rows:
            tokens, values = template(text, self.vocabulary)
            length = min(window, len(tokens))
            if not length:
                continue
            hashed = window_hashes(np.array([_hash(t) for t in tokens], np.uint64), length).tolist()
            used = [q for q in range(len(hashed)) if any(t not in (NUMBER, UNIT, NAME) for t in tokens[q : q + length])]
            if not used:
                continue
            index.setdefault(length, []).extend((hashed[q], len(self.keys), q) for q in used)
            self.keys.append(key)
            self.tokens.append(tokens)
            self.values.append(values)
            self.windows.append(len({hashed[q] for q in used}))
            self.lengths.append(length)
        #: By window length: ascending hashes, the item and place of each, and marks of the hashes' first bits.
        self.index = {}
        for n, found in index.items():
            found.sort()
            hashes, bits = np.array([f[0] for f in found], np.uint64), max(16, (16 * len(found)).bit_length())
            marks = np.zeros(1 << bits, bool)
            marks[hashes >> np.uint64(64 - bits)] = True
            self.index[n] = hashes, np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64), marks

    def _hits(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, place in the text, place in the item, hash) of all windows that a text and an item share, by text and item."""
        ends = np.cumsum(counts)
        begins, found = ends - counts, [np.zeros((4, 0), np.int64)]
        hashed = [np.zeros(0, np.uint64)]
        for n, (hashes, items, places, marks) in self.index.items():
            own = window_hashes(tokens, n)
            at = np.flatnonzero(marks[own >> np.uint64(65 - len(marks).bit_length())])
            own = own[at]
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            text = np.searchsorted(ends, at, "right")
            hit = (high > low) & (at + n <= ends[text])
            at, text, low, many = at[hit], text[hit], low[hit], (high - low)[hit]
            upto = np.cumsum(many)
            each = np.repeat(low - (upto - many), many) + np.arange(int(many.sum()))
            found.append(np.stack([np.repeat(text, many), items[each], np.repeat(at - begins[text], many), places[each]]))
            hashed.append(hashes[each])
        (text, item, p, q), h = np.concatenate(found, axis=1), np.concatenate(hashed)
        order = np.lexsort((h, item, text))
        return text[order], item[order], p[order], q[order], h[order]

    def leaks(self, texts: Texts, tokens: np.ndarray, counts: np.ndarray, min_coverage: float = MIN_COVERAGE) -> Iterator[tuple[int, tuple]]:
        """The number of a text and (item, windows, matched, coverage, slots, kind), for each item that it leaks."""
        text, item, p, q, h = self._hits(tokens, counts)
        if not len(text):
            return
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
        new = np.append(True, h[1:] != h[:-1])
        new[first] = True
        distinct = np.add.reduceat(new.astype(np.int64), first)
        need = np.array([self.enough(i, min_coverage) for i in range(len(self.keys))])
        ends = np.append(first[1:], len(text))
        values: tuple[int, list[str]] = (-1, [])
        for k in np.flatnonzero(distinct >= need[item[first]]).tolist():
            low, high = int(first[k]), int(ends[k])
            t, i = int(text[low]), int(item[low])
            if values[0] != t:
                values = t, template(texts.buf[texts.bounds[t] : texts.bounds[t + 1]].tobytes().decode("utf-8", "replace"), self.vocabulary)[1]
            best = self._best(i, list(zip(p[low:high].tolist(), q[low:high].tolist(), h[low:high].tolist(), strict=True)), values[1], need[i])
            if best:
                yield t, (self.keys[i], self.windows[i], best[0], best[0] / self.windows[i], best[1], best[2])

    def leaks_of(self, text: str) -> list[tuple]:
        """What one text leaks, by itself."""
        texts = Texts(pa.array([text], pa.string()))
        return [leak for _, leak in self.leaks(texts, *TemplateHashes(self.vocabulary).tokens(texts))]

    def enough(self, i: int, min_coverage: float) -> float:
        """The windows of an item that make a leak."""
        return min(min_coverage * self.windows[i], LONG_RUN)

    def _best(self, i: int, found: list[tuple[int, int, int]], values: list[str], enough: float) -> tuple[int, int, str] | None:
        """Of the places in the text where the item stands, the one with the most windows and consistent slots.

        A place is a shift with those near it. Places that are alike, as a text makes that repeats itself, are judged once.
        """
        by_shift: dict[int, list[tuple[int, int, int]]] = {}
        for p, q, h in found:
            by_shift.setdefault(p - q, []).append((p, q, h))
        hits, kinds, kind_of = {}, {}, {}
        for shift in sorted(by_shift):
            own = self._slots(i, sorted(by_shift[shift]), values)
            if not _conflict(chain.from_iterable(slots for _, _, _, slots in own)):
                hits[shift] = own
                kind_of[shift] = kinds.setdefault(tuple((q, *(v for _, v in slots)) for _, q, _, slots in own), len(kinds))
        shifts, reach = [*hits], max(3, len(self.tokens[i]) // 4)
        upto = [0, *accumulate(len(x) for x in hits.values())]
        seen, best = set(), None
        for base in sorted(shifts, key=lambda shift: -len(hits[shift])):
            low, high = bisect_left(shifts, base - reach), bisect_right(shifts, base + reach)
            most = min(upto[high] - upto[low], self.windows[i])
            if most < enough or best and (most < best[0] or most == best[0] and best[2] == "verbatim"):
                continue
            near = shifts[low:high]
            alike = tuple((shift - base, kind_of[shift]) for shift in near)
            if alike in seen:
                continue
            seen.add(alike)
            own = self._aligned(i, base, hits, near)
            if own[0] >= enough and (best is None or (own[0], own[2] == "verbatim") > (best[0], best[2] == "verbatim")):
                best = own
        return best

    def _slots(self, i: int, own: list[tuple[int, int, int]], values: list[str]) -> list[tuple[int, int, int, list]]:
        """The hits of one shift, each with the (kind and value of the item, value of the text) of its slots."""
        # a name at an end of the passage may have run together with one beside it, so it says nothing of consistency
        ends = {own[0][0], own[-1][0] + self.lengths[i] - 1}
        out = []
        for p, q, h in own:
            kinds = self.tokens[i][q : q + self.lengths[i]]
            slots = [((t, self.values[i][q + k]), values[p + k]) for k, t in enumerate(kinds) if t in (NUMBER, UNIT) or t == NAME and p + k not in ends]
            out.append((p, q, h, slots))
        return out

    def _aligned(self, i: int, base: int, hits: dict[int, list], near: list[int]) -> tuple[int, int, str]:
        """Windows, slots and kind of the hits at shift ``base`` and of those at others, nearest first, that agree with them; each window is paired once."""
        maps: dict[tuple[str, str], str] = {}
        left, right, windows, places = set(), set(), set(), set()
        for shift in sorted(near, key=lambda x: (abs(x - base), x)):
            for p, q, h, slots in hits[shift]:
                if p in left or q in right or any(maps.get(a, b) != b for a, b in slots):
                    continue
                left.add(p)
                right.add(q)
                windows.add(h)
                maps.update(slots)
                places.update(q + k for k in range(self.lengths[i]) if self.tokens[i][q + k] in (NUMBER, UNIT, NAME))
        return len(windows), len(places), "verbatim" if all(value == v for (_, value), v in maps.items()) else "reparameterised"


def _conflict(slots: Iterable[tuple[tuple[str, str], str]]) -> bool:
    """Whether one value of the item stands for two of the text."""
    maps: dict[tuple[str, str], str] = {}
    return any(maps.setdefault(a, b) != b for a, b in slots)


_hashes: dict[str, TemplateHashes] = {}


def _worker_hashes(block: str, items: Items) -> TemplateHashes:
    """The worker's own tables for a block of items."""
    claim(f"decontam {block}", _hashes.clear)
    if block not in _hashes:
        _hashes[block] = TemplateHashes(items.vocabulary)
    return _hashes[block]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    rows = benchmark.select(item, text).where(F.col(text).isNotNull())
    size = rows.agg(F.sum(F.octet_length(text)).alias("s")).first()["s"] or 0
    n = 1 + size // BLOCK_BYTES
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == i) if n > 1 else rows
        yield Items([tuple(r) for r in part.collect()])


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, windows, matched, coverage, slots, kind) of each leak."""
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((df, key), (benchmark, item)))
    schema = f"`{key}` {kind}, `{item}` {item_kind}, windows long, matched long, coverage double, slots long, kind string"
    names = [key, item, "windows", "matched", "coverage", "slots", "kind"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
    out = None
    for block in _blocks(benchmark, item, item_text):
        sent, name = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            items = sent.value
            hashes = _worker_hashes(name, items)
            for b in batches:
                rows, found = [], []
                for low, texts in parts(b.column(1)):
                    for i, leak in items.leaks(texts, *hashes.tokens(texts)):
                        rows.append(low + i)
                        found.append(leak)
                if found:
                    cols = [pa.array([f[j + 1] for f in found], k) for j, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([f[0] for f in found]), *cols], names)

        leaks = mapped(df.select(key, text), run, schema)
        out = leaks if out is None else out.union(leaks)
    return out


def without_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that leak no item."""
    for block in _blocks(benchmark, item, item_text):
        sent, name = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        place = df.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name, place=place) -> Iterator[pa.RecordBatch]:
            items = sent.value
            hashes = _worker_hashes(name, items)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for low, texts in parts(b.column(place)):
                    for i, _ in items.leaks(texts, *hashes.tokens(texts)):
                        keep[low + i] = False
                yield b.filter(pa.array(keep))

        df = mapped(df, run, df.schema)
    return df
