"""Token counts by byte-pair merging with a heap over a linked list, for sentencepiece BPE models.

The lowest-rank adjacent pair is popped again and again and merged; the count is the number of
initial symbols less the number of merges, and no identifiers are made. A character outside the
vocabulary is as many symbols as it has UTF-8 bytes. Texts are cut only between characters that
no vocabulary piece holds side by side, so no merge can cross a cut; the counts of recurring
chunks are kept in bounded caches. Null and empty texts have no tokens; very long texts are counted whole; equal
ranks merge from the left. Repeated rows and null keys are rows like others; an empty table gives an empty one; columns
other than key and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import claim, mapped

SPACE = "▁"
#: Entries in a worker's cache of chunks; at that size it starts anew.
CACHE = 400_000


class MergeCounter:
    """Counts tokens as the model in ``model_file`` does, without begin or end tokens."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for text in ("  a  b ", "é ﬁ  ", "\tA\n"):
            if model.normalize(text) != SPACE + text.replace(" ", SPACE):
                raise ValueError("the model normalises text; only models that keep it as it is are supported")
        self.ranks: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.ranks[model.id_to_piece(i)] = -model.get_score(i)
        self.beside = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        #: Chunks start where a space mark follows another character, if no piece crosses there.
        self.chunks = None
        if not any(b == SPACE and a != SPACE for a, b in self.beside):
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*")
        self._of: dict[str, int] = {}
        self._segments: dict[str, int] = {}

    def _symbols(self, char: str) -> int:
        return 1 if char in self.ranks else len(char.encode("utf-8", "surrogatepass"))

    def merged(self, text: str) -> int:
        """Symbols of ``text`` less its merges."""
        n = len(text)
        count = sum(map(self._symbols, text))
        ranks, size = self.ranks, [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(text[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = i + size[i]
            if not size[i] or j >= n or size[i] + size[j] != whole:
                continue  # one side has been merged since
            size[i], size[j] = whole, 0
            count -= 1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                r = ranks.get(text[i : j + size[j]])
                if r is not None:
                    heappush(heap, (r, i, whole + size[j]))
            h = before[i]
            if h >= 0:
                r = ranks.get(text[h : i + whole])
                if r is not None:
                    heappush(heap, (r, h, size[h] + whole))
        return count

    def _chunk(self, chunk: str) -> int:
        total, start, beside, known = 0, 0, self.beside, self._segments
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in beside:
                segment = chunk[start:i]
                n = known.get(segment)
                if n is None:
                    n = self.merged(segment)
                    if len(segment) <= 64:
                        if len(known) >= CACHE:
                            known.clear()
                        known[segment] = n
                total += n
                start = i
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if self.chunks is None:
            return self._chunk(marked)
        of, total = self._of, 0
        for chunk in self.chunks.findall(marked):
            n = of.get(chunk)
            if n is None:
                n = self._chunk(chunk)
                if len(chunk) <= 64:
                    if len(of) >= CACHE:
                        of.clear()
                    of[chunk] = n
            total += n
        return total


_counters: dict[str, MergeCounter] = {}


def clear_counters() -> None:
    _counters.clear()


def counter(model_file: str) -> MergeCounter:
    if model_file not in _counters:
        _counters[model_file] = MergeCounter(model_file)
    return _counters[model_file]


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row's whole text; other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokencount", clear_counters)
        count = counter(model_file).count
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            counts = [count(t) for t in texts]
            cols = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "n_bytes", "n_tokens", "over_limit"])

    return mapped(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
