"""Token ids in Re-Pair grammar files with random access.

Rows are put in order of their key and encoded; runs of about ``SHARD_IDS`` ids, of whole texts, become one shard file each.
In a shard, frequent pairs of neighbouring symbols are replaced by nonterminals again and again, the most frequent ones
first, until no pair occurs ``MIN_COUNT`` times: each round replaces the pairs whose counts come near that of the most
frequent one, from the left where they overlap. Once a round has replaced every frequent pair, new frequent pairs can only
hold a symbol of that round, so the rounds after it count those pairs alone. Pairs that begin with the end id are never replaced.

The file holds the ids in use, the rules, the length of each rule's expansion, the sequence with the number of ids before every
``MARK``-th symbol, and the number of ids of each text, so that any range of ids is decoded by expanding only the
symbols that cover it. Symbols take two bytes, or four where a shard has more than 65,536.

Files are binary values of a Parquet table in the shared folder. Null and empty texts are the end
id alone; repeated rows are texts of their own, null keys come first; an empty table gives no
files and no rows; columns other than key and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import parts
from .util import mapped, saved
from .wordids import word_ids

END = 2
#: A rule takes the room of this many symbols, so that rarer pairs aren't worth one.
MIN_COUNT = 6
#: A round takes the pairs that occur at least one time in so many as the most frequent one.
NEAR = 64
SHARD_IDS = 1 << 19
MARK = 1024
_MAGIC, _HEAD = b"SLREPAI2", "<8sIIIIIQ"


def _codes(left: np.ndarray, right: np.ndarray, wide: bool) -> np.ndarray:
    """One number for each pair."""
    return (left.astype(np.uint64) << np.uint64(32)) | right if wide else (left << np.uint32(16)) | right


def _frequent(codes: np.ndarray, near: int) -> tuple[np.ndarray, bool]:
    """Pair codes whose count is at least MIN_COUNT and comes near the highest, in ascending order; whether these are all that reach MIN_COUNT."""
    ordered = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[: len(ordered)]
    counts = np.diff(first, append=len(ordered))
    top = int(counts.max(initial=0))
    least = max(MIN_COUNT, top // near)
    return ordered[first[counts >= least]], least == MIN_COUNT


def _hits(codes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a code is one of the ascending pairs, and which."""
    bits = max(16, (8 * len(pairs)).bit_length())
    wide = codes.dtype == np.uint64
    slot = (lambda c: (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)) if wide else (lambda c: (c * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    holder = np.full(1 << bits, -1, np.int32)
    holder[slot(pairs)] = np.arange(len(pairs))
    found = holder[slot(codes)]
    at = np.flatnonzero(found >= 0)
    found, codes = found[at], codes[at]
    hit = pairs[found] == codes
    # a slot that pairs share holds one of them: other codes there are looked up among all
    rest = np.flatnonzero(~hit)
    place = np.searchsorted(pairs, codes[rest])
    place[place == len(pairs)] = 0
    found[rest] = place
    hit[rest] = pairs[place] == codes[rest]
    return at[hit], found[hit]


def _replace(seq: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The symbol takes the place of the pair at each of the ascending places, from the left where they overlap."""
    index = np.arange(len(at))
    first = np.concatenate([[True], np.diff(at) != 1])[: len(at)]
    # of places in a row, every other one counts from the left
    keep = (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
    at = at[keep]
    out = seq.copy()
    out[at] = symbols[keep]
    left = np.ones(len(seq), bool)
    left[at + 1] = False
    return out[left]


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, and the place of each id among them."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        alphabet, seq = np.unique(ids, return_inverse=True)
        return alphabet.astype(np.uint32), seq.astype(np.uint32)
    used = np.zeros(int(ids.max()) + 1, bool)
    used[ids] = True
    return np.flatnonzero(used).astype(np.uint32), (np.cumsum(used, dtype=np.uint32) - np.uint32(1))[ids]


def compress(ids: np.ndarray, counts: np.ndarray, end: int = END) -> bytes:
    """The file of a run of texts: ids in a row, and the number of ids of each text."""
    alphabet, seq = _dense(ids)
    own_end = int(np.searchsorted(alphabet, end))
    if own_end == len(alphabet) or alphabet[own_end] != end:
        own_end = (1 << 32) - 1
    base, sizes, left, right, fresh = len(alphabet), [], [], [], None
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        free = a != own_end
        at = np.flatnonzero(free if fresh is None else free & ((a >= fresh) | (b >= fresh)))
        codes = _codes(a[at], b[at], base > 1 << 16)
        pairs, every = _frequent(codes, NEAR)
        if not len(pairs):
            break
        hit, rule = _hits(codes, pairs)
        half = np.uint64(32) if pairs.dtype == np.uint64 else np.uint32(16)
        left.append((pairs >> half).astype("<u4"))
        right.append((pairs & ((pairs.dtype.type(1) << half) - pairs.dtype.type(1))).astype("<u4"))
        sizes.append(len(pairs))
        seq = _replace(seq, at[hit], (base + rule).astype(np.uint32))
        fresh = base if every else fresh
        base += len(pairs)
    none = np.zeros(0, "<u4")
    sizes, left, right = np.array(sizes, "<u4"), np.concatenate([none, *left]), np.concatenate([none, *right])
    lens = _expansions(alphabet, sizes, left, right)[1]
    upto = np.cumsum(lens[seq])
    marks = np.append(0, upto)[:-1][::MARK].astype("<u8") if len(seq) else np.zeros(0, "<u8")
    width = 2 if base <= 1 << 16 else 4
    head = struct.pack(_HEAD, _MAGIC, width, len(alphabet), len(sizes), len(left), len(counts), len(seq))
    body = [alphabet.astype("<u4"), sizes, left, right, lens[len(alphabet) :].astype("<u4"), marks, seq.astype(f"<u{width}"), counts.astype("<u8")]
    return head + b"".join(x.tobytes() for x in body)


def _expand(seq: np.ndarray, starts: np.ndarray, lens: np.ndarray, pool: np.ndarray) -> np.ndarray:
    n = lens[seq]
    ends = np.cumsum(n)
    place = np.repeat(starts[seq] - (ends - n), n)
    place += np.arange(len(place))
    return pool[place]


def _expansions(alphabet: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each symbol's expansion, and the ids of all, round by round: a rule uses earlier symbols only."""
    m = len(alphabet)
    starts, lens, pool, low = np.arange(m, dtype=np.int64), np.ones(m, np.int64), alphabet.astype(np.uint32), 0
    for n in sizes.tolist():
        a, b = left[low : low + n].astype(np.int64), right[low : low + n].astype(np.int64)
        new = lens[a] + lens[b]
        pool = np.concatenate([pool, _expand(np.stack([a, b], axis=1).ravel(), starts, lens, pool)])
        starts = np.concatenate([starts, len(pool) - int(new.sum()) + np.cumsum(new) - new])
        lens = np.concatenate([lens, new])
        low += n
    return starts, lens, pool


class ShardFile:
    """A shard read back. ``counts``: the number of ids of each text."""

    def __init__(self, data: bytes):
        if len(data) < struct.calcsize(_HEAD):
            raise ValueError("a shard file is cut off or too long")
        magic, width, ids, rounds, rules, texts, symbols = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        at = struct.calcsize(_HEAD)
        if width not in (2, 4) or len(data) != at + 4 * (ids + rounds + 3 * rules) + 8 * (-(-symbols // MARK) + texts) + width * symbols:
            raise ValueError("a shard file is cut off or too long")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        alphabet, sizes, left, right, lens = (take("<u4", n) for n in (ids, rounds, rules, rules, rules))
        self.marks, self.seq, self.counts = take("<u8", -(-symbols // MARK)).astype(np.int64), take(f"<u{width}", symbols), take("<u8", texts).astype(np.int64)
        self.starts, self.lens, self.pool = _expansions(alphabet, sizes, left, right)
        if not np.array_equal(self.lens[ids:], lens):
            raise ValueError("expansion lengths and rules differ")

    def all(self) -> np.ndarray:
        return _expand(self.seq, self.starts, self.lens, self.pool)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high (without), from the symbols that cover them alone."""
        if low >= high:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.marks, low, "right")) - 1
        b = int(np.searchsorted(self.marks, high, "left"))
        part = self.seq[a * MARK : b * MARK]
        ends = self.marks[a] + np.cumsum(self.lens[part])
        i, j = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        before = int(ends[i - 1]) if i else int(self.marks[a])
        return _expand(part[i:j], self.starts, self.lens, self.pool)[low - before : high - before]

    def text(self, i: int) -> np.ndarray:
        low = int(self.counts[:i].sum())
        return self.ids(low, low + int(self.counts[i]))


def write_shards(df: DataFrame, file: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of shard files (part, shard, keys, n_ids, data), in ascending order of keys by (part, shard)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = word_ids(file).encode, TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            nonlocal shard
            keys, ids, counts = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held.clear()
            keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            shard += 1
            cols = [pa.array([part]), pa.array([shard - 1]), keys, pa.array([len(ids)]), pa.array([compress(ids, counts, end)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "shard", "keys", "n_ids", "data"])

        for b in batches:
            for low, texts in parts(b.column(1)):
                ids, counts = encode(texts, end)
                held.append((b.column(0).slice(low, len(counts)), ids, counts))
                if sum(len(x[1]) for x in held) >= SHARD_IDS:
                    yield done()
        if held:
            yield done()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the second column parts rows of one key; their order among themselves is free
    ordered = df.select(key, text).repartitionByRange(n, key, F.xxhash64(text)).sortWithinPartitions(key)
    return saved(mapped(ordered, run, f"part long, shard long, keys array<{kind}>, n_ids long, data binary"), "repair-shards")


def read_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each text, from the files alone."""
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = ShardFile(b.column(3)[i].as_py())
                data, n = memoryview(shard.all().astype("<u4").tobytes()), shard.counts
                starts = np.cumsum(n) - n
                sums = [zlib.crc32(data[4 * s : 4 * (s + c)]) for s, c in zip(starts.tolist(), n.tolist(), strict=True)]
                same = [pa.array(np.full(len(n), b.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                cols = [*same, b.column(2)[i].values, pa.array(starts), pa.array(n), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "shard", key, "own", "n_tokens", "ids_crc32"])

    rows = mapped(shards.select("part", "shard", "keys", "data"), run, f"part long, shard long, `{key}` {kind}, own long, n_tokens long, ids_crc32 long")
    parts = shards.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("ids"))
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("p", F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start"))
    starts = starts.join(parts, F.col("part") == F.col("p")).select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before"))
    out = rows.join(starts, ["part", "shard"])
    return out.select(key, (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
