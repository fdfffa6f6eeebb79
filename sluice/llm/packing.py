"""Packing of documents into sequences by cutting-stock column generation.

Each document's ids, with an end id, are cut at multiples of the sequence length, which leaves one
shorter piece. Pieces fall into length classes of ``UNIT`` ids; those below ``SHORT`` ids are first put together in
bundles of equal lengths, which are planned like pieces, so that little is lost to rounding. The driver solves the linear
program over patterns (how many pieces of each class share a sequence) for the histogram of
classes, which has at most ``limit / UNIT`` numbers whatever the data: knapsack dynamic
programming prices new patterns until none would help. Pattern counts are rounded down, the
remainder is placed first-fit by decreasing length, and pieces, ranked in their class on the
cluster, take the places of their class in turn.

Null and empty texts are one piece with the end id alone; repeated rows and null keys are
documents of their own; an empty table gives an empty one; columns other than key and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import parts
from .util import mapped, saved, with_rank
from .wordids import word_ids

LIMIT, UNIT, END = 4096, 16, 2
#: Pieces of fewer ids are bundled, as many of one length as have at most BUNDLE ids.
SHORT, BUNDLE = 128, 512
#: Column generation ends when the linear program is proven to be within this part of its optimum.
GAP = 2e-4

Pattern = tuple[tuple[int, int], ...]  # (class, how many), by decreasing class


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack by dynamic programming: the pattern of most value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, values_up = sizes[order], values[order]
    for w in range(1, capacity + 1):
        k = np.searchsorted(sizes_up, w, side="right")
        best[w] = best[w - 1]
        if k:
            gains = best[w - sizes_up[:k]] + values_up[:k]
            j = int(gains.argmax())
            if gains[j] > best[w] + 1e-12:
                best[w], choice[w] = gains[j], order[j]
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return best[capacity], pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used: min sum(x), patterns @ x >= demand, by revised simplex."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.linalg.inv(basis), demand / np.diag(basis)
    for step in range(40 * m + 200):
        duals = inverse.sum(axis=0)
        value, column = best_pattern(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + GAP:
            break
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, x / way, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    return basis, x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and whole numbers of sequences that hold all pieces of the histogram {class: pieces}."""
    left = {c: n for c, n in histogram.items() if n}
    if not left:
        return []
    sizes = np.array(sorted(left, reverse=True))
    patterns, x = solve(sizes, np.array([left[c] for c in sizes], float), capacity)
    used: list[tuple[Pattern, int]] = []
    for j in np.argsort(-x, kind="stable"):
        pattern = tuple((int(c), int(round(a))) for c, a in zip(sizes, patterns[:, j], strict=True) if round(a) > 0)
        times = min([int(x[j] + 1e-6), *(left[c] // a for c, a in pattern)])
        if times > 0:
            used.append((pattern, times))
            for c, a in pattern:
                left[c] -= a * times
    bins: list[list] = []  # [remaining, {class: n}]
    for c in map(int, sizes):
        for _ in range(left[c]):
            at = next((b for b in bins if b[0] >= c), None)
            if at is None:
                bins.append(at := [capacity, {}])
            at[0] -= c
            at[1][c] = at[1].get(c, 0) + 1
    return used + [(tuple(b[1].items()), 1) for b in bins]


def pieces(df: DataFrame, file: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of each piece of each text's ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(file).encode
        for b in batches:
            rows, starts, lens, sums, tokens = [], [], [], [], []
            for low, texts in parts(b.column(1)):
                ids, counts = encode(texts, end)
                data, at = memoryview(ids.astype("<u4").tobytes()), 0
                for i, n in enumerate(counts.tolist(), low):
                    for start in range(0, n, limit):
                        length = min(limit, n - start)
                        rows.append(i)
                        starts.append(start)
                        lens.append(length)
                        sums.append(zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)]))
                        tokens.append(n)
                    at += n
            cols = [starts, lens, sums, tokens]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                [key, "start", "length", "ids_crc32", "doc_tokens"],
            )

    return mapped(df.select(key, text), run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def bundled(histogram: dict[int, int], limit: int) -> tuple[dict[int, int], list[tuple[int, int, int, int, int]]]:
    """The histogram {class: pieces and bundles}, and where each class's pieces stand in it.

    In the histogram given, pieces of fewer than SHORT ids have the class -length. The list has, for each class: how many
    pieces make a bundle, how many do so, the class of these bundles and their first rank there, and the same for what is left over.
    """
    out = {c: n for c, n in histogram.items() if c > 0}
    rows = []
    for c in sorted(histogram):
        if c > 0:
            rows.append((c, 1, histogram[c], c, 0, c, 0))
            continue
        size = max(1, min(BUNDLE, limit) // -c)
        whole, left = divmod(histogram[c], size)
        wide, rest = (-(-n * -c // UNIT) for n in (size, left))
        rows.append((c, size, whole * size, wide, out.get(wide, 0), rest, out.get(rest, 0) + (whole if rest == wide else 0)))
        out[wide] = out.get(wide, 0) + whole
        if left:
            out[rest] = out.get(rest, 0) + 1
    return out, rows


def pack(df: DataFrame, file: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece. ``limit`` is a multiple of UNIT."""
    if limit < UNIT or limit % UNIT:
        raise ValueError(f"the sequence length must be a multiple of {UNIT}")
    spark = df.sparkSession
    kind = F.expr(f"if(length < {SHORT}, -int(length), int((length + {UNIT - 1}) div {UNIT}))")
    cut = saved(pieces(df, file, limit, end, key, text).withColumns({"_kind": kind, "_row": F.monotonically_increasing_id()}), "pack-pieces")
    histogram, rows = bundled({r["_kind"]: r["n"] for r in cut.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()}, limit)
    places, next_rank, sequence = [], {}, 0
    for pattern, times in plan(histogram, limit // UNIT):
        for c, a in pattern:
            low = next_rank.get(c, 0)
            places.append((c, low, low + a * times, a, sequence))
            next_rank[c] = low + a * times
        sequence += times
    spans = spark.createDataFrame(places, "_c int, _low long, _high long, _a long, _first long")
    # at most SHORT + limit / UNIT rows
    bundles = F.broadcast(spark.createDataFrame(rows, "_kind int, _size long, _whole long, _wide int, _wide0 long, _rest int, _rest0 long"))
    ranked = with_rank(cut, "_kind", F.col("_row"), ["_row"], "_nth").join(bundles, "_kind")
    full = F.col("_nth") < F.col("_whole")
    ranked = ranked.withColumn("_cls", F.when(full, F.col("_wide")).otherwise(F.col("_rest")))
    ranked = ranked.withColumn("_rank", F.when(full, F.expr("_wide0 + _nth div _size")).otherwise(F.col("_rest0")))
    own = ranked.join(spans, (F.col("_cls") == F.col("_c")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    own = own.withColumn("sequence_id", F.expr("_first + (_rank - _low) div _a"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_cls"), "_rank", "_kind", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return own.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
