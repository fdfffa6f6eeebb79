"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups of equal texts (nulls are one group) are never divided. Groups fall into weight classes
of one width in 4096 (exact below 4096 bytes); the driver sees only the histogram of classes,
whose size is bounded whatever the data, and packs it: classes by decreasing weight, each group
into the bin with the tightest remaining capacity that holds it, found in a balanced tree. For
a given number of shards, groups heavier than an equal share have a shard each.
Groups of a class are then ranked on the cluster and take their bins by rank. A null text counts
one byte, as an empty one does; repeated rows and null keys are ordinary rows; an empty table
gives an empty one; columns other than key and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import saved, with_rank

_BITS = 12


class BinTree:
    """AVL tree over (remaining capacity, bin): insert, remove, and the least entry not below a bound."""

    def __init__(self) -> None:
        self.root: list | None = None  # [entry, left, right, height]

    @staticmethod
    def _h(t: list | None) -> int:
        return t[3] if t else 0

    def _fix(self, t: list) -> list:
        def high(x: list) -> None:
            x[3] = 1 + max(self._h(x[1]), self._h(x[2]))

        def turn(x: list, a: int, b: int) -> list:
            y = x[a]
            x[a], y[b] = y[b], x
            high(x)
            high(y)
            return y

        high(t)
        d = self._h(t[1]) - self._h(t[2])
        if d > 1:
            if self._h(t[1][1]) < self._h(t[1][2]):
                t[1] = turn(t[1], 2, 1)
            return turn(t, 1, 2)
        if d < -1:
            if self._h(t[2][2]) < self._h(t[2][1]):
                t[2] = turn(t[2], 1, 2)
            return turn(t, 2, 1)
        return t

    def insert(self, entry: tuple[int, int]) -> None:
        def put(t: list | None) -> list:
            if t is None:
                return [entry, None, None, 1]
            side = 1 if entry < t[0] else 2
            t[side] = put(t[side])
            return self._fix(t)

        self.root = put(self.root)

    def remove(self, entry: tuple[int, int]) -> None:
        def cut(t: list, e: tuple[int, int]) -> list | None:
            if e == t[0]:
                if not t[1] or not t[2]:
                    return t[1] or t[2]
                low = t[2]
                while low[1]:
                    low = low[1]
                t[0] = low[0]
                t[2] = cut(t[2], low[0])
            else:
                side = 1 if e < t[0] else 2
                t[side] = cut(t[side], e)
            return self._fix(t)

        self.root = cut(self.root, entry)

    def tightest(self, need: int) -> tuple[int, int] | None:
        best, t = None, self.root
        while t:
            if t[0][0] >= need:
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best


@dataclass(frozen=True)
class WeightClass:
    cls: int
    count: int
    weight: int  # the largest weight in the class


def best_fit_decreasing(classes: list[WeightClass], capacity: int) -> list[tuple[int, int, int]]:
    """(class, bin, count) in order of placement. A weight over the capacity has a bin of its own.

    Equal items go to one bin until it no longer holds another, which is what placing them one by
    one in the tightest bin does.
    """
    tree, bins, placed = BinTree(), 0, []
    for c in sorted(classes, key=lambda c: (-c.weight, c.cls)):
        left = c.count
        while left:
            at = tree.tightest(c.weight)
            if at:
                tree.remove(at)
            else:
                at = (max(capacity, c.weight), bins)
                bins += 1
            take = min(left, at[0] // c.weight)
            placed.append((c.cls, at[1], take))
            tree.insert((at[0] - take * c.weight, at[1]))
            left -= take
    return placed


def least_capacity(classes: list[WeightClass], shards: int) -> list[tuple[int, int, int]]:
    """The packing into at most ``shards`` bins with nearly the least capacity that allows it.

    A group heavier than an equal share of what is left has a bin of its own. For the others, the
    capacity starts at an equal share, and goes up by one part in 2 ** 16, doubled after each failure.
    """
    total = sum(c.count * c.weight for c in classes)
    alone, rest, bins = [], [], 0
    for c in sorted(classes, key=lambda c: (-c.weight, c.cls)):
        left = c.count
        while left and c.weight * (shards - bins) > total:
            alone.append((c.cls, bins, 1))
            total, left, bins = total - c.weight, left - 1, bins + 1
        if left:
            rest.append(WeightClass(c.cls, left, c.weight))
    if not rest:
        return alone
    least, step = max(-(-total // (shards - bins)), rest[0].weight), 0
    while True:
        placed = best_fit_decreasing(rest, least + (least * step >> 16))
        if len({b for _, b, _ in placed}) <= shards - bins:
            return alone + [(cls, bins + b, n) for cls, b, n in placed]
        step = max(1, 2 * step)


def shard_by_bytes(df: DataFrame, shards: int | None = None, capacity: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row.

    With ``capacity``, as few shards of that many bytes as the method finds (a heavier group has
    a shard of its own); with ``shards``, that many, near equal in bytes.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    raw = F.col(text).cast("binary")
    base = saved(
        df.select(
            F.col(key),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(raw), F.lit("null")).alias("_text"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    groups = base.groupBy("_text").agg(F.sum("size").alias("_w"))
    shift = F.greatest(F.length(F.bin("_w")) - _BITS, F.lit(0))
    groups = groups.withColumn("_e", shift).withColumn("_cls", F.expr("_e * 4096L * 4096 + shiftright(_w, _e)"))
    groups = saved(groups.select("_text", "_w", "_cls"), "shard-groups")
    found = groups.groupBy("_cls").agg(F.count(F.lit(1)).alias("n"), F.max("_w").alias("w")).collect()
    classes = [WeightClass(r["_cls"], r["n"], r["w"]) for r in found]
    placed = least_capacity(classes, shards) if shards else best_fit_decreasing(classes, capacity)

    spans, next_rank = [], {}
    for cls, b, n in placed:
        low = next_rank.get(cls, 0)
        spans.append((cls, low, low + n, b))
        next_rank[cls] = low + n
    plan = df.sparkSession.createDataFrame(spans, "_c long, _low long, _high long, shard int")
    ranked = with_rank(groups, "_cls", F.col("_text"), ["_text"], "_rank")
    of = ranked.join(plan, (F.col("_cls") == F.col("_c")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    dealt = base.join(of.select(F.col("_text").alias("_t"), "shard"), F.col("_text") == F.col("_t"))
    out = with_rank(dealt, "shard", F.col("_row"), ["_row"], "slot")
    return out.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
