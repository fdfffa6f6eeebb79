"""Exact Jaccard join of word n-gram sets and its connected components.

The join is the product of the document by n-gram incidence matrix with its transpose, computed
in blocks of columns (the shuffle partitions of the n-gram hashes) and only where a pair can
still reach the threshold:

1. Documents with equal sets are one row of the matrix. Each row's n-grams are ordered by hash;
   two rows that link share at least ``extra`` n-grams among the first ``size - least overlap +
   extra``, so rows with fewer n-grams there that any other row has are left out.
2. For the rows left, columns held by one row count as unmatched, and the others are ordered from
   rare to frequent. Rows that link share a column among the first ``size - least overlap + 1``,
   unmatched ones included: only those columns are multiplied.
3. Every row is first compared with one centre of each of its columns. The links found make
   components, and the products of the remaining columns are formed only between rows that are
   still in different components. In the first column that a pair shares, its overlap is at most
   the columns that either row has left, so each row meets only rows of the sizes that this
   overlap allows: a passage that many unlike documents hold makes no pairs of them all. Overlap
   counts accumulate per pair; pairs below the bounds that follow from sizes and the count are
   discarded; the others' whole sets are intersected. Columns that the count misses come after the last one of the row
   whose multiplied columns end first, so there are no more than that row has left.

Every pair that links either has both rows in one component already or is compared, so the
components are exact (up to collisions of 64-bit n-gram hashes). Groups of near copies are not
expanded into pairs.

Null, empty and blank texts have an empty set, size 0, and are linked with nothing: their
component is their own key. Null keys take part and never name a component unless all keys in
it are null. Repeated rows are exact copies. An empty table gives an empty one. Columns other
than key and text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import LOWER, Texts, hashes, joined, mixed, parts
from .util import claim, discard, mapped, saved, scratch, transient

#: Bytes of keys that are sent to all executors at most; beyond it, a shuffle finds the rows.
BROADCAST_BYTES = 48 << 20


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, A-Z in lower case."""
    low = LOWER[texts.buf]
    starts, ends = texts.words()
    w = hashes(low, starts, ends)
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for i in range(k):
        h = joined(h, w[i : i + len(h)])
    h = mixed(h).view(np.int64)
    out, at = [], 0
    for n in texts.held(starts).tolist():
        if n >= k:
            out.append(np.unique(h[at : at + n - k + 1]))
        elif n:
            words = b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(at, at + n))
            out.append(np.array([xxhash.xxh3_64_intdigest(words, seed=n)], np.uint64).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def share(percent: int) -> int:
    """One part in this many of a row is demanded of its first n-grams: fewer where the threshold leaves long prefixes anyway."""
    return 10 if percent >= 85 else 20


def extra(n: int, percent: int) -> int:
    return max(1, -(-n // share(percent)))


def _arrays(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _sets(df: DataFrame, key: str, text: str, k: int, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, n, set, grams) of each row; grams is what ``keep`` leaves of its set."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for b in batches:
            for low, texts in parts(b.column(1)):
                sets = shingle_sets(texts, k)
                sizes, keys = pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary())
                ids = b.column(0).slice(low, len(sets))
                yield pa.RecordBatch.from_arrays([ids, sizes, keys, _arrays([keep(s) for s in sets])], [key, "n", "set", "grams"])

    return mapped(df.select(key, text), run, f"`{key}` {kind}, n long, set binary, grams array<long>")


def _free(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of plans that are no longer in use."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that the links (a, b) reach from each node that has one."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "components")
    while True:
        of = labels.select(F.col("node").alias("b"), "component")
        near = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        now = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        new = saved(now.join(jump, "at").select("node", "was", F.least("at", "next").alias("component")), "components")
        if not new.where("component < was").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


class _Join:
    def __init__(self, percent: int, full: DataFrame):
        self.percent, self.full = percent, full

    def bounded(self, overlap: str) -> str:
        """That an overlap suffices for sizes n and n2."""
        return f"100 * ({overlap}) >= {self.percent} * (n + n2 - ({overlap}))"

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) with a != b, by the intersection of whole sets."""
        one = self.full.select(F.col("nid").alias("a"), "n", F.col("grams").alias("left"))
        two = self.full.select(F.col("nid").alias("b"), F.col("n").alias("n2"), F.col("grams").alias("right"))
        counted = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("left", "right")))
        return saved(counted.where(self.bounded("both")).select("a", "b"), "links")


def _rare_columns(full: DataFrame, percent: int) -> DataFrame:
    """(nid, n, shared, rest, last, cols) of each row that can link: cols are the columns to multiply, the rare ones, and last the last (f, h) of them."""
    cells = full.select("nid", F.explode("grams").alias("h"))
    frequency = saved(cells.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "frequency")
    shared = cells.join(frequency, "h").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("cols"))
    rows = full.select("nid", "n").join(shared, "nid").withColumn("shared", F.size("cols").cast("long"))
    rows = rows.withColumn("take", F.expr(f"int((n - (({percent} * n + 99) div 100) + 1) - (n - shared))")).where("take > 0")
    rows = rows.withColumn("take", F.least("take", "shared").cast("int"))
    rows = rows.withColumn("rest", F.col("shared") - F.col("take")).withColumn("last", F.element_at("cols", F.col("take")))
    rows = rows.withColumn("cols", F.slice("cols.h", F.lit(1), F.greatest("take", F.lit(0))))
    return saved(rows.select("nid", "n", "shared", "rest", "last", "cols"), "rows")


def _links(full: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the rows of ``full`` that have a link."""
    join = _Join(percent, full)
    rows = _rare_columns(full, percent)
    _free(full)
    posts = rows.select(F.explode("cols").alias("h"), "nid", "n", "shared")
    best = saved(posts.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("shared")).alias("u"), "nid", "n", "shared")).alias("c")), "centres")
    star = posts.join(best, "h").select(
        F.col("nid").alias("a"), "n", "shared", F.col("c.nid").alias("b"), F.col("c.n").alias("n2"), F.col("c.shared").alias("shared2")
    )
    star = star.where("a != b").where(join.bounded("least(shared, shared2)"))
    links = join.verified(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = components(links)
    _free(full)

    # (nid, component) of all rows; those without a link yet are components of their own
    own = rows.select("nid", "n", "shared", "cols").join(labels.select(F.col("node").alias("nid"), "component"), "nid", "left")
    own = own.select("nid", "n", "shared", F.coalesce("component", "nid").alias("component"), F.posexplode("cols").alias("pos", "h"))
    own = saved(own.withColumn("reach", F.expr("shared - pos")).drop("shared", "pos"), "postings")
    held = own.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed_ = held.groupBy("h").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed_ = saved(mixed_.select("h", "major"), "mixed")
    # in the first column that a pair shares, no row has more than reach columns left to share: so the sizes of its partners lie between least and most
    open_ = own.join(mixed_, "h").withColumns({"least": F.expr(f"({percent} * n + 99) div 100"), "most": F.expr(f"reach * (100 + {percent}) div {percent} - n")})
    open_ = saved(open_.where("least <= most"), "postings")
    one = open_.where("component != major").select("h", F.col("nid").alias("a"), "n", "least", "most", F.col("component").alias("ca"), F.explode(F.sequence(_band("least"), _band("most"))).alias("band"))
    two = open_.select(
        F.col("h").alias("h2"), F.col("nid").alias("b"), F.col("n").alias("n2"), F.col("least").alias("least2"), F.col("most").alias("most2"),
        F.col("component").alias("cb"), "major", _band("n").alias("band2"),
    )
    fits = F.expr("h = h2 and band = band2 and n2 between least and most and n between least2 and most2 and ca != cb and (cb = major or a < b)")
    pairs = one.join(two, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # the pair's overlap count over all columns that are multiplied, and what the row whose columns end first has left beside
    left = rows.select(F.col("nid").alias("a"), "n", "rest", "last", "cols")
    right = rows.select(F.col("nid").alias("b"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("last").alias("last2"), F.col("cols").alias("cols2"))
    reach = "size(array_intersect(cols, cols2)) + if(last <= last2, rest, rest2)"
    pairs = pairs.join(left, "a").join(right, "b").where(join.bounded(reach)).select("a", "b")
    more = join.verified(pairs)
    if more.limit(1).count():
        labels = components(links.union(more))
    return labels


def _band(size: str) -> Column:
    """A number for sizes that are alike: each up to 64, from there on about one in a hundred."""
    return F.expr(f"if({size} < 64, int({size}), 64 + int(floor(100 * ln({size} / 64.0D))))")


def _small(keys: DataFrame) -> bool:
    """Whether the keys of the only column may be broadcast: by their count and, for strings, their bytes."""
    name = keys.columns[0]
    bytes_ = F.sum(F.octet_length(F.col(name).cast("string")) + 32)
    return (keys.agg(bytes_.alias("b")).first()["b"] or 0) <= BROADCAST_BYTES


def jaccard_components(df: DataFrame, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row, for links of at least ``percent`` per cent Jaccard."""
    spark = df.sparkSession
    with transient(spark):
        at = scratch(spark, "jaccard-rows")
        wide = saved(_sets(df, key, text, k, lambda s: s[: len(s) - least_overlap(len(s), percent) + extra(len(s), percent)]), at=at)
        base = saved(wide.select(key, "n", "set"), "jaccard-sizes", keep=True)
        reps = wide.where("n > 0").groupBy("set").agg(F.min(key).alias("rep"), F.first("n").alias("n"), F.first("grams").alias("grams"))
        at_reps = scratch(spark, "jaccard-reps")
        reps = saved(reps.withColumn("row", F.monotonically_increasing_id()), at=at_reps)
        discard(spark, at)
        _free(df)
        distinct = saved(reps.select("set", "rep", "n", "row"), "jaccard-sets")
        cells = reps.select("row", F.explode("grams").alias("h"))
        # saved, so that the join below has plain exchanges on both sides and Spark can split a frequent n-gram's rows
        frequent = saved(cells.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("h"), "jaccard-frequent")
        _free(df)
        found = cells.join(frequent, "h", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("c"))
        need = f"greatest(1, (({percent} * n + 99) div 100 + {share(percent) - 1}) div {share(percent)})"
        left = saved(distinct.join(found, "row").where(f"c >= {need}").select("set", "rep", "n"), "jaccard-left")
        del reps, cells, frequent, found
        discard(spark, at_reps)
        _free(df)

        picked = left.select(F.col("rep").alias("_rep")).distinct()
        picked = F.broadcast(picked) if _small(picked) else picked
        rows = df.select(key, text).join(picked, F.col(key).eqNullSafe(F.col("_rep")), "left_semi")
        sets = _sets(rows, key, text, k, lambda s: s).join(left.select("set"), "set", "left_semi")
        full = sets.groupBy("set").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
        full = saved(full.withColumn("nid", F.monotonically_increasing_id()), "jaccard-full")
        labels = _links(full, percent)
        of = full.select("set", F.col("nid").alias("node")).join(labels, "node").join(distinct.select("set", "rep"), "set")
        least = of.groupBy("component").agg(F.min("rep").alias("_least"))
        joined = of.join(least, "component").select("set", "_least")
        names = saved(distinct.join(joined, "set", "left").select("set", F.coalesce("_least", "rep").alias("component_id")), "jaccard-names", keep=True)
    out = base.join(names, "set", "left").withColumn("component_id", F.coalesce("component_id", key))
    return out.select(key, F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stand for their component: those of its least key.

    Rows without a key are kept. Rows that repeat a key and its text are one row afterwards.
    """
    found = saved(jaccard_components(df, k, percent, key, text), "jaccard-components")
    drop = found.where(F.col("component_id") != F.col(key)).select(F.col(key).alias("_drop")).distinct()
    drop = F.broadcast(drop) if _small(drop) else drop
    kept = df.join(drop, F.col(key) == F.col("_drop"), "left_anti")
    repeated = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if repeated.limit(1).count():
        keyless = kept.where(F.col(key).isNull())
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key, text]).union(keyless)
    return kept
