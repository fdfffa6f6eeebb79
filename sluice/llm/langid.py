"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled row per language on the cluster and brings one
count per language and bucket to the driver: at most MAX_LANGS x BUCKETS numbers, since the labels are
counted on the cluster first and more of them are refused. Workers hold counts of HELD_LANGS languages at
a time. The log-probability matrix is broadcast; batches of texts are scored as sparse rows: the concatenated
bucket numbers index the matrix and are summed per text. Long texts are taken in blocks, whole.

The score is the posterior of the best language; on whole texts it is next to 1 even where no language
fits. ``lift`` is the mean log-probability of a text's n-grams in its best language less that of buckets drawn
evenly: below 0 the text is less like the language than chance.

A null text, or one without a letter, is ``und`` with score 0; so is every text if there is no
labelled row. Rows with a null label are not learned from. Equal best scores take the first
language by name. Rows whose held-out mark is null are neither held out nor learned from.
Columns other than key, text and label are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import claim, mapped

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 16
BUCKETS = 1 << BITS
MAX_LANGS, HELD_LANGS = 512, 32
SMOOTHING = 0.5
#: Code points that are hashed at a time.
BLOCK = 1 << 18

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def buckets(points: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram that starts at each position, one array for each order."""
    out, shift = [], np.uint32(32 - BITS)
    h = points * _A
    for n in ORDERS:
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _B + points[n - 1 :] * _C
        out.append(((h ^ (h >> np.uint32(13))) * _A >> shift).astype(np.intp))
    return out


def _blocks(text: str) -> Iterator[np.ndarray]:
    points, reach = code_points(text), max(ORDERS) - 1
    for i in range(0, len(points), BLOCK):
        yield points[i : i + BLOCK + reach]


def _buckets_of(text: str) -> Iterator[np.ndarray]:
    """All n-grams of a text, each once: a block's n-grams are those that start in it."""
    for block in _blocks(text):
        yield from (h[:BLOCK] for h in buckets(block))


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # buckets x languages, float32
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The best language of each text, its posterior probability, and its lift over chance."""
        names, probs, lifts = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, probs, lifts
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        total, grams = np.tile(self.prior, (len(rows), 1)), np.zeros(len(rows))
        parts, owner, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if parts:
                starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
                sums = np.add.reduceat(self.logp[np.concatenate(parts)], starts, axis=0, dtype=np.float64)
                np.add.at(total, owner, sums)
                parts.clear()
                owner.clear()
                held = 0

        for k, i in enumerate(rows):
            for h in _buckets_of(texts[i]):
                if len(h):
                    parts.append(h)
                    owner.append(k)
                    grams[k] += len(h)
                    held += len(h)
                    if held >= 2 * BLOCK:
                        flush()
        flush()
        if rows:
            best = total.argmax(axis=1)
            post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            lift = (total[np.arange(len(rows)), best] - self.prior[best]) / grams + np.log(BUCKETS)
            for k, i in enumerate(rows):
                names[i], probs[i], lifts[i] = self.langs[best[k]], float(post[k]), float(lift[k])
        return names, probs, lifts


def train(df: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Fit on every row that has a label and a letter in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        pending: dict[str, list[np.ndarray]] = {}

        def add(lang: str) -> None:
            counts[lang] += np.bincount(np.concatenate(pending.pop(lang)), minlength=BUCKETS)

        def counted() -> Iterator[pa.RecordBatch]:
            for lang in [*pending]:
                add(lang)
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                at, c = np.append(at, -1), np.append(c[at], docs[lang])
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([lang])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(at.astype(np.int32)), pa.array(c)], ["lang", "bucket", "n"])
            counts.clear()
            docs.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang is None or not has_letter(t):
                    continue
                if lang not in counts and len(counts) >= HELD_LANGS:
                    yield from counted()
                counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for h in _buckets_of(t):
                    pending.setdefault(lang, []).append(h)
                    if len(h) >= BLOCK or len(pending[lang]) >= 300:
                        add(lang)
            for lang in [*pending]:
                add(lang)
        yield from counted()

    rows = df.select(F.col(label).cast("string").alias("lang"), text).where(F.col("lang").isNotNull())
    n_langs = rows.select("lang").distinct().count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"{n_langs} languages; the matrix is broadcast for at most {MAX_LANGS}")
    sums = mapped(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    langs = tuple(sorted(set(names)))
    place = {x: i for i, x in enumerate(langs)}
    counts, docs = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    col = np.array([place[x] for x in names], dtype=np.intp)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts[bucket[bucket >= 0], col[bucket >= 0]] = n[bucket >= 0]
    docs[col[bucket < 0]] = n[bucket < 0]
    logp = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)) if langs else counts
    return Model(langs, logp.astype(np.float32), np.log(docs / docs.sum()) if langs else docs)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, lang_pred, score) of each row's whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for b in batches:
            names, probs, _ = sent.value.score(b.column(b.num_columns - 1).to_pylist())
            cols = [*b.columns[:-1], pa.array(names, pa.string()), pa.array(probs, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [key, *carry, "lang_pred", "score"])

    return mapped(df.select(key, *carry, text), run, f"{fields}, lang_pred string, score double")


def known(df: DataFrame, model: Model, min_lift: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language of at least ``min_lift``."""
    sent, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for b in batches:
            names, _, lifts = sent.value.score(b.column(place).to_pylist())
            yield b.filter(pa.array([n != UNKNOWN and x >= min_lift for n, x in zip(names, lifts, strict=True)], pa.bool_()))

    return mapped(df, run, df.schema)


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the key as text, mod 4; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4
