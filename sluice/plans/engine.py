"""Runs: a source through a cascade to sinks, with statistics and the commit rule for errors.

Records before the first error, in the order of inputs and lines, are written; later ones are
not; the statistics count that prefix, the failing record among the processed ones; then the error is raised.
Records count as classified once they are written. Where a sink fails, nothing after the record that it failed at is
written or counted; a sink that writes in order has ``written``, the number of records it has written, and one
without it is taken to have failed at the first.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..model import INPUT, LINE, SinkError, SourceError, StageError
from ..operators.cascade import Cascade
from ..operators.sinks import Drop, Sink

log = logging.getLogger("sluice")
DROPPED = "records unclassified and dropped; logging the first, see stats for the total"


@dataclass
class Stats:
    processed: int = 0
    classified: int = 0
    reviewed: int = 0
    by_stage: dict[str, int] = field(default_factory=dict)

    def merge(self, other: Stats) -> None:
        self.processed += other.processed
        self.classified += other.classified
        self.reviewed += other.reviewed
        for name, n in other.by_stage.items():
            self.by_stage[name] = self.by_stage.get(name, 0) + n

    def __str__(self) -> str:
        stages = " ".join(f"{k}:{v}" for k, v in sorted(self.by_stage.items(), key=lambda x: x[0].encode()))
        return f"processed={self.processed} classified={self.classified} review={self.reviewed} by_stage=map[{stages}]"


def statistics(df: DataFrame) -> DataFrame:
    """(processed, classified, reviewed) of classified records in one row."""
    decided = F.col("decision").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(decided).alias("classified"), F.count_if(~decided).alias("reviewed")
    )


def by_stage(df: DataFrame) -> DataFrame:
    return df.where(F.col("decision").isNotNull()).groupBy(F.col("decision")["stage"].alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def _place(df: DataFrame) -> Column:
    return F.struct(INPUT, LINE) if INPUT in df.columns else F.struct("id")


def _limit(at: Row, df: DataFrame) -> Column:
    return F.struct(*(F.lit(at[c]).cast(df.schema[c].dataType).alias(c) for c in at.asDict()))


def _counts(df: DataFrame) -> Stats:
    rows = df.groupBy(F.col("decision")["stage"].alias("stage")).agg(F.count(F.lit(1)).alias("n")).collect()
    return _stats({r["stage"]: r["n"] for r in rows})


def _stats(by_stage: dict[str | None, int]) -> Stats:
    left = by_stage.pop(None, 0)
    found = sum(by_stage.values())
    return Stats(found + left, found, left, by_stage)


def commit(df: DataFrame, sink: Sink, review: Sink | None, stats: Stats, logger: logging.Logger = log) -> None:
    """Write classified records by the rule for errors, add them to ``stats``, and raise the first error."""
    place, decided = _place(df), F.col("decision").isNotNull()
    wrong = F.coalesce("source_error", "error") if "source_error" in df.columns else F.col("error")
    is_source = F.col("source_error").isNotNull() if "source_error" in df.columns else F.lit(False)
    found = df.groupBy(F.col("decision")["stage"].alias("stage")).agg(
        F.count_if(wrong.isNull()).alias("n"), F.min(F.when(wrong.isNotNull(), F.struct(place.alias("at"), is_source.alias("source"), wrong.alias("wrong")))).alias("e")
    ).collect()
    first = min((r["e"] for r in found if r["e"] is not None), key=lambda e: tuple(e["at"]), default=None)
    good = df.where(wrong.isNull())
    if first is None:
        done = _stats({r["stage"]: r["n"] for r in found if r["n"]})
    else:
        good = good.where(place < _limit(first["at"], df))
        done = _counts(good)
        done.processed += not first["source"]

    before = getattr(sink, "written", 0)
    try:
        sink.write(good.where(decided))
    except Exception as e:
        n = getattr(sink, "written", 0) - before
        at = good.where(decided).select(place.alias("at")).orderBy("at").offset(n).limit(1).collect()
        if at:
            limit = _limit(at[0]["at"], df)
            left = good.where(place < limit)
            done = _counts(left)
            if done.classified != n:  # rows of one place
                done = Stats(done.reviewed + n, n, done.reviewed, done.by_stage)
            done.processed += 1
            _review(left.where(~decided), review, done, place, logger)
        stats.merge(done)
        raise SinkError("sink", e) from e
    left, before = good.where(~decided), getattr(review, "written", 0)
    try:
        _review(left, review, done, place, logger)
    except Exception as e:
        stats.merge(Stats(done.processed, done.classified, getattr(review, "written", 0) - before + 1, done.by_stage))
        raise SinkError("review sink", e) from e
    stats.merge(done)
    if first is not None:
        name, message = first["wrong"]["stage"], first["wrong"]["message"]
        raise SourceError(message) if first["source"] else StageError(name, message.removeprefix(f"stage {name}: "))


def _review(left: DataFrame, review: Sink | None, done: Stats, place: Column, logger: logging.Logger) -> None:
    if review is not None and not isinstance(review, Drop):
        review.write(left)
    elif done.reviewed:  # one line for each input: the first record that was dropped
        key = F.col(INPUT) if INPUT in left.columns else F.lit(0)
        for r in left.groupBy(key.alias("i")).agg(F.min_by("id", place).alias("id")).orderBy("i").collect():
            logger.warning("%s record=%s", DROPPED, r["id"])


class Engine:
    """``workers`` is kept for compatible configurations: Spark's partitions are the workers, and results are the same for any number.

    The classified records are persisted for the passes over them (counts, each sink, review), unless ``hold`` is false:
    then each pass reads and classifies anew, which is less work where lines are short and stages cheap.
    """

    def __init__(
        self, source: DataFrame, cascade: Cascade, sink: Sink, review: Sink | None = None, workers: int = 0, logger: logging.Logger | None = None, hold: bool = True
    ):
        if source is None:
            raise ValueError("engine: source is required")
        if cascade is None:
            raise ValueError("engine: cascade is required")
        if sink is None:
            raise ValueError("engine: sink is required")
        if workers < 0:
            raise ValueError("engine: workers must not be negative")
        self.source, self.cascade, self.sink, self.review, self.logger, self.hold = source, cascade, sink, review, logger or log, hold
        self.stats, self._tag = Stats(), f"sluice-{uuid.uuid4().hex}"

    def cancel(self) -> None:
        """Stop a run from another thread: its jobs end, and ``run`` raises."""
        self.source.sparkSession.sparkContext.cancelJobsWithTag(self._tag)

    def run(self) -> Stats:
        """The statistics; also in ``stats`` when an error is raised."""
        sc, self.stats = self.source.sparkSession.sparkContext, Stats()
        sc.addJobTag(self._tag)
        df = self.cascade.classify(self.source, tails=True)
        if self.hold:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            commit(df, self.sink, self.review, self.stats, self.logger)
            return self.stats
        finally:
            sc.removeJobTag(self._tag)
            if self.hold:
                df.unpersist()
            self.cascade.release()
