"""Streams of lines through a cascade, with Structured Streaming."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import Cascade
from ..operators.sinks import Sink
from ..plans.engine import Stats, commit, log
from ..sources.lines import FIELDS, KINDS, numbered, raw_lines, records


def line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(line, _file, _block): the lines of files as they arrive in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return raw_lines(reader.text(path))


def classify_stream(stream: DataFrame, cascade: Cascade, kind: str = "text") -> DataFrame:
    """Decisions of a stream of lines: stateless, so the batch expression is used as it is. Column stages only.

    A stream has no line numbers: ids are empty, and lines that hold no object have no fields.
    """
    out = FIELDS[kind](stream).select(
        F.lit("").alias("id"), F.lit(KINDS[kind]).alias("kind"), F.col("line").cast("binary").alias("data"), "fields", F.lit(None).cast("map<string,string>").alias("meta")
    )
    return out.withColumn("decision", cascade.decision_column())


def run_stream(
    stream: DataFrame, cascade: Cascade, sink: Sink, checkpoint: str, review: Sink | None = None, once: bool = True, kind: str = "text", logger: logging.Logger = log
) -> tuple[StreamingQuery, Stats]:
    """Write each micro-batch of lines to the sinks; the statistics grow as batches end.

    A micro-batch holds whole files, so that records have the ids ``file:line`` that a batch run gives them, and the rule for
    errors holds as it does there: what stands before the first error, by file and line, is written and counted, and the
    query fails. Stop it with ``query.stop()``. With ``once`` it takes what is there and ends.
    """
    stats = Stats()

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            found = records(numbered(batch, each_file=True), kind, F.col("_file"), F.col("_file"))
            done = cascade.classify(found, tails=True).persist()
            try:
                commit(done, sink, review, stats, logger)
            finally:
                done.unpersist()
        finally:
            batch.unpersist()
            cascade.release()

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(), stats
