"""The record envelope and the decision it gets."""

from __future__ import annotations

from pyspark.sql import types as T

REASON = T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())])
DECISION = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("stage", T.StringType()),
        T.StructField("reasons", T.ArrayType(REASON)),
    ]
)
ERROR = T.StructType([T.StructField("stage", T.StringType()), T.StructField("message", T.StringType())])

#: What a stage says of a record; null where it can't decide.
OUTCOME = T.StructType([T.StructField("decision", DECISION), T.StructField("error", ERROR)])

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("fields", T.VariantType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)

KINDS = ("", "text", "log", "event", "record", "json")

#: Columns that order records: the number of the input and the line within it.
INPUT, LINE = "_input", "_line"


class RunError(Exception):
    """What ends a run; ``str`` says in which part."""


class StageError(RunError):
    """A stage failed on a record, or broke its promise of a well-formed decision."""

    def __init__(self, stage: str, cause: str):
        super().__init__(f"engine: stage {stage}: {cause}")
        self.stage, self.cause = stage, cause


class SourceError(RunError):
    """A line that can't be read as a record."""

    def __init__(self, cause: str):
        super().__init__(f"engine: source: {cause}")


class SinkError(RunError):
    """A sink, or the review sink, could not write."""

    def __init__(self, part: str, cause: Exception):
        super().__init__(f"engine: {part}: {cause}")
        self.cause = cause
