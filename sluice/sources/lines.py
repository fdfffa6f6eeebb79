"""Line sources: text and JSON Lines files as records with line numbers.

``read_text`` gives one record for each line, blank ones too; ``read_jsonl`` one for each line
with an object, skipping blank lines but counting them. A folder is read as its files one after another, by path. Bad lines are rows whose ``source_error`` says
what is wrong, so that one pass can commit the records before them. A line of
MAX_LINE bytes or more is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ERROR

MAX_LINE = 1 << 20
#: Blocks whose first line numbers, one small row each, are sent to all executors; more are joined by a shuffle.
MAX_BLOCKS = 100_000
_BLANK = r"^[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$"


def raw_lines(values: DataFrame) -> DataFrame:
    """(line, _file, _block) of a frame of text files: bytes between line feeds without one trailing carriage return."""
    return values.select(
        F.when(F.col("value").endswith("\r"), F.expr("cast(substring(cast(value as binary), 1, octet_length(value) - 1) as string)")).otherwise(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def numbered(raw: DataFrame, each_file: bool = False) -> DataFrame:
    """Add ``_line``, numbers from 1 over all files in the order of their paths, or in each file.

    Spark numbers the rows of each partition as it reads them. A line's number is its distance
    from the first row of its block plus the lines of the blocks before, which one small
    aggregate counts; the lines themselves are not shuffled or sorted.
    """
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    counts = raw.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    order = Window.partitionBy("_file").orderBy("_block") if each_file else Window.orderBy("_file", "_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    files = len(raw.inputFiles())
    blocks = files + raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() / (64 << 20)
    out = raw.join(F.broadcast(starts) if files and blocks <= MAX_BLOCKS else starts, ["_file", "_block"])
    return out.withColumn("_line", (F.col("_at") + F.col("_shift") + 1).cast("long")).drop("_at", "_shift")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, _line) of a file, or of a folder's files one after another."""
    return numbered(raw_lines(spark.read.option("lineSep", "\n").text(path))).select("line", "_line")


def _source_error(message: Column) -> Column:
    return F.struct(F.lit("").alias("stage"), message.alias("message")).cast(ERROR)


def _too_long(prefix: str, name: Column) -> Column:
    return F.when(F.octet_length("line") >= MAX_LINE, F.concat(F.lit(f"{prefix}: "), name, F.lit(": token too long")))


def text_fields(lines: DataFrame) -> DataFrame:
    """Add the fields of a text line, none, and what is wrong with it, nothing."""
    return lines.withColumns({"fields": F.try_parse_json(F.lit(None).cast("string")), "_problem": F.lit(None).cast("string")})


def jsonl_fields(lines: DataFrame) -> DataFrame:
    """Add the fields of a line of JSON and what is wrong with it, without lines that are blank.

    Objects are strict: the parser allows text after a value, so each line is parsed in an array before a sentinel.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    mark = uuid.uuid4().hex
    kept = lines.where(~F.col("line").rlike(_BLANK))
    kept = kept.withColumn("_wrapped", F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit(f',"{mark}"]'))))
    alone = F.try_variant_get("_wrapped", "$[1]", "string") == mark
    alone = F.coalesce(alone, F.lit(False)) & F.try_variant_get("_wrapped", "$[2]", "variant").isNull()
    first = F.try_variant_get("_wrapped", "$[0]", "variant")
    of = F.schema_of_variant(first)
    bare = F.try_parse_json("line")
    problem = (
        F.when(alone & of.startswith("OBJECT"), F.lit(None).cast("string"))
        .when(alone, "line is not a JSON object")
        .when(F.schema_of_variant(bare).startswith("OBJECT"), "unexpected data after JSON object")
        .when(bare.isNotNull(), "line is not a JSON object")
        .otherwise("line is not valid JSON")
    )
    return kept.withColumns({"fields": F.when(alone & of.startswith("OBJECT"), first), "_problem": problem}).drop("_wrapped")


FIELDS = {"text": text_fields, "jsonl": jsonl_fields}
KINDS = {"text": "text", "jsonl": "json"}


def records(lines: DataFrame, kind: str, name: Column, ordinal: Column) -> DataFrame:
    """Records of numbered lines, with ``source_error`` where a line can't be read. ``name`` is the input's."""
    where = F.concat(name, F.lit(":"), F.col("_line").cast("string"))
    problem = F.when(F.col("_problem").isNotNull(), F.concat(F.lit("jsonl: "), where, F.lit(": "), F.col("_problem")))
    said = F.coalesce(_too_long(kind, name), problem)
    return FIELDS[kind](lines).select(
        where.alias("id"),
        F.lit(KINDS[kind]).alias("kind"),
        F.col("line").cast("binary").alias("data"),
        "fields",
        F.lit(None).cast("map<string,string>").alias("meta"),
        ordinal.alias("_input"),
        F.col("_line"),
        F.when(said.isNotNull(), _source_error(said)).alias("source_error"),
    )


def text_records(lines: DataFrame, name: str, ordinal: int = 0) -> DataFrame:
    return records(lines, "text", F.lit(name), F.lit(ordinal))


def jsonl_records(lines: DataFrame, name: str, ordinal: int = 0) -> DataFrame:
    return records(lines, "jsonl", F.lit(name), F.lit(ordinal))


def read_text(spark: SparkSession, path: str, name: str | None = None, ordinal: int = 0) -> DataFrame:
    return text_records(numbered_lines(spark, path), path if name is None else name, ordinal)


def read_jsonl(spark: SparkSession, path: str, name: str | None = None, ordinal: int = 0) -> DataFrame:
    return jsonl_records(numbered_lines(spark, path), path if name is None else name, ordinal)


def read(spark: SparkSession, kind: str, path: str, name: str | None = None, ordinal: int = 0) -> DataFrame:
    return (read_jsonl if kind == "jsonl" else read_text)(spark, path, name, ordinal)


def read_all(spark: SparkSession, kind: str, paths: Sequence[str]) -> DataFrame:
    """Several inputs, ordered by (_input, _line)."""
    return reduce(DataFrame.unionByName, (read(spark, kind, p, ordinal=i) for i, p in enumerate(paths)))
