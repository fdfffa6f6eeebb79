"""Records from memory and from tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MEMORY = "id string, kind string, data binary, fields string, meta map<string,string>, _input int, _line long"


def from_memory(spark: SparkSession, records: Sequence[dict]) -> DataFrame:
    """Records in the order given: dicts of id, kind, data (bytes or str), fields (dict or None), meta (dict or None)."""
    rows = []
    for i, r in enumerate(records, 1):
        data = r.get("data", b"")
        fields = r.get("fields")
        rows.append(
            (
                r.get("id", ""), r.get("kind", ""), data.encode() if isinstance(data, str) else bytes(data),
                None if fields is None else json.dumps(fields, ensure_ascii=False), r.get("meta"), 0, i,
            )
        )
    return spark.createDataFrame(rows, _MEMORY).withColumn("fields", F.try_parse_json("fields"))


def from_table(df: DataFrame, id: Column | str, data: Column | str, fields: Column | None = None, kind: str = "record") -> DataFrame:  # noqa: A002
    """Records of any table: an id, a payload, and optionally fields (a variant, a JSON string, a struct or a map).

    Only the columns named are read, so that the scan is pruned to them.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    empty = F.try_parse_json(F.lit(None).cast("string"))
    return df.select(
        col(id).cast("string").alias("id"),
        F.lit(kind).alias("kind"),
        col(data).cast("string").cast("binary").alias("data"),
        (empty if fields is None else fields).alias("fields"),
        F.lit(None).cast("map<string,string>").alias("meta"),
    )


def json_fields(text: Column) -> Column:
    """A JSON object column as fields; anything else is no fields."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def struct_fields(*columns: str) -> Column:
    """Columns as one fields object; nulls are absent."""
    return F.parse_json(F.to_json(F.struct(*columns)))
