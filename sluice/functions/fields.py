"""Typed access to a record's fields as Columns.

``VariantFields`` reads the variant column and stays inside the JVM; it knows numbers by value,
so ``1.10`` reads as ``1.1``. ``ColumnFields`` reads typed columns. ``ExactFields`` reads what ``with_exact_fields`` took from the raw JSON of
each record, with the text of numbers as it was written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import gotext
from . import paths

STRING, NUMBER, BOOL, NULL, OTHER = "string", "number", "bool", "null", "other"
_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")


def _kinds() -> Column:
    known = {"STRING": STRING, "BOOLEAN": BOOL, "VOID": NULL} | dict.fromkeys(_NUMBERS, NUMBER)
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))


def bound(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is evaluated once, however often the result names it."""
    return F.get(F.transform(F.array(value), result), 0)


def literals(rows: Iterable[Column]) -> Column:
    """Constants in an array, which Spark folds to one literal while the query is planned."""
    return F.array(*rows)


class VariantFields:
    """Access to a variant column. A null column is a record without fields: nothing is found in it."""

    def __init__(self, column: str = "fields"):
        self.name = column

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def structured(self) -> Column:
        return self.column.isNotNull()

    def _get(self, path: str, kind: str) -> Column:
        keys = paths.split(path)
        if not keys:
            return F.lit(None).cast(kind) if kind != "variant" else F.try_parse_json(F.lit(None).cast("string"))
        path = paths.variant_path(keys)
        if path is not None:
            return F.try_variant_get(self.column, path, kind)
        at = self.column
        for key in keys:
            at = F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), F.lit(key))
        return F.try_variant_get(at, "$", kind)

    def present(self, path: str) -> Column:
        return self._get(path, "variant").isNotNull()

    def kind(self, path: str) -> Column:
        """One of the kinds above; null where there is no value."""
        of = F.substring_index(F.schema_of_variant(self._get(path, "variant")), "(", 1)
        return bound(of, lambda t: F.when(t.isNotNull(), F.coalesce(F.element_at(_kinds(), t), F.lit(OTHER))))

    def text(self, path: str) -> Column:
        """A scalar as text; null for other values and none."""

        def shown(v: Column) -> Column:
            plain = F.try_variant_get(v, "$", "string")
            return bound(
                F.struct(F.substring_index(F.schema_of_variant(v), "(", 1).alias("t"), F.try_variant_get(v, "$", "double").alias("n")),
                lambda x: F.when(x["t"].isin("DOUBLE", "FLOAT") & (F.abs(x["n"]) < 1e15) & (x["n"] == F.floor(x["n"])), x["n"].cast("long").cast("string"))
                .when(x["t"].isin("STRING", "BOOLEAN", *_NUMBERS), plain),
            )

        return bound(self._get(path, "variant"), lambda v: F.when(v.isNotNull(), shown(v)))

    def number(self, path: str) -> Column:
        """A finite number; null for other values, numeric strings and numbers beyond double."""
        finite = lambda n: F.when(F.abs(n) < float("inf"), n)
        numeric = lambda v: F.substring_index(F.schema_of_variant(v), "(", 1).isin(*_NUMBERS)
        return bound(self._get(path, "variant"), lambda v: F.when(numeric(v), bound(F.try_variant_get(v, "$", "double"), finite)))


class ColumnFields:
    """Access to typed columns and nested structs of a table, without a variant: comparisons stay plain columns,
    which Spark compiles and can push into scans. A null is an absent field.
    """

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def structured(self) -> Column:
        return F.lit(True)

    def _find(self, path: str) -> tuple[Column | None, T.DataType | None]:
        keys, at, column = paths.split(path), self.schema, None
        for key in keys:
            if not isinstance(at, T.StructType) or key not in at.names:
                return None, None
            column = F.col(f"`{key.replace('`', '``')}`") if column is None else column.getField(key)
            at = at[key].dataType
        return column, at

    def present(self, path: str) -> Column:
        column, _ = self._find(path)
        return F.lit(False) if column is None else column.isNotNull()

    @staticmethod
    def _kind(of: T.DataType | None) -> str:
        if isinstance(of, T.StringType | T.CharType | T.VarcharType):
            return STRING
        return BOOL if isinstance(of, T.BooleanType) else NUMBER if isinstance(of, T.NumericType) else OTHER

    def kind(self, path: str) -> Column:
        column, of = self._find(path)
        return F.lit(None).cast("string") if column is None else F.when(column.isNotNull(), self._kind(of))

    def text(self, path: str) -> Column:
        column, of = self._find(path)
        if column is None or self._kind(of) == OTHER:
            return F.lit(None).cast("string")
        if isinstance(of, T.DoubleType | T.FloatType):
            whole = (F.abs(column) < 1e15) & (column == F.floor(column))
            return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
        return column.cast("string")

    def number(self, path: str) -> Column:
        column, of = self._find(path)
        if column is None or self._kind(of) != NUMBER:
            return F.lit(None).cast("double")
        value = column.cast("double")
        return F.when(F.abs(value) < float("inf"), value) if isinstance(of, T.DoubleType | T.FloatType) else value


class ExactFields:
    """Access to the column of ``with_exact_fields``: map of path to (kind, text)."""

    def __init__(self, column: str = "_exact"):
        self.name = column

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def structured(self) -> Column:
        return self.column.isNotNull()

    def _entry(self, path: str) -> Column:
        return F.element_at(self.column, F.lit(path))

    def present(self, path: str) -> Column:
        return self._entry(path).isNotNull()

    def kind(self, path: str) -> Column:
        return self._entry(path)["kind"]

    def text(self, path: str) -> Column:
        return F.when(self.kind(path).isin(STRING, NUMBER, BOOL), self._entry(path)["text"])

    def number(self, path: str) -> Column:
        value = F.when(self.kind(path) == NUMBER, self._entry(path)["text"].try_cast("double"))
        return F.when(F.abs(value) < float("inf"), value)


class _Number(str):
    """A number as it is written."""


def parse_exact(data: bytes | str) -> dict | None:
    """A JSON object with the text of its numbers; None for anything else."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
        value = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=refuse)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def scalar(value: object) -> tuple[str, str | None]:
    """Kind and text of a value."""
    match value:
        case _Number():
            return NUMBER, str(value)
        case str():
            return STRING, value
        case bool():
            return BOOL, "true" if value else "false"
        case int():
            return NUMBER, str(value)
        case float():
            return NUMBER, gotext.plain(value)
        case None:
            return NULL, None
    return OTHER, None


def with_exact_fields(df: DataFrame, wanted: Iterable[str], data: str = "data", column: str = "_exact") -> DataFrame:
    """Add the exact kinds and texts at the wanted paths of each record's raw JSON, in one Arrow pass."""
    split = {p: paths.split(p) for p in wanted}

    def one(raw: bytes | None) -> list | None:
        value = None if raw is None else parse_exact(raw)
        if value is None:
            return None
        found = ((p, paths.lookup(value, keys)) for p, keys in split.items())
        return [(p, dict(zip(("kind", "text"), scalar(v), strict=True))) for p, (v, there) in found if there]

    kind = pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("text", pa.string())]))

    @F.arrow_udf("map<string, struct<kind: string, text: string>>")
    def exact(raw: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in raw.to_pylist()], kind)

    return df.withColumn(column, exact(F.col(data)))

