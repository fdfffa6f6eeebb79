"""Schema stage: records that break field constraints go to a category, with a reason for each violation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import bound, literals
from ..model import DECISION, REASON
from .stages import ColumnStage, Env

ANY, STRING, NUMBER, BOOL = "any", "string", "number", "bool"


@dataclass(frozen=True)
class Field:
    path: str
    required: bool = False
    type: str = ANY


class SchemaStage(ColumnStage):
    """Each field gives a small number: 0 if it is as declared, 1 if it is missing, 2 if its type is wrong. The numbers above 0 pick
    the reasons from a literal array, so that a field is read once for its kind.
    """

    valid = True

    def __init__(self, category: str, fields: list[Field], name: str = "schema"):
        if not category:
            raise ValueError("schema: category is required")
        if not fields:
            raise ValueError("schema: at least one field is required")
        for f in fields:
            if not f.path:
                raise ValueError("schema: field path is required")
            if f.type not in (ANY, STRING, NUMBER, BOOL):
                raise ValueError(f"schema: unknown field type {f.type!r} (want any, string, number, or bool)")
        self.category, self.fields, self.name = category, list(fields), name
        self.paths = frozenset(f.path for f in fields)

    @staticmethod
    def _broken(f: Field, env: Env) -> Column:
        missing = int(f.required)
        if f.type == ANY:
            return F.when(F.coalesce(env.fields.present(f.path), F.lit(False)), 0).otherwise(missing)
        return bound(env.fields.kind(f.path), lambda k: F.when(k.isNull(), missing).when(k == f.type, 0).otherwise(2))

    def decide(self, env: Env, name: str, least: float = 0.0) -> Column:
        checks, said = [], []
        for f in self.fields:
            if not f.required and f.type == ANY:
                continue
            checks.append(_numbered(self._broken(f, env), 2 * len(checks)))
            said.append(_reason("missing", f"required field {f.path} is missing"))
            said.append(_reason("type", f"field {f.path} is not a {f.type}"))
        if not checks:
            return F.lit(None).cast(DECISION)
        table = literals(said)

        def decided(broken: Column) -> Column:
            reasons = F.transform(broken, lambda i: F.get(table, i))
            whole = F.struct(F.lit(self.category).alias("category"), F.lit(1.0).alias("confidence"), F.lit(name).alias("stage"), reasons.alias("reasons"))
            return F.when(F.size(broken) > 0, whole.cast(DECISION))

        return bound(F.array_compact(F.array(*checks)), decided)


def _reason(code: str, detail: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")).cast(REASON)


def _numbered(broken: Column, first: int) -> Column:
    """The place of a field's reason; null if it is as declared."""
    return bound(broken, lambda x: F.when(x > 0, x + (first - 1)))
