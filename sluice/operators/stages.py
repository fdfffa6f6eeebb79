"""What every stage shares: decisions as Columns, gates, names, and stages of caller code."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import gotext
from ..functions.fields import ColumnFields, ExactFields, VariantFields, literals
from ..model import DECISION

@dataclass(frozen=True)
class Env:
    """The columns that stages read."""

    data: str = "data"
    fields: VariantFields | ColumnFields | ExactFields = VariantFields()

    def text(self) -> Column:
        """The payload as a string with the same bytes."""
        return F.col(self.data).cast("string")


class ColumnStage:
    """A stage whose decision is a Column; null where it can't decide.

    ``valid``: every decision is well formed and its confidence a constant, so that ``decide``
    itself leaves out decisions below ``least`` while the query is planned.
    """

    name = ""
    valid = False

    def decide(self, env: Env, name: str, least: float = 0.0) -> Column:
        raise NotImplementedError


class RowStage:
    """A stage of caller code that runs in Arrow batches, on records that no stage before it decided.

    ``classify`` takes a list of records (dicts of id, kind, data, fields as JSON text, meta) and returns one answer
    for each: None, a (category, confidence) or (category, confidence, reasons) tuple, or an exception.
    """

    def __init__(self, name: str, classify: Callable[[list[dict]], list]):
        self.name, self.classify = name, classify




@dataclass(frozen=True)
class Decided:
    """A constant decision."""

    category: str
    confidence: float
    stage: str
    reasons: tuple[tuple[str, str], ...] = ()

    def column(self) -> Column:
        rows = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(d).alias("detail")) for c, d in self.reasons))
        built = F.struct(
            F.lit(self.category).alias("category"), F.lit(float(self.confidence)).alias("confidence"), F.lit(self.stage).alias("stage"), rows.alias("reasons")
        )
        return built.cast(DECISION)


class ConstantStage(ColumnStage):
    """A stage whose decisions are constants: the first case that holds gives its decision, or else the default.

    Conditions give the number of a case, and one literal array, folded while the query is planned, the decisions.
    """

    valid = True

    def cases(self, env: Env, name: str) -> tuple[list[tuple[Column, Decided]], Decided | None]:
        raise NotImplementedError

    def number(self, env: Env, name: str, least: float, table: list[Decided]) -> Column:
        """The place in ``table`` of the decision, which is added there; null for none and for one below ``least``."""

        def place(d: Decided | None) -> Column:
            if d is None or d.confidence < least:
                return F.lit(None).cast("int")
            table.append(d)
            return F.lit(len(table) - 1)

        cases, default = self.cases(env, name)
        out = None
        for holds, d in cases:
            out = F.when(holds, place(d)) if out is None else out.when(holds, place(d))
        return place(default) if out is None else out.otherwise(place(default))

    def decide(self, env: Env, name: str, least: float = 0.0) -> Column:
        table: list[Decided] = []
        number = self.number(env, name, least, table)
        return F.get(literals([d.column() for d in table]), number) if table else F.lit(None).cast(DECISION)


class Gate:
    """The least confidence that is admitted."""

    def __init__(self, least: float = 0.0):
        if math.isnan(least) or not 0 <= least <= 1:
            raise ValueError(f"min confidence must be within [0, 1], got {gotext.number(least)}")
        self.least = float(least)

    def admits(self, confidence: float) -> bool:
        return confidence >= self.least


def well_formed(c: Column) -> Column:
    confidence = c["confidence"]
    ok = (c["category"] != "") & ~F.isnan(confidence) & (confidence >= 0) & (confidence <= 1)
    return F.coalesce(ok, F.lit(False))


class Gated:
    """A stage whose decisions below the gate count as undecided; ill-formed ones pass, to be refused."""

    def __init__(self, inner: Any, gate: Gate):
        if inner is None:
            raise ValueError("with_gate: stage is nil")
        self.inner, self.gate = inner, gate

    @property
    def name(self) -> str:
        return self.inner.name


class Named:
    """A stage under another name."""

    def __init__(self, inner: Any, name: str):
        if inner is None:
            raise ValueError("with_name: stage is nil")
        self.inner, self.name = inner, name


def with_gate(stage: Any, gate: Gate) -> Gated:
    return Gated(stage, gate)


def with_name(stage: Any, name: str) -> Named:
    return Named(stage, name)


class StaticStage(ColumnStage):
    """Exact lookup of the whole payload. Up to IN_PLAN entries are part of the plan; more are joined, as ``LookupStage`` does."""

    IN_PLAN = 1_000

    def __new__(cls, name: str, categories: dict[str, str]):
        if len(categories) > cls.IN_PLAN:
            return LookupStage(name, dict(categories))
        return super().__new__(cls)

    def __init__(self, name: str, categories: dict[str, str]):
        self.name, self.categories = name, dict(categories)

    def decide(self, env: Env, name: str, least: float = 0.0) -> Column:
        if not self.categories:
            return F.lit(None).cast(DECISION)
        table = F.create_map(*(F.lit(x) for pair in self.categories.items() for x in pair))
        return _looked_up(F.element_at(table, env.text()), name)


def _looked_up(category: Column, name: str) -> Column:
    whole = F.struct(category.alias("category"), F.lit(1.0).alias("confidence"), F.lit(name).alias("stage"), F.array().alias("reasons"))
    return F.when(category.isNotNull(), whole.cast(DECISION))


class LookupStage:
    """Exact lookup of the whole payload in a table of any size, by a join.

    ``categories``: a dict, or a frame of (key, category); of equal keys the least category counts. A table of at most
    BROADCAST_BYTES is sent to all executors; a larger one is joined by shuffles of both sides.
    """

    BROADCAST_BYTES = 32 << 20

    def __init__(self, name: str, categories: dict[str, str] | DataFrame):
        self.name, self.categories = name, categories

    def classify(self, df: DataFrame, env: Env, name: str, open_: Column) -> Column | DataFrame:
        """The frame with ``_found``, the decision of each open record that the table holds."""
        table = self.categories
        if isinstance(table, dict):
            table = df.sparkSession.createDataFrame([*table.items()], "key string, category string")
        table = table.select(F.col("key").cast("string").alias("_key"), F.col("category").cast("string").alias("_category"))
        table = table.where("_key is not null").groupBy("_key").agg(F.min("_category").alias("_category"))
        size = table.agg(F.sum(F.octet_length("_key") + F.octet_length("_category") + 64).alias("s")).first()["s"] or 0
        table = F.broadcast(table) if size <= self.BROADCAST_BYTES else table.hint("shuffle_merge")
        joined = df.withColumn("_text", F.when(open_, env.text())).join(table, F.col("_text") == F.col("_key"), "left")
        return joined.withColumn("_found", _looked_up(F.col("_category"), name)).drop("_text", "_key", "_category")
