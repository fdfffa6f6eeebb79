"""Sinks: JSON lines, memory, routing by category, and files in input order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import IO, Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.wire import TAIL, wire_line
from ..model import INPUT, LINE

KNOWN = (0.0, 1.0)


class Sink(Protocol):
    def write(self, df: DataFrame) -> None: ...


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(INPUT, LINE) if INPUT in df.columns else df


@dataclass
class JsonLines:
    """One ordered file or stream. Lines come to the driver one partition at a time, never all at once."""

    out: IO[str]
    exact: bool = False
    written: int = 0

    def write(self, df: DataFrame) -> None:
        lines = in_order(df.select(*(c for c in (INPUT, LINE) if c in df.columns), wire_line(list(KNOWN), self.exact, TAIL in df.columns).alias("line")))
        for row in lines.select("line").toLocalIterator():
            self.out.write(row["line"] + "\n")
            self.written += 1
        self.out.flush()


@dataclass
class JsonLinesFolder:
    """Part files written by the executors: the form for large outputs."""

    path: str
    exact: bool = False
    mode: str = "overwrite"

    def write(self, df: DataFrame) -> None:
        df.select(wire_line(list(KNOWN), self.exact, TAIL in df.columns).alias("value")).write.mode(self.mode).text(self.path)


class Memory:
    """Keeps (record, decision) rows on the driver; for tests and small results."""

    def __init__(self) -> None:
        self._rows: list[Row] = []

    def write(self, df: DataFrame) -> None:
        shown = df.drop(TAIL)
        shown = shown.withColumn("fields", F.to_json("fields")) if "fields" in df.columns else shown
        self._rows += in_order(shown).collect()

    def entries(self) -> list[Row]:
        return list(self._rows)


class Drop:
    def write(self, df: DataFrame) -> None:
        pass


@dataclass
class Router:
    """Rows whose category has a route go there, the others to the fallback; None drops."""

    fallback: Sink | None
    routes: Mapping[str, Sink | None]

    def split(self, df: DataFrame) -> list[tuple[Sink | None, DataFrame]]:
        category = F.col("decision")["category"]
        out = [(sink, df.where(category == name)) for name, sink in self.routes.items()]
        rest = df.where(~category.isin(*self.routes)) if self.routes else df
        return [*out, (self.fallback, rest)]

    def write(self, df: DataFrame) -> None:
        for sink, part in self.split(df):
            if sink is not None and not isinstance(sink, Drop):
                sink.write(part)


Writer = Callable[[DataFrame], None]
