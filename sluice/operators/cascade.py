"""The cascade: stages in order, each record leaving at the first decision that is well formed and admitted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import gotext
from ..functions.fields import literals
from ..functions.wire import TAIL, wire_tail
from ..model import DECISION, ERROR, LINE, OUTCOME
from ..shipping import ship
from ..sources.tables import from_memory
from .stages import ColumnStage, ConstantStage, Decided, Env, Gate, Gated, LookupStage, Named, RowStage, well_formed

_ARROW_DECISION = pa.struct(
    [
        ("category", pa.string()), ("confidence", pa.float64()), ("stage", pa.string()),
        ("reasons", pa.list_(pa.struct([("code", pa.string()), ("detail", pa.string())]))),
    ]
)
_ARROW_OUTCOME = pa.struct([("decision", _ARROW_DECISION), ("error", pa.struct([("stage", pa.string()), ("message", pa.string())]))])


def _unwrap(stage) -> tuple[ColumnStage | RowStage, list[float]]:
    gates = []
    while isinstance(stage, Gated | Named):
        if isinstance(stage, Gated):
            gates.append(stage.gate.least)
        stage = stage.inner
    return stage, gates


def paths_of(stages: Sequence) -> set[str]:
    """The field paths that the stages read."""
    return {p for s in stages for p in getattr(_unwrap(s)[0], "paths", ())}


def _error(stage: str, message: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.concat(F.lit(f"stage {stage}: "), message).alias("message"))


class Cascade:
    def __init__(self, stages: Sequence, min_confidence: float = 0.0, env: Env | None = None):
        if not stages:
            raise ValueError("at least one stage is required")
        seen = set()
        for i, s in enumerate(stages):
            if s is None:
                raise ValueError(f"stage {i} is nil")
            if not s.name:
                raise ValueError("stage name must not be empty")
            if s.name in seen:
                raise ValueError(f"duplicate stage name {gotext.quote(s.name)}")
            seen.add(s.name)
        self.stages, self.gate, self.env = list(stages), Gate(min_confidence), env or Env()
        self._held: list[DataFrame] = []

    def _least(self, gates: list[float]) -> float:
        return max([self.gate.least, *gates])

    def _checked(self, name: str, decided: Column, gates: list[float]) -> tuple[Column, Column]:
        """The admitted decision and the error of a stage whose decisions may be ill-formed."""
        good, least = well_formed(decided), self._least(gates)
        shown = F.concat(
            F.lit('invalid classification: category="'), F.coalesce(decided["category"], F.lit("")), F.lit('" confidence='),
            F.coalesce(decided["confidence"].cast("string"), F.lit("NaN")),
        )
        stamped = decided.withField("stage", F.lit(name))
        return F.when(good & (decided["confidence"] >= least), stamped), F.when(decided.isNotNull() & ~good, _error(name, shown).cast(ERROR))

    def _trusted(self, stage) -> Column | None:
        inner, gates = _unwrap(stage)
        return inner.decide(self.env, stage.name, self._least(gates)) if isinstance(inner, ColumnStage) and inner.valid else None

    def decision_column(self) -> Column:
        """The decision as one Column, for cascades of Column stages whose decisions are all well formed."""
        columns = [self._trusted(s) for s in self.stages]
        if any(c is None for c in columns):
            raise ValueError("some stage runs caller code or may decide ill-formed")
        return F.coalesce(*columns)

    def _constants(self) -> tuple[Column, list[Decided]] | None:
        """The place of a record's decision among all that the cascade can make, if they are constants."""
        table, numbers = [], []
        for s in self.stages:
            inner, gates = _unwrap(s)
            if not isinstance(inner, ConstantStage):
                return None
            numbers.append(inner.number(self.env, s.name, self._least(gates), table))
        return (F.coalesce(*numbers), table) if table else None

    def classify(self, df: DataFrame, tails: bool = False) -> DataFrame:
        """Add ``decision`` (null: for review) and ``error`` (stage, message) to each record.

        Column stages are one expression. A row stage gets only the records that are undecided
        there; the frame before it is persisted, so that earlier stages are not evaluated again.
        With ``tails``, cascades of constant decisions add ``TAIL`` too: what a line of JSON says of
        the decision, for sinks.
        """
        ship(df.sparkSession)
        if constants := self._constants():
            number, table = constants
            added = {"decision": F.get(literals([d.column() for d in table]), number), "error": F.lit(None).cast(ERROR)}
            if tails:
                said = [wire_tail(d.category, d.confidence, d.stage, d.reasons) for d in table]
                added[TAIL] = F.coalesce(F.get(F.array(*map(F.lit, said)), number), F.lit(wire_tail()))
            return df.withColumns(added)
        columns = [self._trusted(s) for s in self.stages]
        if all(c is not None for c in columns):
            return df.withColumn("decision", F.coalesce(*columns)).withColumn("error", F.lit(None).cast(ERROR))
        out = df.withColumn("decision", F.lit(None).cast(DECISION)).withColumn("error", F.lit(None).cast(ERROR))
        open_ = F.col("decision").isNull() & F.col("error").isNull()
        for stage, column in zip(self.stages, columns, strict=True):
            inner, gates = _unwrap(stage)
            if column is not None:
                out = out.withColumn("decision", F.when(open_, column).otherwise(F.col("decision")))
                continue
            if isinstance(inner, ColumnStage):
                own, error = self._checked(stage.name, inner.decide(self.env, stage.name), gates)
                out = out.withColumns({"decision": F.when(open_, own).otherwise(F.col("decision")), "error": F.when(open_, error).otherwise(F.col("error"))})
                continue
            if isinstance(inner, LookupStage):  # its confidence is 1, which every gate admits
                out = inner.classify(out, self.env, stage.name, open_).withColumn("decision", F.coalesce("decision", "_found")).drop("_found")
                continue
            out = out.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(out)
            out = out.where(~open_).unionByName(self._rows(out.where(open_), stage.name, inner, gates))
        return out

    def release(self) -> None:
        """Drop the frames that were persisted before row stages, once results are written."""
        while self._held:
            self._held.pop().unpersist()

    def classify_batch(self, spark: SparkSession, records: Sequence[dict], workers: int = 1) -> list[tuple[dict | None, str | None]]:
        """(decision, error message) of each record, in order; a record that fails does not stop the others.

        For lists that fit the driver. ``workers`` is the number of partitions; results are the same for any.
        """
        df = from_memory(spark, records)
        if workers > 1 and len(records) > 1:
            df = df.repartition(min(workers, len(records)))
        rows = self.classify(df).select(LINE, "decision", "error").collect()
        self.release()
        rows.sort(key=lambda r: r[LINE])
        return [(r["decision"] and r["decision"].asDict(True), r["error"] and r["error"]["message"]) for r in rows]

    def _rows(self, df: DataFrame, name: str, stage: RowStage, gates: list[float]) -> DataFrame:
        has = [c for c in ("id", "kind", "meta") if c in df.columns]
        args = [F.col(c) for c in has] + [F.col(self.env.data).alias("data")]
        if "fields" in df.columns:
            args.append(F.to_json("fields").alias("fields"))
        answer = F.col("_answer")
        asked = df.withColumn("_answer", row_udf(name, stage.classify)(F.struct(*args)))
        own, error = self._checked(name, answer["decision"], gates)
        return asked.withColumns({"decision": own, "error": F.coalesce(answer["error"], error)}).drop("_answer")


def row_udf(name: str, classify):
    def answer(x) -> dict | None:
        if x is None:
            return None
        if isinstance(x, Exception):
            return {"error": {"stage": name, "message": f"stage {name}: {x}"}}
        category, confidence, *rest = x
        reasons = [{"code": c, "detail": d} for c, d in (rest[0] if rest else [])]
        return {"decision": {"category": category, "confidence": confidence, "stage": name, "reasons": reasons}}

    @F.arrow_udf(OUTCOME)
    def run(records: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in records:
            rows = batch.to_pylist()
            for r in rows:
                if isinstance(r.get("meta"), list):
                    r["meta"] = dict(r["meta"])
            try:
                found = classify(rows)
            except Exception as e:
                found = [e] * len(rows)
            yield pa.array([answer(x) for x in found], _ARROW_OUTCOME)

    return run
