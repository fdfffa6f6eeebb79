"""Rules: ordered predicates over payload and fields; the first that holds decides, with confidence 1."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import gotext
from ..functions.regex import PatternError, compile_pattern
from .stages import ConstantStage, Decided, Env

CONDITIONS = ("exact", "contains", "regex", "exists", "gt", "gte", "lt", "lte")


@dataclass(frozen=True)
class FieldMatcher:
    path: str = ""
    exact: str | None = None
    contains: str | None = None
    regex: str | None = None
    exists: bool | None = None
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class Matcher:
    contains: str | None = None
    regex: str | None = None
    field: FieldMatcher | None = None


@dataclass(frozen=True)
class Rule:
    category: str = ""
    id: str = ""
    contains: list[str] = field(default_factory=list)
    regex: list[str] = field(default_factory=list)
    fields: list[FieldMatcher] = field(default_factory=list)
    any: list[Matcher] = field(default_factory=list)
    all: list[Matcher] = field(default_factory=list)


@dataclass(frozen=True)
class Check:
    """What a matcher says of itself, and its predicate; null counts as false."""

    text: str
    holds: Callable[[Env], Column]


def _payload_contains(part: str, where: str) -> Check:
    if not part:
        raise ValueError(f"rules: {where}: empty contains matcher")
    return Check(f"contains {gotext.quote(part)}", lambda env: F.contains(env.text(), F.lit(part)))


def _payload_regex(source: str, where: str) -> Check:
    if not source:
        raise ValueError(f"rules: {where}: empty regex matcher (matches everything)")
    try:
        pattern = compile_pattern(source)
    except PatternError as e:
        raise ValueError(f"rules: {where}: {e}") from e
    return Check(f"regex {gotext.quote(source)}", lambda env: pattern.matches(env.text()))


def _field(m: FieldMatcher, where: str) -> Check:
    if not m.path:
        raise ValueError(f"rules: {where}: field matcher needs a path")
    given = [c for c in CONDITIONS if getattr(m, c) is not None]
    if len(given) != 1:
        raise ValueError(f"rules: {where}: field {gotext.quote(m.path)} needs exactly one of {'/'.join(CONDITIONS)}")
    kind, want, p = given[0], getattr(m, given[0]), m.path
    if kind == "exact":
        return Check(f"field {p} == {gotext.quote(want)}", lambda env: env.fields.text(p) == F.lit(want))
    if kind == "contains":
        if not want:
            raise ValueError(f"rules: {where}: field {gotext.quote(p)}: empty contains matcher")
        return Check(f"field {p} contains {gotext.quote(want)}", lambda env: F.contains(env.fields.text(p), F.lit(want)))
    if kind == "regex":
        try:
            pattern = compile_pattern(want)
        except PatternError as e:
            raise ValueError(f"rules: {where}: field {gotext.quote(p)}: {e}") from e
        return Check(f"field {p} matches {gotext.quote(want)}", lambda env: pattern.matches(env.fields.text(p)))
    if kind == "exists":
        said = f"field {p} exists" if want else f"field {p} absent"
        return Check(said, lambda env: env.fields.structured() & (env.fields.present(p) if want else ~env.fields.present(p)))
    sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[kind]
    bound = float(want)

    def compare(env: Env) -> Column:
        n = env.fields.number(p)
        return {"gt": n > bound, "gte": n >= bound, "lt": n < bound, "lte": n <= bound}[kind]

    return Check(f"field {p} {sign} {gotext.number(bound)}", compare)


def _item(m: Matcher, where: str) -> Check:
    given = [x for x in (m.contains, m.regex, m.field) if x is not None]
    if len(given) != 1:
        raise ValueError(f"rules: {where}: each any/all matcher needs exactly one of contains/regex/field")
    if m.contains is not None:
        return _payload_contains(m.contains, where)
    return _payload_regex(m.regex, where) if m.regex is not None else _field(m.field, where)


@dataclass(frozen=True)
class _Compiled:
    category: str
    code: str
    base: list[Check]
    any: list[Check]
    all: list[Check]

    def detail(self) -> str:
        said = lambda checks, word: f" {word} ".join(c.text for c in checks)
        blocks = [said(self.base, "or")] if self.base else []
        blocks += [f"any({said(self.any, 'or')})"] if self.any else []
        blocks += [f"all({said(self.all, 'and')})"] if self.all else []
        return " and ".join(blocks)

    def holds(self, env: Env) -> Column:
        leaf = lambda c: F.coalesce(c.holds(env), F.lit(False))
        either = lambda checks: reduce(lambda a, b: a | b, map(leaf, checks))
        blocks = [either(checks) for checks in (self.base, self.any) if checks]
        return reduce(lambda a, b: a & b, [*blocks, *map(leaf, self.all)])


class RulesStage(ConstantStage):
    def __init__(self, rules: list[Rule], name: str = "rules"):
        self.name = name
        if not rules:
            raise ValueError("rules: at least one rule is required")
        self.rules = [self._compile(i, r) for i, r in enumerate(rules, 1)]
        every = (f for r in rules for f in (*r.fields, *(m.field for m in (*r.any, *r.all))))
        self.paths = frozenset(f.path for f in every if f is not None)

    @staticmethod
    def _compile(i: int, r: Rule) -> _Compiled:
        if not r.category:
            raise ValueError(f"rules: rule {i}: category is required")
        where = f"rule {i} ({r.id or r.category})"
        if not (r.contains or r.regex or r.fields or r.any or r.all):
            raise ValueError(f"rules: {where}: at least one matcher (contains/regex/fields/any/all) is required")
        base = [_payload_contains(x, where) for x in r.contains]
        base += [_payload_regex(x, where) for x in r.regex]
        base += [_field(x, where) for x in r.fields]
        return _Compiled(r.category, r.id or r.category, base, [_item(x, where) for x in r.any], [_item(x, where) for x in r.all])

    def cases(self, env: Env, name: str) -> tuple[list[tuple[Column, Decided]], None]:
        return [(r.holds(env), Decided(r.category, 1.0, name, ((r.code, r.detail()),))) for r in self.rules], None
