"""Queries over the test tables, one for each operator, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import io
import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import logfields
from .functions.fields import ColumnFields, ExactFields, with_exact_fields
from .functions.wire import wire_line
from .functions.wordpiece import WordPiece, encode_column
from .operators.cascade import Cascade
from .operators.mock import MockMatcher, MockStage, Outcome
from .operators.rules import FieldMatcher, Matcher, Rule, RulesStage
from .operators.schema import Field, SchemaStage
from .operators.sinks import JsonLines, JsonLinesFolder, Memory, Router
from .operators.stages import Env, Gate, LookupStage, RowStage, StaticStage, with_gate, with_name
from .model import SinkError
from .plans.engine import Engine, Stats, by_stage, statistics
from .sources import lines, tables
from .streaming.run import classify_stream, line_stream, run_stream

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.from_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.from_table(table(spark, sf_dir, "pages"), "page_id", "html")


def _event_json() -> Column:
    return F.concat(
        F.lit('{"type":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"),
        F.lit(',"value":'), F.col("value").cast("string"), F.lit(',"props":'), "props", F.lit("}"),
    )


def events(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """Events as JSON records: {"type", "user", "value", "props": {"k"}}."""
    raw = table(spark, sf_dir, "events").withColumn("_json", _event_json() if text is None else text)
    return tables.from_table(raw, "event_id", "_json", tables.json_fields(F.col("_json")), kind="json")


def decided(df: DataFrame, stages: list, min_confidence: float = 0.0, env: Env | None = None) -> DataFrame:
    """id and flat decision of every record; nulls where none was made."""
    done = Cascade(stages, min_confidence, env).classify(df)
    return flat(done)


def flat(done: DataFrame) -> DataFrame:
    d = F.col("decision")
    return done.select(
        "id", d["category"].alias("category"), d["confidence"].alias("confidence"), d["stage"].alias("stage"),
        F.element_at(d["reasons"], 1)["code"].alias("code"), F.element_at(d["reasons"], 1)["detail"].alias("detail"),
    )


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(source: str, key: str, found: list[tuple], extra: str = "") -> str:
    """SQL for flat decisions: rows of (condition, category, confidence, stage, code, detail); the first that holds counts."""
    columns = []
    for i, name in enumerate(("category", "confidence", "stage", "code", "detail"), 1):
        whens = " ".join(f"WHEN {c[0]} THEN {q(c[i]) if isinstance(c[i], str) else 'NULL' if c[i] is None else f'{c[i]}::DOUBLE'}" for c in found)
        columns.append(f"CASE {whens} END AS {name}")
    return f"SELECT {key}::VARCHAR AS id, {', '.join(columns)} FROM {source} {extra}"


def rule_case(condition: str, category: str, detail: str, code: str | None = None, stage: str = "rules") -> tuple:
    return (condition, category, 1.0, stage, code or category, detail)


# Payload rules


@query(cases("documents", "doc_id", [
    rule_case("contains(text, 'licensed under') OR contains(text, 'All rights reserved')", "license", 'contains "licensed under" or contains "All rights reserved"', "legal"),
    rule_case("contains(text, 'token = ')", "secret", 'contains "token = "'),
    rule_case("contains(text, 'the')", "english", 'contains "the"'),
]))
def rules_contains_first_match(spark, sf_dir):
    rules = [Rule("license", "legal", contains=["licensed under", "All rights reserved"]), Rule("secret", contains=["token = "]), Rule("english", contains=["the"])]
    return decided(documents(spark, sf_dir), [RulesStage(rules)])


def _regex_query(name: str, table_name: str, key: str, column: str, patterns: dict[str, str]) -> None:
    from . import gotext

    sql = cases(table_name, key, [rule_case(f"regexp_matches({column}, {q(p)})", c, f"regex {gotext.quote(p)}") for c, p in patterns.items()])

    def run(spark, sf_dir):
        df = tables.from_table(table(spark, sf_dir, table_name), key, column)
        return decided(df, [RulesStage([Rule(c, regex=[p]) for c, p in patterns.items()])])

    run.__name__ = name
    query(sql)(run)


_regex_query("rules_regex_anchors", "documents", "doc_id", "text", {"start": "^The", "end": r"er\.$", "line": "(?m)^This .* License", "whole": r"\A\S+\z"})
_regex_query("rules_regex_icase_unicode", "documents", "doc_id", "text", {"accent": "(?i)ÉLEON", "sharp": "(?i)erß", "plain": "(?i)THESTION"})
_regex_query("rules_regex_word_boundary", "documents", "doc_id", "text", {"word": r"\bestion\b", "inside": r"\Bthe\B", "accented": r"é\b"})
_regex_query("rules_regex_posix_class", "documents", "doc_id", "text", {"phone": r"[[:digit:]]{3}-[[:digit:]]{4}", "key": r"[[:xdigit:]]{40}", "caps": r"[[:upper:]]{5}"})
_regex_query("rules_regex_dot_newline", "documents", "doc_id", "text", {"line": r"^.{400}", "all": r"(?s)^.{900}", "some": r"\.\s+\S"})
_regex_query("rules_literal_prefilter", "pages", "page_id", "html", {"ad": r'class="ad">In\b', "short": r"<article>[^<]{0,20}</", "cut": r"&am</title>", "any": r"</article><footer>&copy; [a-z.]+"})


@query(cases("pages", "page_id", [
    rule_case("(contains(html, '&amp;&amp;') OR contains(html, '&quot;')) AND (contains(html, 'lang=\"en\"') OR regexp_matches(html, 'lang=\"d.\"'))", "noisy",
              'contains "&amp;&amp;" or contains "&quot;" and any(contains "lang=\\"en\\"" or regex "lang=\\"d.\\"")'),
    rule_case("contains(html, 'class=\"ad\"') AND contains(html, '<b>')", "advert", 'all(contains "class=\\"ad\\"" and contains "<b>")'),
    rule_case("contains(html, '<nav>') OR contains(html, '<menu>')", "page", 'any(contains "<nav>" or contains "<menu>")'),
]))
def rules_any_all_base(spark, sf_dir):
    rules = [
        Rule("noisy", contains=["&amp;&amp;", "&quot;"], any=[Matcher(contains='lang="en"'), Matcher(regex='lang="d."')]),
        Rule("advert", all=[Matcher(contains='class="ad"'), Matcher(contains="<b>")]),
        Rule("page", any=[Matcher(contains="<nav>"), Matcher(contains="<menu>")]),
    ]
    return decided(pages(spark, sf_dir), [RulesStage(rules)])


@query("""SELECT doc_id::VARCHAR AS id, category, code, detail FROM (SELECT doc_id, CASE WHEN contains(text, 'token = ') AND regexp_matches(text, '[0-9]{16}') THEN
  'both' WHEN contains(text, '"') OR contains(text, '\\') THEN 'quoted' END AS category,
  CASE WHEN contains(text, 'token = ') AND regexp_matches(text, '[0-9]{16}') THEN 'leak-1' WHEN contains(text, '"') OR contains(text, '\\') THEN 'quoted' END AS code,
  CASE WHEN contains(text, 'token = ') AND regexp_matches(text, '[0-9]{16}') THEN 'all(contains "token = " and regex "[0-9]{16}")'
  WHEN contains(text, '"') OR contains(text, '\\') THEN 'contains "\\"" or contains "\\\\"' END AS detail FROM documents)""")
def rule_reasons(spark, sf_dir):
    rules = [Rule("both", "leak-1", all=[Matcher(contains="token = "), Matcher(regex="[0-9]{16}")]), Rule("quoted", contains=['"', "\\"])]
    return decided(documents(spark, sf_dir), [RulesStage(rules)]).select("id", "category", "code", "detail")


# Field rules

_K = "(props::JSON->>'k')::BIGINT"


def _field_query(name: str, matchers: list[tuple[str, FieldMatcher, str, str]], make=events, source: str = "events", exact: bool = False) -> None:
    """matchers: category, matcher, SQL condition, detail."""
    sql = cases(source, "event_id", [rule_case(f"coalesce({c}, false)", name_, d) for name_, _, c, d in matchers])

    def run(spark, sf_dir):
        df, env = make(spark, sf_dir), Env()
        if exact:
            df, env = with_exact_fields(df, [m.path for _, m, _, _ in matchers]), Env(fields=ExactFields())
        return decided(df, [RulesStage([Rule(c, fields=[m]) for c, m, _, _ in matchers])], env=env)

    run.__name__ = name
    query(sql)(run)


_field_query("field_exact", [
    ("seven", FieldMatcher("props.k", exact="7"), f"{_K} = 7", 'field props.k == "7"'),
    ("click", FieldMatcher("type", exact="click"), "event_type = 'click'", 'field type == "click"'),
    ("never", FieldMatcher("props", exact="{}"), "false", 'field props == "{}"'),
])
_field_query("field_contains", [
    ("nine", FieldMatcher("props.k", contains="9"), f"contains({_K}::VARCHAR, '9')", 'field props.k contains "9"'),
    ("ew", FieldMatcher("type", contains="ew"), "contains(event_type, 'ew')", 'field type contains "ew"'),
])
_field_query("field_regex", [
    ("digits", FieldMatcher("props.k", regex="^[1-3][0-9]$"), f"regexp_matches({_K}::VARCHAR, '^[1-3][0-9]$')", 'field props.k matches "^[1-3][0-9]$"'),
    ("s", FieldMatcher("type", regex="^(sign|err)"), "regexp_matches(event_type, '^(sign|err)')", 'field type matches "^(sign|err)"'),
    ("empty", FieldMatcher("user", regex=""), "user_id IS NOT NULL", 'field user matches ""'),
])
for _name, _sign, _bound in (("gt", ">", 50.0), ("gte", ">=", 50.0), ("lt", "<", 10.0), ("lte", "<=", 10.0)):
    _field_query(f"field_{_name}", [
        ("k", FieldMatcher("props.k", **{_name: _bound}), f"{_K} {_sign} {_bound}", f"field props.k {_sign} {int(_bound)}"),
        ("value", FieldMatcher("value", **{_name: 1.5}), f"value {_sign} 1.5", f"field value {_sign} 1.5"),
        ("text", FieldMatcher("type", **{_name: 0.0}), "false", f"field type {_sign} 0"),
    ])


def _sparse_events(spark, sf_dir):
    """Events whose props hold k as null, as a number or not at all, by the remainder of the id."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit('{"k":null}')).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("{}"))
    return events(spark, sf_dir, text)


_field_query("field_exists", [("there", FieldMatcher("k", exists=True), "event_id % 3 < 2", "field k exists")], _sparse_events)
_field_query("field_absent", [("absent", FieldMatcher("k", exists=False), "event_id % 3 = 2", "field k absent")], _sparse_events)
_field_query("field_exact_text", [
    ("trailing", FieldMatcher("n", exact="1.10"), "event_id % 2 = 0", 'field n == "1.10"'),
    ("power", FieldMatcher("n", exact="1e2"), "event_id % 2 = 1", 'field n == "1e2"'),
], lambda spark, sf_dir: events(spark, sf_dir, F.when(F.col("event_id") % 2 == 0, F.lit('{"n":1.10}')).otherwise(F.lit('{"n":1e2}'))), exact=True)


@query(cases("documents", "doc_id", [("false", "x", 1.0, "x", "x", "x")]))
def fields_null_never_match(spark, sf_dir):
    rules = [Rule("absent", fields=[FieldMatcher("a", exists=False)]), Rule("there", fields=[FieldMatcher("a", exists=True)])]
    return decided(documents(spark, sf_dir), [RulesStage(rules)])


def _nested_events(spark, sf_dir):
    """Events as {"a": {"b": k}, "a.b": k + 1, "c/d": {"~": k + 2}, "r": [k]}."""
    k = F.get_json_object("props", "$.k").cast("long")
    s = lambda n: (k + n).cast("string")
    text = F.concat(F.lit('{"a":{"b":'), s(0), F.lit('},"a.b":'), s(1), F.lit(',"c/d":{"~":'), s(2), F.lit('},"r":['), s(0), F.lit("]}"))
    return events(spark, sf_dir, text)


_field_query("path_dot", [("dot", FieldMatcher("a.b", gte=50.0), f"{_K} >= 50", "field a.b >= 50"), ("empty", FieldMatcher("a..b", exists=True), "false", "field a..b exists")], _nested_events)
_field_query("path_pointer", [
    ("dotted", FieldMatcher("/a.b", lt=20.0), f"{_K} + 1 < 20", "field /a.b < 20"),
    ("escaped", FieldMatcher("/c~1d/~0", gt=90.0), f"{_K} + 2 > 90", "field /c~1d/~0 > 90"),
    ("nested", FieldMatcher("/a/b", exists=True), f"{_K} IS NOT NULL", "field /a/b exists"),
], _nested_events)
_field_query("path_no_array_index", [("index", FieldMatcher("r.0", exists=True), "false", "field r.0 exists"), ("array", FieldMatcher("r", exists=True), "true", "field r exists")], _nested_events)

# Schema


def _violations(done: DataFrame) -> DataFrame:
    return done.where("decision is not null").select("id", F.col("decision")["category"].alias("category"), F.posexplode(F.col("decision")["reasons"]).alias("pos", "r")).select(
        "id", "category", "pos", F.col("r.code").alias("code"), F.col("r.detail").alias("detail")
    )


@query("SELECT event_id::VARCHAR AS id, 'bad' AS category, 0 AS pos, 'missing' AS code, 'required field k is missing' AS detail FROM events WHERE event_id % 3 = 2")
def schema_required(spark, sf_dir):
    return _violations(Cascade([SchemaStage("bad", [Field("k", True)])]).classify(_sparse_events(spark, sf_dir)))


@query("SELECT event_id::VARCHAR AS id, 'bad' AS category, 0 AS pos, 'type' AS code, 'field k is not a number' AS detail FROM events WHERE event_id % 3 = 0")
def schema_types(spark, sf_dir):
    return _violations(Cascade([SchemaStage("bad", [Field("k", False, "number")])]).classify(_sparse_events(spark, sf_dir)))


@query("""SELECT event_id::VARCHAR AS id, 'bad' AS category, pos, code, detail FROM events,
  (VALUES (0, 'missing', 'required field z is missing'), (1, 'type', 'field type is not a number'), (2, 'type', 'field props is not a string'),
          (3, 'missing', 'required field props.q is missing'), (4, 'type', 'field value is not a bool')) v(pos, code, detail)""")
def schema_multi_violation_order(spark, sf_dir):
    fields = [Field("z", True), Field("props.k", True, "number"), Field("type", False, "number"), Field("props", False, "string"), Field("props.q", True, "bool"), Field("value", True, "bool"), Field("y", False, "string")]
    return _violations(Cascade([SchemaStage("bad", fields)]).classify(events(spark, sf_dir)))


@query(cases("events", "event_id", [
    ("event_id % 3 = 2", "quarantine", 1.0, "schema", "missing", "required field k is missing"),
    rule_case(f"event_id % 3 = 1 AND {_K} > 50", "high", "field k > 50"),
]))
def schema_escalates(spark, sf_dir):
    stages = [SchemaStage("quarantine", [Field("k", True)]), RulesStage([Rule("high", fields=[FieldMatcher("k", gt=50.0)])])]
    return decided(_sparse_events(spark, sf_dir), stages)


@query("SELECT doc_id::VARCHAR AS id, 'bad' AS category, 0 AS pos, 'missing' AS code, 'required field a is missing' AS detail FROM documents")
def schema_nil_fields(spark, sf_dir):
    return _violations(Cascade([SchemaStage("bad", [Field("a", True, "string"), Field("b", False, "number")])]).classify(documents(spark, sf_dir)))


# Mock, static, cascade

_MOCK = [MockMatcher(["token", "licensed"], "legal", 0.85), MockMatcher(["the "], "english", 0.6)]
_MOCK_SQL = [
    ("contains(text, 'token') OR contains(text, 'licensed')", "legal", 0.85, "mock", "mock", 'mock score 0.85 for "legal"'),
    ("contains(text, 'the ')", "english", 0.6, "mock", "mock", 'mock score 0.6 for "english"'),
]
_MOCK_ELSE = ("true", "unknown", 0.4, "mock", "mock", 'mock score 0.4 for "unknown"')


@query(cases("documents", "doc_id", _MOCK_SQL))
def mock_first_match(spark, sf_dir):
    return decided(documents(spark, sf_dir), [MockStage(_MOCK)])


@query(cases("documents", "doc_id", [*_MOCK_SQL, _MOCK_ELSE]))
def mock_default(spark, sf_dir):
    return decided(documents(spark, sf_dir), [MockStage(_MOCK, Outcome("unknown", 0.4))])


@query("""SELECT o_orderkey::VARCHAR AS id, v.category, CASE WHEN v.category IS NOT NULL THEN 1.0::DOUBLE END AS confidence, CASE WHEN v.category IS NOT NULL THEN 'status' END AS stage,
  NULL::VARCHAR AS code, NULL::VARCHAR AS detail FROM orders LEFT JOIN (VALUES ('O', 'open'), ('F', 'done')) v(k, category) ON o_orderstatus = k""")
def static_lookup(spark, sf_dir):
    df = tables.from_table(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")
    done = Cascade([StaticStage("status", {"O": "open", "F": "done"})]).classify(df)
    d = F.col("decision")
    return done.select(
        "id", d["category"].alias("category"), d["confidence"].alias("confidence"), d["stage"].alias("stage"),
        F.get(d["reasons"], 0)["code"].alias("code"), F.get(d["reasons"], 0)["detail"].alias("detail"),
    )


@query("""SELECT d.doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 3 THEN 'seventh' ELSE (SELECT min('b' || (b.doc_id % 10)) FROM documents b WHERE b.text = d.text) END AS category FROM documents d""")
def static_lookup_join(spark, sf_dir):
    """Whole texts looked up in a table of all texts, after a stage that has decided some."""
    raw = table(spark, sf_dir, "documents")
    texts = raw.select(F.col("text").alias("key"), F.concat(F.lit("b"), (F.col("doc_id") % 10).cast("string")).alias("category"))
    seventh = RowStage("seventh", lambda rows: [("seventh", 1.0) if int(r["id"]) % 7 == 3 else None for r in rows])
    done = Cascade([seventh, LookupStage("texts", texts)]).classify(documents(spark, sf_dir))
    return done.select("id", F.col("decision")["category"].alias("category"))


@query("SELECT event_id::VARCHAR AS id, CASE WHEN user_id % 2 = 0 THEN 'even' END AS category FROM events")
def path_both_quotes(spark, sf_dir):
    """A key with both kinds of quotes."""
    df = events(spark, sf_dir, F.concat(F.lit('{"a\'\\"b":{"n":'), (F.col("user_id") % 2).cast("string"), F.lit("}}")))
    done = Cascade([RulesStage([Rule("even", fields=[FieldMatcher("a'\"b.n", exact="0")])])]).classify(df)
    return done.select("id", F.col("decision")["category"].alias("category"))


_LICENSE = [Rule("license", contains=["licensed under"])]
_LICENSE_SQL = rule_case("contains(text, 'licensed under')", "license", 'contains "licensed under"')


@query(cases("documents", "doc_id", [_LICENSE_SQL, *_MOCK_SQL, _MOCK_ELSE]))
def cascade_escalation(spark, sf_dir):
    return decided(documents(spark, sf_dir), [RulesStage(_LICENSE), MockStage(_MOCK, Outcome("unknown", 0.4))])


@query(cases("documents", "doc_id", [_LICENSE_SQL, _MOCK_SQL[0]]))
def gate_global(spark, sf_dir):
    return decided(documents(spark, sf_dir), [RulesStage(_LICENSE), MockStage(_MOCK, Outcome("unknown", 0.4))], min_confidence=0.7)


_MODEL = [("model" if i == 3 else x for i, x in enumerate(row)) for row in _MOCK_SQL]
_MODEL_SQL = [tuple(row) for row in _MODEL]


@query(cases("documents", "doc_id", [
    _LICENSE_SQL, _MODEL_SQL[0], (_MODEL_SQL[1][0], "english", 0.9, "late", "mock", 'mock score 0.9 for "english"'),
]))
def gate_per_stage(spark, sf_dir):
    late = with_name(MockStage([MockMatcher(["the "], "english", 0.9)]), "late")
    stages = [with_gate(RulesStage(_LICENSE), Gate(1.0)), with_gate(with_name(MockStage(_MOCK), "model"), Gate(0.7)), late]
    return decided(documents(spark, sf_dir), stages)


@query(cases("documents", "doc_id", _MOCK_SQL))
def gate_boundary(spark, sf_dir):
    return decided(documents(spark, sf_dir), [with_gate(MockStage(_MOCK), Gate(0.6))], min_confidence=0.6)


@query(cases("documents", "doc_id", [
    rule_case("contains(text, 'licensed under')", "license", 'contains "licensed under"', stage="first"),
    rule_case("contains(text, 'token = ')", "secret", 'contains "token = "', stage="second"),
]))
def stage_rename_twice(spark, sf_dir):
    return decided(documents(spark, sf_dir), [with_name(RulesStage(_LICENSE), "first"), with_name(RulesStage([Rule("secret", contains=["token = "])]), "second")])


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN contains(text, 'licensed under') THEN 'license' WHEN length(text) < 200 THEN 'short' END AS category,
  CASE WHEN NOT contains(text, 'licensed under') AND length(text) > 20000 THEN 'stage size: too long' END AS error FROM documents""")
def batch_results(spark, sf_dir):
    def size(rows):
        found = [r["data"].decode() for r in rows]
        return [ValueError("too long") if len(t) > 20000 else ("short", 0.5) if len(t) < 200 else None for t in found]

    done = Cascade([RulesStage(_LICENSE), RowStage("size", size)]).classify(documents(spark, sf_dir))
    return done.select("id", F.col("decision")["category"].alias("category"), F.col("error")["message"].alias("error"))


@query(cases("documents", "doc_id", [
    _LICENSE_SQL, ("array_length(string_split(text, ' ')) > 300", "long", 0.75, "words", "words", "more than 300"), ("true", "short", 0.9, "rest", "mock", 'mock score 0.9 for "short"'),
]))
def custom_udf_stage(spark, sf_dir):
    def words(rows):
        return [("long", 0.75, [("words", "more than 300")]) if r["data"].count(b" ") + 1 > 300 else ("short", 0.2) for r in rows]

    rest = with_name(MockStage(default=Outcome("short", 0.9)), "rest")
    return decided(documents(spark, sf_dir), [RulesStage(_LICENSE), with_gate(RowStage("words", words), Gate(0.5)), rest])


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN contains(text, 'licensed under') THEN NULL WHEN length(text) % 2 = 0 THEN 'stage odd: invalid classification: category="" confidence=0.5'
  WHEN length(text) % 3 = 0 THEN 'stage odd: invalid classification: category="x" confidence=1.5' END AS error FROM documents""")
def result_validation(spark, sf_dir):
    def odd(rows):
        sizes = [len(r["data"].decode()) for r in rows]
        return [("", 0.5) if n % 2 == 0 else ("x", 1.5) if n % 3 == 0 else ("x", 0.5) for n in sizes]

    done = Cascade([RulesStage(_LICENSE), RowStage("odd", odd)], min_confidence=0.9).classify(documents(spark, sf_dir))
    return done.select("id", F.col("error")["message"].alias("error"))


# Routing, review, statistics

_EVENT_RULES = [
    Rule("alert", fields=[FieldMatcher("type", exact="error")]),
    Rule("noise", all=[Matcher(field=FieldMatcher("type", exact="view")), Matcher(field=FieldMatcher("props.k", lt=50.0))]),
    Rule("sale", fields=[FieldMatcher("type", exact="purchase")]),
]
_EVENT_CASE = f"CASE WHEN event_type = 'error' THEN 'alert' WHEN event_type = 'view' AND {_K} < 50 THEN 'noise' WHEN event_type = 'purchase' THEN 'sale' END"


def _classified_events(spark, sf_dir):
    return Cascade([RulesStage(_EVENT_RULES)]).classify(events(spark, sf_dir))


def _routed(df: DataFrame, fallback, routes: dict) -> list[tuple[object, DataFrame]]:
    return Router(fallback, routes).split(df.where("decision is not null"))


@query(f"SELECT c AS route, count(*) AS n FROM (SELECT {_EVENT_CASE} AS c FROM events) WHERE c IS NOT NULL GROUP BY c")
def route_counts(spark, sf_dir):
    parts = _routed(_classified_events(spark, sf_dir), "sale", {"alert": "alert", "noise": "noise"})
    out = [p.groupBy(F.lit(name).alias("route")).agg(F.count(F.lit(1)).alias("n")) for name, p in parts]
    return out[0].union(out[1]).union(out[2])


@query(f"SELECT event_id::VARCHAR AS id, c AS category FROM (SELECT event_id, {_EVENT_CASE} AS c FROM events) WHERE c IN ('alert', 'sale')")
def route_drop(spark, sf_dir):
    parts = [p for name, p in _routed(_classified_events(spark, sf_dir), "rest", {"noise": None}) if name]
    return parts[0].select("id", F.col("decision")["category"].alias("category"))


@query(f"SELECT event_id::VARCHAR AS id, c AS category FROM (SELECT event_id, {_EVENT_CASE} AS c FROM events) WHERE c = 'sale'")
def route_fallback(spark, sf_dir):
    parts = dict(_routed(_classified_events(spark, sf_dir), "rest", {"noise": "n", "alert": "a"}))
    return parts["rest"].select("id", F.col("decision")["category"].alias("category"))


@query(f"""SELECT '{{"id":"' || event_id || '","kind":"json","data":"' || replace(j, '"', '\\"') || '","fields":{{"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '","user":' || user_id
  || '}},"category":"","confidence":0}}' AS line FROM (SELECT *, {_EVENT_CASE} AS c, '{{"type":"' || event_type || '","user":' || user_id || ',"props":' || props || '}}' AS j FROM events) WHERE c IS NULL""")
def review_rows(spark, sf_dir):
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit("}"))
    done = Cascade([RulesStage(_EVENT_RULES)]).classify(events(spark, sf_dir, text))
    return done.where("decision is null").select(wire_line().alias("line"))


@query(f"SELECT count(*) AS processed, count(c) AS classified, count(*) - count(c) AS reviewed FROM (SELECT {_EVENT_CASE} AS c FROM events)")
def stats_summary(spark, sf_dir):
    return statistics(_classified_events(spark, sf_dir))


@query("""SELECT stage, count(*) AS n FROM (SELECT CASE WHEN contains(text, 'licensed under') THEN 'rules' WHEN contains(text, 'token') OR contains(text, 'licensed') OR contains(text, 'the ')
  THEN 'mock' END AS stage FROM documents) WHERE stage IS NOT NULL GROUP BY stage""")
def stats_by_stage(spark, sf_dir):
    return by_stage(Cascade([RulesStage(_LICENSE), MockStage(_MOCK)]).classify(documents(spark, sf_dir)))


@query(f"""SELECT '{{"id":"' || event_id || '","kind":"json","data":"' || replace(j, '"', '\\"') || '","fields":{{"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '"}},"category":"' || c
  || '","confidence":1,"stage":"rules","reasons":[{{"code":"' || c || '","detail":"' || CASE c WHEN 'alert' THEN 'field type == \\"error\\"' WHEN 'sale' THEN 'field type == \\"purchase\\"'
  ELSE 'all(field type == \\"view\\" and field props.k < 50)' END || '"}}]}}' AS line
  FROM (SELECT *, {_EVENT_CASE} AS c, '{{"type":"' || event_type || '","props":' || props || '}}' AS j FROM events) WHERE c IS NOT NULL""")
def wire_jsonl_line(spark, sf_dir):
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))
    done = Cascade([RulesStage(_EVENT_RULES)]).classify(events(spark, sf_dir, text))
    return done.where("decision is not null").select(wire_line().alias("line"))


# Sources


def _folder(spark: SparkSession, tag: str) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def _spooled(df: DataFrame, tag: str, one: bool = False) -> str:
    """A folder of text files of a sorted string column: the files' names are in the frame's order, as are their lines."""
    path = _folder(df.sparkSession, tag)
    (df.coalesce(1) if one else df).write.text(path)
    return path


_DOC_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents"


@query(f"SELECT 'docs:' || row_number() OVER (ORDER BY doc_id, pos) AS id, line AS data FROM ({_DOC_LINES})")
def text_scan_ids(spark, sf_dir):
    path = _spooled(table(spark, sf_dir, "documents").orderBy("doc_id").select(F.coalesce("text", F.lit(""))), "lines")
    return lines.read_text(spark, path, "docs").select("id", F.col("data").cast("string").alias("data"))


_JSON_SQL = """'{"type":"' || event_type || '","user":' || user_id || ',"props":' || props || '}'"""


def _event_lines(spark, sf_dir, line: Column, one: bool = False) -> str:
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit("}"))
    return _spooled(table(spark, sf_dir, "events").withColumn("j", text).orderBy("event_id").select(line), "events", one)


@query(f"""SELECT 'ev:' || n AS id, event_type AS type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE event_id % 5 <> 0""")
def jsonl_scan_ids(spark, sf_dir):
    path = _event_lines(spark, sf_dir, F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.col("j")))
    return lines.read_jsonl(spark, path, "ev").select("id", F.try_variant_get("fields", "$.type", "string").alias("type"))


@query("""SELECT 'ev:' || n AS id, CASE event_id % 6 WHEN 1 THEN 'jsonl: ev:' || n || ': unexpected data after JSON object' WHEN 2 THEN 'jsonl: ev:' || n || ': line is not a JSON object'
  WHEN 3 THEN 'jsonl: ev:' || n || ': line is not valid JSON' WHEN 4 THEN 'jsonl: ev:' || n || ': unexpected data after JSON object' END AS error
  FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)""")
def jsonl_strictness(spark, sf_dir):
    k, j = F.col("event_id") % 6, F.col("j")
    bad = F.when(k == 1, F.concat(j, F.lit(" x"))).when(k == 2, F.concat(F.lit("["), j, F.lit("]"))).when(k == 3, F.concat(F.lit("{"), j)).when(k == 4, F.concat(j, j)).otherwise(j)
    return lines.read_jsonl(spark, _event_lines(spark, sf_dir, bad), "ev").select("id", F.col("source_error")["message"].alias("error"))


@query("""SELECT 'a:' || row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS data, 0 AS input FROM nation
  UNION ALL SELECT 'b:' || row_number() OVER (ORDER BY r_regionkey), r_name, 1 FROM region""")
def multi_file_union(spark, sf_dir):
    a = _spooled(table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name"), "a")
    b = _spooled(table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name"), "b")
    both = lines.read_text(spark, a, "a", 0).unionByName(lines.read_text(spark, b, "b", 1))
    return both.select("id", F.col("data").cast("string").alias("data"), F.col("_input").alias("input"))


@query("""SELECT 'ev:' || n AS id FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) AS n, min(CASE WHEN event_id % 4999 = 4998 THEN event_id END) OVER () AS stop, event_id FROM events)
  WHERE event_type = 'error' AND (stop IS NULL OR event_id < stop)""")
def error_commits_prefix(spark, sf_dir):
    """What a run writes before the first line that is no object."""
    path = _event_lines(spark, sf_dir, F.when(F.col("event_id") % 4999 == 4998, F.lit("{")).otherwise(F.col("j")))
    out = _folder(spark, "prefix")
    source = lines.read_jsonl(spark, path, "ev")
    engine = Engine(source, Cascade([RulesStage([Rule("alert", fields=[FieldMatcher("type", exact="error")])])]), JsonLinesFolder(out))
    try:
        engine.run()
    except Exception as e:
        if "line is not valid JSON" not in str(e):
            raise
    return spark.read.text(out).select(F.get_json_object("value", "$.id").alias("id"))


@query(f"SELECT coalesce(c, 'review') AS category, count(*) AS n FROM (SELECT {_EVENT_CASE} AS c FROM events) GROUP BY 1")
def engine_run(spark, sf_dir):
    """A whole run with routes and review into folders, read back and counted."""
    main, alert, review = (_folder(spark, t) for t in ("main", "alert", "review"))
    routes = {"alert": JsonLinesFolder(alert)}
    Engine(events(spark, sf_dir), Cascade([RulesStage(_EVENT_RULES)]), Router(JsonLinesFolder(main), routes), JsonLinesFolder(review)).run()
    rows = spark.read.text([main, alert, review]).select(F.get_json_object("value", "$.category").alias("c"))
    return rows.groupBy(F.when(F.col("c") == "", "review").otherwise(F.col("c")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nation' AS id, n_name AS data, 'low' AS category FROM nation WHERE n_regionkey < 2")
def memory_source_and_sink(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").collect()
    source = tables.from_memory(spark, [{"id": "nation", "data": r["n_name"], "fields": {"r": r["n_regionkey"]}} for r in rows])
    sink = Memory()
    Engine(source, Cascade([RulesStage([Rule("low", fields=[FieldMatcher("r", lte=1.0)])])]), sink).run()
    return spark.createDataFrame([(e["id"], bytes(e["data"]).decode(), e["decision"]["category"]) for e in sink.entries()], "id string, data string, category string")


@query("""SELECT row_number() OVER (ORDER BY r_regionkey) AS n, '{"id":"t:' || row_number() OVER (ORDER BY r_regionkey) || '","data":"' || r_name
  || '","category":"all","confidence":0.5,"stage":"mock","reasons":[{"code":"mock","detail":"mock score 0.5 for \\"all\\""}]}' AS line FROM region""")
def ordered_jsonl_sink(spark, sf_dir):
    path = _spooled(table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name"), "t")
    out = io.StringIO()
    Engine(lines.read_text(spark, path, "t"), Cascade([MockStage(default=Outcome("all", 0.5))]), JsonLines(out)).run()
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines(), 1)), "n long, line string")


@query(f"SELECT coalesce(c, 'review') AS category, count(*) AS n FROM (SELECT {_EVENT_CASE} AS c FROM events) GROUP BY 1")
def streaming_equals_batch(spark, sf_dir):
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))
    path = _folder(spark, "stream")
    table(spark, sf_dir, "events").select(text).repartition(4).write.text(path)
    done = classify_stream(line_stream(spark, path, files_per_batch=2), Cascade([RulesStage(_EVENT_RULES)]), "jsonl")
    out = _folder(spark, "streamed")
    flat_rows = done.select(F.coalesce(F.col("decision")["category"], F.lit("review")).alias("category"))
    writer = flat_rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "progress")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(out).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


class _Refusing:
    """A sink that fails at once."""

    def write(self, df: DataFrame) -> None:
        raise OSError("refused")


@query(f"""SELECT min(n) AS processed, 0 AS classified, min(n) - 1 AS reviewed FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, {_EVENT_CASE} AS c FROM events) WHERE c IS NOT NULL""")
def stats_after_sink_error(spark, sf_dir):
    """What a run has counted when its sink fails at the first record."""
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))
    path = _spooled(table(spark, sf_dir, "events").orderBy("event_id").select(text), "events")
    engine = Engine(lines.read_jsonl(spark, path, "ev"), Cascade([RulesStage(_EVENT_RULES)]), _Refusing())
    try:
        engine.run()
    except SinkError as e:
        if str(e) != "engine: sink: refused":
            raise
    s = engine.stats
    return spark.createDataFrame([(s.processed, s.classified, s.reviewed)], "processed long, classified long, reviewed long")


@query("""SELECT n FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) AS n, min(CASE WHEN event_id % 4999 = 4998 THEN event_id END) OVER () AS stop, event_id FROM events)
  WHERE event_type = 'error' AND (stop IS NULL OR event_id < stop)""")
def stream_stage_error(spark, sf_dir):
    """The lines that a stream has written when a stage fails on a record."""
    path, out = _event_lines(spark, sf_dir, F.when(F.col("event_id") % 4999 == 4998, F.lit('{"fail":1}')).otherwise(F.col("j")), one=True), _folder(spark, "stream-error")

    def careful(rows):
        return [ValueError("refused") if b'"fail"' in r["data"] else None for r in rows]

    cascade = Cascade([RulesStage([Rule("alert", fields=[FieldMatcher("type", exact="error")])]), RowStage("careful", careful)])
    run, _ = run_stream(line_stream(spark, path), cascade, JsonLinesFolder(out, mode="append"), _folder(spark, "progress"), kind="jsonl")
    try:
        run.awaitTermination()
    except StreamingQueryException as e:
        if "engine: stage careful: refused" not in str(e):
            raise
    return spark.read.text(out).select(F.regexp_extract(F.get_json_object("value", "$.id"), ":([0-9]+)$", 1).cast("long").alias("n"))


@query("""SELECT 'docs:' || n AS id, CASE WHEN doc_id % 500 = 7 THEN 'text: docs: token too long' END AS error FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)""")
def text_line_cap(spark, sf_dir):
    line = F.when(F.col("doc_id") % 500 == 7, F.repeat(F.lit("x"), F.lit(lines.MAX_LINE))).otherwise(F.regexp_replace("text", r"[\r\n]+", " "))
    path = _spooled(table(spark, sf_dir, "documents").orderBy("doc_id").select(F.coalesce(line, F.lit(""))), "long-lines")
    return lines.read_text(spark, path, "docs").select("id", F.col("source_error")["message"].alias("error"))


@query("""SELECT '{"id":"' || event_id || '","kind":"json","data":"{\\"b\\":[1.10,1E5,9007199254740993],\\"a\\":' || user_id || '.0e0}","fields":{"a":' || user_id || '.0e0,"b":[1.10,1E5,9007199254740993]},"category":"all","confidence":1,"stage":"mock","reasons":[{"code":"mock","detail":"mock score 1 for \\"all\\""}]}' AS line FROM events""")
def wire_exact_numbers(spark, sf_dir):
    text = F.concat(F.lit('{"b":[1.10,1E5,9007199254740993],"a":'), F.col("user_id").cast("string"), F.lit(".0e0}"))
    done = Cascade([MockStage(default=Outcome("all", 1.0))]).classify(events(spark, sf_dir, text))
    return done.select(wire_line(exact=True).alias("line"))


@query("""SELECT '{"id":"' || doc_id || '","kind":"record","data":"' || doc_id || '\\ufffd\\ufffd-\\ufffd","category":"","confidence":0}' AS line FROM documents""")
def wire_bad_utf8(spark, sf_dir):
    df = documents(spark, sf_dir).withColumn("data", F.concat(F.col("id").cast("binary"), F.unhex(F.lit("E2822DFF"))))
    return Cascade([RulesStage([Rule("never", contains=["never there"])])]).classify(df).select(wire_line(exact=True).alias("line"))


_SMALL = [("the ", 1e-7, "1e-7"), ("de ", 1.25e-5, "0.0000125"), ("a", 0.001, "0.001")]


@query("SELECT doc_id::VARCHAR AS id, CASE " + " ".join(f"WHEN contains(text, '{part}') THEN '{shown}'" for part, _, shown in _SMALL) + " ELSE '0' END AS confidence FROM documents")
def wire_small_confidence(spark, sf_dir):
    done = Cascade([MockStage([MockMatcher([part], "some", c) for part, c, _ in _SMALL])]).classify(documents(spark, sf_dir))
    return done.select("id", F.regexp_extract(wire_line(), '"confidence":([^,}]+)', 1).alias("confidence"))


@query("""SELECT row_number() OVER (ORDER BY item_id) AS k, CASE WHEN text LIKE '%a%' THEN 'a' WHEN length(text) % 2 = 0 THEN 'even' END AS category,
  CASE WHEN text NOT LIKE '%a%' AND length(text) % 2 = 1 THEN 'stage odd: odd' END AS error FROM benchmark""")
def batch_workers(spark, sf_dir):
    """A list classified by four workers: results in the list's order."""
    rows = [r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").collect()]
    odd = RowStage("odd", lambda found: [("even", 1.0) if len(r["data"].decode()) % 2 == 0 else ValueError("odd") for r in found])
    cascade = Cascade([RulesStage([Rule("a", contains=["a"])]), odd])
    out = cascade.classify_batch(spark, [{"id": str(i), "data": t} for i, t in enumerate(rows)], workers=4)
    return spark.createDataFrame([(i, d and d["category"], e) for i, (d, e) in enumerate(out, 1)], "k long, category string, error string")


@query("""SELECT 'records unclassified and dropped; logging the first, see stats for the total record=n:' || min(n) AS line FROM
  (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) WHERE NOT contains(n_name, '1')""")
def warn_and_drop(spark, sf_dir):
    """The one line that a run without review logs of its undecided records."""
    heard: list[str] = []
    log, listener = logging.Logger("warn_and_drop"), logging.Handler()
    listener.emit = lambda record: heard.append(record.getMessage())
    log.addHandler(listener)
    path = _spooled(table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name"), "n")
    Engine(lines.read_text(spark, path, "n"), Cascade([RulesStage([Rule("one", contains=["1"])])]), Memory(), logger=log).run()
    return spark.createDataFrame([(x,) for x in heard], "line string")


@query("""SELECT 'processed=' || (a + b) || ' classified=' || (x + y) || ' review=' || (a + b - x - y) || ' by_stage=map[rules:' || (x + y) || ']' AS line FROM
  (SELECT count(*) AS a, count_if(contains(n_name, '1')) AS x FROM nation), (SELECT count(*) AS b, count_if(contains(r_name, '1')) AS y FROM region)""")
def stats_merge(spark, sf_dir):
    """The printed statistics of two runs together."""
    total = Stats()
    for name, key, text in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        source = tables.from_table(table(spark, sf_dir, name), key, text)
        total.merge(Engine(source, Cascade([RulesStage([Rule("one", contains=["1"])])]), Memory(), Memory()).run())
    return spark.createDataFrame([(str(total),)], "line string")


# Log lines

def _log() -> Column:
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ["), F.upper(F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info"))),
        F.lit("] user="), F.col("user_id").cast("string"), F.lit(' msg="a \\"b\\" '), "event_type", F.lit('" user='), (F.col("user_id") + 1).cast("string"), F.lit(" =x y"),
    )


def _logs(spark, sf_dir):
    return tables.from_table(table(spark, sf_dir, "events").withColumn("_line", _log()), "event_id", "_line", kind="text")


def _log_map(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", logfields.log_fields(F.col("data")).alias("m"))


@query("""SELECT event_id::VARCHAR AS id, (user_id + 1)::VARCHAR AS user, 'a "b" ' || event_type AS msg, 4 AS n FROM events""")
def logfmt_pairs(spark, sf_dir):
    return _log_map(spark, sf_dir).select("id", F.col("m")["user"].alias("user"), F.col("m")["msg"].alias("msg"), F.size("m").alias("n"))


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events")
def log_level(spark, sf_dir):
    return _log_map(spark, sf_dir).select("id", F.col("m")["level"].alias("level"))


@query("SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM events")
def log_timestamp(spark, sf_dir):
    return _log_map(spark, sf_dir).select("id", F.col("m")["timestamp"].alias("timestamp"))


@query("""SELECT event_id::VARCHAR AS id, 'log' AS kind, event_type AS level, user_id::VARCHAR AS who, (user_id + 1)::VARCHAR AS user FROM events""")
def log_enrich_wins(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumn("_line", _log())
    own = F.parse_json(F.concat(F.lit('{"level":"'), "event_type", F.lit('","who":'), F.col("user_id").cast("string"), F.lit("}")))
    done = logfields.with_log_fields(tables.from_table(raw, "event_id", "_line", own, kind="text"))
    get = lambda p: F.try_variant_get("fields", f"$.{p}", "string").alias(p)
    return done.select("id", "kind", get("level"), get("who"), get("user"))


# WordPiece: letters and digits as pieces, so that SQL can tell the tokens of whole texts

_MARKS = "".join(map(chr, range(33, 127)))
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789" + chr(0xDF)


def _vocabulary(more: str = "") -> list[str]:
    marks = [c for c in _MARKS if not c.isalnum()]
    return ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *_LETTERS, *(f"##{c}" for c in _LETTERS), *marks, *more]


def _pieces_sql(text: str) -> str:
    """The tokens of a text as a list of strings, one for each word."""
    words = f"regexp_extract_all(strip_accents(lower({text})), '[a-z0-9{chr(0xDF)}]+|[^\\s]')"
    return f"list_transform({words}, lambda w: w[1] || regexp_replace(w[2:], '(.)', ' ##\\1', 'g'))"


def _words_of(spark, sf_dir, text: Column, **options) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return encode_column(df, WordPiece.parse(_vocabulary(chr(0x4E2D) + chr(0x6587)), max_chars_per_word=1 << 20, **options), "text")


@query(f"""SELECT doc_id, '[CLS] ' || coalesce(nullif(array_to_string({_pieces_sql("coalesce(text, '')")}, ' '), '') || ' ', '') || '[SEP]' AS tokens FROM documents""")
def wordpiece_tokens(spark, sf_dir):
    return _words_of(spark, sf_dir, F.coalesce("text", F.lit(""))).select("doc_id", F.array_join("encoding.tokens", " ").alias("tokens"))


@query(f"""SELECT doc_id, n, trim(repeat('1 ', n)) AS mask, trim(repeat('0 ', n)) AS types, 2 AS first, 3 AS last FROM
  (SELECT doc_id, least(16, 2 + len(string_split(nullif(array_to_string({_pieces_sql("text")}, ' '), ''), ' ')))::INTEGER AS n FROM documents WHERE text LIKE '%e%')""")
def wordpiece_truncate(spark, sf_dir):
    e = F.col("encoding")
    out = _words_of(spark, sf_dir, F.col("text"), max_len=16).where("text like '%e%'")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("doc_id", F.size(e["ids"]).alias("n"), text(e["mask"]).alias("mask"), text(e["type_ids"]).alias("types"), F.element_at(e["ids"], 1).alias("first"), F.element_at(e["ids"], -1).alias("last"))


@query(f"""SELECT doc_id, '[CLS] c ##a ##f ##e ' || chr(20013) || ' ' || chr(25991) || ' ' || coalesce(nullif(array_to_string({_pieces_sql("text")}, ' '), '') || ' ', '') || '[UNK] [SEP]' AS tokens FROM documents WHERE text IS NOT NULL""")
def wordpiece_cjk_accents(spark, sf_dir):
    text = F.concat(F.lit("Caf" + chr(0xE9) + chr(0x4E2D) + chr(0x6587)), F.col("text"), F.lit(" " + chr(0x416)))
    out = _words_of(spark, sf_dir, text)
    return out.where("text is not null").select("doc_id", F.array_join("encoding.tokens", " ").alias("tokens"))


@query("""SELECT k, token FROM (VALUES (0, '[UNK]'), (1, '[CLS]'), (2, '[SEP]'), (3, 'a'), (4, ''), (6, 'b')) v(k, token)""")
def wordpiece_vocabulary(spark, sf_dir):
    """Line numbers are ids; ends of lines go; the first of equal lines counts."""
    found = WordPiece.parse(["[UNK]\r\n", "[CLS]\n", "[SEP]\n", "a\n", "\n", "a\r\n", "b"]).vocab
    return spark.createDataFrame([(i, t) for t, i in found.items()], "k int, token string")


# Bulk


@query("""SELECT category, stage, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount >= 0.05 AND l_quantity < 24 THEN 'promo' WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'old' END AS category,
  CASE WHEN l_returnflag = 'R' OR (l_discount >= 0.05 AND l_quantity < 24) THEN 'rules' WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'age' END AS stage FROM lineitem) GROUP BY ALL""")
def lineitem_cascade(spark, sf_dir):
    """Counts by category and stage of a cascade over typed columns as fields."""
    df = table(spark, sf_dir, "lineitem").withColumn("data", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rules = [
        Rule("returned", fields=[FieldMatcher("l_returnflag", exact="R")]),
        Rule("promo", all=[Matcher(field=FieldMatcher("l_discount", gte=0.05)), Matcher(field=FieldMatcher("l_quantity", lt=24.0))]),
    ]
    age = with_name(RulesStage([Rule("old", regex=["^199[0-4]|^198"])]), "age")
    d = F.col("decision")
    done = Cascade([RulesStage(rules), age], env=Env(fields=ColumnFields(df.schema))).classify(df)
    return done.groupBy(d["category"].alias("category"), d["stage"].alias("stage")).agg(F.count(F.lit(1)).alias("n"))
