"""Decided records as JSON lines.

``wire_line`` is built from JVM functions alone. Payload bytes that are no UTF-8 become ``\\ufffd``, one for
each maximal bad sequence, and field numbers print by value; ``exact=True`` renders payload and
fields in Arrow batches instead: one ``\\ufffd`` for each bad byte, numbers as they were written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import gotext
from .fields import _Number, bound, parse_exact

_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = r'[\x{0}-\x{1F}"\\\x{2028}\x{2029}]'
LINE_SEPARATORS = (0x2028, 0x2029)
_BAD, _HOLE = chr(0xFFFD), chr(0x10FFFE)


def _escapes() -> list[tuple[str, str]]:
    controls = [(chr(c), _SHORT.get(chr(c), f"\\u{c:04x}")) for c in range(32)]
    return [("\\", "\\\\"), ('"', '\\"'), *controls, *((chr(c), f"\\u{c:04x}") for c in LINE_SEPARATORS)]


def escaped(text: Column) -> Column:
    """A valid string with JSON escapes, without quotes."""
    chain = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _escapes(), text)
    return F.when(text.rlike(_SPECIAL), chain).otherwise(text)


def json_string(text: Column) -> Column:
    valid = F.coalesce(F.is_valid_utf8(text), F.lit(True))
    mended = F.replace(escaped(F.make_valid_utf8(text)), F.lit(_BAD), F.lit("\\ufffd"))
    return F.concat(F.lit('"'), F.when(valid, escaped(text)).otherwise(mended), F.lit('"'))


_TABLE = {ord(c): e for c, e in _escapes()} | dict.fromkeys(range(0xDC80, 0xDD00), "\\ufffd")


def json_text(text: str) -> str:
    """A string as a JSON literal, in Python; surrogates stand for bad bytes."""
    return '"' + text.translate(_TABLE) + '"'


def json_value(value: object) -> str:
    """A decoded JSON value with keys in byte order and numbers as they were written."""
    match value:
        case _Number():
            return str(value)
        case str():
            return json_text(value)
        case bool():
            return "true" if value else "false"
        case None:
            return "null"
        case float():
            if value != value or value in (float("inf"), float("-inf")):
                raise ValueError(f"unsupported value: {gotext.number(value)}")
            return gotext.json_number(value)
        case int():
            return str(value)
        case dict():
            return "{" + ",".join(f"{json_text(k)}:{json_value(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
        case list():
            return "[" + ",".join(map(json_value, value)) + "]"
    raise ValueError(f"unsupported value: {value!r}")


@F.arrow_udf(T.StringType())
def _exact_payload(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else json_text(x.decode("utf-8", "surrogateescape")) for x in data.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _exact_fields(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else json_value(v) if (v := parse_exact(x)) else None for x in data.to_pylist()], pa.string())


def confidence_text(confidence: Column, known: list[float]) -> Column:
    """A confidence as a JSON number. known: values that occur, rendered while the query is planned.

    Others are as Spark writes them, without a last ``.0``; its exponents become digits, but for values below 1e-6.
    """
    out = F.when(confidence.isNull(), "0")
    for x in known:
        out = out.when(confidence == x, gotext.json_number(x))
    shown = confidence.cast("string")
    plain = F.regexp_replace(shown, r"\.0$", "")
    head, power = F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", ""), F.substring_index(shown, "E-", -1)
    small = F.concat(head, F.lit("e-"), power)
    fixed = F.concat(F.lit("0."), F.repeat(F.lit("0"), power.cast("int") - 1), F.replace(head, F.lit(".")))
    return out.when(~F.contains(shown, F.lit("E")), plain).when(F.abs(confidence) < 1e-6, small).otherwise(fixed)


#: The column that holds, for records with constant decisions, the end of their lines.
TAIL = "_tail"


def wire_tail(category: str = "", confidence: float = 0.0, stage: str = "", reasons: Sequence[tuple[str, str]] = ()) -> str:
    """The end of the line of a record with this decision, from the category on."""
    said = ",".join(f'{{"code":{json_text(c)}' + (f',"detail":{json_text(d)}' if d else "") + "}" for c, d in reasons)
    out = f',"category":{json_text(category)},"confidence":{gotext.json_number(confidence)}'
    return out + (f',"stage":{json_text(stage)}' if stage else "") + (f',"reasons":[{said}]' if said else "") + "}"


def wire_line(known_confidences: list[float] = (0.0, 1.0), exact: bool = False, tail: bool = False) -> Column:
    """The line of a record with id, kind, data, fields, meta and decision (null: for review). ``tail``: its end is in the column TAIL."""
    return (_exact_line if exact else _fast_line)(F.col(TAIL) if tail else _tail(list(known_confidences)))


def _tail(known: list[float]) -> Column:
    """The end of the line for any decision."""
    d, nothing = F.col("decision"), F.lit("")
    some = lambda c: F.coalesce(c, F.lit(False))
    reason = lambda r: F.concat(
        F.lit('{"code":'), json_string(r["code"]),
        F.when(F.coalesce(r["detail"], nothing) != "", F.concat(F.lit(',"detail":'), json_string(r["detail"]))).otherwise(nothing), F.lit("}"),
    )
    return F.when(d.isNull(), F.lit(wire_tail())).otherwise(
        F.concat(
            F.lit(',"category":'), json_string(d["category"]), F.lit(',"confidence":'), confidence_text(d["confidence"], known),
            F.when(some(d["stage"] != ""), F.concat(F.lit(',"stage":'), json_string(d["stage"]))).otherwise(nothing),
            F.when(some(F.size(d["reasons"]) > 0), F.concat(F.lit(',"reasons":['), F.concat_ws(",", F.transform(d["reasons"], reason)), F.lit("]"))).otherwise(nothing),
            F.lit("}"),
        )
    )


def _mended(line: Column) -> Column:
    """JSON as Spark writes it, with control escapes in lower case and line separators escaped."""

    def lowered(text: Column) -> Column:
        for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
            text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u{c:04X}", rf"$1\\u{c:04x}")
        return text

    line = F.when(F.contains(line, F.lit("\\u00")), lowered(line)).otherwise(line)
    for c in LINE_SEPARATORS:
        line = F.replace(line, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return line


def _fast_line(tail: Column) -> Column:
    """The record as it is where it is text alone without anything to escape, else by Spark's own JSON writer, which leaves out nulls; then the tail."""
    kind, data, identity = F.col("kind"), F.coalesce(F.col("data").cast("string"), F.lit("")), F.coalesce("id", F.lit(""))
    bare = F.col("fields").isNull() & F.coalesce(F.size("meta") <= 0, F.lit(True)) & F.coalesce(kind.isin("", "text"), F.lit(True))
    bare = bare & F.is_valid_utf8(data) & ~F.concat(identity, data).rlike(_SPECIAL)
    plain = F.concat(F.lit('{"id":"'), identity, F.lit('","data":"'), data, F.lit('"'))
    # bound: so that this path's code doesn't make the method that holds the other one too large for the JVM's compiler
    whole = F.struct(identity.alias("id"), kind.alias("kind"), data.alias("data"), F.col("fields").alias("fields"), F.col("meta").alias("meta"))
    return F.concat(F.when(bare, plain).otherwise(bound(whole, _front)), tail)


def _front(x: Column) -> Column:
    valid = F.is_valid_utf8(x["data"])
    # a bad sequence goes through the writer as a code point that is no character
    shown = F.when(valid, x["data"]).otherwise(F.replace(F.make_valid_utf8(x["data"]), F.lit(_BAD), F.lit(_HOLE)))
    meta = F.when(F.size(x["meta"]) > 0, F.map_from_entries(F.array_sort(F.map_entries(x["meta"]))))
    fields = F.when(F.schema_of_variant(x["fields"]) != "OBJECT<>", x["fields"])
    line = F.to_json(F.struct(x["id"].alias("id"), F.when(~x["kind"].isin("", "text"), x["kind"]).alias("kind"), shown.alias("data"), fields.alias("fields"), meta.alias("meta")))
    line = bound(line, lambda j: _mended(F.substring(j, F.lit(1), F.length(j) - 1)))
    return F.when(valid, line).otherwise(F.replace(line, F.lit(_HOLE), F.lit("\\ufffd")))


def _exact_line(tail: Column) -> Column:
    kind, nothing = F.col("kind"), F.lit("")
    data, fields = _exact_payload(F.col("data")), F.when(F.col("kind") == "json", _exact_fields(F.col("data")))
    pairs = F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"])))
    some = lambda c: F.coalesce(c, F.lit(False))
    return F.concat(
        F.lit('{"id":'), json_string(F.coalesce("id", nothing)),
        F.when(some(~kind.isin("", "text")), F.concat(F.lit(',"kind":'), json_string(kind))).otherwise(nothing),
        F.lit(',"data":'), F.coalesce(data, F.lit('""')),
        F.when(some((fields != "{}") & (fields != "null")), F.concat(F.lit(',"fields":'), fields)).otherwise(nothing),
        F.when(some(F.size("meta") > 0), F.concat(F.lit(',"meta":{'), F.concat_ws(",", pairs), F.lit("}"))).otherwise(nothing),
        tail,
    )
