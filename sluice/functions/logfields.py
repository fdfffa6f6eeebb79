"""Fields of log lines: key=value pairs, a leading timestamp and a level word.

``parse_line`` is the definition; ``with_log_fields`` applies it to a frame in Arrow batches and
merges what it finds under the fields that a record has already.
"""

from __future__ import annotations

import re
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = frozenset("trace debug info warn warning error fatal panic".split())
_TOKEN = re.compile(rb"[^ \t]+")
_STAMP = re.compile(rb"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:[.,]\d+)?(?:Z|[+-](\d\d):(\d\d))")
_UNICODE_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def is_timestamp(token: bytes) -> bool:
    m = _STAMP.fullmatch(token)
    if not m:
        return False
    year, month, day, hour, minute, second = (int(x) for x in m.groups()[:6])
    try:
        date(max(year, 4 if year == 0 else 1), month, day)
    except ValueError:
        return False
    zone_ok = m[7] is None or int(m[7]) <= 24 and int(m[8]) < 60
    return hour < 24 and minute < 60 and second < 60 and zone_ok


def level_word(token: bytes) -> str | None:
    text = token.strip(b"[]():").decode("utf-8", "replace").replace(chr(0x130), "i").lower()
    return text if text in LEVELS else None


def _quoted(line: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while at < len(line) and line[at] != 0x22:
        if line[at] == 0x5C and line[at + 1 : at + 2] in (b'"', b"\\"):
            at += 1
        out.append(line[at])
        at += 1
    return bytes(out), min(at + 1, len(line))


def pairs(line: bytes) -> dict[bytes, bytes]:
    """key=value pairs anywhere in the line; the last of a key counts."""
    found: dict[bytes, bytes] = {}
    at = 0
    while m := _TOKEN.search(line, at):
        key, sign, _ = m[0].partition(b"=")
        if not sign or not key:
            at = m.end()
            continue
        at = m.start() + len(key) + 1
        if line[at : at + 1] == b'"':
            found[key], at = _quoted(line, at + 1)
        else:
            found[key], at = line[at : m.end()], m.end()
    return found


def parse_line(line: bytes) -> dict[str, str] | None:
    fields = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in pairs(line).items()}
    rest = line.decode("utf-8", "surrogateescape").strip(_UNICODE_SPACE).encode("utf-8", "surrogateescape")
    tokens = _TOKEN.finditer(rest)
    first = next(tokens, None)
    if first and is_timestamp(first[0]):
        fields.setdefault("timestamp", first[0].decode())
        first = next(tokens, None)
    if first and (level := level_word(first[0])):
        fields.setdefault("level", level)
    return fields or None


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def log_fields(data: pa.Array) -> pa.Array:
    """What ``parse_line`` finds in each payload; null where it finds nothing."""
    rows = [None if x is None else parse_line(x) for x in data.to_pylist()]
    return pa.array([None if r is None else list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))


def with_log_fields(df: DataFrame) -> DataFrame:
    """Enrich records: parsed fields are added under those that exist, and kind becomes log where any were found."""
    parsed = df.withColumn("_parsed", log_fields(F.col("data")))
    own = F.from_json(F.to_json("fields"), "map<string,variant>")
    as_json = F.to_json("_parsed")
    fresh = F.from_json(as_json, "map<string,variant>")
    kept = F.map_filter(fresh, lambda k, _: ~F.map_contains_key(F.coalesce(own, F.create_map().cast("map<string,variant>")), k))
    merged = F.parse_json(F.to_json(F.map_concat(kept, F.coalesce(own, F.create_map().cast("map<string,variant>")))))
    found = F.col("_parsed").isNotNull()
    fields = F.when(found & F.col("fields").isNull(), F.parse_json(as_json)).when(found, merged).otherwise(F.col("fields"))
    return parsed.withColumns({"fields": fields, "kind": F.when(found, "log").otherwise(F.col("kind"))}).drop("_parsed")
