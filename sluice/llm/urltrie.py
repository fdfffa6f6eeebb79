"""URL filter: a trie over reversed host labels and path segments, longest rule first.

A rule fits its host and all subdomains if the url's path starts with the rule's path. Of the
rules that fit, the one with the longest host wins, then the one with the longest path; of an
allow and a block rule for one host and path, block wins. Urls without a fitting rule get the
default verdict. A null url or one without ``://`` has an empty host and path, fits no rule and
gets the default. Only key and url are read; further columns are ignored. Repeated rows are
judged alike, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import mapped

ALLOW, BLOCK = "allow", "block"
#: Lists beyond this size are refused: the trie goes to every executor.
MAX_RULES = 2_000_000

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url, up to ``?`` or ``#``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class Trie:
    """Nodes are [edges, paths]: edges by host label from the right; paths is the root of a path trie.

    Path nodes are [edges by complete segment, {rest of the rule after its last slash: (rule, verdict)}, lengths of these
    rests, longest first]: a rest is looked up by the beginnings of the url's segment that have one of the lengths.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        n = 0
        for verdict, host, path in rules:
            n += 1
            if verdict not in (ALLOW, BLOCK) or not host:
                raise ValueError(f"a rule needs allow or block and a host: {(verdict, host, path)!r}")
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            host = host.translate(_UPPER)
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, []]
            at = node[1]
            *whole, rest = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, []])
            if len(rest) not in at[2]:
                at[2].append(len(rest))
                at[2].sort(reverse=True)
            if rest not in at[1] or verdict == BLOCK:
                at[1][rest] = (host + path, verdict)

    @staticmethod
    def _path(node: list, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            for n in node[2]:
                if n <= len(segment) and (found := node[1].get(segment[:n])):
                    best = found
                    break
            if i == len(segments) - 1:
                break
            node = node[0].get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that wins and its verdict, or None."""
        best, node = None, self.root
        if not host:
            return None
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                best = self._path(node[1], path) or best
        return best


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = ALLOW, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of each row. rules: (allow or block, host, path)."""
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [find(*p) or (None, default) for p in parts]
            cols = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], [key, "host", "path", "rule", "verdict"])

    return mapped(df.select(key, url), run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
