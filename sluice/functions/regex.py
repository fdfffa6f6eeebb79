"""RE2 patterns for Java's regular expressions.

``compile_pattern`` parses a pattern in RE2 syntax, refuses what RE2 refuses (lookaround, back
references, possessive and doubled repetitions, more than 1000 repeats) and writes a Java pattern
that finds the same: ASCII classes and word boundaries, ``$`` at the very end, ``.`` that excludes
only the line feed, Unicode case folding. It also finds literal text that every match must hold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_ESCAPED = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
MAX_REPEAT = 1000


class PatternError(ValueError):
    def __init__(self, what: str, where: str):
        super().__init__(f"error parsing regexp: {what}: `{where}`")


@dataclass(frozen=True)
class Flags:
    fold: bool = False
    lines: bool = False
    dot_all: bool = False
    swap: bool = False


@dataclass
class Item:
    """A piece of a sequence: Java text, its literal if it is one, the most repeats nested in it."""

    java: str
    literal: str | None = None
    repeats: int = 1
    quantified: bool = False
    assertion: bool = False


@dataclass(frozen=True)
class Pattern:
    source: str
    java: str
    required: str  # text that every match holds; empty if none is known
    literal: bool  # whether a text matches just if it holds ``required``

    def matches(self, text: Column) -> Column:
        if self.literal:
            return F.contains(text, F.lit(self.required))
        full = text.rlike(self.java)
        return F.contains(text, F.lit(self.required)) & full if self.required else full


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() and code < 128 else f"\\x{{{code:X}}}"


class _Parser:
    def __init__(self, source: str):
        self.s, self.i = source, 0
        self.names: set[str] = set()

    def more(self) -> bool:
        return self.i < len(self.s)

    def alternatives(self, flags: Flags, depth: int) -> tuple[list[list[Item]], Flags]:
        """Sequences up to a closing parenthesis or the end. Flags set in one stay set after it."""
        out: list[list[Item]] = [[]]
        while self.more():
            c = self.s[self.i]
            if c == ")":
                if not depth:
                    raise PatternError("unexpected )", self.s)
                break
            if c == "|":
                self.i += 1
                out.append([])
                continue
            if c == "(":
                item, flags = self.group(flags, depth)
                if item is None:
                    continue
                out[-1].append(item)
                continue
            if c in "*+?" or c == "{" and self.counts():
                self.repetition(out[-1], flags)
                continue
            out[-1].append(self.atom(flags))
        return out, flags

    def group(self, flags: Flags, depth: int) -> tuple[Item | None, Flags]:
        start, own, opening = self.i, flags, "("
        self.i += 1
        if self.s.startswith("?", self.i):
            if self.s.startswith(("?P<", "?<"), self.i) and not self.s.startswith(("?<=", "?<!"), self.i):
                low = self.s.index("<", self.i) + 1
                end = self.s.find(">", low)
                if end < 0:
                    raise PatternError("invalid named capture", self.s[start:])
                name = self.s[low:end]
                if not name or not all(c == "_" or c.isascii() and c.isalnum() for c in name):
                    raise PatternError("invalid named capture", self.s[start : end + 1])
                if name in self.names:
                    raise PatternError("duplicate capture group name", name)
                self.names.add(name)
                self.i = end + 1
            else:
                own, closed = self.flag_group(flags, start)
                if closed:
                    return None, own
                opening = "(?:"
        inner, _ = self.alternatives(own, depth + 1)
        if not self.more():
            raise PatternError("missing closing )", self.s)
        self.i += 1
        java = opening + "|".join(_join(x) for x in inner) + ")"
        items = [x for seq in inner for x in seq]
        literal = items[0].literal if len(inner) == 1 and len(items) == 1 and not items[0].quantified else None
        if len(inner) == 1 and items and all(x.literal is not None and not x.quantified for x in items):
            literal = "".join(x.literal for x in items)
        return Item(java, literal, max([1, *(x.repeats for x in items)]), assertion=any(x.assertion for x in items)), flags

    def flag_group(self, flags: Flags, start: int) -> tuple[Flags, bool]:
        self.i += 1
        on, any_, negated = flags, False, False
        names = {"i": "fold", "m": "lines", "s": "dot_all", "U": "swap"}
        while self.more():
            c = self.s[self.i]
            self.i += 1
            if c in names:
                on, any_ = replace(on, **{names[c]: not negated}), True
            elif c == "-" and not negated:
                negated, any_ = True, False
            elif c in ":)" and (any_ or not negated) and (any_ or c == ":"):
                return on, c == ")"
            else:
                break
        raise PatternError("invalid or unsupported Perl syntax", self.s[start : self.i])

    def counts(self) -> tuple[int, int | None, int] | None:
        """Least, most and end of a counted repetition at the current place; None if the brace is literal."""
        end = self.s.find("}", self.i)
        if end < 0:
            return None
        low, comma, high = self.s[self.i + 1 : end].partition(",")
        ok = lambda x: x.isascii() and x.isdigit() and (x == "0" or x[0] != "0")
        if not ok(low) or high and not ok(high):
            return None
        return int(low), (int(high) if high else None) if comma else int(low), end + 1

    def repetition(self, items: list[Item], flags: Flags) -> None:
        start, c = self.i, self.s[self.i]
        times = 1
        if c == "{":
            low, high, end = self.counts()
            if low > MAX_REPEAT or high is not None and (high > MAX_REPEAT or high < low):
                raise PatternError("invalid repeat count", self.s[start:end])
            mark, self.i, times = self.s[start:end], end, max(low, high or 0, 1)
        else:
            mark, self.i = c, self.i + 1
        lazy = self.s.startswith("?", self.i)
        self.i += lazy
        if not items:
            raise PatternError("missing argument to repetition operator", self.s[start : self.i])
        if items[-1].quantified:
            raise PatternError("invalid nested repetition operator", self.s[start : self.i])
        last = items.pop()
        if times * last.repeats > MAX_REPEAT:
            raise PatternError("invalid repeat count", self.s[start : self.i])
        java = last.java if not last.assertion else f"(?:{last.java})"
        items.append(Item(java + mark + ("?" if lazy != flags.swap else ""), None, times * last.repeats, True, last.assertion))

    def literal(self, text: str, flags: Flags) -> Item:
        java = _char(ord(text))
        if flags.fold and (text.lower() != text.upper()):
            return Item(f"(?iu:{java})")
        return Item(java, text)

    def atom(self, flags: Flags) -> Item:
        c = self.s[self.i]
        self.i += 1
        if c == "^":
            return Item(r"(?:(?<=\n)|\A)" if flags.lines else r"\A", assertion=True)
        if c == "$":
            return Item(r"(?:(?=\n)|\z)" if flags.lines else r"\z", assertion=True)
        if c == ".":
            return Item("(?s:.)" if flags.dot_all else r"[^\n]")
        if c == "[":
            java = self.char_class()
            return Item(f"(?iu:{java})" if flags.fold else java)
        if c != "\\":
            return self.literal(c, flags)
        if not self.more():
            raise PatternError("trailing backslash at end of expression", "")
        c = self.s[self.i]
        if c in "AzbB":
            self.i += 1
            return Item({"A": r"\A", "z": r"\z", "b": _BOUNDARY, "B": _NO_BOUNDARY}[c], assertion=True)
        if c == "Q":
            end = self.s.find("\\E", self.i + 1)
            text, rest = self.s[self.i + 1 : end if end >= 0 else len(self.s)], self.s[end + 2 :] if end >= 0 else ""
            # read on as if each quoted character had been escaped alone
            self.s = self.s[: self.i - 1] + "".join(f"\\x{{{ord(x):X}}}" for x in text) + rest
            self.i -= 1
            return Item("(?:)", "")
        if set_ := self.class_escape():
            return Item(f"[{set_}]")
        return self.literal(chr(self.escape()), flags)

    def class_escape(self) -> str | None:
        """A Perl or Unicode class at the letter after a backslash, as the inside of a Java class."""
        c = self.s[self.i]
        if c.lower() in _PERL:
            self.i += 1
            return _PERL[c] if c.islower() else f"[^{_PERL[c.lower()]}]"
        if c not in "pP":
            return None
        start = self.i - 1
        self.i += 1
        if self.s.startswith("{", self.i):
            end = self.s.find("}", self.i)
            if end < 0:
                raise PatternError("invalid character class range", self.s[start:])
            name, self.i = self.s[self.i + 1 : end], end + 1
        else:
            name, self.i = self.s[self.i : self.i + 1], self.i + 1
        negated = c == "P"
        if name.startswith("^"):
            name, negated = name[1:], not negated
        if name == "Any":
            return "[^\\x{0}-\\x{10FFFF}]" if negated else "\\x{0}-\\x{10FFFF}"
        if not name or not name.replace("_", "").isalpha():
            raise PatternError("invalid character class range", self.s[start : self.i])
        return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def escape(self) -> int:
        """The code point of an escape, from the character after the backslash."""
        start, c = self.i - 1, self.s[self.i]
        self.i += 1
        if c in _ESCAPED:
            return _ESCAPED[c]
        if c in "01234567":
            if c != "0" and not (self.more() and self.s[self.i] in "01234567"):
                raise PatternError("invalid escape sequence", self.s[start : self.i])
            digits = c
            while self.more() and len(digits) < 3 and self.s[self.i] in "01234567":
                digits += self.s[self.i]
                self.i += 1
            return int(digits, 8)
        if c == "x":
            if self.s.startswith("{", self.i):
                end = self.s.find("}", self.i)
                digits, after = self.s[self.i + 1 : end], end + 1
            else:
                digits, after = self.s[self.i : self.i + 2], self.i + 2
                end = 0 if len(digits) == 2 else -1
            try:
                code = int(digits, 16) if digits.isalnum() and end >= 0 else -1
            except ValueError:
                code = -1
            if not 0 <= code <= 0x10FFFF:
                raise PatternError("invalid escape sequence", self.s[start : self.i + 1])
            self.i = after
            return code
        if c.isascii() and not c.isalnum():
            return ord(c)
        raise PatternError("invalid escape sequence", self.s[start : self.i])

    def char_class(self) -> str:
        start = self.i - 1
        negated = self.s.startswith("^", self.i)
        self.i += negated
        parts, first = [], True
        while True:
            if not self.more():
                raise PatternError("missing closing ]", self.s[start:])
            if self.s[self.i] == "]" and not first:
                self.i += 1
                break
            if self.s[self.i] == "-" and not first and not self.s.startswith("-]", self.i) and not self._range_start():
                raise PatternError("invalid character class range", self.s[self.i : self.i + 2])
            first = False
            if self.s.startswith("[:", self.i) and (end := self.s.find(":]", self.i + 2)) >= 0:
                name = self.s[self.i + 2 : end]
                bare = name.removeprefix("^")
                if bare not in _POSIX:
                    raise PatternError("invalid character class range", self.s[self.i : end + 2])
                parts.append(_POSIX[bare] if bare == name else f"[^{_POSIX[bare]}]")
                self.i = end + 2
                continue
            if self.s[self.i] == "\\":
                self.i += 1
                if not self.more():
                    raise PatternError("missing closing ]", self.s[start:])
                if set_ := self.class_escape():
                    parts.append(set_)
                    continue
                low = self.escape()
            else:
                low = ord(self.s[self.i])
                self.i += 1
            high = low
            if self.s.startswith("-", self.i) and not self.s.startswith("-]", self.i) and self.i + 1 < len(self.s):
                at = self.i
                self.i += 1
                if self.s[self.i] == "\\":
                    self.i += 1
                    if self.more() and self.s[self.i].lower() in "dswp":
                        raise PatternError("invalid character class range", self.s[at - 1 : self.i + 1])
                    high = self.escape()
                else:
                    high = ord(self.s[self.i])
                    self.i += 1
                if high < low:
                    raise PatternError("invalid character class range", f"{chr(low)}-{chr(high)}")
            parts.append(_char(low) if low == high else f"{_char(low)}-{_char(high)}")
        return f"[{'^' if negated else ''}{''.join(parts)}]"

    def _range_start(self) -> bool:
        """Whether a hyphen here begins a range of its own, as in ``[+--]``."""
        return self.s.startswith("--", self.i)


def _join(items: list[Item]) -> str:
    out = "".join(x.java for x in items)
    return out.replace(")(?iu:", "") if all(x.java.startswith("(?iu:") and not x.quantified for x in items) and len(items) > 1 else out


def compile_pattern(source: str) -> Pattern:
    parser = _Parser(source)
    sequences, _ = parser.alternatives(Flags(), 0)
    java = "|".join(_join(x) for x in sequences)
    required, literal = "", False
    if len(sequences) == 1:
        items, best, run = sequences[0], "", ""
        for x in items:
            if x.literal is not None and not x.quantified:
                run += x.literal
                best = max(best, run, key=len)
            elif not x.assertion or x.quantified:
                run = ""
        required = best
        literal = bool(items) and bool(best) and all(x.literal is not None and not x.quantified for x in items)
    return Pattern(source, java, required, literal)
