"""Renderings that messages and reasons need: quoted text and plain numbers."""

from __future__ import annotations

import math

_SHORT = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}


def quote(text: str) -> str:
    """Double-quoted with escapes for everything that does not print."""
    out = []
    for c in text:
        if c in _SHORT:
            out.append(_SHORT[c])
        elif c.isprintable():
            out.append(c)
        elif ord(c) < 0x80:
            out.append(f"\\x{ord(c):02x}")
        elif ord(c) < 0x10000:
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(f"\\U{ord(c):08x}")
    return '"' + "".join(out) + '"'


def _digits(x: float) -> tuple[str, int]:
    """Shortest digits and the decimal exponent of the first one."""
    text = repr(abs(x))
    mantissa, _, power = text.partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + ("" if part == "0" else part)
    exponent = len(whole) - 1 + int(power or 0)
    stripped = digits.lstrip("0")
    if not stripped:
        return "0", 0
    exponent -= len(digits) - len(stripped)
    return stripped.rstrip("0") or "0", exponent


def _special(x: float) -> str | None:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return None


def _fixed(digits: str, exponent: int) -> str:
    if exponent < 0:
        return "0." + "0" * (-exponent - 1) + digits
    if len(digits) <= exponent + 1:
        return digits + "0" * (exponent + 1 - len(digits))
    return digits[: exponent + 1] + "." + digits[exponent + 1 :]


def _scientific(digits: str, exponent: int, width: int) -> str:
    head = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
    return f"{head}e{'-' if exponent < 0 else '+'}{abs(exponent):0{width}d}"


def number(x: float) -> str:
    """Shortest form; an exponent below 1e-4 and from 1e6 on."""
    if s := _special(x):
        return s
    digits, exponent = _digits(x)
    sign = "-" if math.copysign(1, x) < 0 else ""
    return sign + (_scientific(digits, exponent, 2) if exponent < -4 or exponent >= 6 else _fixed(digits, exponent))


def plain(x: float) -> str:
    """Shortest form without an exponent."""
    if s := _special(x):
        return s
    return ("-" if math.copysign(1, x) < 0 else "") + _fixed(*_digits(x))


def json_number(x: float) -> str:
    """As a JSON number: fixed unless below 1e-6 or from 1e21 on."""
    digits, exponent = _digits(x)
    sign = "-" if math.copysign(1, x) < 0 else ""
    if x and (abs(x) < 1e-6 or abs(x) >= 1e21):
        return sign + _scientific(digits, exponent, 1 if exponent < 0 else 2)
    return sign + _fixed(digits, exponent)
