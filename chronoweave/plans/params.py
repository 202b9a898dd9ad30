"""Parameters of components: their text form, their checks, and value semantics."""

from __future__ import annotations

import re
from typing import Any


class ParamError(ValueError):
    """What is wrong with a component's parameters."""


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:\\.|[^"\\])*")|(?P<real>[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?\d+[eE][-+]?\d+)|(?P<int>[-+]?(?:0[xX][0-9a-fA-F]+|0[bB][01]+|\d+))(?![\w.])|(?P<name>[A-Za-z_][\w.:-]*)|(?P<op>[\[\]{},=+]))')


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.kind, self.tok = "", ""
        self.next()

    def next(self) -> None:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            if self.text[self.at :].strip():
                raise ParamError(f"unexpected {self.text[self.at:].strip()[:20]!r}")
            self.kind, self.tok = "", ""
            return
        self.kind, self.tok, self.at = m.lastgroup, m[m.lastgroup], m.end()

    def take(self, op: str) -> None:
        if self.tok != op or self.kind != "op":
            raise ParamError(f"expected {op!r}, found {self.tok!r}")
        self.next()

    def integer(self, t: str) -> int:
        sign, digits = (-1, t[1:]) if t[0] == "-" else (1, t.lstrip("+"))
        low = digits.lower()
        base = 16 if low.startswith("0x") else 2 if low.startswith("0b") else 8 if len(low) > 1 and low[0] == "0" else 10
        return sign * int(low, base)

    def value(self) -> Any:
        kind, tok = self.kind, self.tok
        if kind == "op" and tok == "+":
            self.next()
            if self.kind != "int":
                raise ParamError("an unsigned integer must follow +")
            return self.value()
        if kind == "op" and tok == "[":
            self.next()
            out = []
            while self.tok != "]":
                out.append(self.value())
                if self.tok != "]":
                    self.take(",")
            self.next()
            return out
        if kind == "op" and tok == "{":
            self.next()
            return self.pairs("}")
        if not kind or kind == "op":
            raise ParamError(f"expected a value, found {tok!r}")
        self.next()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", tok[1:-1])
        if kind == "real":
            return float(tok)
        if kind == "int":
            return self.integer(tok)
        words = {"null": None, "nul": None, "NULL": None, "true": True, "TRUE": True, "yes": True, "YES": True, "false": False, "FALSE": False, "no": False, "NO": False}
        return words.get(tok, tok)

    def pairs(self, end: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while self.tok != end or (end and self.kind != "op"):
            if self.kind not in ("name", "str"):
                raise ParamError(f"expected a name, found {self.tok!r}")
            key = self.tok if self.kind == "name" else self.tok[1:-1]
            self.next()
            self.take("=")
            out[key] = self.value()
            if self.tok != end:
                self.take(",")
        self.next()
        return out


def parse_params(text: str) -> dict[str, Any]:
    """``a=1,b="x",c=[yes, 0x10],d={e=null}``"""
    r = _Reader(text)
    return r.pairs("") if r.kind else {}


def extend(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base overridden by over, not deeply."""
    return {**base, **over}


def equal(a: Any, b: Any) -> bool:
    """Deep equality in which types count: 1, 1.0 and true all differ."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def check(params: dict[str, Any], spec: dict[str, tuple], where: str) -> dict[str, Any]:
    """spec: name to (types, default or ..., choices or None); ... marks a mandatory one. Returns the parameters with defaults."""
    for k in params:
        if k not in spec:
            raise ParamError(f"{where}: unknown parameter {k!r}")
    out = {}
    for k, (types, default, choices) in spec.items():
        if k not in params:
            if default is ...:
                raise ParamError(f"{where}: missing parameter {k!r}")
            out[k] = default
            continue
        v = params[k]
        if not isinstance(v, types) or (isinstance(v, bool) and bool not in (types if isinstance(types, tuple) else (types,))):
            raise ParamError(f"{where}: parameter {k!r} has type {type(v).__name__}")
        if choices and v not in choices:
            raise ParamError(f"{where}: parameter {k!r} must be one of {', '.join(choices)}")
        out[k] = v
    return out
