"""The metadata language of binary traces: text to a layout of field classes. Driver side only."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from typing import Any

PACKET_MAGIC = 0x75D11D57


@dataclass
class Int:
    size: int
    signed: bool = False
    align: int = 1
    order: str = ""
    base: int = 10
    text: bool = False
    clock: str | None = None


@dataclass
class Float:
    size: int
    align: int = 1
    order: str = ""


@dataclass
class Str:
    align: int = 8


@dataclass
class Enum:
    of: Int
    labels: list[tuple[str, int, int]]

    @property
    def align(self) -> int:
        return self.of.align


@dataclass
class Struct:
    fields: list[tuple[str, Any]] = field(default_factory=list)
    least: int = 1

    @property
    def align(self) -> int:
        return max([self.least, *(f.align for _, f in self.fields)])


@dataclass
class Variant:
    tag: str
    options: list[tuple[str, Any]]
    align: int = 1


@dataclass
class Array:
    of: Any
    length: int | str

    @property
    def align(self) -> int:
        return self.of.align


@dataclass
class EventClass:
    id: int = 0
    stream_id: int = 0
    name: str = ""
    log_level: int | None = None
    emf_uri: str | None = None
    context: Struct | None = None
    fields: Struct | None = None


@dataclass
class StreamClass:
    id: int = 0
    packet_context: Struct | None = None
    event_header: Struct | None = None
    event_context: Struct | None = None
    events: dict[int, EventClass] = field(default_factory=dict)


@dataclass
class Clock:
    name: str = ""
    freq: int = 1_000_000_000
    offset_s: int = 0
    offset: int = 0
    absolute: bool = False
    uuid: str | None = None
    precision: int = 0
    description: str | None = None


@dataclass
class Trace:
    order: str = "le"
    uuid: str | None = None
    packet_header: Struct | None = None
    env: dict[str, Any] = field(default_factory=dict)
    clocks: dict[str, Clock] = field(default_factory=dict)
    streams: dict[int, StreamClass] = field(default_factory=dict)


_TOKEN = re.compile(
    r"""\s+|/\*.*?\*/|//[^\n]*|(?P<str>"(?:\\.|[^"\\])*")|(?P<num>0[xX][0-9a-fA-F]+|0[bB][01]+|\d+)[uUlL]*|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>\.\.\.|:=|->|[{}\[\]();:,=.<>+\-])""",
    re.S,
)


class MetadataError(ValueError):
    pass


def _number(t: str) -> int:
    low = t.lower()
    return int(low, 16) if low.startswith("0x") else int(low, 2) if low.startswith("0b") else int(low, 8) if len(t) > 1 and t[0] == "0" else int(t)


class Parser:
    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise MetadataError(f"unexpected {text[at:at + 20]!r}")
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0
        self.scopes: list[dict[str, Any]] = [{}]
        self.trace = Trace()
        self.order = "le"
        self.orders: list[Any] = []

    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k][1] if self.i + k < len(self.toks) else ""

    def kind(self) -> str:
        return self.toks[self.i][0] if self.i < len(self.toks) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise MetadataError(f"expected {want!r}, found {got!r}")
        self.i += 1
        return got

    def eat(self, t: str) -> bool:
        if self.peek() == t and self.kind() != "str":
            self.i += 1
            return True
        return False

    def value(self) -> Any:
        if self.kind() == "str":
            return bytes(self.take()[1:-1], "utf-8").decode("unicode_escape").encode("latin-1", "ignore").decode("utf-8", "replace")
        if self.eat("-"):
            return -self.value()
        if self.kind() == "num":
            return _number(self.take())
        out = self.take()
        while self.peek() == "." and self.kind() == "op":
            out += self.take() + self.take()
        return out

    def lookup(self, name: str) -> Any:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        raise MetadataError(f"unknown type {name!r}")

    def attributes(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        self.take("{")
        while not self.eat("}"):
            key = self.value()
            self.take("=")
            out[key] = self.value()
            self.take(";")
        return out

    def integer(self) -> Int:
        a = self.attributes()
        size = a.get("size")
        if not isinstance(size, int) or not 1 <= size <= 64:
            raise MetadataError(f"integer size {size!r}")
        signed = str(a.get("signed", "false")).lower() in ("true", "1")
        align = a.get("align", 8 if size % 8 == 0 else 1)
        base = {"decimal": 10, "dec": 10, "d": 10, "i": 10, "u": 10, "hexadecimal": 16, "hex": 16, "x": 16, "X": 16, "p": 16, "octal": 8, "oct": 8, "o": 8, "binary": 2, "b": 2}.get(a.get("base", 10), a.get("base", 10))
        clock = a.get("map")
        out = Int(size, signed, align, {"be": "be", "le": "le", "network": "be"}.get(a.get("byte_order"), ""), base, str(a.get("encoding", "none")).upper() in ("UTF8", "UTF-8", "ASCII"), str(clock).split(".")[1] if clock else None)
        return out

    def floating(self) -> Float:
        a = self.attributes()
        size = a.get("exp_dig", 0) + a.get("mant_dig", 0)
        if size not in (32, 64):
            raise MetadataError(f"floating-point size {size}")
        return Float(size, a.get("align", 8), {"be": "be", "le": "le", "network": "be"}.get(a.get("byte_order"), ""))

    def members(self) -> list[tuple[str, Any]]:
        out = []
        self.take("{")
        self.scopes.append({})
        while not self.eat("}"):
            if self.alias():
                continue
            base = self.type()
            name, fc = self.declarator(base)
            out.append((name, fc))
            self.take(";")
        self.scopes.pop()
        return out

    def declarator(self, fc: Any) -> tuple[str, Any]:
        name = self.take()
        sizes: list[int | str] = []
        while self.eat("["):
            sizes.append(self.value())
            self.take("]")
        for s in reversed(sizes):
            fc = Array(fc, s)
        return name, fc

    def type(self) -> Any:
        t = self.take()
        if t == "integer":
            return self.integer()
        if t == "floating_point":
            return self.floating()
        if t == "string":
            if self.peek() == "{":
                self.attributes()
            return Str()
        if t == "struct":
            name = self.take() if self.kind() == "name" and self.peek() != "align" else None
            if self.peek() != "{":
                if name is None:
                    raise MetadataError("struct without a body")
                return self.lookup(f"struct {name}")
            out = Struct(self.members())
            if self.eat("align"):
                self.take("(")
                out.least = self.value()
                self.take(")")
            if name:
                self.scopes[-1][f"struct {name}"] = out
            return out
        if t == "variant":
            name = self.take() if self.kind() == "name" else None
            tag = ""
            if self.eat("<"):
                tag = self.value()
                self.take(">")
            if self.peek() != "{":
                found = self.lookup(f"variant {name}")
                return Variant(tag or found.tag, found.options)
            out = Variant(tag, self.members())
            if name:
                self.scopes[-1][f"variant {name}"] = out
            return out
        if t == "enum":
            name = self.take() if self.kind() == "name" else None
            of = None
            if self.eat(":"):
                of = self.type()
            if self.peek() != "{":
                return self.lookup(f"enum {name}")
            self.take("{")
            labels: list[tuple[str, int, int]] = []
            after = 0
            while not self.eat("}"):
                label = self.value()
                lo = hi = after
                if self.eat("="):
                    lo = hi = self.value()
                    if self.eat("..."):
                        hi = self.value()
                labels.append((str(label), lo, hi))
                after = hi + 1
                self.eat(",")
            out = Enum(of or self.lookup("int"), labels)
            if name:
                self.scopes[-1][f"enum {name}"] = out
            return out
        words = [t]
        while self.kind() == "name" and any(f"{' '.join(words)} {self.peek()}" in s for s in self.scopes):
            words.append(self.take())
        return self.lookup(" ".join(words))

    def alias(self) -> bool:
        if self.peek() == "typealias":
            self.take()
            fc = self.type()
            self.take(":=")
            words = []
            while self.peek() != ";":
                words.append(self.take())
            self.take(";")
            self.scopes[-1][" ".join(words)] = fc
            return True
        if self.peek() == "typedef":
            self.take()
            fc = self.type()
            name, fc = self.declarator(fc)
            self.take(";")
            self.scopes[-1][name] = fc
            return True
        return False

    def block(self) -> dict[str, Any]:
        """Attributes and type assignments of a trace, stream, event or clock."""
        out: dict[str, Any] = {}
        self.take("{")
        self.scopes.append({})
        while not self.eat("}"):
            if self.alias():
                continue
            key = self.value()
            out[key] = self.type() if self.eat(":=") else (self.take("="), self.value())[1]
            self.take(";")
        self.scopes.pop()
        return out

    def parse(self) -> Trace:
        t = self.trace
        pending: list[dict[str, Any]] = []
        while self.i < len(self.toks):
            if self.alias():
                continue
            head = self.peek()
            if head in ("struct", "variant", "enum"):
                self.type()
                self.eat(";")
                continue
            self.take()
            if head == "env":
                t.env.update(self.attributes())
            else:
                a = self.block()
                if head == "trace":
                    t.order = {"be": "be", "network": "be"}.get(a.get("byte_order"), "le")
                    t.uuid = a.get("uuid")
                    t.packet_header = a.get("packet.header")
                elif head == "clock":
                    t.clocks[str(a.get("name"))] = Clock(str(a.get("name")), a.get("freq", 1_000_000_000), a.get("offset_s", 0), a.get("offset", 0), str(a.get("absolute", "false")).lower() == "true", a.get("uuid"), a.get("precision", 0), a.get("description"))
                elif head == "stream":
                    s = StreamClass(a.get("id", 0), a.get("packet.context"), a.get("event.header"), a.get("event.context"))
                    if s.id in t.streams:
                        raise MetadataError(f"stream {s.id} twice")
                    t.streams[s.id] = s
                elif head == "event":
                    pending.append(a)
                elif head != "callsite":
                    raise MetadataError(f"unknown block {head!r}")
            self.eat(";")
        if not t.streams:
            t.streams[0] = StreamClass()
        for a in pending:
            e = EventClass(a.get("id", 0), a.get("stream_id", next(iter(t.streams)) if len(t.streams) == 1 else 0), str(a.get("name", "")), a.get("loglevel"), a.get("model.emf.uri"), a.get("context"), a.get("fields"))
            if e.stream_id not in t.streams:
                raise MetadataError(f"event {e.name!r} of unknown stream {e.stream_id}")
            if e.id in t.streams[e.stream_id].events:
                raise MetadataError(f"event {e.id} twice in stream {e.stream_id}")
            t.streams[e.stream_id].events[e.id] = e
        return t


def plain_metadata(data: bytes) -> str:
    """The text of a metadata file, freed from packet headers if it is packetised."""
    for order in ("<", ">"):
        if len(data) >= 37 and struct.unpack_from(order + "I", data)[0] == PACKET_MAGIC:
            out, at = b"", 0
            while at + 37 <= len(data):
                _, _, _, content, packet = struct.unpack_from(order + "I16sIII", data, at)
                out += data[at + 37 : at + content // 8]
                at += max(packet // 8, 37)
            return out.decode("utf-8")
    return data.decode("utf-8")


def parse_metadata(text: str | bytes) -> Trace:
    return Parser(plain_metadata(text) if isinstance(text, bytes) else text).parse()


def parse_type(text: str) -> Any:
    """A field class alone, with u8 to u64, s8 to s64, nt_str as short names."""
    names = "".join(f"typealias integer {{ size = {n}; align = 8; signed = {str(s == 's').lower()}; }} := {s}{n};" for n in (8, 16, 32, 64) for s in "us") + "typealias string := nt_str;"
    p = Parser(names + text)
    while p.alias():
        pass
    return p.type()
