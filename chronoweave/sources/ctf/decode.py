"""Field values from bits, and messages from the packets of a data stream."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from .tsdl import PACKET_MAGIC, Array, Enum, Float, Int, Str, StreamClass, Struct, Trace, Variant


class TornStream(ValueError):
    """The data end inside a field."""


class Bits:
    """A cursor over the bits of a buffer, in the byte order of each field."""

    def __init__(self, data: bytes, order: str, at: int = 0, end: int | None = None):
        self.data, self.order, self.at, self.end = data, order, at, len(data) * 8 if end is None else end

    def align(self, n: int) -> None:
        if n > 1:
            self.at = -(-self.at // n) * n

    def take(self, size: int, order: str) -> int:
        a, b = self.at, self.at + size
        if b > self.end:
            raise TornStream(f"{size} bits at {a}, {self.end} there")
        self.at = b
        chunk = self.data[a // 8 : -(-b // 8)]
        if order == "be":
            return int.from_bytes(chunk, "big") >> (-b % 8) & ((1 << size) - 1)
        return int.from_bytes(chunk, "little") >> (a % 8) & ((1 << size) - 1)

    def integer(self, f: Int) -> int:
        self.align(f.align)
        v = self.take(f.size, f.order or self.order)
        return v - (1 << f.size) if f.signed and v >> (f.size - 1) else v

    def value(self, f: Any, scopes: list[dict], clocks: list[tuple[Int, int]] | None = None) -> Any:
        if isinstance(f, Int):
            v = self.integer(f)
            if clocks is not None and f.clock:
                clocks.append((f, v))
            return v
        if isinstance(f, Enum):
            return self.value(f.of, scopes, clocks)
        if isinstance(f, Float):
            self.align(f.align)
            raw = self.take(f.size, f.order or self.order)
            return struct.unpack(">f" if f.size == 32 else ">d", raw.to_bytes(f.size // 8, "big"))[0]
        if isinstance(f, Str):
            self.align(8)
            a = self.at // 8
            z = self.data.find(b"\0", a, self.end // 8)
            if z < 0:
                raise TornStream("string without an end")
            self.at = (z + 1) * 8
            return self.data[a:z].decode("utf-8", "replace")
        if isinstance(f, Struct):
            self.align(f.align)
            out: dict[str, Any] = {}
            for name, of in f.fields:
                out[name] = self.value(of, [*scopes, out], clocks)
            return out
        if isinstance(f, Array):
            n = f.length if isinstance(f.length, int) else find(f.length, scopes)
            self.align(f.align)
            if isinstance(f.of, Int) and f.of.text and f.of.size == 8 and f.of.align == 8:
                raw = bytes(self.integer(f.of) for _ in range(n))
                return raw.split(b"\0")[0].decode("utf-8", "replace")
            return [self.value(f.of, scopes, clocks) for _ in range(n)]
        if isinstance(f, Variant):
            label = tag_labels(f.tag, scopes)
            for name, of in f.options:
                if name in label or name.lstrip("_") in {x.lstrip("_") for x in label}:
                    return self.value(of, scopes, clocks)
            raise TornStream(f"no option for {label}")
        raise TypeError(type(f))


class _Tagged(dict):
    """A scope that knows the classes of its members."""


def find(path: str, scopes: list[dict]) -> Any:
    """A value by a path, from the innermost scope outwards."""
    names = path.split(".")
    for skip in range(len(names)):
        own = names[skip:]
        for scope in reversed(scopes):
            at: Any = scope
            for n in own:
                at = at.get(n) if isinstance(at, dict) else None
            if at is not None:
                return at
    raise KeyError(path)


def tag_labels(path: str, scopes: list[dict]) -> list[str]:
    value = find(path, scopes)
    classes = scopes[0].get("\0classes", {})
    mappings = classes.get(path.split(".")[-1], [])
    return [label for label, lo, hi in mappings if lo <= value <= hi]


def enum_labels(f: Any, out: dict[str, list] | None = None) -> dict[str, list]:
    """The mappings of all enumerations inside a class, by member name."""
    out = {} if out is None else out
    if isinstance(f, Struct):
        for name, of in f.fields:
            if isinstance(of, Enum):
                out[name] = of.labels
            enum_labels(of, out)
    elif isinstance(f, Array):
        enum_labels(f.of, out)
    elif isinstance(f, Variant):
        for _, of in f.options:
            enum_labels(of, out)
    return out


def decode_value(f: Any, data: bytes, order: str = "le") -> Any:
    return Bits(data, order).value(f, [{"\0classes": enum_labels(f)}])


class ClockState:
    """Restores times from counters of any width: one that falls behind has wrapped once; 64 bits replace all."""

    def __init__(self) -> None:
        self.value = 0

    def update(self, f: Int, v: int) -> int:
        if f.size >= 64:
            self.value = v
        else:
            low = self.value & ((1 << f.size) - 1)
            self.value += v - low + ((1 << f.size) if v < low else 0)
        return self.value


def _time(clocks: list[tuple[Int, int]], state: ClockState) -> int | None:
    now = None
    for f, v in clocks:
        now = state.update(f, v)
    return now


def _stamp(ctx: Struct | None, name: str) -> Int | None:
    for n, f in ctx.fields if ctx else []:
        if n == name and isinstance(f, Int):
            return f
    return None


def packets(trace: Trace, data: bytes) -> Iterator[dict]:
    """Header and context of each packet of a data stream, with where it lies."""
    at, order, k = 0, trace.order, 0
    while at < len(data) * 8:
        b = Bits(data, order, at)
        scopes: list[dict] = [{"\0classes": enum_labels(trace.packet_header)}]
        header = b.value(trace.packet_header, scopes) if trace.packet_header else {}
        if "magic" in header and header["magic"] != PACKET_MAGIC:
            raise TornStream(f"magic {header['magic']:#x}")
        sc = trace.streams.get(header.get("stream_id", next(iter(trace.streams))))
        if sc is None:
            raise TornStream(f"unknown stream class {header.get('stream_id')}")
        clocks: list[tuple[Int, int]] = []
        scopes[0]["\0classes"] |= enum_labels(sc.packet_context)
        context = b.value(sc.packet_context, [*scopes, header], clocks) if sc.packet_context else {}
        size = context.get("packet_size") or (context.get("content_size") or len(data) * 8 - at)
        content = context.get("content_size") or size
        yield {"at": at, "body": b.at, "end": min(at + content, len(data) * 8), "size": size, "header": header, "context": context, "class": sc, "ord": k}
        at += max(size, 8)
        k += 1


@dataclass
class Part:
    """What a file is of its stream: whether it holds the beginning and the end, what stands before it (counters and end of the last packet, in cycles), and of each packet that counts its number in the stream and its times, which may be repaired."""

    first: bool = True
    last: bool = True
    before: dict | None = None
    packets: dict[int, tuple[int, int | None, int | None]] | None = None


def messages(trace: Trace, data: bytes, part: Part | None = None) -> Iterator[dict]:
    """SB, then for each packet DE, DP, PB, its events and PE, then SE; of a part, what lies in it. Times are cycles."""
    part = part or Part()
    state = ClockState()
    before = part.before
    if before and before["end"] is not None:
        state.value = before["end"]
    begun = not part.first
    own: dict = {}
    for p in packets(trace, data):
        if part.packets is not None and p["ord"] not in part.packets:
            continue
        sc: StreamClass = p["class"]
        c = p["context"]
        ordinal = p["ord"] if part.packets is None else part.packets[p["ord"]][0]
        own = {"stream_class_id": sc.id, "stream_id": p["header"].get("stream_instance_id"), "packet_ord": ordinal}
        if not begun:
            yield own | {"msg_type": "SB", "packet_ord": None}
            begun = True
        begin, end = c.get("timestamp_begin"), c.get("timestamp_end")
        bf, ef = _stamp(sc.packet_context, "timestamp_begin"), _stamp(sc.packet_context, "timestamp_end")
        if begin is not None and bf is not None:
            begin = state.update(bf, begin)
        if end is not None and ef is not None:
            after = ClockState()
            after.value = state.value
            end = after.update(ef, end)
        if part.packets is not None:
            begin, end = (x if y is None else y for x, y in zip((begin, end), part.packets[p["ord"]][1:], strict=True))
        lost = c.get("events_discarded")
        if lost is not None and (lost != 0 if before is None else lost != before["lost"]):
            yield own | {"msg_type": "DE", "packet_ord": None, "cycles": begin if before is None else before["end"], "end_cycles": end, "disc_count": None if before is None else lost - before["lost"]}
        seq = c.get("packet_seq_num")
        if seq is not None and before is not None and seq - before["seq"] > 1:
            yield own | {"msg_type": "DP", "packet_ord": None, "cycles": before["end"], "end_cycles": begin, "disc_count": seq - before["seq"] - 1}
        rest = {k: v for k, v in c.items() if k not in ("timestamp_begin", "timestamp_end", "content_size", "packet_size", "events_discarded", "packet_seq_num")}
        yield own | {"msg_type": "PB", "cycles": begin, "packet_context": json.dumps(rest) if rest else None}
        b = Bits(data, trace.order, p["body"], p["end"])
        base = {"\0classes": {}}
        while b.at < b.end:
            clocks: list[tuple[Int, int]] = []
            scopes: list[dict] = [base, p["header"], c]
            base["\0classes"] = enum_labels(sc.event_header) | enum_labels(sc.event_context)
            try:
                header = b.value(sc.event_header, scopes, clocks) if sc.event_header else {}
                ident = find("id", [header, header.get("v", {})]) if sc.event_header and _has_id(header) else next(iter(sc.events))
                ec = sc.events.get(ident)
                if ec is None:
                    raise TornStream(f"unknown event class {ident}")
                base["\0classes"] = base["\0classes"] | enum_labels(ec.context) | enum_labels(ec.fields)
                scopes.append(header)
                common = b.value(sc.event_context, scopes, clocks) if sc.event_context else None
                own_context = b.value(ec.context, [*scopes, common or {}], clocks) if ec.context else None
                at = b.at
                payload = b.value(ec.fields, [*scopes, common or {}, own_context or {}], clocks) if ec.fields else {}
            except TornStream:
                raise
            if b.at == at and not sc.event_header and not payload:
                break
            now = _time(clocks, state)
            yield own | {
                "msg_type": "EV", "cycles": now if now is not None else (state.value if trace.clocks else None), "event_class_id": ec.id, "event_class_name": ec.name, "log_level": ec.log_level, "emf_uri": ec.emf_uri,
                "common_context": json.dumps(common) if common is not None else None, "specific_context": json.dumps(own_context) if own_context is not None else None, "payload": json.dumps(payload),
            }
        yield own | {"msg_type": "PE", "cycles": end}
        if end is not None:
            state.value = max(state.value, end)
        before = {"lost": lost, "seq": seq, "end": end}
    if begun and own and part.last:
        yield own | {"msg_type": "SE", "packet_ord": None}


def _has_id(header: dict) -> bool:
    return "id" in header or isinstance(header.get("v"), dict) and "id" in header["v"]
