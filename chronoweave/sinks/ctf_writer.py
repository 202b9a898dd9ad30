"""Message tables as binary traces.

Each stream becomes one data file, written by one task through a Python data source; the metadata are written on commit, once all
streams are there. The folder must be one that all executors see under the same path; outside local mode it is refused unless
``shared`` says so. Streams without packets get packets of their own, closed once they hold ``packet_bytes``.

Types are given for each event class of a stream class, and for the contexts of a stream class; where none is given, they are
taken from the JSON objects if all rows of the class have the same members and these are plain numbers, texts or truth
values, else the object is written as its JSON text in a member ``json``.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..schema import messages
from ..sources.ctf.tsdl import PACKET_MAGIC

PACKET_BYTES = 4 << 20
_HEAD = struct.Struct("<I16sIQ")
_CONTEXT = struct.Struct("<QQQQQQ")
NONE = 2**64 - 1


def tsdl_type(t: T.DataType) -> str:
    """The field class of a Spark type; a boolean is a byte, an unsigned 64-bit number is decimal(20,0)."""
    if isinstance(t, T.BooleanType):
        return "integer { size = 8; align = 8; }"
    if isinstance(t, T.DecimalType):
        return "integer { size = 64; align = 8; }"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        size = {"byte": 8, "short": 16, "integer": 32, "long": 64}[t.typeName()]
        return f"integer {{ size = {size}; align = 8; signed = true; }}"
    if isinstance(t, T.FloatType):
        return "floating_point { exp_dig = 8; mant_dig = 24; align = 8; }"
    if isinstance(t, T.DoubleType):
        return "floating_point { exp_dig = 11; mant_dig = 53; align = 8; }"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.StructType):
        return "struct { " + "".join(tsdl_member(f) for f in t.fields) + "}"
    raise TypeError(f"no field class for {t.simpleString()}")


def tsdl_member(f: T.StructField) -> str:
    if isinstance(f.dataType, T.ArrayType):
        return f"integer {{ size = 32; align = 8; }} _{f.name}_length; {tsdl_type(f.dataType.elementType)} {f.name}[_{f.name}_length]; "
    return f"{tsdl_type(f.dataType)} {f.name}; "


def pack_value(t: T.DataType, v) -> bytes:
    if isinstance(t, T.BooleanType):
        return struct.pack("<B", bool(v))
    if isinstance(t, T.DecimalType):
        return struct.pack("<Q", int(v or 0))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return struct.pack("<" + {"byte": "b", "short": "h", "integer": "i", "long": "q"}[t.typeName()], int(v or 0))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return struct.pack("<f" if isinstance(t, T.FloatType) else "<d", float(v or 0))
    if isinstance(t, T.StringType):
        return str("" if v is None else v).encode().replace(b"\0", b"") + b"\0"
    if isinstance(t, T.ArrayType):
        return struct.pack("<I", len(v or [])) + b"".join(pack_value(t.elementType, x) for x in v or [])
    if isinstance(t, T.StructType):
        return b"".join(pack_value(f.dataType, (v or {}).get(f.name)) for f in t.fields)
    raise TypeError(t.simpleString())


@dataclass
class Committed(WriterCommitMessage):
    files: list[str]


@dataclass
class Types:
    """Struct types: of payloads and specific contexts by (stream class, event class), of packet and common contexts by stream class."""

    payload: dict[tuple[int, int], T.StructType] = field(default_factory=dict)
    specific: dict[tuple[int, int], T.StructType] = field(default_factory=dict)
    packet: dict[int, T.StructType] = field(default_factory=dict)
    common: dict[int, T.StructType] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({k: [[key, t.jsonValue()] for key, t in getattr(self, k).items()] for k in ("payload", "specific", "packet", "common")})

    @classmethod
    def loads(cls, text: str) -> Types:
        return cls(**{k: {tuple(key) if isinstance(key, list) else key: T.StructType.fromJson(t) for key, t in own} for k, own in json.loads(text).items()})


_TEXT = T.StructType([T.StructField("json", T.StringType())])


def _packed(t: T.StructType | None, js: str | None) -> bytes:
    if t is None:
        return b""
    return pack_value(t, {"json": js or "{}"} if t == _TEXT else json.loads(js or "{}"))


class StreamFile:
    """One data stream: packets with their contexts, and events."""

    def __init__(self, path: str, trace_id: bytes, stream_class: int, stream: int, types: Types, packet_bytes: int):
        self.out = open(path, "wb")
        self.head, self.types, self.limit, self.stream_class = _HEAD.pack(PACKET_MAGIC, trace_id, stream_class, stream), types, packet_bytes, stream_class
        self.body, self.context, self.begin, self.last, self.lost, self.seq, self.opened, self.own = bytearray(), b"", None, 0, 0, 0, False, False

    def open_packet(self, ts: int, own: bool, context: str | None = None) -> None:
        self.body, self.begin, self.opened, self.own = bytearray(), ts, True, own
        self.context = _packed(self.types.packet.get(self.stream_class), context)

    def close_packet(self, ts: int) -> None:
        size = (_HEAD.size + _CONTEXT.size + len(self.context) + len(self.body)) * 8
        self.out.write(self.head + _CONTEXT.pack(self.begin, ts, size, size, self.lost, self.seq) + self.context + self.body)
        self.seq += 1
        self.opened = False

    def add(self, r) -> None:
        kind, ts = r["msg_type"], r["ts_ns"]
        self.last = now = max(self.last, ts if ts is not None else self.last)
        if kind == "PB":
            self.open_packet(now, False, r["packet_context"])
        elif kind == "PE":
            self.close_packet(now)
        elif kind == "EV":
            if not self.opened:
                self.open_packet(now, True)
            own = (self.stream_class, r["event_class_id"] or 0)
            self.body += struct.pack("<QQ", own[1], now) + _packed(self.types.common.get(self.stream_class), r["common_context"]) + _packed(self.types.specific.get(own), r["specific_context"]) + _packed(self.types.payload[own], r["payload"])
            if self.own and len(self.body) >= self.limit:
                self.close_packet(now)
        elif kind == "DE":
            self.lost += 1 if r["disc_count"] is None else int(r["disc_count"])
        elif kind == "DP":
            self.seq += 1 if r["disc_count"] is None else int(r["disc_count"])
        elif kind == "SE" and self.opened:
            self.close_packet(now)

    def close(self) -> None:
        if self.opened:
            self.close_packet(self.last)
        self.out.close()


class TraceWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.trace_id = options["path"], bytes.fromhex(options["traceid"])
        self.types, self.metadata, self.packet_bytes = Types.loads(options["types"]), options["metadata"], int(options["packetbytes"])

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        tag = f"{TaskContext.get().partitionId()}-{TaskContext.get().attemptNumber()}"
        files: dict[tuple[int, int], StreamFile] = {}
        names = []
        for r in iterator:
            key = (r["stream_class_id"] or 0, r["stream_id"] or 0)
            if key not in files:
                names.append(f".{stream_name(r['stream_name'], *key)}.{tag}")
                files[key] = StreamFile(os.path.join(self.path, names[-1]), self.trace_id, *key, self.types, self.packet_bytes)
            files[key].add(r)
        for f in files.values():
            f.close()
        return Committed(names)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        for m in messages:
            for name in m.files if m else []:
                os.replace(os.path.join(self.path, name), os.path.join(self.path, unique(self.path, name[1:].rsplit(".", 1)[0])))
        with open(os.path.join(self.path, "metadata"), "w", encoding="utf-8") as f:
            f.write(self.metadata)

    def abort(self, messages: list) -> None:
        for m in messages:
            for name in m.files if m else []:
                if os.path.exists(at := os.path.join(self.path, name)):
                    os.remove(at)


class TraceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronoweave_ctf"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return TraceWriter(self.options)


def stream_name(name: str | None, stream_class: int, stream: int) -> str:
    """A file name from a stream's name, without separators and leading dots."""
    clean = re.sub(r"[/\\\0]", "_", name or "").lstrip(".")
    return clean if clean not in ("", "metadata") else f"stream_{stream_class}_{stream}"


def unique(folder: str, name: str) -> str:
    out, k = name, 0
    while os.path.exists(os.path.join(folder, out)):
        out, k = f"{name}-{k}", k + 1
    return out


def metadata_text(trace_id: str, streams: list[int], classes: list[tuple[int, int, str]], types: Types, env: dict | None = None) -> str:
    u64 = "integer { size = 64; align = 8; }"
    members = lambda t: "".join(tsdl_member(f) for f in t.fields) if t else ""
    out = ["/* CTF 1.8 */", f'trace {{ major = 1; minor = 8; uuid = "{trace_id}"; byte_order = le; packet.header := struct {{ integer {{ size = 32; align = 8; }} magic; integer {{ size = 8; align = 8; }} uuid[16]; integer {{ size = 32; align = 8; }} stream_id; {u64} stream_instance_id; }}; }};']
    if env:
        out.append("env { " + " ".join(f"{k} = {json.dumps(v)};" for k, v in env.items()) + " };")
    out.append('clock { name = "c"; freq = 1000000000; offset_s = 0; absolute = true; };')
    time = "integer { size = 64; align = 8; map = clock.c.value; }"
    for s in streams:
        context = f" event.context := {tsdl_type(types.common[s])};" if s in types.common else ""
        out.append(f"stream {{ id = {s}; packet.context := struct {{ {time} timestamp_begin; {time} timestamp_end; {u64} content_size; {u64} packet_size; {u64} events_discarded; {u64} packet_seq_num; {members(types.packet.get(s))} }}; event.header := struct {{ {u64} id; {time} timestamp; }};{context} }};")
    for s, e, name in classes:
        context = f" context := {tsdl_type(types.specific[s, e])};" if (s, e) in types.specific else ""
        out.append(f"event {{ name = {json.dumps(name)}; id = {e}; stream_id = {s};{context} fields := {tsdl_type(types.payload[s, e])}; }};")
    return "\n".join(out) + "\n"


def struct_types(rows: DataFrame, column: str, by: list[str], wanted: str) -> dict[tuple, T.StructType]:
    """The struct type of a column of JSON objects for each class; one row for each class and member reaches the driver."""
    held = rows.where(wanted).where(F.col(column).isNotNull()).select(*(F.coalesce(c, F.lit(0)).alias(c) for c in by), column)
    totals = {tuple(r[:-1]): r[-1] for r in held.groupBy(*by).count().collect()}
    members = held.select(*by, F.explode(F.json_object_keys(column)).alias("name"), F.col(column).alias("js"))
    kind = F.schema_of_variant(F.element_at(F.from_json("js", "map<string,variant>"), F.col("name")))
    found = members.select(*by, "name", kind.alias("kind")).groupBy(*by, "name").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds")).orderBy("name").collect()
    out: dict[tuple, T.StructType] = {key: T.StructType() for key in totals}
    plain = {"BIGINT": T.LongType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType()}
    for r in found:
        key = tuple(r[: len(by)])
        kinds = {"DOUBLE" if k.startswith(("DECIMAL", "FLOAT")) else k for k in r["kinds"]}
        kinds = {"DOUBLE"} if kinds == {"DOUBLE", "BIGINT"} else kinds
        whole = r["n"] == totals[key] and len(kinds) == 1 and kinds <= set(plain) and re.fullmatch("[A-Za-z_][A-Za-z_0-9]*", r["name"])
        if out[key] is not _TEXT:
            out[key] = out[key].add(r["name"], plain[kinds.pop()]) if whole else _TEXT
    return {k: t if t.fields else _TEXT for k, t in out.items()}


def write_ctf(df: DataFrame, path: str, payloads: dict | None = None, ignore_discarded_events: bool = False, ignore_discarded_packets: bool = False, env: dict | None = None, packet_bytes: int = PACKET_BYTES, shared: bool = False) -> None:
    """df: a message table (ordered by ``pos`` if it has one, else by src_seq in its ports). Times must not be negative.

    payloads: a struct type for each event class, by its ID or by (stream class, event class).
    """
    spark = df.sparkSession
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a trace is written to a folder that all executors share; say so with shared")
    order = "pos" if "pos" in df.columns else "src_seq"
    rows = messages(df).where("msg_type <> 'MI'")
    if ignore_discarded_events:
        rows = rows.where("msg_type <> 'DE'")
    if ignore_discarded_packets:
        rows = rows.where("msg_type <> 'DP'")
    if not rows.where("msg_type in ('DE', 'DP')").isEmpty() and not unwritable_losses(rows, order).isEmpty():
        raise ValueError("losses that a trace can't hold: inside a packet, or over one another")
    classes = [(r[0] or 0, r[1] or 0, r[2] or "") for r in rows.where("msg_type = 'EV'").select("stream_class_id", "event_class_id", "event_class_name").distinct().collect()]  # one row for each event class
    streams = sorted({r[0] or 0 for r in rows.select("stream_class_id").distinct().collect()})
    given = payloads or {}
    event, stream = ["stream_class_id", "event_class_id"], ["stream_class_id"]
    types = Types(
        {(s, e): given.get((s, e), given.get(e)) or _TEXT for s, e, _ in classes},
        struct_types(rows, "specific_context", event, "msg_type = 'EV'"),
        {k[0]: t for k, t in struct_types(rows, "packet_context", stream, "msg_type = 'PB'").items()},
        {k[0]: t for k, t in struct_types(rows, "common_context", stream, "msg_type = 'EV'").items()},
    )
    trace_id = uuid.uuid4()
    spark.dataSource.register(TraceSink)
    wanted = rows.repartition("stream_class_id", "stream_id").sortWithinPartitions("stream_class_id", "stream_id", order)
    wanted.select("stream_class_id", "stream_id", "stream_name", "msg_type", "ts_ns", "end_ts_ns", F.col("disc_count").cast("long").alias("disc_count"), "event_class_id", "packet_context", "common_context", "specific_context", "payload").write.format("chronoweave_ctf").mode("append").options(
        path=path, traceid=trace_id.hex, types=types.dumps(), metadata=metadata_text(str(trace_id), streams, sorted(classes), types, env), packetbytes=str(packet_bytes)
    ).save()


def unwritable_losses(df: DataFrame, order: str = "pos") -> DataFrame:
    """Losses that a trace can't hold: discarded packets inside a packet, and discarded events that overlap others of their stream."""
    from pyspark.sql import Window

    w = Window.partitionBy("trace_name", "stream_class_id", "stream_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.sum(F.when(F.col("msg_type") == "PB", 1).when(F.col("msg_type") == "PE", -1).otherwise(0)).over(w)
    latest = F.max(F.when(F.col("msg_type") == "DE", F.col("end_ts_ns"))).over(w)
    rows = df.select("*", opened.alias("_open"), latest.alias("_latest"))
    return rows.where("(msg_type = 'DP' and _open > 0) or (msg_type = 'DE' and ts_ns < _latest)").drop("_open", "_latest")
