"""Binary traces as message tables.

Metadata are parsed on the driver. Directories of one UUID are one trace, read with the metadata that know most classes. Data
streams are read through Spark's binary-file source, so any store that Spark reads will do, one row for each file.

A stream may lie in several files and directories. A packet table (from index files where there are any, else from the
headers) puts its packets in order of their begin; packets that overlapping snapshots hold twice count once, and
the times of packets that a known tracer got wrong are repaired. Each file is then decoded by itself, told what of it counts and
what stands before it, so losses between two files are found and a stream has one beginning and one end.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions.clock import NS
from ...operators import packets as tables
from ...operators.storage import stored
from ...schema import messages
from . import decode
from .tsdl import Clock, Trace, parse_metadata


#: Fixed value: what an index file begins with.
INDEX_MAGIC = 0xC1F1DCC1


def load_metadata(spark: SparkSession, path: str) -> Trace:
    row = spark.read.format("binaryFile").load(f"{path}/metadata").select("content").first()
    return parse_metadata(bytes(row["content"]))


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".") & (name != "metadata") & ~name.endswith(".idx")).select("path", "content")


def stream_ref(header: dict, path: str) -> int:
    got = header.get("stream_instance_id")
    return got if got is not None else zlib.crc32(path.encode()) & 0x7FFFFFFF


_INDEX = "path string, stream_class_id long, stream_id long, packet_ord long, packet_size long, ts_begin long, ts_end long, packet_seq_num long, events_discarded long"
_INDEX_NAMES = [f.split()[0] for f in _INDEX.split(", ")]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_INDEX_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(cols)], _INDEX_NAMES)


def _small(x: int | None) -> int | None:
    """Counters are unsigned; what a long can't hold counts as unknown."""
    return x if x is not None and x < 2**63 else None


def scanned_packets(trace: Trace, files: DataFrame) -> DataFrame:
    """A row for each packet of files (path, content), from headers and contexts alone; times are cycles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in decode.packets(trace, data):
                    c = p["context"]
                    rows.append((name, p["class"].id, stream_ref(p["header"], name), p["ord"], p["size"], *(_small(c.get(k)) for k in ("timestamp_begin", "timestamp_end", "packet_seq_num", "events_discarded"))))
            yield _index_batch(rows)

    return files.mapInArrow(run, _INDEX)


def indexed_packets(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The same from the index files ``index/NAME.idx`` that name their stream; a broken one isn't used. None without any."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load([f"{p}/index" for p in paths]).select("path", "content")
    except AnalysisException:  # no such folder
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    entries = parse_index(data)
                except PacketIndexError:
                    continue
                folder, file = name.rsplit("/index/", 1)
                if all(e["stream_id"] is not None for e in entries):
                    rows += [(f"{folder}/{file.removesuffix('.idx')}", e["stream_class_id"], e["stream_id"], k, e["packet_size"], *(_small(e[c]) for c in ("ts_begin", "ts_end", "packet_seq_num", "events_discarded"))) for k, e in enumerate(entries)]
            yield _index_batch(rows)

    return found.mapInArrow(run, _INDEX)


def packet_index(spark: SparkSession, path: str | list[str], trace: Trace | None = None) -> DataFrame:
    """A row for each packet of a trace; times are cycles."""
    paths = [path] if isinstance(path, str) else path
    trace = trace or load_metadata(spark, paths[0])
    files = _files(spark, paths)
    indexed = indexed_packets(spark, paths)
    if indexed is None:
        return scanned_packets(trace, files)
    known = indexed.select("path").distinct()
    return indexed.join(files.select("path"), "path", "left_semi").select(*_INDEX_NAMES).unionByName(scanned_packets(trace, files.join(known, "path", "left_anti")))


class PacketIndexError(ValueError):
    """A packet index that contradicts itself or its data stream."""


def parse_index(data: bytes, stream_bytes: int | None = None) -> list[dict]:
    """Entries of a packet index file (version 1): offsets, sizes in bits and times of packets, all checked."""
    head = struct.Struct(">IIII")
    if len(data) < head.size:
        raise PacketIndexError("no header")
    magic, major, minor, length = head.unpack_from(data)
    if magic != INDEX_MAGIC or major != 1 or length < 56:
        raise PacketIndexError(f"magic {magic:#x}, version {major}.{minor}, entries of {length} bytes")
    if (len(data) - head.size) % length:
        raise PacketIndexError("torn entry")
    out: list[dict] = []
    for at in range(head.size, len(data), length):
        offset, size, content, begin, end, lost, stream = struct.unpack_from(">QQQQQQQ", data, at)
        own, seq = struct.unpack_from(">QQ", data, at + 56) if minor >= 1 and length >= 72 else (None, None)
        if out and offset <= out[-1]["offset"] or begin > end or size % 8 or content > size:
            raise PacketIndexError(f"entry {len(out)}")
        out.append({"offset": offset, "packet_size": size, "content_size": content, "ts_begin": begin, "ts_end": end, "events_discarded": lost, "stream_class_id": stream, "stream_id": own, "packet_seq_num": seq})
    if stream_bytes is not None and sum(e["packet_size"] for e in out) // 8 != stream_bytes:
        raise PacketIndexError("sizes don't add up to the data stream")
    return out


def to_ns(cycles: int | None, clock: Clock | None, shift_ns: int = 0) -> int | None:
    if cycles is None or clock is None:
        return None
    scale = lambda c: c if clock.freq == NS else int(1e9 * c / clock.freq)
    out = clock.offset_s * NS + scale(clock.offset) + scale(cycles) + shift_ns
    return out if -(2**63) <= out < 2**63 else None


_STREAM = ["stream_class_id", "stream_id"]
_SAME = ["packet_size", "ts_begin", "ts_end", "packet_seq_num"]


def _event_times(trace: Trace, files: DataFrame) -> DataFrame:
    """(path, packet_ord, first_event_ns, last_event_ns) in cycles: what repairs are made from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: dict[tuple[str, int], list[int]] = {}
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in decode.messages(trace, data):
                    if m["msg_type"] == "EV" and m.get("cycles") is not None:
                        span = at.setdefault((name, m["packet_ord"]), [m["cycles"], m["cycles"]])
                        span[:] = min(span[0], m["cycles"]), max(span[1], m["cycles"])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in at], pa.string()), pa.array([k[1] for k in at], pa.int64()), pa.array([v[0] for v in at.values()], pa.int64()), pa.array([v[1] for v in at.values()], pa.int64())], ["path", "packet_ord", "first_event_ns", "last_event_ns"])

    return files.mapInArrow(run, "path string, packet_ord long, first_event_ns long, last_event_ns long")


def file_parts(trace: Trace, index: DataFrame, files: DataFrame) -> DataFrame:
    """Of each file that counts: (path, stream_class_id, stream_id, rank, first, last, before, packets), as decode.Part wants it."""
    # packets that name no time and no number can't be told apart, so none of them is a duplicate
    told = F.col("ts_begin").isNotNull() & F.col("ts_end").isNotNull()
    twice = F.row_number().over(Window.partitionBy(*_STREAM, *_SAME).orderBy("path", "packet_ord"))
    rows = index.withColumn("_twice", F.when(told, twice).otherwise(1)).where("_twice = 1").drop("_twice")
    order = Window.partitionBy(*_STREAM).orderBy(F.col("ts_begin").asc_nulls_first(), "path", "packet_ord")
    rows = rows.withColumn("file_ord", F.col("packet_ord")).withColumn("packet_ord", F.row_number().over(order).cast("long") - 1)
    if tables.repairs_for(trace.env):
        times = _event_times(trace, files).withColumnRenamed("packet_ord", "file_ord")
        rows = tables.repaired(rows.join(times, ["path", "file_ord"], "left"), trace.env, _STREAM)
    w = Window.partitionBy(*_STREAM).orderBy("packet_ord")
    rows = rows.withColumn("before", F.when(F.col("packet_ord") > 0, F.struct(F.lag("events_discarded").over(w).alias("lost"), F.lag("packet_seq_num").over(w).alias("seq"), F.lag("ts_end").over(w).alias("end"))))
    each = F.sort_array(F.collect_list(F.struct("packet_ord", "file_ord", "ts_begin", "ts_end")))
    parts = rows.groupBy("path", *_STREAM).agg(each.alias("packets"), F.min_by("before", "packet_ord").alias("before"), F.min("packet_ord").alias("_at"))
    by = Window.partitionBy(*_STREAM).orderBy("_at")
    parts = parts.withColumn("rank", F.row_number().over(by) - 1).withColumn("last", F.lead("_at").over(by).isNull())
    return parts.withColumn("first", F.col("rank") == 0).drop("_at")


_ROWS = "port_ord int, src_seq long, stream_class_id long, stream_id long, msg_type string, cycles decimal(20,0), ts_ns long, end_ts_ns long, disc_count decimal(20,0), packet_ord long, event_class_id long, event_class_name string, log_level int, emf_uri string, packet_context string, common_context string, specific_context string, payload string"


def _read_trace(spark: SparkSession, trace: Trace, paths: list[str], first_port: int, shift: int) -> tuple[DataFrame, int]:
    """One trace, and how many ports it has."""
    clock = next(iter(trace.clocks.values()), None)
    names = [f.split()[0] for f in _ROWS.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0)}
    kinds = [types[f.split(" ", 1)[1]] for f in _ROWS.split(", ")]
    files = _files(spark, paths)
    index = stored(packet_index(spark, paths, trace), "packets")
    streams = [tuple(r) for r in index.select(*_STREAM).distinct().orderBy(*_STREAM).collect()]  # a row for each stream
    ports = {s: first_port + k for k, s in enumerate(streams)}
    parts = file_parts(trace, index, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        dec = lambda x: None if x is None else Decimal(x)
        for batch in batches:
            data_of, told = batch.column(0), batch.drop_columns(["content"]).to_pylist()
            for k, r in enumerate(told):
                data = data_of[k].as_py()
                part = decode.Part(r["first"], r["last"], r["before"], {p["file_ord"]: (p["packet_ord"], p["ts_begin"], p["ts_end"]) for p in r["packets"]})
                port = ports[r["stream_class_id"], r["stream_id"]]
                rows: list[list] = []
                for i, m in enumerate(decode.messages(trace, data, part)):
                    rows.append([
                        port, (r["rank"] << 40) + i, m["stream_class_id"], r["stream_id"], m["msg_type"], dec(m.get("cycles")), to_ns(m.get("cycles"), clock, shift), to_ns(m.get("end_cycles"), clock, shift), dec(m.get("disc_count")), m.get("packet_ord"), m.get("event_class_id"), m.get("event_class_name"), m.get("log_level"), m.get("emf_uri"),
                        m.get("packet_context"), m.get("common_context"), m.get("specific_context"), m.get("payload"),
                    ])
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    told = files.join(parts, "path").select("content", *parts.columns)
    return told.mapInArrow(run, _ROWS), len(streams)


def read_ctf(spark: SparkSession, path: str | list[str], trace_name: str | None = None, clock_offset_s: int = 0, clock_offset_ns: int = 0, unix_epoch: bool = False) -> DataFrame:
    """Trace directories as a message table; a port for each data stream. Directories of one UUID are one trace.

    unix_epoch: clocks count from 1970 whatever the metadata say. That changes whether they may be compared, not their values.
    """
    groups: dict[str, list[tuple[str, Trace]]] = {}
    for p in [path] if isinstance(path, str) else path:
        trace = load_metadata(spark, p)
        groups.setdefault(trace.uuid or p, []).append((p, trace))
    kinds = {bool(c.absolute or unix_epoch) for own in groups.values() for _, t in own for c in t.clocks.values()}
    if len(kinds) > 1:
        raise ValueError("clocks from 1970 and others can't be merged")
    out, ports = None, 0
    for own in groups.values():
        trace = max((t for _, t in own), key=lambda t: len(t.streams) + sum(len(s.events) for s in t.streams.values()))
        rows, n = _read_trace(spark, trace, [p for p, _ in own], ports, clock_offset_s * NS + clock_offset_ns)
        ports += n
        rows = messages(rows.withColumn("trace_uuid", F.lit(trace.uuid)).withColumn("trace_name", F.lit(trace_name)).withColumn("trace_env", F.lit(json.dumps(trace.env, default=str) if trace.env else None).cast("string")))
        out = rows if out is None else out.unionByName(rows)
    return out


def trace_infos(spark: SparkSession, path: str) -> DataFrame:
    """(port, begin_ns, end_ns) of each stream: first begin and last end of its packets."""
    trace = load_metadata(spark, path)
    clock = next(iter(trace.clocks.values()), Clock())
    from ...functions.clock import cycles_to_ns

    ranges = packet_index(spark, path).groupBy("stream_class_id", "stream_id").agg(F.min("ts_begin").alias("b"), F.max("ts_end").alias("e"))
    ns = lambda c: cycles_to_ns(F.col(c), clock.freq, clock.offset_s, clock.offset)
    port = F.concat_ws(" | ", F.lit(trace.uuid or path), F.col("stream_class_id").cast("string"), F.col("stream_id").cast("string"))
    return ranges.select(port.alias("port"), ns("b").alias("begin_ns"), ns("e").alias("end_ns"))
