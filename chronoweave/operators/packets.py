"""Packet tables: losses between packets, repairs of wrong packet times, duplicates, ranges and intersections.

A packet table has (trace_name, stream_id, packet_ord, ts_begin, ts_end, packet_seq_num, events_discarded) and, for
repairs, the first and last event time of each packet (first_event_ns, last_event_ns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKET_STREAM = ["trace_name", "stream_id"]


def _w(by: list[str]):
    return Window.partitionBy(*by).orderBy("packet_ord")


def packets_of(messages: DataFrame) -> DataFrame:
    """The packet table of a message table."""
    rows = messages.where("packet_ord is not null").groupBy(*PACKET_STREAM, "packet_ord")
    event = F.when(F.col("msg_type") == "EV", F.col("ts_ns"))
    return rows.agg(F.min(F.when(F.col("msg_type") == "PB", F.col("ts_ns"))).alias("ts_begin"), F.max(F.when(F.col("msg_type") == "PE", F.col("ts_ns"))).alias("ts_end"), F.min(event).alias("first_event_ns"), F.max(event).alias("last_event_ns"), F.count(event).alias("n_events"))


def discarded_events(packets: DataFrame, by: list[str] = PACKET_STREAM, timed: bool = True) -> DataFrame:
    """Losses of events before packets, from the counter in each: the first packet tells no count, later ones the difference.

    A counter that falls is an error: count is null and ``broken`` true.
    """
    w = _w(by)
    before = F.lag("events_discarded").over(w)
    first = F.row_number().over(w) == 1
    step = F.when(first, F.lit(None)).otherwise(F.col("events_discarded") - before)
    out = packets.select("*", step.cast("long").alias("_step"), first.alias("_first"), F.lag("ts_end").over(w).alias("_end"))
    lost = F.when(F.col("_first"), F.col("events_discarded") != 0).otherwise(F.col("_step") != 0)
    span = lambda c: c if timed else F.lit(None).cast("long")
    return out.where(lost).select(
        *by, "packet_ord", F.lit("DE").alias("msg_type"), span(F.when(F.col("_first"), F.col("ts_begin")).otherwise(F.col("_end"))).alias("begin_ns"), span(F.col("ts_end")).alias("end_ns"), F.when(F.col("_step") > 0, F.col("_step")).alias("disc_count"), F.coalesce(F.col("_step") < 0, F.lit(False)).alias("broken")
    )


def discarded_packets(packets: DataFrame, by: list[str] = PACKET_STREAM, timed: bool = True) -> DataFrame:
    """Losses of packets: gaps in their sequence numbers; never before the first packet."""
    w = _w(by)
    out = packets.select("*", (F.col("packet_seq_num") - F.lag("packet_seq_num").over(w)).alias("_step"), F.lag("ts_end").over(w).alias("_end"))
    span = lambda c: c if timed else F.lit(None).cast("long")
    return out.where("_step > 1 or _step < 0").select(
        *by, "packet_ord", F.lit("DP").alias("msg_type"), span(F.col("_end")).alias("begin_ns"), span(F.col("ts_begin")).alias("end_ns"), F.when(F.col("_step") > 1, F.col("_step") - 1).alias("disc_count"), (F.col("_step") < 0).alias("broken")
    )


def losses(packets: DataFrame, by: list[str] = PACKET_STREAM) -> DataFrame:
    """Both kinds, with the order in which they precede their packet: events, then packets."""
    both = discarded_events(packets, by).unionByName(discarded_packets(packets, by))
    return both.withColumn("before_packet", F.when(F.col("msg_type") == "DE", 0).otherwise(1))


def without_duplicates(packets: DataFrame, by: list[str] = PACKET_STREAM, keys: tuple[str, ...] = ("packet_size", "ts_begin", "ts_end", "packet_seq_num")) -> DataFrame:
    """One packet of those equal in size, times and sequence number (overlapping snapshots), the first by packet_ord."""
    own = [*by, *keys]
    rest = [c for c in packets.columns if c not in own]
    first = packets.groupBy(*own).agg(F.min(F.struct("packet_ord", *(c for c in rest if c != "packet_ord"))).alias("_r"))
    return first.select(*own, *(F.col(f"_r.{c}").alias(c) for c in rest))


def events_after_packet(packets: DataFrame, by: list[str] = PACKET_STREAM) -> DataFrame:
    """Repairs packets whose events run past their end: each ends where the next begins, the last with its last event."""
    return packets.withColumn("ts_end", F.coalesce(F.lead("ts_begin").over(_w(by)), F.col("last_event_ns"), F.col("ts_begin")))


def events_before_packet(packets: DataFrame, by: list[str] = PACKET_STREAM) -> DataFrame:
    """Repairs packets that begin after their first event: from the second on each begins with it, and the one before ends there."""
    w = _w(by)
    begin = F.when(F.row_number().over(w) > 1, F.coalesce("first_event_ns", "ts_begin")).otherwise(F.col("ts_begin"))
    out = packets.withColumn("_b", begin)
    return out.withColumn("ts_end", F.coalesce(F.lead("_b").over(w), F.col("ts_end"))).withColumn("ts_begin", F.col("_b")).drop("_b")


def crashed(packets: DataFrame, by: list[str] = PACKET_STREAM) -> DataFrame:
    """Repairs packets that a crash left with end 0: the next begin, or the last event, or the own begin."""
    torn = (F.col("ts_end") == 0) & (F.col("ts_begin") != 0)
    return packets.withColumn("ts_end", F.when(torn, F.coalesce(F.lead("ts_begin").over(_w(by)), F.col("last_event_ns"), F.col("ts_begin"))).otherwise(F.col("ts_end")))


#: A tracer, versions (major, minor, patch) from which and below which it has a fault, and the repair.
FAULTS = [
    ("lttng-ust", (0, 0, 0), (2, 11, 0), "events_after_packet"),
    ("lttng-modules", (0, 0, 0), (2, 9, 13), "events_after_packet"),
    ("lttng-modules", (2, 10, 0), (2, 10, 10), "events_after_packet"),
    ("barectf", (0, 0, 0), (2, 3, 1), "events_before_packet"),
    ("lttng-ust", (0, 0, 0), (10**6, 0, 0), "crashed"),
    ("lttng-modules", (0, 0, 0), (10**6, 0, 0), "crashed"),
]


def repairs_for(env: dict) -> list[str]:
    """Which repairs a trace's environment asks for: by tracer_name, tracer_major, tracer_minor and tracer_patch (or tracer_patchlevel)."""
    name, major = env.get("tracer_name"), env.get("tracer_major")
    if not isinstance(name, str) or not isinstance(major, int):
        return []
    version = (major, env.get("tracer_minor") or 0, env.get("tracer_patch", env.get("tracer_patchlevel")) or 0)
    return [repair for tracer, since, fixed, repair in FAULTS if tracer == name and since <= version < fixed]


def repaired(packets: DataFrame, env: dict, by: list[str] = PACKET_STREAM) -> DataFrame:
    for name in repairs_for(env):
        packets = {"events_after_packet": events_after_packet, "events_before_packet": events_before_packet, "crashed": crashed}[name](packets, by)
    return packets


def stream_ranges(packets: DataFrame, by: list[str] = PACKET_STREAM) -> DataFrame:
    """Begin and end of each stream; null if a packet's time is unknown."""
    known = lambda c: F.when(F.count(c) == F.count("*"), F.min(c) if c == "ts_begin" else F.max(c))
    return packets.groupBy(*by).agg(known("ts_begin").alias("begin_ns"), known("ts_end").alias("end_ns"))


def intersections(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Common range of the streams of each trace: the latest begin and the earliest end, or what is wrong."""
    own = by or ["trace_name"]
    out = ranges.groupBy(*own).agg(F.max("begin_ns").alias("begin_ns"), F.min("end_ns").alias("end_ns"), F.count("*").alias("n_streams"), F.sum(F.col("begin_ns").isNull().cast("int") + F.col("end_ns").isNull().cast("int")).alias("unknown"))
    wrong = F.when(F.col("unknown") > 0, "a stream has no range").when((F.col("begin_ns") < 0) | (F.col("end_ns") < 0), "negative time").when(F.col("begin_ns") > F.col("end_ns"), "streams don't intersect")
    return out.withColumn("error", wrong).drop("unknown")


def port_name(trace: str = "trace_name", stream_class: str = "stream_class_id", stream: str = "stream_id"):
    """``TRACE | CLASS | STREAM``, without what is absent."""
    return F.concat_ws(" | ", F.col(trace), F.col(stream_class).cast("string"), F.col(stream).cast("string"))


def merged_traces(traces: DataFrame) -> DataFrame:
    """traces: (uuid, path, n_stream_classes, n_event_classes). Directories of one UUID are one trace, and the class with most stream and event classes is its class; ordered by the first path."""
    key = F.coalesce("uuid", F.concat(F.lit("path:"), F.col("path")))
    weight = F.col("n_stream_classes") + F.col("n_event_classes")
    out = traces.groupBy(key.alias("trace_key")).agg(F.min("path").alias("first_path"), F.count("*").alias("n_paths"), F.max(weight).alias("weight"), F.min(F.struct((-weight).alias("w"), "path")).alias("_b"))
    return out.select("trace_key", "first_path", "n_paths", "weight", F.col("_b.path").alias("class_path"))
