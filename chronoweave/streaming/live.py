"""The operators on streams: a merge that waits for the slowest port, late messages, windows, and stateful loss detection.

Inactivity messages ("nothing before t") are what watermarks are to Spark: with several inputs the engine takes the least
of their watermarks, as a merge waits for its slowest port. Spark drops late rows in silence; here they go to a side table first,
and strict mode raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class LateMessage(RuntimeError):
    """A message before the time that its port had passed."""


def event_time(ns: str = "ts_ns"):
    """Event time for watermarks: Spark's is microseconds."""
    return F.timestamp_micros(F.expr(f"{ns} div 1000"))


def merged_ports(frames: list[DataFrame], delay: str) -> DataFrame:
    """Streams as one, with the least watermark of all (set spark.sql.streaming.multipleWatermarkPolicy to min, its default)."""
    out = None
    for f in frames:
        own = f.withColumn("event_time", event_time()).withWatermark("event_time", delay)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def window_counts(df: DataFrame, width: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows; df has event_time with a watermark."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return df.groupBy(w, *(by or [])).agg(F.count("*").alias("n"))


def clamp_losses(df: DataFrame, inactive_until: str = "inactive_ns") -> DataFrame:
    """Losses that begin before the time up to which their stream was declared inactive begin there; others that do are late."""
    early = F.col("ts_ns") < F.col(inactive_until)
    loss = F.col("msg_type").isin("DE", "DP") & (F.col("end_ts_ns") >= F.col(inactive_until))
    return df.withColumn("late", F.coalesce(early & ~loss, F.lit(False))).withColumn("ts_ns", F.when(early & loss, F.col(inactive_until)).otherwise(F.col("ts_ns")))


def ordered_batches(sink: Callable[[DataFrame, int], None], late_to: Callable[[DataFrame], None] | None = None, strict: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: gives each batch in merged order, and late rows (column ``late``) aside."""

    def run(batch: DataFrame, number: int) -> None:
        if "late" in batch.columns:
            late = batch.where("late")
            if strict and not late.isEmpty():
                raise LateMessage(f"batch {number} has late messages")
            if late_to is not None:
                late_to(late)
            batch = batch.where("not late").drop("late")
        sink(batch.orderBy("ts_ns", F.col("trace_name").asc_nulls_last(), "stream_class_id", "stream_id", "port_ord", "src_seq"), number)

    return run


class LossDetector(StatefulProcessor):
    """Keeps the last packet of each stream and reports losses before the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, lost long, end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        before = self.last.get() if self.last.exists() else None
        for r in pd.concat(list(rows)).sort_values("packet_ord").itertuples():
            lost = r.events_discarded - (before[1] if before else 0)
            if lost:
                found.append((key[0], r.packet_ord, "DE", before[2] if before else r.ts_begin, r.ts_end, lost if before else None))
            if before and r.packet_seq_num - before[0] > 1:
                found.append((key[0], r.packet_ord, "DP", before[2], r.ts_begin, r.packet_seq_num - before[0] - 1))
            before = (int(r.packet_seq_num), int(r.events_discarded), int(r.ts_end))
        if before:
            self.last.update(before)
        yield pd.DataFrame(found, columns=["stream_id", "packet_ord", "msg_type", "begin_ns", "end_ns", "disc_count"])

    def close(self) -> None:
        pass


def streaming_losses(packets: DataFrame) -> DataFrame:
    """packets: a stream of (stream_id, packet_ord, ts_begin, ts_end, packet_seq_num, events_discarded)."""
    return packets.groupBy("stream_id").transformWithStateInPandas(LossDetector(), "stream_id long, packet_ord long, msg_type string, begin_ns long, end_ns long, disc_count long", "append", "none")


def trimmed_stream(df: DataFrame, begin: int | None, end: int | None) -> DataFrame:
    """Events of a stream within a range; beginnings and ends are made where the stream is consumed, as the cut is positional."""
    out = df
    if begin is not None:
        out = out.where(F.col("ts_ns") >= begin)
    return out if end is None else out.where(F.col("ts_ns") <= end)
