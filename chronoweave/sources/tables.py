"""Message tables from the driver's tables.

``events`` is a trace of four streams (user_id % 4) whose packets are UTC days; ``orders`` and ``lineitem`` are traces of one
stream of events each. Times are UTC. A range that is known beforehand is given to the reader as a filter on the raw
column, widened to its unit, so Parquet can skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import whole
from ..schema import messages

DAY_NS = 86_400 * 1_000_000_000
STREAMS = 4
EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


def ns_of(ts: str) -> Column:
    """Nanoseconds from 1970 (UTC) of a column of timestamps without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") * F.lit(1000)


def between_ns(df: DataFrame, ts: str, begin: int | None, end: int | None) -> DataFrame:
    """df within a range, as a filter that reaches the scan."""
    raw = lambda ns, up: F.lit(_ntz(-(-ns // 1000) if up else ns // 1000)).cast("timestamp_ntz")
    if begin is not None:
        df = df.where(F.col(ts) >= raw(begin, True))
    return df if end is None else df.where(F.col(ts) <= raw(end, False))


def _ntz(micros: int) -> str:
    from datetime import datetime, timedelta

    return str(datetime(1970, 1, 1) + timedelta(microseconds=micros))


def _class_id(name: str) -> Column:
    return F.array_position(F.array(*map(F.lit, EVENT_CLASSES)), F.col(name)) - 1


def event_rows(spark: SparkSession, sf_dir: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """The EV rows of the trace ``events``."""
    raw = between_ns(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", begin, end)
    stream = (F.col("user_id") % STREAMS).cast("long")
    rows = raw.select(
        stream.cast("int").alias("port_ord"), (F.col("event_id") * 8 + 4).alias("src_seq"), F.lit("events").alias("trace_name"), F.lit(0).cast("long").alias("stream_class_id"), stream.alias("stream_id"), F.lit("EV").alias("msg_type"), ns_of("ts").alias("ts_ns"),
        whole(ns_of("ts"), DAY_NS).alias("packet_ord"), _class_id("event_type").alias("event_class_id"), F.col("event_type").alias("event_class_name"), "event_id", "user_id", "value", "props",
    )
    return messages(rows)


def bounds_of(rows: DataFrame) -> DataFrame:
    """SB, PB, PE and SE of event rows: at the first and the last event of each stream and packet."""
    of = rows.groupBy("port_ord", "trace_name", "stream_class_id", "stream_id", "packet_ord").agg(F.min("ts_ns").alias("b"), F.max("ts_ns").alias("e"), F.min("src_seq").alias("f"), F.max("src_seq").alias("l"))
    kind = lambda m, t, q, k: F.struct(F.lit(m).alias("m"), t.alias("t"), (q + k).alias("q"))
    packets = of.withColumn("r", F.explode(F.array(kind("PB", F.col("b"), F.col("f"), -2), kind("PE", F.col("e"), F.col("l"), 1))))
    streams = of.groupBy("port_ord", "trace_name", "stream_class_id", "stream_id").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.min("f").alias("f"), F.max("l").alias("l"))
    streams = streams.withColumn("packet_ord", F.lit(None).cast("long")).withColumn("r", F.explode(F.array(kind("SB", F.col("b"), F.col("f"), -4), kind("SE", F.col("e"), F.col("l"), 3))))
    both = packets.unionByName(streams)
    return messages(both.select("port_ord", "trace_name", "stream_class_id", "stream_id", "packet_ord", F.col("r.m").alias("msg_type"), F.col("r.t").alias("ts_ns"), F.col("r.q").alias("src_seq")))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole trace ``events``, with its streams' and packets' bounds."""
    rows = event_rows(spark, sf_dir)
    return rows.unionByName(bounds_of(rows), allowMissingColumns=True)


def order_rows(spark: SparkSession, sf_dir: str, port: int = 100) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return messages(raw.select(F.lit(port).alias("port_ord"), F.col("o_orderkey").alias("src_seq"), F.lit("orders").alias("trace_name"), F.lit(0).cast("long").alias("stream_class_id"), F.lit(0).cast("long").alias("stream_id"), F.lit("EV").alias("msg_type"), ns_of("o_orderdate").alias("ts_ns")))


def lineitem_rows(spark: SparkSession, sf_dir: str, port: int = 101) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return messages(raw.select(F.lit(port).alias("port_ord"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("src_seq"), F.lit("lineitem").alias("trace_name"), F.lit(0).cast("long").alias("stream_class_id"), F.lit(0).cast("long").alias("stream_id"), F.lit("EV").alias("msg_type"), ns_of("l_shipdate").alias("ts_ns")))
