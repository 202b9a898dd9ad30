"""Kernel-ring-buffer text: one event for each line that isn't blank.

A line may begin with ``[seconds.microseconds] `` or ``[Y-M-D h:m:s.milliseconds] `` (UTC). The digits after the point are a
number of their unit however many they are ([1.5] is 5 microseconds), unless ``scaled``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import messages

SINCE_BOOT = r"^\[\s*(\d+)\.\s*(\d+)\]"
WALL = r"^\[(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d+)\.(\d+)\]"


def parse_line(line: Column, extract: bool = True, scaled: bool = False) -> tuple[Column, Column]:
    """(ts_ns or null, text) of a line."""
    if not extract:
        return F.lit(None).cast("long"), line
    part = lambda p, i: F.regexp_extract(line, p, i)
    digits = part(SINCE_BOOT, 2)
    micros = F.rpad(F.substring(digits, 1, 6), 6, "0") if scaled else digits
    boot = (part(SINCE_BOOT, 1).try_cast("long") * 1_000_000 + micros.try_cast("long")) * 1000
    d = [part(WALL, i).try_cast("int") for i in range(1, 8)]
    # days past the 28th are counted on from the first, as a calendar that rolls over does
    first = F.datediff(F.make_date(F.when(line.rlike(WALL) & d[1].between(1, 12), d[0]), d[1], F.lit(1)), F.lit("1970-01-01").cast("date"))
    wall = ((first + d[2] - 1).cast("long") * 86_400 + d[3] * 3600 + d[4] * 60 + d[5]) * F.lit(1_000_000_000) + d[6].cast("long") * 1_000_000
    ts = F.when(line.rlike(SINCE_BOOT), boot).when(line.rlike(WALL), wall)
    text = F.when(ts.isNotNull(), F.regexp_replace(line, r"^[^\]]*\] ?", "")).otherwise(line)
    return ts, text


def line_messages(lines: DataFrame, extract: bool = True, scaled: bool = False, trace_name: str = "dmesg") -> DataFrame:
    """lines: (line string, n long: the order). Returns SB, an EV for each line that isn't blank, SE."""
    ts, text = parse_line(F.col("line"), extract, scaled)
    rows = lines.where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    fixed = [F.lit(0).alias("port_ord"), F.lit(trace_name).alias("trace_name"), F.lit(0).cast("long").alias("stream_class_id"), F.lit(0).cast("long").alias("stream_id")]
    events = rows.select(*fixed, F.col("n").alias("src_seq"), F.lit("EV").alias("msg_type"), ts.alias("ts_ns"), F.lit(0).cast("long").alias("event_class_id"), F.lit("string").alias("event_class_name"), F.to_json(F.struct(text.alias("str"))).alias("payload"))
    ends = lines.agg(F.coalesce(F.min("n"), F.lit(0)).alias("a"), F.coalesce(F.max("n"), F.lit(0)).alias("b"))
    ends = ends.select(*fixed, F.explode(F.array(F.struct(F.lit("SB").alias("m"), (F.col("a") - 1).alias("q")), F.struct(F.lit("SE").alias("m"), (F.col("b") + 1).alias("q")))).alias("r"))
    return messages(events).unionByName(messages(ends.select("port_ord", "trace_name", "stream_class_id", "stream_id", F.col("r.m").alias("msg_type"), F.col("r.q").cast("long").alias("src_seq"))))


def read_text_log(spark: SparkSession, path: str, extract: bool = True, scaled: bool = False) -> DataFrame:
    """A text file as a message table. The order of lines is that of the file: partition by partition, line by line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))
    return line_messages(lines, extract, scaled)
