"""A deterministic dump: one compact line for each message, or blocks with metadata the first time it is seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TITLES, messages


def grouped(x: Column) -> Column:
    """An integer with commas between groups of three digits."""
    s = F.abs(x.cast("decimal(38,0)")).cast("string")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(s, r"(?<=\d)(?=(\d{3})+$)", ","))


def title() -> Column:
    out = F.lit(None).cast("string")
    for k, v in {**TITLES, "DE": "Discarded events", "DP": "Discarded packets"}.items():
        out = F.when(F.col("msg_type") == k, v).otherwise(out)
    return out


def trace_numbers(df: DataFrame, order: str = "pos") -> DataFrame:
    """Traces numbered from 0 by where they are first seen. One row for each trace."""
    first = df.where("msg_type <> 'MI'").groupBy("trace_uuid", "trace_name").agg(F.min(order).alias("_first"))
    return first.withColumn("trace_no", F.dense_rank().over(Window.orderBy("_first")) - 1).drop("_first")


def _time(begin: Column, cycles: Column, compact: bool) -> Column:
    a, b, c = ("[", " ", "]") if compact else ("[", " cycles, ", " ns from origin]")
    return F.when(begin.isNull(), F.lit("[Unknown]")).otherwise(F.concat(F.lit(a), grouped(F.coalesce(cycles, begin.cast("decimal(20,0)"))), F.lit(b), grouped(begin), F.lit(c)))


def details_lines(df: DataFrame, order: str = "pos", with_time: bool = True, with_data: bool = True, compact: bool = True) -> DataFrame:
    """(pos, line) for each message: ``[cycles ns] {trace class stream} Title ...``"""
    df = messages(df)
    numbers = trace_numbers(df, order)
    same = df["trace_uuid"].eqNullSafe(numbers["trace_uuid"]) & df["trace_name"].eqNullSafe(numbers["trace_name"])
    rows = df.join(numbers, same, "left").drop(numbers["trace_uuid"]).drop(numbers["trace_name"])
    tag = F.when(F.col("msg_type") == "MI", F.lit("")).otherwise(F.concat(F.lit("{"), F.concat_ws(" ", F.col("trace_no").cast("string"), F.col("stream_class_id").cast("string"), F.col("stream_id").cast("string")), F.lit("} ")))
    span = F.when(F.col("msg_type").isin("DE", "DP"), F.concat(F.lit(" - "), _time(F.col("end_ts_ns"), F.col("end_ts_ns").cast("decimal(20,0)"), compact))).otherwise(F.lit(""))
    time = F.concat(_time(F.col("ts_ns"), F.col("cycles"), compact), span, F.lit(" ")) if with_time else F.lit("")
    event = F.concat(F.lit(" `"), F.coalesce("event_class_name", F.lit("")), F.lit("` ("), F.coalesce(F.col("event_class_id").cast("string"), F.lit("?")), F.lit(")"))
    count = F.concat(F.lit(" ("), F.coalesce(grouped(F.col("disc_count")), F.lit("Unknown")), F.lit(")"))
    body = F.concat(title(), F.when(F.col("msg_type") == "EV", event).when(F.col("msg_type").isin("DE", "DP"), count).otherwise(F.lit("")))
    data = F.lit("")
    if with_data and not compact:
        scopes = [F.concat(F.lit(f"\n  {name}: "), F.col(c)) for name, c in (("Packet context", "packet_context"), ("Common context", "common_context"), ("Specific context", "specific_context"), ("Payload", "payload"))]
        data = F.concat(*(F.coalesce(s, F.lit("")) for s in scopes))
    return rows.select(order, F.concat(time, tag, body, data).alias("line"))


def metadata_blocks(df: DataFrame, order: str = "pos", trace_names: bool = True, uuids: bool = True, stream_class_names: bool = True, stream_names: bool = True) -> DataFrame:
    """(trace_no, first, block): of each trace its streams and event classes in ID order, as printed before its first message."""
    df = messages(df)
    numbers = trace_numbers(df, order)
    traces = ["trace_uuid", "trace_name"]
    rows = df.where("msg_type <> 'MI'")
    # each stream, stream class and event class once before they are gathered into their trace
    streams = rows.groupBy(*traces, "stream_class_id", "stream_id").agg(F.max("stream_name").alias("name"))
    classes = rows.groupBy(*traces, "stream_class_id").agg(F.max("stream_class_name").alias("name"))
    events = rows.where("msg_type = 'EV'").groupBy(*traces, "stream_class_id", "event_class_id").agg(F.max("event_class_name").alias("name"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    quoted = lambda shown: F.when(F.col("name").isNotNull(), F.concat(F.lit(" `"), F.col("name"), F.lit("`"))).otherwise(F.lit("")) if shown else F.lit("")
    lines = streams.select(*traces, F.lit(1).alias("k"), "stream_class_id", F.col("stream_id").alias("id"), F.concat(F.lit("  Stream"), quoted(stream_names), F.lit(" "), text(F.col("stream_id")), F.lit(" (class "), text(F.col("stream_class_id")), F.lit(")")).alias("line"))
    if stream_class_names:
        lines = lines.unionByName(classes.where("name is not null").select(*traces, F.lit(0).alias("k"), "stream_class_id", F.lit(None).cast("long").alias("id"), F.concat(F.lit("  Stream class"), quoted(True), F.lit(" "), text(F.col("stream_class_id"))).alias("line")))
    lines = lines.unionByName(events.select(*traces, F.lit(2).alias("k"), "stream_class_id", F.col("event_class_id").alias("id"), F.concat(F.lit("  Event class `"), F.coalesce("name", F.lit("?")), F.lit("` (stream class "), text(F.col("stream_class_id")), F.lit(", ID "), text(F.col("event_class_id")), F.lit(")")).alias("line")))
    of = lines.groupBy(*traces).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "stream_class_id", "id", "line"))), lambda x: x["line"]).alias("lines"))
    first = rows.groupBy(*traces).agg(F.min(order).alias("first"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("trace_uuid", "_u").withColumnRenamed("trace_name", "_n")
        return left.join(right, F.col("trace_uuid").eqNullSafe(F.col("_u")) & F.col("trace_name").eqNullSafe(F.col("_n"))).drop("_u", "_n")

    both = beside(beside(of, numbers), first)
    head = F.concat(F.lit("Trace "), F.col("trace_no").cast("string"), F.lit(": `"), F.coalesce("trace_name", F.lit("(no name)")), F.lit("`")) if trace_names else F.concat(F.lit("Trace "), F.col("trace_no").cast("string"))
    head = F.concat(head, F.when(F.col("trace_uuid").isNotNull(), F.concat(F.lit(", UUID "), F.col("trace_uuid"))).otherwise(F.lit(""))) if uuids else head
    return both.select("trace_no", "first", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("block"))


def details_text(df: DataFrame, order: str = "pos", with_metadata: bool = True, **shown: bool) -> DataFrame:
    """details_lines, with each trace's metadata before its first message. shown: with_time, with_data, compact, and the switches of metadata_blocks."""
    own = {k: shown.pop(k) for k in ("with_time", "with_data", "compact") if k in shown}
    lines = details_lines(df, order, **own)
    if not with_metadata:
        return lines
    blocks = metadata_blocks(df, order, **shown).select(F.col("first").alias(order), "block")  # one row for each trace
    return lines.join(blocks, order, "left").select(order, F.concat_ws("\n", "block", "line").alias("line"))
