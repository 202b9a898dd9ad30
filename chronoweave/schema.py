"""The message table: the one DataFrame shape that sources give, operators transform and sinks take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 0
#: Message types in the order of equal times.
RANKS = {"SB": 0, "PB": 1, "EV": 2, "DE": 3, "MI": 4, "PE": 5, "DP": 6, "SE": 7}
#: What each type is called in reports.
TITLES = {
    "EV": "Event",
    "SB": "Stream beginning",
    "SE": "Stream end",
    "PB": "Packet beginning",
    "PE": "Packet end",
    "DE": "Discarded event",
    "DP": "Discarded packet",
    "MI": "Message iterator inactivity",
}
#: Names of log levels 0 to 14.
LOG_LEVELS = ["EMERG", "ALERT", "CRIT", "ERR", "WARNING", "NOTICE", "INFO", "DEBUG_SYSTEM", "DEBUG_PROGRAM", "DEBUG_PROCESS", "DEBUG_MODULE", "DEBUG_UNIT", "DEBUG_FUNCTION", "DEBUG_LINE", "DEBUG"]
COLUMNS = {
    "port_ord": "int",
    "src_seq": "long",
    "trace_uuid": "string",
    "trace_name": "string",
    "stream_class_id": "long",
    "stream_class_name": "string",
    "stream_id": "long",
    "stream_name": "string",
    "msg_type": "string",
    "cycles": "decimal(20,0)",
    "ts_ns": "long",
    "end_ts_ns": "long",
    "disc_count": "decimal(20,0)",
    "packet_ord": "long",
    "event_class_id": "long",
    "event_class_name": "string",
    "log_level": "int",
    "emf_uri": "string",
    "packet_context": "string",
    "common_context": "string",
    "specific_context": "string",
    "payload": "string",
}
STREAM = ["trace_uuid", "trace_name", "stream_class_id", "stream_id"]


def ddl(*more: str) -> str:
    return ", ".join([f"{c} {t}" for c, t in COLUMNS.items()] + list(more))


def type_rank(msg_type: str | Column = "msg_type") -> Column:
    col = F.col(msg_type) if isinstance(msg_type, str) else msg_type
    out = F.lit(None).cast("int")
    for name, rank in RANKS.items():
        out = F.when(col == name, rank).otherwise(out)
    return out


def messages(df: DataFrame) -> DataFrame:
    """df with all columns of the message table, those that it lacks null; other columns of df stay."""
    have = set(df.columns)
    fixed = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]
    return df.select(*fixed, *(c for c in df.columns if c not in COLUMNS))


def identity(prefix: str = "") -> list[Column]:
    """What equal times are ordered by before the message type: absent UUIDs and names come last."""
    return [F.col(f"{prefix}trace_uuid").asc_nulls_last(), F.col(f"{prefix}trace_name").asc_nulls_last(), F.col(f"{prefix}stream_class_id").asc_nulls_last(), F.col(f"{prefix}stream_id").asc_nulls_last()]
