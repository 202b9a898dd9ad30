"""Pipelines in one call: sources found by themselves, merged, trimmed, filtered, and given as one message table."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mux import mux
from ..operators.packets import intersections
from ..operators.trim import trim, trim_ns
from ..schema import messages
from . import graph


@dataclass
class Source:
    """A source component class and its parameters."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)


def discover(spark: SparkSession, inputs: list[str]) -> list[Source]:
    """For each input, the source that is surest of it; folders that none wants are searched. Inputs of one group are one source.

    The first of equally sure sources wins. Strings that are no path are offered as they are.
    """
    found: list[tuple[str, str | None, str]] = []

    def ask(value: str, kind: str) -> tuple[float, str | None, str] | None:
        best = None
        for (k, name), cls in graph.REGISTRY.items():
            if k != "source" or "support-info" not in cls.queries:
                continue
            got = cls.queries["support-info"](spark, {"input": value, "type": kind})
            if got["weight"] > 0 and (best is None or got["weight"] > best[0]):
                best = (got["weight"], got.get("group"), name)
        return best

    def visit(value: str) -> bool:
        kind = "directory" if os.path.isdir(value) else "file" if os.path.isfile(value) else "string"
        got = (ask(value, "string") if kind != "string" else None) or ask(value, kind)
        if got:
            found.append((got[2], got[1], value))
            return True
        if kind == "directory":
            return any([visit(os.path.join(value, n)) for n in sorted(os.listdir(value)) if os.path.isdir(os.path.join(value, n))])
        return False

    for value in inputs:
        if not visit(value):
            raise graph.GraphError(f"no source reads {value!r}")
    groups: dict[tuple, list[str]] = {}
    for k, (name, group, value) in enumerate(found):
        groups.setdefault((name, group) if group else (name, None, k), []).append(value)
    return [Source(key[0], {"inputs": values}) for key, values in groups.items()]


class TraceCollection:
    """inputs: paths to be discovered; sources: named ones. begin, end: bounds as text or seconds."""

    def __init__(self, spark: SparkSession, inputs: list[str] | None = None, sources: list[Source] | None = None, filters: list[tuple[str, dict]] | None = None, intersection: bool = False, begin=None, end=None, frames: list[DataFrame] | None = None):
        self.spark = spark
        self.sources = [*(sources or []), *(discover(spark, inputs) if inputs else [])]
        self.filters, self.intersection, self.begin, self.end = filters or [], intersection, begin, end
        self.given = frames or []

    def _frames(self) -> list[DataFrame]:
        made = []
        for s in self.sources:
            cls = graph.find("source", s.name)
            made.append(cls.run(self.spark, graph.check(s.params, cls.spec, s.name)))
        return [messages(f) for f in [*made, *self.given]]

    def messages(self) -> DataFrame:
        """The merged, trimmed and filtered message table, with ``pos``. An intersection is taken before the merge."""
        frames = self._frames()
        if not frames:
            raise graph.GraphError("nothing to read")
        if self.intersection:
            frames = [intersected(f) for f in frames]
        df = graph.find("filter", "utils.muxer").run(frames, {})
        if self.begin is not None or self.end is not None:
            df = trim(df, self.begin, self.end)
        for name, params in self.filters:
            cls = graph.find("filter", name)
            df = cls.run(df, graph.check(params, cls.spec, name))
        return df

    def events(self) -> DataFrame:
        return self.messages().where("msg_type = 'EV'")


def intersected(df: DataFrame) -> DataFrame:
    """Each trace trimmed to the common range of its streams."""
    timed = df.where("msg_type in ('PB', 'PE', 'EV')")
    ranges = timed.groupBy("trace_uuid", "trace_name", "stream_class_id", "stream_id").agg(F.min("ts_ns").alias("begin_ns"), F.max("ts_ns").alias("end_ns"))
    common = intersections(ranges, ["trace_uuid", "trace_name"]).collect()  # one row for each trace
    if not common:
        raise graph.GraphError("trace without streams")
    out = None
    for r in common:
        if r["error"]:
            raise graph.GraphError(r["error"])
        own = df.where(F.col("trace_uuid").eqNullSafe(F.lit(r["trace_uuid"])) & F.col("trace_name").eqNullSafe(F.lit(r["trace_name"])))
        cut = trim_ns(mux(own), r["begin_ns"], r["end_ns"])
        cut = cut.withColumn("src_seq", F.col("pos")).drop("pos")
        out = cut if out is None else out.unionByName(cut, allowMissingColumns=True)
    return out


def convert(spark: SparkSession, inputs: list[str], sink: str = "text.pretty", sink_params: dict | None = None, begin=None, end=None, intersection: bool = False, debug_info: bool = False) -> Any:
    """inputs, merged and trimmed, to a sink."""
    filters = [("utils.debug-info", {})] if debug_info else []
    df = TraceCollection(spark, inputs, filters=filters, intersection=intersection, begin=begin, end=end).messages()
    cls = graph.find("sink", sink)
    return cls.run(df, graph.check(sink_params or {}, cls.spec, sink))


def split_timerange(text: str) -> tuple[str, str]:
    """``begin,end`` or ``[begin,end]``"""
    body = text.strip().removeprefix("[").removesuffix("]")
    parts = [p.strip() for p in body.split(",")]
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"not a time range: {text!r}")
    return parts[0], parts[1]
