"""Component classes and graphs of them. Building a graph builds a plan; running it runs the sinks' actions."""

from __future__ import annotations

import fnmatch
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.enrich import with_debug_info
from ..operators.mux import mux
from ..operators.trim import trim
from ..schema import SCHEMA_VERSION
from ..sinks import count, details, pretty
from ..sinks.ctf_writer import write_ctf
from ..sources import textlog
from ..sources.ctf import reader
from .params import check


class GraphError(RuntimeError):
    """What is wrong with a graph; causes are chained."""


@dataclass
class ComponentClass:
    """kind: source (spark, params -> DataFrame), filter (DataFrame or list of them, params -> DataFrame) or sink (DataFrame, params -> result)."""

    kind: str
    name: str
    run: Callable[..., Any]
    spec: dict[str, tuple] = field(default_factory=dict)
    queries: dict[str, Callable[..., Any]] = field(default_factory=dict)
    help: str = ""
    many: bool = False


REGISTRY: dict[tuple[str, str], ComponentClass] = {}


def register(cls: ComponentClass) -> ComponentClass:
    if cls.kind not in ("source", "filter", "sink"):
        raise GraphError(f"unknown kind of component {cls.kind!r}")
    REGISTRY[cls.kind, cls.name] = cls
    return cls


def component(kind: str, name: str, spec: dict[str, tuple] | None = None, **more) -> Callable:
    """Decorator: a function becomes a component class."""
    return lambda f: register(ComponentClass(kind, name, f, spec or {}, help=(f.__doc__ or "").strip(), **more)).run


def find(kind: str, name: str) -> ComponentClass:
    try:
        return REGISTRY[kind, name]
    except KeyError:
        raise GraphError(f"no component class {kind}.{name}") from None


def greatest_version(*offered: int) -> int:
    if offered and SCHEMA_VERSION not in offered:
        raise GraphError(f"only version {SCHEMA_VERSION} is known")
    return SCHEMA_VERSION


_TEXT, _FLAG, _INT = (str,), (bool,), (int,)
_BOUND = ((str, int), None, None)


def _weight(path: str) -> dict[str, Any]:
    """How sure the trace source is that it reads a folder."""
    meta = os.path.join(path, "metadata")
    if not os.path.isfile(meta):
        return {"weight": 0.0}
    try:
        with open(meta, "rb") as f:
            trace = reader.parse_metadata(f.read())
    except ValueError:
        return {"weight": 0.0}
    return {"weight": 0.75, "group": trace.uuid} if trace.uuid else {"weight": 0.75}


def _metadata_info(spark: SparkSession, params: dict) -> dict[str, Any]:
    row = spark.read.format("binaryFile").load(f"{params['path']}/metadata").select("content").first()
    raw = bytes(row["content"])
    from ..sources.ctf.tsdl import plain_metadata

    text = plain_metadata(raw)
    return {"text": text, "is-packetized": raw != text.encode()}


@component("source", "ctf.fs", {"inputs": (list, ..., None), "trace-name": (_TEXT, None, None), "clock-class-offset-s": (_INT, 0, None), "clock-class-offset-ns": (_INT, 0, None), "force-clock-class-origin-unix-epoch": (_FLAG, False, None)})
def ctf_source(spark: SparkSession, p: dict) -> DataFrame:
    """Reads the directories of a trace."""
    return reader.read_ctf(spark, list(p["inputs"]), p["trace-name"], p["clock-class-offset-s"], p["clock-class-offset-ns"], p["force-clock-class-origin-unix-epoch"])


find("source", "ctf.fs").queries = {
    "support-info": lambda spark, p: _weight(p["input"]) if p.get("type") == "directory" else {"weight": 0.0},
    "trace-infos": lambda spark, p: [{"port-name": r["port"], "range-ns": None if r["begin_ns"] is None or r["end_ns"] is None else {"begin": r["begin_ns"], "end": r["end_ns"]}} for path in p["inputs"] for r in reader.trace_infos(spark, path).collect()],
    "metadata-info": _metadata_info,
}


@component("source", "text.dmesg", {"path": (_TEXT, ..., None), "no-extract-timestamp": (_FLAG, False, None)})
def dmesg_source(spark: SparkSession, p: dict) -> DataFrame:
    """Reads a kernel ring buffer as text."""
    return textlog.read_text_log(spark, p["path"], extract=not p["no-extract-timestamp"])


@component("filter", "utils.muxer", many=True)
def muxer_filter(frames: list[DataFrame], p: dict) -> DataFrame:
    """Merges its inputs by time. A port of an input stays a port; ports of different inputs don't mix."""
    from pyspark.sql import functions as F

    out = None
    for k, f in enumerate(frames):
        own = f.withColumn("port_ord", (F.coalesce(F.col("port_ord"), F.lit(0)) % 100_000_000 + k * 100_000_000).cast("int")) if len(frames) > 1 else f
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return mux(out.drop("pos"), shared_identity=True)


@component("filter", "utils.trimmer", {"begin": _BOUND, "end": _BOUND, "gmt": (_FLAG, False, None)})
def trimmer_filter(df: DataFrame, p: dict) -> DataFrame:
    """Keeps a time range."""
    zone = "UTC" if p["gmt"] else df.sparkSession.conf.get("spark.sql.session.timeZone")
    return trim(df, p["begin"], p["end"], zone)


@component("filter", "utils.debug-info", {"debug-info-field-name": (_TEXT, "debug_info", None), "debug-info-dir": (_TEXT, None, None), "target-prefix": (_TEXT, "", None), "full-path": (_FLAG, False, None)})
def debug_info_filter(df: DataFrame, p: dict) -> DataFrame:
    """Adds which binary, and where in it, an event's address lies in."""
    if p["debug-info-dir"]:
        raise GraphError("debug files aren't read: debug-info-dir isn't supported")
    return with_debug_info(df, field=p["debug-info-field-name"], full_path=p["full-path"], target_prefix=p["target-prefix"])


@component("sink", "utils.counter", {"step": (_INT, count.DEFAULT_STEP, None), "hide-zero": (_FLAG, False, None)})
def counter_sink(df: DataFrame, p: dict) -> str:
    """Counts messages."""
    return count.report(count.count_messages(df), p["hide-zero"])


@component("sink", "utils.dummy")
def dummy_sink(df: DataFrame, p: dict) -> None:
    """Reads all and writes nothing."""
    count.consume(df)


_NAME = (_TEXT, None, ("show", "hide"))
_PRETTY = {"color": (_TEXT, "auto", ("never", "auto", "always")), "path": (_TEXT, None, None)} | {k: (_FLAG, False, None) for k in ("no-delta", "clock-cycles", "clock-seconds", "clock-date", "clock-gmt", "verbose", "print-enum-flags")}
_PRETTY |= {"name-default": _NAME, "field-default": _NAME} | {f"name-{k}": (_FLAG, None, None) for k in pretty.NAMES} | {f"field-{k}": (_FLAG, None, None) for k in pretty.FIELDS}


def _uncoloured(p: dict) -> None:
    if p["color"] == "always":
        raise GraphError("text is written without colours")


@component("sink", "text.pretty", _PRETTY)
def pretty_sink(df: DataFrame, p: dict) -> DataFrame | None:
    """A line for each event, written as text if there is a path; losses are warned of on standard error. Times are UTC."""
    _uncoloured(p)
    if p["print-enum-flags"]:
        raise GraphError("flags of enumerations aren't told apart in a message table: print-enum-flags isn't supported")
    for r in pretty.loss_warning(df).orderBy("pos").select("warning").toLocalIterator():
        print(r["warning"], file=sys.stderr)
    lines = pretty.pretty_lines(df, {k: v for k, v in p.items() if v is not None})
    if p["path"]:
        lines.repartitionByRange("pos").sortWithinPartitions("pos").select("line").write.text(p["path"])
        return None
    return lines


@component("sink", "text.details", {"color": (_TEXT, "auto", ("never", "auto", "always")), "compact": (_FLAG, False, None)} | {k: (_FLAG, True, None) for k in ("with-metadata", "with-data", "with-time", "with-trace-name", "with-stream-class-name", "with-stream-name", "with-uuid")})
def details_sink(df: DataFrame, p: dict) -> DataFrame:
    """A dump of every message."""
    _uncoloured(p)
    return details.details_text(df, with_metadata=p["with-metadata"], with_time=p["with-time"], with_data=p["with-data"], compact=p["compact"], trace_names=p["with-trace-name"], uuids=p["with-uuid"], stream_class_names=p["with-stream-class-name"], stream_names=p["with-stream-name"])


@component("sink", "ctf.fs", {"path": (_TEXT, ..., None)} | {k: (_FLAG, False, None) for k in ("assume-single-trace", "ignore-discarded-events", "ignore-discarded-packets", "quiet")})
def ctf_sink(df: DataFrame, p: dict) -> None:
    """Writes a trace, or a folder for each trace."""
    names = [r[0] for r in df.select("trace_name").where("trace_name is not null").distinct().collect()]  # one row for each trace
    for name in [None] if p["assume-single-trace"] or len(names) < 2 else names:
        own = df if name is None else df.where(df["trace_name"] == name)
        write_ctf(own, p["path"] if name is None else os.path.join(p["path"], name.replace("/", "_")), ignore_discarded_events=p["ignore-discarded-events"], ignore_discarded_packets=p["ignore-discarded-packets"])


class Graph:
    """Components and connections between them; a component has one output and any number of inputs if it is a muxer."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.components: dict[str, tuple[ComponentClass, dict]] = {}
        self.edges: list[tuple[str, str]] = []

    def add(self, name: str, kind: str, cls: str | ComponentClass, params: dict | None = None) -> Graph:
        if name in self.components:
            raise GraphError(f"component {name!r} twice")
        own = find(kind, cls) if isinstance(cls, str) else cls
        try:
            self.components[name] = (own, check(params or {}, own.spec, f"{own.kind}.{own.name}") if own.spec or params else {})
        except ValueError as e:
            raise GraphError(f"component {name!r} can't be made") from e
        return self

    def connect(self, up: str, down: str) -> Graph:
        """Names may be patterns; every pair of components that match is connected."""
        ups = [n for n in self.components if fnmatch.fnmatchcase(n, up)]
        downs = [n for n in self.components if fnmatch.fnmatchcase(n, down)]
        if not ups or not downs:
            raise GraphError(f"nothing to connect: {up!r} to {down!r}")
        for u in ups:
            for d in downs:
                if self.components[u][0].kind == "sink" or self.components[d][0].kind == "source":
                    raise GraphError(f"{u!r} can't be upstream of {d!r}")
                if (u, d) in self.edges:
                    raise GraphError(f"{u!r} and {d!r} are connected")
                if not self.components[d][0].many and any(x == d for _, x in self.edges):
                    raise GraphError(f"{d!r} has one input only")
                self.edges.append((u, d))
        return self

    def _frame(self, name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in path:
            raise GraphError("cycle: " + " > ".join([*path, name]))
        cls, params = self.components[name]
        if cls.kind == "source":
            return cls.run(self.spark, params)
        ups = [self._frame(u, (*path, name)) for u, d in self.edges if d == name]
        if not ups:
            raise GraphError(f"{name!r} has no input")
        return cls.run(ups if cls.many else ups[0], params)

    def frame(self, name: str) -> DataFrame:
        """What a source or a filter gives."""
        return self._frame(name)

    def run(self, tag: str | None = None) -> dict[str, Any]:
        """Runs all sinks; returns what each gives. Its jobs carry the tag, by which ``interrupt`` stops them."""
        if tag:
            self.spark.addTag(tag)
        sinks = [n for n, (c, _) in self.components.items() if c.kind == "sink"]
        if not sinks:
            raise GraphError("no sink")
        return {n: self._frame(n) for n in sinks}


def interrupt(spark: SparkSession, tag: str) -> None:
    """Stops the jobs of graphs that run under a tag."""
    spark.interruptTag(tag)


def load_plugins(folders: list[str]) -> list[str]:
    """Imports the Python files named ``chronoweave_plugin_*.py`` in folders and below; each registers its component classes."""
    import importlib.util

    loaded = []
    for folder in folders:
        for at, _, names in sorted(os.walk(folder)):
            for name in sorted(fnmatch.filter(names, "chronoweave_plugin_*.py")):
                spec = importlib.util.spec_from_file_location(name[:-3], os.path.join(at, name))
                module = importlib.util.module_from_spec(spec)
                try:
                    spec.loader.exec_module(module)
                except Exception as e:
                    raise GraphError(f"plugin {os.path.join(at, name)!r} can't be loaded") from e
                loaded.append(name[:-3])
    return loaded


def run_query(spark: SparkSession, kind: str, cls: str, name: str, params: dict | None = None) -> Any:
    """Asks a component class; no graph is run."""
    own = find(kind, cls)
    if name not in own.queries:
        raise GraphError(f"{kind}.{cls} doesn't know the query {name!r}")
    return own.queries[name](spark, params or {})


def list_components() -> list[tuple[str, str, str]]:
    return [(c.kind, c.name, c.help) for c in REGISTRY.values()]
