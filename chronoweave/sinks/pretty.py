"""Lines of text for events, and warnings for losses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import escaped
from ..functions.times import clock_text, delta_text
from ..operators.position import Ordered
from ..schema import LOG_LEVELS

#: What is shown of fields and names if nothing is said.
FIELDS = {"trace": False, "hostname": True, "domain": False, "procname": True, "vpid": True, "loglevel": False, "emf": False, "callsite": False}
NAMES = {"payload": True, "context": True, "header": False, "scope": False}


@dataclass
class Options:
    delta: bool = True
    cycles: bool = False
    seconds: bool = False
    date: bool = False
    verbose: bool = False
    fields: dict[str, bool] = field(default_factory=lambda: dict(FIELDS))
    names: dict[str, bool] = field(default_factory=lambda: dict(NAMES))


def options(params: dict | None = None) -> Options:
    """From a sink's parameters: no-delta, clock-*, verbose, field-* and name-* with their defaults."""
    p = dict(params or {})
    out = Options(delta=not p.get("no-delta"), cycles=bool(p.get("clock-cycles")), seconds=bool(p.get("clock-seconds")), date=bool(p.get("clock-date")), verbose=bool(p.get("verbose")))
    for kind, own in (("field", out.fields), ("name", out.names)):
        default = p.get(f"{kind}-default")
        if default in ("show", "hide"):
            own.update(dict.fromkeys(own, default == "show"))
        for k in own:
            if f"{kind}-{k}" in p:
                own[k] = bool(p[f"{kind}-{k}"])
    return out


#: Levels of objects and arrays that are rendered; what lies deeper is printed as JSON.
DEPTH = 3


def _value(raw: Column, kind: Column, names: bool, depth: int) -> Column:
    """A member from its text and its variant's type. Absent options are ``<none>``."""
    text = F.when(raw.rlike(r'[\x00-\x1F\x7F"\\]'), escaped(raw)).otherwise(F.concat(F.lit('"'), raw, F.lit('"')))
    out = F.when(kind.isNull() | (kind == "VOID"), F.lit("<none>")).when(kind == "STRING", text)
    if depth:
        out = out.when(kind.startswith("OBJECT"), _object(raw, names, depth - 1)).when(kind.startswith("ARRAY"), _array(raw, names, depth - 1))
    return out.otherwise(raw)


def _braced(begin: str, parts: Column, end: str) -> Column:
    return F.when(F.size(parts) == 0, F.lit(f"{begin} {end}")).otherwise(F.concat(F.lit(f"{begin} "), F.array_join(parts, ", "), F.lit(f" {end}")))


def _object(js: Column, names: bool, depth: int) -> Column:
    raw, kinds = F.from_json(js, "map<string,string>"), F.from_json(js, "map<string,variant>")
    kind_of = F.transform_values(kinds, lambda k, v: F.schema_of_variant(v))
    member = lambda e, ks: F.concat(e["key"], F.lit(" = "), _value(e["value"], F.element_at(ks, e["key"]), names, depth)) if names else _value(e["value"], F.element_at(ks, e["key"]), names, depth)
    return _braced("{", F.get(F.transform(F.array(kind_of), lambda ks: F.transform(F.map_entries(raw), lambda e: member(e, ks))), F.lit(0)), "}")


def _array(js: Column, names: bool, depth: int) -> Column:
    kinds = F.transform(F.from_json(js, "array<variant>"), F.schema_of_variant)
    both = F.arrays_zip(F.from_json(js, "array<string>").alias("raw"), kinds.alias("kind"))
    return _braced("[", F.transform(both, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] = "), _value(x["raw"], x["kind"], names, depth))), "]")


def render_json(js: Column, names: bool = True) -> Column:
    """A JSON object as ``{ a = 1, b = "x", c = { d = 2 }, e = [ [0] = 1, [1] = 2 ] }``; null if there is none."""
    return F.when(js.isNotNull(), _object(js, names, DEPTH))


def level_name(level: Column) -> Column:
    return F.concat(F.lit("TRACE_"), F.get(F.array(*map(F.lit, LOG_LEVELS)), level))


def line(o: Options, previous: Column, payload: Column | None = None, has_env: bool = False) -> Column:
    """The line of an event row; previous: the time of the event before; has_env: there is a column trace_env (JSON)."""
    if o.cycles:
        time = F.coalesce(F.lpad(F.col("cycles").cast("string"), 20, "0"), F.lit("?" * 20))
    else:
        time = clock_text(F.col("ts_ns"), date=o.date, seconds=o.seconds)
    head = F.concat(F.lit("["), time, F.lit("] "), *([F.lit("("), delta_text(F.col("ts_ns") - previous), F.lit(") ")] if o.delta else []))
    shown = []
    # where a trace comes from: host, tracer, program and process, from its environment
    asked = [k for k in ("hostname", "domain", "procname", "vpid") if o.fields[k]] if has_env else []
    origin = []
    for k in asked:
        value = F.get_json_object(F.col("trace_env"), f"$.{k}")
        value = F.concat(F.lit("("), value, F.lit(")")) if k == "vpid" else value
        origin.append(F.concat(F.lit(f"trace:{k} = "), value) if o.names["header"] else value)
    if o.fields["trace"]:
        shown.append(F.when(F.col("trace_name").isNotNull(), F.concat(F.lit("trace = " if o.names["header"] else ""), F.col("trace_name"))))
    if origin:
        shown.append(F.nullif(F.concat_ws(", " if o.names["header"] else ":", *origin), F.lit("")))
    if o.fields["loglevel"]:
        shown.append(F.when(F.col("log_level").isNotNull(), F.concat(F.lit("loglevel = " if o.names["header"] else ""), level_name(F.col("log_level")), F.lit(" ("), F.col("log_level").cast("string"), F.lit(")"))))
    if o.fields["emf"]:
        shown.append(F.concat(F.lit("model.emf.uri = " if o.names["header"] else ""), F.col("emf_uri")))
    info = F.concat_ws(", ", *shown) if shown else F.lit("")
    title = F.concat(F.when(info == "", "").otherwise(F.concat(info, F.lit(", " if o.names["header"] else " "))), F.lit("name = " if o.names["header"] else ""), F.coalesce("event_class_name", F.lit("<unknown>")), F.lit(", " if o.names["header"] else ": "))
    scope = lambda name: f"{name} = " if o.names["scope"] else ""
    parts = [F.concat(F.lit(scope(s)), render_json(F.col(c), o.names[k])) for s, c, k in (("stream.packet.context", "packet_context", "context"), ("stream.event.context", "common_context", "context"), ("event.context", "specific_context", "context"))]
    parts.append(F.concat(F.lit(scope("event.fields")), payload if payload is not None else render_json(F.col("payload"), o.names["payload"])))
    return F.concat(head, title, F.concat_ws(", ", *parts))


def pretty_lines(df: DataFrame, params: dict | None = None, order: str = "pos") -> DataFrame:
    """(pos, line) for each event of a merged message table. The delta is to the event printed before."""
    o = options(params)
    events = df.where("msg_type = 'EV'")
    out = Ordered(events, [F.col(order).asc()], "ts_ns").with_previous("_previous") if o.delta else events.withColumn("_previous", F.lit(None).cast("long"))
    return out.select(order, line(o, F.col("_previous"), has_env="trace_env" in df.columns).alias("line"))


def loss_warning(df: DataFrame) -> DataFrame:
    """A sentence for each DE and DP row."""
    what = F.when(F.col("msg_type") == "DE", "event").otherwise("packet")
    many = F.when(F.col("disc_count") == 1, what).otherwise(F.concat(what, F.lit("s")))
    lead = F.when(F.col("disc_count").isNull(), F.concat(F.lit("WARNING: Tracer may have discarded "), what, F.lit("s"))).otherwise(F.concat(F.lit("WARNING: Tracer discarded "), F.col("disc_count").cast("string"), F.lit(" "), many))
    span = F.concat(F.lit(" between ["), clock_text(F.col("ts_ns")), F.lit("] and ["), clock_text(F.col("end_ts_ns")), F.lit("]"))
    where = F.concat(F.when(F.col("trace_name").isNotNull(), F.concat(F.lit(' in trace "'), F.col("trace_name"), F.lit('"'))).otherwise(F.lit(" in trace (no name)")), F.lit(" within stream (stream class ID: "), F.col("stream_class_id").cast("string"), F.lit(", stream ID: "), F.col("stream_id").cast("string"), F.lit(")."))
    return df.where("msg_type in ('DE', 'DP')").withColumn("warning", F.concat(lead, F.when(F.col("ts_ns").isNotNull(), span).otherwise(F.lit("")), where))
