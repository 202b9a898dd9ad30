"""Enrichment of events by state: as-of joins on time, and which loaded binary an address lies in.

A mapping lives from its load to its unload, to a clearing of its process, or to the end. An event is looked up after it has
changed the state itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import whole

#: The names of events that change a process's mappings.
LOADS = ("lttng_ust_statedump:bin_info", "lttng_ust_dl:dlopen", "lttng_ust_lib:load")
UNLOADS = ("lttng_ust_dl:dlclose", "lttng_ust_lib:unload")
CLEARS = ("lttng_ust_statedump:start",)
BUILD_IDS = ("lttng_ust_statedump:build_id", "lttng_ust_lib:build_id")
DEBUG_LINKS = ("lttng_ust_statedump:debug_link", "lttng_ust_lib:debug_link")


def as_of(events: DataFrame, states: DataFrame, by: list[str], order: str, values: list[str], strict: bool = False, bucket: int | None = None) -> DataFrame:
    """Each event with the values of the latest state of its key at or before it (strictly before, if strict).

    One sort of both tables instead of a join. With ``bucket`` (a width of ``order``), a key's rows are dealt out by buckets,
    so that a hot key isn't one task, and the last state of earlier buckets is carried into each.
    """
    late = 1 if strict else 0
    keep = [c for c in events.columns if c not in (*by, order, *values)]
    e = events.select(*by, order, F.struct(*(keep or [F.lit(1).alias("_")])).alias("_e"), F.lit(1 - late).alias("_k"))
    s = states.select(*by, order, F.struct(*values).alias("_s"), F.lit(late).alias("_k"))
    both = e.unionByName(s, allowMissingColumns=True)
    if bucket:
        both = both.withColumn("_b", whole(F.col(order), bucket))
    else:
        both = both.withColumn("_b", F.lit(0).cast("long"))
    w = Window.partitionBy(*by, "_b").orderBy(order, "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_e is not null")
    if bucket:
        ends = both.groupBy(*by, "_b").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct(order, "_k"))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_c"))
        out = out.join(carried, [*by, "_b"], "left").withColumn("_s", F.coalesce("_s", "_c"))
    return out.select(*by, order, *(F.col(f"_e.{c}").alias(c) for c in keep), *(F.col(f"_s.{v}").alias(v) for v in values))


def lifetimes(changes: DataFrame, order: str = "pos") -> DataFrame:
    """changes: (trace_name, vpid, order, kind, baddr, memsz, path, is_pic) with kind load, unload or clear.

    Returns mappings (trace_name, vpid, lo, hi, path, is_pic, valid_from, valid_to), valid_to null for the end. Loads of no memory are
    ignored, and so are loads of a base that is mapped.
    """
    live = changes.where("kind <> 'load' or memsz > 0")
    process = Window.partitionBy("trace_name", "vpid").orderBy(order)
    # what lies after a row, as a running frame of the order turned round: that of an open end is computed anew for each row
    after = Window.partitionBy("trace_name", "vpid").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    clears = live.withColumn("_cleared", F.min(F.when(F.col("kind") == "clear", F.col(order))).over(after))
    epoch = F.sum((F.col("kind") == "clear").cast("int")).over(process.rowsBetween(Window.unboundedPreceding, 0))
    rows = clears.withColumn("_epoch", epoch).where("kind <> 'clear'")
    base = Window.partitionBy("trace_name", "vpid", "_epoch", "baddr").orderBy(order)
    fresh = (F.col("kind") == "load") & (F.coalesce(F.lag("kind").over(base), F.lit("unload")) == "unload")
    later = Window.partitionBy("trace_name", "vpid", "_epoch", "baddr").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.min(F.when(F.col("kind") == "unload", F.col(order))).over(later)
    out = rows.withColumn("_fresh", fresh).withColumn("_gone", gone).where("_fresh")
    return out.select("trace_name", "vpid", F.col("baddr").alias("lo"), (F.col("baddr") + F.col("memsz")).alias("hi"), "path", "is_pic", F.col(order).alias("valid_from"), F.least("_gone", "_cleared").alias("valid_to"))


def with_identifiers(mappings: DataFrame, identifiers: DataFrame) -> DataFrame:
    """mappings with the build ID and debug link that events attached to their base: the last of each while they were loaded.

    identifiers: (trace_name, vpid, order, baddr, build_id, debug_link, debug_crc), null what an event doesn't tell.
    """
    ids = identifiers.select(F.col("trace_name").alias("_t"), F.col("vpid").alias("_v"), F.col("baddr").alias("_a"), F.col("pos").alias("_p"), "build_id", "debug_link", "debug_crc")
    on = mappings["trace_name"].eqNullSafe(F.col("_t")) & (mappings["vpid"] == F.col("_v")) & (mappings["lo"] == F.col("_a")) & (F.col("_p") >= mappings["valid_from"]) & (mappings["valid_to"].isNull() | (F.col("_p") < mappings["valid_to"]))
    own = [mappings[c] for c in mappings.columns]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c)
    return mappings.join(ids, on, "left").groupBy(*own).agg(last("build_id"), last("debug_link"), last("debug_crc"))


def identifiers_of(df: DataFrame) -> DataFrame:
    """The build-ID and debug-link events of a merged message table."""
    js = lambda s, k, t: F.get_json_object(F.col(s), f"$.{k}").cast(t)
    rows = df.where((F.col("msg_type") == "EV") & F.col("event_class_name").isin(*BUILD_IDS, *DEBUG_LINKS))
    return rows.select("trace_name", js("common_context", "vpid", "long").alias("vpid"), "pos", js("payload", "baddr", "long").alias("baddr"), js("payload", "build_id", "string").alias("build_id"), js("payload", "filename", "string").alias("debug_link"), js("payload", "crc", "long").alias("debug_crc"))


def binary_text(path: Column, ip: Column, lo: Column, is_pic: Column, full_path: bool = False) -> Column:
    """``name+0xoffset`` for position-independent code, otherwise ``name@0xaddress``."""
    name = path if full_path else F.substring_index(path, "/", -1)
    place = F.when(is_pic, F.concat(F.lit("+0x"), F.lower(F.hex(ip - lo)))).otherwise(F.concat(F.lit("@0x"), F.lower(F.hex(ip))))
    return F.concat(name, place)


def debug_info(events: DataFrame, mappings: DataFrame, order: str = "pos", bucket: int = 1 << 20, full_path: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """events: (trace_name, vpid, order, ip, ...). Adds debug_bin, debug_func and debug_src, empty where unknown.

    A range join on addresses and positions: mappings are posted once for every ``bucket`` addresses that they touch and
    joined on equality of the bucket, then refined. symbols: (path, addr, func, src), of which the nearest at or below the
    offset (the address, without position independence) is taken.
    """
    floor = lambda c: whole(c, bucket)
    posted = mappings.withColumn("_b", F.explode(F.sequence(floor(F.col("lo")), floor(F.col("hi") - 1))))
    keyed = events.withColumn("_b", floor(F.col("ip")))
    m = {c: f"_m_{c}" for c in mappings.columns}
    posted = posted.select(*(F.col(c).alias(m[c]) for c in mappings.columns), F.col("_b").alias("_m_b"))
    alive = (F.col(order) >= F.col("_m_valid_from")) & (F.col("_m_valid_to").isNull() | (F.col(order) < F.col("_m_valid_to")))
    on = (F.col("trace_name").eqNullSafe(F.col("_m_trace_name"))) & (F.col("vpid") == F.col("_m_vpid")) & (F.col("_b") == F.col("_m_b")) & (F.col("ip") >= F.col("_m_lo")) & (F.col("ip") < F.col("_m_hi")) & alive
    joined = keyed.join(posted, on, "left")
    text = binary_text(F.col("_m_path"), F.col("ip"), F.col("_m_lo"), F.col("_m_is_pic"), full_path)
    out = joined.withColumn("debug_bin", F.coalesce(text, F.lit("")))
    if symbols is None:
        out = out.withColumn("debug_func", F.lit("")).withColumn("debug_src", F.lit(""))
    else:
        out = out.withColumn("_at", F.when(F.col("_m_is_pic"), F.col("ip") - F.col("_m_lo")).otherwise(F.col("ip"))).withColumn("path", F.coalesce(F.col("_m_path"), F.lit("")))
        named = as_of(out.withColumnRenamed("_at", "addr"), symbols.select("path", "addr", F.col("func").alias("debug_func"), F.col("src").alias("debug_src")), ["path"], "addr", ["debug_func", "debug_src"])
        hit = F.col("debug_bin") != ""
        out = named.withColumn("debug_func", F.when(hit, F.coalesce("debug_func", F.lit(""))).otherwise("")).withColumn("debug_src", F.when(hit, F.coalesce("debug_src", F.lit(""))).otherwise("")).drop("path", "addr")
    return out.drop("_b", "_m_b", *m.values())


def with_debug_info(df: DataFrame, symbols: DataFrame | None = None, field: str = "debug_info", full_path: bool = False, target_prefix: str = "") -> DataFrame:
    """A merged message table whose events carry ip and vpid in their common context (JSON): adds the field there."""
    event = F.col("msg_type") == "EV"
    js = lambda s, k, t: F.get_json_object(F.col(s), f"$.{k}").cast(t)
    vpid, ip = js("common_context", "vpid", "long"), js("common_context", "ip", "long")
    kind = F.when(F.col("event_class_name").isin(*LOADS), "load").when(F.col("event_class_name").isin(*UNLOADS), "unload").when(F.col("event_class_name").isin(*CLEARS), "clear")
    path = F.concat(F.lit(target_prefix), F.coalesce(js("payload", "path", "string"), F.lit("")))
    changes = df.where(event & kind.isNotNull()).select("trace_name", vpid.alias("vpid"), "pos", kind.alias("kind"), js("payload", "baddr", "long").alias("baddr"), js("payload", "memsz", "long").alias("memsz"), path.alias("path"), F.coalesce(js("payload", "is_pic", "int") == 1, F.lit(True)).alias("is_pic"))
    looked = debug_info(df.where(event).select("trace_name", vpid.alias("vpid"), "pos", ip.alias("ip")), lifetimes(changes), symbols=symbols, full_path=full_path)
    found = looked.select("pos", F.to_json(F.struct(F.struct(F.col("debug_bin").alias("bin"), F.col("debug_func").alias("func"), F.col("debug_src").alias("src")).alias(field))).alias("_debug"))
    out = df.join(found, "pos", "left")
    merged = F.when(F.coalesce("common_context", F.lit("{}")) == "{}", F.col("_debug")).otherwise(F.concat(F.expr("substr(common_context, 1, length(common_context) - 1)"), F.lit(","), F.expr("substr(_debug, 2)")))
    return out.withColumn("common_context", F.when(F.col("_debug").isNotNull(), merged).otherwise(F.col("common_context"))).drop("_debug")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, begin: str, end: str, width: int) -> DataFrame:
    """left rows with each right row of the same key whose [begin, end] holds left's ``at``; bucketed by ``width``."""
    floor = lambda c: whole(F.col(c), width)
    posted = right.withColumn("_b", F.explode(F.sequence(floor(begin), floor(end))))
    return left.withColumn("_b", floor(at)).join(posted, [*by, "_b"]).where(F.col(at).between(F.col(begin), F.col(end))).drop("_b")
