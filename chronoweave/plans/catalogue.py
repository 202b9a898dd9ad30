"""The named queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, fields, times
from ..operators import enrich, packets, validate
from ..operators.mux import mux
from ..operators.position import Ordered
from ..operators.trim import trim_ns, trim_timed
from ..schema import messages
from ..sinks import count, details, pretty
from ..sources import tables, textlog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: 2024-01-10 and 2024-01-20, in ns from 1970.
BEGIN, END = 1_704_844_800_000_000_000, 1_705_708_800_000_000_000

EV = """ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) * 1000 AS ts_ns, user_id % 4 AS stream_id,
  CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day FROM events)"""
MSG = (
    EV
    + """, pk AS (SELECT stream_id, day, min(ts_ns) b, max(ts_ns) e, min(event_id) f, max(event_id) l FROM ev GROUP BY ALL),
st AS (SELECT stream_id, min(b) b, max(e) e, min(f) f, max(l) l FROM pk GROUP BY ALL),
msg AS (
  SELECT stream_id, 'EV' AS msg_type, ts_ns, event_id * 8 + 4 AS seq, day, event_type FROM ev
  UNION ALL SELECT stream_id, 'PB', b, f * 8 + 2, day, NULL FROM pk UNION ALL SELECT stream_id, 'PE', e, l * 8 + 5, day, NULL FROM pk
  UNION ALL SELECT stream_id, 'SB', b, f * 8, NULL, NULL FROM st UNION ALL SELECT stream_id, 'SE', e, l * 8 + 7, NULL, NULL FROM st),
m AS (SELECT *, row_number() OVER (ORDER BY ts_ns, stream_id, seq) AS pos FROM msg)"""
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mux(tables.event_messages(spark, sf_dir), timed=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per type between two times, streams merged."""
    return count.count_messages(trim_ns(merged_events(spark, sf_dir), BEGIN, END))


# counts and order


@query(
    f"WITH {MSG} SELECT t AS msg_type, CAST(count(pos) AS BIGINT) AS n FROM (VALUES ('SB'),('PB'),('EV'),('DE'),('MI'),('PE'),('DP'),('SE')) v(t) LEFT JOIN m ON m.msg_type = t GROUP BY t UNION ALL SELECT 'TOTAL', CAST(count(*) AS BIGINT) FROM m"
)
def count_by_msg_type(spark, sf_dir):
    return count.count_messages(tables.event_messages(spark, sf_dir))


@query(
    f"""WITH {MSG}, c AS (SELECT (pos - 1) // 1000 AS block, msg_type, count(*) n FROM m GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT block FROM c), (SELECT DISTINCT msg_type FROM c))
SELECT CAST(g.block AS BIGINT) AS block, g.msg_type, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.msg_type ORDER BY g.block) AS BIGINT) AS n FROM g LEFT JOIN c ON c.block = g.block AND c.msg_type = g.msg_type"""
)
def count_step_blocks(spark, sf_dir):
    return count.count_blocks(merged_events(spark, sf_dir), 1000)


_MERGED = """a AS (SELECT 'events' AS trace_name, user_id % 4 AS stream_id, event_id * 8 + 4 AS src_seq, epoch_us(ts) * 1000 AS ts_ns FROM events
UNION ALL SELECT 'orders', 0, o_orderkey, epoch_us(o_orderdate) * 1000 FROM orders
UNION ALL SELECT 'lineitem', 0, l_orderkey * 8 + l_linenumber, epoch_us(l_shipdate) * 1000 FROM lineitem)"""


@query(f"WITH {_MERGED} SELECT row_number() OVER (ORDER BY ts_ns, trace_name, stream_id, src_seq) AS pos, trace_name, CAST(stream_id AS BIGINT) AS stream_id, CAST(src_seq AS BIGINT) AS src_seq, ts_ns FROM a")
def mux_order(spark, sf_dir):
    rows = tables.event_rows(spark, sf_dir).select("port_ord", "src_seq", "trace_name", "stream_class_id", "stream_id", "msg_type", "ts_ns")
    others = tables.order_rows(spark, sf_dir).unionByName(tables.lineitem_rows(spark, sf_dir)).select(rows.columns)
    return mux(rows.unionByName(others), timed=True).select("pos", "trace_name", "stream_id", "src_seq", "ts_ns")


@query(
    """WITH a AS (SELECT 'orders' AS trace_name, o_orderkey AS src_seq, epoch_us(o_orderdate) * 1000 AS ts_ns FROM orders UNION ALL SELECT 'lineitem', l_orderkey * 8 + l_linenumber, epoch_us(l_shipdate) * 1000 FROM lineitem)
SELECT row_number() OVER (ORDER BY ts_ns, trace_name, src_seq) AS pos, trace_name, CAST(src_seq AS BIGINT) AS src_seq FROM a"""
)
def mux_ties(spark, sf_dir):
    rows = tables.order_rows(spark, sf_dir).unionByName(tables.lineitem_rows(spark, sf_dir))
    rows = rows.select("port_ord", "src_seq", "trace_name", "stream_class_id", "stream_id", "msg_type", "ts_ns")
    return mux(rows, timed=True).select("pos", "trace_name", "src_seq")


# trimming


def _trim_sql(b: int | None, e: int | None) -> str:
    lo, hi = (str(b) if b is not None else "NULL"), (str(e) if e is not None else "NULL")
    return f"""WITH {MSG}, s AS (SELECT min(pos) sp FROM m WHERE {lo} IS NULL OR ts_ns >= {lo}),
sk AS (SELECT m.* FROM m, s WHERE {lo} IS NOT NULL AND (sp IS NULL OR pos < sp)),
al AS (SELECT stream_id, sum(CASE msg_type WHEN 'PB' THEN 1 WHEN 'PE' THEN -1 ELSE 0 END) op, max_by(day, pos) FILTER (msg_type = 'PB') AS day FROM sk GROUP BY stream_id HAVING count(*) FILTER (msg_type = 'SB') > 0 AND count(*) FILTER (msg_type = 'SE') = 0),
fr AS (SELECT stream_id, 'SB' msg_type, CAST({lo} AS BIGINT) ts_ns, NULL event_type, CAST(NULL AS BIGINT) AS day, 0 k FROM al UNION ALL SELECT stream_id, 'PB', {lo}, NULL, day, 1 FROM al WHERE op > 0),
r AS (SELECT *, row_number() OVER (ORDER BY stream_id, k) pos FROM fr),
n AS (SELECT stream_id, msg_type, ts_ns, event_type, day, pos FROM r UNION ALL SELECT stream_id, msg_type, ts_ns, event_type, day, pos - sp + 1 + (SELECT count(*) FROM r) FROM m, s WHERE pos >= sp),
c AS (SELECT min(pos) cp FROM n WHERE {hi} IS NOT NULL AND ts_ns > {hi}),
kept AS (SELECT n.* FROM n, c WHERE cp IS NULL OR pos < cp),
cl AS (SELECT stream_id, sum(CASE msg_type WHEN 'PB' THEN 1 WHEN 'PE' THEN -1 ELSE 0 END) op, max_by(day, pos) FILTER (msg_type = 'PB') AS day FROM kept, c WHERE cp IS NOT NULL GROUP BY stream_id HAVING count(*) FILTER (msg_type = 'SB') > 0 AND count(*) FILTER (msg_type = 'SE') = 0),
en AS (SELECT stream_id, 'PE' msg_type, CAST({hi} AS BIGINT) ts_ns, day, 0 k FROM cl WHERE op > 0 UNION ALL SELECT stream_id, 'SE', {hi}, NULL, 1 FROM cl)
SELECT CAST(pos AS BIGINT) pos, CAST(stream_id AS BIGINT) stream_id, msg_type, ts_ns, event_type AS event_class_name, day AS packet_ord FROM kept
UNION ALL SELECT CAST(cp - 1 + row_number() OVER (ORDER BY stream_id, k) AS BIGINT), stream_id, msg_type, ts_ns, NULL, day FROM en, c"""


def _trimmed(spark, sf_dir, b, e):
    """Streams and packets are derived from all events; of the events themselves only those in the range are read."""
    rows = tables.event_rows(spark, sf_dir, b, e).unionByName(tables.bounds_of(tables.event_rows(spark, sf_dir)), allowMissingColumns=True)
    return trim_timed(rows, b, e).select("pos", "stream_id", "msg_type", "ts_ns", "event_class_name", "packet_ord")


@query(_trim_sql(BEGIN, END))
def trim_range(spark, sf_dir):
    return _trimmed(spark, sf_dir, BEGIN, END)


@query(_trim_sql(BEGIN, None))
def trim_begin_only(spark, sf_dir):
    return _trimmed(spark, sf_dir, BEGIN, None)


@query(_trim_sql(None, END))
def trim_end_only(spark, sf_dir):
    return _trimmed(spark, sf_dir, None, END)


@query(_trim_sql(END * 2, None))
def trim_empty(spark, sf_dir):
    return _trimmed(spark, sf_dir, END * 2, None)


@query(
    f"""WITH {EV} SELECT CAST(stream_id AS BIGINT) AS stream_id, day AS packet_ord, greatest(min(ts_ns), {BEGIN}) AS ts_ns, least(max(ts_ns), {END}) AS end_ts_ns,
CASE WHEN min(ts_ns) >= {BEGIN} AND max(ts_ns) <= {END} THEN CAST(count(*) AS BIGINT) END AS disc_count FROM ev GROUP BY stream_id, day HAVING max(ts_ns) >= {BEGIN} AND min(ts_ns) <= {END}"""
)
def trim_losses(spark, sf_dir):
    """Losses that cross the bounds: each day's events of a stream as one loss."""
    rows = tables.event_rows(spark, sf_dir).groupBy("port_ord", "trace_name", "stream_class_id", "stream_id", "packet_ord").agg(F.min("ts_ns").alias("ts_ns"), F.max("ts_ns").alias("end_ts_ns"), F.count("*").cast("decimal(20,0)").alias("disc_count"), F.min("src_seq").alias("src_seq"))
    out = trim_ns(mux(rows.withColumn("msg_type", F.lit("DE")), timed=True), BEGIN, END)
    return out.where("msg_type = 'DE'").select("stream_id", "packet_ord", "ts_ns", "end_ts_ns", F.col("disc_count").cast("long").alias("disc_count"))


# ranges


@query(f"WITH {MSG} SELECT 'events' AS trace_name, CAST(stream_id AS BIGINT) AS stream_id, 'events | ' || stream_id AS port, min(b) AS begin_ns, max(e) AS end_ns FROM pk GROUP BY stream_id")
def stream_ranges(spark, sf_dir):
    of = packets.stream_ranges(packets.packets_of(tables.event_messages(spark, sf_dir)))
    return of.select("trace_name", "stream_id", F.concat_ws(" | ", "trace_name", F.col("stream_id").cast("string")).alias("port"), "begin_ns", "end_ns")


@query(f"WITH {MSG}, i AS (SELECT max(b) b, min(e) e FROM (SELECT stream_id, min(b) b, max(e) e FROM pk GROUP BY ALL)) SELECT 'events' AS trace_name, any_value(b) AS begin_ns, any_value(e) AS end_ns, CAST(4 AS BIGINT) AS n_streams, CAST(count(*) AS BIGINT) AS n_events FROM ev, i WHERE ts_ns BETWEEN b AND e")
def stream_intersection(spark, sf_dir):
    rows = tables.event_messages(spark, sf_dir)
    common = packets.intersections(packets.stream_ranges(packets.packets_of(rows))).where("error is null")
    held = rows.where("msg_type = 'EV'").join(F.broadcast(common), "trace_name").where("ts_ns between begin_ns and end_ns")  # one row for each trace
    return held.groupBy("trace_name").agg(F.first("begin_ns").alias("begin_ns"), F.first("end_ns").alias("end_ns"), F.first("n_streams").alias("n_streams"), F.count("*").alias("n_events"))


@query(f"WITH {EV} SELECT event_id, ts_ns - lag(ts_ns) OVER (ORDER BY ts_ns, event_id) AS delta_ns FROM ev")
def event_delta(spark, sf_dir):
    rows = tables.event_rows(spark, sf_dir).select("event_id", "ts_ns")
    out = Ordered(rows, [F.col("ts_ns").asc(), F.col("event_id").asc()], "ts_ns").with_previous("_previous")
    return out.select("event_id", (F.col("ts_ns") - F.col("_previous")).alias("delta_ns"))


@query(f"WITH {EV} SELECT 'events | 0 | ' || stream_id AS port, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY stream_id")
def port_names(spark, sf_dir):
    return tables.event_rows(spark, sf_dir).groupBy(packets.port_name().alias("port")).agg(F.count("*").alias("n"))


# clocks


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(1e9 * CAST(l_orderkey * 1000 + l_partkey AS DOUBLE) / 33333333) AS BIGINT) + 1500000000 + CAST(trunc(1e9 * 7.0 / 33333333) AS BIGINT) AS ns FROM lineitem")
def cycles_to_ns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (clock.cycles_to_ns(F.col("l_orderkey") * 1000 + F.col("l_partkey"), 33_333_333, 1, 7) + F.lit(500_000_000)).alias("ns"))


@query("SELECT event_id, CAST(((epoch_us(ts) * 1000 - 1000000000000000000)::HUGEINT * 1000003) // 1000000000 - 5 AS BIGINT) AS cycles FROM events")
def ns_to_cycles(spark, sf_dir):
    ns = tables.event_rows(spark, sf_dir).select("event_id", "ts_ns")
    return ns.select("event_id", clock.ns_to_cycles(F.col("ts_ns"), 1_000_003, 1_000_000_000, 5).cast("long").alias("cycles"))


@query(f"WITH {EV}, b AS (SELECT stream_id, min(ts_ns // 1000000) o FROM ev GROUP BY 1) SELECT event_id, ts_ns // 1000000 - (o - (o % 134217728)) AS cycles FROM ev JOIN b USING (stream_id)")
def clock_unwrap(spark, sf_dir):
    """Milliseconds as a 27-bit counter, restored to a whole one. Every stream starts from its first value."""
    rows = tables.event_rows(spark, sf_dir).select(F.col("stream_id").alias("k"), "event_id", F.pmod(fields.whole(F.col("ts_ns"), 1_000_000), F.lit(2**27)).alias("low"))
    return clock.unwrap(rows, "low", 27, ["k"], ["event_id"]).select("event_id", F.col("cycles").cast("long").alias("cycles"))


@query(
    """SELECT g AS trace_no, CASE WHEN g = 0 THEN true WHEN g = 1 THEN false WHEN g = 2 THEN false ELSE true END AS comparable, CASE g WHEN 1 THEN 'kinds differ' WHEN 2 THEN 'UUIDs differ' END AS error
FROM (SELECT DISTINCT n_nationkey % 4 AS g FROM nation)"""
)
def clock_correlation(spark, sf_dir):
    """Four groups of clocks: all Unix, mixed, two UUIDs, one UUID."""
    n = table(spark, sf_dir, "nation")
    g = F.col("n_nationkey") % 4
    clocks = n.select(
        g.alias("trace_no"),
        F.lit(True).alias("has_clock"),
        ((g == 0) | ((g == 1) & (F.col("n_nationkey") % 8 == 1))).alias("unix_origin"),
        F.when(g == 2, F.concat(F.lit("u"), (F.col("n_nationkey") % 8).cast("string"))).when(g == 3, "same").alias("clock_uuid"),
        F.col("n_nationkey").alias("clock_id"),
    )
    return clock.correlation(clocks, ["trace_no"]).select("trace_no", "comparable", "error")


# packets

_PACKETS = (
    MSG
    + """, p AS (SELECT stream_id, day, b, e, (SELECT count(*) FROM ev x WHERE x.stream_id = pk.stream_id AND x.day <= pk.day AND x.event_type = 'error') AS d, row_number() OVER (PARTITION BY stream_id ORDER BY day) AS q FROM pk)"""
)


def packet_table(spark, sf_dir) -> DataFrame:
    """A packet for each stream and day, with a counter of the errors so far and a sequence number."""
    rows = tables.event_rows(spark, sf_dir)
    of = rows.groupBy("trace_name", "stream_id", "packet_ord").agg(F.min("ts_ns").alias("ts_begin"), F.max("ts_ns").alias("ts_end"), F.min("ts_ns").alias("first_event_ns"), F.max("ts_ns").alias("last_event_ns"), F.count("*").alias("packet_size"), F.sum((F.col("event_class_name") == "error").cast("int")).alias("_errors"))
    w = Window.partitionBy("trace_name", "stream_id").orderBy("packet_ord")
    return of.withColumn("events_discarded", F.sum("_errors").over(w)).withColumn("packet_seq_num", F.row_number().over(w).cast("long")).drop("_errors")


@query(
    f"""WITH {_PACKETS}, x AS (SELECT *, d - lag(d) OVER w AS s, lag(e) OVER w AS pe, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY stream_id ORDER BY day))
SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, CASE WHEN rn = 1 THEN b ELSE pe END AS begin_ns, e AS end_ns, CAST(CASE WHEN rn > 1 THEN s END AS BIGINT) AS disc_count FROM x WHERE (rn = 1 AND d <> 0) OR (rn > 1 AND s <> 0)"""
)
def discarded_events(spark, sf_dir):
    return packets.discarded_events(packet_table(spark, sf_dir)).select("stream_id", "packet_ord", "begin_ns", "end_ns", "disc_count")


@query(
    f"""WITH {_PACKETS}, x AS (SELECT *, q - lag(q) OVER w AS s, lag(e) OVER w AS pe FROM p WHERE day % 7 <> 3 WINDOW w AS (PARTITION BY stream_id ORDER BY day))
SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, pe AS begin_ns, b AS end_ns, CAST(s - 1 AS BIGINT) AS disc_count FROM x WHERE s > 1"""
)
def discarded_packets(spark, sf_dir):
    return packets.discarded_packets(packet_table(spark, sf_dir).where("packet_ord % 7 <> 3")).select("stream_id", "packet_ord", "begin_ns", "end_ns", "disc_count")


@query(
    f"""WITH {_PACKETS}, x AS (SELECT *, d - lag(d) OVER w AS sd, q - lag(q) OVER w AS sq, row_number() OVER w AS rn FROM p WHERE day % 7 <> 3 WINDOW w AS (PARTITION BY stream_id ORDER BY day))
SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, 'DE' AS msg_type, 0 AS before_packet FROM x WHERE (rn = 1 AND d <> 0) OR (rn > 1 AND sd <> 0)
UNION ALL SELECT stream_id, day, 'DP', 1 FROM x WHERE sq > 1"""
)
def loss_order(spark, sf_dir):
    return packets.losses(packet_table(spark, sf_dir).where("packet_ord % 7 <> 3")).select("stream_id", "packet_ord", "msg_type", "before_packet")


@query(f"WITH {_PACKETS} SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, b AS ts_begin, e AS ts_end FROM p")
def packet_dedup(spark, sf_dir):
    p = packet_table(spark, sf_dir)
    both = p.where("packet_ord <= 19745").unionByName(p.where("packet_ord >= 19735").withColumn("packet_ord", F.col("packet_ord")))
    return packets.without_duplicates(both).select("stream_id", "packet_ord", "ts_begin", "ts_end")


@query(f"WITH {_PACKETS} SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, coalesce(lead(b) OVER (PARTITION BY stream_id ORDER BY day), e) AS ts_end FROM p")
def packet_end_repair(spark, sf_dir):
    return packets.events_after_packet(packet_table(spark, sf_dir)).select("stream_id", "packet_ord", "ts_end")


@query(
    f"""WITH {_PACKETS}, x AS (SELECT *, CASE WHEN q > 1 THEN b ELSE b - 777 END AS nb FROM p)
SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, nb AS ts_begin, coalesce(lead(nb) OVER (PARTITION BY stream_id ORDER BY day), e) AS ts_end FROM x"""
)
def packet_begin_repair(spark, sf_dir):
    early = packet_table(spark, sf_dir).withColumn("ts_begin", F.col("ts_begin") - 777)
    return packets.events_before_packet(early).select("stream_id", "packet_ord", "ts_begin", "ts_end")


@query(f"WITH {_PACKETS} SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, CASE WHEN day % 5 = 2 THEN coalesce(lead(b) OVER (PARTITION BY stream_id ORDER BY day), e) ELSE e END AS ts_end FROM p")
def crash_repair(spark, sf_dir):
    torn = packet_table(spark, sf_dir).withColumn("ts_end", F.when(F.col("packet_ord") % 5 == 2, F.lit(0).cast("long")).otherwise(F.col("ts_end")))
    return packets.crashed(torn).select("stream_id", "packet_ord", "ts_end")


@query(
    """SELECT 'uuid-' || n_regionkey AS trace_key, 'p' || lpad(CAST(min(n_nationkey) AS VARCHAR), 3, '0') AS first_path, CAST(count(*) AS BIGINT) AS n_paths, 'p' || lpad(CAST(max_by(n_nationkey, (n_nationkey * 7 % 11) * 1000 - n_nationkey) AS VARCHAR), 3, '0') AS class_path FROM nation GROUP BY n_regionkey"""
)
def trace_grouping(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    traces = n.select(F.concat(F.lit("uuid-"), "n_regionkey").alias("uuid"), F.concat(F.lit("p"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("path"), F.lit(1).alias("n_stream_classes"), (F.col("n_nationkey") * 7 % 11).alias("n_event_classes"))
    return packets.merged_traces(traces).select("trace_key", "first_path", "n_paths", "class_path")


@query(
    f"""WITH {MSG}, k AS (SELECT * FROM m WHERE NOT (msg_type = 'PB' AND day % 9 = 4)),
x AS (SELECT *, lag(msg_type) OVER (PARTITION BY stream_id ORDER BY pos) AS pm, lag(pos) OVER (PARTITION BY stream_id ORDER BY pos) AS pp FROM k)
SELECT CAST(stream_id AS BIGINT) stream_id, day AS packet_ord, msg_type, 'illegal succession' AS error FROM x WHERE NOT (
 (pm IS NULL AND msg_type = 'SB') OR (pm = 'SB' AND msg_type IN ('SE','PB')) OR (pm = 'EV' AND msg_type IN ('EV','PE')) OR (pm = 'PB' AND msg_type IN ('EV','PE')) OR (pm = 'PE' AND msg_type IN ('PB','SE')))"""
)
def sequence_check(spark, sf_dir):
    broken = merged_events(spark, sf_dir).where("not (msg_type = 'PB' and packet_ord % 9 = 4)")
    return validate.sequence_errors(broken).select("stream_id", "packet_ord", "msg_type", "error")


# enrichment


@query(
    f"""WITH {EV}, s AS (SELECT user_id, ts_ns, value FROM ev WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, ts_ns FROM ev WHERE event_type = 'purchase')
SELECT p.event_id, s.value AS signup_value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts_ns >= s.ts_ns"""
)
def asof_state(spark, sf_dir):
    rows = tables.event_rows(spark, sf_dir).select("event_id", "user_id", "ts_ns", "event_class_name", "value")
    signups = rows.where("event_class_name = 'signup'").select("user_id", "ts_ns", F.col("value").alias("signup_value"))
    return enrich.as_of(rows.where("event_class_name = 'purchase'").select("event_id", "user_id", "ts_ns"), signups, ["user_id"], "ts_ns", ["signup_value"], bucket=tables.DAY_NS).select("event_id", "signup_value")


@query(
    f"""WITH {EV}, x AS (SELECT event_id AS pos, user_id % 7 AS vpid, event_type, user_id, CAST(floor(value * 100) AS BIGINT) AS ip FROM ev),
l AS (SELECT pos, vpid, (user_id % 5) * 2000 AS lo, 2500 AS sz FROM x WHERE event_type = 'signup'), u AS (SELECT pos, vpid, (user_id % 5) * 2000 AS lo FROM x WHERE event_type = 'error'),
c AS (SELECT pos, vpid, lo, 1 AS is_load FROM l UNION ALL SELECT pos, vpid, lo, 0 FROM u),
f AS (SELECT *, lag(is_load) OVER (PARTITION BY vpid, lo ORDER BY pos) AS pl, min(CASE WHEN is_load = 0 THEN pos END) OVER (PARTITION BY vpid, lo ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM c),
mp AS (SELECT vpid, lo, lo + 2500 AS hi, pos AS vf, gone AS vt FROM f WHERE is_load = 1 AND coalesce(pl, 0) = 0)
SELECT e.pos AS event_id, coalesce('lib' || (lo // 2000) || '.so+0x' || lower(printf('%x', ip - lo)), '') AS debug_bin FROM x e LEFT JOIN mp ON mp.vpid = e.vpid AND e.ip >= lo AND e.ip < hi AND e.pos >= vf AND (vt IS NULL OR e.pos < vt) WHERE e.event_type = 'purchase'"""
)
def debug_info_lookup(spark, sf_dir):
    """signup loads a library, error unloads it, purchase has an address that may lie in one of those loaded, or two."""
    rows = tables.event_rows(spark, sf_dir).select("trace_name", F.col("event_id").alias("pos"), (F.col("user_id") % 7).alias("vpid"), "user_id", "event_class_name", F.floor(F.col("value") * 100).cast("long").alias("ip"))
    base = F.col("user_id") % 5
    kind = F.when(F.col("event_class_name") == "signup", "load").when(F.col("event_class_name") == "error", "unload")
    changes = rows.where(kind.isNotNull()).select("trace_name", "vpid", "pos", kind.alias("kind"), (base * 2000).alias("baddr"), F.lit(2500).cast("long").alias("memsz"), F.concat(F.lit("/usr/lib/lib"), base.cast("string"), F.lit(".so")).alias("path"), F.lit(True).alias("is_pic"))
    looked = enrich.debug_info(rows.where("event_class_name = 'purchase'").select("trace_name", "vpid", "pos", "ip"), enrich.lifetimes(changes), bucket=1024)
    return looked.select(F.col("pos").alias("event_id"), "debug_bin")


_LABELS = [("low", 0, 20), ("middle", 15, 60), ("high", 50, 100), ("peak", 95, 100), ("low", 21, 22)]


@query("SELECT event_id, label FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events) e JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _LABELS) + ") m(label, lo, hi) ON v BETWEEN lo AND hi")
def range_label(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("long").alias("v"))
    return fields.label_join(rows, "v", spark.createDataFrame(_LABELS, "label string, lo long, hi long"), 16).select("event_id", "label")


@query(
    "SELECT event_id, CASE WHEN u > 0 AND u < 16 THEN concat_ws(' | ', CASE WHEN u & 1 > 0 THEN '\"read\"' END, CASE WHEN u & 2 > 0 THEN '{ \"write\", \"append\" }' END, CASE WHEN u & 4 > 0 THEN '\"run\"' END, CASE WHEN u & 8 > 0 THEN '\"lock\"' END) ELSE '<unknown>' END AS flags FROM (SELECT event_id, user_id % 20 AS u FROM events)"
)
def bitflag_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("u"))
    return rows.select("event_id", fields.flags_text(F.col("u"), [("read", 1, 1), ("write", 2, 2), ("append", 2, 2), ("run", 4, 4), ("lock", 8, 8), ("all", 1, 15)]).alias("flags"))


@query("SELECT event_id, printf('0x%X', user_id) AS hex, '0b' || CASE WHEN user_id = 0 THEN '0' ELSE ltrim(bin(user_id), '0') END AS bin, printf('0%o', user_id) AS oct, CAST(user_id AS VARCHAR) AS dec FROM events")
def int_bases(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", fields.in_base(u, 16).alias("hex"), fields.in_base(u, 2).alias("bin"), fields.in_base(u, 8).alias("oct"), fields.in_base(u, 10).alias("dec"))


@query("SELECT event_id, CAST(floor((user_id - 700) / 7.0) AS BIGINT) AS q, user_id - 700 - 7 * CAST(floor((user_id - 700) / 7.0) AS BIGINT) AS r, user_id << 3 AS l, user_id >> 2 AS s, user_id & 12 AS a, user_id | 5 AS o, xor(user_id, 9) AS x, ~user_id AS n FROM events")
def field_arithmetic(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", fields.floor_div(u - 700, F.lit(7)).alias("q"), fields.floor_mod(u - 700, F.lit(7).cast("long")).alias("r"), F.shiftleft(u, 3).alias("l"), F.shiftright(u, 2).alias("s"), u.bitwiseAND(F.lit(12)).alias("a"), u.bitwiseOR(F.lit(5)).alias("o"), u.bitwiseXOR(F.lit(9)).alias("x"), F.bitwise_not(u).alias("n")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def payload_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"), *(F.lit(None).cast("string").alias(c) for c in ("specific_context", "common_context", "packet_context")))
    k = fields.member("k").cast("long")
    return rows.select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


# text


@query(
    f"""WITH {EV}, d AS (SELECT *, ts_ns - lag(ts_ns) OVER (ORDER BY ts_ns, event_id) AS delta FROM ev)
SELECT event_id, '[' || strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S') || '.' || lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0') || '] (' ||
coalesce('+' || (delta // 1000000000) || '.' || lpad(CAST(delta % 1000000000 AS VARCHAR), 9, '0'), '+?.?????????') || ') ' || event_type || ': {{ k = ' || json_extract_string(props, '$.k') || ' }}' AS line FROM d"""
)
def pretty_line(spark, sf_dir):
    rows = tables.event_rows(spark, sf_dir).withColumn("payload", F.col("props"))
    return pretty.pretty_lines(rows, order="event_id")


@query(
    f"""WITH {MSG} SELECT CAST(pos AS BIGINT) AS pos, '[' || format('{{:,}}', ts_ns) || ' ' || format('{{:,}}', ts_ns) || '] {{0 0 ' || stream_id || '}} ' ||
CASE msg_type WHEN 'EV' THEN 'Event `' || event_type || '` (' || (list_position(['click','error','purchase','signup','view'], event_type) - 1) || ')' WHEN 'SB' THEN 'Stream beginning' WHEN 'SE' THEN 'Stream end' WHEN 'PB' THEN 'Packet beginning' ELSE 'Packet end' END AS line FROM m"""
)
def details_compact(spark, sf_dir):
    return details.details_lines(merged_events(spark, sf_dir))


@query("SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, 'user ' || user_id AS text FROM events")
def textlog_parse(spark, sf_dir):
    """Lines made of events, read as a text log."""
    rows = tables.event_rows(spark, sf_dir)
    micros = F.expr("ts_ns div 1000")
    seconds = F.expr("ts_ns div 1000000000")
    body = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    line = F.concat(F.lit("["), seconds.cast("string"), F.lit("."), F.lpad((micros - seconds * 1_000_000).cast("string"), 6, "0"), F.lit("] "), body)
    ts, text = textlog.parse_line(F.col("line"))
    return rows.select("event_id", line.alias("line")).select("event_id", ts.alias("ts_ns"), text.alias("text"))


@query(f"WITH {MSG} SELECT CAST(stream_id AS BIGINT) AS stream_id, day AS packet_ord, 'WARNING: Tracer discarded ' || n || CASE WHEN n = 1 THEN ' event' ELSE ' events' END || ' between [' || strftime(make_timestamp(b // 1000), '%H:%M:%S') || '.' || lpad(CAST(b % 1000000000 AS VARCHAR), 9, '0') || '] and [' || strftime(make_timestamp(e // 1000), '%H:%M:%S') || '.' || lpad(CAST(e % 1000000000 AS VARCHAR), 9, '0') || '] in trace \"events\" within stream (stream class ID: 0, stream ID: ' || stream_id || ').' AS warning FROM (SELECT stream_id, day, min(ts_ns) b, max(ts_ns) e, count(*) n FROM ev GROUP BY ALL)")
def loss_warnings(spark, sf_dir):
    rows = tables.event_rows(spark, sf_dir).groupBy("trace_name", "stream_class_id", "stream_id", "packet_ord").agg(F.min("ts_ns").alias("ts_ns"), F.max("ts_ns").alias("end_ts_ns"), F.count("*").alias("disc_count"))
    return pretty.loss_warning(messages(rows.withColumn("msg_type", F.lit("DE")))).select("stream_id", "packet_ord", "warning")


# relational operations, Spark's own


@query("SELECT 'orders' AS src, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM events")
def union_ports(spark, sf_dir):
    all_ports = tables.order_rows(spark, sf_dir).unionByName(tables.lineitem_rows(spark, sf_dir)).unionByName(tables.event_rows(spark, sf_dir), allowMissingColumns=True)
    return all_ports.groupBy(F.col("trace_name").alias("src")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, user_id FROM events WHERE epoch_us(ts) * 1000 BETWEEN {BEGIN} AND {END} AND event_type = 'error'")
def filter_project(spark, sf_dir):
    return tables.between_ns(table(spark, sf_dir, "events"), "ts", BEGIN, END).where("event_type = 'error'").select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, true AS has_items FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def semi_anti(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    semi = orders.join(items.where("l_quantity > 49"), orders.o_orderkey == items.l_orderkey, "left_semi")
    anti = orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti")
    return semi.select("o_orderkey", F.lit(True).alias("has_items")).unionByName(anti.select("o_orderkey", F.lit(False).alias("has_items")))


@query("SELECT 'both' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT 'only', user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'view')")
def set_ops(spark, sf_dir):
    of = lambda t: table(spark, sf_dir, "events").where(F.col("event_type") == t).select("user_id")
    both, only = of("signup").intersect(of("error")), of("click").subtract(of("view"))
    return both.select(F.lit("both").alias("kind"), "user_id").unionByName(only.select(F.lit("only").alias("kind"), "user_id"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(count(DISTINCT k) AS BIGINT) AS sessions FROM s GROUP BY user_id"""
)
def session_gap(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    return raw.groupBy("user_id", F.session_window("t", "1 day")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT epoch_us(ts) // 21600000000 * 21600000000 AS window_us, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_type", tables.ns_of("ts").alias("ns"))
    width = 21_600_000_000_000
    return raw.groupBy((fields.whole(F.col("ns"), width) * (width // 1000)).alias("window_us"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT c_mktsegment, n_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_aggregate(spark, sf_dir):
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r, prev FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS prev FROM orders) WHERE r <= 3")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    out = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("r"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("prev"))
    return out.where("r <= 3")


@query(
    f"""WITH {EV}, p AS (SELECT user_id, ts_ns - 43200000000000 AS b, ts_ns AS e, event_id AS purchase_id FROM ev WHERE event_type = 'purchase')
SELECT v.event_id, p.purchase_id FROM ev v JOIN p ON v.user_id = p.user_id AND v.ts_ns BETWEEN b AND e WHERE v.event_type = 'view'"""
)
def interval_join(spark, sf_dir):
    """Views within half a day before a purchase of the same user."""
    rows = tables.event_rows(spark, sf_dir).select("event_id", "user_id", "ts_ns", "event_class_name")
    views = rows.where("event_class_name = 'view'").select("event_id", "user_id", "ts_ns")
    spans = rows.where("event_class_name = 'purchase'").select("user_id", (F.col("ts_ns") - 43_200_000_000_000).alias("b"), F.col("ts_ns").alias("e"), F.col("event_id").alias("purchase_id"))
    return enrich.interval_join(views, spans, ["user_id"], "ts_ns", "b", "e", 43_200_000_000_000).select("event_id", "purchase_id")


@query("SELECT l_shipmode_k, round(avg(l_quantity), 4) AS avg_q, max(l_discount) AS max_d FROM (SELECT l_orderkey % 5 AS l_shipmode_k, l_quantity, l_discount FROM lineitem) GROUP BY 1")
def sql_view(spark, sf_dir):
    """The same through a view and SQL."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("cw_lineitem")
    return spark.sql("WITH t AS (SELECT l_orderkey % 5 AS l_shipmode_k, l_quantity, l_discount FROM cw_lineitem) SELECT l_shipmode_k, round(avg(l_quantity), 4) AS avg_q, max(l_discount) AS max_d FROM t GROUP BY 1")


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) * 1000 % 1000000000 AS VARCHAR), 9, '0') AS t FROM events")
def time_text(spark, sf_dir):
    return tables.event_rows(spark, sf_dir).select("event_id", times.clock_text(F.col("ts_ns"), date=True).alias("t"))


# messages without a time, bounds as text, clocks at their limits


@query(
    f"""WITH {EV}, q AS (SELECT stream_id, event_id * 8 + 4 AS src_seq, CASE WHEN event_id % 7 > 2 THEN ts_ns END AS t FROM ev),
r AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY src_seq) AS known FROM q)
SELECT row_number() OVER (ORDER BY known NULLS FIRST, stream_id, src_seq) AS pos, CAST(stream_id AS BIGINT) AS stream_id, CAST(src_seq AS BIGINT) AS src_seq, t AS ts_ns FROM r"""
)
def mux_untimed(spark, sf_dir):
    """Three events in seven have no time: they follow the message before them in their port, or come first of all."""
    rows = tables.event_rows(spark, sf_dir)
    timed = F.when(F.col("event_id") % 7 > 2, F.col("ts_ns"))
    rows = rows.withColumn("ts_ns", timed).select("port_ord", "src_seq", "trace_name", "stream_class_id", "stream_id", "msg_type", "ts_ns")
    return mux(rows).select("pos", "stream_id", "src_seq", "ts_ns")


@query(
    """WITH d AS (SELECT date_trunc('day', min(ts) - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS midnight FROM events)
SELECT event_id FROM events, d WHERE ts BETWEEN midnight + INTERVAL 77400 SECOND + INTERVAL 500 MILLISECOND AND TIMESTAMP '2024-01-05 15:00:00'"""
)
def bounds_in_zone(spark, sf_dir):
    """From a time of day, on the first event's date in New York, to a date and time there; the bounds reach the scan."""
    zone = "America/New_York"
    raw = table(spark, sf_dir, "events")
    first = raw.agg(F.min(tables.ns_of("ts"))).first()[0]
    begin, end = (times.resolved(times.parse_bound(b, zone), first, zone) for b in ("21:30:00.5", "2024-01-05 10:00"))
    return tables.between_ns(raw, "ts", begin, end).select("event_id")


@query(
    """SELECT event_id, CASE WHEN ns BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(ns AS BIGINT) END AS ns, CAST(t - 3600000000000 + 5 AS BIGINT) AS shifted
FROM (SELECT event_id, epoch_us(ts) * 1000 AS t, (epoch_us(ts) * 1000)::HUGEINT + event_id::HUGEINT * 10000000000000000 AS ns FROM events)"""
)
def clock_limits(spark, sf_dir):
    """Times under a growing clock offset, null from where they don't fit; and times under a shifted offset."""
    ns = tables.ns_of("ts")
    return table(spark, sf_dir, "events").select("event_id", clock.cycles_to_ns(ns, offset_s=F.col("event_id") * 10_000_000).alias("ns"), clock.shifted(ns, -3600, 5).alias("shifted"))


# fields as text

_OVERLAPPING = [("low", 0, 6), ("mid", 4, 20), ("high", 15, 40), ("odd", 13, 13)]


@query(
    "SELECT event_id, '( ' || CASE len(l) WHEN 0 THEN '<unknown>' WHEN 1 THEN l[1] ELSE '{ ' || array_to_string(l, ', ') || ' }' END || ' : container = ' || v || ' )' AS enumeration FROM (SELECT event_id, v, "
    + "list_filter([" + ", ".join(f"CASE WHEN v BETWEEN {lo} AND {hi} THEN '\"{n}\"' END" for n, lo, hi in _OVERLAPPING) + "], lambda x: x IS NOT NULL) AS l FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events))"
)
def enumeration_text(spark, sf_dir):
    """Values with all their labels, where ranges overlap or none holds the value."""
    v = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select("event_id", fields.enum_text(v, _OVERLAPPING).alias("enumeration"))


@query(r"""SELECT event_id, '"' || replace(replace(replace(replace(replace(props || chr(10) || event_type || chr(9) || '\' || chr(1), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(1), '\x01') || '"' AS text FROM events""")
def string_escapes(spark, sf_dir):
    text = F.concat("props", F.lit("\n"), "event_type", F.lit("\t\\\x01"))
    return table(spark, sf_dir, "events").select("event_id", fields.escaped(text).alias("text"))


# more of the engine's own


@query("SELECT (epoch_us(ts) // 21600000000 - k) * 21600000000 AS window_us, CAST(count(*) AS BIGINT) AS n FROM events, range(4) r(k) GROUP BY ALL")
def hopping_counts(spark, sf_dir):
    """Windows of a day that begin every six hours."""
    counted = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(fields.whole(tables.ns_of("w.start"), 1000).alias("window_us"), "n")


_ABOVE = """WITH above AS (SELECT o_custkey FROM {o} o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM {o} i WHERE i.o_custkey = o.o_custkey))
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM above WHERE EXISTS (SELECT 1 FROM {c} c WHERE c.c_custkey = above.o_custkey AND c.c_nationkey < 10) GROUP BY o_custkey"""


@query(_ABOVE.format(o="orders", c="customer"))
def subqueries(spark, sf_dir):
    """A correlated scalar subquery, one in EXISTS and a common table expression, over views."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("cw_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("cw_customer")
    return spark.sql(_ABOVE.format(o="cw_orders", c="cw_customer"))


@query(
    "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS priority, CAST(length(o_orderpriority) AS INT) AS size, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, strftime(o_orderdate, '%Y-%m') AS month FROM orders"
)
def text_and_dates(spark, sf_dir):
    p, day = F.col("o_orderpriority"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.split_part(p, F.lit("-"), F.lit(1)).alias("rank"), F.lower(F.regexp_replace(p, "^[0-9]-", "")).alias("priority"), F.length(p).alias("size"), F.year(day).alias("y"), F.quarter(day).alias("q"), F.date_format(day, "yyyy-MM").alias("month"))


@query("SELECT event_id, CAST(b AS INT) AS bit, printf('%08x', user_id) AS hex FROM events, range(63) r(b) WHERE (user_id >> b) & 1 = 1")
def function_kinds(spark, sf_dir):
    """A user's table function (the set bits of a number) and a user's vectorised function; both only where built-ins would not show the interface."""

    @F.udtf(returnType="bit int")
    class SetBits:
        def eval(self, number: int):
            at = 0
            while number:
                if number & 1:
                    yield (at,)
                number, at = number >> 1, at + 1

    @F.pandas_udf("string")
    def hexed(numbers: pd.Series) -> pd.Series:
        return numbers.map("{:08x}".format)

    spark.udtf.register("cw_set_bits", SetBits)
    table(spark, sf_dir, "events").select("event_id", "user_id", hexed("user_id").alias("hex")).createOrReplaceTempView("cw_numbers")
    return spark.sql("SELECT event_id, bit, hex FROM cw_numbers, LATERAL cw_set_bits(user_id)")
