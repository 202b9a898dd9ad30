"""Restriction of a merged sequence to a time range that leaves it well formed.

Both bounds are inclusive. The lower one is a seek: rows before the first with a time in range vanish, and every stream
that is alive there begins anew at the bound (with its open packet, if it has one). The upper one is a cut: the first row past
it ends the sequence, and every stream that is open there is ended at the bound. A beginning or an end that is made up has a
time only if its stream has shown one. Losses across a bound are clamped to it and lose their count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import Bound, parse_bound, resolved
from ..schema import STREAM, messages
from .position import Ordered
from .storage import stored


def _is(*types: str) -> Column:
    return F.col("msg_type").isin(*types)


def _state(df: DataFrame, order: str) -> DataFrame:
    """Of each stream: whether it began and ended, whether a packet is open, whether a time was seen, its last packet."""
    known = df.where(~_is("MI"))
    return known.groupBy(*STREAM).agg(
        F.max(_is("SB").cast("int")).alias("began"),
        F.max(_is("SE").cast("int")).alias("ended"),
        F.sum(F.when(_is("PB"), 1).when(_is("PE"), -1).otherwise(0)).alias("open"),
        F.count("ts_ns").alias("timed"),
        F.max_by(F.struct("packet_ord", "packet_context"), F.when(_is("PB"), F.col(order))).alias("packet"),
        F.max_by(F.struct("port_ord", "stream_class_name", "stream_name"), F.col(order)).alias("names"),
    )


def _made(state: DataFrame, at: int, packet: str, stream: str) -> DataFrame:
    """Rows at a bound: a stream's and, if a packet is open, the packet's, in the order of stream identity."""
    pair = [F.struct(F.lit(stream).alias("m"), F.lit(0).alias("k")), F.when(F.col("open") > 0, F.struct(F.lit(packet).alias("m"), F.lit(1).alias("k")))]
    rows = state.withColumn("_r", F.explode(F.filter(F.array(*pair), lambda x: x.isNotNull())))
    time = F.when((F.col("_r.m") == packet) | (F.col("timed") > 0), F.lit(at).cast("long"))
    is_packet = F.col("_r.m") == packet
    out = rows.select(
        *STREAM, F.col("_r.m").alias("msg_type"), time.alias("ts_ns"), F.col("names.port_ord").alias("port_ord"), F.col("names.stream_class_name").alias("stream_class_name"), F.col("names.stream_name").alias("stream_name"),
        F.when(is_packet, F.col("packet.packet_ord")).alias("packet_ord"), F.when(is_packet, F.col("packet.packet_context")).alias("packet_context"), (1 - F.col("_r.k") if packet == "PE" else F.col("_r.k")).alias("_k"),
    )
    order = Window.orderBy(*(F.col(c).asc_nulls_last() for c in STREAM), "_k")  # a row or two for each stream
    return messages(out.withColumn("_n", F.row_number().over(order)).drop("_k"))


def trim_ns(df: DataFrame, begin: int | None = None, end: int | None = None, store: bool = True) -> DataFrame:
    """df: a message table with ``pos``. Bounds in ns from origin, None for none. Returns it trimmed, with new ``pos``.

    The input is read several times (where to begin, what is alive there, where to cut, what is open there), so it is stored
    first; where to begin and to cut are then filters on ``pos`` that reach the scan.
    """
    if begin is not None and end is not None and begin > end:
        raise ValueError("the range begins after its end")
    written = getattr(df, "_cw_written", False)
    df = messages(df)
    if begin is None and end is None:
        return df
    if store and not written:
        df = stored(df, "trim")
    loss = _is("DE", "DP")
    shift = 0
    fresh = None
    if begin is not None:
        reaches = (F.col("ts_ns") >= begin) | (loss & (F.col("end_ts_ns") >= begin))
        start = df.where(reaches).agg(F.min("pos")).first()[0]
        skipped = df if start is None else df.where(F.col("pos") < start)
        made = _made(_state(skipped, "pos").where("began = 1 and ended = 0"), begin, "PB", "SB")
        fresh = made.withColumn("pos", F.col("_n").cast("long")).drop("_n")
        if store:
            fresh = stored(fresh, "fresh")  # a row or two for each stream
        df = df.limit(0) if start is None else df.where(F.col("pos") >= start)
        shift = fresh.count() - (start or 1) + 1
        moved = loss & (F.col("ts_ns") < begin)
        df = df.withColumn("disc_count", F.when(~F.coalesce(moved, F.lit(False)), F.col("disc_count"))).withColumn("ts_ns", F.when(moved, F.lit(begin).cast("long")).otherwise(F.col("ts_ns")))

    def whole(rest: DataFrame) -> DataFrame:
        rest = rest.withColumn("pos", F.col("pos") + F.lit(shift))
        return rest if fresh is None else fresh.unionByName(rest, allowMissingColumns=True)

    if end is None:
        return whole(df)
    cut = df.where(F.col("ts_ns") > end).agg(F.min("pos")).first()[0]
    crossing = loss & (F.col("end_ts_ns") > end)
    kept = df if cut is None else df.where(F.col("pos") < cut)
    kept = kept.withColumn("disc_count", F.when(~F.coalesce(crossing, F.lit(False)), F.col("disc_count"))).withColumn("end_ts_ns", F.when(crossing, F.lit(end).cast("long")).otherwise(F.col("end_ts_ns")))
    out = whole(kept)
    if cut is None:
        return out
    closing = _made(_state(out, "pos").where("began = 1 and ended = 0"), end, "PE", "SE")
    closing = closing.withColumn("pos", F.col("_n").cast("long") + F.lit(cut + shift - 1)).drop("_n")
    return out.unionByName(closing, allowMissingColumns=True)


def _key() -> Column:
    """What a merge of rows that all have a time orders them by, absent identities last."""
    parts = [F.struct(F.col(c).isNull().alias("absent"), F.col(c).alias("value")).alias(c) for c in STREAM]
    return F.struct("ts_ns", *parts, "port_ord", "src_seq")


def _literal(row, kind: StructType) -> Column:
    """A row as a struct of literals."""
    return F.struct(*((_literal(row[f.name], f.dataType) if isinstance(f.dataType, StructType) else F.lit(row[f.name]).cast(f.dataType)).alias(f.name) for f in kind))


def trim_timed(df: DataFrame, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Merges ports in which every row has a time and trims them, as trim_ns does with merged rows; only what is left is sorted.

    Where to begin and to cut are the least keys of rows in range and of rows past the end, from one aggregate; what is alive
    or open there follows from one more each. No position is needed before the end.
    """
    if begin is not None and end is not None and begin > end:
        raise ValueError("the range begins after its end")
    df = messages(df).withColumn("_key", _key())
    loss = _is("DE", "DP")
    reaches = F.lit(True) if begin is None else (F.col("ts_ns") >= begin) | F.coalesce(loss & (F.col("end_ts_ns") >= begin), F.lit(False))
    past = F.lit(False) if end is None else F.col("ts_ns") > end
    at = df.agg(F.min(F.when(reaches, F.struct(F.col("_key").alias("k")))).alias("start"), F.min(F.when(past, F.struct(F.col("_key").alias("k")))).alias("cut"))
    found, kind = at.first(), df.schema["_key"].dataType
    start, cut = (found[c] and found[c]["k"] for c in ("start", "cut"))
    kept, fresh, n_fresh = df, None, 0
    if begin is not None:
        skipped = df if start is None else df.where(F.col("_key") < _literal(start, kind))
        made = _made(_state(skipped, "_key").where("began = 1 and ended = 0"), begin, "PB", "SB")
        fresh = stored(made.withColumn("pos", F.col("_n").cast("long")).drop("_n"), "fresh")  # a row or two for each stream
        n_fresh = fresh.count()
        # the filter on the time alone can reach a scan
        kept = df.limit(0) if start is None else df.where((F.col("ts_ns") >= F.lit(start["ts_ns"])) & (F.col("_key") >= _literal(start, kind)))
    if cut is not None:
        kept = kept.where((F.col("ts_ns") <= F.lit(cut["ts_ns"])) & (F.col("_key") < _literal(cut, kind)))
    if begin is not None:
        moved = F.coalesce(loss & (F.col("ts_ns") < begin), F.lit(False))
        kept = kept.withColumn("disc_count", F.when(~moved, F.col("disc_count"))).withColumn("ts_ns", F.when(moved, F.lit(begin).cast("long")).otherwise(F.col("ts_ns")))
    if end is not None:
        crossing = F.coalesce(loss & (F.col("end_ts_ns") > end), F.lit(False))
        kept = kept.withColumn("disc_count", F.when(~crossing, F.col("disc_count"))).withColumn("end_ts_ns", F.when(crossing, F.lit(end).cast("long")).otherwise(F.col("end_ts_ns")))
    if start is None and begin is not None:
        rest, n = kept.drop("_key").withColumn("pos", F.lit(0).cast("long")), 0
    else:
        ordered = Ordered(kept, [F.col("_key").asc()])
        rest, n = ordered.with_position().drop("_key").withColumn("pos", F.col("pos") + F.lit(n_fresh)), ordered.total
    out = rest if fresh is None else fresh.unionByName(rest, allowMissingColumns=True)
    if cut is None:
        return out
    closing = _made(_state(out, "pos").where("began = 1 and ended = 0"), end, "PE", "SE")
    closing = closing.withColumn("pos", F.col("_n").cast("long") + F.lit(n_fresh + n)).drop("_n")
    return out.unionByName(closing, allowMissingColumns=True)


def trim(df: DataFrame, begin: str | int | None = None, end: str | int | None = None, zone: str = "UTC") -> DataFrame:
    """Bounds as text (see parse_bound); a time of day takes the date of the first timed message, both in the zone.

    Events, packets and losses without a time are refused if there is a bound.
    """
    b, e = parse_bound(begin, zone), parse_bound(end, zone)
    if (b is not None or e is not None) and not untrimmable(df).isEmpty():
        raise ValueError("messages without a time can't be trimmed")
    first = None
    if any(isinstance(x, Bound) and x.of_day for x in (b, e)):
        first = df.where("ts_ns is not null").agg(F.min_by("ts_ns", "pos")).first()[0]
    return trim_ns(df, resolved(b, first, zone), resolved(e, first, zone))


def untrimmable(df: DataFrame) -> DataFrame:
    """Rows that a trimmer refuses: events, packets and losses without a time."""
    return messages(df).where(_is("EV", "PB", "PE", "DE", "DP") & F.col("ts_ns").isNull())
