"""Merging of ports into one order: what a merge that compares only the heads of the ports gives, as a sort.

A port keeps its own order. A message without a time goes out as soon as it is the head of its port, right after the
message before it; so it is sorted by the last known time of its port, and before all else if there was none. Messages of one time
are ordered by the identity of their stream, then by port, then by their order in the port. Only if ports share an
identity must their heads be compared one by one; such groups of one time and identity are merged on their own.
"""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COLUMNS, RANKS, STREAM, messages
from .position import with_position

_IDENTITY = ["a_uuid", "a_name", "a_class", "a_stream"]
_HEADS = ["stream_name", "stream_class_name", "event_class_id", "event_class_name", "log_level", "emf_uri", "end_ts_ns", "disc_count", "clock_name"]


def _plain(x):
    return None if x is None or x is pd.NA or x != x else x


def _order(a, b, absent_first: bool) -> int:
    a, b = _plain(a), _plain(b)
    if a is None or b is None:
        side = -1 if absent_first else 1
        return 0 if a is None and b is None else side if a is None else -side
    return (a > b) - (a < b)


def compare_heads(a: dict, b: dict) -> int:
    """Order of two messages of one time and one stream identity."""
    rank = RANKS[a["msg_type"]] - RANKS[b["msg_type"]]
    if rank:
        return rank
    keys: list[tuple[str, bool]] = []
    if a["msg_type"] == "EV":
        keys += [("event_class_id", False), ("event_class_name", True), ("log_level", False), ("emf_uri", True)]
    if a["msg_type"] in ("DE", "DP"):
        keys += [("end_ts_ns", False), ("disc_count", False)]
    if a["msg_type"] == "MI":
        keys += [("clock_name", True)]
    keys += [("stream_name", True), ("stream_class_name", True)]
    for k, absent_first in keys:
        c = _order(a.get(k), b.get(k), absent_first)
        if c:
            return c
    return 0


def merge_heads(rows: list[dict]) -> list[dict]:
    """Head-by-head merge of the rows of several ports, all of one time and identity."""
    ports: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["port_ord"], r["src_seq"])):
        ports.setdefault(r["port_ord"], []).append(r)
    queues = {p: list(reversed(q)) for p, q in ports.items()}
    out = []
    while queues:
        best = min(queues, key=cmp_to_key(lambda p, q: compare_heads(queues[p][-1], queues[q][-1]) or p - q))
        out.append(queues[best].pop())
        if not queues[best]:
            del queues[best]
    return out


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    done = merge_heads(pdf.to_dict("records"))
    return pd.DataFrame({"port_ord": [r["port_ord"] for r in done], "src_seq": [r["src_seq"] for r in done], "tie": range(len(done))})


def mux(df: DataFrame, timed: bool = False, shared_identity: bool = False) -> DataFrame:
    """df: a message table with (port_ord, src_seq). Returns it with ``pos``, 1 and on in the merged order.

    timed: every row has a time, so no port needs a window. shared_identity: ports may share trace name, UUID, stream
    class and stream ID, so their equal times are compared head by head.
    """
    # columns that df lacks are null in every row: they aren't moved and sorted, but added at the end
    kept = {"port_ord", "src_seq", "msg_type", "ts_ns", *STREAM, *df.columns}
    df = messages(df)
    df = df.drop(*(c for c in COLUMNS if c not in kept))
    at, identity = "eff_ts", _IDENTITY
    if timed:
        keyed, at, identity = df, "ts_ns", STREAM
    else:
        own = F.struct(*(F.col(c).alias(a) for c, a in zip(STREAM, _IDENTITY, strict=True)))
        w = Window.partitionBy("port_ord").orderBy("src_seq").rowsBetween(Window.unboundedPreceding, 0)
        anchor = F.last(F.when(F.col("ts_ns").isNotNull(), own), ignorenulls=True).over(w)
        keyed = df.withColumn("eff_ts", F.last("ts_ns", ignorenulls=True).over(w)).withColumn("_id", F.coalesce(anchor, own))
        keyed = keyed.select("*", *(F.col(f"_id.{a}").alias(a) for a in _IDENTITY)).drop("_id")
    keys = [F.col(a).asc_nulls_last() for a in identity]
    if shared_identity:
        group = [at, *identity]
        several = keyed.groupBy(*group).agg(F.min("port_ord").alias("p"), F.max("port_ord").alias("q")).where("p <> q").drop("p", "q")
        same = [keyed[c].eqNullSafe(several[c]) for c in group]
        tied = keyed.join(several, same, "left_semi")
        heads = [c for c in _HEADS if c in keyed.columns]
        ties = tied.select(*group, "port_ord", "src_seq", "msg_type", *heads).groupBy(*group).applyInPandas(_merge_group, "port_ord int, src_seq long, tie long")
        keyed = keyed.join(ties, ["port_ord", "src_seq"], "left")
        keys.append(F.coalesce("tie", F.lit(0)).asc())
    out = with_position(keyed, [F.col(at).asc_nulls_first(), *keys, F.col("port_ord").asc(), F.col("src_seq").asc()], sized=df)
    out = messages(out.drop("eff_ts", *_IDENTITY, "tie"))
    out._cw_written = True  # type: ignore[attr-defined]
    return out
