"""Whether a message table is well formed: legal successions in each stream, times that never fall, packets that match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STREAM, messages

#: What may follow what in a stream with packets; None is the beginning. DE is inside or outside of a packet.
WITH_PACKETS = {None: "SB", "SB": "SE PB DP DE", "EV": "EV DE PE", "PB": "EV PE DE", "PE": "PB SE DE DP", "DE in": "DE EV PE", "DE out": "DE SE PB DP", "DP": "DP PB SE DE", "SE": ""}
WITHOUT_PACKETS = {None: "SB", "SB": "SE EV DE", "EV": "EV DE SE", "DE out": "DE SE EV", "SE": ""}


def sequence_errors(df: DataFrame, packets: bool = True, order: str = "pos") -> DataFrame:
    """Rows that break a contract, with what is wrong: succession, packet or time."""
    df = messages(df)
    w = Window.partitionBy(*STREAM).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.sum(F.when(F.col("msg_type") == "PB", 1).when(F.col("msg_type") == "PE", -1).otherwise(0)).over(so_far)
    port = Window.partitionBy("port_ord").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", F.lag("msg_type").over(w).alias("_before"), (F.coalesce(opened, F.lit(0)) > 0).alias("_open"), F.last(F.when(F.col("msg_type") == "PB", F.col("packet_ord")), ignorenulls=True).over(so_far).alias("_packet"), F.max("ts_ns").over(port).alias("_latest"))
    before = F.when(F.col("_before") == "DE", F.when(F.col("_open"), F.lit("DE in")).otherwise(F.lit("DE out"))).otherwise(F.col("_before"))
    legal = F.lit(False)
    for state, after in (WITH_PACKETS if packets else WITHOUT_PACKETS).items():
        follows = F.col("msg_type").isin(*after.split()) if after else F.lit(False)
        legal = F.when(before.isNull() if state is None else before == state, follows).otherwise(legal)
    wrong_packet = F.col("_open") & F.col("msg_type").isin("EV", "PE") & ~F.col("packet_ord").eqNullSafe(F.col("_packet"))
    error = F.when(F.col("ts_ns") < F.col("_latest"), "time falls").when((F.col("msg_type") != "MI") & ~legal, "illegal succession").when(wrong_packet, "other packet")
    return rows.withColumn("error", error).where("error is not null").drop("_before", "_open", "_packet", "_latest")


def well_formed(df: DataFrame, packets: bool = True, order: str = "pos") -> bool:
    return sequence_errors(df, packets, order).isEmpty()
