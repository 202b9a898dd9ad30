"""Counts of messages by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import whole
from ..schema import RANKS, TITLES

DEFAULT_STEP = 10_000


def count_messages(df: DataFrame, hide_zero: bool = False, total: bool = True) -> DataFrame:
    """(msg_type, n) for each of the eight types, and TOTAL."""
    spark = df.sparkSession
    types = spark.createDataFrame([(t,) for t in RANKS], "msg_type string")
    found = df.groupBy("msg_type").agg(F.count("*").alias("n"))
    out = types.join(F.broadcast(found), "msg_type", "left").select("msg_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # eight rows
    if total:
        out = out.unionByName(found.agg(F.lit("TOTAL").alias("msg_type"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
    return out.where("n > 0 or msg_type = 'TOTAL'") if hide_zero else out


def count_blocks(df: DataFrame, step: int = DEFAULT_STEP) -> DataFrame:
    """(block, msg_type, n): counts so far after every ``step`` messages by ``pos``, and after the last."""
    from pyspark.sql import Window

    per = df.groupBy(whole(F.col("pos") - 1, step).alias("block"), "msg_type").agg(F.count("*").alias("n"))
    blocks = per.select("block").distinct()
    types = per.select("msg_type").distinct()
    grid = blocks.crossJoin(F.broadcast(types))  # at most eight types
    w = Window.partitionBy("msg_type").orderBy("block")
    return grid.join(per, ["block", "msg_type"], "left").select("block", "msg_type", F.sum(F.coalesce("n", F.lit(0))).over(w).cast("long").alias("n"))


def report(counts: DataFrame, hide_zero: bool = False) -> str:
    """The counts as a text block; a line for each type, the total last."""
    found = {r["msg_type"]: r["n"] for r in counts.collect()}
    total = found.pop("TOTAL", sum(found.values()))
    lines = [f"{n:15d} {TITLES[t]} message{'' if n == 1 else 's'}" for t in TITLES if (n := found.get(t, 0)) or not hide_zero]
    return "\n".join([*lines, f"{total:15d} message{'' if total == 1 else 's'} (TOTAL)"])


def consume(df: DataFrame) -> None:
    """Runs the plan and throws the rows away."""
    df.write.format("noop").mode("overwrite").save()
