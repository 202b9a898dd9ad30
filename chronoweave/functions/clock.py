"""Clock arithmetic: cycles, nanoseconds from origin, n-bit counters, and whether clocks are comparable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def plain_ns(cycles: Column, frequency) -> Column:
    """Cycles without an offset: exact at 1 GHz, otherwise by a double, truncated."""
    f = _c(frequency)
    scaled = F.try_divide(cycles.cast("double") * F.lit(float(NS)), f.cast("double"))
    return F.when(f == NS, cycles.cast("decimal(38,0)")).otherwise(F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("decimal(38,0)"))


def cycles_to_ns(cycles: Column, frequency=NS, offset_s=0, offset_cycles=0) -> Column:
    """Nanoseconds from origin; null if they don't fit 64 bits."""
    total = _c(offset_s).cast("decimal(38,0)") * NS + plain_ns(_c(offset_cycles), frequency) + plain_ns(cycles, frequency)
    return F.when(total.between(-(2**63), 2**63 - 1), total).try_cast("long")


def ns_to_cycles(ns: Column, frequency=NS, offset_s=0, offset_cycles=0) -> Column:
    """The inverse, in integers, truncated; null before the clock's offset."""
    f = _c(frequency).cast("decimal(38,0)")
    past = ns.cast("decimal(38,0)") - _c(offset_s).cast("decimal(38,0)") * NS
    product = (past * f).cast("decimal(38,0)")
    over = F.lit(NS).cast("decimal(38,0)")
    cycles = ((product - F.pmod(product, over)) / over).cast("decimal(38,0)") - _c(offset_cycles).cast("decimal(38,0)")
    return F.when((past >= 0) & (cycles >= 0), cycles).try_cast("decimal(20,0)")


def shifted(ns: Column, offset_s: int = 0, offset_ns: int = 0) -> Column:
    """Times under a clock offset shifted by parameters; null if they don't fit."""
    return F.try_add(ns, F.lit(offset_s * NS + offset_ns))


def unwrap(df: DataFrame, value: str, bits: int, by: list[str], order: list[str], to: str = "cycles") -> DataFrame:
    """Restores an n-bit counter: a value below the one before has wrapped exactly once."""
    w = Window.partitionBy(*by).orderBy(*order)
    wrapped = F.when(F.col(value) < F.lag(value).over(w), F.lit(2**bits)).otherwise(F.lit(0)).cast("decimal(20,0)")
    return df.withColumn("_wrapped", wrapped).withColumn(to, (F.sum("_wrapped").over(w) + F.col(value)).cast("decimal(20,0)")).drop("_wrapped")


def correlation(clocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """clocks: (has_clock, unix_origin, clock_uuid, clock_id) of stream beginnings and inactivity messages.

    All must be of one kind: no clock, a clock with the Unix origin, one of a UUID, or one and the same object.
    Returns the kinds found, whether they are comparable, and what is wrong otherwise.
    """
    kind = F.when(~F.col("has_clock"), "none").when(F.col("unix_origin"), "unix").when(F.col("clock_uuid").isNotNull(), "uuid").otherwise("object")
    found = clocks.withColumn("_kind", kind).groupBy(*(by or [])).agg(
        F.count_distinct("_kind").alias("n_kinds"), F.min("_kind").alias("kind"), F.count_distinct(F.when(F.col("_kind") == "uuid", F.col("clock_uuid"))).alias("n_uuids"), F.count_distinct(F.when(F.col("_kind") == "object", F.col("clock_id"))).alias("n_objects")
    )
    wrong = F.when(F.col("n_kinds") > 1, "kinds differ").when(F.col("n_uuids") > 1, "UUIDs differ").when(F.col("n_objects") > 1, "clocks differ")
    return found.withColumn("error", wrong).withColumn("comparable", wrong.isNull())
