"""Positions in a global order without one partition for all rows.

Rows are dealt out by ranges of the whole key, with bounds that Spark samples from the rows, so a burst, an outlying time or
many rows of one time make no large range. How many ranges there are follows the size of the rows as they lie in a sort, so
that one task sorts about as much of a large table as of a small one; nothing joins ranges afterwards, as adaptive execution
would by their compressed size. The sorted ranges are written once, with the number of each row in its range; a row's
position is that plus the rows of earlier ranges. One row for each range reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, MapType, StringType, StructType

from .storage import stored

#: monotonically_increasing_id() holds the partition above this bit and the row's number in it below.
_SHIFT = 33
_AT, _RANGE, _BEFORE, _LAST = "_cw_at", "_cw_range", "_cw_before", "_cw_last"
#: What a range holds, about, in bytes of a sort.
RANGE_BYTES = 128 << 20
#: Up to ``spark.sql.shuffle.partitions``, there are more ranges than that asks for while each still has this many rows.
RANGE_ROWS = 10_000
#: Bytes of a row beside its fields: its header and what the sorter keeps for it.
_ROW_BYTES = 40


def _size(kind: DataType, at: Column) -> tuple[int, list[Column]]:
    """Bytes of a value in a row: those that every value takes, and what is added to them."""
    if isinstance(kind, StructType):
        parts = [_size(f.dataType, at.getField(f.name)) for f in kind]
        return 16 + sum(n for n, _ in parts), [c for _, more in parts for c in more]
    if isinstance(kind, (StringType, BinaryType)):
        return 16, [F.octet_length(at)]
    if isinstance(kind, (ArrayType, MapType)):
        return 32, [F.octet_length(at.cast("string"))]
    return (24 if isinstance(kind, DecimalType) else 8), []


def ranges_for(df: DataFrame) -> int:
    """How many ranges the rows of df are dealt into."""
    fixed, more = _ROW_BYTES, F.lit(0)
    for f in df.schema:
        n, added = _size(f.dataType, F.col("`" + f.name.replace("`", "``") + "`"))
        fixed += n
        for c in added:
            more = more + F.coalesce(c, F.lit(0)).cast("long")
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(more), F.lit(0))).first()
    at_least = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    return max(1, at_least, -(-(rows * fixed + size) // RANGE_BYTES))


class Ordered:
    """Rows of a table in an order, written.

    ``time``: a column whose value in the row before is wanted. ``sized``: the same rows at an earlier step that is cheaper to
    read; their size is taken there.
    """

    def __init__(self, df: DataFrame, keys: list[Column], time: str | None = None, sized: DataFrame | None = None):
        spark = df.sparkSession
        self.time = time
        self.ranges = ranges_for(df if sized is None else sized)
        dealt = df.repartitionByRange(self.ranges, *keys).sortWithinPartitions(*keys)
        rows = stored(dealt.withColumn(_AT, F.monotonically_increasing_id()), "ordered")
        self.rows = rows.withColumn(_RANGE, F.shiftright(_AT, _SHIFT))
        last = F.max_by(time, _AT) if time else F.lit(None).cast("long")
        found = self.rows.groupBy(_RANGE).agg(F.count("*").alias("n"), last.alias("last")).orderBy(_RANGE).collect()
        starts, total, before = [], 0, None
        for r in found:
            starts.append((r[_RANGE], total, before))
            total, before = total + r["n"], r["last"]
        self.total = total
        self.starts = spark.createDataFrame(starts, f"{_RANGE} long, {_BEFORE} long, {_LAST} long")

    def _placed(self) -> DataFrame:
        return self.rows.join(F.broadcast(self.starts), _RANGE)  # a row for each range

    def with_position(self, to: str = "pos") -> DataFrame:
        """The rows with 1, 2, ... in their order."""
        at = F.col(_AT).bitwiseAND(F.lit((1 << _SHIFT) - 1))
        return self._placed().withColumn(to, at + F.col(_BEFORE) + 1).drop(_AT, _RANGE, _BEFORE, _LAST)

    def with_previous(self, to: str) -> DataFrame:
        """The rows with the time of the row before, across ranges."""
        w = Window.partitionBy(_RANGE).orderBy(_AT)
        first = F.col(_AT).bitwiseAND(F.lit((1 << _SHIFT) - 1)) == 0
        before = F.when(first, F.col(_LAST)).otherwise(F.lag(self.time).over(w))
        placed = self._placed()
        if self.ranges > 1:
            placed = placed.repartition(self.ranges, _RANGE)  # else what a task of the window sorts grows with the table
        return placed.withColumn(to, before).drop(_AT, _RANGE, _BEFORE, _LAST)


def with_position(df: DataFrame, keys: list[Column], to: str = "pos", sized: DataFrame | None = None) -> DataFrame:
    return Ordered(df, keys, sized=sized).with_position(to)
