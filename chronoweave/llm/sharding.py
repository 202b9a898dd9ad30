"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. A size-weighted sample of keys is drawn by
hash; its quantiles are the boundaries of many ranges, and every row goes to its range by binary search. A range that
turns out overfull is sampled again on its own and subdivided, by doc_id where one text alone fills it. With the exact
bytes of each range known, a row's place in the order is the bytes of earlier ranges plus a running sum inside its
range, and its shard follows from that place. Nothing larger than a row for each range reaches the driver.

A group of equal texts of up to ``whole`` of a shard stays in one shard; larger ones are cut where a shard is full.
Sizes therefore differ from the mean by at most ``whole`` of a shard and one document.

Null text: no bytes, size 1. Repeated rows take one slot each. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .ranges import LOW, ranges_of

SHARDS, WHOLE = 16, 0.01


def shard_documents(docs: DataFrame, shards: int = SHARDS, whole: float = WHOLE) -> DataFrame:
    """docs: (doc_id, text, ...). Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.coalesce("doc_id", F.lit(LOW)).alias("d"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), "doc_id")
    keyed = materialize(keyed, "keyed")
    ranges = ranges_of(keyed, ["h", "d"])
    ranged, sums = keyed.withColumn("range", ranges.column()), ranges.sums
    total = sum(sums.values())
    before = 0
    prefix = []
    for g in sorted(sums):
        prefix.append((g, before))
        before += sums[g]
    spark = docs.sparkSession
    starts = spark.createDataFrame(prefix or [(0, 0)], "range int, before long")
    inside = Window.partitionBy("range").orderBy("h", "d")
    same = Window.partitionBy("range", "h")
    placed = ranged.join(F.broadcast(starts), "range").withColumn("sum_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("rank", F.row_number().over(inside))
    placed = placed.withColumn("group_size", F.sum("size").over(same)).withColumn("group_start", F.min("sum_before").over(same))
    small = F.col("group_size") <= F.lit(int(whole * total / shards))
    place = F.col("before") + F.when(small, F.col("group_start") + F.expr("group_size div 2")).otherwise(F.col("sum_before") + F.expr("size div 2"))
    shard = F.least(F.lit(shards - 1), F.floor(place.cast("decimal(38,0)") * F.lit(shards) / F.lit(max(1, total)).cast("decimal(38,0)"))).cast("int")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "range", "rank", shard.alias("shard")), "placed")
    counts = placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()
    seen = [0] * shards
    offsets = []
    for r in sorted(counts, key=lambda r: (r["range"], r["shard"])):
        offsets.append((r["range"], r["shard"], seen[r["shard"]] - r["first"]))
        seen[r["shard"]] += r["n"]
    at = spark.createDataFrame(offsets or [(0, 0, 0)], "range int, shard int, shift long")
    out = placed.join(F.broadcast(at), ["range", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard_documents(table(spark, sf_dir, "documents"))
