"""Ranges of nearly equal weight by sampled splitters, for keys of one or more longs.

A weighted sample of keys is drawn by hash and its quantiles become the boundaries; every row finds its range by binary
search. Ranges that turn out overfull are sampled again and subdivided. Only boundaries and one sum for each range reach
the driver. The range is a column, so any later job deals the rows out alike. Rows alike in their whole key share a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_RANGE, BYTES_PER_RANGE, LEAST_RANGES, MOST_RANGES, DRAWS, OVERFULL, ROUNDS = 20_000, 256 << 20, 64, 20_000, 40, 2.0, 4
LOW, HIGH = -(2**63), 2**63 - 1
Key = tuple[int, ...]


def _drawn(keys: list[str], size: Column, per_byte: float, seed: int) -> Column:
    """A draw with a chance that follows the size; the same row is drawn the same way when a task runs again."""
    even = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)).cast("double") / float(2**53)
    return even < size * F.lit(per_byte)


def _splitters(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Quantile boundaries of weighted keys. Each is cut to as few leading parts as set it apart from the one before, so that what shares these begins its range as a whole."""
    sample.sort()
    if not sample:
        return []
    at = np.cumsum([w for _, w in sample])
    picks = np.unique(np.searchsorted(at, at[-1] * np.arange(1, parts) / parts))
    out: list[Key] = []
    for key in (sample[min(i, len(sample) - 1)][0] for i in picks):
        for n in range(1, len(key) + 1):
            cut = key[:n] + (LOW,) * (len(key) - n)
            if not out or cut > out[-1]:
                out.append(cut)
                break
    return out


def places(splitters: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """How many splitters (rows of several longs, in order) are at or below each key: a binary search over all keys at once."""
    lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(splitters), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        below, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, key in enumerate(keys):
            s = splitters[np.minimum(mid, len(splitters) - 1), k]
            below |= equal & (s < key)
            equal &= s == key
        up = open_ & (below | equal)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo.astype(np.int32)


class Ranges:
    """The boundaries of ranges over ``keys`` and the sum of sizes in each."""

    def __init__(self, keys: list[str], splitters: list[Key], sums: dict[int, int] | None = None):
        self.keys, self.splitters, self.sums = keys, splitters, sums or {}

    def column(self) -> Column:
        """The range of a row. Only the keys go through Python."""
        table = np.array(self.splitters, np.int64).reshape(-1, len(self.keys))

        @F.pandas_udf("int")
        def of(*keys: pd.Series) -> pd.Series:
            return pd.Series(places(table, [k.to_numpy(np.int64) for k in keys]))

        return of(*self.keys)


def ranges_of(keyed: DataFrame, keys: list[str], least: int = LEAST_RANGES, rows: int = ROWS_PER_RANGE, most: int = MOST_RANGES) -> Ranges:
    """keyed: a written table with long columns ``keys`` and ``size``, without nulls in these."""
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(most, max(least, n // rows, total // BYTES_PER_RANGE)))
    target = max(1, total / ranges)

    def draw(df: DataFrame, per_byte: float, seed: int) -> list[tuple[Key, float]]:
        found = df.where(_drawn(keys, F.col("size"), per_byte, seed)).select(*keys, "size").collect()
        return [(tuple(r[:-1]), max(1.0, r[-1] * per_byte)) for r in found]

    splitters = _splitters(draw(keyed, DRAWS / target, 0), ranges)
    for k in range(1, ROUNDS + 1):
        out = Ranges(keys, splitters)
        ranged = keyed.select(*keys, "size", out.column().alias("range"))
        out.sums = {r["range"]: r["b"] for r in ranged.groupBy("range").agg(F.sum("size").alias("b")).collect()}
        over = {g: b for g, b in out.sums.items() if b > OVERFULL * target}
        if not over or k == ROUNDS:
            break
        sample = draw(ranged.where(F.col("range").isin(list(over))), DRAWS * 4 / target, k)
        more: set[Key] = set()
        held = [(LOW,) * len(keys), *splitters, (HIGH,) * len(keys)]
        for g, b in over.items():
            inside = [s for s in sample if held[g] <= s[0] < held[g + 1]]
            more.update(_splitters(inside, int(2 * b / target) + 1))
        fresh = sorted(set(splitters) | more)
        if fresh == splitters:
            break
        splitters = fresh
    return out
