"""Field operations: floor division, enumeration labels, bit flags, display bases, escapes, event members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(x: Column, n: int) -> Column:
    """x over a positive n, rounded to minus infinity, exact for all longs (``/`` goes through doubles or rounds decimals)."""
    return F.call_function("div", x.cast("long") - F.pmod(x.cast("long"), F.lit(n).cast("long")), F.lit(n).cast("long"))


def floor_div(a: Column, b: Column) -> Column:
    """Integer division rounded to minus infinity, exact; null by zero."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.try_divide(wide(a) - wide(floor_mod(a, b)), wide(b)).cast("long")


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; null by zero."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def labels(value: Column, mappings: list[tuple[str, int, int]]) -> Column:
    """All labels whose ranges hold the value, in the order of the mappings, each once."""
    table = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for n, lo, hi in mappings))
    hit = F.filter(table, lambda m: (value.cast("long") >= m["lo"]) & (value.cast("long") <= m["hi"]))
    return F.array_distinct(F.transform(hit, lambda m: m["label"]))


def label_join(df: DataFrame, value: str, mappings: DataFrame, width: int) -> DataFrame:
    """(df columns, label) for each label of each value, as a range join bucketed by ``width``.

    mappings: (label, lo, hi), closed ranges. Each range is posted once for every bucket that it touches, so the join is on
    equality of buckets and refined inside.
    """
    bucket = lambda c: whole(F.col(c), width)
    posted = mappings.withColumn("_b", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    return df.withColumn("_b", bucket(value)).join(posted, "_b").where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))).drop("_b", "lo", "hi")


def quoted_labels(value: Column, mappings: list[tuple[str, int, int]]) -> Column:
    found = F.transform(labels(value, mappings), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.when(F.size(found) == 0, F.lit("<unknown>")).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.concat(F.lit("{ "), F.array_join(found, ", "), F.lit(" }")))


def enum_text(value: Column, mappings: list[tuple[str, int, int]]) -> Column:
    """``( labels : container = value )``"""
    return F.concat(F.lit("( "), quoted_labels(value, mappings), F.lit(" : container = "), value.cast("string"), F.lit(" )"))


def flags_text(value: Column, mappings: list[tuple[str, int, int]]) -> Column:
    """A value as its set bits' labels; unknown if negative, if a bit has no label, or if a range isn't a single bit.

    A mapping serves only if it stands for one bit: lo = hi = a power of two.
    """
    bits: dict[int, list[str]] = {}
    for name, lo, hi in mappings:
        if lo == hi and lo > 0 and lo & (lo - 1) == 0:
            bits.setdefault(lo, []).append(name)
    known = sum(bits)
    v = value.cast("long")
    parts = [F.when(v.bitwiseAND(F.lit(b)) != 0, F.lit(f'"{names[0]}"' if len(names) == 1 else "{ " + ", ".join(f'"{n}"' for n in names) + " }")) for b, names in sorted(bits.items())]
    shown = F.concat_ws(" | ", *parts) if parts else F.lit("")
    return F.when((v > 0) & (v.bitwiseAND(F.bitwise_not(F.lit(known).cast("long"))) == 0), shown).otherwise(F.lit("<unknown>"))


def in_base(value: Column, base: int, bits: int = 64) -> Column:
    """An integer in base 2, 8, 10 or 16 with its prefix; negative ones as two's complement of ``bits`` bits, but in base 10."""
    v = value.cast("long")
    if base == 10:
        return v.cast("string")
    whole = v if bits >= 64 else v.bitwiseAND(F.lit(2**bits - 1))
    if base == 16:
        return F.concat(F.lit("0x"), F.hex(whole))
    if base == 2:
        return F.concat(F.lit("0b"), F.bin(whole))
    if base == 8:
        return F.concat(F.lit("0"), F.conv(F.bin(whole), 2, 8))
    raise ValueError(f"display base {base}")


#: Escapes of control characters in printed strings.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", "\x1b": "\\e"}


def escaped(text: Column) -> Column:
    """A string in quotes with C escapes; other control characters as ``\\xNN``."""
    out = text
    for c, e in ESCAPES.items():
        out = F.replace(out, F.lit(c), F.lit(e))
    for i in [*range(1, 32), 127]:
        if chr(i) not in ESCAPES:
            out = F.replace(out, F.lit(chr(i)), F.lit(f"\\x{i:02x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def member(name: str, scopes: tuple[str, ...] = ("payload", "specific_context", "common_context", "packet_context")) -> Column:
    """An event's member by name, from the first scope (JSON text) that has it."""
    return F.coalesce(*(F.get_json_object(F.col(s), f"$.{name}") for s in scopes))


def ranges_overlap(a: Column, b: Column) -> Column:
    """Whether two sets of closed integer ranges (arrays of lo, hi) share a value."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])))


def ranges_hold(a: Column, value: Column) -> Column:
    return F.exists(a, lambda x: (x["lo"] <= value) & (value <= x["hi"]))
