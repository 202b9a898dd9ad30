"""Times as text, and bounds from text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import whole

NS = 1_000_000_000


def _parts(ns: Column) -> tuple[Column, Column]:
    """Whole seconds (floored) and the rest."""
    s = whole(ns, NS)
    return s, ns.cast("long") - s * NS


def nine(ns: Column) -> Column:
    return F.lpad(ns.cast("string"), 9, "0")


def clock_text(ns: Column, date: bool = False, seconds: bool = False) -> Column:
    """``HH:MM:SS.nnnnnnnnn`` in UTC, or with the date, or as seconds; question marks if unknown. Negative times in seconds."""
    s, rest = _parts(ns)
    up, left = _parts(F.abs(ns.cast("long")))
    plain = F.concat(F.when(ns < 0, "-").otherwise(""), up.cast("string"), F.lit("."), nine(left))
    if seconds:
        return F.coalesce(plain, F.lit("??????????.?????????"))
    day = F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss" if date else "HH:mm:ss")
    return F.coalesce(F.when(ns < 0, plain).otherwise(F.concat(day, F.lit("."), nine(rest))), F.lit(("????-??-?? " if date else "") + "??:??:??.?????????"))


def delta_text(ns: Column) -> Column:
    """``+s.nnnnnnnnn``"""
    s, rest = _parts(ns)
    return F.coalesce(F.concat(F.lit("+"), s.cast("string"), F.lit("."), nine(rest)), F.lit("+?.?????????"))


@dataclass(frozen=True)
class Bound:
    """A time bound: ns from origin, or the ns of a day to be added to the date of the first timed message."""

    ns: int
    of_day: bool = False


_DATE = r"(?P<Y>\d{4})-(?P<M>\d{2})-(?P<D>\d{2})"
_TIME = r"(?P<h>\d{1,2}):(?P<m>\d{2})(?::(?P<s>\d{2})(?:\.(?P<f>\d{1,9}))?)?"


def _fraction(digits: str | None) -> int:
    return int((digits or "0").ljust(9, "0"))


def parse_bound(text: str | int | None, zone: str = "UTC") -> Bound | None:
    """A date with or without a time, a time of day, or seconds; an integer is seconds. None is no bound."""
    if text is None:
        return None
    if isinstance(text, int):
        return Bound(text * NS)
    text = text.strip()
    if m := re.fullmatch(rf"{_DATE}(?:[ T]{_TIME})?", text):
        g = m.groupdict()
        at = datetime(int(g["Y"]), int(g["M"]), int(g["D"]), int(g["h"] or 0), int(g["m"] or 0), int(g["s"] or 0), tzinfo=ZoneInfo(zone))
        since = at.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return Bound((since.days * 86_400 + since.seconds) * NS + _fraction(g["f"]))
    if m := re.fullmatch(_TIME, text):
        g = m.groupdict()
        h, mi, s = int(g["h"]), int(g["m"]), int(g["s"] or 0)
        if h > 23 or mi > 59 or s > 60:
            raise ValueError(f"not a time of day: {text!r}")
        return Bound((h * 3600 + mi * 60 + s) * NS + _fraction(g["f"]), of_day=True)
    if m := re.fullmatch(r"(-?)(\d+)(?:\.(\d{1,9}))?", text):
        size = int(m[2]) * NS + _fraction(m[3])
        return Bound(-size if m[1] else size)
    raise ValueError(f"not a time: {text!r}")


def resolved(bound: Bound | None, first_ns: int | None, zone: str = "UTC") -> int | None:
    """The bound in ns from origin; a time of day takes the date that the first timed message has in the zone."""
    if bound is None or not bound.of_day:
        return bound and bound.ns
    if first_ns is None:
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    day = (epoch + timedelta(seconds=first_ns // NS)).astimezone(ZoneInfo(zone)).date()
    seconds, rest = divmod(bound.ns, NS)
    at = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)) + timedelta(seconds=seconds)  # on the clock of the wall
    since = at.astimezone(timezone.utc) - epoch
    return (since.days * 86_400 + since.seconds) * NS + rest
