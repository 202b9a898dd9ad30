"""Trimmer and muxer against the golden cases in FIXTURES.md and a literal head-by-head merge."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import times
from chronoweave.operators import mux as mux_module
from chronoweave.operators.mux import mux
from chronoweave.operators.trim import trim, trim_ns
from chronoweave.operators.validate import sequence_errors, well_formed
from chronoweave.schema import ddl, messages

FIXTURES = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
CASES = re.findall(r"^\| ([yn]) \| ([yn]) \| (—|\d+) \| (—|\d+) \| (.*?) \| (\d+) \|$", FIXTURES, re.M)


def trace_rows(times_known: bool, packets: bool):
    at = lambda t: (10_000 + t) * 10**9
    rows = [("SB", at(100) if times_known else None, None, None)]
    rows += [("PB", at(200), 0, None)] if packets else []
    p = 0 if packets else None
    rows += [("EV", at(300), p, 0), ("EV", at(400), p, 1)]
    rows += [("PE", at(900), 0, None)] if packets else []
    return [*rows, ("SE", at(1000) if times_known else None, None, None)]


def table(spark, rows):
    return messages(spark.createDataFrame([(i + 1, 0, i, 0, 0, m, t, p, e) for i, (m, t, p, e) in enumerate(rows)], "pos long, port_ord int, src_seq long, stream_class_id long, stream_id long, msg_type string, ts_ns long, packet_ord long, event_class_id long"))


def shown(df):
    out = []
    rows = sorted(df.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(1, len(rows) + 1))
    for r in rows:
        name = f"E{r['event_class_id'] + 1}" if r["msg_type"] == "EV" else r["msg_type"]
        out.append(f"{name}@{'?' if r['ts_ns'] is None else r['ts_ns'] // 10**9 - 10_000}")
    return " ".join(out) or "(empty)"


def test_all_cases_are_there():
    assert len(CASES) == 56


@pytest.mark.parametrize("known,packets,begin,end,expected,line", CASES)
def test_trim_golden(spark, known, packets, begin, end, expected, line):
    df = table(spark, trace_rows(known == "y", packets == "y"))
    got = trim(df, None if begin == "—" else begin, None if end == "—" else end)
    assert shown(got) == expected


def test_trim_losses(spark):
    rows = spark.createDataFrame([(1, "DE", 10, 30, 5), (2, "DP", 22, 24, 3), (3, "DE", 24, 40, 2), (4, "DE", 26, 40, 2)], "pos long, msg_type string, ts_ns long, end_ts_ns long, disc_count int")
    got = [(r.ts_ns, r.end_ts_ns, r.disc_count) for r in trim_ns(messages(rows), 20, 25).orderBy("pos").collect()]
    assert got == [(20, 25, None), (22, 24, 3), (24, 25, None)]
    with pytest.raises(ValueError):
        trim_ns(messages(rows), 5, 4)


def test_bounds():
    ns = lambda x: times.parse_bound(x).ns
    assert ns("2024-01-02") == 1_704_153_600 * 10**9 and ns("2024-01-02 03:04:05.5") == (1_704_153_600 + 11_045) * 10**9 + 500_000_000
    assert ns("10.5") == 10_500_000_000 and ns("-3.25") == -3_250_000_000 and ns(7) == 7 * 10**9 and times.parse_bound(None) is None
    assert times.parse_bound("03:04").of_day and times.resolved(times.parse_bound("03:04"), ns("2024-01-02 22:00")) == ns("2024-01-02 03:04:00")
    assert times.parse_bound("2024-07-01 00:00", "America/Montreal").ns == ns("2024-07-01 04:00")
    for bad in ("x", "2024-1-2x", "1.2.3"):
        with pytest.raises(ValueError):
            times.parse_bound(bad)


def ports(spark, rows):
    """rows: dicts with port_ord, src_seq, msg_type, ts_ns and more."""
    full = [{"trace_uuid": None, "trace_name": None, "stream_class_id": 0, "stream_id": 0} | r for r in rows]
    names = [f.split()[0] for f in ddl("clock_name string").split(", ") if not f.startswith("0)")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ddl("clock_name string"))


def two(port1: dict, port2: dict):
    """Two ports, each SB at 0 and SE at 193 times its number."""
    return [{"port_ord": p, "src_seq": k, "msg_type": m, "ts_ns": t} | own for p, own in ((1, port1), (2, port2)) for k, (m, t) in enumerate((("SB", 0), ("SE", 193 * p)))]


MUX = [
    ("trace name", {"trace_name": "rouyn"}, {"trace_name": "noranda"}, 2),
    ("stream name", {"stream_name": "port-daniel"}, {"stream_name": "gascon"}, 2),
    ("stream without name", {"stream_name": "one"}, {}, 2),
    ("stream id", {"stream_id": 5}, {"stream_id": 3}, 2),
    ("stream class id", {"stream_class_id": 5}, {"stream_class_id": 3}, 2),
    ("stream class name", {"stream_class_name": "one"}, {"stream_class_name": "two"}, 1),
    ("stream class without name", {"stream_class_name": "one"}, {}, 2),
    ("absent trace name last", {}, {"trace_name": "a"}, 2),
]


@pytest.mark.parametrize("case,one,other,first", MUX)
def test_mux_golden(spark, case, one, other, first):
    got = mux(ports(spark, two(one, other)), shared_identity=True).orderBy("pos").collect()
    assert got[0]["port_ord"] == first and [r["ts_ns"] for r in got] == [0, 0, 193, 386]


def test_mux_event_classes_and_inactivity(spark):
    for key, a, b, first in (("event_class_name", "Hull", "Gatineau", 2), ("event_class_id", 1, 2, 1)):
        rows = [{"port_ord": p, "src_seq": k, "msg_type": m, "ts_ns": t, key: v} for p, v in ((1, a), (2, b)) for k, (m, t) in enumerate((("SB", p), ("EV", 50), ("SE", 60 + p)))]
        got = [r["port_ord"] for r in mux(ports(spark, rows), shared_identity=True).orderBy("pos").collect() if r["ts_ns"] == 50]
        assert got[0] == first
    rows = [{"port_ord": p, "src_seq": 0, "msg_type": "MI", "ts_ns": 0, "clock_name": n, "stream_class_id": None, "stream_id": None} for p, n in ((1, "La Baie"), (2, "Chicoutimi"))]
    assert [r["port_ord"] for r in mux(ports(spark, rows), shared_identity=True).orderBy("pos").collect()] == [2, 1]


def test_mux_several_ports(spark):
    spec = [("hello", 0, 0, "SB", 1), ("hello", 0, 1, "EV", 2), ("meow", 0, 1, "PB", 3), ("meow", 1, 1, "EV", 4)]
    rows = [{"port_ord": p, "src_seq": 0, "msg_type": m, "ts_ns": 25, "trace_name": n, "stream_class_id": c, "stream_id": s} for n, c, s, m, p in reversed(spec)]
    assert [r["port_ord"] for r in mux(ports(spark, rows)).orderBy("pos").collect()] == [1, 2, 3, 4]
    rows = [{"port_ord": p, "src_seq": k, "msg_type": m, "ts_ns": t, "stream_id": p} for p, b in ((1, 0), (2, 120), (3, 4)) for k, (m, t) in enumerate((("SB", b), ("SE", 193 * p)))]
    assert [r["ts_ns"] for r in mux(ports(spark, rows)).orderBy("pos").collect()] == [0, 4, 120, 193, 386, 579]


def literal_merge(rows):
    """Head-by-head: a head without a time goes first, then the smallest time, identity, type."""
    queues = {}
    for r in sorted(rows, key=lambda r: (r["port_ord"], r["src_seq"])):
        queues.setdefault(r["port_ord"], []).append(r)
    last = (lambda x: (x is None, x or ""))
    out = []
    while any(queues.values()):
        heads = [q[0] for q in queues.values() if q]
        best = min(heads, key=lambda r: (r["ts_ns"] is not None, r["ts_ns"] or 0, last(r["trace_name"]), r["stream_class_id"], r["stream_id"], r["port_ord"]))
        queues[best["port_ord"]].pop(0)
        out.append((best["port_ord"], best["src_seq"]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_mux_random(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(rng.randrange(2, 6)):
        t, k = rng.randrange(5), 0
        known = rng.random() < 0.5
        kinds = ["SB"] + ["EV"] * rng.randrange(1, 12) + ["SE"]
        for m in kinds:
            t += rng.choice([0, 0, 1, 2])
            rows.append({"port_ord": p, "src_seq": k, "msg_type": m, "ts_ns": t if known or m == "EV" else None, "trace_name": rng.choice(["a", "b"]) if k == 0 else rows[-1]["trace_name"], "stream_class_id": 0, "stream_id": p})
            k += 1
    got = [(r["port_ord"], r["src_seq"]) for r in mux(ports(spark, rows)).orderBy("pos").collect()]
    assert got == literal_merge(rows)
    assert mux_module.merge_heads([]) == []


def test_sequence_checks(spark):
    assert well_formed(table(spark, trace_rows(True, True))) and well_formed(table(spark, trace_rows(False, False)), packets=False)
    for drop in range(6):
        rows = trace_rows(True, True)
        kind = rows.pop(drop)[0]
        errors = sequence_errors(table(spark, rows)).collect()
        assert bool(errors) == (kind not in ("EV", "SE")), kind
    fall = trace_rows(True, True)
    fall[2], fall[3] = fall[3], fall[2]
    assert [r["error"] for r in sequence_errors(table(spark, fall)).collect()] == ["time falls"]
    other = trace_rows(True, True)
    other[2] = ("EV", other[2][1], 7, 0)
    assert [r["error"] for r in sequence_errors(table(spark, other)).collect()] == ["other packet"]
    assert trim_ns(table(spark, []), 1, 2).count() == 0 and F is not None
