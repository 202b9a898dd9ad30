"""Traces whose streams lie in several files and directories, with duplicates, repairs and index files."""

import json
import shutil
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import times
from chronoweave.operators import trim
from chronoweave.operators.mux import mux
from chronoweave.operators.validate import sequence_errors
from chronoweave.plans import graph
from chronoweave.schema import messages
from chronoweave.sinks import details, pretty
from chronoweave.sinks.ctf_writer import write_ctf
from chronoweave.sources.ctf import decode
from chronoweave.sources.ctf.reader import load_metadata, packet_index, read_ctf


def write(spark, path, env=None, torn=False):
    """Two streams of four packets of three events."""
    rows = []
    for s in (0, 1):
        k = 0
        for kind, t in [("SB", None), *((x, 1000 * (p + 1) + 100 * s + d) for p in range(4) for x, d in (("PB", 0), ("EV", 10), ("EV", 20), ("EV", 30), ("PE", 40))), ("SE", None)]:
            rows.append((s, k, s, kind, t))
            k += 1
    df = spark.createDataFrame(rows, "port_ord int, src_seq long, stream_id long, msg_type string, ts_ns long")
    df = df.withColumn("stream_class_id", F.lit(0).cast("long")).withColumn("event_class_id", F.when(F.col("msg_type") == "EV", 0).cast("long")).withColumn("event_class_name", F.when(F.col("msg_type") == "EV", "e"))
    write_ctf(messages(df), str(path), env=env)
    return rows


def split(path, spark):
    """The packets of each stream file."""
    trace = load_metadata(spark, str(path))
    out = {}
    for f in sorted(path.iterdir()):
        if f.name != "metadata" and not f.name.startswith("."):
            data = f.read_bytes()
            out[f.name] = [data[p["at"] // 8 : (p["at"] + p["size"]) // 8] for p in decode.packets(trace, data)]
    return out


def shape(df):
    return [(r.stream_id, r.msg_type, r.ts_ns) for r in df.orderBy("port_ord", "src_seq").collect()]


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ctf") / "whole"
    write(spark, path)
    return path


def test_streams_in_several_files(spark, trace, tmp_path):
    """Two files a stream, the later one first by name: one beginning and one end, in order."""
    whole = shape(read_ctf(spark, str(trace)))
    assert [m for _, m, _ in whole].count("SB") == 2
    at = tmp_path / "split"
    at.mkdir()
    shutil.copy(trace / "metadata", at / "metadata")
    for name, packets in split(trace, spark).items():
        (at / f"{name}_b").write_bytes(b"".join(packets[:1]))
        (at / f"{name}_a").write_bytes(b"".join(packets[1:]))
    got = read_ctf(spark, str(at))
    assert shape(got) == whole and got.select("port_ord").distinct().count() == 2
    assert sequence_errors(mux(got)).count() == 0


def test_chunks_and_duplicates(spark, trace, tmp_path):
    """Two directories of one UUID that overlap in a packet are one trace."""
    whole = shape(read_ctf(spark, str(trace)))
    paths = []
    for k, part in enumerate((slice(0, 3), slice(2, 4))):
        at = tmp_path / f"chunk{k}"
        at.mkdir()
        shutil.copy(trace / "metadata", at / "metadata")
        for name, packets in split(trace, spark).items():
            (at / name).write_bytes(b"".join(packets[part]))
        paths.append(str(at))
    for order in (paths, paths[::-1]):
        assert shape(read_ctf(spark, order)) == whole


def test_losses_between_files(spark, trace, tmp_path):
    """A packet that no file holds is a loss between the two files."""
    at = tmp_path / "gap"
    at.mkdir()
    shutil.copy(trace / "metadata", at / "metadata")
    for name, packets in split(trace, spark).items():
        (at / f"{name}_0").write_bytes(b"".join(packets[:1]))
        (at / f"{name}_1").write_bytes(b"".join(packets[2:]))
    lost = read_ctf(spark, str(at)).where("msg_type = 'DP'").orderBy("stream_id").collect()
    assert [(r.stream_id, int(r.disc_count), r.ts_ns, r.end_ts_ns) for r in lost] == [(0, 1, 1040, 3000), (1, 1, 1140, 3100)]


def test_repairs_by_tracer(spark, tmp_path):
    """A crash left the end of a packet 0: it ends where the next begins, the last one with its last event."""
    path = tmp_path / "torn"
    write(spark, path, env={"tracer_name": "lttng-ust", "tracer_major": 2, "tracer_minor": 12})
    trace = load_metadata(spark, str(path))
    for name in split(path, spark):
        data = bytearray((path / name).read_bytes())
        for p in list(decode.packets(trace, bytes(data)))[1::2]:
            head = p["at"] // 8 + struct.calcsize("<I16sIQ")
            data[head + 8 : head + 16] = bytes(8)
        (path / name).write_bytes(data)
    ends = [(r.stream_id, r.ts_ns) for r in read_ctf(spark, str(path)).where("msg_type = 'PE'").orderBy("stream_id", "src_seq").collect()]
    assert ends == [(0, 1040), (0, 3000), (0, 3040), (0, 4030), (1, 1140), (1, 3100), (1, 3140), (1, 4130)]


def test_index_files(spark, trace, tmp_path):
    """Packets come from index files where there are any; a broken one is passed over."""
    at = tmp_path / "indexed"
    shutil.copytree(trace, at)
    (at / "index").mkdir()
    want = sorted(map(tuple, (r[1:] for r in packet_index(spark, str(trace)).collect())))
    rows = {f: [r for r in packet_index(spark, str(trace)).collect() if r.path.endswith(f"/{f}")] for f in split(trace, spark)}
    for k, (name, own) in enumerate(rows.items()):
        out, offset = struct.pack(">IIII", 0xC1F1DCC1, 1, 1, 72), 0
        for r in own:
            out += struct.pack(">QQQQQQQQQ", offset, r.packet_size, r.packet_size, r.ts_begin, r.ts_end, r.events_discarded, r.stream_class_id, r.stream_id, r.packet_seq_num)
            offset += r.packet_size // 8
        (at / "index" / f"{name}.idx").write_bytes(out if k == 0 else out[:-5])
    assert sorted(map(tuple, (r[1:] for r in packet_index(spark, str(at)).collect()))) == want
    assert shape(read_ctf(spark, str(at))) == shape(read_ctf(spark, str(trace)))


def test_contexts_round_trip(spark, tmp_path):
    """Packet, common and specific contexts come back; two stream classes may use one event class ID with other types."""
    rows = [
        (0, 0, "SB", None, None, None, None, None, None), (0, 1, "PB", 10, None, '{"cpu": 3, "host": "a"}', None, None, None),
        (0, 2, "EV", 11, 0, None, '{"vpid": 7, "ip": 1.5}', '{"deep": true}', '{"n": 1}'), (0, 3, "EV", 12, 0, None, '{"vpid": 8, "ip": 2}', '{"deep": false}', '{"n": 2}'), (0, 4, "PE", 13, None, None, None, None, None), (0, 5, "SE", None, None, None, None, None, None),
        (1, 0, "SB", None, None, None, None, None, None), (1, 1, "PB", 10, None, None, None, None, None), (1, 2, "EV", 11, 0, None, '{"a": {"b": 1}}', None, '{"s": "x"}'), (1, 3, "PE", 13, None, None, None, None, None), (1, 4, "SE", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(r[0], *r) for r in rows], "port_ord int, stream_class_id long, src_seq long, msg_type string, ts_ns long, event_class_id long, packet_context string, common_context string, specific_context string, payload string")
    df = df.withColumn("stream_id", F.lit(0).cast("long")).withColumn("event_class_name", F.lit("e"))
    kinds = {(0, 0): T.StructType([T.StructField("n", T.LongType())]), (1, 0): T.StructType([T.StructField("s", T.StringType())])}
    write_ctf(messages(df), str(tmp_path / "t"), kinds)
    back = {(r.stream_class_id, r.src_seq): r for r in read_ctf(spark, str(tmp_path / "t")).collect()}
    load = lambda x: None if x is None else json.loads(x)
    for r in rows:
        got = back[r[0], r[1]]
        assert got.msg_type == r[2] and got.ts_ns == r[3] and load(got.payload) == load(r[8]) and load(got.specific_context) == load(r[7])
        assert load(got.packet_context) == load(r[5])
        common = load(got.common_context)
        assert (load(common["json"]) if common and "json" in common else common) == load(r[6])


def test_refusals(spark, tmp_path):
    df = messages(spark.createDataFrame([(0, 0, "SB", 1, None), (0, 1, "PB", 1, None), (0, 2, "DP", 2, 3), (0, 3, "PE", 4, None)], "port_ord int, src_seq long, msg_type string, ts_ns long, end_ts_ns long"))
    with pytest.raises(ValueError):
        write_ctf(df, str(tmp_path / "x"))
    write_ctf(df, str(tmp_path / "y"), ignore_discarded_packets=True)
    with pytest.raises(ValueError):
        trim.trim(messages(spark.createDataFrame([(0, 0, "EV", None)], "port_ord int, src_seq long, msg_type string, ts_ns long")).withColumn("pos", F.lit(1)), "1.5")


@pytest.mark.parametrize(("zone", "hour"), [("UTC", 10), ("America/New_York", 15), ("Asia/Tokyo", 1)])
def test_time_of_day_in_a_zone(zone, hour):
    """10:00 of the first message's date, in the zone: it is 2024-01-10 in all three."""
    noon = 1_704_888_000_000_000_000
    assert times.resolved(times.parse_bound("10:00:00.5", zone), noon, zone) == 1_704_844_800_000_000_000 + hour * 3_600_000_000_000 + 500_000_000


def test_pretty_fields_and_nested_values(spark):
    rows = [(1, "EV", 1500, "e", '{"z":1,"s":"1","t":"a\\"b\\u0001\\n","n":null,"b":true,"o":{"y":2,"x":{"deep":[1,"q"]}},"l":[],"m":[1,{"k":"v"}]}', '{"hostname":"box","procname":"app","vpid":7,"domain":"ust"}'), (2, "EV", 1600, "f", "{}", None)]
    df = messages(spark.createDataFrame(rows, "pos long, msg_type string, ts_ns long, event_class_name string, payload string, trace_env string")).withColumn("trace_name", F.lit("t"))
    text = '{ z = 1, s = "1", t = "a\\"b\\x01\\n", n = <none>, b = true, o = { y = 2, x = { deep = [ [0] = 1, [1] = "q" ] } }, l = [ ], m = [ [0] = 1, [1] = { k = "v" } ] }'
    got = [r.line for r in pretty.pretty_lines(df, {"no-delta": True}).orderBy("pos").collect()]
    assert got == [f"[00:00:00.000001500] box:app:(7) e: {text}", "[00:00:00.000001600] f: { }"]
    named = pretty.pretty_lines(df, {"no-delta": True, "name-default": "show", "field-default": "show"}).orderBy("pos").first().line
    assert named.startswith("[00:00:00.000001500] trace = t, trace:hostname = box, trace:domain = ust, trace:procname = app, trace:vpid = (7), name = e, event.fields = { z = 1")


def test_details_metadata_once(spark):
    rows = [(1, "a", "SB", 0, 0, None, None), (2, "b", "SB", 0, 0, None, None), (3, "a", "EV", 0, 0, 5, "e"), (4, "b", "EV", 0, 1, 6, "f")]
    df = messages(spark.createDataFrame(rows, "pos long, trace_name string, msg_type string, stream_class_id long, stream_id long, event_class_id long, event_class_name string")).withColumn("stream_name", F.lit("s"))
    lines = [r.line.split("\n") for r in details.details_text(df).orderBy("pos").collect()]
    assert [len(x) for x in lines] == [4, 5, 1, 1]
    assert lines[0][:3] == ["Trace 0: `a`", "  Stream `s` 0 (class 0)", "  Event class `e` (stream class 0, ID 5)"] and lines[1][0] == "Trace 1: `b`"
    bare = [r.line for r in details.details_text(df, trace_names=False, stream_names=False).orderBy("pos").collect()]
    assert bare[0].startswith("Trace 0\n  Stream 0 (class 0)\n") and all("\n" not in r.line for r in details.details_text(df, with_metadata=False).collect())


def test_unsupported_parameters_are_refused(spark):
    df = messages(spark.createDataFrame([(1, "EV", 5)], "pos long, msg_type string, ts_ns long"))
    for kind, name, params in (("sink", "text.pretty", {"color": "always"}), ("sink", "text.pretty", {"print-enum-flags": True}), ("sink", "text.details", {"color": "always"}), ("filter", "utils.debug-info", {"debug-info-dir": "/x"})):
        cls = graph.find(kind, name)
        with pytest.raises(graph.GraphError):
            cls.run(df, graph.check(params, cls.spec, name))
