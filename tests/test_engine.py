"""Clocks, fields, text logs, packets, enrichment, sinks, parameters, graphs, binary traces, streams."""

import json
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import clock, fields, times
from chronoweave.operators import enrich, packets
from chronoweave.operators.mux import mux
from chronoweave.plans import facade, graph, params
from chronoweave.schema import messages
from chronoweave.sinks import count, details, pretty
from chronoweave.sinks.ctf_writer import unwritable_losses, write_ctf
from chronoweave.sources import textlog
from chronoweave.sources.ctf import decode, tsdl
from chronoweave.sources.ctf.reader import PacketIndexError, packet_index, parse_index, read_ctf, trace_infos
from chronoweave.streaming import live


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_clocks(spark):
    c = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    got = one(spark, *(clock.cycles_to_ns(c(v), f, s, o).alias(f"x{i}") for i, (v, f, s, o) in enumerate([(5, 1, 100, 0), (2**64 - 1, 10**9, 0, 0), (7, 10**6, -3, 2), (10, 33_333_333, 0, 0), (2**63 - 1, 10**9, 0, 0)])))
    assert tuple(got) == (105 * 10**9, None, -3 * 10**9 + 9000, 300, 2**63 - 1)
    got = one(spark, *(clock.ns_to_cycles(F.lit(v).cast("long"), f, s, o).cast("long").alias(f"x{i}") for i, (v, f, s, o) in enumerate([(105 * 10**9, 1, 100, 0), (5, 10**9, 1, 0), (1999, 10**6, 0, 0)])))
    assert tuple(got) == (5, None, 1)
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([250, 3, 2, 9])], "s int, i int, v long")
    assert [int(r.cycles) for r in clock.unwrap(rows, "v", 8, ["s"], ["i"]).orderBy("i").collect()] == [250, 259, 514, 521]
    assert one(spark, clock.shifted(F.lit(2**63 - 1).cast("long"), 1))[0] is None


def test_fields(spark):
    ranges = [("single", 1, 1), ("single2", 2, 2), ("single3", 4, 4), ("range", 4, 8), ("range2", 15, 20)]
    text = lambda v: one(spark, fields.enum_text(F.lit(v), ranges))[0]
    assert text(1) == '( "single" : container = 1 )' and text(7) == '( "range" : container = 7 )' and text(4) == '( { "single3", "range" } : container = 4 )' and text(21).startswith("( <unknown>")
    bits = [("bit0", 1, 1), ("bit0bis", 1, 1), ("bit1", 2, 2), ("bit3", 4, 4), ("bit4", 8, 8), ("bit5", 16, 16), ("bit5", 32, 32)]
    flag = lambda v: one(spark, fields.flags_text(F.lit(v), bits))[0]
    assert flag(12) == '"bit3" | "bit4"' and flag(68) == "<unknown>" and flag(3) == '{ "bit0", "bit0bis" } | "bit1"' and flag(48) == '"bit5" | "bit5"' and flag(-1) == "<unknown>"
    got = one(spark, fields.floor_div(F.lit(-7), F.lit(2)), fields.floor_mod(F.lit(-7), F.lit(2)), fields.floor_div(F.lit(1), F.lit(0)), fields.in_base(F.lit(-1), 16, 8), fields.in_base(F.lit(8), 8), fields.escaped(F.lit('a"\n\x01')))
    assert tuple(got) == (-4, 1, None, "0xFF", "010", '"a\\"\\n\\x01"')
    a = F.array(F.struct(F.lit(1).alias("lo"), F.lit(5).alias("hi")))
    b = F.array(F.struct(F.lit(5).alias("lo"), F.lit(9).alias("hi")))
    assert tuple(one(spark, fields.ranges_overlap(a, b), fields.ranges_hold(a, F.lit(6)))) == (True, False)


def test_times(spark):
    got = one(spark, times.clock_text(F.lit(1_704_067_323_000_000_005)), times.clock_text(F.lit(-1_500_000_000)), times.clock_text(F.lit(None).cast("long")), times.clock_text(F.lit(5), seconds=True), times.delta_text(F.lit(2_000_000_001)))
    assert tuple(got) == ("00:02:03.000000005", "-1.500000000", "??:??:??.?????????", "0.000000005", "+2.000000001")
    got = one(spark, times.clock_text(F.lit(1_999_999_999)), times.delta_text(F.lit(999_999_999)), fields.floor_div(F.lit(10**15 - 1), F.lit(10**15)), fields.whole(F.lit(-1), 10**9), fields.whole(F.lit(2**63 - 1), 2), clock.ns_to_cycles(F.lit(1_999_999_999).cast("long"), 1).cast("long"))
    assert tuple(got) == ("00:00:01.999999999", "+0.999999999", 0, -1, 2**62 - 1, 1)


def test_text_log(spark, tmp_path):
    p = tmp_path / "log"
    p.write_text("[87166.510937] a\n[1.5] b\n[2024-01-02 03:04:05.006] c\n   \n\nplain\n[x] y\n")
    got = textlog.read_text_log(spark, str(p)).orderBy("src_seq").collect()
    events = [(r.ts_ns, json.loads(r.payload)["str"]) for r in got if r.msg_type == "EV"]
    assert [r.msg_type for r in got] == ["SB"] + ["EV"] * 5 + ["SE"]
    assert events == [(87_166_510_937_000, "a"), (1_000_005_000, "b"), (1_704_164_645_006_000_000, "c"), (None, "plain"), (None, "[x] y")]
    assert textlog.read_text_log(spark, str(p), scaled=True).where("payload like '%\"b\"%'").first().ts_ns == 1_500_000_000
    raw = textlog.read_text_log(spark, str(p), extract=False).where("msg_type = 'EV'").orderBy("src_seq").collect()
    assert raw[0].ts_ns is None and json.loads(raw[0].payload)["str"] == "[87166.510937] a"


def packet_rows(spark, rows):
    return spark.createDataFrame([("t", s, *r) for s, r in rows], "trace_name string, stream_id int, packet_ord int, ts_begin long, ts_end long, packet_seq_num long, events_discarded long").withColumn("first_event_ns", F.col("ts_begin") + 1).withColumn("last_event_ns", F.col("ts_end") - 1)


def test_losses_and_repairs(spark):
    gap = packet_rows(spark, [(1, (0, 0, 9, 4, 0)), (1, (1, 10, 19, 5, 2)), (1, (2, 20, 29, 8, 2)), (2, (0, 0, 5, 0, 3)), (2, (1, 6, 9, 4, 1))])
    got = {(r.stream_id, r.packet_ord, r.msg_type): (r.begin_ns, r.end_ns, r.disc_count, r.broken) for r in packets.losses(gap).collect()}
    assert got == {(1, 1, "DE"): (9, 19, 2, False), (1, 2, "DP"): (19, 20, 2, False), (2, 0, "DE"): (0, 5, None, False), (2, 1, "DE"): (5, 9, None, True), (2, 1, "DP"): (5, 6, 3, False)}
    torn = gap.withColumn("ts_end", F.when((F.col("packet_ord") == 1) & (F.col("stream_id") == 1), 0).otherwise(F.col("ts_end")))
    assert {(r.stream_id, r.packet_ord): r.ts_end for r in packets.crashed(torn).collect()}[1, 1] == 20
    assert [r.ts_end for r in packets.events_after_packet(gap.where("stream_id = 1")).orderBy("packet_ord").collect()] == [10, 20, 28]
    assert [(r.ts_begin, r.ts_end) for r in packets.events_before_packet(gap.where("stream_id = 1")).orderBy("packet_ord").collect()] == [(0, 11), (11, 21), (21, 29)]
    assert packets.repairs_for({"tracer_name": "barectf", "tracer_major": 2, "tracer_minor": 3}) == ["events_before_packet"] and packets.repairs_for({"tracer_name": "barectf", "tracer_major": 2, "tracer_minor": 3, "tracer_patch": 1}) == []
    same = gap.withColumn("packet_size", F.lit(1))
    assert packets.without_duplicates(same.unionByName(same.withColumn("packet_ord", F.col("packet_ord") + 10))).count() == 5


def test_intersections(spark):
    r = spark.createDataFrame([("a", 0, 10), ("a", 5, 20), ("b", 0, 4), ("b", 5, 9), ("c", None, 9)], "trace_name string, begin_ns long, end_ns long")
    got = {x.trace_name: (x.begin_ns, x.end_ns, x.error) for x in packets.intersections(r).collect()}
    assert got["a"] == (5, 10, None) and got["b"][2] == "streams don't intersect" and got["c"][2] == "a stream has no range"


def test_debug_info(spark):
    ch = spark.createDataFrame([("t", 1, 1, "load", 100, 50, "/l/a.so", True), ("t", 1, 2, "load", 100, 9, "/l/b.so", True), ("t", 1, 5, "unload", 100, 0, None, None), ("t", 1, 6, "load", 200, 0, "/l/z.so", True), ("t", 1, 7, "load", 120, 50, "/bin/c", False), ("t", 1, 9, "clear", 0, 0, None, None)], "trace_name string, vpid int, pos long, kind string, baddr long, memsz long, path string, is_pic boolean")
    maps = enrich.lifetimes(ch)
    assert sorted((r.lo, r.hi, r.path, r.valid_from, r.valid_to) for r in maps.collect()) == [(100, 150, "/l/a.so", 1, 5), (120, 170, "/bin/c", 7, 9)]
    ev = spark.createDataFrame([("t", 1, p, ip) for p, ip in ((1, 110), (4, 149), (4, 150), (5, 110), (8, 130), (9, 130))], "trace_name string, vpid int, pos long, ip long")
    sym = spark.createDataFrame([("/l/a.so", 0, "f", "f.c:1"), ("/l/a.so", 20, "g", "g.c:2")], "path string, addr long, func string, src string")
    got = sorted((r.pos, r.ip, r.debug_bin, r.debug_func, r.debug_src) for r in enrich.debug_info(ev, maps, bucket=16, symbols=sym).collect())
    assert got == [(1, 110, "a.so+0xa", "f", "f.c:1"), (4, 149, "a.so+0x31", "g", "g.c:2"), (4, 150, "", "", ""), (5, 110, "", "", ""), (8, 130, "c@0x82", "", ""), (9, 130, "", "", "")]


def test_sinks(spark):
    df = messages(spark.createDataFrame([(1, "SB", 0, None, None), (2, "EV", 1500, "e", '{"a":1,"b":"x"}'), (3, "EV", 2500, "f", None), (4, "DE", 2600, None, None)], "pos long, msg_type string, ts_ns long, event_class_name string, payload string"))
    df = df.withColumn("trace_name", F.lit("t")).withColumn("stream_class_id", F.lit(0).cast("long")).withColumn("stream_id", F.lit(1).cast("long")).withColumn("event_class_id", F.lit(3).cast("long")).withColumn("end_ts_ns", F.when(F.col("msg_type") == "DE", F.lit(2700)).cast("long"))
    text = count.report(count.count_messages(df))
    assert "              2 Event messages" in text and text.endswith("              4 messages (TOTAL)") and "              1 Stream beginning message\n" in text
    assert len(count.report(count.count_messages(df), hide_zero=True).splitlines()) == 4
    lines = [r.line for r in pretty.pretty_lines(df).orderBy("pos").collect()]
    assert lines == ['[00:00:00.000001500] (+?.?????????) e: { a = 1, b = "x" }', "[00:00:00.000002500] (+0.000001000) f: "]
    assert pretty.loss_warning(df).first().warning == 'WARNING: Tracer may have discarded events between [00:00:00.000002600] and [00:00:00.000002700] in trace "t" within stream (stream class ID: 0, stream ID: 1).'
    assert [r.line for r in details.details_lines(df).orderBy("pos").collect()][:2] == ["[0 0] {0 0 1} Stream beginning", "[1,500 1,500] {0 0 1} Event `e` (3)"]
    assert details.metadata_blocks(df).first().block.startswith("Trace 0: `t`\n  Stream 1 (class 0)")
    assert [(r.block, r.msg_type, r.n) for r in count.count_blocks(df, 2).orderBy("block", "msg_type").collect()][-1] == (1, "SB", 1)
    count.consume(df)


def test_params():
    assert params.parse_params('a=1, b="x\\"y", c=[yes, 0x10, -0b11, null], d={e=1.5, f=[]}, g=+7, h=word') == {"a": 1, "b": 'x"y', "c": [True, 16, -3, None], "d": {"e": 1.5, "f": []}, "g": 7, "h": "word"}
    assert params.parse_params("") == {} and params.extend({"a": 1, "b": {"x": 1}}, {"b": {"y": 2}}) == {"a": 1, "b": {"y": 2}}
    assert not params.equal({"a": 1}, {"a": 1.0}) and not params.equal(True, 1) and params.equal([1, {"a": None}], [1, {"a": None}])
    for bad in ("a", "a=", "=1", "a=[1", "a={b}", "a=1 b=2"):
        with pytest.raises(params.ParamError):
            params.parse_params(bad)
    with pytest.raises(params.ParamError):
        params.check({"x": 1}, {}, "c")


def test_graph(spark):
    df = messages(spark.createDataFrame([(0, i, "EV", i) for i in range(5)], "port_ord int, src_seq long, msg_type string, ts_ns long"))
    made = graph.ComponentClass("source", "test.rows", lambda s, p: df)
    g = graph.Graph(spark).add("in", "source", made).add("mux", "filter", "utils.muxer").add("trim", "filter", "utils.trimmer", {"begin": "0.000000002", "gmt": True}).add("out", "sink", "utils.counter")
    g.connect("in", "mux").connect("mux", "trim").connect("tr*", "out")
    assert "3 Event messages" in g.run()["out"]
    for bad in (lambda: g.add("in", "source", made), lambda: g.connect("in", "trim"), lambda: g.connect("no", "mux"), lambda: g.add("x", "sink", "ctf.fs"), lambda: g.connect("out", "mux"), lambda: graph.find("sink", "none"), lambda: graph.Graph(spark).run()):
        with pytest.raises(graph.GraphError):
            bad()
    assert {("sink", "utils.counter"), ("source", "ctf.fs"), ("filter", "utils.trimmer")} <= {(k, n) for k, n, _ in graph.list_components()}
    assert graph.greatest_version(0, 1) == 0 and facade.split_timerange("[1, 2]") == ("1", "2")




def test_field_classes():
    u = tsdl.parse_type
    assert decode.decode_value(u("integer { size = 32; }"), struct.pack(">I", 7), "be") == 7 and decode.decode_value(u("u32"), struct.pack("<I", 9)) == 9
    assert decode.decode_value(u("struct { u8 a; s16 b; }"), b"\x05\xfe\xff") == {"a": 5, "b": -2} and decode.decode_value(u("struct { }"), b"") == {}
    variant = u("struct { enum : u8 { MEOW, MIX, } tag; variant <tag> { u16 MEOW; nt_str MIX; } var; }")
    assert decode.decode_value(tsdl.Array(variant, 2), b"\x00" + struct.pack("<H", 1995) + b"\x01hello there!\0") == [{"tag": 0, "var": 1995}, {"tag": 1, "var": "hello there!"}]
    assert decode.decode_value(u("struct { u8 n; integer { size = 4; } v[n]; }"), b"\x03\x21\x03") == {"n": 3, "v": [1, 2, 3]}
    assert decode.decode_value(u("struct { integer { size = 3; } a; integer { size = 5; signed = true; } b; }"), bytes([0b101_10101]), "be") == {"a": 0b101, "b": 0b10101 - 32}
    bits = decode.Bits(bytes([0b1010_0110, 0b1111_0000]), "be")
    assert (bits.take(3, "be"), bits.take(7, "be")) == (0b101, 0b0011011)
    bits = decode.Bits(bytes([0b1010_0110, 0b1111_0000]), "le")
    assert (bits.take(3, "le"), bits.take(7, "le")) == (0b110, 0b0010100)
    assert decode.decode_value(u("floating_point { exp_dig = 11; mant_dig = 53; }"), struct.pack("<d", 1.5)) == 1.5
    assert decode.decode_value(u("struct { integer { size = 8; encoding = UTF8; } s[4]; }"), b"ab\0\0") == {"s": "ab"}
    for bad in ("integer { size = 65; }", "floating_point { exp_dig = 5; mant_dig = 11; }", "nothing", "struct { u8 a }"):
        with pytest.raises(tsdl.MetadataError):
            u(bad)


def test_small_trace(spark, tmp_path):
    (tmp_path / "metadata").write_text("/* CTF 1.8 */\ntrace { major = 1; minor = 8; byte_order = le; };\nevent { name = ev; fields := struct { integer { size = 8; } a; integer { size = 8; align = 16; } b[0]; integer { size = 8; } c; }; };\n")
    (tmp_path / "stream").write_bytes(bytes([1, 2, 3]))
    got = read_ctf(spark, str(tmp_path)).orderBy("src_seq").collect()
    assert [r.msg_type for r in got] == ["SB", "PB", "EV", "PE", "SE"] and json.loads(got[2].payload) == {"a": 1, "b": [], "c": 3}
    # the array's alignment counts even when it is empty, so c is the third byte


def test_trace_round_trip(spark, tmp_path):
    path = str(tmp_path / "trace")
    rows = []
    for s in (0, 1):
        t = 10 * s
        rows += [(s, "SB", None, None, None, None, None), (s, "PB", t + 1, None, None, None, None)] + [(s, "EV", t + 2 + i, None, None, i % 2, json.dumps({"n": i, "f": i / 2, "s": f"é{i}", "l": [1, i]})) for i in range(4)] + [(s, "PE", t + 9, None, None, None, None), (s, "DE", t + 9, t + 15, 3, None, None), (s, "DP", t + 9, t + 12, 2, None, None), (s, "PB", t + 12, None, None, None, None), (s, "EV", t + 13, None, None, 0, json.dumps({"n": 7, "f": 1.0, "s": "", "l": []})), (s, "PE", t + 15, None, None, None, None), (s, "SE", None, None, None, None, None)]
    df = spark.createDataFrame([(s, i, s, m, t, e, n, c, p) for i, (s, m, t, e, n, c, p) in enumerate(rows)], "port_ord int, src_seq long, stream_id long, msg_type string, ts_ns long, end_ts_ns long, disc_count long, event_class_id long, payload string")
    df = df.withColumn("stream_class_id", F.lit(0).cast("long")).withColumn("event_class_name", F.when(F.col("event_class_id").isNotNull(), F.concat(F.lit("e"), F.col("event_class_id").cast("string"))))
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("l", T.ArrayType(T.IntegerType()))])
    write_ctf(messages(df), path, {0: kind, 1: kind})
    back = read_ctf(spark, path, trace_name="t")
    want = [(s, m, t, e, n, c, None if p is None else json.loads(p)) for s, m, t, e, n, c, p in rows]
    key = lambda r: (r[0], r[1], r[2] or 0)
    got = [(r.stream_id, r.msg_type, r.ts_ns, r.end_ts_ns, None if r.disc_count is None else int(r.disc_count), r.event_class_id, None if r.payload is None else {k: v for k, v in json.loads(r.payload).items() if not k.startswith("_")}) for r in back.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert packet_index(spark, path).count() == 4
    assert [(r.begin_ns, r.end_ns) for r in trace_infos(spark, path).orderBy("port").collect()] == [(1, 15), (11, 25)]
    assert graph.run_query(spark, "source", "ctf.fs", "support-info", {"input": path, "type": "directory"})["weight"] == 0.75
    assert not graph.run_query(spark, "source", "ctf.fs", "metadata-info", {"path": path})["is-packetized"]
    assert len(graph.run_query(spark, "source", "ctf.fs", "trace-infos", {"inputs": [path]})) == 2
    found = facade.discover(spark, [str(tmp_path)])
    assert [(s.name, s.params) for s in found] == [("ctf.fs", {"inputs": [path]})]
    whole = facade.TraceCollection(spark, [str(tmp_path)])
    assert whole.events().count() == 10 and facade.TraceCollection(spark, [path], begin=None, end="0.000000013").events().count() == 7
    cut = facade.TraceCollection(spark, [path], intersection=True).events()
    assert sorted(r.ts_ns for r in cut.collect()) == [12, 13, 13, 14, 15]
    assert "10 Event messages" in facade.convert(spark, [path], "utils.counter")
    with pytest.raises(graph.GraphError):
        facade.discover(spark, [str(tmp_path / "none")])
    assert unwritable_losses(mux(messages(df))).count() == 0


def test_packetized_metadata():
    text = b"trace { major = 1; minor = 8; byte_order = be; };"
    packet = struct.pack(">I16sIII", tsdl.PACKET_MAGIC, b"u" * 16, 0, (37 + len(text)) * 8, (40 + len(text)) * 8) + b"\0" * 5 + text + b"\0" * 3
    assert tsdl.parse_metadata(packet).order == "be"


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(i * 10**9, "EV", 0, 0) for i in range(100)], "ts_ns long, msg_type string, stream_id int, port_ord int").write.parquet(str(src))
    stream = spark.readStream.schema("ts_ns long, msg_type string, stream_id int, port_ord int").parquet(str(src))
    counts = live.window_counts(live.merged_ports([live.trimmed_stream(stream, 10 * 10**9, 89 * 10**9)], "10 seconds"), "20 seconds")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("cw_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("cw_counts").collect()) == [10, 10, 20, 20, 20]
    df = spark.createDataFrame([("DE", 5, 20, 10), ("DE", 5, 9, 10), ("EV", 5, None, 10), ("EV", 11, None, 10)], "msg_type string, ts_ns long, end_ts_ns long, inactive_ns long")
    assert [(r.ts_ns, r.late) for r in live.clamp_losses(df).collect()] == [(10, False), (5, True), (5, True), (11, False)]
    late = live.clamp_losses(df)
    seen = []
    for c in ("trace_name", "stream_class_id", "stream_id", "port_ord", "src_seq"):
        late = late.withColumn(c, F.lit(None).cast("string"))
    live.ordered_batches(lambda b, n: seen.append(b.count()), lambda b: seen.append(-b.count()))(late, 0)
    assert seen == [-2, 2]
    with pytest.raises(live.LateMessage):
        live.ordered_batches(lambda b, n: None, strict=True)(late, 0)


def test_correlation(spark):
    rows = [Row(has_clock=True, unix_origin=False, clock_uuid="a", clock_id=1), Row(has_clock=True, unix_origin=False, clock_uuid="b", clock_id=2)]
    assert clock.correlation(spark.createDataFrame(rows)).first().error == "UUIDs differ"


def test_packet_index_files():
    head = lambda minor, size: struct.pack(">IIII", 0xC1F1DCC1, 1, minor, size)
    entry = lambda o, b, e: struct.pack(">QQQQQQQQQ", o, 80, 72, b, e, 1, 0, 5, o)
    got = parse_index(head(1, 72) + entry(0, 1, 2) + entry(10, 3, 4), 20)
    assert [(x["offset"], x["stream_id"], x["packet_seq_num"]) for x in got] == [(0, 5, 0), (10, 5, 10)]
    for bad in (b"", head(1, 72)[:-1] + b"\0", head(1, 72) + entry(0, 2, 1), head(1, 72) + entry(5, 1, 2) + entry(5, 3, 4), head(1, 72) + entry(0, 1, 2)[:-3]):
        with pytest.raises(PacketIndexError):
            parse_index(bad)
    with pytest.raises(PacketIndexError):
        parse_index(head(1, 72) + entry(0, 1, 2), 11)


def test_as_of_buckets(spark):
    ev = spark.createDataFrame([(k, t) for k in (1, 2) for t in range(0, 100, 3)], "k int, t long")
    st = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 40, "c"), (2, 99, "d")], "k int, t long, v string")
    for strict in (False, True):
        plain, dealt = (sorted(map(tuple, enrich.as_of(ev, st, ["k"], "t", ["v"], strict, bucket=b).collect()), key=str) for b in (None, 10))
        assert plain == dealt and len(plain) == 68
        assert (2, 99, None if strict else "d") in plain


def test_identifiers(spark):
    maps = spark.createDataFrame([("t", 1, 100, 150, "a", True, 1, 9)], "trace_name string, vpid int, lo long, hi long, path string, is_pic boolean, valid_from long, valid_to long")
    ids = spark.createDataFrame([("t", 1, 2, 100, "b1", None, None), ("t", 1, 3, 100, None, "l", 7), ("t", 1, 4, 100, "b2", None, None), ("t", 1, 9, 100, "late", None, None)], "trace_name string, vpid int, pos long, baddr long, build_id string, debug_link string, debug_crc long")
    r = enrich.with_identifiers(maps, ids).first()
    assert (r.build_id, r.debug_link, r.debug_crc) == ("b2", "l", 7)


def test_plugins_and_command_line(spark, tmp_path, capsys):
    from chronoweave.__main__ import main

    (tmp_path / "chronoweave_plugin_x.py").write_text("from chronoweave.plans.graph import component\n\n@component('sink', 'test.x')\ndef x(df, p):\n    'Says x.'\n    return 'x'\n")
    assert main(["--plugin-path", str(tmp_path), "list"]) == 0 and "sink.test.x: Says x." in capsys.readouterr().out
    log = tmp_path / "log"
    log.write_text("[1.000001] a\n[2.000002] b\n")
    run = ["run", "--component", f'in:source.text.dmesg:path="{log}"', "--component", "m:filter.utils.muxer", "--component", "out:sink.utils.counter:hide-zero=yes", "--connect", "in:m", "--connect", "m:out"]
    assert main(run) == 0 and "2 Event messages" in capsys.readouterr().out
    assert main(["query", "source.ctf.fs", "none"]) == 1 and "GraphError" in capsys.readouterr().err


def test_stateful_losses(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "stream_id long, packet_ord long, ts_begin long, ts_end long, packet_seq_num long, events_discarded long"
    src = tmp_path / "in"
    for part in ([(1, 0, 0, 9, 4, 0), (1, 1, 10, 19, 5, 2)], [(1, 2, 20, 29, 8, 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    q = live.streaming_losses(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.outputMode("append").format("memory").queryName("cw_losses").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.packet_ord, r.msg_type): (r.begin_ns, r.end_ns, r.disc_count) for r in spark.table("cw_losses").collect()}
    assert got == {(1, "DE"): (9, 19, 2), (2, "DP"): (19, 20, 2)}
