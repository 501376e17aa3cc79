"""Capture files, decoding, predicates, records, correlation and streams on small captures."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.functions import predicates as P
from tidewire.functions import scalars
from tidewire.model import PACKETS, as_packets, field, first_layer, layer, warnings
from tidewire.operators import catalog, correlate, follow, project, select, stats
from tidewire.sources import captures, decode, records


def ip(text: str) -> bytes:
    return bytes(map(int, text.split(".")))


def frame(l4: str, src: str, dst: str, sp: int, dp: int, payload: bytes = b"") -> bytes:
    proto = {"TCP": 6, "UDP": 17}[l4]
    head = struct.pack(">HHIIBBHHH", sp, dp, 1, 0, 5 << 4, 0x18, 0, 0, 0) if l4 == "TCP" else struct.pack(">HHHH", sp, dp, 8 + len(payload), 0)
    body = head + payload
    v4 = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + ip(src) + ip(dst)
    return bytes.fromhex("020000000001020000000002") + b"\x08\x00" + v4 + body


DNS = struct.pack(">HHHHHH", 7, 0, 1, 0, 0, 0) + b"\x07example\x03com\x00" + struct.pack(">HH", 1, 1)
MIXED = [
    frame("TCP", "10.0.0.1", "10.0.0.2", 5000, 80),
    frame("UDP", "10.0.0.2", "10.0.0.1", 12345, 54321),
    frame("TCP", "10.0.0.2", "10.0.0.1", 443, 8080),
    frame("UDP", "10.0.0.3", "10.0.0.2", 5353, 53, DNS),
    frame("TCP", "10.0.0.1", "10.0.0.2", 6000, 443),
]


def pcap(frames, order="<", magic=captures.MICRO, link=1) -> bytes:
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", k + 1, 500, len(f), len(f) + 10) + f
    return out


def pcapng(frames) -> bytes:
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(captures.SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(captures.INTERFACE, struct.pack("<HHI", 1, 0, 65535))
    for k, f in enumerate(frames):
        ticks = (k + 1) * 1_000_000 + 500
        out += block(captures.ENHANCED, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f) + 10) + f + b"\0" * (-len(f) % 4))
    return out


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cap") / "mixed.pcap"
    path.write_bytes(pcap(MIXED))
    return decode.decode(captures.read_capture(spark, str(path))).cache()


@pytest.mark.parametrize(
    "condition, expected",
    [
        (lambda: P.has_layer("tcp") & P.field_eq("tcp.dst_port", 80), [1]),
        (lambda: P.has_layer("udp") | P.field_gt("tcp.src_port", 1024), [1, 2, 4, 5]),
        (lambda: ~P.has_layer("dns"), [1, 2, 3, 5]),
        (lambda: P.field_in("ipv4.src", ["10.0.0.1", "10.0.0.2"]), [1, 2, 3, 5]),
        (lambda: P.field_between("tcp.dst_port", 80, 443), [1, 5]),
        (lambda: P.number_between(2, 4), [2, 3, 4]),
        (lambda: ~P.field_eq("tcp.dst_port", 80), [2, 3, 4, 5]),
        (lambda: P.field_ne("tcp.dst_port", 80), [3, 5]),
        (lambda: P.field_lt("ipv4.ttl", 300), []),
        (lambda: P.field_eq("dns.questions", "EXAMPLE.com"), [4]),
        (lambda: P.field_eq("dns.questions.type", 1) & P.field_eq("dns.qr", 0), [4]),
        (lambda: P.field_eq("dns.qr", "Query"), []),
        (lambda: P.field_eq("ethernet.src", "02-00-00-00-00-02"), [1, 2, 3, 4, 5]),
        (lambda: P.field_gt("ipv4.src", "10.0.0.1"), []),
    ],
)
def test_predicates(mixed, condition, expected):
    assert sorted(r.number for r in mixed.where(condition()).collect()) == expected


def test_argument_errors():
    for bad in (lambda: P.field_in("a.b", []), lambda: P.parse_numbers("5-1"), lambda: P.parse_numbers("0"), lambda: P.parse_numbers(""), lambda: P.packet_number("<", 1), lambda: P.number_in([]), lambda: decode.check_overrides([("x", 1, "a")]), lambda: decode.check_overrides([("tcp.port", 70000, "a")]), lambda: project.check_pattern("a*b"), lambda: project.check_pattern("*"), lambda: project.check_pattern("a.b.c")):
        with pytest.raises(ValueError):
            bad()
    assert P.parse_numbers("1,5,10-20") == [(1, 1), (5, 5), (10, 20)]


def test_any_element_and_first_field(spark):
    made = layer(0, "X", field("v", "u8", F.lit(1)), field("v", "u8", F.lit(2)), field("list.n", "u8", F.lit(1), elem=(0,)), field("list.n", "u8", F.lit(9), elem=(1,)), field("t", "u8", F.lit(3), F.lit("Three")))
    df = as_packets(spark.range(1).select(F.lit("c").alias("capture_id"), F.lit(1).alias("number"), F.array(made).alias("layers")))
    holds = lambda c: df.where(c).count() == 1
    assert holds(P.field_eq("x.v", 1)) and not holds(P.field_eq("x.v", 2))  # side by side: the first
    assert holds(P.field_eq("x.list.n", 9)) and holds(P.field_ne("x.list.n", 9))  # elements: any
    assert holds(P.field_between("x.list.n", 5, 20)) and holds(P.field_between("x.list.n", 2, 8))  # each end by itself
    assert holds(P.field_eq("x.t_name", "three")) and holds(P.field_ne("x.t_name", "two")) and not holds(P.field_gt("x.t_name", "a"))


def test_formats_ranges_and_errors(spark, tmp_path):
    for name, data in (("a.pcap", pcap(MIXED * 40)), ("b.pcap", pcap(MIXED, ">")), ("c.pcapng", pcapng(MIXED)), ("d.pcap", pcap([])), ("e.pcapng", pcapng([])), ("f.pcap", pcap(MIXED, magic=captures.NANO))):
        (tmp_path / name).write_bytes(data)
    got = captures.read_capture(spark, str(tmp_path), rangeBytes=500)
    assert got.rdd.getNumPartitions() > 10
    rows = sorted((r.capture_id, r.number, r.length, r.original_length, bytes(r.raw)) for r in got.collect())
    assert [r[1] for r in rows if r[0] == "a.pcap"] == list(range(1, 201)) and all(r[4] == MIXED[(r[1] - 1) % 5] and r[3] == r[2] + 10 for r in rows)
    assert {r[0] for r in rows} == {"a.pcap", "b.pcap", "c.pcapng", "f.pcap"}
    assert {r.ts_us for r in got.where("number = 2 and capture_id <> 'f.pcap'").collect()} == {2_000_500}
    assert got.where("number between 100 and 102 and capture_id = 'a.pcap'").count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.pcap").write_bytes(pcap(MIXED)[:-3])
    with pytest.raises(Exception):
        captures.read_capture(spark, str(tmp_path / "bad")).collect()


def test_export_round_trip(spark, mixed, tmp_path):
    captures.write_capture(mixed.where(P.has_layer("tcp")), str(tmp_path / "out"))
    back = captures.read_capture(spark, str(tmp_path / "out")).orderBy("ts_us").collect()
    assert [bytes(r.raw) for r in back] == [MIXED[0], MIXED[2], MIXED[4]] and [r.ts_us for r in back] == [1_000_500, 3_000_500, 5_000_500]


def test_undecodable(spark):
    rows = [("c", 1, 1000, 3, 3, 1, b"abc"), ("c", 2, 2000, 3, 3, 147, MIXED[0]), ("c", 3, 3000, 3, 3, 1, MIXED[0][:40]), ("c", 4, 0, 3, 3, 1, MIXED[0])]
    df = decode.decode(spark.createDataFrame(rows, captures.SCHEMA))
    assert {r.number: r.decode_error for r in warnings(df).collect()} == {1: "truncated frame", 2: "unknown link type", 3: "truncated packet"}
    seen = stats.overview(df).first()
    assert seen.total_packets == 4 and stats.protocol_counts(df).count() == 3
    assert project.summarise(df).where("number = 1").first().protocol == "???"


def test_port_overrides(spark, mixed):
    again = decode.decode(mixed.select("capture_id", "number", "ts_us", "length", "original_length", "link_type", "raw"), [("udp.port", 54321, "DNS"), ("udp.port", 53, "other")])
    assert {r.number: r.stack for r in again.collect()}[4] == "Ethernet:IPv4:UDP:other"


def test_paging(mixed):
    assert [r.number for r in select.page(mixed, sample=2).collect()] == [1, 3, 5]
    assert [r.number for r in select.page(mixed, sample=2, offset=1, count=1).collect()] == [3]
    assert select.page(mixed, count=0).count() == 0 and select.page_with_more(mixed, count=4)[1] and not select.page_with_more(mixed, count=5)[1]
    with pytest.raises(ValueError):
        select.sample_every(mixed, 0)


def test_ordinal_across_buckets(spark):
    r = random.Random(1)
    rows = [(c, n) for c in "ab" for n in r.sample(range(1, 5000), 700)]
    df = spark.createDataFrame(rows, "capture_id string, number long").repartition(7)
    want = {(c, n): k + 1 for c in "ab" for k, n in enumerate(sorted(n for d, n in rows if d == c))}
    assert all(want[x.capture_id, x.number] == x.ordinal for x in select.ordinal(df, bucket=64).collect())


def test_visibility(mixed):
    shown = project.visible_fields(mixed, {"UDP": ["src_port"], "DNS": ["id", "questions.na*"]})
    r = shown.where("number = 4").select(first_layer("UDP").alias("u"), first_layer("DNS").alias("d"), first_layer("IPv4").alias("i")).first()
    assert [f.path for f in r.u.fields] == ["src_port"] and [f.path for f in r.d.fields] == ["id", "questions.name"] and len(r.i.fields) == 4


def test_summary_lines(mixed):
    got = {r.number: r.info for r in project.summarise(mixed).collect()}
    assert got[1] == "5000 → 80" and got[2] == "12345 → 54321" and got[4] == "Query example.com"
    assert [r.time for r in project.summarise(mixed, "relative").orderBy("number").collect()] == [f"{k}.000000" for k in range(5)]
    assert [r.time for r in project.summarise(mixed, "delta").orderBy("number").collect()] == ["0.000000"] + ["1.000000"] * 4


def test_records_round_trip(spark, mixed, tmp_path):
    records.write_records(mixed, str(tmp_path / "out"), raw_bytes=True)
    kinds = [(p.protocol, p.path, p.kind) for p in catalog.fields(mixed).collect()]
    back = records.read_records(spark, str(tmp_path / "out"), kinds)
    key = lambda df: {r.number: (r.stack, [(x.protocol, [(f.path, f.elem, f.kind, f.num, f.str) for f in x.fields]) for x in r.layers], bytes(r.raw), r.ts_us) for r in df.collect()}
    assert key(back) == key(mixed)
    line = records.to_records(mixed.where("number = 1")).first().value
    assert line.startswith('{"number":1,"timestamp":"1970-01-01T00:00:01.000500Z","length":54,"original_length":64,"stack":"Ethernet:IPv4:TCP","layers":[{"protocol":"Ethernet","fields":{"dst":')


def test_stream_ids_and_follow(spark, mixed):
    flows = follow.first_stream_ids(mixed)
    assert sorted(r.stream_id for r in flows.collect()) == [0, 1, 2]
    lines = follow.with_stream(mixed).where(P.has_layer("udp")).withColumn("payload", F.lit(b"one\r\ntwo\x00\n"))
    assert [r.line for r in follow.payload_lines(lines.where("number = 2")).orderBy("line_number").collect()] == ["one", "two."]


def test_catalog(mixed):
    assert {r.protocol for r in catalog.protocols(mixed).collect()} == {"Ethernet", "IPv4", "TCP", "UDP", "DNS"}
    assert {r.value for r in catalog.field_values(mixed, "ipv4.src").collect()} == {"10.0.0.1", "10.0.0.2", "10.0.0.3"}
    assert catalog.fields(mixed, "nothing").count() == 0 and "dns.questions.name" in {r.path for r in catalog.field_paths(mixed).collect()}


def fold(rows, tick, limit):
    waiting, last, out, n = {}, {}, [], 0
    for number, us, qr, ident, client in sorted(rows):
        n += 1
        key = (ident, client)
        is_tick = n % tick == 0 and us is not None
        if us is None:
            continue
        if qr == 0:
            waiting.setdefault(key, (number, us))
        if is_tick:
            waiting = {k: v for k, v in waiting.items() if us - v[1] < limit}
        if qr == 1 and key in waiting:
            q = waiting.pop(key)
            if us >= q[1]:
                out.append((q[0], number, (us - q[1]) / 1e6))
    return sorted(out)


def test_dns_pairs_against_a_fold(spark):
    r = random.Random(3)
    rows, us = [], 0
    for n in range(1, 400):
        us += r.randrange(0, 4_000_000)
        rows.append((n, None if r.random() < 0.03 else us + r.randrange(-500_000, 500_000), r.randrange(2), r.randrange(3), r.randrange(2)))
    df = spark.createDataFrame(rows, "number long, ts_us long, qr int, id int, client int")
    mine, theirs = F.concat(F.lit("10.0.0."), F.col("client").cast("string")), F.lit("10.9.9.9")
    ask = F.col("qr") == 0
    ends = layer(0, "IPv4", field("src", "ipv4addr", F.when(ask, mine).otherwise(theirs)), field("dst", "ipv4addr", F.when(ask, theirs).otherwise(mine)))
    udp = layer(1, "UDP", field("src_port", "u16", F.when(ask, 999).otherwise(53)), field("dst_port", "u16", F.when(ask, 53).otherwise(999)))
    packets = as_packets(df.select(F.lit("c").alias("capture_id"), "number", "ts_us", F.array(ends, udp, layer(2, "DNS", field("qr", "u8", F.col("qr")), field("id", "u16", F.col("id")))).alias("layers")))
    got = sorted((x.query_number, x.response_number, x.rtt) for x in correlate.dns_pairs(packets, tick=10, timeout_s=5.0).collect())
    want = fold(rows, 10, 5_000_000)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 20
    summary = stats.response_summary(spark.createDataFrame([(float(k),) for k in range(1, 11)], "rtt double")).first()
    assert (summary.median, summary.p95, summary.p99) == (5.5, 9.55, 9.91) or abs(summary.p99 - 9.91) < 1e-9
    assert stats.response_summary(spark.createDataFrame([], "rtt double")).count() == 0


def test_streams_fill_unknown_ends(spark):
    tcp = lambda sp, dp: layer(1, "TCP", field("stream_id", "u32", F.lit(4)), field("src_port", "u16", F.lit(sp)), field("dst_port", "u16", F.lit(dp)))
    v4 = layer(0, "IPv4", field("src", "ipv4addr", F.lit("1.1.1.1")), field("dst", "ipv4addr", F.lit("2.2.2.2")))
    rows = spark.createDataFrame([(1, 10, 5_000_000), (2, 20, None), (3, 30, 7_500_400)], "number long, original_length int, ts_us long")
    layers = F.when(F.col("number") == 1, F.array(tcp(None, None))).when(F.col("number") == 2, F.array(v4, tcp(50, 80))).otherwise(F.array(v4, tcp(51, 81)))
    got = stats.tcp_streams(as_packets(rows.select("*", F.lit("c").alias("capture_id"), layers.alias("layers")))).first()
    assert tuple(got) == (4, "1.1.1.1", 50, "2.2.2.2", 80, 3, 60, 2.5)


def test_scalars(spark):
    r = spark.range(1).select(scalars.iso_time(F.lit(0)).alias("a"), scalars.iso_time(F.lit(253_402_300_800_000_007)).alias("b"), scalars.media_type(F.lit("text/html; x=1")).alias("c"), scalars.mac_text(F.lit(b"\x02\x00\x00\x00\x00\x0a"), 0).alias("d"), scalars.ipv6_text(F.lit(bytes(15) + b"\x01")).alias("e"), scalars.normalised_name(F.lit("GTPv2-C")).alias("f")).first()
    assert tuple(r) == ("1970-01-01T00:00:00.000000Z", "9999-12-31T23:59:59.000007Z", "text/html", "02:00:00:00:00:0a", "::1", "gtpv2c")


def test_live_equals_batch(spark, mixed, tmp_path):
    from tidewire.streaming import live

    packets = as_packets(mixed)
    packets.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.tail(spark, str(tmp_path / "in"), 1)
    for name, df, mode, batch in (
        ("filtered", live.live_filter(stream, P.has_layer("tcp")).select("number"), "append", packets.where(P.has_layer("tcp")).select("number")),
        ("protocols", live.live_protocols(stream), "complete", stats.protocol_counts(packets)),
        ("talkers", live.live_talkers(stream), "complete", stats.top_talkers(packets, None)),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))


def test_schema_is_the_contract(mixed):
    assert [f.name for f in mixed.schema] == [f.name for f in PACKETS]


def test_live_dns_pairs(spark, tmp_path):
    from tidewire.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 1_000_000, 0, 7), (2, 2_000_000, 0, 7), (3, 3_500_000, 1, 7), (4, 3_600_000, 1, 7), (5, 4_000_000, 0, 8), (6, 40_000_000, 1, 8), (7, 41_000_000, 0, 9), (8, 41_250_000, 1, 9)]
    df = spark.createDataFrame(rows, "number long, ts_us long, qr int, id int")
    ask, mine, theirs = F.col("qr") == 0, F.lit("10.0.0.1"), F.lit("10.9.9.9")
    ends = layer(0, "IPv4", field("src", "ipv4addr", F.when(ask, mine).otherwise(theirs)), field("dst", "ipv4addr", F.when(ask, theirs).otherwise(mine)))
    udp = layer(1, "UDP", field("src_port", "u16", F.when(ask, 999).otherwise(53)), field("dst_port", "u16", F.when(ask, 53).otherwise(999)))
    packets = as_packets(df.select(F.lit("c").alias("capture_id"), "number", "ts_us", F.array(ends, udp, layer(2, "DNS", field("qr", "u8", F.col("qr")), field("id", "u16", F.col("id")))).alias("layers")))
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.live_dns_pairs(live.tail(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pairs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.query_number, r.response_number, r.rtt) for r in spark.table("pairs").collect()) == [(1, 3, 2.5), (7, 8, 0.25)]


def test_all_captures_have_their_tcp_streams(spark):
    from tidewire.plans import registry

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_type in ('click', 'view')")
    want = {(f"c{r.c}", r.user_id): r["count"] for r in events.groupBy(F.expr("event_id div 2048").alias("c"), "user_id").count().collect()}
    got = {(r.capture_id, r.stream_id): r.packets for r in registry.queries()["a04_tcp_streams_all"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len({c for c, _ in want}) > 1


# ---------------------------------------------------------------- captures, end to end


def test_exports_never_overwrite(spark, mixed, tmp_path):
    out = str(tmp_path / "out")
    captures.write_capture(mixed.where("number = 1"), out)
    captures.write_capture(mixed.where("number = 2"), out)
    assert sorted(bytes(r.raw) for r in captures.read_capture(spark, out).collect()) == sorted(MIXED[:2])
    with pytest.raises(Exception):  # a task that fails leaves no part and no folder of its own
        captures.write_capture(mixed.withColumn("ts_us", F.when(F.col("number") < 4, F.col("ts_us")).otherwise(F.lit(-(1 << 60)))), out)
    assert captures.read_capture(spark, out).count() == 2 and len(list((tmp_path / "out").iterdir())) == 2
    captures.write_capture(mixed.withColumn("link_type", F.when(F.col("number") == 5, F.lit(101)).otherwise(F.lit(1))), out, overwrite=True)
    assert sorted((r.link_type, bytes(r.raw)) for r in captures.read_capture(spark, out).collect()) == sorted([(1, x) for x in MIXED[:4]] + [(101, MIXED[4])])


def block(order, kind, body):
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def test_sections_and_torn_files(spark, tmp_path):
    data, n = b"", 0
    for order, links in (("<", (1,)), (">", (101, 1))):  # the second section has another byte order and other interfaces
        data += block(order, captures.SECTION, struct.pack(order + "IHHq", captures.BYTE_ORDER, 1, 0, -1))
        for link in links:
            data += block(order, captures.INTERFACE, struct.pack(order + "HHI", link, 0, 65535))
        for k in range(50):
            n += 1
            data += block(order, captures.ENHANCED, struct.pack(order + "IIIII", len(links) - 1, 0, n * 1000, 54, 54) + MIXED[0][:54] + b"\0\0")
            data += block(order, 5, b"\0" * 8)  # statistics are passed over
    (tmp_path / "two.pcapng").write_bytes(data)
    got = captures.read_capture(spark, str(tmp_path / "two.pcapng"), rangeBytes=700)
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r.number, r.ts_us, r.link_type) for r in got.collect()) == [(k, k * 1000, 1) for k in range(1, 101)]
    assert [r.number for r in captures.read_capture(spark, str(tmp_path / "two.pcapng"), rangeBytes=700, numbers=(60, 62)).collect()] == [60, 61, 62]
    assert spark.read.format("capture").load(str(tmp_path / "two.pcapng")).where("number >= 99").count() == 2
    for cut in (3, 40):
        (tmp_path / "torn.pcapng").write_bytes(data[:-cut])
        with pytest.raises(Exception):
            captures.read_capture(spark, str(tmp_path / "torn.pcapng")).collect()
    (tmp_path / "small.pcapng").write_bytes(data + struct.pack(">II", 6, 8))
    with pytest.raises(Exception):
        captures.read_capture(spark, str(tmp_path / "small.pcapng")).collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.pcap").write_bytes(pcap([]))
    assert captures.read_capture(spark, str(tmp_path / "empty")).count() == 0


def six(next_header: int, src: str, dst: str, body: bytes) -> bytes:
    import ipaddress

    head = struct.pack(">IHBB", 6 << 28, len(body), next_header, 64) + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed
    return bytes.fromhex("020000000001020000000002") + b"\x86\xdd" + head + body


def answer(name: bytes, kind: int, data: bytes) -> bytes:
    return name + struct.pack(">HHIH", kind, 1, 300, len(data)) + data


TALK = [
    frame("TCP", "10.0.0.1", "10.0.0.2", 5000, 80, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
    frame("TCP", "10.0.0.9", "10.0.0.2", 5001, 80),
    frame("TCP", "10.0.0.2", "10.0.0.1", 80, 5000, b"HTTP/1.1 200 OK\x00\n"),
    frame("UDP", "10.0.0.2", "10.0.0.3", 53, 5999, struct.pack(">HHHHHH", 7, 0x8003, 2, 3, 0, 0) + b"\x01a\x03com\x00" + struct.pack(">HH", 1, 1) + b"\x01b\xc0\x0e" + struct.pack(">HH", 28, 1) + answer(b"\xc0\x0c", 1, bytes([1, 2, 3, 4])) + answer(b"\xc0\x0c", 5, b"\x01c\xc0\x0e") + answer(b"\xc0\x0c", 28, bytes(15) + b"\x01")),
    six(0, "2001:db8::1", "2001:db8::2", bytes([44, 0]) + bytes(6) + bytes([17, 0]) + struct.pack(">HI", 0, 1) + struct.pack(">HHHH", 1000, 2000, 9, 0) + b"x"),
    six(44, "2001:db8::1", "2001:db8::2", bytes([17, 0]) + struct.pack(">HI", 8 << 3, 1) + b"middle of a datagram"),
    MIXED[0][:12] + b"\x81\x00" + struct.pack(">H", 0x2005) + MIXED[0][12:],
]


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cap") / "talk.pcap"
    path.write_bytes(pcap(TALK))
    return follow.with_stream_ids(decode.with_labels(decode.decode(captures.read_capture(spark, str(path))))).cache()


def test_decoded_streams_and_payload(talk):
    assert {r.number: r.stream_id for r in talk.collect()} == {1: 0, 2: 1, 3: 0, 4: None, 5: None, 6: None, 7: 0}
    assert [r.number for r in talk.where(P.field_eq("tcp.stream_id", 0)).orderBy("number").collect()] == [1, 3, 7]
    lines = follow.payload_lines(follow.follow(talk, "tcp:0")).orderBy("number", "line_number").collect()
    assert [(r.number, r.from_client, r.line) for r in lines] == [(1, True, "GET / HTTP/1.1"), (1, True, "Host: x"), (1, True, ""), (3, False, "HTTP/1.1 200 OK.")]
    got = {r.stream_id: (r.src, r.src_port, r.dst, r.dst_port, r.packets) for r in stats.tcp_streams(talk).collect()}
    assert got == {0: ("10.0.0.1", 5000, "10.0.0.2", 80, 3), 1: ("10.0.0.9", 5001, "10.0.0.2", 80, 1)}


def test_decoded_layers_and_labels(talk):
    rows = {r.number: r for r in talk.collect()}
    assert rows[5].stack == "Ethernet:IPv6:UDP" and (rows[5].src, rows[5].src_port, rows[5].dst_port, bytes(rows[5].payload)) == ("2001:db8::1", 1000, 2000, b"x")
    assert rows[6].stack == "Ethernet:IPv6" and rows[6].transport is None and rows[6].decode_error is None
    assert [f.num for f in rows[7].layers[0].fields if f.path == "vlan_id"] == [5]
    dns = [(f.path, f.elem, f.num if f.num is not None else f.str, f.name) for f in rows[4].layers[3].fields]
    assert [x[2] for x in dns if x[0] == "questions.name"] == ["a.com", "b.com"] and [x[2] for x in dns if x[0] == "answers.rdata"] == ["1.2.3.4", "c.com", "::1"]
    assert ("rcode", [], 3, "NXDomain") in dns and [x[3] for x in dns if x[0] == "questions.type"] == ["A", "AAAA"]
    info = {r.number: r.info for r in project.summarise(talk).collect()}
    assert info[2] == "5001 → 80 [PSH, ACK]" and info[4] == "Response a.com"
    names = {(r.metric, r.name): r["count"] for r in stats.frequencies(talk, ["dns"]).collect()}
    assert names == {("total_responses", None): 1, ("rcode_distribution", "NXDomain"): 1}


def test_late_ports(spark):
    tcp = lambda sp, dp: layer(0, "TCP", field("stream_id", "u32", F.lit(4)), field("src_port", "u16", sp), field("dst_port", "u16", dp))
    sets = [[(None, 7), (0, 8), (None, None)], [(None, 7), (5, None), (None, 9)], [(None, 7), (5, 6), (0, 9)], [(None, None), (3, 4), (5, 6)]]
    rows = [(f"c{c}", n + 1, sp, dp) for c, packets in enumerate(sets) for n, (sp, dp) in enumerate(packets)]
    df = spark.createDataFrame(rows, "capture_id string, number long, sp int, dp int").withColumn("original_length", F.lit(1)).withColumn("layers", F.array(tcp(F.col("sp"), F.col("dp"))))
    got = {r.capture_id: (r.src_port, r.dst_port) for r in stats.tcp_streams(as_packets(df), by=["capture_id"]).collect()}
    assert got == {"c0": (0, 8), "c1": (5, 7), "c2": (5, 6), "c3": (3, 4)}


def test_records_keep_their_shape(spark, tmp_path):
    shapes = [{"a": {"b": [1, 2]}}, {"a": [{"b": 1}, {"b": 2}]}, {"x": [[1, 2], [3]]}, {"t": True, "f": False}, {"e": [], "o": {}, "l": [[], [1]]}, {"q": [{"n": "a", "t": 1, "t_name": "A"}, {"n": "b", "t": 2}]}, {"p": 1.5, "neg": -3, "big": 2**64 - 1}, {"d": {"e": {"f": [{"g": [1]}]}}}]
    lines = [json.dumps({"number": k + 1, "timestamp": "1970-01-01T00:00:01.000500Z", "length": 1, "original_length": 1, "stack": "P", "layers": [{"protocol": "P", "fields": s}]}, separators=(",", ":")) for k, s in enumerate(shapes)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    back = records.to_records(records.read_records(spark, str(tmp_path / "in.jsonl"))).collect()
    assert sorted(r.value for r in back) == sorted(lines)


def test_pages_far_down_and_flags(spark):
    df = spark.createDataFrame([(c, n) for c in "ab" for n in range(1, 400)], "capture_id string, number long").repartition(5)
    want = [(c, n) for c in "ab" for n in range(1, 400)]
    assert [tuple(r) for r in select.page(df, offset=390, count=None).collect()] == want[390:]
    held, select.HELD = select.HELD, 10
    try:
        assert [tuple(r) for r in select.page(df, offset=397, count=5).collect()] == want[397:402]
    finally:
        select.HELD = held
    plan = select.page(df, offset=390, count=None)._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "TakeOrdered" not in plan
    assert select.truncated(df, count=797).first().truncated and not select.truncated(df, count=798).first().truncated


def test_dns_pairs_over_many_buckets(spark):
    r = random.Random(11)
    rows, us = [], 0
    for n in range(1, 900):
        us += r.randrange(0, 3_000_000)
        rows.append((n, None if r.random() < 0.02 else us, int(r.random() < 0.3), 0, 0))  # one key has all
    df = spark.createDataFrame(rows, "number long, ts_us long, qr int, id int, client int").repartition(6)
    ask, mine, theirs = F.col("qr") == 0, F.lit("10.0.0.1"), F.lit("10.9.9.9")
    ends = layer(0, "IPv4", field("src", "ipv4addr", F.when(ask, mine).otherwise(theirs)), field("dst", "ipv4addr", F.when(ask, theirs).otherwise(mine)))
    udp = layer(1, "UDP", field("src_port", "u16", F.when(ask, 999).otherwise(53)), field("dst_port", "u16", F.when(ask, 53).otherwise(999)))
    packets = as_packets(df.select(F.lit("c").alias("capture_id"), "number", "ts_us", F.array(ends, udp, layer(2, "DNS", field("qr", "u8", F.col("qr")), field("id", "u16", F.col("id")))).alias("layers")))
    for bucket in (7, 64, 1 << 16):
        got = sorted((x.query_number, x.response_number, x.rtt) for x in correlate.dns_pairs(packets, tick=9, timeout_s=6.0, bucket=bucket).collect())
        assert got == fold(rows, 9, 6_000_000) and len(got) > 50


def test_document(spark, mixed):
    got = json.loads(stats.document(mixed).first().stats)
    assert got["total_packets"] == 5 and got["duration_secs"] == 4.0 and {x["name"]: x["count"] for x in got["protocols"]} == {"Ethernet": 5, "IPv4": 5, "TCP": 3, "UDP": 2, "DNS": 1}
    assert got["top_talkers"][0] == {"src": "10.0.0.1", "dst": "10.0.0.2", "packets": 2, "bytes": 128} and "tcp_streams" not in got and "dns_response_time" not in got
    assert {(x["protocol"], x["metric"]): x["count"] for x in got["tables"] if x["metric"].startswith("total")} == {("dns", "total_queries"): 1}
    part = json.loads(stats.document(mixed, ["dhcp"], talkers=False).first().stats)
    assert set(part) == {"total_packets", "start_time", "end_time", "duration_secs", "protocols"}


def test_live_tables_and_streams(spark, talk, tmp_path):
    from tidewire.streaming import live

    packets = as_packets(talk)
    packets.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.tail(spark, str(tmp_path / "in"), 1)
    streams = stats.tcp_streams(packets, None, ["capture_id"])
    overview = packets.groupBy("capture_id").agg(F.count("*").alias("n"), F.min("ts_us"), F.max("ts_us"))
    for name, df, batch in (("tables", live.live_frequencies(stream), stats.name_counts(packets)), ("streams", live.live_streams(stream), streams), ("overview", live.live_overview(stream), overview)):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(str, map(tuple, spark.table(name).collect()))) == sorted(map(str, map(tuple, batch.collect()))) and batch.count()


def test_plans_read_once(spark):
    """Headline plans scan the packet table once for each pass and never rebuild layers."""
    from tidewire.plans import registry

    sf = "/root/testdata/sf0.001"

    def plan(name):
        df = registry.queries()[name](spark, sf)
        df._jdf.collectToPython()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    for name, scans in (("a01_overview", 1), ("a03_top_talkers", 1), ("a05_dns", 1), ("freq_all", 1)):
        assert plan(name).count("FileScan parquet") == scans, name
    talkers = plan("a03_top_talkers")
    assert "layers" not in talkers and "PushedFilters: [IsNull(decode_error), IsNotNull(src), IsNotNull(dst)]" in talkers


def test_visibility_from_a_file(tmp_path):
    (tmp_path / "shown.toml").write_text('[UDP]\nfields = ["src_port"]\n["NAS-5G"]\nfields = ["a.*", "b"]\n')
    assert project.load_visibility(str(tmp_path / "shown.toml")) == {"UDP": ["src_port"], "NAS-5G": ["a.*", "b"]}
    (tmp_path / "bad.toml").write_text('[UDP]\nfields = ["a*b"]\n')
    with pytest.raises(ValueError):
        project.load_visibility(str(tmp_path / "bad.toml"))


def test_bytes_as_text(spark):
    names = ["c3a9", "41ff42", "", None, "41ff42"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "number long, hex string")
    dhcp = layer(0, "DHCP", field("dhcp_message_type", "u8", F.lit(1)), field("hostname", "bytes", F.col("hex")))
    packets = as_packets(rows.select(F.lit("c").alias("capture_id"), "number", F.array(dhcp).alias("layers")))
    got = {r.name: r["count"] for r in stats.frequencies(packets, ["dhcp"]).collect() if r.metric == "top_hostnames"}
    assert got == {"é": 1, "A\ufffdB": 2}
    assert packets.where(P.field_eq("dhcp.hostname", "c3a9") | P.field_ne("dhcp.hostname", "x")).count() == 0  # bytes compare to nothing


def test_frequency_roles_and_parts(spark):
    """Messages by role, sibling values and second-choice layers, on hand-made packets."""
    gtp = layer(0, "GTPv2-C", field("message_type", "u8", F.lit(33), F.lit("Create Session Response")), field("teid", "u32", F.col("number")), field("ies.type", "u32", F.lit(1), elem=(0,)), field("ies.value", "str", F.lit("99970"), elem=(0,)), field("ies.type", "u32", F.lit(2), elem=(1,)), field("ies.value.cause_value", "u8", F.lit(16), F.lit("Accepted"), elem=(1,)), field("ies.type", "u32", F.lit(83), elem=(2,)), field("ies.value.mcc", "str", F.lit("999"), elem=(2,)), field("ies.value.mnc", "str", F.lit("70"), elem=(2,)))
    lldp = layer(1, "LLDP", field("tlvs.type", "u8", F.lit(5), elem=(0,)), field("tlvs.value", "str", F.lit(" sw "), elem=(0,)), field("tlvs.type", "u8", F.lit(99), elem=(1,)))
    three, two = layer(2, "OSPFv3", field("msg_type", "u8", F.lit(1))), layer(3, "OSPFv2", field("msg_type", "u8", F.lit(2)))
    diameter = layer(4, "Diameter", field("is_request", "u8", F.lit(0)), field("avps.code", "u32", F.lit(263), elem=(0,)), field("avps.value", "u32", F.lit(1), elem=(0,)), field("avps.code", "u32", F.lit(298), elem=(1,)), field("avps.value", "u32", F.lit(5001), elem=(1,)))
    packets = as_packets(spark.range(1, 4).select(F.lit("c").alias("capture_id"), F.col("id").alias("number")).withColumn("layers", F.array(gtp, lldp, three, two, diameter, diameter)))
    got = {(r.protocol, r.metric, r.group, r.name): r["count"] for r in stats.frequencies(packets).collect()}
    assert got == {
        ("gtpv2c", "total_messages", None, None): 3, ("gtpv2c", "message_type_distribution", None, "Create Session Response"): 3, ("gtpv2c", "unique_imsi_count", None, None): 1, ("gtpv2c", "unique_teid_count", None, None): 3,
        ("gtpv2c", "cause_per_message_type", "Create Session Response", "Accepted"): 3, ("gtpv2c", "plmn_distribution", None, "999-70"): 3, ("lldp", "total_packets", None, None): 3, ("lldp", "tlv_type_distribution", None, "System Name"): 3,
        ("lldp", "tlv_type_distribution", None, "Reserved"): 3, ("lldp", "top_system_names", None, "sw"): 3, ("ospf", "total_packets", None, None): 3, ("ospf", "packet_type_distribution", None, "2"): 3, ("ospf", "version_distribution", None, "v2"): 3,
        ("diameter", "total_messages", None, None): 3, ("diameter", "total_answers", None, None): 3, ("diameter", "result_code_distribution", None, "5001"): 3,
    }
