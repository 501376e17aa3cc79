"""Captures that are indexed by many tasks, that grow while they are read, and that share a name."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.functions import predicates as P
from tidewire.sources import captures, records

from test_packets import MIXED, block, pcap


def plain_packets(data: bytes) -> list[tuple]:
    """Number, kept bytes and link type of every packet, by a pass over the whole file."""
    out, at = [], 24
    if data[:4] == struct.pack("<I", captures.SECTION):
        at, order, links = 0, "<", []
        while at < len(data):
            if data[at : at + 4] == struct.pack("<I", captures.SECTION):
                order, links = "<" if data[at + 8 : at + 12] == struct.pack("<I", captures.BYTE_ORDER) else ">", []
            kind, size = struct.unpack(order + "II", data[at : at + 8])
            if kind == captures.INTERFACE:
                links.append(struct.unpack(order + "H", data[at + 8 : at + 10])[0])
            if kind == captures.ENHANCED:
                index, _, _, kept = struct.unpack(order + "IIII", data[at + 8 : at + 24])
                out.append((len(out) + 1, data[at + 28 : at + 28 + kept], links[index]))
            at += size
        return out
    while at < len(data):
        (kept,) = struct.unpack("<I", data[at + 8 : at + 12])
        out.append((len(out) + 1, data[at + 16 : at + 16 + kept], 1))
        at += 16 + kept
    return out


def got(df) -> list[tuple]:
    return sorted((r.number, bytes(r.raw), r.link_type) for r in df.select("number", "raw", "link_type").collect())


def tricky_frames(rng) -> list[bytes]:
    """Frames whose payloads hold whole captures, zeros, and sizes from nothing to several ranges."""
    bait = pcap([rng.randbytes(rng.randint(20, 60)) for _ in range(40)])
    return [rng.choice([MIXED[0], rng.randbytes(rng.randint(0, 200)), bytes(rng.randint(0, 90)), bait, bait[24:], rng.randbytes(5000)]) for _ in range(300)]


def test_one_file_is_indexed_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    data = pcap(tricky_frames(rng))
    (tmp_path / "one.pcap").write_bytes(data)
    index = captures.capture_index(spark, str(tmp_path / "one.pcap"), 3000)
    rows = index.orderBy("start", "end").collect()
    assert len(rows) == -(-len(data) // 3000) and sum(r["count"] for r in rows) == 300
    numbered = [r for r in rows if r["count"]]
    assert [r["first"] for r in numbered] == [1 + sum(x["count"] for x in numbered[:k]) for k in range(len(numbered))]
    assert len(numbered) > 40
    for size in (3000, 20_000, 1 << 20):
        assert got(captures.read_capture(spark, str(tmp_path / "one.pcap"), rangeBytes=size)) == plain_packets(data), size


def test_wrong_guesses_are_walked_again(spark, tmp_path):
    """Ranges that lie within payloads which are captures themselves."""
    bait = pcap([bytes([k]) * 40 for k in range(200)])[24:]
    data = pcap([bait, MIXED[0], bait, bait[10:], MIXED[1]])
    (tmp_path / "bait.pcap").write_bytes(data)
    rows = [captures._walked({"path": str(tmp_path / "bait.pcap"), "k": k, "start": 1000 * k, "end": min(len(data), 1000 * k + 1000), "size": len(data)}) for k in range(-(-len(data) // 1000))]
    import pyarrow as pa

    assert any(r["again"] for r in captures._stitch(pa.Table.from_pylist(rows, captures._WALKED)).to_pylist())
    assert got(captures.read_capture(spark, str(tmp_path / "bait.pcap"), rangeBytes=1000)) == plain_packets(data)


def two_sections(rng, n: int = 120) -> bytes:
    data = b""
    for order, links in (("<", (1,)), (">", (101, 1)), ("<", (113, 1, 101))):
        data += block(order, captures.SECTION, struct.pack(order + "IHHq", captures.BYTE_ORDER, 1, 0, -1))
        for link in links[:-1]:
            data += block(order, captures.INTERFACE, struct.pack(order + "HHI", link, 0, 65535))
        for k in range(n):
            if k == n // 2:  # an interface in the middle of a section
                data += block(order, captures.INTERFACE, struct.pack(order + "HHI", links[-1], 0, 65535))
            body = rng.randbytes(rng.randint(0, 300))
            data += block(order, captures.ENHANCED, struct.pack(order + "IIIII", rng.randrange(len(links) - (k < n // 2)) if len(links) > 1 or k >= n // 2 else 0, 0, k, len(body), len(body)) + body + b"\0" * (-len(body) % 4)) if len(links) > 1 or k >= n // 2 else b""
            data += block(order, 5, b"\0" * 8) if k % 7 == 0 else b""
    return data


def test_sections_over_many_ranges(spark, tmp_path):
    data = two_sections(random.Random(3))
    (tmp_path / "s.pcapng").write_bytes(data)
    want = plain_packets(data)
    assert len(want) == 300 and len({x[2] for x in want}) == 3
    for size in (1000, 9000):
        assert got(captures.read_capture(spark, str(tmp_path / "s.pcapng"), rangeBytes=size)) == want


def test_torn_files_fail_over_many_ranges(spark, tmp_path):
    for name, data in (("t.pcap", pcap([MIXED[0]] * 100)), ("t.pcapng", two_sections(random.Random(4)))):
        for cut in (1, 22):
            (tmp_path / name).write_bytes(data[:-cut])
            with pytest.raises(Exception):
                captures.read_capture(spark, str(tmp_path / name), rangeBytes=4000).count()


def test_captures_of_one_name_are_told_apart(spark, tmp_path):
    for folder, n in (("a", 2), ("b", 3)):
        (tmp_path / "x" / folder).mkdir(parents=True)
        (tmp_path / "x" / folder / "cap.pcap").write_bytes(pcap(MIXED[:n]))
        (tmp_path / "y" / folder).mkdir(parents=True)
        (tmp_path / "y" / folder / "r +1.jsonl").write_text("".join(json.dumps({"number": k + 1, "layers": []}) + "\n" for k in range(n)))
    want = [("a/cap.pcap", 1), ("a/cap.pcap", 2), ("b/cap.pcap", 1), ("b/cap.pcap", 2), ("b/cap.pcap", 3)]
    pattern = str(tmp_path / "x" / "*" / "cap.pcap")
    captures.register(spark)
    for df in (captures.read_capture(spark, pattern), spark.read.format("capture").load(pattern)):
        assert sorted((r.capture_id, r.number) for r in df.collect()) == want
    read = records.read_records(spark, str(tmp_path / "y" / "*" / "*.jsonl"))
    assert sorted((r.capture_id, r.number) for r in read.select("capture_id", "number").collect()) == [(a.replace("cap.pcap", "r +1.jsonl"), n) for a, n in want]
    assert {r.capture_id for r in captures.read_capture(spark, str(tmp_path / "x" / "a")).collect()} == {"cap.pcap"}
    assert {r.capture_id for r in captures.read_capture(spark, str(tmp_path / "x" / "a" / "cap.pcap")).collect()} == {"cap.pcap"}


# ---------------------------------------------------------------- growing


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_a_growing_capture_as_a_stream(spark, tmp_path, kind):
    """Bytes are appended between micro-batches, with a header or half a packet at the end, and over a restart."""
    rng = random.Random(6)
    data = pcap([rng.randbytes(rng.randint(0, 90)) for _ in range(60)]) if kind == "pcap" else two_sections(rng, 30)
    want = plain_packets(data)
    path, log, out = tmp_path / "in" / f"live.{kind}", str(tmp_path / "log"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    captures.register(spark)

    def start():
        stream = spark.readStream.format("capture").option("rangeBytes", 500).load(str(tmp_path / "in"))
        return stream.writeStream.format("parquet").option("checkpointLocation", log).start(out)

    def landed():
        return got(spark.read.schema(captures.SCHEMA).parquet(out)) if list((tmp_path / "out").glob("*.parquet")) else []

    query, whole = start(), 0
    cuts = sorted({3, 20, 30, *(rng.randrange(len(data)) for _ in range(6)), len(data) - 2, len(data)})
    try:
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            with open(path, "ab") as f:
                f.write(data[a:b])
            if k == 5:  # what has come is known to the next query too
                query.stop()
                query = start()
            query.processAllAvailable()
            seen = landed()
            assert seen == want[: len(seen)] and len(seen) >= whole
            whole = len(seen)
        assert seen == want
        (tmp_path / "in" / f"more.{kind}").write_bytes(data)
        query.processAllAvailable()
        assert landed() == sorted(want * 2)
    finally:
        query.stop()


def test_live_filters_over_a_growing_capture(spark, tmp_path):
    from tidewire.streaming import live

    (tmp_path / "in").mkdir()
    data = pcap(MIXED)
    (tmp_path / "in" / "c.pcap").write_bytes(data[:200])
    stream = live.live_filter(live.tail_captures(spark, str(tmp_path / "in")), P.field_eq("tcp.dst_port", 443) | P.has_layer("dns"))
    query = stream.select("capture_id", "number", F.col("src")).writeStream.format("memory").queryName("filtered").start()
    try:
        query.processAllAvailable()
        with open(tmp_path / "in" / "c.pcap", "ab") as f:
            f.write(data[200:])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("filtered").collect())) == [("c.pcap", 4, "10.0.0.3"), ("c.pcap", 5, "10.0.0.1")]


def test_a_shorter_capture_is_an_error(tmp_path):
    path = tmp_path / "c.pcap"
    path.write_bytes(pcap(MIXED))
    reader = captures.GrowingReader({"path": str(path)})
    reader.latestOffset()
    path.write_bytes(pcap(MIXED[:2]))
    with pytest.raises(ValueError):
        reader.latestOffset()


def test_batches_of_a_growing_capture_are_bounded(tmp_path):
    path = tmp_path / "c.pcap"
    path.write_bytes(pcap(MIXED[:1]))
    reader = captures.GrowingReader({"path": str(path), "maxBytesPerTrigger": "100"})
    at = reader.latestOffset()
    path.write_bytes(pcap(MIXED * 4))
    numbers = []
    for _ in range(20):
        following = reader.latestOffset()
        numbers += [r for p in reader.partitions(at, following) for b in reader.read(p) for r in b.column("number").to_pylist()]
        assert following[str(path)]["at"] - at[str(path)]["at"] < 300
        reader.commit(at := following)
    assert numbers == list(range(2, 21))
