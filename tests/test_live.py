"""Live statistics, streams and pairs: any order of arrival, restarts, bounded state."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.model import as_packets, field, layer
from tidewire.operators import correlate, select, stats
from tidewire.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drip(packets, folder, parts, seed):
    """The packets in files of a few each, in an order of the seed; returns the files' names in the order to land."""
    rows = packets.withColumn("_part", F.pmod(F.xxhash64("capture_id", "number", F.lit(seed)), F.lit(parts)))
    for k in range(parts):
        rows.where(F.col("_part") == k).drop("_part").coalesce(1).write.parquet(f"{folder}-{k}")
    return [f"{folder}-{k}" for k in range(parts)]


def land(part, folder):
    import shutil
    from pathlib import Path

    Path(folder).mkdir(exist_ok=True)
    for f in Path(part).glob("*.parquet"):
        shutil.copy(f, f"{folder}/{Path(part).name}-{f.name}")


def tcp_rows(spark):
    """Streams whose first packets lack ports or addresses, in several ways, for two captures."""
    rng = random.Random(8)
    rows = [(c, n, rng.randrange(5), rng.choice([None, 0, 7, 9]), rng.choice([None, 0, 80, 443]), rng.choice([None, "10.0.0.1", "10.0.0.2"])) for c in ("a", "b") for n in range(1, 61)]
    df = spark.createDataFrame(rows, "capture_id string, number long, sid long, sp int, dp int, src string")
    ip = layer(0, "IPv4", field("src", "ipv4addr", F.col("src")), field("dst", "ipv4addr", F.lit("10.9.9.9")))
    tcp = layer(1, "TCP", field("src_port", "u16", F.col("sp")), field("dst_port", "u16", F.col("dp")), field("stream_id", "u32", F.col("sid")))
    made = df.select("capture_id", "number", (F.col("number") * 1_000_000).alias("ts_us"), F.lit(60).alias("original_length"), F.array(ip, tcp).alias("layers"))
    return as_packets(made.withColumn("ts", F.timestamp_micros("ts_us")))


@pytest.mark.parametrize("seed", [1, 2])
def test_live_streams_in_any_order(spark, tmp_path, seed):
    packets = tcp_rows(spark).cache()
    parts = drip(packets, str(tmp_path / "p"), 4, seed)
    land(parts[0], str(tmp_path / "in"))
    query = live.live_streams(live.tail(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName(f"streams{seed}").outputMode("complete").start()
    try:
        query.processAllAvailable()
        for part in parts[1:]:
            land(part, str(tmp_path / "in"))
            query.processAllAvailable()
    finally:
        query.stop()
    want = stats.tcp_streams(packets, None, ["capture_id"])
    assert sorted(map(tuple, spark.table(f"streams{seed}").collect())) == sorted(map(tuple, want.select(*spark.table(f"streams{seed}").columns).collect()))
    assert want.where("dst_port > 0 and src_port > 0").count()


def dns_rows(spark, n, seed):
    """Queries and responses of a few keys; number order is time order, with repeats and times within the timeout."""
    rng = random.Random(seed)
    rows, us = [], 1_000_000
    for k in range(1, n + 1):
        us += rng.choice([0, 1000, 250_000])
        rows.append((k, us, rng.randrange(2), rng.randrange(3)))
    df = spark.createDataFrame(rows, "number long, ts_us long, qr int, id int")
    ask, mine, theirs = F.col("qr") == 0, F.lit("10.0.0.1"), F.lit("10.9.9.9")
    ends = layer(0, "IPv4", field("src", "ipv4addr", F.when(ask, mine).otherwise(theirs)), field("dst", "ipv4addr", F.when(ask, theirs).otherwise(mine)))
    udp = layer(1, "UDP", field("src_port", "u16", F.when(ask, 999).otherwise(53)), field("dst_port", "u16", F.when(ask, 53).otherwise(999)))
    return as_packets(df.select(F.lit("c").alias("capture_id"), "number", "ts_us", F.timestamp_micros("ts_us").alias("ts"), F.array(ends, udp, layer(2, "DNS", field("qr", "u8", F.col("qr")), field("id", "u16", F.col("id")))).alias("layers")))


@pytest.mark.parametrize("seed", [1, 2])
def test_live_pairs_in_any_order(spark, tmp_path, seed):
    """Messages shuffled over micro-batches pair as the batch form pairs them; a last message lets time pass."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    packets = dns_rows(spark, 80, seed).cache()
    want = sorted(map(tuple, correlate.dns_pairs(packets).collect()))
    assert len(want) > 10
    parts = drip(packets, str(tmp_path / "p"), 3, seed)
    dns_rows(spark, 1, 0).withColumn("ts_us", F.lit(500_000_000).cast("long")).withColumn("number", F.lit(900).cast("long")).write.parquet(str(tmp_path / "p-end"))
    land(parts[0], str(tmp_path / "in"))
    query = live.live_dns_pairs(live.tail(spark, str(tmp_path / "in"), 1), lateness_s=60).writeStream.format("memory").queryName(f"pairs_any{seed}").outputMode("append").start()
    try:
        query.processAllAvailable()
        for part in [*parts[1:], str(tmp_path / "p-end")]:
            land(part, str(tmp_path / "in"))
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table(f"pairs_any{seed}").collect())) == want


def test_windows_restart_and_stay_bounded(spark, tmp_path):
    """Talkers and tables kept over a restart equal the batch's; closed windows leave the state."""
    packets = tcp_rows(spark).where("number <= 40").cache()
    ordered = [packets.where(F.col("number").between(a, a + 9)) for a in (1, 11, 21, 31)]
    for k, part in enumerate(ordered):
        part.coalesce(1).write.parquet(str(tmp_path / f"p-{k}"))
    talkers = live.WindowStore(spark, str(tmp_path / "talkers"), ["packets", "bytes"], compact=2)
    tables = live.WindowStore(spark, str(tmp_path / "tables"), ["count"], compact=2)

    def start():
        stream = live.tail(spark, str(tmp_path / "in"), 1)
        first = live.keep_windows(live.windowed_talkers(stream, "5 seconds", "1 second"), talkers, str(tmp_path / "log1"))
        return first, live.keep_windows(live.windowed_frequencies(live.tail(spark, str(tmp_path / "in"), 1), ["tcp", "sctp", "dns"], "5 seconds", "1 second"), tables, str(tmp_path / "log2"))

    land(str(tmp_path / "p-0"), str(tmp_path / "in"))
    queries = start()
    states = []
    try:
        for k in range(4):
            if k:
                land(str(tmp_path / f"p-{k}"), str(tmp_path / "in"))
            if k == 2:
                for q in queries:
                    q.stop()
                queries = start()
            for q in queries:
                q.processAllAvailable()
            states.append(queries[0].lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        for q in queries:
            q.stop()
    want = stats.top_talkers(packets, None)
    got = talkers.totals()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert [r.src for r in select.top_n(got, 1, by=[F.desc("bytes"), F.asc("src")]).collect()] == [r.src for r in stats.top_talkers(packets, 1).collect()]
    # a batch that runs again replaces itself
    talkers.put(spark.read.parquet(str(tmp_path / "talkers" / "*")).limit(0).drop("batch"), 10**6)
    assert sorted(map(tuple, talkers.totals().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert max(states) <= 8, states
