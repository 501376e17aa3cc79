"""What filters push to a stored packet table, and that plain columns decide as the layers do."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import predicates as P
from tidewire.model import KEYS, KNOWN, as_packets, field, layer
from tidewire.sources.store import read_packets, write_packets


def some_packets(spark):
    """Plain packets, tunnels, both transports, both IP versions, parts missing, other kinds, arrays, nothing at all."""
    ip = lambda k, name, a, b: layer(k, name, field("src", "ipv4addr" if name == "IPv4" else "ipv6addr", F.lit(a)), field("dst", "ipv4addr" if name == "IPv4" else "ipv6addr", F.lit(b)))
    port = lambda k, name, a, b, *more: layer(k, name, field("src_port", "u16", F.lit(a)), field("dst_port", "u16", F.lit(b)), *more)
    stream = field("stream_id", "u32", F.lit(7))
    made = [
        [ip(0, "IPv4", "10.0.0.1", "10.0.0.2"), port(1, "TCP", 80, 5000, stream)],
        [ip(0, "IPv4", "10.0.0.2", "10.0.0.1"), port(1, "UDP", 53, 5000), layer(2, "DNS", field("id", "u16", F.lit(7)))],
        [ip(0, "IPv6", "::1", "fe80::2"), port(1, "TCP", 443, 80)],
        [ip(0, "IPv4", "10.0.0.1", "10.0.0.9"), port(1, "UDP", 4789, 4789), layer(2, "VXLAN", field("vni", "u32", F.lit(1))), ip(3, "IPv4", "10.0.0.3", "10.0.0.1"), port(4, "TCP", 80, 81, stream)],
        [ip(0, "IPv6", "::1", "::2"), ip(1, "IPv4", "10.0.0.1", "10.0.0.2")],
        [layer(0, "IPv4", field("src", "ipv4addr", F.lit("10.0.0.1")))],
        [ip(0, "IPv4", "10.0.0.1", "10.0.0.1"), layer(1, "TCP", field("src_port", "u16", F.lit(80)))],
        [layer(0, "TCP", field("src_port", "str", F.lit("80")), field("dst_port", "u32", F.lit(80)))],
        [layer(0, "UDP", field("src_port", "u16", F.lit(1)), field("src_port", "u16", F.lit(80)), field("dst_port", "u16", F.lit(9), elem=(0,)), field("dst_port", "u16", F.lit(80), elem=(1,)))],
        [layer(0, "tcp", field("src_port.part", "u16", F.lit(80)), field("dst_port", "u16", F.lit(5000)))],
        [layer(0, "Foo-Bar", field("v", "u8", F.lit(80)))],
        [],
    ]
    rows = None
    for n, layers in enumerate(made):
        value = F.array(*layers) if layers else F.array().cast(as_packets(rows).schema["layers"].dataType)
        one = spark.range(1).select(F.lit("c").alias("capture_id"), F.lit(n).cast("long").alias("number"), value.alias("layers"))
        rows = one if rows is None else rows.unionByName(one)
    nothing = spark.range(1).select(F.lit("c").alias("capture_id"), F.lit(99).cast("long").alias("number"), F.lit(None).cast(rows.schema["layers"].dataType).alias("layers"))
    return as_packets(rows.unionByName(nothing))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packets") / "t")
    write_packets(some_packets(spark), path)
    return read_packets(spark, path)


ATOMS = [(f"{p}.{path}", op, text) for p in KEYS for path in KEYS[p] for op in ("=", "!=", ">=") for text in ("80", "7", "70000", "10.0.0.1", "::1")]


def by_layers(atom) -> object:
    protocol, path = atom[0].split(".")
    return P._in_layers(protocol, path, atom[1], atom[2])


def test_plain_columns_decide_as_layers_do(stored):
    rows = stored.select(*(P._compare(*a).alias(f"p{k}") for k, a in enumerate(ATOMS)), *(by_layers(a).alias(f"l{k}") for k, a in enumerate(ATOMS))).collect()
    assert len(rows) == 13
    for k, a in enumerate(ATOMS):
        assert [r[f"p{k}"] for r in rows] == [r[f"l{k}"] for r in rows], a
    assert sum(r[f"l{k}"] for r in rows for k in range(len(ATOMS))) > 60


def test_random_trees_decide_as_layers_do(stored):
    rng = random.Random(4)
    others = [(P.has_layer(p), F.array_contains(F.transform(F.coalesce("layers", F.array().cast(stored.schema["layers"].dataType)), lambda x: x["proto_norm"]), re.sub("[^a-z0-9]", "", p.lower()))) for p in ("tcp", "DNS", "foobar", "GRE")]
    others += [(P.packet_number("<=", 4), F.col("number") <= 4), (P.number_in([(2, 9), 11]), F.col("number").between(2, 9) | (F.col("number") == 11)), (P.field_eq("dns.id", 7), P._in_layers("dns", "id", "=", "7")), (F.col("number") % 2 == 0, F.col("number") % 2 == 0)]

    def tree(depth):
        if depth == 0:
            if rng.random() < 0.5:
                return rng.choice(others)
            a = rng.choice(ATOMS)
            return P._compare(*a), by_layers(a)
        (p, x), (q, y) = tree(depth - 1), tree(rng.randint(0, depth - 1))
        p, x = (~p, ~x) if rng.random() < 0.3 else (p, x)
        return (p & q, x & y) if rng.random() < 0.5 else (p | q, x | y)

    trees = [tree(rng.randint(1, 3)) for _ in range(40)]
    rows = stored.select("number", *(p.alias(f"p{k}") for k, (p, _) in enumerate(trees)), *(x.alias(f"x{k}") for k, (_, x) in enumerate(trees))).collect()
    for k in range(len(trees)):
        assert [r[f"p{k}"] for r in rows] == [r[f"x{k}"] for r in rows], k
    for k, (p, _) in enumerate(trees[:12]):  # as filters, which the optimizer rewrites
        assert sorted(r.number for r in stored.where(p).select("number").collect()) == sorted(r.number for r in rows if r[f"x{k}"]), k


def scan_of(df) -> tuple[str, str]:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return (re.search(r"PushedFilters: \[(.*)\]", text) or [None, ""])[1], re.search(r"ReadSchema: (.*)", text)[1]


@pytest.mark.parametrize(
    "condition, pushed, layers",
    [
        (lambda: P.field_eq("tcp.dst_port", 80) & P.has_layer("tcp"), ["EqualNullSafe(has.tcp,true)", "Or(And(And(EqualNullSafe(transport,tcp),IsNotNull(dst_port)),EqualTo(dst_port,80)),EqualNullSafe(nested,true))"], False),
        (lambda: P.field_eq("ipv4.src", "10.0.0.1"), ["And(And(EqualNullSafe(has.ipv4,true),IsNotNull(src)),EqualTo(src,10.0.0.1))"], False),
        (lambda: P.field_in("udp.dst_port", [53, 5353]) & P.packet_number(">", 3), ["EqualTo(dst_port,53)", "EqualTo(dst_port,5353)", "GreaterThan(number,3)"], False),
        (lambda: P.field_between("tcp.src_port", 10, 20), ["GreaterThanOrEqual(src_port,10)", "LessThanOrEqual(src_port,20)"], False),
        (lambda: P.field_eq("tcp.stream_id", 7) | P.has_layer("dns"), ["EqualTo(stream_id,7)", "EqualNullSafe(has.dns,true)"], False),
        (lambda: ~P.has_layer("dns"), ["Not(EqualNullSafe(has.dns,true))"], False),
        (lambda: ~P.field_eq("tcp.dst_port", 80), ["IsNull(dst_port)", "Not(EqualTo(dst_port,80))"], False),
        (lambda: P.field_eq("dns.id", 7) & P.field_gt("udp.src_port", 1024), ["EqualNullSafe(has.dns,true)", "GreaterThan(src_port,1024)"], True),
        (lambda: P.field_eq("dns.id", 7) | P.field_eq("http.method", "get"), ["Or(EqualNullSafe(has.dns,true),EqualNullSafe(has.http,true))"], True),
        (lambda: P.has_layer("foobar"), [], False),
    ],
)
def test_pushed_conditions(stored, condition, pushed, layers):
    filters, schema = scan_of(stored.where(condition()).select("capture_id", "number"))
    for part in pushed:
        assert part.replace(" ", "") in filters.replace(" ", ""), filters
    assert ("layers:" in schema) == layers


def test_flags_are_pruned_to_the_ones_asked_for(stored):
    _, schema = scan_of(stored.where(P.has_layer("dns")).select("number"))
    assert "has:struct<dns:boolean>" in schema
    assert len(KNOWN) == len(set(KNOWN))


def test_row_groups_without_a_match_are_not_read(spark, tmp_path):
    """Flags and numbers have statistics, addresses Bloom filters."""
    import pyarrow.parquet as pq

    rows = spark.range(1, 2001).select(F.lit("c").alias("capture_id"), F.col("id").alias("number"), F.array(layer(0, "IPv4", field("src", "ipv4addr", F.concat(F.lit("10.0."), (F.col("id") % 256).cast("string"), F.lit("."), F.floor(F.col("id") / 256).cast("string"))), field("dst", "ipv4addr", F.lit("10.9.9.9")))).alias("layers"))
    write_packets(as_packets(rows), str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("*.parquet"))
    columns = {pq.ParquetFile(f).metadata.row_group(0).column(k).path_in_schema: pq.ParquetFile(f).metadata.row_group(0).column(k) for f in files[:1] for k in range(pq.ParquetFile(f).metadata.num_columns)}
    assert columns["has.ipv4"].statistics.min is True and columns["has.dns"].statistics.max is False
    table = read_packets(spark, str(tmp_path / "t"))
    assert table.where(P.field_eq("ipv4.src", "10.0.3.1")).count() == 1
    assert table.where(P.has_layer("dns")).count() == 0
