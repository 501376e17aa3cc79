"""The packet table: column types, and helpers to build and look into layers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_KINDS = ("u8", "u16", "u32", "u64", "i32")

#: Protocols with a flag of their own in ``has``, by normalised name.
KNOWN = ("ethernet", "arp", "ipv4", "ipv6", "icmp", "icmpv6", "igmp", "tcp", "udp", "sctp", "dns", "mdns", "dhcp", "dhcpv6", "http", "http2", "tls", "sip", "diameter", "radius", "gtpv1u", "gtpv2c", "pfcp", "ngap", "nas5g", "rtp", "stun", "ntp", "bgp", "ospfv2", "ospfv3", "lldp", "vxlan", "geneve", "gre")

FIELD = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("elem", T.ArrayType(T.IntegerType())),
        T.StructField("kind", T.StringType()),
        T.StructField("num", T.DecimalType(20, 0)),
        T.StructField("str", T.StringType()),
        T.StructField("name", T.StringType()),
        # how many of the places in ``elem`` belong to each step of the path; null: one a step, outer ones first
        T.StructField("depth", T.ArrayType(T.IntegerType())),
    ]
)
LAYER = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("proto_norm", T.StringType()),
        T.StructField("protocol_label", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD)),
    ]
)
PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("original_length", T.IntegerType()),
        T.StructField("link_type", T.IntegerType()),
        T.StructField("stack", T.StringType()),
        T.StructField("decode_error", T.StringType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("layers", T.ArrayType(LAYER)),
        # what most operators ask for, as plain columns beside the layers
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("transport", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("stream_id", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        # what filters ask for, see ``with_facts``
        T.StructField("protocols", T.ArrayType(T.StringType())),
        T.StructField("has", T.StructType([T.StructField(p, T.BooleanType()) for p in KNOWN])),
        T.StructField("nested", T.BooleanType()),
        T.StructField("further", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("num", T.DecimalType(20, 0)), T.StructField("str", T.StringType())]))),
        # of the first layer named DNS; null without one
        T.StructField("dns", T.StructType([T.StructField("qr", T.IntegerType()), T.StructField("id", T.IntegerType())])),
    ]
)
FLOW = ("src", "dst", "transport", "src_port", "dst_port", "stream_id")
FACTS = ("protocols", "has", "nested", "further", "dns")
#: The columns that readers and decoders make themselves.
DECODED = T.StructType([f for f in PACKETS if f.name not in FACTS])
#: Fields that filters find in plain columns: their kind in a packet that has one value of each.
KEYS = {
    "ipv4": {"src": "ipv4addr", "dst": "ipv4addr"},
    "ipv6": {"src": "ipv6addr", "dst": "ipv6addr"},
    "tcp": {"src_port": "u16", "dst_port": "u16", "stream_id": "u32"},
    "udp": {"src_port": "u16", "dst_port": "u16"},
}


def normalised(name: str) -> str:
    """``GTPv2-C`` and ``gtpv2c`` are one protocol."""
    return re.sub("[^a-z0-9]", "", name.lower())


# ---------------------------------------------------------------- building


def field(path: str, kind: str, value: Column, name: Column | None = None, elem: tuple[int, ...] = ()) -> Column:
    """One field; a null value makes a null element, which ``layer`` leaves out."""
    number = kind in NUMERIC_KINDS
    item = F.struct(
        F.lit(0).alias("pos"),
        F.lit(path).alias("path"),
        F.array(*map(F.lit, elem)).cast("array<int>").alias("elem"),
        F.lit(kind).alias("kind"),
        (value.cast("decimal(20,0)") if number else F.lit(None).cast("decimal(20,0)")).alias("num"),
        (F.lit(None).cast("string") if number else value.cast("string")).alias("str"),
        (F.lit(None).cast("string") if name is None else name).alias("name"),
        F.lit(None).cast("array<int>").alias("depth"),
    )
    return F.when(value.isNotNull(), item)


def layer(idx: int, protocol: str, *fields: Column, label: str | None = None) -> Column:
    kept = F.transform(F.array_compact(F.array(*fields)), lambda f, i: f.withField("pos", i)) if fields else F.array().cast(T.ArrayType(FIELD))
    return F.struct(
        F.lit(idx).alias("idx"), F.lit(protocol).alias("protocol"), F.lit(normalised(protocol)).alias("proto_norm"), F.lit(label or protocol).alias("protocol_label"), kept.cast(T.ArrayType(FIELD)).alias("fields")
    )


def as_packets(df: DataFrame) -> DataFrame:
    """``df`` with all packet columns, in order.

    Those that it lacks are null, but for ``stack``, the flow columns and the facts, which follow the layers.
    """
    if "layers" in df.columns and "stack" not in df.columns:
        df = df.withColumn("stack", stack())
    if "layers" in df.columns and not set(FLOW) <= set(df.columns):
        df = with_flow_columns(df)
    if "layers" in df.columns and not set(FACTS) <= set(df.columns):
        df = with_facts(df)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS))


def with_flow_columns(df: DataFrame) -> DataFrame:
    """Adds or replaces ``src, dst, transport, src_port, dst_port, stream_id`` from the layers."""
    kept = [F.col(c) for c in df.columns if c not in FLOW]
    found = df.select(*kept, endpoints().alias("_e"), transport().alias("_t"), first_field(first_layer("TCP"), "stream_id")["num"].cast("long").alias("stream_id"))
    return found.select(*kept, "_e.src", "_e.dst", "_t.transport", "_t.src_port", "_t.dst_port", "stream_id")


def with_facts(df: DataFrame) -> DataFrame:
    """Adds or replaces what filters and pairs ask for: ``protocols, has, nested, further, dns``.

    ``protocols`` are the layers' normalised names, ``has`` a flag for each of ``KNOWN``. The flow
    columns hold all that a filter on one of ``KEYS`` can see in most packets. Where they don't
    (tunnels, several transports, values of another kind), ``nested`` is true and ``further`` has
    every value of those fields; so no filter on them needs the layers. ``dns`` has the direction
    and id of a DNS message.
    """
    kept = [F.col(c) for c in df.columns if c not in FACTS]
    named = df.select(*kept, F.coalesce(F.transform("layers", lambda x: x["proto_norm"]), F.array().cast("array<string>")).alias("protocols"))
    found = named.withColumn("has", F.struct(*(F.array_contains("protocols", p).alias(p) for p in KNOWN)))
    value = lambda key, kind, num, text: F.struct(F.lit(key).alias("key"), kind.alias("kind"), num.cast("decimal(20,0)").alias("num"), text.cast("string").alias("str"))

    def seen(layer_: Column, protocol: str, path: str) -> Column:
        single = F.slice(F.filter(layer_["fields"], lambda f: (f["path"] == path) & (F.size(f["elem"]) == 0)), 1, 1)
        parts = F.filter(layer_["fields"], lambda f: ((f["path"] == path) & (F.size(f["elem"]) > 0)) | F.startswith(f["path"], F.lit(path + ".")))
        return F.transform(F.concat(single, parts), lambda f: value(f"{protocol}.{path}", f["kind"], f["num"], f["str"]))

    def told(protocol: str, path: str, kind: str) -> Column:
        none, column = F.lit(None), F.col(path)
        if kind.endswith("addr"):
            own = F.col("has.ipv4") if protocol == "ipv4" else ~F.col("has.ipv4")
            return F.when(own & column.isNotNull(), value(f"{protocol}.{path}", F.lit(kind), none, column))
        own = column.isNotNull() if path == "stream_id" else column.isNotNull() & (F.col("transport") == protocol)
        return F.when(own, value(f"{protocol}.{path}", F.lit(kind), column, none))

    def all_seen(protocol: str) -> Column:
        own = F.filter("layers", lambda x: x["proto_norm"] == protocol)
        return F.flatten(F.transform(own, lambda x: F.concat(*(seen(x, protocol, path) for path in KEYS[protocol]))))

    in_layers = F.concat(*map(all_seen, KEYS))
    in_columns = F.array_compact(F.array(*(told(p, path, kind) for p in KEYS for path, kind in KEYS[p].items())))
    found = found.withColumn("further", F.coalesce(in_layers, F.array().cast(PACKETS["further"].dataType)).cast(PACKETS["further"].dataType))
    found = found.withColumn("nested", ~F.col("further").eqNullSafe(in_columns.cast(PACKETS["further"].dataType)))
    message = lambda x: F.struct(*(first_field(x, p)["num"].cast("int").alias(p) for p in ("qr", "id")))
    found = found.withColumn("dns", F.when(F.col("has.dns"), bind(first_layer("DNS"), lambda x: F.when(x.isNotNull(), message(x)))))
    return found.withColumn("further", F.when(F.col("nested"), F.col("further"))).select(*kept, *FACTS)


# ---------------------------------------------------------------- looking


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def stack() -> Column:
    """Layer labels, outermost first, joined by colons."""
    return F.array_join(F.transform("layers", lambda x: x["protocol_label"]), ":")


def holds(*protocols: str) -> Column:
    """Whether a packet has a layer of one of exactly these names; cheaper than looking inside layers."""
    names = F.col("layers.protocol")
    found = F.array_contains(names, protocols[0]) if len(protocols) == 1 else F.arrays_overlap(names, F.array(*map(F.lit, protocols)))
    return F.coalesce(found, F.lit(False))


def flagged(protocol: str) -> Column:
    """Whether a packet has a layer of that normalised name, from plain columns; sources prune by the flags of ``KNOWN``."""
    name = normalised(protocol)
    if name in KNOWN:
        return F.col(f"has.{name}").eqNullSafe(F.lit(True))
    return F.coalesce(F.array_contains("protocols", name), F.lit(False))


def first_layer(protocol: str, layers: Column | str = "layers") -> Column:
    """The first layer of exactly that name, or null."""
    return F.get(F.filter(layers, lambda x: x["protocol"] == protocol), 0)


def first_field(layer_: Column, path: str) -> Column:
    return F.get(all_fields(layer_, path), 0)


def all_fields(layer_: Column, path: str) -> Column:
    return F.filter(layer_["fields"], lambda f: f["path"] == path)


def endpoints() -> Column:
    """``src, dst`` of the first IPv4 layer, else the first IPv6 layer, else null.

    An IPv4 layer that lacks an address gives null; IPv6 is not looked at then.
    """

    def pair(layer: Column) -> Column:
        both = F.struct(first_field(layer, "src")["str"].alias("src"), first_field(layer, "dst")["str"].alias("dst"))
        return bind(both, lambda e: F.when(e["src"].isNotNull() & e["dst"].isNotNull(), e))

    return bind(first_layer("IPv4"), lambda four: F.when(four.isNotNull(), pair(four)).otherwise(bind(first_layer("IPv6"), pair)))


def transport() -> Column:
    """``transport, src_port, dst_port`` of UDP, else TCP; both ports must be there."""

    def tuple_(name: str) -> Column:
        flow = lambda x: F.struct(F.lit(name.lower()).alias("transport"), *(first_field(x, p)["num"].cast("int").alias(p) for p in ("src_port", "dst_port")))
        return bind(bind(first_layer(name), flow), lambda t: F.when(t["src_port"].isNotNull() & t["dst_port"].isNotNull(), t))

    return F.coalesce(tuple_("UDP"), tuple_("TCP"))


def raw_text(f: Column) -> Column:
    return F.coalesce(f["str"], f["num"].cast("string"))


def label_text(f: Column) -> Column:
    """The display label where there is one, else the value as text."""
    return F.coalesce(f["name"], f["str"], f["num"].cast("string"))


def flat_fields(packets: DataFrame) -> DataFrame:
    """One row per field of every layer."""
    rows = packets.select("capture_id", "number", F.explode("layers").alias("l")).select("capture_id", "number", "l.idx", "l.protocol", "l.proto_norm", F.explode("l.fields").alias("f"))
    return rows.select("capture_id", "number", F.col("idx").alias("layer_idx"), "protocol", "proto_norm", "f.path", "f.elem", "f.kind", "f.num", "f.str", "f.name")


def decoded(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("decode_error").isNull())


def warnings(packets: DataFrame) -> DataFrame:
    """Packets that could not be decoded, with the reason."""
    return packets.where(F.col("decode_error").isNotNull()).select("capture_id", "number", "decode_error")


# ---------------------------------------------------------------- published schemas

#: A record as it is written; the fields of a layer are an object whose keys its protocol has.
RECORD = "number long, timestamp string, length long, original_length long, stack string, layers array<struct<protocol string, fields variant>>, raw_bytes string"
#: What the statistics return.
STATISTICS = {
    "overview": "total_packets long, start_time double, end_time double, duration_secs double",
    "protocols": "name string, count long",
    "top_talkers": "src string, dst string, packets long, bytes long",
    "tcp_streams": "capture_id string, stream_id long, src string, src_port int, dst string, dst_port int, packets long, bytes long, duration_secs double",
    "tables": "protocol string, metric string, group string, name string, count long",
    "response_time": "count long, min double, max double, mean double, median double, p95 double, p99 double",
}
