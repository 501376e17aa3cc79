"""Statistics of captures: overview, talkers, streams, and frequency tables of 29 protocols."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from ..functions.scalars import utf8_lossy
from ..model import FIELD, LAYER, all_fields, bind, decoded, first_field, first_layer, holds, label_text, normalised, raw_text
from ..sources.store import written
from .project import diameter_result, with_flow
from .select import top_n

# ---------------------------------------------------------------- overview


def overview(packets: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """All packets, also those not decoded; times without the unknown ones."""
    t = lambda f: f("ts_us") / 1e6
    return packets.groupBy(*by).agg(
        F.count("*").alias("total_packets"), t(F.min).alias("start_time"), t(F.max).alias("end_time"), F.coalesce(F.round((F.max("ts_us") - F.min("ts_us")) / 1e6, 3), F.lit(0.0)).alias("duration_secs")
    )


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Every occurrence of every layer."""
    return decoded(packets).select(F.explode("layers.protocol").alias("name")).groupBy("name").count()


def top_talkers(packets: DataFrame, n: int | None = 10) -> DataFrame:
    flows = decoded(with_flow(packets)).select("src", "dst", "original_length").where("src is not null and dst is not null")
    sums = flows.groupBy("src", "dst").agg(F.count("*").alias("packets"), F.sum("original_length").alias("bytes"))
    return top_n(sums, n, by=[F.desc("bytes"), F.desc("packets"), F.asc("src"), F.asc("dst")])


def tcp_ports() -> tuple[Column, Column]:
    """Ports of the first TCP layer; the plain columns have them unless the packet's flow is UDP or lacks one."""
    port = lambda p: F.when(F.col("transport") == "tcp", F.col(p)).otherwise(first_field(first_layer("TCP"), p)["num"].cast("int"))
    return port("src_port"), port("dst_port")


def tcp_streams(packets: DataFrame, n: int | None = 10, by: Iterable[str] = ()) -> DataFrame:
    """Sums per TCP stream, for each value of ``by`` (``capture_id``, where ids are a capture's own).

    Addresses are those of the first packet that has both. Ports are read from each packet until
    one has a source port; what that one lacks is of the last one before it that has it. All are
    partial aggregates, so one giant stream is no hot spot.
    """
    by = list(by)
    sp, dp = tcp_ports()
    rows = decoded(with_flow(packets)).where("stream_id is not null").select(*by, "stream_id", "number", "ts_us", "original_length", "src", "dst", sp.alias("sp"), dp.alias("dp"))
    known = F.coalesce("sp", F.lit(0)) != 0
    sums = rows.groupBy(*by, "stream_id").agg(
        F.min_by(F.struct("src", "dst"), F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.col("number"))).alias("e"),
        F.min_by(F.struct("number", "sp", "dp"), F.when(known, F.col("number"))).alias("p"),
        F.count("*").alias("packets"),
        F.sum("original_length").alias("bytes"),
        F.coalesce(F.round((F.max("ts_us") - F.min("ts_us")) / 1e6, 3), F.lit(0.0)).alias("duration_secs"),
    )
    # packets without a source port are few: their target ports are put beside the sums
    vague = rows.where(~known & F.col("dp").isNotNull()).select(*by, "stream_id", "number", F.col("dp").alias("late_dp"))
    same = reduce(lambda x, y: x & y, (F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "stream_id"]))
    early = vague.alias("v").join(sums.select(*by, "stream_id", F.col("p.number").alias("until")).alias("s"), same).where("until is null or number < until")
    early = early.groupBy(*(F.col(f"v.{c}").alias(c) for c in [*by, "stream_id"])).agg(F.max_by("late_dp", "number").alias("late_dp"))
    shaped = sums.join(early, [*by, "stream_id"], "left").select(
        *by, "stream_id", F.coalesce("e.src", F.lit("unknown")).alias("src"), F.coalesce("p.sp", F.lit(0)).alias("src_port"), F.coalesce("e.dst", F.lit("unknown")).alias("dst"), F.coalesce("p.dp", "late_dp", F.lit(0)).alias("dst_port"), "packets", "bytes", "duration_secs"
    )
    return top_n(shaped, n, by=[F.desc("bytes"), F.asc("stream_id"), *map(F.asc, by)])


# ---------------------------------------------------------------- frequency tables


@dataclass(frozen=True)
class Metric:
    """One frequency table: what to do with the values at ``path``.

    ``how``: label (display label, else value), raw (value; ``arg``: only of that kind, not
    empty), string (its text alone), prefix (label, else ``arg`` and the number), code (name in the code table ``arg``, else
    ``other``), rtp, hex, text (bytes as text, not empty), service (names that begin with ``_``),
    grouped (a part's value under its label). ``role``: only of messages in that role.
    ``every``: all values at the path, not the first alone.
    """

    metric: str
    path: str
    how: str = "raw"
    arg: str | None = None
    role: str | None = None
    every: bool = False
    other: str = "Unknown"


def total(metric: str, role: str | None = None) -> Metric:
    return Metric(metric, MESSAGE, "total", role=role)


@dataclass(frozen=True)
class Protocol:
    """``layers``: names of which the first that a packet has counts. ``role`` sorts messages;
    ``parts`` makes values that no single field has: path, and name or (name, group) texts."""

    layers: tuple[str, ...]
    metrics: tuple[Metric, ...]
    role: Callable[[Column], Column] | None = None
    parts: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


#: The path of a value that each message has once.
MESSAGE = "@message"


def _number(x: Column, path: str) -> Column:
    return first_field(x, path)["num"]


def _split(condition: Callable[[Column], Column], yes: str, no: str) -> Callable[[Column], Column]:
    return lambda x: F.when(F.coalesce(condition(x), F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def _dns_role(x: Column) -> Column:
    known = _number(x, "qr").isNotNull() & _number(x, "id").isNotNull()
    return F.when(known, F.when(_number(x, "qr") == 0, F.lit("query")).otherwise(F.lit("response")))


def _http_role(x: Column) -> Column:
    return F.when(first_field(x, "method").isNotNull(), F.lit("request")).when(first_field(x, "status_code").isNotNull(), F.lit("response"))


def _nas_role(x: Column) -> Column:
    code = _number(x, "extended_protocol_discriminator")
    return F.when(code == 0x7E, F.lit("mm")).when(code == 0x2E, F.lit("sm"))


def _sibling(x: Column, f: Column, path: str) -> Column:
    """The field at ``path`` in the same array element as ``f``."""
    return F.get(F.filter(x["fields"], lambda g: (g["path"] == path) & (F.get(g["elem"], 0) == F.get(f["elem"], 0))), 0)


def _of_elements(type_path: str, code: int, value: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.transform(F.filter(all_fields(x, type_path), lambda f: f["num"] == code), lambda f: value(x, f))


def _text_of_bytes(f: Column) -> Column:
    text = F.when(f["kind"] == "bytes", utf8_lossy(f["str"])).otherwise(f["str"])
    return F.when(text != "", text)


def _system_names(x: Column) -> Column:
    return _of_elements("tlvs.type", 5, lambda x, f: bind(F.trim(_text_of_bytes(_sibling(x, f, "tlvs.value"))), lambda t: F.when(t != "", t)))(x)


def _plmn(x: Column) -> Column:
    return _of_elements("ies.type", 83, lambda x, f: F.concat(_sibling(x, f, "ies.value.mcc")["str"], F.lit("-"), _sibling(x, f, "ies.value.mnc")["str"]))(x)


def _causes(x: Column) -> Column:
    message = F.coalesce(label_text(first_field(x, "message_type")), F.lit("Unknown"))
    return _of_elements("ies.type", 2, lambda x, f: F.struct(label_text(_sibling(x, f, "ies.value.cause_value")).alias("name"), message.alias("group")))(x)


def _port_pair(x: Column) -> Column:
    return F.array(F.concat(raw_text(first_field(x, "src_port")), F.lit(":"), raw_text(first_field(x, "dst_port"))))


def _simple(layer: str, count: str, *metrics: Metric) -> Protocol:
    return Protocol((layer,), (total(count), *metrics))


def _labels(**paths: str) -> tuple[Metric, ...]:
    return tuple(Metric(f"{name}_distribution", path, "label") for name, path in paths.items())


SPEC: dict[str, Protocol] = {
    "dns": Protocol(
        ("DNS",),
        (
            total("total_queries", "query"),
            total("total_responses", "response"),
            Metric("top_query_names", "questions.name", "string", role="query", every=True),
            Metric("query_type_distribution", "questions.type", "prefix", "TYPE", "query", True),
            Metric("rcode_distribution", "rcode", "prefix", "RCODE", "response"),
        ),
        _dns_role,
    ),
    "mdns": Protocol(
        ("mDNS",),
        (
            total("total_packets"),
            total("total_queries", "query"),
            total("total_responses", "response"),
            Metric("top_query_names", "questions.name", "string", every=True),
            Metric("query_type_distribution", "questions.type", "prefix", "TYPE", every=True),
            Metric("service_distribution", "questions.name", "service", every=True),
        ),
        _split(lambda x: _number(x, "qr") == 1, "response", "query"),
    ),
    "http": Protocol(
        ("HTTP",),
        (
            total("total_requests", "request"),
            total("total_responses", "response"),
            Metric("method_distribution", "method"),
            Metric("status_code_distribution", "status_code", role="response"),
            Metric("top_uris", "uri", role="request"),
        ),
        _http_role,
    ),
    "http2": _simple("HTTP2", "total_frames", *_labels(frame_type="frame_type", error_code="error_code"), Metric("top_stream_ids", "stream_id")),
    "tls": _simple("TLS", "total_records", *_labels(content_type="content_type", version="version"), Metric("top_server_names", "extensions.server_name", "text", every=True)),
    "sip": Protocol(
        ("SIP",),
        (
            total("total_requests", "request"),
            total("total_responses", "response"),
            Metric("method_distribution", "method", role="request"),
            Metric("status_code_distribution", "status_code", role="response"),
        ),
        _split(lambda x: _number(x, "is_response") == 1, "response", "request"),
    ),
    "diameter": Protocol(
        ("Diameter",),
        (
            total("total_messages"),
            total("total_requests", "request"),
            total("total_answers", "answer"),
            *_labels(command_code="command_code", application_id="application_id"),
            Metric("result_code_distribution", "@result", every=True),
        ),
        _split(lambda x: _number(x, "is_request") == 1, "request", "answer"),
        {"@result": lambda x: F.array(diameter_result(x))},
    ),
    "gtpv1u": _simple("GTPv1-U", "total_packets", *_labels(message_type="message_type"), Metric("top_teids", "teid")),
    "gtpv2c": Protocol(
        ("GTPv2-C",),
        (
            total("total_messages"),
            *_labels(message_type="message_type"),
            Metric("unique_imsi_count", "@imsi", every=True),
            Metric("unique_teid_count", "teid"),
            Metric("cause_per_message_type", "@cause", "grouped", every=True),
            Metric("plmn_distribution", "@plmn", every=True),
        ),
        None,
        {"@imsi": _of_elements("ies.type", 1, lambda x, f: _sibling(x, f, "ies.value")["str"]), "@cause": _causes, "@plmn": _plmn},
    ),
    "pfcp": _simple("PFCP", "total_messages", *_labels(message_type="message_type")),
    "ngap": _simple("NGAP", "total_messages", Metric("pdu_type_distribution", "pdu_type", "code", "ngap_pdu"), Metric("procedure_code_distribution", "procedure_code", "code", "ngap_procedure")),
    "nas5g": Protocol(
        ("NAS-5G",),
        (
            total("total_messages"),
            Metric("epd_distribution", "extended_protocol_discriminator", "code", "nas_discriminator"),
            Metric("mm_message_type_distribution", "message_type", "code", "nas_mm", "mm"),
            Metric("sm_message_type_distribution", "message_type", "code", "nas_sm", "sm"),
        ),
        _nas_role,
    ),
    "radius": _simple("RADIUS", "total_packets", *_labels(code="code")),
    "dhcp": _simple("DHCP", "total_packets", *_labels(message_type="dhcp_message_type"), Metric("top_hostnames", "hostname", "text"), Metric("top_requested_ips", "requested_ip", "raw", "ipv4addr")),
    "dhcpv6": _simple("DHCPv6", "total_packets", *_labels(msg_type="msg_type")),
    "rtp": _simple("RTP", "total_packets", Metric("payload_type_distribution", "payload_type", "rtp", "rtp_payload"), Metric("ssrc_distribution", "ssrc", "hex")),
    "stun": _simple("STUN", "total_messages", Metric("class_distribution", "message_class", "code", "stun_class"), Metric("method_distribution", "message_method", "code", "stun_method")),
    "icmp": _simple("ICMP", "total_packets", *_labels(type="type", code="code")),
    "icmpv6": _simple("ICMPv6", "total_packets", *_labels(type="type", code="code")),
    "arp": _simple("ARP", "total_packets", *_labels(oper="oper"), Metric("top_spa", "spa", "raw", "ipv4addr"), Metric("top_sha", "sha", "text")),
    "igmp": _simple(
        "IGMP",
        "total_packets",
        Metric("type_distribution", "type", "code", "igmp_type"),
        Metric("version_distribution", "type", "code", "igmp_version", other="Other"),
        Metric("top_group_addresses", "group_address"),
        Metric("top_group_addresses", "group_records.multicast_address", every=True),
    ),
    "lldp": Protocol(
        ("LLDP",),
        (total("total_packets"), Metric("tlv_type_distribution", "tlvs.type", "code", "lldp_tlv", every=True, other="Reserved"), Metric("top_system_names", "@system", every=True)),
        None,
        {"@system": _system_names},
    ),
    "ntp": _simple("NTP", "total_packets", *_labels(mode="mode", stratum="stratum"), Metric("version_distribution", "version")),
    "bgp": _simple("BGP", "total_messages", *_labels(message_type="type")),
    "ospf": Protocol(
        ("OSPFv2", "OSPFv3"),
        (total("total_packets"), *_labels(packet_type="msg_type"), Metric("version_distribution", "@version", every=True)),
        None,
        {"@version": lambda x: F.array(F.lower(F.substring(x["protocol"], 5, 2)))},
    ),
    "sctp": Protocol(("SCTP",), (total("total_packets"), Metric("top_src_ports", "src_port"), Metric("top_dst_ports", "dst_port"), Metric("top_port_pairs", "@pair", every=True)), None, {"@pair": _port_pair}),
    "vxlan": _simple("VXLAN", "total_packets", Metric("top_vnis", "vni")),
    "geneve": _simple("GENEVE", "total_packets", *_labels(protocol_type="protocol_type"), Metric("top_vnis", "vni")),
    "gre": _simple("GRE", "total_packets", *_labels(protocol_type="protocol_type"), Metric("top_keys", "key")),
}

#: Parts of a document that are no protocol's table: a message each.
_PARTS = ("@packets", "@layers", "@talkers")
SPEC |= {p: Protocol((), (Metric(p, MESSAGE, "total"),)) for p in _PARTS}
#: Metrics that count distinct names instead of listing them.
DISTINCT = ("unique_imsi_count", "unique_teid_count")


def _chosen(protocols: Iterable[str] | None) -> list[str]:
    wanted = None if protocols is None else {normalised(p) for p in protocols}
    return [k for k in SPEC if k not in _PARTS and (wanted is None or k in wanted)]


def _messages(packets: DataFrame, keys: list[str], by: Iterable[str] = ()) -> DataFrame:
    """``key, message`` and columns ``by``: of each packet the first layer of each protocol's name."""
    first_names = {name: (key, SPEC[key].layers[:k]) for key in keys for k, name in enumerate(SPEC[key].layers)}
    rows = decoded(packets)
    if set(keys) != set(SPEC) - set(_PARTS):  # else few packets have none, and layers that are made as they are read would be made again for the filter
        rows = rows.where(holds(*first_names))
    rows = rows.select(*by, F.col("layers.protocol").alias("names"), F.posexplode_outer("layers").alias("at", "message"))
    name = F.col("message.protocol")
    first = F.coalesce(F.array_position("names", name), F.lit(0)) == F.col("at") + 1
    for own, (_, better) in first_names.items():
        if better:  # a packet's message of another name counts instead
            first = first & ~((name == own) & F.arrays_overlap("names", F.array(*map(F.lit, better))))
    key = F.create_map(*(F.lit(x) for own, (k, _) in first_names.items() for x in (own, k)))
    return rows.where(name.isin(*first_names) & first).select(*by, F.try_element_at(key, name).alias("key"), "message")


def _part(path: str) -> Callable[[Column], Column]:
    def of(value: Column) -> Column:
        null = lambda kind: F.lit(None).cast(kind)
        return F.struct(F.lit(0).alias("pos"), F.lit(path).alias("path"), null("array<int>").alias("elem"), null("string").alias("kind"), null("decimal(20,0)").alias("num"), value["name"].alias("str"), value["group"].alias("name"), null("array<int>").alias("depth"))

    return of


def _values(messages: DataFrame, keys: list[str], by: Iterable[str] = ()) -> DataFrame:
    """``by, key, role, path, first, f``: every field of every message that some table counts, and the parts that no field has."""
    x, key = F.col("message"), F.col("key")
    kind = T.ArrayType(FIELD)
    role, parts = F.when(F.lit(False), ""), F.when(F.lit(False), F.array().cast(kind))
    for k in keys:
        if SPEC[k].role:
            role = role.when(key == k, SPEC[k].role(x))
        made = []
        for path, values in SPEC[k].parts.items():
            named = values(x) if path == "@cause" else F.transform(values(x), lambda v: F.struct(v.alias("name"), F.lit(None).cast("string").alias("group")))
            made.append(F.transform(named, _part(path)).cast(kind))
        if made:
            parts = parts.when(key == k, F.concat(*made))
    parts = parts.otherwise(F.array().cast(kind))
    one = F.array(_part(MESSAGE)(F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("group")))).cast(kind)
    asked = F.create_map(*(c for k in keys for c in (F.lit(k), F.array(*map(F.lit, sorted({m.path for m in SPEC[k].metrics}))))))
    counted = bind(F.try_element_at(asked, key), lambda paths: F.filter(x["fields"], lambda f: F.array_contains(paths, f["path"])))
    rows = messages.select(*by, "key", role.alias("role"), F.concat(one, parts, F.coalesce(counted, F.array().cast(kind))).alias("fields"))
    rows = rows.select(*by, "key", "role", F.col("fields.path").alias("paths"), F.posexplode("fields").alias("at", "f"))
    return rows.select(*by, "key", "role", F.col("f.path").alias("path"), (F.array_position("paths", F.col("f.path")) == F.col("at") + 1).alias("first"), "f")


def name_counts(packets: DataFrame, protocols: Iterable[str] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """``protocol, metric, group, name, count`` of every name, uncut, for each value of ``by``; also over a stream.

    Every value of every message meets the rows of ``SPEC`` by protocol and path, and those of
    the code tables by code; both are constants and are sent to the executors. Counts are partial
    before the shuffle, so a name that most packets have is no hot spot.
    """
    keys, by = _chosen(protocols), list(by)
    if not keys:
        return packets.select(*by).limit(0).select(*by, *(F.lit(None).cast("string").alias(c) for c in ("protocol", "metric", "group", "name")), F.lit(0).cast("long").alias("count"))
    return _named(_messages(packets, keys, by), keys, by).groupBy(*by, "protocol", "metric", "group", "name").count()


def _named(messages: DataFrame, keys: list[str], by: Iterable[str] = ()) -> DataFrame:
    """``by, protocol, metric, group, name``: a row for each value that a table counts."""
    spark = messages.sparkSession
    rows = [(k, m.path, m.metric, m.how, m.arg, m.role, m.every, m.other) for k in keys for m in SPEC[k].metrics]
    spec = F.broadcast(labels.constant(spark, rows, "key string, path string, metric string, how string, arg string, wanted string, every boolean, other string"))
    codes = F.broadcast(labels.code_rows(spark))
    met = _values(messages, keys, by).join(spec, ["key", "path"]).where((F.col("wanted").isNull() | (F.col("wanted") == F.col("role"))) & (F.col("every") | F.col("first")))
    number = F.col("f.num").cast("long")
    met = met.withColumn("code", F.when(F.col("how").isin("code", "rtp"), number)).join(codes.withColumnRenamed("table", "arg"), ["arg", "code"], "left")
    f, how = F.col("f"), F.col("how")
    value, text = raw_text(f), _text_of_bytes(f)
    name = (
        F.when(how == "label", label_text(f))
        .when(how == "prefix", F.coalesce(f["name"], F.concat("arg", f["num"].cast("string"))))
        .when(how == "code", F.when(number.isNotNull(), F.coalesce("label", "other")))
        .when(how == "rtp", F.when(number.isNotNull(), F.coalesce("label", labels.rtp_other(number))))
        .when(how == "hex", F.concat(F.lit("0x"), F.lpad(F.hex(number), 8, "0")))
        .when(how == "text", text)
        .when(how == "service", F.when(F.startswith(f["str"], F.lit("_")), f["str"]))
        .when(how == "raw", F.when(F.col("arg").isNull() | ((f["kind"] == F.col("arg")) & (value != "")), value))
        .otherwise(f["str"])
    )
    return met.select(*by, F.col("key").alias("protocol"), "metric", F.when(how == "grouped", f["name"]).alias("group"), name.alias("name")).where("name is not null")


def frequencies(packets: DataFrame, protocols: Iterable[str] | None = None, n: int | None = 10) -> DataFrame:
    """``protocol, metric, group, name, count`` of all requested tables, from one shuffle of counts.

    Totals and distinct counts have a null name. Each list is cut to its first ``n`` names by
    falling count, then name. Unknown protocols are ignored. Equal messages are counted before
    their fields are looked into; where all differ, each is shuffled once.
    """
    keys = _chosen(protocols)
    if keys:
        alike = _messages(packets, keys).groupBy("key", "message").agg(F.count("*").alias("alike"))
        counts = _named(alike, keys, ["alike"]).groupBy("protocol", "metric", "group", "name").agg(F.sum("alike").alias("count"))
    else:
        counts = name_counts(packets, protocols)
    # a distinct count is how many names there are: they are added up before anything is ranked
    distinct = F.col("metric").isin(*DISTINCT)
    whole = counts.groupBy("protocol", "metric", "group", F.when(~distinct & ~F.startswith("metric", F.lit("total_")), F.col("name")).alias("name")).agg(F.sum(F.when(distinct, 1).otherwise(F.col("count"))).alias("count"))
    return top_n(whole, n, within=("protocol", "metric", "group"))


# ---------------------------------------------------------------- times, document


#: The percentiles of a summary.
PERCENTILES = {"median": 0.5, "p95": 0.95, "p99": 0.99}


def _of_group(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``left`` with the columns of its group's row in ``right``; null is a group too. Without ``by``, ``right`` is one row."""
    if not by:
        return left.join(F.broadcast(right))
    same = reduce(lambda x, y: x & y, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by))
    return left.alias("l").join(right.alias("r"), same).select("l.*", *(f"r.{c}" for c in right.columns if c not in by))


def response_summary(pairs: DataFrame, value: str = "rtt", by: Iterable[str] = (), cuts: int = 256) -> DataFrame:
    """Count, extremes, mean and interpolated percentiles, exact; no row when there are no values.

    Values are counted, and put to parts between rough percentiles, which a sketch of fixed size
    gives. The parts' sizes tell which few of them hold the ranks that are asked for; only those
    are ordered. So no task holds all distinct values.
    """
    by = list(by)
    rows = pairs.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    places = F.array(*(F.lit(k / cuts) for k in range(cuts + 1)))
    base = rows.groupBy(*by).agg(F.count("*").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.percentile_approx("_v", places, 4 * cuts).alias("_cuts")).where("count > 0")
    counted = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    placed = _of_group(counted, base.select(*by, "_cuts"), by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_size"))
    at = lambda p, f: f((F.col("count") - 1) * p).cast("long")
    ranks = F.array_distinct(F.array(*(at(p, f) for p in PERCENTILES.values() for f in (F.floor, F.ceil))))
    asked = _of_group(before, base.select(*by, ranks.alias("_ranks")), by)
    asked = asked.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))).where(F.size("_ranks") > 0)
    found = _of_group(placed, asked.select(*by, "_part", "_before", "_ranks"), [*by, "_part"])
    until = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    held = found.withColumn("_until", until).withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r < F.col("_until")) & (r >= F.col("_until") - F.col("_n")))))
    values = held.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def percentile(p: float) -> Column:
        place = (F.col("count") - 1) * F.lit(p)
        low, high = F.try_element_at("_at", at(p, F.floor)), F.try_element_at("_at", at(p, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    summed = _of_group(base.drop("_cuts"), values, by)
    return summed.select(*by, "count", "min", "max", "mean", *(percentile(p).alias(name) for name, p in PERCENTILES.items()))


#: What a document counts besides tables, as metrics of messages that no layer is.
_PACKETS, _LAYERS, _TALKERS = _PARTS
#: Names that a list of a document may have before it is cut to what is asked for.
_MOST_NAMES = 4096


def _tagged(packets: DataFrame, keys: list[str], talkers: bool) -> DataFrame:
    """One row for each part of a document that a packet feeds: its message of each protocol, and what ``_PACKETS`` and the others name."""
    first_names = {name: (key, SPEC[key].layers[:k]) for key in keys for k, name in enumerate(SPEC[key].layers)}
    good = F.col("decode_error").isNull()
    tag = lambda key, name, group, message: F.struct(F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), name.cast("string").alias("tag"), group.cast("string").alias("tag_group"), message.cast(LAYER).alias("message"))
    none, layers = F.lit(None), F.coalesce(F.col("layers"), F.array().cast(T.ArrayType(LAYER)))
    names = F.transform(layers, lambda x: x["protocol"])

    def counts(x: Column, at: Column) -> Column:
        first = F.array_position(names, x["protocol"]) == at + 1
        for own, (_, better) in first_names.items():
            if better:
                first = first & ~((x["protocol"] == own) & F.arrays_overlap(names, F.array(*map(F.lit, better))))
        return x["protocol"].isin(*first_names) & first

    parts = [F.array(tag(_PACKETS, none, none, none)), F.when(good, F.transform(layers, lambda x: tag(_LAYERS, x["protocol"], none, none)))]
    if first_names:
        key = F.create_map(*(F.lit(x) for own, (k, _) in first_names.items() for x in (own, k)))
        parts.append(F.when(good, F.transform(F.filter(layers, counts), lambda x: tag(F.try_element_at(key, x["protocol"]), none, none, x))))
    if talkers:
        parts.append(F.when(good & F.col("src").isNotNull() & F.col("dst").isNotNull(), F.array(tag(_TALKERS, F.col("src"), F.col("dst"), none))))
    empty = F.array().cast("array<struct<key:string,tag:string,tag_group:string,message:" + LAYER.simpleString() + ">>")
    rows = packets.select("ts_us", "original_length", F.explode(F.concat(*(F.coalesce(p, empty) for p in parts))).alias("t"))
    return rows.select("ts_us", "original_length", "t.*")


def _sums(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """``protocol, metric, group, name, count, bytes, first, last`` of every name of a document, uncut.

    All sums are plain numbers, so they are kept by hash and spill; nothing is collected for a name.
    """
    named = _named(tagged, [*keys, *_PARTS], ["ts_us", "original_length", "tag", "tag_group"])
    part = F.col("protocol")
    own, distinct = part.isin(*_PARTS), F.col("metric").isin(*DISTINCT)
    in_part = lambda p, c: F.when(part.isin(*p), F.col(c))
    sums = named.groupBy("protocol", "metric", F.when(own, F.col("tag_group")).otherwise(F.col("group")).alias("group"), F.when(own, F.col("tag")).otherwise(F.col("name")).alias("name")).agg(
        F.count("*").alias("count"), F.sum(in_part([_TALKERS], "original_length")).alias("bytes"), F.min(in_part([_PACKETS], "ts_us")).alias("first"), F.max(in_part([_PACKETS], "ts_us")).alias("last")
    )
    # distinct counts are numbers of names; totals have no name
    shown = F.when(~distinct & ~F.startswith("metric", F.lit("total_")), F.col("name"))
    first = lambda c: F.max(c).alias(c)  # noqa: E731  one row a name, but for distinct counts
    return sums.groupBy("protocol", "metric", "group", F.when(own, F.col("name")).otherwise(shown).alias("name")).agg(F.sum(F.when(distinct, 1).otherwise(F.col("count"))).alias("count"), *map(first, ("bytes", "first", "last")))


def _ranked(sums: DataFrame, n: int, lots: int = 64) -> DataFrame:
    """``sums`` and ``_rank`` of the first ``n`` of each list (``_MOST_NAMES`` layers).

    A list may have as many names as there are packets: each is ranked in ``lots`` parts first,
    and only what these leave comes together.
    """
    part = F.col("protocol")
    # of parts, the group is no list of its own
    order = [F.desc_nulls_last("bytes"), F.desc("count"), F.asc("name"), F.asc("group")]
    within = ["protocol", "metric", F.when(~part.isin(*_PARTS), F.col("group"))]
    rank = lambda *lot: F.row_number().over(Window.partitionBy(*within, *lot).orderBy(*order))
    lot = F.when(part == _LAYERS, F.xxhash64("name")).otherwise(F.pmod(F.xxhash64("name", "group"), F.lit(lots)))  # a layer alone
    left = sums.withColumn("_rank", rank(lot)).where(F.col("_rank") <= max(n, 1))
    return left.withColumn("_rank", rank()).where(F.col("_rank") <= max(n, _MOST_NAMES)).where((part == _LAYERS) | (F.col("_rank") <= n))


def _listed_streams(packets: DataFrame, n: int) -> DataFrame:
    """One row, the list of the first ``n`` streams: sums of all by plain columns, ends among the packets of these alone."""
    sent = decoded(with_flow(packets)).where("stream_id is not null")
    sums = sent.groupBy("capture_id", "stream_id").agg(F.count("*").alias("count"), F.sum("original_length").alias("bytes"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    order = [F.desc("bytes"), F.asc("stream_id"), F.desc("count"), F.asc("capture_id")]
    chosen = written(sums.orderBy(*order).limit(n).withColumn("_rank", F.row_number().over(Window.orderBy(*order))), "document-streams")
    sp, dp = tcp_ports()
    own = sent.alias("p").join(F.broadcast(chosen.select("_rank", "stream_id", "capture_id").alias("c")), (F.col("p.stream_id") == F.col("c.stream_id")) & F.col("p.capture_id").eqNullSafe(F.col("c.capture_id")))
    rows = written(own.select("_rank", "number", "src", "dst", sp.alias("sp"), dp.alias("dp")), "document-stream-packets")
    known = F.coalesce("sp", F.lit(0)) != 0
    ends = rows.groupBy("_rank").agg(
        F.min_by(F.struct("src", "dst"), F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.col("number"))).alias("e"), F.min_by(F.struct("number", "sp", "dp"), F.when(known, F.col("number"))).alias("p")
    )
    # packets without a source port, until one has it
    vague = rows.where(~known & F.col("dp").isNotNull()).select("_rank", "number", "dp").join(F.broadcast(ends.select("_rank", F.col("p.number").alias("until"))), "_rank")
    late = vague.where("until is null or number < until").groupBy("_rank").agg(F.max(F.struct("number", "dp"))["dp"].alias("late"))
    whole = chosen.join(F.broadcast(ends), "_rank", "left").join(F.broadcast(late), "_rank", "left")
    row = F.struct(
        "stream_id", "capture_id", F.coalesce("e.src", F.lit("unknown")).alias("src"), F.coalesce("p.sp", F.lit(0)).alias("src_port"), F.coalesce("e.dst", F.lit("unknown")).alias("dst"), F.coalesce("p.dp", "late", F.lit(0)).alias("dst_port"),
        F.col("count").alias("packets"), "bytes", _seconds().alias("duration_secs"),
    )
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", row.alias("row")))), lambda x: x["row"]).alias("tcp_streams"))


def _seconds() -> Column:
    return F.coalesce(F.round((F.col("last") - F.col("first")) / 1e6, 3), F.lit(0.0))


def document(packets: DataFrame, protocols: Iterable[str] | None = None, n: int = 10, talkers: bool = True, streams: bool = True) -> DataFrame:
    """One row, one JSON text: the enabled parts, each a bounded list; parts without content are left out.

    The packet table is read once for all parts but the DNS times and the streams: a packet becomes a
    row for each part that it feeds, these are counted and summed by part and name in one partial
    aggregation, and what is left is ranked within its list, in parts first. Pairs of DNS messages
    are a pass of their own, as are streams, of which only those listed are looked into.
    """
    from .correlate import dns_pairs

    wanted = None if protocols is None else {normalised(p) for p in protocols}
    keys, streams = _chosen(wanted), streams and (wanted is None or "tcp" in wanted)
    ranked = _ranked(_sums(_tagged(with_flow(packets), keys, talkers), keys), n)
    part = F.col("protocol")
    in_part = lambda p, c: F.when(part.isin(*p), c)
    listed = lambda p, *shape: F.transform(F.sort_array(F.collect_list(F.when(p, F.struct("_rank", F.struct(*shape).alias("row"))))), lambda x: x["row"])
    table = F.struct("protocol", "metric", "group", "name", "count")
    out = ranked.agg(
        F.coalesce(F.max(in_part([_PACKETS], F.col("count"))), F.lit(0)).alias("total_packets"),
        F.max(in_part([_PACKETS], F.col("first") / 1e6)).alias("start_time"),
        F.max(in_part([_PACKETS], F.col("last") / 1e6)).alias("end_time"),
        F.coalesce(F.max(in_part([_PACKETS], _seconds())), F.lit(0.0)).alias("duration_secs"),
        listed(part == _LAYERS, "name", "count").alias("protocols"),
        F.sort_array(F.collect_list(F.when(~part.isin(*_PARTS), table))).alias("tables"),
        listed(part == _TALKERS, F.col("name").alias("src"), F.col("group").alias("dst"), F.col("count").alias("packets"), "bytes").alias("top_talkers"),
    )
    if streams:
        out = out.join(F.broadcast(_listed_streams(packets, n)))
    if wanted is None or "dns" in wanted:
        times = response_summary(dns_pairs(packets))
        out = out.join(F.broadcast(times.agg(F.collect_list(F.struct(*times.columns)).alias("dns_response_time"))))
    names = ["total_packets", "start_time", "end_time", "duration_secs", "protocols", "tables", "dns_response_time", "top_talkers", "tcp_streams"]
    full = [F.when(F.size(c) > 0, F.col(c)).alias(c) if k > 3 else F.col(c) for k, c in enumerate(names) if c in out.columns]
    return out.select(F.to_json(F.struct(*full), {"ignoreNullFields": "true"}).alias("stats"))
