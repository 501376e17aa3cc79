"""Columns derived from packets: endpoints, times, summaries, and which fields are shown."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_time, media_type
from ..model import FACTS, FLOW, all_fields, bind, first_field, first_layer, label_text, with_facts, with_flow_columns


def with_flow(packets: DataFrame) -> DataFrame:
    """Makes sure of the plain columns of a packet table: flow columns and facts."""
    flows = packets if set(FLOW) <= set(packets.columns) else with_flow_columns(packets)
    return flows if set(FACTS) <= set(flows.columns) else with_facts(flows)


# ---------------------------------------------------------------- times


def with_relative_time(packets: DataFrame, name: str = "relative_s") -> DataFrame:
    """Seconds since the capture's first packet: a join with one row a capture, so a huge one is not sorted in one task."""
    first = packets.groupBy("capture_id").agg(F.min_by("ts_us", "number").alias("_first"))
    return packets.join(first, "capture_id").withColumn(name, F.round((F.col("ts_us") - F.col("_first")) / 1e6, 6)).drop("_first")


def with_delta_time(packets: DataFrame, name: str = "delta_s", bucket: int = 1 << 16) -> DataFrame:
    """Seconds since the packet before, 0 for a capture's first; null where either time is unknown.

    Worked out in buckets of ``number``; a bucket's first row looks at the last one before it.
    """
    time = F.struct("ts_us")  # a known packet, also where its time is not
    keyed = packets.withColumn("_b", F.floor(F.col("number") / bucket))
    last = keyed.groupBy("capture_id", "_b").agg(F.max_by(time, "number").alias("_last"))
    edge = last.select("capture_id", "_b", F.lag("_last").over(Window.partitionBy("capture_id").orderBy("_b")).alias("_edge"))
    before = F.lag(time).over(Window.partitionBy("capture_id", "_b").orderBy("number"))
    rows = keyed.withColumn("_before", before).join(edge, ["capture_id", "_b"])
    return rows.withColumn(name, F.round((F.col("ts_us") - F.coalesce("_before", "_edge", time)["ts_us"]) / 1e6, 6)).select(*packets.columns, name)


# ---------------------------------------------------------------- summaries


def _ports(layer: Column) -> Column:
    port = lambda p: F.coalesce(first_field(layer, p)["num"].cast("string"), F.lit("0"))
    return F.concat(port("src_port"), F.lit(" → "), port("dst_port"))


def _header(layer: Column, name: str) -> Column:
    """The value of an HTTP header, whose name and value share an array place."""
    at = F.get(F.filter(layer["fields"], lambda f: (f["path"] == "headers.name") & (F.lower(f["str"]) == name.lower())), 0)["elem"]
    return F.get(F.filter(layer["fields"], lambda f: (f["path"] == "headers.value") & (f["elem"] == at)), 0)["str"]


def _short(f: Column) -> Column:
    """Only scalars; strings over 30 bytes are cut."""
    text = f["str"]
    cut = F.when(F.octet_length(text) > 30, F.concat(F.substring(text, 1, 27), F.lit("..."))).otherwise(text)
    return F.when(f["num"].isNotNull(), f["num"].cast("string")).when(f["kind"] == "str", cut).when(f["kind"].isin("ipv4addr", "macaddr"), text)


def info() -> Column:
    """One line on a packet: by the first protocol with a rule, else labels or fields of the top layer."""

    def of_dns(dns: Column) -> Column:
        qr = first_field(dns, "qr")
        way = F.when(qr["num"] == 0, "Query").when(qr["num"] == 1, "Response").otherwise("")
        asked = F.exists(dns["fields"], lambda f: F.startswith(f["path"], F.lit("questions.")))
        return F.when(qr.isNotNull(), F.when(asked, F.concat(way, F.lit(" "), F.coalesce(first_field(dns, "questions.name")["str"], F.lit("?")))).otherwise(way))

    def of_http(http: Column) -> Column:
        media = media_type(_header(http, "Content-Type"))
        request = F.concat(first_field(http, "method")["str"], F.lit(" "), first_field(http, "uri")["str"])
        reason = F.coalesce(F.concat(F.lit(" "), first_field(http, "reason_phrase")["str"]), F.lit(""))
        return F.coalesce(request, F.concat(first_field(http, "status_code")["num"].cast("string"), reason, F.coalesce(F.concat(F.lit(" ("), media, F.lit(")")), F.lit(""))))

    def bracketed(text: Column) -> Column:
        return F.coalesce(F.concat(F.lit(" ["), text, F.lit("]")), F.lit(""))

    def of_sctp(sctp: Column) -> Column:
        chunks = F.filter(F.transform(all_fields(sctp, "chunks.type"), lambda f: f["name"]), lambda n: n.isNotNull())
        return F.concat(_ports(sctp), bind(chunks, lambda c: bracketed(F.when(F.size(c) > 0, F.array_join(c, ", ")))))

    def of_gtp(gtp: Column) -> Column:
        message, cause = first_field(gtp, "message_type")["name"], label_text(first_field(gtp, "ies.value.cause_value"))
        return F.when(F.contains(message, F.lit("Response")) & cause.isNotNull(), F.concat(message, F.lit(" ("), cause, F.lit(")"))).otherwise(message)

    def of_diameter(x: Column) -> Column:
        command, answer = first_field(x, "command_code")["name"], F.coalesce(first_field(x, "is_request")["num"] != 1, F.lit(True))
        return bind(diameter_result(x), lambda result: F.when(answer & result.isNotNull(), F.concat(command, F.lit(" ("), result, F.lit(")"))).otherwise(command))

    def of_tls(tls: Column) -> Column:
        return F.concat(first_field(tls, "content_type")["name"], F.coalesce(F.concat(F.lit(", "), first_field(tls, "handshake_type")["name"]), F.lit("")))

    def of_top(top: Column) -> Column:
        outer = F.filter(top["fields"], lambda f: ~F.contains(f["path"], F.lit(".")))
        labels = F.filter(F.transform(outer, lambda f: f["name"]), lambda n: n.isNotNull() & ~n.isin("", "Unknown"))
        short = lambda f: bind(_short(f), lambda v: F.concat(f["path"], F.lit("="), F.when(v != "", v)))
        plain = F.filter(F.transform(F.slice(F.filter(outer, lambda f: f["name"].isNull()), 1, 3), short), lambda x: x.isNotNull())
        pick = lambda found, other: bind(found, lambda a: F.when(F.size(a) > 0, F.array_join(a, " ")).otherwise(other))
        return pick(labels, pick(plain, F.lit("")))

    def by_top(top: Column) -> Column:
        flags = lambda tcp: F.concat(_ports(tcp), bracketed(first_field(tcp, "flags")["name"]))
        name = top["protocol"]
        flow = F.when(name == "TCP", bind(first_layer("TCP"), flags)).when(name == "UDP", bind(first_layer("UDP"), _ports)).when(name == "SCTP", bind(first_layer("SCTP"), of_sctp))
        return F.coalesce(flow, bind(first_layer("GTPv2-C"), of_gtp), bind(first_layer("Diameter"), of_diameter), bind(first_layer("TLS"), of_tls), of_top(top))

    return F.coalesce(bind(first_layer("DNS"), of_dns), bind(first_layer("HTTP"), of_http), bind(F.get("layers", F.size("layers") - 1), by_top), F.lit(""))


def diameter_result(layer: Column) -> Column:
    """Label or value of the first AVP with code 268 or 298."""
    at = F.get(F.filter(layer["fields"], lambda f: (f["path"] == "avps.code") & f["num"].isin(268, 298)), 0)["elem"]
    return label_text(F.get(F.filter(layer["fields"], lambda f: (f["path"] == "avps.value") & (f["elem"] == at)), 0))


def summarise(packets: DataFrame, time: str = "absolute") -> DataFrame:
    """One display row per packet; ``time``: absolute, relative or delta."""
    if time not in ("absolute", "relative", "delta"):
        raise ValueError(f"unknown time format {time!r}")
    packets = with_flow(packets)
    rows = with_relative_time(packets, "_t") if time == "relative" else with_delta_time(packets, "_t") if time == "delta" else packets
    shown = iso_time(F.col("ts_us")) if time == "absolute" else F.format_string("%.6f", F.col("_t"))
    mac, bad = first_layer("Ethernet"), F.col("decode_error").isNotNull()
    return rows.select(
        "capture_id",
        "number",
        shown.alias("time"),
        F.coalesce("src", first_field(mac, "src")["str"], F.lit("")).alias("source"),
        F.coalesce("dst", first_field(mac, "dst")["str"], F.lit("")).alias("destination"),
        F.when(bad, "???").otherwise(F.coalesce(F.element_at("layers", -1)["protocol_label"], F.lit(""))).alias("protocol"),
        F.col("length"),
        F.when(bad, "dissection error").otherwise(info()).alias("info"),
    )


# ---------------------------------------------------------------- visible fields


def check_pattern(pattern: str) -> str:
    """Exact, ``prefix*`` or ``*suffix``, on a field or, after one dot, on a container's child."""
    parts = pattern.split(".")
    if not pattern or len(parts) > 2 or any(not p for p in parts):
        raise ValueError(f"not a field pattern: {pattern!r}")
    for k, part in enumerate(parts):
        if part == "*" and not (len(parts) == 2 and k == 1):
            raise ValueError("a bare * is no pattern")
        if "*" in part[1:-1] or part.count("*") > 1:
            raise ValueError(f"* may only begin or end a pattern: {pattern!r}")
    return pattern


def load_visibility(path: str) -> dict[str, list[str]]:
    """A visibility table from a TOML file: a section a protocol, its patterns under ``fields``."""
    with open(path, "rb") as f:
        return {protocol: [check_pattern(p) for p in part["fields"]] for protocol, part in tomllib.load(f).items()}


def _matches(name: Column, pattern: str) -> Column:
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("*"):
        return F.startswith(name, F.lit(pattern[:-1]))
    if pattern.startswith("*"):
        return F.endswith(name, F.lit(pattern[1:]))
    return name == pattern


def _any(name: Column, patterns: Sequence[str]) -> Column:
    exact = [p for p in patterns if "*" not in p]
    out = name.isin(exact) if exact else F.lit(False)
    for p in patterns:
        if "*" in p:
            out = out | _matches(name, p)
    return out


def visible_fields(packets: DataFrame, config: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keeps the listed fields of each listed protocol; other protocols show everything.

    A container without dotted patterns shows all children; with some, those that match. The
    parent of a child is the container right above it, and a hidden ancestor hides all below.
    A label goes by its own name, the field's plus ``_name``.
    """
    checked = {protocol: [check_pattern(p) for p in patterns] for protocol, patterns in config.items()}

    def shown(path: Column, patterns: Sequence[str]) -> Column:
        dotted = [p.split(".") for p in patterns if "." in p]
        top = [p for p in patterns if "." not in p] + [a for a, _ in dotted]
        out = _any(F.substring_index(path, ".", 1), top)
        if not dotted:  # no child is told apart
            return out
        steps = F.split(path, r"\.")

        def child_ok(i: Column) -> Column:
            parent, leaf, listed, allowed = F.get(steps, i - 1), F.get(steps, i), F.lit(False), F.lit(False)
            for a, b in dotted:
                listed = listed | (parent == a)
                allowed = allowed | ((parent == a) & _matches(leaf, b))
            return ~listed | allowed

        return out & F.when(F.size(steps) > 1, F.forall(F.sequence(F.lit(1), F.size(steps) - 1), child_ok)).otherwise(True)

    def of(layer: Column) -> Column:
        fields = layer["fields"]
        chosen = F.when(F.lit(False), fields)
        for protocol, patterns in checked.items():

            def keep(f: Column, patterns=patterns) -> Column:
                label_shown = shown(F.concat(f["path"], F.lit("_name")), patterns)
                value_shown = shown(f["path"], patterns)
                blank = f.withField("num", F.lit(None).cast("decimal(20,0)")).withField("str", F.lit(None).cast("string"))
                return F.when(value_shown, F.when(label_shown, f).otherwise(f.withField("name", F.lit(None).cast("string")))).when(label_shown & f["name"].isNotNull(), blank)

            chosen = chosen.when(layer["protocol"] == protocol, F.array_compact(F.transform(fields, _one_argument(keep))))
        return layer.withField("fields", chosen.otherwise(fields))

    return packets.withColumn("layers", F.transform("layers", of)) if checked else packets


def _one_argument(f):
    return lambda x: f(x)


# The fields shown by default, for protocols that are decoded, counted or told apart
# here. The rest of a longer list comes from a file, see ``load_visibility``.
DEFAULT_FIELDS = {
    "Ethernet": ["dst", "src", "vlan_id", "ethertype", "ethertype_name", "length", "llc_dsap", "llc_ssap", "llc_control"],
    "ARP": ["oper", "oper_name", "sha", "spa", "tha", "tpa"],
    "IPv4": ["ttl", "protocol", "src", "dst"],
    "IPv6": ["next_header", "hop_limit", "src", "dst"],
    "TCP": ["src_port", "dst_port", "seq", "ack", "flags", "flags_name", "stream_id", "reassembly_in_progress", "segment_count"],
    "UDP": ["src_port", "dst_port"],
    "ICMP": ["type", "code", "identifier", "sequence_number", "next_hop_mtu", "length", "num_addrs", "addr_entry_size", "lifetime", "entries", "invoking_packet", "*_timestamp", "address_mask", "subtype", "local", "state", "active", "ipv4", "ipv6"],
    "ICMPv6": ["type", "code", "identifier", "sequence_number", "length", "max_response_delay", "multicast_address", "s_flag", "qrv", "qqic", "num_sources", "sources", "cur_hop_limit", "flags", "router_lifetime", "reachable_time", "retrans_timer", "target_address", "destination_address", "options", "num_records", "records", "home_agent_addresses", "query_interval", "robustness_variable", "options.type", "options.prefix_length", "options.prefix", "options.valid_lifetime", "options.preferred_lifetime", "options.link_layer_address", "options.mtu"],
    "DNS": ["id", "qr", "opcode", "rcode", "questions", "answers", "questions.name", "questions.type", "questions.class", "answers.name", "answers.type", "answers.class", "answers.ttl", "answers.rdata", "answers.rdata_*", "reassembly_in_progress", "segment_count"],
    "DHCP": ["xid", "yiaddr", "chaddr", "dhcp_message_type", "server_identifier", "requested_ip", "hostname", "domain_name", "subnet_mask", "router", "dns_server", "lease_time", "renewal_time", "rebinding_time"],
    "DHCPv6": ["msg_type", "transaction_id", "options"],
    "SCTP": ["src_port", "dst_port"],
    "HTTP": ["method", "uri", "version", "status_code", "reason_phrase", "headers", "content_length", "reassembly_in_progress", "segment_count"],
    "GENEVE": ["protocol_type", "vni"],
    "GRE": ["protocol_type", "key"],
    "VXLAN": ["vni"],
    "GTPv1-U": ["teid", "message_type", "sequence_number", "n_pdu_number", "next_extension_header_type", "extension_headers"],
    "GTPv2-C": ["message_type", "teid", "sequence_number", "ies", "ies.type_name", "ies.instance", "ies.value"],
    "PFCP": ["message_type", "seid", "sequence_number", "ies", "ies.type_name", "ies.value"],
    "TLS": ["content_type_name", "version_name", "handshake_type_name", "handshake_version_name", "cipher_suites", "cipher_suite", "cipher_suite_name", "extensions", "extensions.type_name", "extensions.server_name", "alert_level_name", "alert_description_name"],
    "RTP": ["payload_type", "sequence_number", "timestamp", "ssrc", "marker", "csrc_list"],
    "NGAP": ["pdu_type", "pdu_type_name", "procedure_code", "procedure_code_name", "ies", "ies.id_name", "ies.value"],
    "STUN": ["message_class", "message_class_name", "message_method", "message_method_name", "message_length", "transaction_id", "attributes"],
}
# Multicast DNS is the same but for what comes from reassembly over TCP.
DEFAULT_FIELDS["mDNS"] = [f for f in DEFAULT_FIELDS["DNS"] if f not in ("reassembly_in_progress", "segment_count")]
