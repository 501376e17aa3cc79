"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.labels import IGMP_TYPE, IGMP_VERSION, LLDP_TLV, NAS_DISCRIMINATOR, NAS_MM, NAS_SM, NGAP_PDU, NGAP_PROCEDURE, RTP_PAYLOAD, STUN_CLASS, STUN_METHOD
from ..functions.scalars import iso_time
from ..model import decoded, endpoints, flat_fields, transport, warnings
from ..operators import catalog, correlate, follow, project, select, stats
from ..sources import captures, decode, records
from ..sources.store import shared_folder
from .captures import BASE_SQL, CAPTURE, SIGNALLING, event_frames, event_packets, passing_signalling_packets, signalling_packets

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _add(name: str, sql: str | None, source: Callable[[SparkSession, str], DataFrame] = event_packets):
    def keep(f: Callable[[DataFrame], DataFrame]):
        _FOUND[name] = (lambda spark, sf_dir: f(source(spark, sf_dir)), sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _FOUND.items() if v[1] is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = event_packets(spark, sf_dir)
    return stats.top_talkers(packets.where(P.has_layer("dns") & P.field_gt("udp.src_port", 1024)))


# ---------------------------------------------------------------- the same packets in SQL

PACKETS = f"""e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
pk AS (SELECT event_id, user_id, event_type, k, 'c' || CAST(event_id // {CAPTURE} AS VARCHAR) AS capture_id, event_id % {CAPTURE} + 1 AS number, epoch_us(ts) AS ts_us,
 64 + CAST(floor(value) AS BIGINT) AS original_length, least(64 + CAST(floor(value) AS BIGINT), 256) AS length, 64 + k % 64 AS ttl,
 CASE WHEN event_type <> 'purchase' THEN '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) WHEN event_id % 2 = 1 THEN '10.1.0.53' ELSE '10.0.0.' || CAST(user_id % 16 AS VARCHAR) END AS src,
 CASE WHEN event_type <> 'purchase' THEN '10.1.0.' || CAST(k AS VARCHAR) WHEN event_id % 2 = 0 THEN '10.1.0.53' ELSE '10.0.0.' || CAST(user_id % 16 AS VARCHAR) END AS dst,
 CASE WHEN event_type = 'error' THEN NULL WHEN event_type <> 'purchase' THEN 1024 + event_id % 1000 WHEN event_id % 2 = 1 THEN 53 ELSE 1024 + user_id % 16 END AS sport,
 CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'signup' THEN 67 WHEN 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN 1024 + user_id % 16 ELSE 53 END END AS dport,
 CASE WHEN event_type IN ('click', 'view') THEN 'tcp' WHEN event_type IN ('purchase', 'signup') THEN 'udp' END AS transport,
 CASE event_type WHEN 'click' THEN 'Ethernet:IPv4:TCP:HTTP' WHEN 'view' THEN 'Ethernet:IPv4:TCP:TLS' WHEN 'purchase' THEN 'Ethernet:IPv4:UDP:DNS' WHEN 'signup' THEN 'Ethernet:IPv4:UDP:DHCP' ELSE 'Ethernet:IPv4:ICMP' END AS stack,
 CASE WHEN k % 4 = 2 AND event_type = 'view' THEN 'h' || CAST(k % 16 AS VARCHAR) || '.example.com' END AS sni
 FROM e)"""


def _select(rest: str) -> str:
    return f"WITH {PACKETS} {rest}"


# ---------------------------------------------------------------- predicates


def _predicate(name: str, condition, sql: str) -> None:
    _add(name, _select(f"SELECT capture_id, number FROM pk WHERE {sql}"))(lambda packets: packets.where(condition()).select("capture_id", "number"))


_predicate("p01_has_layer", lambda: P.has_layer("DNS"), "event_type = 'purchase'")
_predicate("p02_field_eq", lambda: P.field_eq("tcp.dst_port", 80), "dport = 80 AND transport = 'tcp'")
_predicate("p03_field_ne", lambda: P.field_ne("tcp.dst_port", 80), "dport <> 80 AND transport = 'tcp'")
_predicate("p04_ordered", lambda: P.field_gt("udp.src_port", 1024) & P.field_le("ipv4.ttl", 100), "transport = 'udp' AND sport > 1024 AND ttl <= 100")
_predicate("p05_literal_width", lambda: P.field_lt("ipv4.ttl", 300) | P.field_eq("dns.qr", "Query") | P.field_ge("ipv4.ttl", 120), "ttl >= 120")
_predicate("p06_string_eq", lambda: P.field_eq("http.method", "get"), "event_type = 'click' AND k % 8 <> 0 AND k % 2 = 0")
_predicate("p07_address_eq", lambda: P.field_eq("ipv4.dst", "10.1.0.9") | P.field_eq("ethernet.src", "02-00-00-00-00-0A"), "dst = '10.1.0.9' OR user_id % 256 = 10")
_predicate("p08_label", lambda: P.field_eq("tls.content_type_name", "HANDSHAKE"), "event_type = 'view' AND k % 4 = 2")
_predicate("p09_nested_path", lambda: P.field_eq("dns.questions.name", "n3.example.com"), "event_type = 'purchase' AND k % 32 = 3")
_predicate("p10_container", lambda: P.field_eq("tls.extensions", "h2.example.com"), "sni = 'h2.example.com'")
_predicate("p11_between", lambda: P.field_between("tcp.src_port", 1100, 1200) | P.field_between("ipv4.ttl", 64, 126, negate=True), "(transport = 'tcp' AND sport BETWEEN 1100 AND 1200) OR ttl NOT BETWEEN 64 AND 126")
_predicate("p12_in", lambda: P.field_in("tcp.dst_port", [80, 8080]) | P.field_in("ipv4.src", ["10.0.0.1", "10.0.0.2"]), "(transport = 'tcp' AND dport IN (80, 8080)) OR src IN ('10.0.0.1', '10.0.0.2')")
_predicate("p13_boolean", lambda: ~P.field_eq("tcp.dst_port", 80) & (P.has_layer("udp") | P.has_layer("tcp")), "NOT coalesce(transport = 'tcp' AND dport = 80, false) AND transport IS NOT NULL")
_predicate("p14_packet_number", lambda: P.packet_number(">=", 100) & P.number_between(50, 200), "number BETWEEN 100 AND 200")
_predicate("p15_number_list", lambda: P.number_in(P.parse_numbers("1,5,10-20")), "number IN (1, 5) OR number BETWEEN 10 AND 20")

# ---------------------------------------------------------------- projections

_add("f01_stack", _select("SELECT capture_id, number, stack FROM pk"))(lambda p: p.select("capture_id", "number", "stack"))


def _shown(layer: str) -> Column:
    """Paths of a layer's fields, in order, with their labels' names."""
    named = F.transform(project.first_layer(layer)["fields"], lambda f: F.concat(f["path"], F.when(f["name"].isNotNull(), F.lit("+name")).otherwise(F.lit(""))))
    return F.coalesce(F.array_join(named, " "), F.lit("-"))


@_add(
    "f02_visible_fields",
    _select("""SELECT capture_id, number, CASE WHEN transport = 'tcp' THEN 'src_port' ELSE '-' END AS tcp, CASE WHEN transport = 'udp' THEN 'src_port dst_port' ELSE '-' END AS udp, 'ttl dst' AS ipv4,
 CASE WHEN event_type = 'view' THEN CASE WHEN sni IS NULL THEN 'content_type+name' ELSE 'content_type+name extensions.server_name' END ELSE '-' END AS tls FROM pk"""),
)
def _visible(packets: DataFrame) -> DataFrame:
    shown = project.visible_fields(packets, {"TCP": ["src*"], "IPv4": ["ttl", "*st"], "TLS": ["content*", "ext*"]})
    return shown.select("capture_id", "number", *(_shown(x).alias(x.lower()) for x in ("TCP", "UDP", "IPv4", "TLS")))


@_add("f03_nested_visibility", _select("SELECT capture_id, number, 'id questions.name' AS some, 'rcode questions.name questions.type' || CASE WHEN k % 3 = 0 THEN '+name' ELSE '' END AS whole, 'id' AS none FROM pk WHERE event_type = 'purchase'"))
def _nested(packets: DataFrame) -> DataFrame:
    dns = packets.where(P.has_layer("dns"))
    of = lambda config, name: project.visible_fields(dns, {"DNS": config}).select("capture_id", "number", _shown("DNS").alias(name))
    return of(["id", "questions", "questions.na*"], "some").join(of(["rcode", "questions"], "whole"), ["capture_id", "number"]).join(of(["id"], "none"), ["capture_id", "number"])


@_add(
    "f04_default_fields",
    _select("""SELECT capture_id, number, 'src dst ethertype' AS ethernet, 'ttl src dst' AS ipv4, CASE WHEN transport = 'tcp' THEN 'src_port dst_port stream_id flags+name' ELSE '-' END AS tcp,
 CASE WHEN event_type = 'purchase' THEN 'id qr rcode questions.name questions.type' ELSE '-' END AS dns FROM pk"""),
)
def _defaults(packets: DataFrame) -> DataFrame:
    shown = project.visible_fields(packets, project.DEFAULT_FIELDS)
    return shown.select("capture_id", "number", *(_shown(x).alias(x.lower()) for x in ("Ethernet", "IPv4", "TCP", "DNS")))


_add("f06_labels", _select("SELECT capture_id, number, CASE WHEN k % 3 = 0 THEN 'A' ELSE CAST(1 + k % 3 AS VARCHAR) END AS question_type FROM pk WHERE event_type = 'purchase'"))(
    lambda p: p.where(P.has_layer("dns")).select("capture_id", "number", project.label_text(project.first_field(project.first_layer("DNS"), "questions.type")).alias("question_type"))
)
_add("f07_iso_time", _select("SELECT capture_id, number, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS time FROM pk"))(lambda p: p.select("capture_id", "number", iso_time(F.col("ts_us")).alias("time")))
_add("f08_endpoints", _select("SELECT capture_id, number, src, dst FROM pk"))(lambda p: p.select("capture_id", "number", endpoints().alias("e")).select("capture_id", "number", "e.src", "e.dst"))
_add("f09_transport", _select("SELECT capture_id, number, transport, CAST(sport AS BIGINT) AS src_port, CAST(dport AS BIGINT) AS dst_port FROM pk WHERE transport IS NOT NULL"))(
    lambda p: p.select("capture_id", "number", transport().alias("t")).where("t is not null").select("capture_id", "number", "t.transport", F.col("t.src_port").cast("long").alias("src_port"), F.col("t.dst_port").cast("long").alias("dst_port"))
)
_add(
    "f10_summary",
    _select("""SELECT capture_id, number, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS time, src AS source, dst AS destination, split_part(stack, ':', length(stack) - length(replace(stack, ':', '')) + 1) AS protocol, CAST(length AS BIGINT) AS length,
 CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Query' ELSE 'Response' END || ' n' || CAST(k % 32 AS VARCHAR) || '.example.com'
 WHEN 'click' THEN CASE WHEN k % 8 = 0 THEN CAST(200 + k AS VARCHAR) || ' OK' ELSE CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /p/' || CAST(k AS VARCHAR) END
 WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'change_cipher_spec' WHEN 1 THEN 'alert' WHEN 2 THEN 'handshake' ELSE 'application_data' END
 WHEN 'error' THEN CASE WHEN k % 8 = 0 THEN 'Echo Reply' ELSE 'type=' || CAST(k % 8 AS VARCHAR) || ' code=' || CAST(k % 4 AS VARCHAR) END
 ELSE concat_ws(' ', 'dhcp_message_type=' || CAST(1 + k % 8 AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'hostname=host' || CAST(k % 10 AS VARCHAR) END, CASE WHEN k % 3 = 0 THEN 'requested_ip=10.9.0.' || CAST(k AS VARCHAR) END) END AS info FROM pk"""),
)(lambda p: project.summarise(p).withColumn("length", F.col("length").cast("long")))
_add("f11_info_count", _select("SELECT CASE event_type WHEN 'purchase' THEN 'DNS' WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'TLS' WHEN 'error' THEN 'ICMP' ELSE 'DHCP' END AS protocol, count(*) AS packets FROM pk GROUP BY 1"))(
    lambda p: p.select(F.element_at("layers", -1)["protocol"].alias("protocol"), project.info().alias("info")).where("info <> ''").groupBy("protocol").agg(F.count("*").alias("packets"))
)
_add("f12_relative_time", _select("SELECT capture_id, number, round((ts_us - first_value(ts_us) OVER (PARTITION BY capture_id ORDER BY number)) / 1e6, 6) AS relative_s FROM pk"))(lambda p: project.with_relative_time(p).select("capture_id", "number", "relative_s"))
_add("f13_delta_time", _select("SELECT capture_id, number, round((ts_us - coalesce(lag(ts_us) OVER (PARTITION BY capture_id ORDER BY number), ts_us)) / 1e6, 6) AS delta_s FROM pk"))(lambda p: project.with_delta_time(p, bucket=512).select("capture_id", "number", "delta_s"))
_add("f14_time_format", _select("SELECT capture_id, number, printf('%.6f', (ts_us - first_value(ts_us) OVER (PARTITION BY capture_id ORDER BY number)) / 1e6) AS time FROM pk"))(lambda p: project.summarise(p, "relative").select("capture_id", "number", "time"))

# ---------------------------------------------------------------- sampling, paging, ranks

_add("l01_sample_every", _select("SELECT capture_id, number FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY number) AS n FROM pk WHERE transport = 'udp') WHERE (n - 1) % 7 = 0"))(
    lambda p: select.sample_every(p.where(P.has_layer("udp")), 7, bucket=256).select("capture_id", "number")
)
_add("l02_offset", _select("SELECT capture_id, number FROM pk WHERE transport = 'tcp' ORDER BY capture_id, number OFFSET 20"))(lambda p: select.page(p.where(P.has_layer("tcp")), offset=20, count=None).select("capture_id", "number"))
_add("l03_page", _select("SELECT capture_id, number FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY number) AS n FROM pk) WHERE (n - 1) % 3 = 0 ORDER BY capture_id, number LIMIT 5 OFFSET 2"))(
    lambda p: select.page(p, sample=3, offset=2, count=5).select("capture_id", "number")
)


_add("l04_truncated", _select("SELECT count(*) > 1000 AS truncated FROM pk WHERE transport = 'tcp'"))(lambda p: select.truncated(p.where(P.has_layer("tcp")), count=1000))
_add("l05_top_n", _select("SELECT stack, dst AS name, count FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY count DESC, dst) AS r FROM (SELECT stack, dst, count(*) AS count FROM pk GROUP BY 1, 2)) WHERE r <= 3"))(
    lambda p: select.top_n(project.with_flow(p).groupBy("stack", F.col("dst").alias("name")).count(), 3, within=("stack",))
)
_add("l06_in_order", _select("SELECT capture_id, number FROM pk WHERE event_type = 'signup' ORDER BY 1, 2"))(lambda p: select.in_order(p.where(P.has_layer("dhcp")).select("capture_id", "number")))

# ---------------------------------------------------------------- statistics

_add("a01_overview", _select("SELECT capture_id, count(*) AS total_packets, min(ts_us) / 1e6 AS start_time, max(ts_us) / 1e6 AS end_time, round((max(ts_us) - min(ts_us)) / 1e6, 3) AS duration_secs FROM pk GROUP BY 1"))(lambda p: stats.overview(p, ["capture_id"]))
_add("a02_protocol_counts", _select("SELECT name, count(*) AS count FROM (SELECT unnest(string_split(stack, ':')) AS name FROM pk) GROUP BY 1"))(stats.protocol_counts)
_add("a03_top_talkers", _select("SELECT src, dst, count(*) AS packets, CAST(sum(original_length) AS BIGINT) AS bytes FROM pk GROUP BY 1, 2 ORDER BY bytes DESC, packets DESC, src, dst LIMIT 10"))(stats.top_talkers)
_STREAM_SQL = _select("""SELECT capture_id, user_id AS stream_id, arg_min(src, event_id) AS src, CAST(arg_min(sport, event_id) AS BIGINT) AS src_port, arg_min(dst, event_id) AS dst, CAST(arg_min(dport, event_id) AS BIGINT) AS dst_port, count(*) AS packets, CAST(sum(original_length) AS BIGINT) AS bytes,
 round((max(ts_us) - min(ts_us)) / 1e6, 3) AS duration_secs FROM pk WHERE transport = 'tcp' GROUP BY 1, 2""")


@_add("a04_tcp_streams_all", _STREAM_SQL)
@_add("a04_tcp_streams", _STREAM_SQL)
def _tcp_streams(packets: DataFrame) -> DataFrame:
    return stats.tcp_streams(packets, None, by=["capture_id"]).withColumn("src_port", F.col("src_port").cast("long")).withColumn("dst_port", F.col("dst_port").cast("long"))


_RTT = """q AS (SELECT *, sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, user_id % 16 ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM pk WHERE event_type = 'purchase'),
pairs AS (SELECT capture_id, min(CASE WHEN event_id % 2 = 0 THEN number END) AS query_number, max(CASE WHEN event_id % 2 = 1 THEN number END) AS response_number,
 (max(CASE WHEN event_id % 2 = 1 THEN ts_us END) - arg_min(ts_us, CASE WHEN event_id % 2 = 0 THEN number END)) / 1e6 AS rtt FROM q GROUP BY capture_id, user_id % 16, coalesce(g, 0)
 HAVING count(CASE WHEN event_id % 2 = 0 THEN 1 END) > 0 AND count(CASE WHEN event_id % 2 = 1 THEN 1 END) > 0)"""
_add("j01_rtt_pairs", _select(f", {_RTT} SELECT * FROM pairs").replace("FROM e) ,", "FROM e),"))(correlate.dns_pairs)
_add("a34_rtt_summary", _select(f", {_RTT} SELECT count(*) AS count, min(rtt) AS min, max(rtt) AS max, avg(rtt) AS mean, quantile_cont(rtt, 0.5) AS median, quantile_cont(rtt, 0.95) AS p95, quantile_cont(rtt, 0.99) AS p99 FROM pairs").replace("FROM e) ,", "FROM e),"))(
    lambda p: stats.response_summary(correlate.dns_pairs(p)).select("count", "min", "max", F.round("mean", 6).alias("mean"), "median", "p95", "p99")
)
_FOUND["a34_rtt_summary"] = (_FOUND["a34_rtt_summary"][0], _FOUND["a34_rtt_summary"][1].replace("avg(rtt) AS mean", "round(avg(rtt), 6) AS mean"))
_add("a36_document", None)(lambda p: stats.document(p))


# Frequency tables: rows (protocol, metric, group, name) in SQL, then one count.


def _value(layer: str, path: str, how: str = "label") -> str:
    _, _, value, shown = next(x for x in SIGNALLING[layer] if x[0] == path)
    text = f"CAST(({value}) AS VARCHAR)"
    return f"coalesce({shown}, {text})" if how == "label" and shown else text


def _names(code: str, table: dict[int, str], other: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items())
    return f"CASE WHEN ({code}) IS NOT NULL THEN CASE ({code}) {cases} ELSE {other} END END"


def _code(layer: str, path: str) -> str:
    return next(x for x in SIGNALLING[layer] if x[0] == path)[2]


_UNKNOWN = "'Unknown'"
_EVENT_ROWS: dict[str, dict[str, tuple[str, str]]] = {
    "dns": {
        "total_queries": ("''", "event_type = 'purchase' AND event_id % 2 = 0"),
        "total_responses": ("''", "event_type = 'purchase' AND event_id % 2 = 1"),
        "top_query_names": ("'n' || CAST(k % 32 AS VARCHAR) || '.example.com'", "event_type = 'purchase' AND event_id % 2 = 0"),
        "query_type_distribution": ("CASE WHEN k % 3 = 0 THEN 'A' ELSE 'TYPE' || CAST(1 + k % 3 AS VARCHAR) END", "event_type = 'purchase' AND event_id % 2 = 0"),
        "rcode_distribution": ("'RCODE' || CAST(k % 4 AS VARCHAR)", "event_type = 'purchase' AND event_id % 2 = 1"),
    },
    "http": {
        "total_requests": ("''", "event_type = 'click' AND k % 8 <> 0"),
        "total_responses": ("''", "event_type = 'click' AND k % 8 = 0"),
        "method_distribution": ("CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END", "event_type = 'click' AND k % 8 <> 0"),
        "status_code_distribution": ("CAST(200 + k AS VARCHAR)", "event_type = 'click' AND k % 8 = 0"),
        "top_uris": ("'/p/' || CAST(k AS VARCHAR)", "event_type = 'click' AND k % 8 <> 0"),
    },
    "tls": {
        "total_records": ("''", "event_type = 'view'"),
        "content_type_distribution": ("CASE k % 4 WHEN 0 THEN 'change_cipher_spec' WHEN 1 THEN 'alert' WHEN 2 THEN 'handshake' ELSE 'application_data' END", "event_type = 'view'"),
        "version_distribution": ("'TLS 1.2'", "event_type = 'view'"),
        "top_server_names": ("sni", "event_type = 'view'"),
    },
    "dhcp": {
        "total_packets": ("''", "event_type = 'signup'"),
        "message_type_distribution": ("CAST(1 + k % 8 AS VARCHAR)", "event_type = 'signup'"),
        "top_hostnames": ("'host' || CAST(k % 10 AS VARCHAR)", "event_type = 'signup' AND k % 2 = 0"),
        "top_requested_ips": ("'10.9.0.' || CAST(k AS VARCHAR)", "event_type = 'signup' AND k % 3 = 0"),
    },
    "icmp": {
        "total_packets": ("''", "event_type = 'error'"),
        "type_distribution": ("CASE WHEN k % 8 = 0 THEN 'Echo Reply' ELSE CAST(k % 8 AS VARCHAR) END", "event_type = 'error'"),
        "code_distribution": ("CAST(k % 4 AS VARCHAR)", "event_type = 'error'"),
    },
}


def _signalling_rows() -> dict[str, dict[str, tuple[str, str]]]:
    v, is_ = _value, {name: f"p = {k}" for k, name in enumerate(SIGNALLING)}
    mm, sm = f"{is_['NAS-5G']} AND a < 3", f"{is_['NAS-5G']} AND a >= 3 AND a < 6"
    query, answer = f"{is_['SIP']} AND NOT (a > 0 AND a % 2 = 1)", f"{is_['SIP']} AND a > 0 AND a % 2 = 1"
    rtp = _code("RTP", "payload_type")
    out: dict[str, dict[str, tuple[str, str]]] = {
        "mdns": {"total_packets": ("''", is_["mDNS"]), "total_queries": ("''", f"{is_['mDNS']} AND a % 2 = 0"), "total_responses": ("''", f"{is_['mDNS']} AND a % 2 = 1"), "top_query_names": (v("mDNS", "questions.name"), is_["mDNS"]), "query_type_distribution": ("CASE WHEN a % 3 = 0 THEN 'PTR' ELSE 'TYPE' || CAST(12 + a % 3 AS VARCHAR) END", is_["mDNS"]), "service_distribution": (v("mDNS", "questions.name"), f"{is_['mDNS']} AND a < 4")},
        "http2": {"total_frames": ("''", is_["HTTP2"]), "frame_type_distribution": (v("HTTP2", "frame_type"), is_["HTTP2"]), "error_code_distribution": (v("HTTP2", "error_code"), is_["HTTP2"]), "top_stream_ids": (v("HTTP2", "stream_id"), is_["HTTP2"])},
        "sip": {"total_requests": ("''", query), "total_responses": ("''", answer), "method_distribution": (v("SIP", "method"), query), "status_code_distribution": (v("SIP", "status_code"), answer)},
        "diameter": {"total_messages": ("''", is_["Diameter"]), "total_requests": ("''", f"{is_['Diameter']} AND a % 2 = 1"), "total_answers": ("''", f"{is_['Diameter']} AND a % 2 = 0"), "command_code_distribution": (v("Diameter", "command_code"), is_["Diameter"]), "application_id_distribution": (v("Diameter", "application_id"), is_["Diameter"]), "result_code_distribution": (v("Diameter", "avps.value"), f"{is_['Diameter']} AND a % 2 = 0")},
        "gtpv1u": {"total_packets": ("''", is_["GTPv1-U"]), "message_type_distribution": (v("GTPv1-U", "message_type"), is_["GTPv1-U"]), "top_teids": (v("GTPv1-U", "teid"), is_["GTPv1-U"])},
        "gtpv2c": {"total_messages": ("''", is_["GTPv2-C"]), "message_type_distribution": (v("GTPv2-C", "message_type"), is_["GTPv2-C"]), "unique_imsi_count": (v("GTPv2-C", "ies.value"), f"{is_['GTPv2-C']} AND a < 3"), "unique_teid_count": (v("GTPv2-C", "teid"), is_["GTPv2-C"]), "cause_per_message_type": (v("GTPv2-C", "ies.value.cause_value"), f"{is_['GTPv2-C']} AND a >= 3 AND a < 6"), "plmn_distribution": ("'999-' || CAST(70 + b % 4 AS VARCHAR)", f"{is_['GTPv2-C']} AND a >= 6")},
        "ngap": {"total_messages": ("''", is_["NGAP"]), "pdu_type_distribution": (_names("a % 4", NGAP_PDU, _UNKNOWN), is_["NGAP"]), "procedure_code_distribution": (_names("a * 8 + b", NGAP_PROCEDURE, _UNKNOWN), is_["NGAP"])},
        "nas5g": {"total_messages": ("''", is_["NAS-5G"]), "epd_distribution": (_names(_code("NAS-5G", "extended_protocol_discriminator"), NAS_DISCRIMINATOR, _UNKNOWN), is_["NAS-5G"]), "mm_message_type_distribution": (_names("65 + b", NAS_MM, _UNKNOWN), mm), "sm_message_type_distribution": (_names("193 + b", NAS_SM, _UNKNOWN), sm)},
        "rtp": {"total_packets": ("''", is_["RTP"]), "payload_type_distribution": (_names(rtp, RTP_PAYLOAD, f"CASE WHEN {rtp} BETWEEN 96 AND 127 THEN 'Dynamic(' || CAST({rtp} AS VARCHAR) || ')' ELSE 'PT(' || CAST({rtp} AS VARCHAR) || ')' END"), is_["RTP"]), "ssrc_distribution": ("printf('0x%08X', 4096 + b)", is_["RTP"])},
        "stun": {"total_messages": ("''", is_["STUN"]), "class_distribution": (_names("a % 5", STUN_CLASS, _UNKNOWN), is_["STUN"]), "method_distribution": (_names("b % 3", STUN_METHOD, _UNKNOWN), is_["STUN"])},
        "arp": {"total_packets": ("''", is_["ARP"]), "oper_distribution": (v("ARP", "oper"), is_["ARP"]), "top_spa": (v("ARP", "spa"), is_["ARP"]), "top_sha": (v("ARP", "sha"), is_["ARP"])},
        "igmp": {"total_packets": ("''", is_["IGMP"]), "type_distribution": (_names(_code("IGMP", "type"), IGMP_TYPE, _UNKNOWN), is_["IGMP"]), "version_distribution": (_names(_code("IGMP", "type"), IGMP_VERSION, "'Other'"), is_["IGMP"]), "top_group_addresses": ("CASE WHEN a <> 4 THEN '239.0.0.' || CAST(b AS VARCHAR) ELSE '239.0.1.' || CAST(b AS VARCHAR) END", is_["IGMP"])},
        "lldp": {"total_packets": ("''", is_["LLDP"]), "tlv_type_distribution": (_names("a * 2 + b % 2", LLDP_TLV, "'Reserved'"), is_["LLDP"]), "top_system_names": ("'sw' || CAST(b AS VARCHAR)", f"{is_['LLDP']} AND a * 2 + b % 2 = 5")},
        "ntp": {"total_packets": ("''", is_["NTP"]), "mode_distribution": (v("NTP", "mode"), is_["NTP"]), "stratum_distribution": (v("NTP", "stratum"), is_["NTP"]), "version_distribution": (v("NTP", "version"), is_["NTP"])},
        "ospf": {"total_packets": ("''", f"({is_['OSPFv2']} OR {is_['OSPFv3']})"), "packet_type_distribution": (f"CASE WHEN {is_['OSPFv2']} AND a % 5 = 0 THEN 'Hello' ELSE CAST(1 + a % 5 AS VARCHAR) END", f"({is_['OSPFv2']} OR {is_['OSPFv3']})"), "version_distribution": (f"CASE WHEN {is_['OSPFv2']} THEN 'v2' ELSE 'v3' END", f"({is_['OSPFv2']} OR {is_['OSPFv3']})")},
        "sctp": {"total_packets": ("''", is_["SCTP"]), "top_src_ports": (v("SCTP", "src_port"), is_["SCTP"]), "top_dst_ports": (v("SCTP", "dst_port"), is_["SCTP"]), "top_port_pairs": ("CAST(2900 + a AS VARCHAR) || ':' || CAST(38412 + b AS VARCHAR)", is_["SCTP"])},
    }
    simple = {
        "pfcp": ("PFCP", "total_messages", {"message_type_distribution": "message_type"}), "radius": ("RADIUS", "total_packets", {"code_distribution": "code"}), "dhcpv6": ("DHCPv6", "total_packets", {"msg_type_distribution": "msg_type"}),
        "icmpv6": ("ICMPv6", "total_packets", {"type_distribution": "type", "code_distribution": "code"}), "bgp": ("BGP", "total_messages", {"message_type_distribution": "type"}), "vxlan": ("VXLAN", "total_packets", {"top_vnis": "vni"}),
        "geneve": ("GENEVE", "total_packets", {"protocol_type_distribution": "protocol_type", "top_vnis": "vni"}), "gre": ("GRE", "total_packets", {"protocol_type_distribution": "protocol_type", "top_keys": "key"}),
    }
    for key, (layer, count, tables) in simple.items():
        out[key] = {count: ("''", is_[layer])} | {metric: (v(layer, path), is_[layer]) for metric, path in tables.items()}
    return out


def _frequency_sql(rows: dict[str, dict[str, tuple[str, str]]], base: str, source: str) -> str:
    parts = []
    for key, metrics in rows.items():
        for metric, (name, where) in metrics.items():
            group = "'M' || CAST(a AS VARCHAR)" if metric == "cause_per_message_type" else "CAST(NULL AS VARCHAR)"
            parts.append(f"SELECT '{key}' AS protocol, '{metric}' AS metric, {group} AS grp, {name} AS name FROM {source} WHERE {where}")
    return f"""WITH {base}, rows_ AS ({" UNION ALL ".join(parts)}), n AS (SELECT protocol, metric, grp, name, count(*) AS count FROM rows_ WHERE name IS NOT NULL GROUP BY ALL),
u AS (SELECT protocol, metric, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS VARCHAR) AS name, count(*) AS count FROM n WHERE metric LIKE 'unique%' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY protocol, metric, grp ORDER BY count DESC, name) AS k FROM n WHERE metric NOT LIKE 'unique%')
SELECT protocol, metric, grp, CASE WHEN metric LIKE 'total%' THEN NULL ELSE name END AS name, count FROM r WHERE k <= 10 UNION ALL SELECT * FROM u"""


def _frequencies(protocols: list[str] | None):
    return lambda p: stats.frequencies(p, protocols).withColumnRenamed("group", "grp")


_SIGNAL_ROWS = _signalling_rows()
_add("freq_all", _frequency_sql(_SIGNAL_ROWS, f"s AS ({BASE_SQL})", "s"), passing_signalling_packets)(_frequencies(None))
_add("freq_events", _frequency_sql(_EVENT_ROWS, PACKETS, "pk"))(_frequencies(None))
_IDS = dict(zip("dns mdns http http2 tls sip diameter gtpv1u gtpv2c pfcp ngap nas5g radius dhcp dhcpv6 rtp stun icmp icmpv6 arp igmp lldp ntp bgp ospf sctp vxlan geneve gre".split(), range(5, 34)))
for _key, _n in _IDS.items():
    if _key in _EVENT_ROWS:
        _add(f"a{_n:02d}_{_key}", _frequency_sql({_key: _EVENT_ROWS[_key]}, PACKETS, "pk"))(_frequencies([_key]))
    else:
        _add(f"a{_n:02d}_{_key}", _frequency_sql({_key: _SIGNAL_ROWS[_key]}, f"s AS ({BASE_SQL})", "s"), signalling_packets)(_frequencies([_key]))

_add("a35_filtered_talkers", _select("SELECT src, dst, count(*) AS packets, CAST(sum(original_length) AS BIGINT) AS bytes FROM pk WHERE event_type = 'purchase' AND sport > 1024 GROUP BY 1, 2 ORDER BY bytes DESC, packets DESC, src, dst LIMIT 10"))(
    lambda p: stats.top_talkers(p.where(P.has_layer("dns") & P.field_gt("udp.src_port", 1024)))
)

# ---------------------------------------------------------------- streams

_KEY = """CASE WHEN transport = 'tcp' THEN 'tcp:' || CAST(user_id AS VARCHAR) WHEN (src, sport) <= (dst, dport) THEN 'udp:' || src || ':' || CAST(sport AS VARCHAR) || '-' || dst || ':' || CAST(dport AS VARCHAR)
 ELSE 'udp:' || dst || ':' || CAST(dport AS VARCHAR) || '-' || src || ':' || CAST(sport AS VARCHAR) END"""
_STREAMS = _select(f", k2 AS (SELECT *, {_KEY} AS stream_key FROM pk WHERE transport IS NOT NULL) ").replace("FROM e) ,", "FROM e),")
_add("w01_stream_key", _STREAMS + "SELECT capture_id, number, stream_key FROM k2")(lambda p: p.select("capture_id", "number", follow.stream_key().alias("stream_key")).where("stream_key is not null"))
_add("w02_follow", _STREAMS + "SELECT capture_id, number FROM k2 WHERE stream_key = 'tcp:7'")(lambda p: follow.follow(p, "tcp:7").select("capture_id", "number"))
_add("w03_direction", _STREAMS + "SELECT capture_id, number, stream_key, src = first_value(src) OVER (PARTITION BY capture_id, stream_key ORDER BY number) AS from_client FROM k2")(
    lambda p: follow.with_stream(p).select("capture_id", "number", "stream_key", "from_client")
)



@_add("w04_payload_lines", _STREAMS + ", t AS (SELECT capture_id, stream_key, number, 'GET /p/' || CAST(k AS VARCHAR) AS one, 'Host: ' || dst AS two FROM k2 WHERE event_type = 'click') SELECT capture_id, stream_key, number, CAST(0 AS BIGINT) AS line_number, one AS line FROM t UNION ALL SELECT capture_id, stream_key, number, CAST(1 AS BIGINT), two FROM t")
def _payload(packets: DataFrame) -> DataFrame:
    return follow.payload_lines(follow.with_stream(packets)).select("capture_id", "stream_key", "number", F.col("line_number").cast("long"), "line")


# ---------------------------------------------------------------- catalog

_add("c01_protocols", _select("SELECT DISTINCT unnest(string_split(stack, ':')) AS protocol FROM pk"))(lambda p: catalog.protocols(p).select("protocol"))
_add("c02_fields", _select("SELECT * FROM (VALUES ('http.method', 'HTTP', 'method', 'str', true), ('http.uri', 'HTTP', 'uri', 'str', true), ('http.status_code', 'HTTP', 'status_code', 'u16', true), ('http.reason_phrase', 'HTTP', 'reason_phrase', 'str', true)) t(qualified_name, protocol, path, kind, optional)"))(
    lambda p: catalog.fields(p, "http")
)
def _descriptor(path: str, kind: str, children: str = "''") -> str:
    """SQL for the JSON text of a DNS field."""
    name = path.rsplit(".", 1)[-1].title()
    return f"""'{{"qualified_name":"dns.{path}","display_name":"{name}","type":"{kind}","optional":false,"protocol":"DNS"' || {children} || '}}'"""


_QUESTIONS = "',\"children\":[' || " + _descriptor("questions.name", "str") + " || ',' || " + _descriptor("questions.type", "u16") + " || ']'"
_TREES = {"id": _descriptor("id", "u16"), "qr": _descriptor("qr", "u8"), "questions": _descriptor("questions", "object", _QUESTIONS), "rcode": _descriptor("rcode", "u8")}
_add("c02_field_trees", _select(" UNION ".join(f"SELECT DISTINCT 'DNS' AS protocol, 'dns.{path}' AS qualified_name, {text} AS descriptor FROM pk WHERE event_type = 'purchase'" for path, text in _TREES.items())))(lambda p: catalog.field_trees(p, "dns"))
_add(
    "c02_field_nodes",
    _select("""SELECT 'TLS' AS protocol, path, kind, parent, optional FROM (VALUES ('content_type', 'u8', NULL, false), ('version', 'u16', NULL, false), ('extensions', 'object', NULL, true), ('extensions.server_name', 'str', 'extensions', false)) t(path, kind, parent, optional)"""),
)(lambda p: catalog.field_nodes(p, "tls"))
_PATHS = {
    "true": "ethernet.src ethernet.dst ethernet.ethertype ipv4.ttl ipv4.src ipv4.dst",
    "event_type = 'click'": "tcp.src_port tcp.dst_port tcp.stream_id tcp.flags",
    "event_type = 'view'": "tcp.src_port tcp.dst_port tcp.stream_id tcp.flags tls.content_type tls.version",
    "event_type = 'click' AND k % 8 <> 0": "http.method http.uri",
    "event_type = 'click' AND k % 8 = 0": "http.status_code http.reason_phrase",
    "sni IS NOT NULL": "tls.extensions.server_name",
    "event_type = 'purchase'": "udp.src_port udp.dst_port dns.id dns.qr dns.rcode dns.questions.name dns.questions.type",
    "event_type = 'signup'": "udp.src_port udp.dst_port dhcp.dhcp_message_type",
    "event_type = 'signup' AND k % 2 = 0": "dhcp.hostname",
    "event_type = 'signup' AND k % 3 = 0": "dhcp.requested_ip",
    "event_type = 'error'": "icmp.type icmp.code",
}
_add("c04_field_paths", _select(" UNION ".join(f"SELECT DISTINCT unnest(string_split('{paths}', ' ')) AS path FROM pk WHERE {where}" for where, paths in _PATHS.items())))(catalog.field_paths)
_add("c05_field_values", _select("SELECT DISTINCT CAST(1 + k % 3 AS VARCHAR) AS value FROM pk WHERE event_type = 'purchase' "))(lambda p: catalog.field_values(p, "dns.questions.type"))
_add("s09_warnings", _select("SELECT capture_id, number, 'no dissector' AS decode_error FROM pk WHERE event_type = 'error'"))(
    lambda p: warnings(p.withColumn("decode_error", F.when(P.has_layer("icmp"), F.lit("no dissector"))))
)
@_add(
    "s09_torn_frames",
    _select("""SELECT capture_id, number, CASE WHEN event_id % 5 = 0 THEN 'unknown link type' WHEN event_id % 5 = 1 THEN 'truncated frame' ELSE 'truncated packet' END AS decode_error FROM pk WHERE event_id % 5 < 3"""),
    event_frames,
)
def _torn(frames: DataFrame) -> DataFrame:
    """Frames of another link type, cut within the link header, and cut within the network header."""
    number = F.conv(F.substring("capture_id", 2, 20), 10, 10).cast("long") * CAPTURE + F.col("number") - 1
    kept = F.when(number % 5 == 1, 10).when(number % 5 == 2, 30).otherwise(F.octet_length("raw"))
    torn = frames.withColumn("link_type", F.when(number % 5 == 0, 113).otherwise(1)).withColumn("raw", F.substring(F.col("raw"), F.lit(1), kept))
    return warnings(decode.decode(torn))


@_add("s04_decode_as", _select("SELECT capture_id, number, CASE event_type WHEN 'view' THEN 'Ethernet:IPv4:TCP:tunnel' WHEN 'signup' THEN 'Ethernet:IPv4:UDP:boot' ELSE 'Ethernet:IPv4:TCP:HTTP' END AS stack FROM pk WHERE event_type IN ('click', 'view', 'signup')"), event_frames)
def _decode_as(frames: DataFrame) -> DataFrame:
    """Protocols above ports: two by override, one by the known port."""
    carried = frames.withColumn("raw", F.concat("raw", F.lit(b"x")))
    named = decode.decode(carried, [("tcp.port", 443, "tunnel"), ("udp.port", 67, "first"), ("udp.port", 67, "Boot")])
    return named.where(F.col("dst_port").isin(80, 443, 67)).select("capture_id", "number", "stack")


_add("s06_raw_hex", _select("SELECT capture_id, number, lower(hex('GET /p/' || CAST(k AS VARCHAR) || chr(13) || chr(10) || 'Host: ' || dst || chr(13) || chr(10))) AS raw_bytes FROM pk WHERE event_type = 'click'"))(
    lambda p: p.where(P.has_layer("http") & F.col("payload").isNotNull()).withColumn("raw", F.col("payload")).select("capture_id", "number", records.raw_hex().alias("raw_bytes"))
)
_add("s01_flat_fields", _select("SELECT 'TCP' AS protocol, 'dst_port' AS path, CAST(dport AS BIGINT) AS num, count(*) AS count FROM pk WHERE transport = 'tcp' GROUP BY dport"))(
    lambda p: flat_fields(decoded(p)).where("protocol = 'TCP' and path = 'dst_port'").groupBy("protocol", "path", F.col("num").cast("long").alias("num")).count()
)

# ---------------------------------------------------------------- records


def _json(*parts: str) -> str:
    """Members of a JSON object, each with its comma, joined in SQL; those that are null are left out."""
    return "concat_ws(',', " + ", ".join(parts) + ")"


def _member(key: str, value: str, text: bool = True) -> str:
    return f"""'"{key}":"' || {value} || '"'""" if text else f"""'"{key}":' || CAST({value} AS VARCHAR)"""


def _object(protocol: str, members: str) -> str:
    return f"""'{{"protocol":"{protocol}","fields":{{' || {members} || '}}}}'"""


_LAST = f"""CASE event_type
 WHEN 'click' THEN {_object("HTTP", _json("CASE WHEN k % 8 <> 0 THEN " + _member("method", "CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END") + " END", "CASE WHEN k % 8 <> 0 THEN " + _member("uri", "'/p/' || CAST(k AS VARCHAR)") + " END", "CASE WHEN k % 8 = 0 THEN " + _member("status_code", "200 + k", False) + " END", "CASE WHEN k % 8 = 0 THEN " + _member("reason_phrase", "'OK'") + " END"))}
 WHEN 'view' THEN {_object("TLS", _json(_member("content_type", "20 + k % 4", False), _member("content_type_name", "CASE k % 4 WHEN 0 THEN 'change_cipher_spec' WHEN 1 THEN 'alert' WHEN 2 THEN 'handshake' ELSE 'application_data' END"), _member("version", "771", False), _member("version_name", "'TLS 1.2'"), "'\"extensions\":[{\"server_name\":\"' || sni || '\"}]'"))}
 WHEN 'purchase' THEN {_object("DNS", _json(_member("id", "user_id % 16", False), _member("qr", "event_id % 2", False), _member("rcode", "k % 4", False), "'\"questions\":[{\"name\":\"n' || CAST(k % 32 AS VARCHAR) || '.example.com\",\"type\":' || CAST(1 + k % 3 AS VARCHAR) || CASE WHEN k % 3 = 0 THEN ',\"type_name\":\"A\"' ELSE '' END || '}]'"))}
 WHEN 'signup' THEN {_object("DHCP", _json(_member("dhcp_message_type", "1 + k % 8", False), "CASE WHEN k % 2 = 0 THEN " + _member("hostname", "'host' || CAST(k % 10 AS VARCHAR)") + " END", "CASE WHEN k % 3 = 0 THEN " + _member("requested_ip", "'10.9.0.' || CAST(k AS VARCHAR)") + " END"))}
 ELSE {_object("ICMP", _json(_member("type", "k % 8", False), "CASE WHEN k % 8 = 0 THEN " + _member("type_name", "'Echo Reply'") + " END", _member("code", "k % 4", False)))} END"""
_LAYERS = ", ".join(
    [
        _object("Ethernet", _json(_member("src", "'02:00:00:00:00:' || lower(lpad(to_hex(user_id % 256), 2, '0'))"), _member("dst", "'02:00:00:00:01:01'"), _member("ethertype", "2048", False))),
        _object("IPv4", _json(_member("ttl", "ttl", False), _member("src", "src"), _member("dst", "dst"))),
        "CASE WHEN transport = 'tcp' THEN " + _object("TCP", _json(_member("src_port", "sport", False), _member("dst_port", "dport", False), _member("stream_id", "user_id", False), _member("flags", "16 + 8 * (k % 2)", False), _member("flags_name", "CASE WHEN k % 2 = 1 THEN 'PSH,ACK' ELSE 'ACK' END"))) + " END",
        "CASE WHEN transport = 'udp' THEN " + _object("UDP", _json(_member("src_port", "sport", False), _member("dst_port", "dport", False))) + " END",
        _LAST,
    ]
)
_add(
    "s05_records",
    _select(f"""SELECT '{{"number":' || CAST(number AS VARCHAR) || ',"timestamp":"' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '","length":' || CAST(length AS VARCHAR) || ',"original_length":' || CAST(original_length AS VARCHAR) || ',"stack":"' || stack || '","layers":[' || concat_ws(',', {_LAYERS}) || ']}}' AS value FROM pk"""),
)(records.to_records)


@_add("s01_records", _select("SELECT protocol, path, kind, count(*) AS count, CAST(sum(num) AS BIGINT) AS total FROM (" + " UNION ALL ".join(
    f"SELECT '{protocol}' AS protocol, '{path}' AS path, '{kind}' AS kind, {num} AS num FROM pk WHERE {where}"
    for protocol, path, kind, num, where in (
        ("Ethernet", "ethertype", "u16", "2048", "true"), ("IPv4", "ttl", "u8", "ttl", "true"), ("IPv4", "src", "ipv4addr", "NULL", "true"), ("TCP", "dst_port", "u16", "dport", "transport = 'tcp'"),
        ("TCP", "stream_id", "u32", "user_id", "transport = 'tcp'"), ("DNS", "questions.type", "u16", "1 + k % 3", "event_type = 'purchase'"), ("TLS", "extensions.server_name", "str", "NULL", "sni IS NOT NULL"), ("ICMP", "code", "u8", "k % 4", "event_type = 'error'"),
    )) + ") GROUP BY 1, 2, 3"))
def _records_back(packets: DataFrame) -> DataFrame:
    """Writes all packets as records, reads them again and counts fields by kind."""
    spark = packets.sparkSession
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    records.write_records(packets, path)
    kinds = [(r.protocol, r.path, r.kind) for r in catalog.fields(packets).collect()]
    wanted = F.concat_ws(".", "proto_norm", "path").isin("ethernet.ethertype", "ipv4.ttl", "ipv4.src", "tcp.dst_port", "tcp.stream_id", "dns.questions.type", "tls.extensions.server_name", "icmp.code")
    return flat_fields(records.read_records(spark, path, kinds)).where(wanted).groupBy("protocol", "path", "kind").agg(F.count("*").alias("count"), F.sum("num").cast("long").alias("total"))


# ---------------------------------------------------------------- capture files

# an address has four octets of 8 bits: 10 and the low 24 bits of a user's id, also where there are more users than two octets hold
_HEADERS = _select("""SELECT ts_us, CAST(original_length AS BIGINT) AS original_length,
 CASE WHEN event_type <> 'purchase' THEN '10.' || CAST(user_id // 65536 % 256 AS VARCHAR) || '.' || CAST(user_id // 256 % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) ELSE src END AS src, dst, transport, CAST(sport AS BIGINT) AS src_port, CAST(dport AS BIGINT) AS dst_port, CAST(ttl AS BIGINT) AS ttl,
 'Ethernet:IPv4:' || coalesce(upper(transport), 'ICMP') AS stack FROM pk""")


def _headers(packets: DataFrame) -> DataFrame:
    ttl = project.first_field(project.first_layer("IPv4"), "ttl")["num"].cast("long")
    return packets.select("ts_us", F.col("original_length").cast("long"), "src", "dst", "transport", F.col("src_port").cast("long"), F.col("dst_port").cast("long"), ttl.alias("ttl"), "stack")


@_add("s03_decode", _HEADERS, event_frames)
def _decoded(frames: DataFrame) -> DataFrame:
    return _headers(decode.decode(frames))


@_add("s02_s07_capture_files", _HEADERS, event_frames)
def _round_trip(frames: DataFrame) -> DataFrame:
    """Exports all frames as capture files, reads these in ranges and decodes them."""
    spark = frames.sparkSession
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    captures.write_capture(frames, path)
    return _headers(decode.decode(captures.read_capture(spark, path)))
