"""Headers from bytes: Ethernet, ARP, IPv4, IPv6, ICMP, TCP, UDP, SCTP and DNS, a batch of packets at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from ipaddress import IPv4Address, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import DECODED, as_packets, normalised

#: Well-known ports of the protocols that are named; DNS and mDNS are decoded further.
PORTS = {("udp", 53): "DNS", ("tcp", 53): "DNS", ("udp", 5353): "mDNS", ("tcp", 80): "HTTP", ("tcp", 443): "TLS"}
_TABLES = {"tcp.port": "tcp", "udp.port": "udp"}

# Frame types, and the next-header numbers of IPv6 that come before the transport.
IPV4, IPV6, ARP, TAGS = 0x0800, 0x86DD, 0x0806, (0x8100, 0x88A8)
EXTENSIONS, FRAGMENT, AUTHENTICATION = (0, 43, 60, 135), 44, 51


def check_overrides(overrides: Iterable[tuple[str, int, str]]) -> dict[tuple[str, int], str]:
    """``(table, port, protocol)`` by transport and port; the last one of a port holds."""
    out = {}
    for table, port, protocol in overrides:
        key = _TABLES.get(str(table).strip().lower())
        if key is None:
            raise ValueError(f"unknown table {table!r}")
        if not isinstance(port, int) or not 0 <= port <= 65535:
            raise ValueError(f"not a port: {port!r}")
        if not str(protocol).strip():
            raise ValueError("an empty protocol")
        out[key, port] = str(protocol).strip().lower()
    return out


# ---------------------------------------------------------------- DNS


def _name(message: bytes, at: int) -> tuple[str, int]:
    """A name, which may point back, and the place after it; a broken one ends where it breaks."""
    parts, after, hops = [], None, 0
    while at < len(message) and message[at] and hops < 64:
        n = message[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(message):
                break
            after = at + 2 if after is None else after
            at, hops = (n & 0x3F) << 8 | message[at + 1], hops + 1
        else:
            parts.append(message[at + 1 : at + 1 + n].decode("ascii", "replace"))
            at += 1 + n
    return ".".join(parts), at + 1 if after is None else after


def _record_text(message: bytes, kind: int, at: int, size: int) -> str | None:
    data = message[at : at + size]
    if kind == 1 and size == 4:
        return str(IPv4Address(data))
    if kind == 28 and size == 16:
        return str(IPv6Address(data))
    if kind in (2, 5, 12):
        return _name(message, at)[0]
    return data.hex() if data else None


def dns_fields(message: bytes) -> list[tuple[str, tuple[int, ...], str, int | str | None]]:
    """``path, places, kind, value`` of a DNS message: its header, questions and answers."""
    if len(message) < 12:
        return []
    number = lambda at, n=2: int.from_bytes(message[at : at + n], "big")
    flags, at = number(2), 12
    out: list[tuple] = [("id", (), "u16", number(0)), ("qr", (), "u8", flags >> 15), ("opcode", (), "u8", flags >> 11 & 15), ("rcode", (), "u8", flags & 15)]
    for i in range(number(4)):
        name, at = _name(message, at)
        if at + 4 > len(message):
            return out
        out += [("questions.name", (i,), "str", name), ("questions.type", (i,), "u16", number(at)), ("questions.class", (i,), "u16", number(at + 2))]
        at += 4
    for i in range(number(6)):
        name, at = _name(message, at)
        if at + 10 > len(message) or at + 10 + number(at + 8) > len(message):
            return out
        kind, size = number(at), number(at + 8)
        out += [("answers.name", (i,), "str", name), ("answers.type", (i,), "u16", kind), ("answers.class", (i,), "u16", number(at + 2)), ("answers.ttl", (i,), "u32", number(at + 4, 4))]
        out += [("answers.rdata", (i,), "str", _record_text(message, kind, at + 10, size))]
        at += 10 + size
    return out


# ---------------------------------------------------------------- headers


class _Bytes:
    """Big-endian numbers at any places of a batch's bytes; places past the end read zeros."""

    def __init__(self, column: pa.Array):
        column = column.fill_null(b"") if column.null_count else column
        wide = pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.base, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.data = np.concatenate([data, np.zeros(64, np.uint8)])
        self.last = len(self.data) - 17

    def number(self, rows: np.ndarray, at: np.ndarray | int, n: int) -> np.ndarray:
        start, out = np.minimum(self.base[rows] + at, self.last), np.zeros(len(rows), np.int64)
        for k in range(n):
            out = out << 8 | self.data[start + k]
        return out

    def rows_of(self, rows: np.ndarray, at: np.ndarray | int, n: int) -> np.ndarray:
        """The ``n`` bytes at a place of each row."""
        return self.data[np.minimum(self.base[rows] + at, self.last)[:, None] + np.arange(n)]

    def piece(self, row: int, at: int) -> bytes:
        return self.data[self.base[row] + at : self.base[row] + self.size[row]].tobytes()


_HEX = np.array([f"{k:02x}" for k in range(256)])
_DECIMAL = np.array([str(k) for k in range(256)])


def _joined(parts: np.ndarray, table: np.ndarray, sign: str) -> list[str]:
    return [sign.join(x) for x in table[parts].tolist()]


class _Layers:
    """Fields of many packets, gathered field by field, put in packet order at the end."""

    def __init__(self, n: int):
        self.n, self.layers, self.items = n, [], []

    def add(self, order: int, name: str, rows: np.ndarray, *fields: tuple) -> None:
        """A layer of the packets ``rows``; a field is path, kind, values and the rows among them that have it."""
        self.layers.append((rows, np.full(len(rows), order), [name] * len(rows)))
        for pos, (path, kind, values, *some) in enumerate(fields):
            which = rows if not some else rows[some[0]]
            self.items.append((which, np.full(len(which), order), np.full(len(which), pos), [path] * len(which), [()] * len(which), [kind] * len(which), values if not some else [v for v, s in zip(values, some[0]) if s]))

    def add_rows(self, order: int, name: str, row: int, fields: list[tuple]) -> None:
        """A layer of one packet, with fields ``path, places, kind, value``."""
        at = np.array([row])
        self.layers.append((at, np.array([order]), [name]))
        if fields:
            k = len(fields)
            path, elem, kind, value = zip(*fields)
            self.items.append((np.full(k, row), np.full(k, order), np.arange(k), list(path), list(elem), list(kind), list(value)))

    def array(self, kind: pa.DataType) -> tuple[pa.Array, list[list[str]]]:
        rows, order = (np.concatenate([x[k] for x in self.layers] or [np.zeros(0, np.int64)]) for k in (0, 1))
        names = [n for x in self.layers for n in x[2]]
        place = np.lexsort((order, rows))
        rows, order, names = rows[place], order[place], [names[k] for k in place.tolist()]
        cut = np.searchsorted(rows, np.arange(self.n + 1)).astype(np.int32)
        idx = (np.arange(len(rows)) - cut[rows]).astype(np.int32)
        f_rows, f_order, f_pos = (np.concatenate([x[k] for x in self.items] or [np.zeros(0, np.int64)]) for k in (0, 1, 2))
        inner = np.lexsort((f_pos, f_order, f_rows))
        flat = [[v for x in self.items for v in x[k]] for k in (3, 4, 5, 6)]
        path, elem, kinds, value = ([column[k] for k in inner.tolist()] for column in flat)
        key, f_key = rows * 64 + order, (f_rows * 64 + f_order)[inner]
        f_cut = np.searchsorted(f_key, np.append(key, 1 << 62)).astype(np.int32)
        f_at = (np.arange(len(f_key)) - f_cut[np.searchsorted(key, f_key)]).astype(np.int32) if len(f_key) else np.zeros(0, np.int32)
        layer = kind.value_type
        item = layer.field("fields").type.value_type
        plain = [None if isinstance(v, str) else v for v in value]
        numbers = pa.array(plain, pa.int64()).cast(item.field("num").type)
        texts = pa.array([v if isinstance(v, str) else None for v in value], pa.string())
        columns = [pa.array(f_at), pa.array(path, pa.string()), pa.array(elem, item.field("elem").type), pa.array(kinds, pa.string()), numbers, texts, pa.nulls(len(path), pa.string()), pa.nulls(len(path), item.field("depth").type)]
        fields = pa.ListArray.from_arrays(pa.array(f_cut), pa.StructArray.from_arrays(columns, fields=list(item)), type=layer.field("fields").type)
        norm = {n: normalised(n) for n in set(names)}
        structs = pa.StructArray.from_arrays([pa.array(idx), pa.array(names, pa.string()), pa.array([norm[n] for n in names], pa.string()), pa.array(names, pa.string()), fields], fields=list(layer))
        stacks = [":".join(names[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.ListArray.from_arrays(pa.array(cut), structs, type=kind), stacks


def _addresses(data: _Bytes, rows: np.ndarray, at: np.ndarray, six: bool) -> list[str]:
    parts = data.rows_of(rows, at, 16 if six else 4)
    if not six:
        return _joined(parts, _DECIMAL, ".")
    known = {k: str(IPv6Address(k)) for k in {bytes(x) for x in parts}}
    return [known[bytes(x)] for x in parts]


def _transport_of(data: _Bytes, rows: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and place of what follows IPv6 extension headers; 256 in later fragments."""
    at, kind = at.copy(), kind.copy()
    for _ in range(16):
        extension, fragment, signed = np.isin(kind, EXTENSIONS), kind == FRAGMENT, kind == AUTHENTICATION
        open_ = (extension | fragment | signed) & (at + 8 <= data.size[rows])
        if not open_.any():
            break
        following, length = data.number(rows, at, 1), data.number(rows, at + 1, 1)
        later = fragment & (data.number(rows, at + 2, 2) >> 3 > 0)
        size = np.where(fragment, 8, np.where(signed, 4 * (length + 2), 8 * (length + 1)))
        kind = np.where(open_, np.where(later, 256, following), kind)
        at = np.where(open_, at + size, at)
    return kind, at


def _decoded(raw: pa.Array, link: np.ndarray, named: dict[tuple[str, int], str], layers_type: pa.DataType) -> dict[str, pa.Array | list]:
    data, n = _Bytes(raw), len(raw)
    size, everyone = data.size, np.arange(n)
    error = np.full(n, None, object)
    error[link != 1] = "unknown link type"
    error[(link == 1) & (size < 14)] = "truncated frame"
    good = error == None  # noqa: E711

    kind, net, vlan = data.number(everyone, 12, 2), np.full(n, 14), np.full(n, -1)
    for _ in range(2):
        tagged = good & np.isin(kind, TAGS) & (size >= net + 4)
        vlan = np.where(tagged & (vlan < 0), data.number(everyone, net, 2) & 0xFFF, vlan)
        kind = np.where(tagged, data.number(everyone, net + 2, 2), kind)
        net = net + 4 * tagged
    four, six = good & (kind == IPV4), good & (kind == IPV6)
    short = (four & (size < net + 20)) | (six & (size < net + 40))
    arp = good & (kind == ARP) & (size >= net + 28)

    first = data.number(everyone, net, 1)
    proto = np.where(four, data.number(everyone, net + 9, 1), np.where(six, data.number(everyone, net + 6, 1), 256))
    proto = np.where(four & (data.number(everyone, net + 6, 2) & 0x1FFF > 0), 256, proto)  # a later fragment
    seg = np.where(four, net + 4 * np.maximum(first & 15, 5), net + 40)
    if (ahead := np.flatnonzero(six & ~short)).size:
        proto[ahead], seg[ahead] = _transport_of(data, ahead, seg[ahead], proto[ahead])
    tcp, udp, sctp = (good & ~short & (proto == k) for k in (6, 17, 132))
    least = np.where(tcp, 20, np.where(udp, 8, 12))
    short |= (tcp | udp | sctp) & (size < seg + least)
    error[good & short] = "truncated packet"
    good &= ~short

    out = _Layers(n)
    rows = np.flatnonzero(good)
    mac = lambda r, at: _joined(data.rows_of(r, at, 6), _HEX, ":")
    tags = vlan[rows]
    out.add(0, "Ethernet", rows, ("dst", "macaddr", mac(rows, 0)), ("src", "macaddr", mac(rows, 6)), ("vlan_id", "u16", tags.tolist(), tags >= 0), ("ethertype", "u16", kind[rows].tolist()))
    r = np.flatnonzero(arp & good)
    at = net[r]
    out.add(1, "ARP", r, ("oper", "u16", data.number(r, at + 6, 2).tolist()), ("sha", "macaddr", mac(r, at + 8)), ("spa", "ipv4addr", _addresses(data, r, at + 14, False)), ("tha", "macaddr", mac(r, at + 18)), ("tpa", "ipv4addr", _addresses(data, r, at + 24, False)))
    src, dst = np.full(n, None, object), np.full(n, None, object)
    r = np.flatnonzero(four & good)
    src[r], dst[r] = _addresses(data, r, net[r] + 12, False), _addresses(data, r, net[r] + 16, False)
    out.add(1, "IPv4", r, ("ttl", "u8", data.number(r, net[r] + 8, 1).tolist()), ("protocol", "u8", data.number(r, net[r] + 9, 1).tolist()), ("src", "ipv4addr", src[r].tolist()), ("dst", "ipv4addr", dst[r].tolist()))
    r = np.flatnonzero(six & good)
    src[r], dst[r] = _addresses(data, r, net[r] + 8, True), _addresses(data, r, net[r] + 24, True)
    out.add(1, "IPv6", r, ("next_header", "u8", data.number(r, net[r] + 6, 1).tolist()), ("hop_limit", "u8", data.number(r, net[r] + 7, 1).tolist()), ("src", "ipv6addr", src[r].tolist()), ("dst", "ipv6addr", dst[r].tolist()))
    for name, of in (("ICMP", four & (proto == 1)), ("ICMPv6", six & (proto == 58))):
        r = np.flatnonzero(good & of & (size >= seg + 4))
        out.add(2, name, r, ("type", "u8", data.number(r, seg[r], 1).tolist()), ("code", "u8", data.number(r, seg[r] + 1, 1).tolist()))
    sp, dp = data.number(everyone, seg, 2), data.number(everyone, seg + 2, 2)
    app = np.where(tcp, seg + 4 * np.maximum(data.number(everyone, seg + 12, 1) >> 4, 5), seg + least)
    for name, of in (("TCP", tcp), ("UDP", udp), ("SCTP", sctp)):
        r = np.flatnonzero(good & of)
        more = [(path, kind_, data.number(r, seg[r] + at, k).tolist()) for path, kind_, at, k in (("seq", "u32", 4, 4), ("ack", "u32", 8, 4), ("flags", "u8", 13, 1))] if name == "TCP" else []
        out.add(2, name, r, ("src_port", "u16", sp[r].tolist()), ("dst_port", "u16", dp[r].tolist()), *more)

    carried = good & (tcp | udp | sctp)
    payload: list[bytes | None] = [None] * n
    for k in np.flatnonzero(carried).tolist():
        payload[k] = data.piece(k, int(app[k]))
    for name, of in (("tcp", tcp), ("udp", udp)):
        for port, above in named.items():
            if port[0] != name:
                continue
            hit = good & of & (app < size) & ((dp == port[1]) | ((sp == port[1]) & ~np.isin(dp, [p for t, p in named if t == name])))
            r = np.flatnonzero(hit)
            if normalised(above) not in ("dns", "mdns"):
                out.add(3, above, r)
                continue
            label = {"dns": "DNS", "mdns": "mDNS"}[normalised(above)]
            for k in r.tolist():
                message = payload[k] if name == "udp" else payload[k][2:]
                if fields := dns_fields(message):
                    out.add_rows(3, label, k, fields)
    layers, stacks = out.array(layers_type)
    both = carried & (tcp | udp)
    ports = lambda x: pa.array(x, pa.int32(), mask=~both)
    return {"layers": layers, "stack": stacks, "decode_error": error.tolist(), "src": src.tolist(), "dst": dst.tolist(), "transport": np.where(both, np.where(udp, "udp", "tcp"), None).tolist(), "src_port": ports(sp), "dst_port": ports(dp), "payload": payload}


def decode(packets: DataFrame, overrides: Iterable[tuple[str, int, str]] = ()) -> DataFrame:
    """The packet table of ``capture_id, number, ts_us, length, original_length, link_type, raw``.

    Link type Ethernet, with up to two VLAN tags. Frames too short for a header that they
    announce, or of another link type, get a ``decode_error`` and no layers; later fragments have
    no transport. ``overrides`` names the protocol above given ports. Columns are worked out for
    a batch at once; only DNS messages are parsed one by one. ``payload`` is what follows the
    transport header. Streams are not told apart here: see ``follow.with_stream_ids``; labels of
    codes are ``with_labels``.
    """
    named = PORTS | check_overrides(overrides)
    schema = to_arrow_schema(DECODED)
    wanted = ["capture_id", "number", "ts_us", "length", "original_length", "link_type", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = {name: batch.column(k).slice(i, 2048) for k, name in enumerate(wanted)}
                link = np.array([-1 if x is None else x for x in part["link_type"].to_pylist()])
                made = part | _decoded(part["raw"], link, named, schema.field("layers").type)
                us = part["ts_us"].to_pylist()
                made["ts"] = pa.array([x or None for x in us], pa.int64()).cast(pa.timestamp("us", "UTC")).cast(schema.field("ts").type)
                made["stream_id"] = pa.nulls(len(us), pa.int64())
                columns = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return as_packets(packets.select(*wanted).mapInArrow(run, DECODED))


# ---------------------------------------------------------------- labels

# Names of codes as their standards have them.
_DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR", 41: "OPT", 43: "DS", 46: "RRSIG", 48: "DNSKEY", 64: "SVCB", 65: "HTTPS", 255: "ANY"}
LABELS: dict[tuple[str, str], dict[int, str]] = {
    ("Ethernet", "ethertype"): {IPV4: "IPv4", ARP: "ARP", IPV6: "IPv6"},
    ("ARP", "oper"): {1: "Request", 2: "Reply"},
    ("IPv4", "protocol"): {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 132: "SCTP"},
    ("IPv6", "next_header"): {6: "TCP", 17: "UDP", 58: "ICMPv6", 132: "SCTP"},
    ("ICMP", "type"): {0: "Echo Reply", 3: "Destination Unreachable", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded"},
    ("ICMPv6", "type"): {1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded", 128: "Echo Request", 129: "Echo Reply", 133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation", 136: "Neighbor Advertisement"},
    ("DNS", "qr"): {0: "Query", 1: "Response"},
    ("DNS", "rcode"): {0: "NoError", 1: "FormErr", 2: "ServFail", 3: "NXDomain", 4: "NotImp", 5: "Refused"},
    ("DNS", "questions.type"): _DNS_TYPES,
    ("DNS", "answers.type"): _DNS_TYPES,
    ("mDNS", "questions.type"): _DNS_TYPES,
    ("mDNS", "answers.type"): _DNS_TYPES,
}
TCP_FLAGS = {1: "FIN", 2: "SYN", 4: "RST", 8: "PSH", 16: "ACK", 32: "URG", 64: "ECE", 128: "CWR"}


def _flag_names(flags: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in TCP_FLAGS.items()))), ", ")


def with_labels(packets: DataFrame) -> DataFrame:
    """Gives decoded fields the display labels of their codes; those that have one keep it."""
    names = F.create_map(*(F.lit(x) for (protocol, path), codes in LABELS.items() for code, label in codes.items() for x in (f"{protocol}|{path}|{code}", label)))

    def labelled(protocol: Column, f: Column) -> Column:
        known = F.try_element_at(names, F.concat_ws("|", protocol, f["path"], f["num"].cast("string")))
        flags = F.when((protocol == "TCP") & (f["path"] == "flags"), _flag_names(f["num"].cast("int")))
        return f.withField("name", F.coalesce(f["name"], F.when(f["num"].isNotNull(), F.coalesce(flags, known))))

    return packets.withColumn("layers", F.transform("layers", lambda x: x.withField("fields", F.transform(x["fields"], lambda f: labelled(x["protocol"], f)))))
