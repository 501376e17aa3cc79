"""Packet records as JSON lines: reading them into the packet table, and writing it back."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import bytes_hex, iso_time
from ..model import DECODED, as_packets, normalised
from .captures import root_of

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _flatten(layer: dict, kinds: dict[tuple[str, str], str]) -> list[dict]:
    """A layer's fields in their order; ``X_name`` right after ``X`` is X's label.

    Each value keeps its places in lists and how many of them belong to each step of its path, so
    lists of lists and lists within objects keep their shape. An empty list or object is a field
    of that kind without a value; JSON nulls are left out.
    """
    out: list[dict] = []
    protocol = normalised(layer["protocol"])

    def item(path: list[str], depth: list[int], elem: list[int], kind: str, num: int | None, text: str | None) -> None:
        out.append({"pos": len(out), "path": ".".join(path), "elem": elem, "kind": kind, "num": num, "str": text, "name": None, "depth": depth})

    def value(path: list[str], depth: list[int], elem: list[int], x: object) -> None:
        if isinstance(x, dict):
            if not x and path:
                item(path, depth, elem, "object", None, None)
            for k, v in x.items():
                inner([*path, k], [*depth, 0], elem, v)
        elif isinstance(x, list):
            if not x:
                item(path, depth, elem, "array", None, None)
            for i, v in enumerate(x):
                value(path, [*depth[:-1], depth[-1] + 1], [*elem, i], v)
        elif isinstance(x, bool):
            item(path, depth, elem, "bool", None, "true" if x else "false")
        elif isinstance(x, int) and -(2**31) <= x < 2**64:
            item(path, depth, elem, kinds.get((protocol, ".".join(path))) or ("u64" if x >= 0 else "i32"), x, None)
        elif isinstance(x, int | float):
            item(path, depth, elem, "number", None, json.dumps(x))
        elif x is not None:
            item(path, depth, elem, kinds.get((protocol, ".".join(path))) or "str", None, x)

    def inner(path: list[str], depth: list[int], elem: list[int], x: object) -> None:
        last = out[-1] if out else None
        if last and isinstance(x, str) and last["kind"] not in ("object", "array") and ".".join(path) == last["path"] + "_name" and elem == last["elem"] and depth == last["depth"]:
            last["name"] = x
        else:
            value(path, depth, elem, x)

    value([], [], [], layer.get("fields") or {})
    return out


def _columns(lines: list[str], captures: pa.Array, kinds: dict[tuple[str, str], str], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of records as packets. Values go to flat columns; only layers with objects or lists are walked."""
    plain: dict[str, list] = {k: [] for k in ("number", "ts", "ts_us", "length", "original_length", "link_type", "stack", "decode_error", "raw")}
    layers: dict[str, list] = {k: [] for k in ("idx", "protocol", "proto_norm", "protocol_label")}
    fields: dict[str, list] = {k: [] for k in ("pos", "path", "kind", "num", "str", "name")}
    lists: dict[str, tuple[list, list]] = {k: ([0], []) for k in ("elem", "depth")}
    layer_ends, field_ends, names = [0], [0], {}
    pos, path, kind, num, text, label = fields.values()
    (elem_ends, elem), (depth_ends, depth) = lists.values()
    for line in lines:
        record = json.loads(line)
        labels = (record.get("stack") or "").split(":")
        for i, layer in enumerate(record.get("layers") or []):
            name = layer["protocol"]
            norm = names.get(name) or names.setdefault(name, normalised(name))
            for column, x in zip(layers.values(), (i, name, norm, labels[i] if i < len(labels) else name)):
                column.append(x)
            found = layer.get("fields") or {}
            if any(type(v) not in (str, int) for v in found.values()):
                for f in _flatten(layer, kinds):
                    for k, column in fields.items():
                        column.append(f[k])
                    elem.extend(f["elem"])
                    depth.extend(f["depth"])
                    elem_ends.append(len(elem))
                    depth_ends.append(len(depth))
            else:
                n = 0
                for k, v in found.items():
                    whole = type(v) is int
                    if n and not whole and k == path[-1] + "_name":
                        label[-1] = v
                        continue
                    small = whole and -(2**31) <= v < 2**64
                    pos.append(n)
                    path.append(k)
                    kind.append("number" if whole and not small else kinds.get((norm, k)) or ("str" if not whole else "u64" if v >= 0 else "i32"))
                    num.append(v if small else None)
                    text.append(json.dumps(v) if whole and not small else None if whole else v)
                    label.append(None)
                    depth.append(0)
                    elem_ends.append(len(elem))
                    depth_ends.append(len(depth))
                    n += 1
            field_ends.append(len(pos))
        layer_ends.append(len(field_ends) - 1)
        ts = record.get("timestamp")
        us = None if not ts else (datetime.fromisoformat(ts.replace("Z", "+00:00")) - EPOCH) // timedelta(microseconds=1)
        raw = record.get("raw_bytes")
        for column, x in zip(plain.values(), (record["number"], us or None, us, record.get("length"), record.get("original_length"), record.get("link_type"), record.get("stack"), record.get("error"), bytes.fromhex(raw) if raw else None)):
            column.append(x)

    def listed(ends: list[int], values: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)

    def struct(kind: pa.DataType, made: dict[str, list | pa.Array]) -> pa.Array:
        parts = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    layer_type = schema.field("layers").type.value_type
    field_type = layer_type.field("fields").type.value_type
    places = {k: listed(ends, pa.array(values, pa.int32()), field_type.field(k).type) for k, (ends, values) in lists.items()}
    held = listed(field_ends, struct(field_type, fields | places), layer_type.field("fields").type)
    made = {"capture_id": captures, "layers": listed(layer_ends, struct(layer_type, layers | {"fields": held}), schema.field("layers").type)}
    column = lambda f: made[f.name] if f.name in made else pa.array(plain["ts"], pa.int64()).cast(f.type) if f.name == "ts" else pa.array(plain.get(f.name, [None] * len(lines)), f.type)
    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def read_records(spark: SparkSession, path: str, catalog: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Reads JSON-lines records as packets; each file is a capture.

    JSON has no address or width types: ``catalog`` (protocol, path, kind) gives them back. Key
    order is kept at any depth. Broken lines fail the read.
    """
    kinds = {(normalised(p), path): kind for p, path, kind in catalog or []}
    schema = to_arrow_schema(DECODED)

    def run(batches):
        for batch in batches:
            yield _columns(batch.column(0).to_pylist(), batch.column(1), kinds, schema)

    # a file's path from the folder that was asked for names the capture
    file, root = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), root_of(path)
    name = F.substr(file, F.instr(file, root) + len(root)) if root else F.element_at(F.split(file, "/"), -1)
    lines = spark.read.text(path).select("value", name.alias("capture_id")).where(F.trim("value") != "")
    return as_packets(lines.mapInArrow(run, DECODED))


def _put(top: dict, steps: list[str], depth: list[int], elem: list[int], value: object) -> dict:
    """Puts a value to its place and returns the object around it. Places that are left out stay null."""
    here, places = top, iter(elem)
    for k, (step, levels) in enumerate(zip(steps, depth)):
        last = k == len(steps) - 1
        if not levels:
            if last:
                here[step] = value
                return here
            here = here.setdefault(step, {})
            continue
        held = here.setdefault(step, [])
        for level in range(levels):
            at, inmost = next(places), level == levels - 1
            held.extend([None] * (at + 1 - len(held)))
            if last and inmost:
                held[at] = value
                return here
            if held[at] is None:
                held[at] = {} if inmost else []
            held = held[at]
        here = held
    return here


def _nested(fields: list[dict]) -> dict:
    """Objects and lists rebuilt from paths and places, labels after their fields."""
    top: dict = {}
    for f in fields or []:
        steps, elem = f["path"].split("."), list(f["elem"] or [])
        depth = f["depth"]
        if depth is None:
            depth = [1] * min(len(elem), len(steps)) + [0] * (len(steps) - len(elem))
            depth[-1] += max(0, len(elem) - len(steps))
        empty = {"object": {}, "array": []}.get(f["kind"])
        if f["num"] is not None:
            value: object = int(f["num"])
        elif f["kind"] in ("bool", "number") and f["str"] is not None:
            value = json.loads(f["str"])
        else:
            value = empty if empty is not None else f["str"]
        if value is not None:
            around = _put(top, steps, depth, elem, value)
        else:  # a label by itself
            around = top
            for step in steps[:-1]:
                around = around.setdefault(step, {})
        if f["name"] is not None:
            around[steps[-1] + "_name"] = f["name"]
    return top


#: Kinds whose values are not text or a number of their own.
_SHAPED = ("bool", "number", "object", "array")
_dumps = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _texts(batch: pa.RecordBatch) -> list[str]:
    """A batch of packets as JSON texts. Layers of plain fields are joined from flat columns; others are nested first."""
    layers = batch.column("layers")
    labels, held = (dict(zip((f.name for f in layers.type.value_type), layers.flatten().flatten()))[k] for k in ("protocol_label", "fields"))
    fields = held.flatten()
    flat = dict(zip((f.name for f in fields.type), fields.flatten()))
    path, kind, text, name, elem, depth = (flat[k].to_pylist() for k in ("path", "kind", "str", "name", "elem", "depth"))
    num = flat["num"].cast(pa.string()).to_pylist()
    ends = list(accumulate(pc.fill_null(pc.list_value_length(held), 0).to_pylist(), initial=0))
    keys: dict[str, str] = {}  # JSON of the few texts that protocols and paths are

    def key(x: str) -> str:
        return keys.get(x) or keys.setdefault(x, _dumps(x))

    def layer(k: int) -> str:
        made: dict[str, str] = {}
        for i in range(ends[k], ends[k + 1]):
            p = path[i]
            if elem[i] or "." in p or kind[i] in _SHAPED or (depth[i] and depth[i] != [0]):
                whole = [{"path": path[j], "elem": elem[j], "kind": kind[j], "num": num[j], "str": text[j], "name": name[j], "depth": depth[j]} for j in range(ends[k], ends[k + 1])]
                return _dumps(_nested(whole))
            if num[i] is not None:
                made[p] = num[i]
            elif text[i] is not None:
                made[p] = _dumps(text[i])
            if name[i] is not None:
                made[p + "_name"] = key(name[i])
        return "{" + ",".join([f"{key(p)}:{v}" for p, v in made.items()]) + "}"

    done = [f'{{"protocol":{_dumps(label)},"fields":{layer(k)}}}' for k, label in enumerate(labels.to_pylist())]
    columns = [batch.column(c).to_pylist() for c in ("number", "timestamp", "length", "original_length", "stack", "raw_bytes")]
    out, at = [], 0
    for n, number, time, length, original, stack, raw in zip(pc.fill_null(pc.list_value_length(layers), 0).to_pylist(), *columns):
        end = "" if raw is None else f',"raw_bytes":"{raw}"'
        out.append(f'{{"number":{_dumps(number)},"timestamp":{_dumps(time)},"length":{_dumps(length)},"original_length":{_dumps(original)},"stack":{_dumps(stack)},"layers":[{",".join(done[at : at + n])}]{end}}}')
        at += n
    return out


def to_records(packets: DataFrame, raw_bytes: bool = False) -> DataFrame:
    """One JSON text ``value`` per packet, keys in a fixed order, fields in protocol order."""
    rows = packets.where(F.col("decode_error").isNull()).select("number", iso_time(F.coalesce("ts_us", F.lit(0))).alias("timestamp"), "length", "original_length", "stack", "layers", (raw_hex() if raw_bytes else F.lit(None).cast("string")).alias("raw_bytes"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_texts(batch), pa.string())], ["value"])

    return rows.mapInArrow(run, "value string")


def write_records(packets: DataFrame, path: str, raw_bytes: bool = False, **options: str) -> None:
    """Writes records in packet order, a range of packets a file."""
    ordered = packets.repartitionByRange("capture_id", "number").sortWithinPartitions("capture_id", "number")
    to_records(ordered, raw_bytes).write.options(**options).text(path)


def raw_hex() -> Column:
    return bytes_hex(F.col("raw"))
