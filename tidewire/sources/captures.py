"""Capture files: a distributed index of their headers, reading in ranges, and exports that join in order."""

from __future__ import annotations

import glob
import json
import os
import re
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from .store import written

SCHEMA = "capture_id string, number long, ts_us long, length int, original_length int, link_type int, raw binary"
_ARROW = pa.schema([("capture_id", pa.string()), ("number", pa.int64()), ("ts_us", pa.int64()), ("length", pa.int32()), ("original_length", pa.int32()), ("link_type", pa.int32()), ("raw", pa.binary())])

# The magic numbers of capture files with micro- and nanosecond times, and of the
# blocks of the newer format.
MICRO, NANO, SECTION, INTERFACE, ENHANCED, SIMPLE = 0xA1B2C3D4, 0xA1B23C4D, 0x0A0D0D0A, 1, 6, 3
BYTE_ORDER = 0x1A2B3C4D


@dataclass
class State:
    """What a reader knows at some place of a file."""

    blocks: bool
    order: str
    nano: bool = False
    #: Link type, time units a second and kept bytes (0: all) of each interface; a classic file has one.
    links: list = field(default_factory=list)
    #: Section headers met so far.
    sections: int = 0


def _need(f, n: int, what: str) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ValueError(f"{f.name}: the capture ends within {what}")
    return data


def _interface(body: bytes, order: str) -> tuple[int, int, int]:
    link, keep, unit, at = *struct.unpack(order + "H2xI", body[:8]), 1_000_000, 8
    while at + 4 <= len(body):
        code, n = struct.unpack(order + "HH", body[at : at + 4])
        if code == 0:
            break
        if code == 9 and n >= 1:
            exponent = body[at + 4]
            unit = 2 ** (exponent & 127) if exponent & 128 else 10**exponent
        at += 4 + (n + 3) // 4 * 4
    return link, unit, keep


def _opened(f) -> State:
    """Reads what a file begins with, up to its first packet header or block."""
    magic = _need(f, 4, "its header")
    if struct.unpack("<I", magic)[0] == SECTION:
        f.seek(0)
        return State(True, "<")
    order = next((o for o in "<>" if struct.unpack(o + "I", magic)[0] in (MICRO, NANO)), None)
    if order is None:
        raise ValueError(f"{f.name}: not a capture file")
    head = _need(f, 20, "its header")
    return State(False, order, struct.unpack(order + "I", magic)[0] == NANO, [(struct.unpack(order + "I", head[16:])[0] & 0xFFFF, 0, 0)])


def _packets(f, state: State, end: int, bodies: bool) -> Iterator[tuple[int, tuple | None]]:
    """Place of each packet and, with ``bodies``, its time, original length, link type and bytes.

    Without ``bodies`` only headers are read; sections and interfaces change ``state`` as they come.
    """
    while (at := f.tell()) < end:
        if not state.blocks:
            seconds, fraction, kept, size = struct.unpack(state.order + "IIII", _need(f, 16, "a packet header"))
            if bodies:
                yield at, (seconds * 1_000_000 + (fraction // 1000 if state.nano else fraction), size, state.links[0][0], _need(f, kept, "a packet"))
            else:
                yield at, None
                f.seek(at + 16 + kept)
            continue
        head = _need(f, 8, "a block header")
        if struct.unpack("<I", head[:4])[0] == SECTION:
            # its byte order counts for its own length already; interfaces are numbered anew
            state.order = "<" if struct.unpack("<I", _need(f, 4, "a section"))[0] == BYTE_ORDER else ">"
            state.links = []
            state.sections += 1
        kind, size = struct.unpack(state.order + "II", head)
        if size < 12 or size % 4:
            raise ValueError(f"{f.name}: a block of {size} bytes")
        f.seek(at + 8)
        if kind == INTERFACE:
            state.links.append(_interface(_need(f, size - 8, "a block")[:-4], state.order))
        elif kind in (ENHANCED, SIMPLE) and bodies:
            body = _need(f, size - 8, "a block")[:-4]
            if kind == ENHANCED:
                index, high, low, kept, original = struct.unpack(state.order + "IIIII", body[:20])
                (link, unit, _), ticks, data = state.links[index], high << 32 | low, body[20 : 20 + kept]
            else:
                (original,) = struct.unpack(state.order + "I", body[:4])
                (link, unit, most), ticks = state.links[0], 0
                data = body[4 : 4 + min(original, most or original)]
            yield at, (ticks * 1_000_000 // unit, original, link, data)
        elif kind in (ENHANCED, SIMPLE):
            yield at, None
        f.seek(at + size)


# ---------------------------------------------------------------- index

INDEX = "path string, start long, end long, first long, count long, blocks boolean, order string, nano boolean, links array<array<long>>"
#: A range as one task walked it: from ``entry`` to ``exit``, the first place at or past its end;
#: ``reset``: a section began, and ``order_after`` and ``links`` are its own, else ``links`` are added.
_WALKED = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("k", "start", "end", "size")), ("blocks", pa.bool_()), ("nano", pa.bool_()), ("entry", pa.int64()), ("order", pa.string()), ("exit", pa.int64()), ("count", pa.int64()), ("reset", pa.bool_()), ("order_after", pa.string()), ("links", pa.list_(pa.list_(pa.int64())))])
_STITCHED = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("k", "start", "end", "first", "count")), ("blocks", pa.bool_()), ("order", pa.string()), ("nano", pa.bool_()), ("links", pa.list_(pa.list_(pa.int64()))), ("again", pa.bool_()), ("size", pa.int64()), ("range_start", pa.int64()), ("range_end", pa.int64())])
#: Most bytes that a guess takes a packet for, and how many packets in a row make a guess.
_MOST_KEPT, _CHAIN = 1 << 20, 12
# Kinds of blocks that a guess knows.
_KINDS = (1, 2, 3, 4, 5, 6, 10, 0x0BAD, 0x40000BAD, SECTION)


def _walk(f, state: State, entry: int, end: int) -> dict:
    """Passes over the headers from ``entry`` to the first packet or block at or past ``end``."""
    f.seek(entry)
    order, sections = state.order, state.sections
    n = sum(1 for _ in _packets(f, state, end, False))
    return {"entry": entry, "order": order, "exit": f.tell(), "count": n, "reset": state.sections > sections or not state.blocks, "order_after": state.order, "links": [list(x) for x in state.links]}


def _next(data: bytes, at: int, blocks: bool, order: str, units: int) -> int | None:
    """Where the packet or block after the one at ``at`` would be; None if this can't be one, -1 if it is cut off."""
    if at + (12 if blocks else 16) > len(data):
        return -1
    if not blocks:
        _, fraction, kept, size = struct.unpack_from(order + "IIII", data, at)
        return at + 16 + kept if fraction < units and kept <= _MOST_KEPT and kept <= size else None
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind not in _KINDS or size < 12 or size % 4:
        return None
    if at + size > len(data):
        return -1
    return at + size if struct.unpack_from(order + "I", data, at + size - 4)[0] == size else None


def _guess(f, blocks: bool, orders: str, nano: bool, start: int, end: int, size: int, window: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """Places from which a chain of headers goes on, with their byte order; payloads may hold such chains too."""
    units = 1_000_000_000 if nano else 1_000_000
    for low in range(start, end, window):
        f.seek(low)
        data = f.read(2 * window + 16)
        words = np.frombuffer(data + b"\0" * 16, np.uint8)
        within = min(window, end - low, len(data))
        for order in orders:
            word = lambda k: np.ndarray((within,), order + "u4", words, k, (1,))  # noqa: E731, B023
            if blocks:
                likely = np.isin(word(0), _KINDS) & (word(4) >= 12) & (word(4) % 4 == 0) & ((np.arange(within) + low) % 4 == 0)
            else:
                likely = (word(4) < units) & (word(8) <= _MOST_KEPT) & (word(8) <= word(12)) & (word(8) > 0)
            for at in np.flatnonzero(likely).tolist():
                there, n = at, 0
                while there is not None and 0 <= there < len(data) and n < _CHAIN:
                    there, n = _next(data, there, blocks, order, units), n + 1
                # all of a chain, or one up to the end of the file, or more than chance gives
                if there is not None and (n == _CHAIN or (there == len(data) and low + there == size) or n > 4):
                    yield low + at, order
                    break


def _walked(r: dict, entry: int | None = None, order: str | None = None) -> dict:
    """One range of a file, from a place that is known or guessed."""
    with open(r["path"], "rb") as f:
        state = _opened(f)
        out = {k: r[k] for k in ("path", "k", "start", "end", "size")} | {"blocks": state.blocks, "nano": state.nano}
        if entry is None and r["k"] == 0:
            entry, order = f.tell(), state.order
        if entry is not None:
            return out | _walk(f, State(state.blocks, order, state.nano, [] if state.blocks else state.links), entry, r["end"])
        for entry, order in _guess(f, state.blocks, "<>" if state.blocks else state.order, state.nano, r["start"], r["end"], r["size"]):
            try:
                return out | _walk(f, State(state.blocks, order, state.nano, [] if state.blocks else state.links), entry, r["end"])
            except (ValueError, struct.error):  # the guess was wrong
                break
        return out | {"entry": None, "order": state.order, "exit": None, "count": 0, "reset": False, "order_after": state.order, "links": []}


def _stitch(table: pa.Table) -> pa.Table:
    """Numbers the ranges of one file where each begins where the one before ended; others are to be walked again from there.

    Such a range's end is taken for right meanwhile if another range begins there, as chains that
    begin apart soon meet, else the next guess; so one pass finds most that are wrong. What it says
    is only used once no range is left to walk again.
    """
    rows, out = sorted(table.to_pylist(), key=lambda r: r["k"]), []
    entries = {r["entry"] for r in rows} - {None}
    at, first, order, links = rows[0]["entry"], 1, rows[0]["order"], []
    for k, r in enumerate(rows):
        common = {c: r[c] for c in ("path", "k", "blocks", "nano", "size")} | {"range_start": r["start"], "range_end": r["end"], "first": first, "order": order, "links": links if r["blocks"] else r["links"]}
        if at >= r["end"]:  # a packet from before covers it
            out.append(common | {"start": at, "end": at, "count": 0, "again": False})
        elif r["entry"] == at and r["order"] == order:
            out.append(common | {"start": at, "end": r["exit"], "count": r["count"], "again": False})
            at, first = r["exit"], first + r["count"]
            order, links = r["order_after"], r["links"] if r["reset"] else links + r["links"]
        else:
            out.append(common | {"start": at, "end": at, "count": 0, "again": True})
            following = next((x for x in rows[k + 1 :] if x["entry"] is not None), None)
            if r["exit"] in entries:
                at, order = r["exit"], r["order_after"]
            else:
                at, order = (r["size"], order) if following is None else (following["entry"], following["order"])
    if at > rows[0]["size"] and not any(r["again"] for r in out):
        raise ValueError(f"{rows[0]['path']}: the capture ends within a packet")
    return pa.Table.from_pylist(out, _STITCHED)


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if os.path.isfile(f)) or [path]


def root_of(path: str) -> str:
    """The folder that captures are named from: what was asked for, up to its first wildcard or file name."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return path.rstrip("/") + "/"
    fixed = re.split(r"[*?\[{]", path)[0]
    return fixed[: fixed.rfind("/") + 1]


def capture_index(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """One row for each range of about ``range_bytes``: where it begins and its first packet's number.

    Every range is a task's, also those of one file: it finds a place where headers follow each
    other, passes over the headers from there and seeks over the packets. A small pass over each
    file's ranges then joins them: a range counts if it began where the one before ended. Those
    that guessed wrong, as payloads can look like headers, are walked again from the right place,
    until none is left. The driver lists the files and their sizes.
    """
    files = files_of(path)
    listed = spark.createDataFrame(pa.table({"path": files, "size": [os.path.getsize(f) for f in files]}), "path string, size long")
    number = F.expr(f"greatest(1, ceil(size / {range_bytes}))")
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), number.cast("long") - 1)).alias("k"))
    ranges = ranges.select("path", "k", (F.col("k") * range_bytes).alias("start"), F.least(F.col("size"), (F.col("k") + 1) * range_bytes).alias("end"), "size")
    tasks = sum(max(1, -(-os.path.getsize(f) // range_bytes)) for f in files)

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_walked(r)], _WALKED)

    def walk_again(batches):
        for batch in batches:
            for r in batch.to_pylist():
                known = {"path": r["path"], "k": r["k"], "start": r["range_start"], "end": r["range_end"], "size": r["size"]}
                yield pa.RecordBatch.from_pylist([_walked(known, r["start"], r["order"])], _WALKED)

    walked_schema, stitched_schema = from_arrow_schema(_WALKED), from_arrow_schema(_STITCHED)
    walked = written(ranges.repartition(min(tasks, 10_000), "path", "k").mapInArrow(walk, walked_schema), "capture-ranges")
    while True:
        stitched = written(walked.groupBy("path").applyInArrow(_stitch, stitched_schema), "capture-index")
        again = stitched.where("again")
        n = again.count()
        if not n:
            return stitched.select("path", "start", "end", "first", "count", "blocks", "order", "nano", "links")
        right = again.repartition(min(n, 10_000), "path", "k").mapInArrow(walk_again, walked_schema)
        walked = written(walked.join(again.select("path", "k"), ["path", "k"], "left_anti").select(*walked.columns).unionByName(right), "capture-ranges")


def _read_range(r: dict, low: int, high: int | None, most: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    name, number, rows, size = r["path"].removeprefix(r["root"]), r["first"], [], 0
    with open(r["path"], "rb") as f:
        f.seek(r["start"])
        state = State(r["blocks"], r["order"], r["nano"], [tuple(x) for x in r["links"]])
        for _, (us, original, link, data) in _packets(f, state, r["end"], True):
            if high is not None and number > high:
                break
            if number >= low:
                rows.append((name, number, us, len(data), original, link, data))
                size += len(data)
            number += 1
            if len(rows) >= most or size >= most_bytes:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_capture(spark: SparkSession, path: str, rangeBytes: int = 64 << 20, numbers: tuple[int, int | None] = (1, None)) -> DataFrame:
    """Packet metadata and bytes of capture files in a folder that all machines see.

    The index is written to the shared folder; then its ranges are read, a task each. ``numbers``
    (first, last) passes over the ranges outside. ``capture_id`` is a file's path from the folder
    that was asked for, so files of one name in several folders are captures of their own.
    """
    register(spark)
    low, high = numbers
    root = root_of(path)
    index = capture_index(spark, path, int(rangeBytes)).where((F.col("first") + F.col("count") > low) & (F.lit(True) if high is None else F.col("first") <= high) & (F.col("count") > 0))
    n = index.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    spread = index.repartitionByRange(n, "path", "start") if n > 1 else index

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _read_range(r | {"root": root}, low, high)

    return spread.mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- data source


@dataclass
class Whole(InputPartition):
    path: str


class CaptureReader(DataSourceReader):
    """One task a file; ``read_capture`` also cuts files. Ranges of ``number`` end a file early."""

    def __init__(self, options: dict):
        self.root, self.files, self.low, self.high = root_of(options["path"]), files_of(options["path"]), 1, None

    def pushFilters(self, filters):
        """Takes ranges of ``number``; Spark still checks them, so the reader may return more."""
        for f in filters:
            if getattr(f, "attribute", None) == ("number",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[Whole]:
        return [Whole(f) for f in self.files]

    def read(self, part: Whole):
        with open(part.path, "rb") as f:
            state = _opened(f)
            whole = {"path": part.path, "root": self.root, "start": f.tell(), "end": os.path.getsize(part.path), "first": 1, "blocks": state.blocks, "order": state.order, "nano": state.nano, "links": state.links}
        yield from _read_range(whole, self.low, self.high)


# ---------------------------------------------------------------- growing captures


def _whole(f, state: State, at: int, size: int) -> int:
    """How far the packet or block at ``at`` reaches; 0 if it isn't all there yet."""
    f.seek(at)
    head = f.read(16 if not state.blocks else 12)
    if len(head) < (16 if not state.blocks else 12):
        return 0
    if not state.blocks:
        end = at + 16 + struct.unpack(state.order + "I", head[8:12])[0]
    else:
        order = state.order
        if struct.unpack("<I", head[:4])[0] == SECTION:
            order = "<" if struct.unpack("<I", head[8:])[0] == BYTE_ORDER else ">"
        length = struct.unpack(order + "I", head[4:8])[0]
        if length < 12 or length % 4:
            raise ValueError(f"{f.name}: a block of {length} bytes")
        end = at + length
    return end if end <= size else 0


@dataclass
class Arrived(InputPartition):
    range: dict


class GrowingReader(DataSourceStreamReader):
    """Captures that grow while they are read: each micro-batch takes the whole packets that came since.

    An offset has, for each file, the place after its last whole packet, the next packet's number
    and what a reader must know there (byte order, interfaces of the section). A packet of which
    only a part has arrived waits; so does a file without a whole header. The driver passes over
    the headers of what is new, a task reads each range of it. Files may join at any time. A file
    that gets shorter is an error. ``maxBytesPerTrigger`` bounds what one batch takes of a file,
    but for the first one of a (re)started query, which passes over all that is there.
    """

    def __init__(self, options: dict):
        self.path, self.root = options["path"], root_of(options["path"])
        self.most, self.range_bytes = int(options.get("maxBytesPerTrigger", 1 << 62)), int(options.get("rangeBytes", 64 << 20))
        self.seen: dict[str, dict] = {}
        self.cuts: dict[str, list[dict]] = {}
        self.first = True

    def initialOffset(self) -> dict:
        return {}

    @staticmethod
    def _known(at: int, number: int, state: State) -> dict:
        return {"at": at, "number": number, "blocks": state.blocks, "order": state.order, "nano": state.nano, "links": json.dumps(state.links)}

    @staticmethod
    def _state(known: dict) -> State:
        return State(known["blocks"], known["order"], known["nano"], [tuple(x) for x in json.loads(known["links"])])

    def _begin(self, path: str) -> dict | None:
        with open(path, "rb") as f:
            if os.fstat(f.fileno()).st_size < 24:
                return None
            state = _opened(f)
            return self._known(f.tell(), 1, state)

    def _advance(self, path: str, known: dict, most: int) -> dict:
        """The place after the last whole packet; notes places about ``range_bytes`` apart."""
        size, state, at, number = os.path.getsize(path), self._state(known), known["at"], known["number"]
        if size < at:
            raise ValueError(f"{path}: the capture has become shorter")
        cuts = self.cuts.setdefault(path, [])
        begin = at
        with open(path, "rb") as f:
            while at - known["at"] < most and (end := _whole(f, state, at, size)):
                if at - begin >= self.range_bytes:
                    cuts.append(self._known(at, number, state))
                    begin = at
                if state.blocks:
                    f.seek(at)
                    number += sum(1 for _ in _packets(f, state, at + 1, False))
                else:
                    number += 1
                at = end
        return self._known(at, number, state)

    def latestOffset(self) -> dict:
        most, self.first = (1 << 62) if self.first else self.most, False
        for path in files_of(self.path):
            if os.path.isfile(path) and (known := self.seen.get(path) or self._begin(path)):
                self.seen[path] = self._advance(path, known, most)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Arrived]:
        out = []
        for path, last in end.items():
            if self.seen.get(path, {"at": -1})["at"] < last["at"]:
                self.seen[path] = last
            known = start.get(path) or self._begin(path)
            stops = [c for c in self.cuts.get(path, []) if known["at"] < c["at"] < last["at"]] + [last]
            for stop in stops:
                if stop["at"] > known["at"]:
                    state = self._state(known)
                    out.append(Arrived({"path": path, "root": self.root, "start": known["at"], "end": stop["at"], "first": known["number"], "blocks": state.blocks, "order": state.order, "nano": state.nano, "links": [list(x) for x in state.links]}))
                known = stop
        return out

    def read(self, partition: Arrived):
        yield from _read_range(partition.range, 1, None)

    def commit(self, end: dict) -> None:
        for path, last in end.items():
            self.cuts[path] = [c for c in self.cuts.get(path, []) if c["at"] > last["at"]]

    def stop(self) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class CaptureWriter(DataSourceWriter):
    """Each task writes a part for each link type, a capture file of its own.

    Parts are made in a folder of the job's own and only moved, under names that no other export
    has, when the whole job is done; a job that fails leaves nothing. Names sort by job, then by
    task, so the parts of an ordered export follow each other.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.temporary = f"{self.folder}/.job-{self.job}"

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        task, out, paths = TaskContext.get(), {}, []
        os.makedirs(self.temporary, exist_ok=True)
        try:
            for row in rows:
                link = 1 if row["link_type"] is None else row["link_type"]
                if link not in out:
                    paths.append(f"{task.partitionId():06d}-{len(paths)}-link{link}-{task.taskAttemptId()}")
                    out[link] = open(f"{self.temporary}/{paths[-1]}", "wb")
                    out[link].write(struct.pack("<IHHiIII", MICRO, 2, 4, 0, 0, 262144, link))
                data, us = bytes(row["raw"] or b""), row["ts_us"] or 0
                out[link].write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(data), row["original_length"] or len(data)) + data)
        finally:
            for f in out.values():
                f.close()
        return Written(paths)

    def commit(self, messages) -> None:
        os.makedirs(self.folder, exist_ok=True)
        old = glob.glob(f"{self.folder}/part-*.pcap") if self.overwrite else []
        for message in messages:
            for part in message.parts if message else ():
                os.rename(f"{self.temporary}/{part}", f"{self.folder}/part-{self.job}-{part}.pcap")
        for path in old:
            os.unlink(path)
        shutil.rmtree(self.temporary, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)


class CaptureSource(DataSource):
    """``spark.read.format("capture")``, or ``readStream`` while they grow, over capture files in a folder that all machines see."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push ranges of ``number`` into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def write_capture(packets: DataFrame, path: str, overwrite: bool = False) -> None:
    """Exports packets with their bytes, dealt by number so that the parts follow each other.

    Without ``overwrite`` the folder's earlier exports stay.
    """
    register(packets.sparkSession)
    rows = packets.select("capture_id", "number", "ts_us", "length", "original_length", "link_type", "raw")
    rows.repartitionByRange("capture_id", "number").sortWithinPartitions("capture_id", "number").write.format("capture").mode("overwrite" if overwrite else "append").save(path)
