"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffer_of, lowered, materialise, mixed, slices, text_of

Q = 8
#: Places of items that are looked at together.
HITS = 1 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))
_SPACES = np.array([9, 10, 11, 12, 13], np.uint32)


def _code_points(data: np.ndarray) -> np.ndarray:
    """Code points, ASCII letters in lower case and every ASCII white space a space."""
    codes = np.frombuffer(lowered(data).tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    codes[np.isin(codes, _SPACES)] = 32
    return codes


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)
    return mixed(h)


class ShortItems:
    """Whole items that are too short for windows, found as they are, between word borders."""

    def __init__(self):
        self.ids: dict[str, list[int]] = {}
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "automaton": None}  # made again where it is used

    def add(self, item_id: int, codes: np.ndarray) -> None:
        text = " ".join(codes.astype("<u4").tobytes().decode("utf-32-le", "replace").split(" ")).strip()
        text = " ".join(x for x in text.split(" ") if x)
        if any(map(str.isalnum, text)):
            self.ids.setdefault(text, []).append(item_id)

    def find(self, codes: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Row, item, start and end in the row, and edits (none), of each occurrence."""
        if not self.ids:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for text in self.ids:
                self.automaton.add_word(text, text)
            self.automaton.make_automaton()
        found: list[tuple[int, int, int, int, int]] = []
        for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            part = codes[a:b]
            # of several spaces in a row the first counts
            places = np.flatnonzero((part != 32) | np.concatenate([[True], part[:-1] != 32]))
            text = part[places].astype("<u4").tobytes().decode("utf-32-le", "replace")
            for end, item in self.automaton.iter(text):
                start = end - len(item) + 1
                inner = (item[0].isalnum() and start and text[start - 1].isalnum()) or (item[-1].isalnum() and end + 1 < len(text) and text[end + 1].isalnum())
                if not inner:
                    found += [(row, k, int(places[start]), int(places[end]) + 1, 0) for k in self.ids[item]]
        return [tuple(np.array(x) for x in zip(*found))] if found else []


class Probe:
    """Windows of the items, their edit budgets, and an index of their q-grams.

    An item is cut into windows of ``window`` code points, half of one apart (a shorter item is
    one window), so part of an item is found too. A window of m code points matches a region
    within ``e = rate * m`` edits. By the q-gram lemma such a region shares at least
    ``m - q + 1 - q * e`` q-grams with it, on at most ``2 e + 1`` neighbouring diagonals.
    """

    def __init__(self, items: list[tuple[int, str]], window: int, rate: float, least: int, q: int = Q):
        self.q, self.codes, item, budget, at = q, [], [], [], []
        hashes, unit, place = [], [], []
        self.short = ShortItems()
        for item_id, text in items:
            codes = _code_points(np.frombuffer((text or "").encode(), np.uint8))
            if len(codes) < least:
                self.short.add(item_id, codes)
                continue
            starts = list(range(0, max(1, len(codes) - window + 1), window // 2))
            if starts[-1] + window < len(codes):
                starts.append(len(codes) - window)
            for s in starts:
                part = codes[s : s + window]
                h = _grams(part, q)
                hashes.append(h)
                unit.append(np.full(len(h), len(self.codes)))
                place.append(np.arange(len(h)))
                self.codes.append(part)
                item.append(item_id)
                at.append(s)
                budget.append(max(0, min(int(rate * len(part)), (len(part) - q) // q)))
        self.item, self.budget, self.at = np.array(item, np.int64), np.array(budget, np.int64), np.array(at, np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.needed = self.length - q + 1 - q * self.budget
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.unit = np.concatenate(unit)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.bits = min(26, max(16, len(self.keys).bit_length() + 6))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.drift = int(self.budget.max()) if len(self.budget) else 0
        self.shift = max(3, int(2 * self.drift + 1).bit_length())

    def regions(self, codes: np.ndarray, at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document row, window and lowest diagonal (from the row's start) of each band to verify."""
        h = _grams(codes, self.q)
        pos = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[pos])
        ok = key < len(self.keys)
        ok[ok] = self.keys[key[ok]] == h[pos][ok]
        pos, key = pos[ok], key[ok]
        # a hit stands for every place of its q-gram in the items; some of them at a time
        cost = np.cumsum(self.first[key + 1] - self.first[key])
        done, i = [], 0
        while i < len(pos):
            j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + HITS, side="right")))
            done.append(self._bands(pos[i:j], key[i:j], at, gap))
            i = j
            if sum(len(x[0]) for x in done) > HITS:
                done = [_summed(done)]
        where, row, count = _summed(done) if done else (np.zeros(0, np.int64),) * 3
        keep = count >= self.needed[where >> 40]
        where, row = where[keep], row[keep]
        return row, where >> 40, ((where & ((1 << 40) - 1)) << self.shift) - gap - row * gap - at[row]

    def _bands(self, pos: np.ndarray, key: np.ndarray, at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window and band as one number, document row and q-grams of each band hit."""
        n = self.first[key + 1] - self.first[key]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[key], n)
        pos = np.repeat(pos, n)
        unit = self.unit[entry]
        row = np.searchsorted(at, pos, side="right") - 1
        diagonal = pos + row * gap - self.place[entry] + gap
        # bands of 2**shift diagonals and the budget's drift above: a hit is in one or two
        band = diagonal >> self.shift
        low = (diagonal & ((1 << self.shift) - 1)) < 2 * self.drift + 1
        band = np.concatenate([band, band[low] - 1])
        unit, row = np.concatenate([unit, unit[low]]), np.concatenate([row, row[low]])
        where, head, count = np.unique(unit.astype(np.int64) << 40 | band, return_index=True, return_counts=True)
        return where, row[head], count


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    where, row, count = (np.concatenate(x) for x in zip(*parts))
    where, head, place = np.unique(where, return_index=True, return_inverse=True)
    return where, row[head], np.bincount(place, count, len(where)).astype(np.int64)


def _align(patterns: np.ndarray, codes: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern and the diagonal where they are reached first.

    ``cost`` has what it costs to begin on each diagonal from ``low`` on. Row by row over all
    candidates at once; the run along a row is a running minimum. Code points outside
    ``begin .. end`` match nothing.
    """
    n, m = patterns.shape
    ramp, far = np.arange(cost.shape[1]), 1 << 20
    for i in range(m):
        at = low[:, None] + i + ramp
        inside = (at >= begin[:, None]) & (at < end[:, None])
        differs = codes[np.clip(at, 0, len(codes) - 1)] != patterns[:, i, None]
        step = np.where(inside, cost + differs, far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
    best = cost.argmin(1)
    return cost[np.arange(n), best], best


def _verified(probe: Probe, codes: np.ndarray, at: np.ndarray, most: int = 4096) -> list[tuple[np.ndarray, ...]]:
    """Row, item, start and end in the row, and edits, of each window's match."""
    row, unit, low = probe.regions(codes, at, gap=4 * int(probe.length.max()) + (4 << probe.shift))
    out = []
    d, width = probe.drift, (1 << probe.shift) + 2 * probe.drift + 1
    for m in np.unique(probe.length[unit]):
        group = np.flatnonzero(probe.length[unit] == m)
        for k in range(0, len(group), most):
            g = group[k : k + most]
            begin, end, lowest = at[row[g]], at[row[g] + 1], low[g] + at[row[g]]
            patterns = np.stack([probe.codes[u] for u in unit[g]])
            first = lowest[:, None] + np.arange(width)
            cost, best = _align(patterns, codes, lowest, begin, end, np.where((first >= begin[:, None]) & (first <= end[:, None]), 0, 1 << 20))
            hit = np.flatnonzero(cost <= probe.budget[unit[g]])
            if not len(hit):
                continue
            g, begin, end, cost = g[hit], begin[hit], end[hit], cost[hit]
            stop = lowest[hit] + best[hit] + m
            # backwards from the end that was found, for the start
            mirror = len(codes) - stop - d
            ramp = np.arange(-d, d + 1)
            _, best = _align(patterns[hit][:, ::-1], codes[::-1], mirror, len(codes) - end, len(codes) - begin, np.tile(np.where(ramp >= 0, ramp, 1 << 20), (len(g), 1)))
            out.append((row[g], probe.item[unit[g]], len(codes) - (mirror + best + m) - begin, stop - begin, cost))
    return out


def _merged(found: list[tuple[np.ndarray, ...]], rows: int) -> list[list[dict]]:
    """Per row, overlapping matches of one item as one span; edits are the most of its windows."""
    spans: list[list[dict]] = [[] for _ in range(rows)]
    for row, item, start, end, edits in sorted(zip(*(np.concatenate(x).tolist() for x in zip(*found)))) if found else ():
        last = spans[row][-1] if spans[row] else None
        if last and last["item_id"] == item and start <= last["end"]:
            last["end"], last["edits"] = max(last["end"], end), max(last["edits"], edits)
        else:
            spans[row].append({"item_id": item, "start": start, "end": end, "edits": edits})
    return spans


def _scan(handle, text_at: int, carry: list[int], schema: pa.Schema, old_at: int | None, step: int = 1 << 21):
    def run(batches):
        probe = handle.value
        for batch in batches:
            data, offsets = buffer_of(batch.column(text_at))
            for i, j in slices(offsets, step):
                part = data[offsets[i] : offsets[j]]
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                at = chars[offsets[i : j + 1] - offsets[i]]
                codes = _code_points(part)
                spans = _merged((_verified(probe, codes, at) if len(probe.codes) else []) + probe.short.find(codes, at), j - i)
                if old_at is not None:
                    spans = [(a or []) + b for a, b in zip(batch.column(old_at).slice(i, j - i).to_pylist(), spans)]
                columns = [batch.column(k).slice(i, j - i) for k in carry]
                yield pa.RecordBatch.from_arrays([*(c.cast(t.type) for c, t in zip(columns, schema)), pa.array(spans, schema.field("spans").type)], schema=schema)

    return run


def locate(docs: DataFrame, benchmark: DataFrame, *, carry: list[str] | None = None, window: int = 96, rate: float = 0.1, least: int = 40, block_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with ``spans``: the regions of each whole text that repeat part of an item.

    ``carry`` names the columns to return (all). A region matches if it aligns with a window of
    an item within ``rate`` edits a code point, white space and ASCII case aside. The items are a
    stated query set: they are taken in blocks of at most about ``block_chars`` code points, whose
    q-gram index (some 40 bytes a code point) is sent to the executors; each block passes over
    the documents in turn.

    An item of under ``least`` code points matches as a whole and without edits, between word
    borders, runs of white space being one space; one without a letter or digit matches nothing.
    Part of a longer item is sure to be found if it holds a whole window, so from
    ``3 * window / 2`` code points on, and never if it is much shorter than one.

    Null or empty text and null items: no spans. Equal items each give a span, overlapping matches
    of one item in a text are one span. A very long text is worked on as a whole, with memory that
    grows with its length, and with the number of its regions that look like an item's. A column ``spans`` of ``docs`` is
    replaced; further columns are carried as they are. An empty table on either side is no error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    carry = [c for c in (carry or docs.columns) if c != "spans"]
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    current = docs.select(*carry, *([] if "text" in carry else ["text"]))
    for block in range(blocks):
        items = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", text_of().alias("text")).collect()
        handle = spark.sparkContext.broadcast(Probe([(r.item_id, r.text) for r in items], window, rate, least))
        last = block == blocks - 1
        names = [*carry, *([] if last or "text" in carry else ["text"])]
        schema = T.StructType([current.schema[c] for c in names] + [T.StructField("spans", SPAN)])
        columns = current.columns
        job = _scan(handle, columns.index("text"), [columns.index(c) for c in names], to_arrow_schema(schema), columns.index("spans") if "spans" in columns else None)
        current = current.mapInArrow(job, schema)
        if not last:
            current = materialise(current, "decontaminated")
    return current


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any span, with their own columns; as ``locate`` for odd rows.

    Null and empty texts stay, and so does each of several equal rows.
    """
    return locate(docs, benchmark, **options).where(F.size("spans") == 0).select(*docs.columns)
