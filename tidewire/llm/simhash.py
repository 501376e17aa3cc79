"""SimHash fingerprints, linked through a covering code's anchors."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, lowered, materialise, slices, text_of, words_of
from .graph import components

# ---------------------------------------------------------------- fingerprints


def simhash64(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the unsigned 64-bit hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _fingerprints(size: int, step: int = 1 << 21):
    digest = xxhash.xxh64_intdigest

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(-1))
            out = []
            for i, j in slices(offsets, step):
                base = offsets[i]
                part = lowered(data[base : offsets[j]])
                starts, ends, bounds = words_of(part, offsets[i : j + 1] - base)
                # the words again, one space apart, so that every shingle is one slice
                lengths = ends - starts
                at = np.concatenate([[0], np.cumsum(lengths + 1)])
                joined = np.full(at[-1], 0x20, np.uint8)
                inner = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
                keep = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
                ramp = np.arange(lengths.sum())
                joined[ramp + inner] = part[ramp + keep]
                text = joined.tobytes()
                first, last = at[:-1].tolist(), (at[1:] - 1).tolist()
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = b - a
                    if n >= size:
                        h = [digest(text[s:e], 42) for s, e in zip(first[a : b - size + 1], last[a + size - 1 : b])]
                    else:
                        h = [digest(text[first[a] : last[b - 1]], 42)] if n else []
                    out.append(simhash64(np.array(h, np.uint64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(out, np.uint64).view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; a column ``row_key`` goes along."""
    keys = [F.col(c).cast("long") for c in ("doc_id", "row_key") if c in docs.columns]
    return docs.select(*keys, text_of().alias("text")).mapInArrow(_fingerprints(shingle), "".join(f"{c} long, " for c in ("doc_id", "row_key") if c in docs.columns) + "fp long")


# ---------------------------------------------------------------- anchors

# Fixed value: the generator polynomial of the perfect binary Golay code of length 23, whose
# 4096 words cover all 23-bit strings within 3 bits, each string exactly once.
GOLAY = 0b110001110101
RADIUS, CODE_BITS, FREE_BITS = 3, 23, 9


def _syndromes(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64, copy=True)
    for bit in range(CODE_BITS - 1, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


def _patterns(weight: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(CODE_BITS), weight)], np.int64)


class Anchors:
    """Anchors of 32-bit halves: a Golay word on 23 bits times the other 9 bits as they are.

    Every half has one home anchor within the covering radius 3. Two halves that differ in at
    most ``threshold`` (1) bits meet at the home of either, if each goes to every anchor within
    the covering radius plus the threshold: 1 + 9 + about 4.3 anchors.
    """

    def __init__(self):
        self.leader = np.zeros(2048, np.int64)
        for w in range(RADIUS + 1):
            p = _patterns(w)
            self.leader[_syndromes(p)] = p
        far = _patterns(RADIUS + 1)
        s = _syndromes(far)
        order = np.argsort(s, kind="stable")
        self.far, self.at = far[order], np.searchsorted(s[order], np.arange(2049))

    def of(self, half: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor and whether it is home, for each anchor of each row."""
        code, free = half >> FREE_BITS, half & ((1 << FREE_BITS) - 1)
        s = _syndromes(code)
        rows = np.arange(len(half))
        number = lambda word, rest: (side << 21) | (word >> 11 << FREE_BITS) | rest
        home = code ^ self.leader[s]
        n = self.at[s + 1] - self.at[s]
        row = np.repeat(rows, n)
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[s], n)
        out = [(rows, number(home, free), True), (row, number(code[row] ^ self.far[pick], free[row]), False)]
        out += [(rows, number(home, free ^ (1 << b)), False) for b in range(FREE_BITS)]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), x[2]) for x in out])


def _replicate(only_home: bool):
    def run(batches):
        anchors = Anchors()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(0, len(fps), 1 << 14):
                fp = fps[i : i + (1 << 14)]
                for side in (0, 1):
                    half = (fp >> (32 * side)) & 0xFFFFFFFF
                    row, anchor, home = anchors.of(half, side)
                    if only_home:
                        row, anchor, home = row[home], anchor[home], home[home]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    return run


# ---------------------------------------------------------------- comparing


def _settle(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label reachable over the edges a-b."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, most_bits: int, budget: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by key, within each key: at most one link a row.

    Only homes are compared with the rest of their group, ``budget`` pairs at a time.
    """
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cut, len(keys)))
    h = np.flatnonzero(home)
    group = np.searchsorted(cut, h, side="right") - 1
    h, group = h[size[group] > 1], group[size[group] > 1]
    label = np.arange(len(keys))
    cost = np.cumsum(size[group])
    i = 0
    while i < len(h):
        j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + budget, side="right")))
        g = group[i:j]
        n = size[g]
        a = np.repeat(h[i:j], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[g], n)
        apart = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64))
        near = (apart <= most_bits) & (a != b)
        if near.any():
            label = _settle(len(keys), a[near], b[near], label)
        i = j
    child = np.flatnonzero(label != np.arange(len(keys)))
    return fps[child], fps[label[child]]


def _compare(most_bits: int, most_rows: int = 1 << 18):
    """Over rows sorted by key and home first; a group may span batches.

    A group longer than ``most_rows`` is streamed: its homes (bounded by the split of hot
    anchors) stay, and further rows are compared with them as they come.
    """

    def run(batches):
        rest: list[np.ndarray] | None = None

        def emit(keys, fps, home):
            u, v = _links(keys, fps, home, most_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            keys = (cols[0] << 20) | cols[1]
            if not len(keys):
                continue
            start = int(np.searchsorted(keys, keys[-1]))
            if start:
                yield emit(keys[:start], cols[2][:start], cols[3][:start])
            rest = [c[start:] for c in cols]
            if len(rest[0]) > most_rows and not rest[3][-1]:
                yield emit(keys[start:], rest[2], rest[3])
                rest = [c[rest[3]] for c in rest]
        if rest is not None:
            keys = (rest[0] << 20) | rest[1]
            yield emit(keys, rest[2], rest[3])

    return run


def near_links(fps: DataFrame, most_bits: int = 3, most_homes: int = 4096) -> DataFrame:
    """Spanning links ``u, v`` between distinct fingerprints at ``most_bits`` (3) or fewer bits.

    At 3 differing bits one 32-bit half differs in at most 1, so the halves' anchors find every
    pair. A hot anchor (over ``most_homes`` homes) is split into blocks of homes; its other rows
    go to every block, so no task compares against an unbounded set and no pair is lost.
    """
    if most_bits > 3:
        raise ValueError("two halves with a threshold of one bit each find at most 3 bits")
    kind = "anchor long, fp long, home boolean"
    rows = fps.mapInArrow(_replicate(False), kind)
    hot = fps.mapInArrow(_replicate(True), kind).groupBy("anchor").count().where(F.col("count") > most_homes)
    hot = materialise(hot.select("anchor", F.ceil(F.col("count") / most_homes).cast("int").alias("blocks")), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("anchor", "fp", F.explode(every).alias("block"), (F.col("home") & (own == F.col("block"))).alias("home"))
        rows = rows.select("anchor", "block", "fp", "home")
    else:
        rows = rows.select("anchor", F.lit(0).alias("block"), "fp", "home")
    dealt = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"), "fp")
    return dealt.select(F.col("anchor"), F.col("block").cast("long"), "fp", "home").mapInArrow(_compare(most_bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Equal fingerprints are one node from the start, so copies are never compared or paired.
    Null or empty text: fingerprint zero, linked like any other. Repeated ``doc_id`` rows keep
    a row each; a null ``doc_id`` is never the smallest of a component, which is null only if all
    its ids are. A tie of votes leaves a bit 0. A very long text is counted 65,536 shingles at a
    time. Further columns are ignored; an empty table gives no rows.
    """
    marks, roots = _classes(docs, shingle, most_bits)
    placed = marks.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    multi = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(multi, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, shingle: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``fp, root`` of those that are linked to another."""
    marks = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(marks.select("fp").distinct(), "distinct-fingerprints")
    roots = materialise(components(near_links(nodes, most_bits)).withColumnRenamed("node", "fp"), "components")
    return marks, roots


def keep_one(docs: DataFrame, *, shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, chosen as in ``near_copies.keep_one``."""
    from .near_copies import first_rows, row_key

    marks, roots = _classes(docs.select("doc_id", "text", row_key().alias("row_key")), shingle, most_bits)
    placed = marks.join(roots, "fp", "left").select("doc_id", "row_key", F.coalesce("root", "fp").alias("root"))
    return first_rows(docs, placed)
