"""Near copies by word shingles: wide SimHash fingerprints propose pairs, the shingle sets decide.

The method is that of ``simhash``, with a covering code's anchors, for pairs that are much further
apart: at a Jaccard similarity of 0.8 some 15 % of the bits differ. No table of anchors can cover
that, so there are many tables, each on bits of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, buffer_of, discard, lowered, materialise, mixed, slices, text_of, words_of
from .graph import components
from .simhash import CODE_BITS, Anchors, _syndromes

LANES = ["f0", "f1", "f2", "f3"]
BITS = 64 * len(LANES)

# ---------------------------------------------------------------- shingle sets and fingerprints


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def shingle_sets(column: pa.Array, size: int, step: int = 1 << 21):
    """For each text the ascending distinct hashes of its shingles; a shorter text is one shingle."""
    data, offsets = buffer_of(column)
    for i, j in slices(offsets, step):
        base = offsets[i]
        part = lowered(data[base : offsets[j]])
        starts, ends, bounds = words_of(part, offsets[i : j + 1] - base)
        words = Spans(part)(starts, ends)
        joined = words[: max(0, len(words) - size + 1)]
        for k in range(1, size):
            joined = _join(joined, words[k : k + len(joined)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(joined[a : b - size + 1])
            elif b > a:
                one = words[a : a + 1]
                for k in range(a + 1, b):
                    one = _join(one, words[k : k + 1])
                yield one
            else:
                yield words[:0]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 majority votes of a set of hashes; a tie goes to the least hash. Zeros for none."""
    lanes = lambda h: np.stack([h, *(mixed(h ^ np.uint64(k * 0xD1B54A32D192ED03 % 2**64)) for k in range(1, len(LANES)))], axis=1).astype("<u8").view(np.uint8)
    if not len(hashes):
        return np.zeros(len(LANES), np.int64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(lanes(hashes[i : i + (1 << 14)]), axis=1, bitorder="little").sum(0, dtype=np.int64)
    tie = np.unpackbits(lanes(hashes[:1]), axis=1, bitorder="little")[0]
    return np.packbits(4 * ones + 2 * tie > 2 * len(hashes) + 1, bitorder="little").view("<i8")


#: Bits of a set's occupancy map.
MAP_BITS = 2048


def occupancy(hashes: np.ndarray) -> bytes:
    """Which remainders of ``MAP_BITS`` a set has. Two maps differ in no more bits than their sets in elements."""
    held = np.zeros(MAP_BITS, np.uint8)
    held[(hashes >> np.uint64(20)) % np.uint64(MAP_BITS)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, maps: np.ndarray, size: np.ndarray, least: float, step: int = 1 << 15) -> np.ndarray:
    """False only where sets ``a`` and ``b`` can't reach a Jaccard similarity of ``least``.

    Sets that do differ in (1 - least) / (1 + least) of their sizes' sum of elements at most.
    """
    out = np.empty(len(a), bool)
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        apart = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
        out[i : i + step] = np.maximum(apart, np.abs(size[x] - size[y])) * (1 + least) <= (1 - least) * (size[x] + size[y]) + 1e-6
    return out


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            nodes, fps, sizes, maps = [], [], [], []
            for hashes in shingle_sets(batch.column(2), size):
                nodes.append(int(mixed(hashes).sum(dtype=np.uint64)))
                fps.append(wide_fingerprint(hashes))
                sizes.append(len(hashes))
                maps.append(occupancy(hashes))
            fps = np.array(fps, np.int64).reshape(-1, len(LANES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), *(pa.array(fps[:, k].copy()) for k in range(len(LANES))), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "row_key", "node", *LANES, "size", "map"])

    return run


def row_key() -> Column:
    """A hash of id and text: rows that share it are one row repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, row_key, node, f0..f3, size, map``: hashes of the row and of its shingle set, the fingerprint, and the set's size and occupancy."""
    kind = "doc_id long, row_key long, node long, " + ", ".join(f"{f} long" for f in LANES) + ", size long, map binary"
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), text_of().alias("text")).mapInArrow(_sketches(shingle), kind)


# ---------------------------------------------------------------- candidates

# Each table looks at 28 of the 256 bits: 23 go to their Golay word, 5 stay as they are.
TABLES, FREE = 64, 5
ANCHORS = TABLES << 17
_PLACES = np.stack([np.random.default_rng(k).permutation(BITS)[: CODE_BITS + FREE] for k in range(TABLES)])
#: What of the fingerprint goes along to the anchors, and how many of its bits may differ there.
CARRIED, CARRIED_BITS = 2, 36
#: The tables of the first round, which joins most of every large group by few pairs a node.
FIRST_TABLES = 8
#: Leaders of a hot anchor.
LEADERS = 64


def anchors_of(fps: np.ndarray, leader: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Anchor of each row in each of the first tables."""
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<i8").view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    out = np.empty((len(fps), tables), np.int32)
    for t, places in enumerate(_PLACES[:tables]):
        word = (bits[:, places[:CODE_BITS]] @ (2.0 ** np.arange(CODE_BITS, dtype=np.float32))).astype(np.int64)
        free = (bits[:, places[CODE_BITS:]] @ (2.0 ** np.arange(FREE, dtype=np.float32))).astype(np.int64)
        out[:, t] = (t << 17) | ((word ^ leader[_syndromes(word)]) >> 11 << FREE) | free
    return out


def _anchor_rows(only, tables: int, step: int = 1 << 12):
    """A row for each node and table; ``only``: at the anchors whose bit is set."""

    def run(batches):
        leader = Anchors().leader
        wanted = None if only is None else np.unpackbits(only.value, bitorder="little").astype(bool)
        for batch in batches:
            names = batch.schema.names
            cols = [c.to_numpy() for c in batch.columns[: 2 + len(LANES)]]
            for i in range(0, len(cols[0]), step):
                part = [c[i : i + step] for c in cols]
                anchor = anchors_of(np.stack(part[2:], axis=1), leader, tables).ravel()
                row = np.repeat(np.arange(len(part[0])), tables)
                if wanted is not None:
                    keep = wanted[anchor]
                    anchor, row = anchor[keep], row[keep]
                more = [batch.column(k).take(pa.array(i + row)) for k in range(2 + len(LANES), len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *(pa.array(c[row]) for c in part[: 2 + CARRIED]), *more], ["anchor", "node", "comp", *LANES[:CARRIED], *names[2 + len(LANES) :]])

    return run


def _anchor_rows_of(nodes: DataFrame, only=None, tables: int = TABLES, more: str = "") -> DataFrame:
    """``more``: further columns that go along."""
    extra = [c.split()[0] for c in more.split(", ")] if more else []
    kind = "anchor int, node long, comp long, " + ", ".join(f"{f} long" for f in LANES[:CARRIED])
    return nodes.select("node", "comp", *LANES, *extra).mapInArrow(_anchor_rows(only, tables), f"{kind}, {more}" if more else kind)


def _compare(rows: dict, most: int, least: float, budget: int = 1 << 20):
    """Pairs of a home and any row of its key; each home's first ``most`` near rows of other components.

    Adds to ``seen`` how many of these each home has met so far. An anchor is marked where pairs
    of unlike components are left.
    """
    keys, home, old, seen, fps, comp = (rows[k] for k in ("key", "home", "old", "seen", "fps", "comp"))
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cut, len(keys)))
    h = np.flatnonzero(home)
    group = np.searchsorted(cut, h, side="right") - 1
    h, group = h[size[group] > 1], group[size[group] > 1]
    cost = np.cumsum(size[group])
    us, vs, more, i = [], [], [], 0
    while i < len(h):
        j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + budget, side="right")))
        n = size[group[i:j]]
        a = np.repeat(h[i:j], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[group[i:j]], n)
        # of two homes the later looks at the earlier
        use = (a != b) & ~(home[b] & (old[a] | (b > a)))
        a, b = a[use], b[use]
        apart = np.zeros(len(a), np.uint8)
        for f in fps:
            apart += np.bitwise_count((f[a] ^ f[b]).view(np.uint64))
        near = (apart <= CARRIED_BITS) & (comp[a] != comp[b])
        a, b = a[near], b[near]
        if "map" in rows:
            near = may_be_similar(a, b, rows["map"], rows["size"], least)
            a, b = a[near], b[near]
        if len(a):
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            runs = np.diff(np.append(first, len(a)))
            place = seen[a] + np.arange(len(a)) - np.repeat(first, runs)
            seen[a[first]] += runs
            use = place < most
            us.append(rows["node"][a[use]])
            vs.append(rows["node"][b[use]])
            more.append(np.unique(rows["anchor"][a[~use]]))
        i = j
    left = np.unique(np.concatenate(more)) if more else np.zeros(0, np.int64)
    u, v = np.concatenate([*us, left]), np.concatenate([*vs, left])
    flag = np.arange(len(u)) >= len(u) - len(left)
    return pa.RecordBatch.from_arrays([pa.array(np.where(flag, u, np.minimum(u, v))), pa.array(np.where(flag, v, np.maximum(u, v))), pa.array(flag)], ["u", "v", "more"])


def _candidates(most: int, least: float, most_rows: int = 1 << 18):
    """Over rows sorted by anchor, block and home first; a long group's homes stay while it streams."""

    def run(batches):
        rest: dict | None = None
        pick = lambda rows, at: {k: [f[at] for f in x] if k == "fps" else x[at] for k, x in rows.items()}
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: 5 + CARRIED]]
            n = len(cols[0])
            if not n:
                continue
            anchor = cols[0].astype(np.int64)
            rows = {"anchor": anchor, "key": (anchor << 32) | cols[1], "home": cols[2], "node": cols[3], "comp": cols[4], "old": np.zeros(n, bool), "seen": np.zeros(n, np.int64), "fps": cols[5:]}
            if "map" in batch.schema.names:
                rows["size"] = batch.column("size").to_numpy()
                rows["map"] = np.frombuffer(b"".join(batch.column("map").to_pylist()), "<u8").reshape(n, -1)
            if rest is not None:
                rows = {k: [np.concatenate([p, q]) for p, q in zip(rest[k], x)] if k == "fps" else np.concatenate([rest[k], x]) for k, x in rows.items()}
            start = int(np.searchsorted(rows["key"], rows["key"][-1]))
            if start:
                yield _compare(pick(rows, slice(0, start)), most, least)
            rest = pick(rows, slice(start, None))
            if len(rest["key"]) > most_rows and not rest["home"][-1]:
                yield _compare(rest, most, least)
                rest = pick(rest, rest["home"])
                rest["old"] = np.ones(len(rest["key"]), bool)
        if rest is not None:
            yield _compare(rest, most, least)

    return run


def _pairs(rows: DataFrame, most: int, least: float) -> DataFrame:
    """``u, v, more`` of rows ``anchor, block, home, node, comp``, the carried fingerprint and, where they are there, ``size, map``."""
    dealt = rows.select("anchor", "block", "home", "node", "comp", *LANES[:CARRIED], *(c for c in ("size", "map") if c in rows.columns)).repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"), "node")
    return dealt.mapInArrow(_candidates(most, least), "u long, v long, more boolean").distinct()


def _first_pairs(nodes: DataFrame, tables: int, most_homes: int, least: float) -> DataFrame:
    """Each node with the first near one of each of its anchors, where that is of another component.

    The loads of anchors are taken from an eighth of the nodes, to deal rows out: a hot anchor's
    nodes go to blocks by hash, with some leaders that are in all blocks. What blocks keep apart
    is for the next round, so a hot anchor is always marked. Loads never decide what is found.
    """
    part = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(8)) == 0)
    load = _anchor_rows_of(part, None, tables).groupBy("anchor").agg((8 * F.count("*")).alias("load")).where(F.col("load") > most_homes)
    hot = materialise(load, "hot-anchors")
    rows = _anchor_rows_of(nodes, None, tables)
    if hot.isEmpty():
        return _pairs(rows.withColumns({"block": F.lit(0), "home": F.lit(True)}), 1, least)
    rows = rows.join(hot, "anchor", "left")
    blocks = F.coalesce(F.ceil(F.col("load") / most_homes).cast("int"), F.lit(1))
    leads = F.pmod(F.xxhash64("node", F.lit(5)), F.col("load")) < LEADERS
    own = F.pmod(F.xxhash64("node", F.lit(4)), blocks).cast("int")
    rows = rows.withColumn("home", F.lit(True)).withColumn("block", F.explode(F.when(leads, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))))
    marks = hot.select(F.col("anchor").cast("long").alias("u"), F.col("anchor").cast("long").alias("v"), F.lit(True).alias("more"))
    return _pairs(rows, 1, least).unionByName(marks).distinct()


def _further_pairs(nodes: DataFrame, only, most_homes: int, least: float) -> DataFrame:
    """All near pairs of unlike components at the marked anchors whose sizes and occupancy maps allow that they are similar.

    Those two tests lose no similar pair, and leave few others where sets are not much larger than
    their maps; so a large group that is near by fingerprints, but not similar, gives few pairs.

    At each anchor the rows of its most common component are no homes: their pairs with others
    are found from the others. The homes are split into blocks of ``most_homes``, and every
    block meets all rows.
    """
    rows = _anchor_rows_of(nodes, only, more="size long, map binary")
    each = _anchor_rows_of(nodes, only).groupBy("anchor", "comp").agg(F.count("*").alias("n"))
    common = each.groupBy("anchor").agg(F.max_by("comp", F.struct("n", "comp")).alias("common"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    rows = rows.join(common, "anchor")
    blocks = F.ceil(F.col("others") / most_homes).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(4)), blocks).cast("int")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("home", (F.col("comp") != F.col("common")) & (F.col("block") == own))
    return _pairs(rows, 1 << 62, least)


# ---------------------------------------------------------------- deciding


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """Which of the numbers ``n`` below ``2**bits`` are there, as packed bits: one size, whatever is in it."""
    at = F.col("n").cast("long") + 1
    rows = numbers.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = part[: len(out) - at]
    return out


def _wanted(sent):
    def run(batches):
        held = np.unpackbits(sent.value, bitorder="little").astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(held[batch.column(0).to_numpy() & (len(held) - 1)]))

    return run


def _verify(size: int, least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float, most_bits: int) -> DataFrame:
    """The pairs whose shingle sets are similar.

    The whole fingerprints are compared first. Then the texts of the nodes that are left are
    fetched: rows that are no node's are told off by a bitmap of fixed size while they are read,
    so only candidates' texts are shuffled.
    """
    spark = docs.sparkSession
    left, right = ([nodes[c].alias(f"{side}_{c}") for c in ("node", *LANES)] for side in "uv")
    apart = sum(F.bit_count(F.col(f"u_{f}").bitwiseXOR(F.col(f"v_{f}"))) for f in LANES)
    close = pairs.join(nodes.select(*left), F.col("u") == F.col("u_node")).join(nodes.select(*right), F.col("v") == F.col("v_node")).where(apart <= most_bits).select("u", "v")
    close = materialise(close, "candidates")
    if close.isEmpty():
        return close
    held = close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node"))).distinct()
    wanted = materialise(nodes.select("node", "row_key").join(held, "node", "left_semi"), "wanted")
    sent = spark.sparkContext.broadcast(bitmap(wanted.select(F.col("row_key").bitwiseAND(F.lit((1 << 26) - 1)).alias("n")), 26))
    found = docs.select(row_key().alias("row_key"), text_of().alias("text")).mapInArrow(_wanted(sent), "row_key long, text string")
    texts = materialise(found.join(wanted, "row_key").groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
    full = close.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    links = materialise(full.select("u", "v", "a", "b").mapInArrow(_verify(shingle, least), "u long, v long"), "links")
    for table in (close, wanted, texts):
        discard(table)
    sent.destroy()
    return links


def _joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` with further links: these join whole components, so only roots are looked at."""
    if roots is None:
        return materialise(components(links), "components")
    if links.isEmpty():
        return roots
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    upper = materialise(components(ends).select(F.col("node").alias("root"), F.col("root").alias("top")), "components")
    moved = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return materialise(moved.unionByName(alone), "components")


def classes(docs: DataFrame, *, shingle: int = 5, least: float = 0.8, most_bits: int = 60, most_homes: int = 4096) -> DataFrame:
    """``doc_id, row_key, root``: a row for each row of ``docs``, with its component."""
    spark = docs.sparkSession
    marks = materialise(sketches(docs, shingle), "sketches")
    nodes = materialise(marks.groupBy("node").agg(F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("row_key"), *(F.min(c).alias(c) for c in (*LANES, "size", "map"))), "distinct-sketches")
    roots = only = None
    for tables in (FIRST_TABLES, TABLES, None):
        placed = nodes.withColumn("comp", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        pairs = _first_pairs(placed, tables, most_homes, least) if tables else _further_pairs(placed, only, most_homes, least)
        pairs = materialise(pairs, "pairs")
        links = _similar(pairs.where(~F.col("more")).select("u", "v"), nodes, docs, shingle, least, most_bits)
        roots = _joined_roots(roots, links)
        if tables == TABLES:  # before that, all anchors are looked at again anyway
            marked = bitmap(pairs.where("more").select(F.col("u").alias("n")), ANCHORS.bit_length() - 1)
            if not marked.any():
                break
            only = spark.sparkContext.broadcast(marked)
        discard(pairs)
    if only is not None:
        only.destroy()
    return marks.join(roots, "node", "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, component_id``: components of pairs with a Jaccard similarity of ``least`` (0.8) or more.

    Texts with the same shingle set are one node from the start. Nodes that share an anchor in one
    of 64 tables and differ in at most ``most_bits`` of 256 bits are candidates; their shingle sets
    decide. First each node is tested with one near node an anchor, in a few of the tables and
    then, where that is of another component, in all; then, at the anchors where that left some
    apart, with all others that are not in its component yet and may be similar by their sizes and
    occupancy. So a large group of near copies is joined without all its pairs, and every candidate is tested or
    joined. Candidates are probable, not certain: at a similarity of 0.8 a pair shares no anchor
    with a chance of 3 %, at 0.87 of 0.01 %.

    Null or empty text: the empty set, one node. Repeated ``doc_id`` rows keep a row each; a null
    ``doc_id`` is never the smallest of a component, which is null only if all its ids are. A long
    text is one set of hashes in memory, 8 bytes a word. Further columns are ignored; an empty
    table gives no rows.
    """
    placed = classes(docs, **options)
    least_id = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least_id, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns.

    It is the row with the smallest id; rows without one stay only where no row of the component
    has one. Of texts that share the id the one with the least hash stays, of rows that share id
    and text any one.
    """
    return first_rows(docs, classes(docs.select("doc_id", "text"), **options))


def first_rows(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The first row of each ``root``; ``placed``: ``doc_id, row_key, root``."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = placed.groupBy("root").agg(F.min_by("row_key", order).alias("_row_key")).select("_row_key")
    plain = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(row_key().alias("_row_key"), *plain).join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
