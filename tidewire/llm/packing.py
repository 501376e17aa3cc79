"""Best-two-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, materialise, slices
from .tokens import held, word_vocabulary

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item.

    A bin is filled with the longest item that fits, again and again. What then stays open is
    closed, where possible, by taking the bin's smallest item out and putting two unpacked items
    in that fit the widened gap more tightly. ``present`` holds the unpacked lengths as bits.
    """
    piles: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        piles.setdefault(int(lengths[i]), []).append(i)
    present = 0
    for n in piles:
        present |= 1 << n
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def longest(most: int) -> int:
        return (present & ((1 << (most + 1)) - 1)).bit_length() - 1 if most >= 0 else -1

    def take(n: int) -> int:
        nonlocal present
        pile = piles[n]
        item = pile.pop()
        if not pile:
            present ^= 1 << n
        return item

    def give_back(item: int, n: int) -> None:
        nonlocal present
        piles[n].append(item)
        present |= 1 << n

    number = 0
    while present:
        inside: list[int] = []
        gap = capacity
        while gap and (n := longest(gap)) >= 0:
            inside.append(take(n))
            gap -= n
        if gap and present:
            out = inside[-1]
            smallest = int(lengths[out])
            room, best, pair = gap + smallest, smallest, None
            a = longest(room)
            while a >= 0 and 2 * a > best:
                b = longest(min(a, room - a))
                if b == a and len(piles[a]) < 2:
                    b = longest(a - 1)
                if b >= 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                inside.pop()
                inside += [take(pair[0]), take(pair[1])]
                give_back(out, smallest)
        at = 0
        for item in inside:
            bins[item], places[item] = number, at
            at += int(lengths[item])
        number += 1
    return bins, places


def _pieces(path: str, end_id: int, capacity: int, step: int = 1 << 21):
    def run(batches):
        tokenizer = held(path)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for i, j in slices(offsets, step):
                ids, at = tokenizer.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                size = np.diff(at)
                n = -(-size // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (at[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table.column("copies").to_numpy())))
        bins, places = best_two_fit(table.column("length").to_numpy(), capacity)
        shard = table.column("shard")[0].as_py() if len(table) else 0
        return table.drop_columns(["shard", "copies"]).append_column("sequence_id", pa.array(bins + (shard << 40))).append_column("offset", pa.array(places))

    return run


def pack(docs: DataFrame, *, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, rows_per_shard: int = 8192) -> DataFrame:
    """Packs every document's ids, cut only where longer than ``capacity``.

    Pieces (lengths and checksums, no ids) are written once. Whole ones fill a sequence each and
    never meet another piece. Of the others a document has one at most; they are dealt evenly by a
    hash to shards of about ``rows_per_shard`` pieces, whatever the lengths of the documents, so
    every shard sees the same mix of lengths and wastes at most about one sequence. Equal pieces of
    one id travel as one with a count, and go to many shards where there are many of them, so no
    key can be hot. Shards are packed independently.

    Null or empty text: a piece of the end id alone. Null and repeated ``doc_id`` are kept as
    rows of their own. A very long text is as many pieces as it fills. Of pieces of one length
    any may be taken first. Sequences of whole pieces have negative numbers. Further columns are
    ignored. An empty table gives no rows.
    """
    job = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary or word_vocabulary(), end_id, capacity), PIECE)
    pieces = materialise(job, "pieces")
    names = pieces.columns
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    open_ones = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-open_ones.count() // rows_per_shard))
    most = max(1, rows_per_shard // 8)
    counted = open_ones.groupBy(*names).agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / most).cast("int")))
    dealt = counted.select(*names, "n", part.alias("part")).withColumn("copies", F.least(F.lit(most), F.col("n") - F.col("part") * most))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "part"), F.lit(shards)).cast("long")
    packed = dealt.select(*names, "copies", shard.alias("shard")).groupBy("shard").applyInArrow(_packed(capacity), PIECE + ", sequence_id long, offset long")
    return packed.unionByName(whole)
