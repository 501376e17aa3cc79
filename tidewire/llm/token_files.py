"""Token-id files: Parquet lists with dictionary and delta encodings, small row groups and page indexes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffer_of, materialise, shared_folder, slices
from .tokens import held, word_vocabulary

#: Shards whose token counts are summed together.
BLOCK = 1000
#: Rows of 16 bytes that are sent to all executors at most; beyond that a join shuffles.
MOST_SENT = 1_000_000
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, token_ids array<int>"


def _batches(path: str, end_id: int, step: int = 1 << 21):
    def run(batches):
        from pyspark import TaskContext

        shard, done, tokenizer = TaskContext.get().partitionId(), 0, held(path)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for i, j in slices(offsets, step):
                ids, at = tokenizer.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.full(j - i, shard, np.int32)),
                        pa.array(done + at[:-1]),
                        pa.array(np.diff(at).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    ["doc_id", "shard", "shard_start", "n_tokens", "token_ids"],
                )
                done += len(ids)
            del batch, data  # some 30 MB, else held while the next are read

    return run


def write_token_files(docs: DataFrame, path: str | None = None, *, vocabulary: str | None = None, end_id: int = 2, shard_bytes: int = 24 << 20, row_group_bytes: int = 16 << 20, page_rows: int = 512) -> str:
    """Writes one token list per document, in ascending ``doc_id`` order, and returns the folder.

    Documents are dealt to range shards of about ``shard_bytes`` of text by id, then by a hash of
    the text, so many rows of one id need not share a shard, and sorted; each shard is one file
    with the columns ``doc_id, shard, shard_start, n_tokens, token_ids``. Ids keep a dictionary (a
    few hot tokens make most of a text); the ascending numbers are delta encoded. Row groups have
    a byte bound, pages a row bound, and the writer adds column and offset indexes, so a reader
    can take the metadata alone (``read_lengths``) or the pages of a few documents
    (``read_tokens``).

    Null or empty text: a list with the end id only. Null ``doc_id`` sorts first. Repeated ids
    are kept, next to each other, in the order of their texts' hashes. A very long text is one
    list. Further columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(_batches(vocabulary or word_vocabulary(), end_id), SCHEMA).write.options(
        **{
            "compression": "zstd",
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.row.count.limit": str(page_rows),
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#shard_start": "false",
            "parquet.enable.dictionary#n_tokens": "false",
        }
    ).parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, shard, shard_start, n_tokens``: the columns of ids are not read."""
    return read_token_files(spark, path).drop("token_ids")


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The lists of documents ``first`` to ``last``: files and pages whose ids lie apart are passed over."""
    return read_token_files(spark, path).where(F.col("doc_id").between(first, last))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(3)
        ids, at = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B"), 4 * lists.offsets.to_numpy().astype(np.int64)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.array(crc, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: its place among all ids and a checksum of its ids, read from the files.

    A shard's first place is the sum of the shards before it: of whole blocks of ``BLOCK`` shards,
    then of those of its own block. The lengths are read by themselves for that.
    """
    files = read_token_files(spark, path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / BLOCK))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("of_block"))
    before = blocks.select("block", (F.sum("of_block").over(Window.orderBy("block")) - F.col("of_block")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    first = totals.withColumn("inside", inside).join(before, "block").select("shard", (F.col("before") + F.col("inside")).alias("first"))
    first = materialise(first, "shard-starts")
    first = F.broadcast(first) if first.count() <= MOST_SENT else first
    return files.join(first, "shard").select("doc_id", (F.col("first") + F.col("shard_start")).alias("start"), F.col("n_tokens").cast("long"), "token_ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
