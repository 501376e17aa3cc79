"""Shared helpers: shared-folder tables, folds, and vectorised text buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of code points other than these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a temporary folder is used.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(sc, "_tidewire_shared", None)
        if folder is None:
            folder = sc._tidewire_shared = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    return folder


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the table read back.

    Cuts lineage: the table survives the loss of any executor.
    """
    return stored(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", **options)


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def discard(table: DataFrame) -> None:
    """Removes the files of a table made by ``materialise``, once nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id is in fold 0's hash of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


# ---------------------------------------------------------------- text buffers


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int, most_rows: int = 1 << 14):
    """Row ranges of about ``most`` bytes each (a longer row is a range of its own) and ``most_rows`` at most."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n, i + most_rows)
        yield i, j
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (one more than rows)."""
    return runs_of(~_SPACE[data], offsets)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are ``inside``, and the number of runs before each row; no run crosses rows."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(inside)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = cuts[cuts > 0] - 1
    last[ends_at] = inside[ends_at]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


#: Spans up to this many bytes are hashed side by side, 8 bytes a step; longer ones by XXH64.
SHORT = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


class Spans:
    """Hashes and compares any spans of a byte buffer by 8-byte words."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(data) + 1,), "<u8", self.data, 0, (1,))

    def _word(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next 8 bytes, those past the end as zeros."""
        return self.words[starts] & _KEEP[np.minimum(left, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes; every step mixes all bits, so no shape of text collides by rule."""
        length = ends - starts
        out = mixed(self._word(starts, length) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero((length > 8) & (length <= SHORT))
        step = 8
        while len(at):
            out[at] = mixed(out[at] * np.uint64(0x2545F4914F6CDD1D) ^ self._word(starts[at] + step, length[at] - step))
            step += 8
            at = at[length[at] > step]
        for k in np.flatnonzero(length > SHORT).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[starts[k] : ends[k]], 77)
        return out

    __call__ = hashes

    def equal(self, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes of the other one."""
        length = ends - starts
        same = length == other_ends - others
        at, step = np.flatnonzero(same), 0
        while len(at):
            small = at[length[at] <= SHORT]
            same[small] &= self._word(starts[small] + step, length[small] - step) == self._word(others[small] + step, length[small] - step)
            if not step:
                for k in at[length[at] > SHORT].tolist():
                    same[k] = np.array_equal(self.data[starts[k] : ends[k]], self.data[others[k] : other_ends[k]])
            step += 8
            at = small[length[small] > step]
        return same


def keys_of(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Feature numbers below ``2**bits`` from 64-bit hashes."""
    return (mixed(hashes + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range; zero for an empty row."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
