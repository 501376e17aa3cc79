"""Sampling, paging and ranking, in packet order and without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def ordinal(df: DataFrame, name: str = "ordinal", bucket: int = BUCKET) -> DataFrame:
    """Adds each row's 1-based place among the rows of its capture, by ``number``.

    Rows are ranked within fixed buckets of ``number``; each bucket's first place is the running
    sum of the counts of those before it, a table of one row per ``bucket`` packets.
    """
    keyed = df.withColumn("_bucket", F.floor(F.col("number") / bucket))
    counts = keyed.groupBy("capture_id", "_bucket").agg(F.count("number").alias("_n"))
    before = counts.select("capture_id", "_bucket", (F.sum("_n").over(Window.partitionBy("capture_id").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("capture_id", "_bucket").orderBy("number"))
    return keyed.withColumn("_rank", inside).join(before, ["capture_id", "_bucket"]).withColumn(name, F.col("_before") + F.col("_rank")).select(*df.columns, name)


def fetch(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``capture_id, number`` is among ``keys``.

    The keys become bits, 4 KB for each 32 768 numbers of a capture that has any. That is small
    enough to be sent to the rows for captures of very many packets (Spark checks the size), so
    whole rows are read where they lie, and only keys were sorted.
    """
    bits = keys.groupBy("capture_id", F.bitmap_bucket_number("number").alias("_word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("_bits"))
    held = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(number) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(number) % 8 as int)) & 1 = 1")
    return df.withColumn("_word", F.bitmap_bucket_number("number")).join(bits, ["capture_id", "_word"]).where(held).select(*df.columns)


def _keys(df: DataFrame) -> DataFrame:
    return df.select("capture_id", "number")


def sample_every(df: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    """The 1st, (n+1)th, (2n+1)th ... row of each capture's rows. Numbers are a capture's own."""
    if n < 1:
        raise ValueError("the sampling step is at least 1")
    if n == 1:
        return df
    return fetch(df, _sampled(_keys(df), n, bucket))


def _sampled(keys: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    return ordinal(keys, "_ordinal", bucket).where((F.col("_ordinal") - 1) % n == 0).drop("_ordinal")


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("capture_id", "number")


def overall_ordinal(df: DataFrame, name: str = "ordinal", bucket: int = BUCKET) -> DataFrame:
    """Adds each row's 1-based place among all rows, by ``capture_id``, then ``number``; a row a capture is summed up."""
    sizes = df.groupBy("capture_id").agg(F.count("*").alias("_n"))
    before = sizes.select("capture_id", (F.sum("_n").over(Window.orderBy("capture_id")) - F.col("_n")).alias("_before"))
    return ordinal(df, "_inside", bucket).join(before, "capture_id").withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


#: Rows that a sorted limit may hold in each task; pages beyond it are cut by ordinal.
HELD = 100_000


def page(df: DataFrame, *, sample: int = 1, offset: int = 0, count: int | None = 1000) -> DataFrame:
    """Sample, then skip, then limit, in packet order; ``count=None`` is no limit.

    A page near the start is a limit on the sorted keys; one that begins far down, or has no end,
    is a range of their ordinals, so that no task holds all keys before it. Whole rows are only
    fetched for the page.
    """
    if offset < 0 or (count is not None and count < 0):
        raise ValueError("offset and count are not negative")
    if sample < 1:
        raise ValueError("the sampling step is at least 1")
    if sample == 1 and not offset and count is None:
        return in_order(df)
    keys = _keys(df) if sample == 1 else _sampled(_keys(df), sample)
    if count is not None and offset + count <= HELD:
        keys = in_order(keys)
        keys = (keys.offset(offset) if offset else keys).limit(count)
    elif offset or count is not None:
        keys = overall_ordinal(keys, "_place").where((F.col("_place") > offset) & (F.lit(True) if count is None else F.col("_place") <= offset + count)).drop("_place")
    return in_order(fetch(df, keys))


def truncated(df: DataFrame, *, sample: int = 1, offset: int = 0, count: int = 1000) -> DataFrame:
    """One row ``truncated``: whether a page's limit leaves rows out (not if it is met exactly)."""
    return page(_keys(df), sample=sample, offset=offset + count, count=1).agg((F.count("*") > 0).alias("truncated"))


def page_with_more(df: DataFrame, *, sample: int = 1, offset: int = 0, count: int = 1000) -> tuple[DataFrame, bool]:
    """A page, and ``truncated`` as a value, for which a job runs now."""
    return page(df, sample=sample, offset=offset, count=count), truncated(df, sample=sample, offset=offset, count=count).first()[0]


def top_n(df: DataFrame, n: int | None = 10, within: Sequence[str] = (), by: Sequence[Column] = ()) -> DataFrame:
    """The first ``n`` rows of each group; by default by falling ``count``, then ``name``."""
    order = list(by) or [F.desc("count"), F.asc("name")]
    if n is None:
        return df
    if not within:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
