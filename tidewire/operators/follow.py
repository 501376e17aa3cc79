"""Streams: their key, packets, direction and payload text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import printable
from ..model import FACTS, bind, decoded, first_field, first_layer, holds, with_facts
from .project import with_flow
from .select import ordinal


def stream_key() -> Column:
    """TCP by ``stream_id``; else UDP, else SCTP, by both ends in order; else null.

    A missing port counts as 0 and a missing address as empty.
    """

    def of(name: str, sp: Column, dp: Column) -> Column:
        a, b = end("src", sp), end("dst", dp)
        text = lambda low, high: F.concat(F.lit(name + ":"), low["a"], F.lit(":"), low["p"].cast("string"), F.lit("-"), high["a"], F.lit(":"), high["p"].cast("string"))
        return F.when(a <= b, text(a, b)).otherwise(text(b, a))

    def of_layer(name: str) -> Column:
        port = lambda x, p: first_field(x, p)["num"].cast("int")
        return bind(first_layer(name), lambda x: F.when(x.isNotNull(), of(name.lower(), port(x, "src_port"), port(x, "dst_port"))))

    by_layers = F.coalesce(of_layer("UDP"), of_layer("SCTP"))
    plain = F.when(F.col("transport") == "udp", of("udp", F.col("src_port"), F.col("dst_port"))).when(holds("UDP", "SCTP"), by_layers)
    return F.coalesce(F.concat(F.lit("tcp:"), F.col("stream_id").cast("string")), plain)


def end(address: str, port: Column) -> Column:
    return F.struct(F.coalesce(F.col(address), F.lit("")).alias("a"), F.coalesce(port, F.lit(0)).alias("p"))


def with_stream(packets: DataFrame) -> DataFrame:
    """Adds ``stream_key`` and ``from_client``: whether the source is that of the stream's first packet.

    The first source is a partial aggregate joined back, so a giant stream is not sorted in one task.
    """
    keyed = decoded(with_flow(packets)).withColumn("stream_key", stream_key()).where("stream_key is not null")
    first = keyed.groupBy("capture_id", "stream_key").agg(F.min_by("src", "number").alias("_client"))
    return keyed.join(first, ["capture_id", "stream_key"]).withColumn("from_client", F.col("src").eqNullSafe(F.col("_client"))).select(*packets.columns, "stream_key", "from_client")


def follow(packets: DataFrame, key: str, capture_id: str | None = None) -> DataFrame:
    """The packets of one stream, in one capture or in each."""
    rows = packets if capture_id is None else packets.where(F.col("capture_id") == capture_id)
    return with_stream(rows).where(F.col("stream_key") == key)


def payload_lines(streams: DataFrame, payload: str = "payload") -> DataFrame:
    """Lines of printable payload text in packet order; a last empty line and line-end returns go."""
    lines = F.split(printable(F.col(payload)), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    rows = streams.where(F.octet_length(payload) > 0).select("capture_id", "stream_key", "number", "from_client", F.posexplode(lines).alias("line_number", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"\r$", ""))


def first_stream_ids(packets: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """``capture_id, low, high, stream_id``: TCP flows numbered from 0 by their first packet.

    A flow is both ends in order. One row per flow is ranked, within buckets of the first number.
    """
    low, high = _ends()
    rows = decoded(packets).where(holds("TCP") & (F.col("transport") == "tcp")).select("capture_id", "number", low.alias("low"), high.alias("high"))
    flows = rows.groupBy("capture_id", "low", "high").agg(F.min("number").alias("number"))
    return ordinal(flows, "stream_id", bucket).select("capture_id", "low", "high", (F.col("stream_id") - 1).alias("stream_id"))


def _ends() -> tuple[Column, Column]:
    a, b = end("src", F.col("src_port")), end("dst", F.col("dst_port"))
    return F.least(a, b), F.greatest(a, b)


def with_stream_ids(packets: DataFrame) -> DataFrame:
    """Packets whose TCP layers have a ``stream_id``: given where there is none, as decoding does not know it.

    The id is a plain column and the last field of each packet's TCP layer.
    """
    low, high = _ends()
    ids = first_stream_ids(packets).select("capture_id", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("stream_id").alias("_id"))
    keyed = packets.withColumn("_low", F.when(F.col("transport") == "tcp", low)).withColumn("_high", F.when(F.col("transport") == "tcp", high))
    rows = keyed.join(ids, ["capture_id", "_low", "_high"], "left")
    number = F.when(holds("TCP"), F.coalesce("stream_id", "_id"))

    def numbered(x: Column) -> Column:
        item = F.struct(F.size(x["fields"]).alias("pos"), F.lit("stream_id").alias("path"), F.array().cast("array<int>").alias("elem"), F.lit("u32").alias("kind"), F.col("_id").cast("decimal(20,0)").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<int>").alias("depth"))
        return x.withField("fields", F.array_append(x["fields"], item))

    add = F.col("_id").isNotNull() & F.col("stream_id").isNull()
    layers = F.when(add, F.transform("layers", lambda x: F.when(x["protocol"] == "TCP", numbered(x)).otherwise(x))).otherwise(F.col("layers"))
    numbered_rows = rows.withColumn("layers", layers).withColumn("stream_id", number)
    return (with_facts(numbered_rows) if set(FACTS) & set(packets.columns) else numbered_rows).select(*packets.columns)
