"""Packet tables as Parquet: decoded once, read by every later question."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import PACKETS, as_packets

_WRITTEN: dict[tuple, str] = {}
#: Folders of intermediate tables, by application.
_MADE: dict[str, list[str]] = {}


def write_packets(packets: DataFrame, path: str, ordered: bool = False) -> None:
    """Writes packets by capture and number, so that ranges of both prune row groups.

    Addresses, ports and stream ids have Bloom filters, as sorting by number spreads them over all.
    ``ordered``: the rows come in that order already, and are not shuffled.
    """
    rows = as_packets(packets)
    if not ordered:
        rows = rows.repartitionByRange("capture_id", "number").sortWithinPartitions("capture_id", "number")
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("src", "dst", "src_port", "dst_port", "stream_id")}
    rows.write.options(compression="zstd", **blooms, **{"parquet.bloom.filter.adaptive.enabled": "true"}).parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """The table; only the columns (and parts of layers) that are asked for are read."""
    return spark.read.schema(PACKETS).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all machines see: ``spark.checkpoint.dir``; where that is unset (one machine), a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        key = (spark.sparkContext.applicationId,)
        found = _WRITTEN.setdefault(key, _WRITTEN.get(key) or "file://" + tempfile.mkdtemp(prefix="tidewire-"))
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder now and read from there, for a table that is read several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and last change of a table's files."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [f for f in files.listStatus(found)]
    return sum(f.getLen() for f in held), max((f.getModificationTime() for f in held), default=0)


def once(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """The packet table that ``build()`` makes of the table ``name`` in ``source``, written by the first who asks in this application.

    It is made anew where the table's files have changed since.
    """
    key = (spark.sparkContext.applicationId, name, source, _stamp(spark, f"{source}/{name}.parquet"))
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/packets-{name}-{uuid.uuid4().hex}"
        write_packets(build(), path, ordered=True)
        _WRITTEN[key] = path
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return read_packets(spark, _WRITTEN[key])


def clean(spark: SparkSession) -> int:
    """Removes the intermediate tables of this application; results that still read them must be written before. Returns how many."""
    app = spark.sparkContext.applicationId
    paths = _MADE.pop(app, [])
    for key in [k for k, v in _WRITTEN.items() if v in paths]:
        del _WRITTEN[key]
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    return len(paths)
