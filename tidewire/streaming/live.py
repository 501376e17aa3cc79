"""Live captures with Structured Streaming: the same filters and statistics over arriving packets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import PACKETS, decoded
from ..operators.correlate import dns_messages
from ..operators.stats import name_counts, tcp_ports
from ..sources.captures import register
from ..sources.decode import decode, with_labels


def tail(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Packets from Parquet files as they land in ``folder``."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tail_captures(spark: SparkSession, path: str, overrides: Iterable[tuple[str, int, str]] = (), **options: object) -> DataFrame:
    """Decoded packets of capture files while they grow; see ``captures.GrowingReader`` for the options.

    Whoever captures writes to a file (``tee`` does for a pipe); packets come as they are whole.
    """
    register(spark)
    stream = spark.readStream.format("capture").options(**{k: str(v) for k, v in options.items()}).load(path)
    return with_labels(decode(stream, overrides))


def live_filter(packets: DataFrame, condition: Column) -> DataFrame:
    """Append: each arriving packet that matches."""
    return packets.where(condition)


def live_overview(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id").agg(F.count("*").alias("total_packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def live_protocols(packets: DataFrame) -> DataFrame:
    return decoded(packets).select(F.explode("layers.protocol").alias("name")).groupBy("name").count()


def live_talkers(packets: DataFrame) -> DataFrame:
    return decoded(packets).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("packets"), F.sum("original_length").alias("bytes"))


def live_frequencies(packets: DataFrame, protocols: Iterable[str] | None = None) -> DataFrame:
    """Running counts of all names of the frequency tables; readers rank them as they like."""
    return name_counts(packets, protocols)


def live_streams(packets: DataFrame) -> DataFrame:
    """Running sums per TCP stream, whatever order its packets come in.

    Addresses are those of the first packet, by number, that has both. Ports are those of the
    first with a source port; what it lacks is of the last one before it that has it, so target
    ports of packets without a source port are kept with their numbers.
    """
    sp, dp = tcp_ports()
    rows = decoded(packets).where("stream_id is not null").select("capture_id", "stream_id", "number", "ts_us", "original_length", "src", "dst", sp.alias("sp"), dp.alias("dp"))
    known = F.coalesce("sp", F.lit(0)) != 0
    sums = rows.groupBy("capture_id", "stream_id").agg(
        F.min_by(F.struct("src", "dst"), F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.col("number"))).alias("e"),
        F.min_by(F.struct("number", "sp", "dp"), F.when(known, F.col("number"))).alias("p"),
        F.collect_list(F.when(~known & F.col("dp").isNotNull(), F.struct("number", "dp"))).alias("vague"),
        F.count("*").alias("packets"),
        F.sum("original_length").alias("bytes"),
        F.coalesce(F.round((F.max("ts_us") - F.min("ts_us")) / 1e6, 3), F.lit(0.0)).alias("duration_secs"),
    )
    late = F.array_max(F.filter("vague", lambda v: F.col("p.number").isNull() | (v["number"] < F.col("p.number"))))["dp"]
    return sums.select("capture_id", "stream_id", F.coalesce("e.src", F.lit("unknown")).alias("src"), F.coalesce("p.sp", F.lit(0)).alias("src_port"), F.coalesce("e.dst", F.lit("unknown")).alias("dst"), F.coalesce("p.dp", late, F.lit(0)).alias("dst_port"), "packets", "bytes", "duration_secs")


# ---------------------------------------------------------------- statistics with bounded state


def _in_windows(packets: DataFrame, width: str, lateness: str) -> DataFrame:
    return packets.withWatermark("ts", lateness).withColumn("window", F.window("ts", width))


def windowed_talkers(packets: DataFrame, width: str = "1 minute", lateness: str = "30 seconds") -> DataFrame:
    """Talkers of each window of event time; the state of a window goes ``lateness`` after its end.

    Packets later than that, or without a time, are not counted.
    """
    rows = decoded(_in_windows(packets, width, lateness)).where("src is not null and dst is not null")
    return rows.groupBy("window", "src", "dst").agg(F.count("*").alias("packets"), F.sum("original_length").alias("bytes"))


def windowed_frequencies(packets: DataFrame, protocols: Iterable[str] | None = None, width: str = "1 minute", lateness: str = "30 seconds") -> DataFrame:
    """Names of the frequency tables in each window of event time, under the terms of ``windowed_talkers``."""
    return name_counts(_in_windows(packets, width, lateness), protocols, by=("window",))


class WindowStore:
    """What windows hold, in a folder: a micro-batch's rows replace what earlier ones had for the same window and keys.

    Each batch is a folder named by its id, so a batch that runs again after a failure replaces
    itself and nothing counts twice. From time to time older folders become one.
    """

    def __init__(self, spark: SparkSession, path: str, values: Iterable[str], compact: int = 50):
        self.spark, self.path, self.values, self.compact = spark, path.rstrip("/"), list(values), compact
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _held(self) -> tuple[int, dict[int, str]]:
        """The last batch of the newest merged folder, and the complete folders to read by batch."""
        if not self._files.exists(self._folder):
            return -1, {}
        path = lambda name: self._folder.suffix(f"/{name}")
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder) if self._files.exists(path(f"{f.getPath().getName()}/_SUCCESS"))]
        merged = max((int(n.removeprefix("upto-")) for n in names if n.startswith("upto-")), default=-1)
        batches = {int(n.removeprefix("batch-")): n for n in names if n.startswith("batch-")}
        return merged, ({merged: f"upto-{merged}"} if merged >= 0 else {}) | {k: n for k, n in sorted(batches.items()) if k > merged}

    def _latest(self, folders: Iterable[str]) -> DataFrame:
        rows = self.spark.read.parquet(*(f"{self.path}/{n}" for n in folders))
        keys = [c for c in rows.columns if c not in (*self.values, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct("batch", *self.values), "batch").alias("v")).select(*keys, "v.*")

    def put(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        merged, folders = self._held()
        if len(folders) > self.compact:
            self._latest(folders.values()).write.mode("overwrite").parquet(f"{self.path}/upto-{max(folders)}")
            for name in folders.values():
                self._files.delete(self._folder.suffix(f"/{name}"), True)

    def totals(self) -> DataFrame:
        """Sums of all windows by key."""
        _, folders = self._held()
        if not folders:
            raise ValueError(f"{self.path}: nothing has been kept yet")
        latest = self._latest(folders.values())
        keys = [c for c in latest.columns if c not in ("window", "batch", *self.values)]
        return latest.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in self.values))


def keep_windows(windowed: DataFrame, store: WindowStore, checkpoint: str):
    """Starts a query that holds the windows' tables in ``store``; rank ``store.totals()`` with ``top_n``."""
    return windowed.writeStream.outputMode("update").foreachBatch(store.put).option("checkpointLocation", checkpoint).start()


# ---------------------------------------------------------------- pairs


class _Pairing(StatefulProcessor):
    """Holds a key's messages until the watermark passes them, then takes them in number order.

    What waits is one query, until a response or ``timeout_ms`` of event time.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "number long, ts_us long, ask boolean")
        self.waiting = handle.getValueState("waiting", "number long, ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = list(zip(frame["number"].tolist(), frame["ts_us"].tolist(), frame["ask"].tolist()))
            self.held.appendList(new)
            for ms in {us // 1000 for _, us, _ in new}:
                self.handle.registerTimer(max(0, ms - 1))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get()) if self.held.exists() else []
        waiting = tuple(self.waiting.get()) if self.waiting.exists() else None
        before, n, out = waiting, 0, []
        while n < len(held) and held[n][1] // 1000 <= passed:
            number, us, ask = held[n]
            n += 1
            if waiting is not None and us - waiting[1] >= 1000 * self.timeout_ms:
                waiting = None
            if ask:
                waiting = waiting or (number, us)
            else:
                if waiting is not None and us >= waiting[1]:
                    out.append((key[0], waiting[0], number, (us - waiting[1]) / 1e6))
                waiting = None
        rest = held[n:]
        if n:
            self.held.put(rest) if rest else self.held.clear()
        if rest:
            self.handle.registerTimer(max(passed, min(us for _, us, _ in rest) // 1000))
        elif waiting is not None and waiting[1] // 1000 + self.timeout_ms <= passed:
            waiting = None
        if waiting != before:
            if waiting is None:
                self.waiting.clear()
            else:
                self.waiting.update(waiting)
                self.handle.registerTimer(waiting[1] // 1000 + self.timeout_ms)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["capture_id", "query_number", "response_number", "rtt"]).astype({"query_number": "int64", "response_number": "int64", "rtt": "float64"})

    def close(self) -> None:
        pass


def live_dns_pairs(packets: DataFrame, timeout_s: float = 30.0, lateness_s: float = 0.0) -> DataFrame:
    """Answered DNS queries as they complete. Needs the RocksDB state store.

    Messages wait until event time is ``lateness_s`` past them, and are then taken in number
    order: those that come in any order within that time give the pairs of ``dns_pairs``, later
    ones are dropped. A query waits ``timeout_s`` of event time, exactly; the batch form only looks
    at every thousandth message.
    """
    rows = dns_messages(packets).where("qr is not null and id is not null and ts_us is not null and src is not null and transport is not null")
    ask = F.col("qr") == 0
    end = lambda a, p: F.concat(F.col(a), F.lit(":"), F.col(p).cast("string"))
    keyed = rows.select("capture_id", F.concat_ws("|", "transport", F.col("id").cast("string"), F.when(ask, end("src", "src_port")).otherwise(end("dst", "dst_port")), F.when(ask, end("dst", "dst_port")).otherwise(end("src", "src_port"))).alias("flow"), "number", "ts_us", ask.alias("ask"), F.timestamp_micros("ts_us").alias("ts"))
    marked = keyed.withWatermark("ts", f"{int(lateness_s * 1000)} milliseconds")
    return marked.groupBy("capture_id", "flow").transformWithStateInPandas(statefulProcessor=_Pairing(int(timeout_s * 1000)), outputStructType="capture_id string, query_number long, response_number long, rtt double", outputMode="Append", timeMode="EventTime")
