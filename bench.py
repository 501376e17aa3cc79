"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Packet tables are made once, as an engine over captures would, and timed by themselves. Each query
is then timed as it runs first (planning and compilation included) and as it runs again.
``from_bytes``: capture files of the events' frames to answers, from the files' bytes on (index,
decoding and the statistic), once and again.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidewire.functions import predicates as P
from tidewire.operators import stats
from tidewire.plans import captures, registry
from tidewire.sources.captures import read_capture, write_capture
from tidewire.sources.decode import decode

HEADLINE = {"overview": "a01_overview", "freq_all": "freq_all", "top_talkers": "a03_top_talkers", "filter_page": "l03_page", "sample_every": "l01_sample_every", "stream_summary": "a04_tcp_streams", "rtt_pairs": "j01_rtt_pairs"}

#: How often the events' frames are in the captures that are read from bytes.
COPIES = 10


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, first, again, packets = registry.queries(), {}, {}, {}

    def timed(job) -> float:
        start = time.perf_counter()
        job()
        return round(time.perf_counter() - start, 3)

    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    ingest = {"events": timed(lambda: captures.event_packets(spark, sf_dir)), "lineitem": timed(lambda: captures.signalling_packets(spark, sf_dir))}
    rows = {"events": captures.event_packets(spark, sf_dir).count(), "lineitem": captures.signalling_packets(spark, sf_dir).count()}
    for name, query in HEADLINE.items():
        run = lambda query=query: queries[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
        first[name], again[name] = timed(run), timed(run)
        packets[name] = rows["lineitem" if name == "freq_all" else "events"]
    folder = tempfile.mkdtemp(prefix="tidewire-bench-")
    frames = captures.event_frames(spark, sf_dir)
    for k in range(COPIES):
        write_capture(frames, f"{folder}/{k}")

    def answered() -> None:
        packets = decode(read_capture(spark, f"{folder}/*/*"))
        stats.overview(packets).collect()
        stats.top_talkers(packets.where(P.has_layer("udp") & P.field_gt("udp.src_port", 1024))).collect()

    from_bytes = {"packets": COPIES * rows["events"], "passes": 2, "first": timed(answered), "again": timed(answered)}
    print(json.dumps({"metric": "headline queries, first runs, total", "value": round(sum(first.values()), 3), "unit": "sec", "queries": first, "again": again, "ingest": ingest, "from_bytes": from_bytes, "packets": packets, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
