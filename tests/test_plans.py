"""Percentiles, samples, pages and delta times: exact, and without one task or whole rows under a sort."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import project, select, stats


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("n", [1, 2, 3, 500, 20_000])
def test_percentiles_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random(), rng.expovariate(3), 0.25, 1e6 * (rng.random() < 0.01)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "rtt double").repartition(5)
    got = stats.response_summary(df, cuts=16).first()
    assert [got["count"], got["min"], got["max"]] == [n, min(values), max(values)]
    assert [got["median"], got["p95"], got["p99"]] == pytest.approx(list(np.quantile(values, [0.5, 0.95, 0.99])), rel=1e-12)


def test_percentiles_by_group_and_of_nothing(spark):
    rows = [(c, float(k % m)) for c, m in (("a", 7), (None, 100), ("hot", 1)) for k in range(300)] + [("none", None)]
    df = spark.createDataFrame(rows, "capture_id string, rtt double")
    got = {r.capture_id: (r["count"], r.median, r.p95, r.p99) for r in stats.response_summary(df, by=["capture_id"]).collect()}
    want = {c: (300, *np.quantile([v for d, v in rows if d == c], [0.5, 0.95, 0.99])) for c in ("a", None, "hot")}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    assert stats.response_summary(df.where("rtt is null")).count() == 0
    text = plan(stats.response_summary(df))
    assert "percentile(" not in text and "collect_list" in text  # a few ranks are collected, never the values


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(2)
    rows = [(c, n, None if rng.random() < 0.2 else 1_000_000 * n, "x" * 50) for c in ("a", "b") for n in sorted(rng.sample(range(1, 200_000), 400))]
    return spark.createDataFrame(rows, "capture_id string, number long, ts_us long, layers string").repartition(4).cache()


@pytest.mark.parametrize("bucket", [3, 1000, 1 << 16])
def test_delta_times_do_not_depend_on_buckets(packets, bucket):
    rows = sorted((r.capture_id, r.number, r.ts_us) for r in packets.collect())
    want = {}
    for k, (c, n, us) in enumerate(rows):
        before = rows[k - 1][2] if k and rows[k - 1][0] == c else us
        want[c, n] = None if us is None or before is None else (us - before) / 1e6
    assert {(r.capture_id, r.number): r.delta_s for r in project.with_delta_time(packets, bucket=bucket).collect()} == want
    assert None in want.values()


@pytest.mark.parametrize("sample, offset, count", [(1, 0, 10), (7, 0, None), (3, 5, 20), (1, 390, None), (2, 150, 100), (1, 0, 0), (1, 0, None), (900, 0, 5)])
def test_pages_are_ordered_slices(packets, monkeypatch, sample, offset, count):
    keys = sorted((r.capture_id, r.number) for r in packets.collect())
    every = [k for c in ("a", "b") for k in [x for x in keys if x[0] == c][::sample]]
    want = every[offset : None if count is None else offset + count]
    for held in (select.HELD, 4):
        monkeypatch.setattr(select, "HELD", held)
        got = select.page(packets, sample=sample, offset=offset, count=count)
        assert [(r.capture_id, r.number) for r in got.collect()] == want
        assert got.columns == packets.columns
    if count is not None:
        assert select.truncated(packets, sample=sample, offset=offset, count=count).first()[0] == (len(every) > offset + count)


def test_only_keys_are_sorted_and_shuffled(spark, packets, tmp_path):
    packets.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    text = plan(select.sample_every(stored, 7))
    for part in re.findall(r"\((?:\d+)\) (?:Exchange|Sort|Window)\n(?:Input \[\d+\]: (.*)|.*\nInput.*)", text):
        assert "layers" not in part
    scans = re.findall(r"ReadSchema: (.*)", text)
    assert sum("layers" in s for s in scans) == 1
    page = plan(select.page(stored, sample=3, offset=200, count=5))
    assert sum("layers" in s for s in re.findall(r"ReadSchema: (.*)", page)) == 1


def test_document_parts_equal_their_operators_and_read_the_table_twice(spark):
    """Every part of the document is the operator's own list, from one scan; DNS times take a second."""
    import json

    from tidewire.operators import correlate
    from tidewire.plans.captures import event_packets, signalling_packets

    sf = "/root/testdata/sf0.001"
    for source in (event_packets, signalling_packets):
        packets = source(spark, sf)
        df = stats.document(packets, n=5)
        got = json.loads(df.first().stats)
        rows = lambda df: [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
        over = rows(stats.overview(packets))[0]
        assert {k: got[k] for k in over} == pytest.approx(over)
        assert got["protocols"] == rows(select.top_n(stats.protocol_counts(packets), None).orderBy(F.desc("count"), "name"))
        key = lambda r: [str(r.get(c)) for c in ("protocol", "metric", "group", "name")]
        assert sorted(got["tables"], key=key) == sorted(rows(stats.frequencies(packets, n=5)), key=key)
        talkers, streams = rows(stats.top_talkers(packets, 5)), rows(stats.tcp_streams(packets, 5, ["capture_id"]))
        assert got.get("top_talkers", []) == talkers
        assert got.get("tcp_streams", []) == streams
        assert got.get("dns_response_time", []) == rows(stats.response_summary(correlate.dns_pairs(packets)))
    text = plan(stats.document(packets, n=5))
    scans = [s for s in re.findall(r"ReadSchema: (.*)", text) if "layers" in s]
    assert len(scans) == 1


def test_document_of_nothing(spark):
    import json

    from tidewire.plans.captures import event_packets

    packets = event_packets(spark, "/root/testdata/sf0.001")
    assert json.loads(stats.document(packets.where("number < 0")).first().stats) == {"total_packets": 0, "duration_secs": 0.0}
    assert set(json.loads(stats.document(packets, ["dhcp"], talkers=False).first().stats)) == {"total_packets", "start_time", "end_time", "duration_secs", "protocols", "tables"}
