"""What larger tables bring: more users than an octet holds, and more rows than a task should."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tidewire.plans import registry


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of users whose ids fill one, two and three octets, of every type."""
    folder = str(tmp_path_factory.mktemp("sf"))
    users = [5, 255, 256, 65_535, 65_536, 90_000, 700_001, 16_777_215]
    kinds = ["click", "view", "purchase", "signup", "error"]
    rows = [(n, datetime(2024, 1, 1) + timedelta(seconds=n, microseconds=n), users[n % 8], kinds[n % 5], 1.5 * n, f'{{"k": {n * 7 % 100}}}') for n in range(400)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    made.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def expected(name: str, folder: str) -> list[tuple]:
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
        return sorted(map(str, c.execute(registry.oracle_sql()[name]).fetchall()))


@pytest.mark.parametrize("name", ["s02_s07_capture_files", "s03_decode"])
def test_addresses_of_many_users(spark, many_users, name):
    got = [tuple(r) for r in registry.queries()[name](spark, many_users).collect()]
    assert sorted(map(str, got)) == expected(name, many_users)
    assert {r[2] for r in got} >= {"10.0.255.255", "10.1.0.0", "10.1.95.144", "10.10.174.97", "10.255.255.255"}


def test_plain_columns_follow_from_the_layers(spark, many_users, tmp_path):
    """What the views state beside the layers is what looking into the layers finds, for events that lack values too."""
    from pyspark.sql import functions as F

    from tidewire.model import FACTS, FLOW, as_packets
    from tidewire.plans import captures

    events = spark.read.parquet(f"{many_users}/events.parquet")
    for column in ("user_id", "props", "event_type"):
        events = events.unionByName(spark.read.parquet(f"{many_users}/events.parquet").where("event_id < 80").withColumn(column, F.lit(None).cast(events.schema[column].dataType)))
    events.write.parquet(f"{tmp_path}/events.parquet")
    for made in (captures.build_event_packets(spark, str(tmp_path)), captures.build_signalling_packets(spark, "/root/testdata/sf0.001")):
        looked = as_packets(made.drop(*FLOW, *FACTS, "stack"))
        assert looked.exceptAll(made).isEmpty() and made.exceptAll(looked).isEmpty()


def test_larger_tables_are_built_by_more_tasks(spark, many_users, monkeypatch):
    from tidewire.plans import captures

    monkeypatch.setattr(captures, "ROWS", 20)
    assert captures.build_event_packets(spark, many_users).rdd.getNumPartitions() == 20
    monkeypatch.setattr(captures, "ROWS", 10**6)
    assert captures.build_event_packets(spark, many_users).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_plain_layers_are_not_walked(spark, many_users, monkeypatch):
    """Records of plain layers go through flat columns both ways; the objects of the others stay as they were."""
    import json

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from tidewire.model import DECODED
    from tidewire.sources import records

    record = lambda fields: json.dumps({"number": 1, "timestamp": "1970-01-01T00:00:01.000500Z", "length": 1, "original_length": 1, "stack": "P", "layers": [{"protocol": "P", "fields": fields}]}, separators=(",", ":"), ensure_ascii=False)
    plain = record({"a": 1, "a_name": "\"é\n", "b": "x", "c": -3, "big": 2**64 - 1, "e_name": "", "e": 0})
    shaped = record({"a": 2**64, "b": None, "c": [{"d": 1}], "t": True})
    monkeypatch.setattr(records, "_flatten", None)
    monkeypatch.setattr(records, "_nested", None)
    held = records._columns([plain], pa.array(["f"]), {}, to_arrow_schema(DECODED))
    as_written = pa.RecordBatch.from_arrays([held.column("number"), pa.array(["1970-01-01T00:00:01.000500Z"]), *(held.column(c) for c in ("length", "original_length", "stack", "layers")), pa.nulls(1, pa.string())], ["number", "timestamp", "length", "original_length", "stack", "layers", "raw_bytes"])
    assert records._texts(as_written) == [plain]
    with pytest.raises(TypeError):
        records._columns([shaped], pa.array(["f"]), {}, to_arrow_schema(DECODED))


def test_visibility_splits_paths_only_for_dotted_patterns(spark):
    from pyspark.sql import functions as F

    from tidewire.model import as_packets, field, layer
    from tidewire.operators import project

    made = layer(0, "P", field("a", "u8", F.lit(1), F.lit("A")), field("a.b", "u8", F.lit(2)), field("bc.d.e", "u8", F.lit(3)), field("xa", "u8", F.lit(4)))
    packets = as_packets(spark.range(2).select(F.lit("c").alias("capture_id"), F.col("id").alias("number"), F.array(made).alias("layers")))
    seen = lambda patterns: [f.path + ("+" if f.name else "") for f in project.visible_fields(packets, {"P": patterns}).first().layers[0].fields]
    assert seen(["a"]) == ["a", "a.b"] and seen(["a*"]) == ["a+", "a.b"] and seen(["*a", "bc"]) == ["a", "a.b", "bc.d.e", "xa"] and seen([]) == []
    assert seen(["bc.d"]) == ["bc.d.e"] and seen(["bc.x"]) == []
    text = lambda patterns: project.visible_fields(packets, {"P": patterns})._jdf.queryExecution().analyzed().toString()
    assert "forall" not in text(["a", "b*"]) and "forall" in text(["a.b"])


def test_lists_of_a_document_do_not_come_together_whole(spark):
    """Sums are kept by hash, and of very many talkers only the first of each lot meet in the task that ranks them."""
    from pyspark.sql import functions as F

    from tidewire.model import as_packets, field, layer
    from tidewire.operators import stats

    made = spark.range(20_000).select(F.lit("c").alias("capture_id"), F.col("id").alias("number"), (F.col("id") % 7919).cast("int").alias("original_length"), F.array(layer(0, "IPv4", field("src", "ipv4addr", F.col("id")), field("dst", "ipv4addr", F.lit("d")))).alias("layers"))
    sums = stats._sums(stats._tagged(as_packets(made), ["dns"], True), ["dns"])
    text = sums._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and text.count("HashAggregate(") >= 4 and "ObjectHashAggregate" not in text and "SortAggregate" not in text
    kept = stats._ranked(sums, 10)
    assert kept.where("protocol = '@talkers'").orderBy("_rank").select("bytes").toPandas()["bytes"].tolist() == [7918, 7918, 7917, 7917, 7916, 7916, 7915, 7915, 7914, 7914]
    assert sums.count() > 20_000 and _rows_before_windows(kept)[-1] <= 64 * 10 + 3


def _rows_before_windows(df) -> list[int]:
    """Rows that each window of a plan reads, the first window first."""
    plans, counts = [df._jdf.queryExecution().optimizedPlan()], []
    while plans:
        at = plans.pop()
        if at.nodeName() == "Window":
            counts.append(at)
        plans.extend(at.children().apply(k) for k in range(at.children().size()))
    dataset = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset
    return [dataset.ofRows(df._jdf.sparkSession(), w.children().apply(0)).count() for w in reversed(counts)]


def test_equal_messages_are_looked_into_once(spark, monkeypatch):
    """Tables count equal messages first; packets of one pass are made once, after they are dealt out, and not stored."""
    from pyspark.sql import functions as F

    from tidewire.model import as_packets, field, layer
    from tidewire.operators import stats

    made = layer(0, "SIP", field("method", "str", F.concat(F.lit("M"), F.col("id") % 3)), field("status_code", "u16", F.lit(200)))
    packets = as_packets(spark.range(300).select(F.lit("c").alias("capture_id"), F.col("id").alias("number"), F.array(made).alias("layers")))
    seen, named = [], stats._named
    monkeypatch.setattr(stats, "_named", lambda messages, *more: (seen.append(messages.count()), named(messages, *more))[1])
    got = {(r.metric, r.name): r["count"] for r in stats.frequencies(packets).collect()}
    assert got == {("total_requests", None): 300, ("method_distribution", "M0"): 100, ("method_distribution", "M1"): 100, ("method_distribution", "M2"): 100}
    assert seen == [3]
    monkeypatch.undo()
    text = registry.queries()["freq_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Repartition ") :]
    assert "mDNS" in text and "mDNS" not in below and "lineitem" not in below.split("Relation")[0]
