"""What the statistics publish is what they return; and what the driver's entry does without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tidewire import model
from tidewire.operators import correlate, stats
from tidewire.plans.captures import event_packets

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize(
    "name, made",
    [
        ("overview", stats.overview),
        ("protocols", stats.protocol_counts),
        ("top_talkers", stats.top_talkers),
        ("tcp_streams", lambda p: stats.tcp_streams(p, 10, ["capture_id"])),
        ("tables", stats.frequencies),
        ("response_time", lambda p: stats.response_summary(correlate.dns_pairs(p))),
    ],
)
def test_published_schemas(spark, name, made):
    got = made(event_packets(spark, "/root/testdata/sf0.001")).schema
    want = spark.createDataFrame([], model.STATISTICS[name]).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in want]


def entry_in(folder: Path, *, drop: tuple[str, ...] = (), broken: bool = False) -> subprocess.CompletedProcess:
    for name in ("tidewire", "__spark_entry__.py", "corpus_pipeline.py"):
        if not (ROOT / name).exists() or name in drop:
            continue
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, folder / name)
    if "tidewire/llm" in drop:
        shutil.rmtree(folder / "tidewire/llm", ignore_errors=True)
    if broken and (folder / "tidewire/llm").exists():
        with open(folder / "tidewire/llm/common.py", "a") as f:
            f.write("\nimport a_module_that_is_not_there\n")
    return subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print('FOUND', len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_folders(tmp_path):
    out = entry_in(tmp_path, drop=("tidewire/llm", "corpus_pipeline.py"))
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr


def test_entry_with_the_pipeline_alone(tmp_path):
    out = entry_in(tmp_path, drop=("tidewire/llm",))
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr


def test_entry_does_not_hide_other_missing_modules(tmp_path):
    if (ROOT / "tidewire/llm").exists():
        assert entry_in(tmp_path, broken=True).returncode != 0


def test_packet_tables_follow_their_source_and_can_be_removed(spark, tmp_path):
    from tidewire.sources import store

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(5).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert event_packets(spark, str(tmp_path)).count() == 5
    events.limit(9).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert event_packets(spark, str(tmp_path)).count() == 9
    assert store.clean(spark) >= 2 and store.clean(spark) == 0
    assert event_packets(spark, str(tmp_path)).count() == 9
