"""Fitting on Spark: a bounded labelled sample, shards that learn side by side, states that are mixed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

SHARDS = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """``shard, label, text`` of at most ``most`` labelled documents that ``usable`` admits.

    The sample is the rows whose ids hash lowest: all of them where there are fewer. Each class
    has half of the places if it can fill them, so a rare one is not lost. Ids with two labels
    take the larger; null labels and ids are not used. The chosen ids (at most ``most``) are
    sent to the executors.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    order = F.xxhash64("doc_id", F.lit(7))
    rare = known.where("label = 1").orderBy(order).limit(most // 2).unionByName(known.where("label = 0").orderBy(order).limit(most // 2))
    chosen = materialise(rare, "sample-ids")
    text = docs.select("doc_id", text_of().alias("text"))
    sample = text.join(F.broadcast(chosen), "doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SHARDS)).alias("shard"), F.xxhash64("doc_id", F.lit(13)).alias("order"), "label", "text")
    return materialise(sample, "sample")


@dataclass(frozen=True)
class Leader:
    """Follow-the-regularised-leader, per coordinate: z gathers gradients, n their squares."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, z: np.ndarray, n: np.ndarray, key: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        z[key] += g - (np.sqrt(n[key] + g * g) - np.sqrt(n[key])) / self.alpha * w
        n[key] += g * g


def _shard(sent, learn, turn: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        order = np.random.default_rng(turn).permutation(len(table))
        table = table.take(pa.array(order)).combine_chunks()
        out = learn([x.astype(np.float64) for x in sent.value], table.column("label").to_numpy(), table.column("text"), turn)
        return pa.table({"state": pa.array([b"".join(np.asarray(x, "<f4").tobytes() for x in out)], pa.binary())})

    return run


def _moves(sent):
    """The sum of what the shards' states moved from the joint one, in one row."""

    def run(batches):
        before = np.concatenate(sent.value).astype(np.float64)
        moved = np.zeros(len(before))
        n = 0
        for batch in batches:
            for state in batch.column(0).to_pylist():
                moved += np.frombuffer(state, "<f4") - before
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([moved.astype("<f4").tobytes()], pa.binary())], ["moved"])

    return run


def mix(sample: DataFrame, start: list[np.ndarray], learn: Callable[[list[np.ndarray], np.ndarray, pa.Array, int], list[np.ndarray]], rounds: int, gain: float = 0.25) -> list[np.ndarray]:
    """Iterative parameter mixing: every round, each shard learns on from the joint state.

    The joint state moves by ``gain`` times the sum of what the shards' states moved: 1 is as if
    all steps had been taken in turn, 1 / SHARDS is the mean.

    A state is a fixed number of vectors of fixed length, and there are ``SHARDS`` shards; their
    moves are summed in one task, so what reaches the driver is one state, whatever the corpus. A
    lost shard is learnt again from the round's start.
    """
    spark = sample.sparkSession
    state = [np.asarray(x, np.float32) for x in start]
    cuts = np.cumsum([len(x) for x in state])[:-1]
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(state)
        states = sample.groupBy("shard").applyInArrow(_shard(sent, learn, turn), "state binary")
        got = states.repartition(1).mapInArrow(_moves(sent), "moved binary").collect()
        if not got:
            return state
        flat = np.concatenate(state) + np.float32(gain) * np.frombuffer(got[0]["moved"], "<f4")
        state = [x.astype(np.float32) for x in np.split(flat, cuts)]
        sent.destroy()
    return state
