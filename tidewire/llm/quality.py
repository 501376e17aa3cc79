"""Quality: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, buffer_of, keys_of, lowered, mixed, slices, text_of
from .learning import Leader, labelled_sample, mix

BITS = 18

_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letters (all non-ASCII), 2 digits, 3 signs
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters, digits or signs, and the runs before each row."""
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    cuts = offsets[1:-1]
    first[cuts[cuts < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature number and value: sparse rows of unit length.

    Features are the pieces and the pairs of neighbouring pieces, hashed; a piece that repeats
    the one before makes the same pair whatever it is. A value is the root of the feature's
    share of the row's n-grams.
    """
    starts, ends, bounds = pieces_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    h = Spans(lowered(data))(starts, ends)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = np.flatnonzero(row[1:] == row[:-1])
    joint = np.where(h[pair] == h[pair + 1], np.uint64(1), mixed(h[pair]) + h[pair + 1])
    key = np.concatenate([row << BITS | keys_of(h, 1, BITS), row[pair] << BITS | keys_of(joint, 2, BITS)])
    key, count = np.unique(key, return_counts=True)
    row, key = key >> BITS, key & ((1 << BITS) - 1)
    total = np.bincount(row, count)
    return row, key, np.sqrt(count / total[row])


LEADER = Leader(alpha=1.0, beta=1.0, l1=0.02, l2=0.1)


def _learn(state, label, text: pa.Array, turn: int):
    z, n = state
    data, offsets = buffer_of(text)
    for i, j in slices(offsets, 1 << 21):
        row, key, value = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            # the last place is the intercept
            own, x = np.append(key[a:b], 1 << BITS), np.append(value[a:b], 1.0)
            w = LEADER.weights(z[own], n[own])
            LEADER.step(z, n, own, w, (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label[i + k]) * x)
    return [z, n]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "quality", most: int = 16_000, rounds: int = 8) -> np.ndarray:
    """Weights of the features and, last, the intercept.

    At most ``most`` labelled documents are learnt from (see ``labelled_sample``); labels are
    read by id and are no input of a score. No usable label: all weights 0, every score 0.5.
    """
    sample = labelled_sample(docs, labels, label, usable, most)
    z, n = mix(sample, [np.zeros((1 << BITS) + 1)] * 2, _learn, rounds)
    return LEADER.weights(z.astype(np.float64), n.astype(np.float64)).astype(np.float32)


def _score(handle, step: int = 1 << 21):
    def run(batches):
        w = handle.value
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            out = [np.zeros(0)]
            for i, j in slices(offsets, step):
                row, key, value = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out.append(1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(row, w[key] * value, minlength=j - i), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every whole text: the sparse dot product's logistic value.

    Null and empty texts score by the intercept alone. Repeated and null ids keep a row each, and
    equal texts score alike; further columns are ignored; an empty table gives no rows. A very
    long text is one row of features, with memory that grows with its length. The weights have a
    fixed size.
    """
    handle = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_score(handle), "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their own columns, whatever their names.

    Null and empty texts go by the intercept alone. Repeated rows and ids all stay or all go, as
    equal texts score alike. An empty table gives no rows.
    """
    handle = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches):
        w = handle.value
        for batch in batches:
            data, offsets = buffer_of(batch.column(at))
            for i, j in slices(offsets, 1 << 21):
                row, key, value = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(row, w[key] * value, minlength=j - i), -30, 30)))
                yield batch.slice(i, j - i).filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
