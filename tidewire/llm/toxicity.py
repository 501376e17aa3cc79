"""Toxicity by multiple-instance learning: sentences' chances, joined by noisy-or, fit to documents' labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, buffer_of, keys_of, lowered, slices, text_of
from .learning import Leader, labelled_sample, mix
from .quality import _CLASS, pieces_of

BITS = 18
#: A word's features: itself, and its first bytes where it is longer.
PREFIXES = (4, 5, 6)
START = -6.0

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F, 0x0A]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Feature numbers with the sentence of each, and the row, start and end of each sentence.

    A sentence ends with ``. ! ?`` or a line end. Sentences without letters have no features and
    are left out.
    """
    starts, ends, bounds = pieces_of(data, offsets)
    letters = _CLASS[data[starts]] == 1
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[letters]
    starts, ends = starts[letters], ends[letters]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    stops = np.flatnonzero(_STOP[data])
    part = np.searchsorted(stops, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    hasher = Spans(lowered(data))
    keys, of = [keys_of(hasher(starts, ends), 1, BITS)], [sentence]
    for n in PREFIXES:
        long = ends - starts > n
        keys.append(keys_of(hasher(starts[long], starts[long] + n), n, BITS))
        of.append(sentence[long])
    return np.concatenate(keys), np.concatenate(of), row[head], starts[head], ends[np.append(head[1:], len(starts)) - 1]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _noisy_or(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over each row's sentences."""
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-13)), minlength=n))


LEADER = Leader(alpha=1.0, beta=1.0, l1=0.5, l2=0.0)


def _learn(state, label, text: pa.Array, turn: int):
    """One pass of follow-the-leader steps on the documents' log-likelihood.

    With P the document's chance, a sentence's share of the slope is p (1 - P) / P upwards for a
    toxic document, mostly to its likeliest sentences, and p downwards for any other.
    """
    z, squares = state
    data, offsets = buffer_of(text)
    for i, j in slices(offsets, 1 << 21):
        key, of, row, _, _ = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        order = np.argsort(of, kind="stable")
        key, of = key[order], of[order]
        first = np.searchsorted(row, np.arange(j - i + 1))
        at = np.searchsorted(of, first)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if a == b:
                continue
            n, where = first[k + 1] - first[k], of[a:b] - first[k]
            own, place = np.unique(key[a:b], return_inverse=True)
            own = np.append(own, 1 << BITS)
            w = LEADER.weights(z[own], squares[own])
            p = _logistic(START + w[-1] + np.bincount(where, w[place], minlength=n))
            if label[i + k]:
                joint = max(1e-9, float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-13)).sum())))
                slope = -p * (1 - joint) / joint
            else:
                slope = p
            LEADER.step(z, squares, own, w, np.append(np.bincount(place, slope[where], minlength=len(own) - 1), slope.sum()))
    return [z, squares]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", most: int = 16_000, rounds: int = 8) -> np.ndarray:
    """Weights of the features and, last, the intercept of a sentence.

    At most ``most`` labelled documents are learnt from (see ``labelled_sample``); labels are
    read by id and are no input of a score. No usable label: a low score for every text.
    """
    sample = labelled_sample(docs, labels, label, usable, most)
    z, squares = mix(sample, [np.zeros((1 << BITS) + 1)] * 2, _learn, rounds)
    w = LEADER.weights(z.astype(np.float64), squares.astype(np.float64))
    w[-1] += START
    return w.astype(np.float32)


SENTENCES = "array<struct<start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _score(handle, least: float, step: int = 1 << 21):
    def run(batches):
        w = handle.value.astype(np.float64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for i, j in slices(offsets, step):
                part = data[offsets[i] : offsets[j]]
                key, of, row, starts, ends = sentences(part, offsets[i : j + 1] - offsets[i])
                p = _logistic(w[-1] + np.bincount(of, w[key], minlength=len(row)))
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                hits = np.flatnonzero(p >= least)
                if len(hits):
                    points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    begin = points[offsets[i : j + 1] - offsets[i]]
                    for s in hits.tolist():
                        spans[row[s]].append({"start": int(points[starts[s]] - begin[row[s]]), "end": int(points[ends[s]] - begin[row[s]]), "score": float(p[s])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(_noisy_or(p, row, j - i)), pa.array(spans, _ARROW)], ["doc_id", "score", "sentences"])

    return run


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """``doc_id, score, sentences``: the noisy-or of the whole text, and its offending sentences.

    ``sentences`` has each one whose own chance is ``least`` or more, in code points. Null and
    empty texts score 0, as do texts without a letter. Repeated and null ids keep a row each, and
    equal texts score alike; further columns are ignored; an empty table gives no rows. A very
    long text is many sentences, with memory that grows with its length. The weights have a fixed
    size.
    """
    handle = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_score(handle, least), f"doc_id long, score double, sentences {SENTENCES}")
