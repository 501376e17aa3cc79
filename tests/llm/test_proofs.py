"""Learners, thresholds and pattern graphs against plain loops; the columns of the ten queries."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import pii, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


class PlainLeader:
    """Follow-the-regularised-leader with a dictionary of coordinates."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, k):
        z, n = self.z[k], self.n[k]
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def step(self, gradients, weights):
        for k, g in gradients.items():
            self.z[k] += g - (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / self.alpha * weights[k]
            self.n[k] += g * g


def sample(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "x", "12", "hä", "foo!", "foo!!", "idiotic"]
    return [(int(r.random() < 0.5), " ".join(r.choice(words) for _ in range(r.randint(0, 12))) + r.choice([".", "!\n", "", " 77 "])) for _ in range(60)]


def test_quality_learns_as_plain_loops_do():
    rows = sample(3)
    state = quality._learn([np.zeros((1 << quality.BITS) + 1)] * 1 + [np.zeros((1 << quality.BITS) + 1)], np.array([y for y, _ in rows]), pa.array([t for _, t in rows]), 0)
    w = quality.LEADER.weights(*state)
    plain = PlainLeader(1.0, 1.0, 0.02, 0.1)

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        pieces = re.findall(r"[a-z\x80-\U0010ffff]+|[0-9]+|[^a-z0-9\x80-\U0010ffff \t-\r]+", low)
        grams = Counter([(p,) for p in pieces] + [("=", "=") if a == b else (a, b) for a, b in zip(pieces, pieces[1:])])
        total = sum(grams.values())
        return {k: math.sqrt(c / total) for k, c in grams.items()} | {"intercept": 1.0}

    def chance(x):
        return 1 / (1 + math.exp(-max(-30, min(30, sum(plain.weight(k) * v for k, v in x.items())))))

    for y, text in rows:
        x = features(text)
        p = chance(x)
        plain.step({k: (p - y) * v for k, v in x.items()}, {k: plain.weight(k) for k in x})
    texts = [t for _, t in rows] + ["alpha beta gamma", "unseen words"]
    from tidewire.llm.common import buffer_of

    data, offsets = buffer_of(pa.array(texts))
    row, key, value = quality.features(data, offsets)
    got = 1 / (1 + np.exp(-(w[-1] + np.bincount(row, w[key] * value, minlength=len(texts)))))
    assert np.allclose(got, [chance(features(t)) for t in texts], atol=1e-9) and len(set(np.round(got, 6))) > 20


def test_toxicity_learns_as_plain_loops_do():
    rows = sample(4)
    size = (1 << toxicity.BITS) + 1
    z, n = toxicity._learn([np.zeros(size), np.zeros(size)], np.array([y for y, _ in rows]), pa.array([t for _, t in rows]), 0)
    w = toxicity.LEADER.weights(z, n)
    plain = PlainLeader(1.0, 1.0, 0.5, 0.0)

    def instances(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        out = []
        for sentence in re.split(r"[.!?\n]", low):
            words = [w.encode() for w in re.findall(r"[a-z\x80-\U0010ffff]+", sentence)]
            if words:
                out.append(Counter([(0, w) for w in words] + [(k, w[:k]) for w in words for k in toxicity.PREFIXES if len(w) > k]))
        return out

    def chances(text):
        return [1 / (1 + math.exp(-(toxicity.START + plain.weight("intercept") + sum(c * plain.weight(k) for k, c in x.items())))) for x in instances(text)]

    for y, text in rows:
        found, p = instances(text), chances(text)
        if not found:
            continue
        joint = max(1e-9, 1 - math.prod(1 - q for q in p))
        slopes = [-q * (1 - joint) / joint if y else q for q in p]
        gradients = defaultdict(float)
        for s, x in zip(slopes, found):
            for k, c in x.items():
                gradients[k] += s * c
        gradients["intercept"] = sum(slopes)
        plain.step(gradients, {k: plain.weight(k) for k in gradients})
    from tidewire.llm.common import buffer_of

    texts = [t for _, t in rows]
    data, offsets = buffer_of(pa.array(texts))
    key, of, row, _, _ = toxicity.sentences(data, offsets)
    p = toxicity._logistic(toxicity.START + w[-1] + np.bincount(of, w[key], minlength=len(row)))
    got = toxicity._noisy_or(p, row, len(texts))
    assert np.allclose(got, [1 - math.prod(1 - q for q in chances(t)) for t in texts], atol=1e-9) and len(set(np.round(got, 6))) > 10


def test_secret_bins_against_plain_counting(spark):
    r = random.Random(5)
    alphabet = secrets.ENCODINGS["base62"]
    rows = []
    for k in range(6000):
        token = "".join(r.choice(alphabet) for _ in range(22)) if k % 2 else "".join(r.choice(["abc1", "def2", "ghi3"]) for _ in range(r.choice([4, 6])))
        rows.append((k, f"some words {token} and more"))
    tested = [(k, s, e, n, p) for k, t in rows for s, e, n, p in secrets.candidates(t, secrets.base_spans(t))]
    accepted = {}
    for key in {(n, secrets.stratum(e - s)) for _, s, e, n, _ in tested}:
        own = [min(secrets.BINS - 1, int(p * secrets.BINS)) for _, s, e, n, p in tested if (n, secrets.stratum(e - s)) == key]
        counts = [own.count(b) for b in range(secrets.BINS)]
        level = sum(counts[secrets.BINS // 2 :]) / (secrets.BINS / 2)
        fine = [b for b in range(secrets.BINS) if sum(counts[b:]) and sum(max(0, c - level) for c in counts[b:]) <= 0.1 * sum(counts[b:])]
        accepted[key] = min(fine, default=secrets.BINS)
    want = {k: set() for k, _ in rows}
    for k, s, e, n, p in tested:
        if p > 0.001 and min(secrets.BINS - 1, int(p * secrets.BINS)) >= accepted[n, secrets.stratum(e - s)]:
            want[k].add((s, e))
    got = {x.doc_id: {(s.start, s.end) for s in x.spans if s.kind == "random"} for x in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) > 50


def test_pattern_graph_against_plain_loops(spark):
    r = random.Random(6)
    spans = "array<struct<kind:string,start:int,end:int,instance:bigint,patterns:array<bigint>>>"
    rows, edges = [], {}
    for row in range(300):
        base, others = [], []
        for side, out in ((1.0, base), (0.0, others)):
            for _ in range(r.randrange(0, 3)):
                group = r.randrange(12)
                instance, patterns = r.randrange(40) + (1000 if side else 0) + 50 * (group // 4), [group] + ([group + 100] if r.random() < 0.3 else [])
                out.append(("k", 0, 1, instance, patterns))
                for p in patterns:
                    edges[instance, p] = max(side, edges.get((instance, p), 0.0))
        rows.append((row, row, base, others))
    least, seeds, score = 0.85, 3, {}
    for _ in range(50):
        of = defaultdict(list)
        for (i, p), seed in edges.items():
            of[p].append(max(seed, score.get(i, 0.0)))
        trust = {p: sum(v) / (len(v) + 1) for p, v in of.items() if sum(x >= least for x in v) >= seeds}
        score = {}
        for (i, p), seed in edges.items():
            if seed == 0 and p in trust:
                score[i] = max(score.get(i, 0.0), trust[p])
    scanned = spark.createDataFrame(rows, f"row long, doc_id long, base {spans}, others {spans}")
    got = {x.pattern for x in pii.trusted(scanned, least=least, seeds=seeds, rounds=50).collect()}
    assert got == {p for p, t in trust.items() if t >= least} and 0 < len(got) <= len({p for _, p in edges})


KINDS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_line_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_best_two_fit": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_decontaminate": "doc_id bigint, contaminated boolean, n_spans int",
    "op9_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}
FOLDS = {"op1_toxicity": (4, 2), "op5_quality": (5, 0), "op10_language_model": (5, 1)}


@pytest.mark.parametrize("name", KINDS)
def test_queries_have_their_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: k for c, k in (x.split(" ") for x in KINDS[name].split(", "))}.items() <= kinds.items()
    rows = df.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows if name != "op7_best_two_fit" or r.piece == 0) == sorted(ids)
    if name in FOLDS:
        k, held = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == held) for r in rows)
    if "predicted" in kinds:
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
