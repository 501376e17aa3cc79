"""Secrets: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, materialise, text_of

# ---------------------------------------------------------------- base patterns


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed patterns: keyword assignments, access-key ids, runs of hexadecimal digits.
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the fixed patterns' matches, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


# ---------------------------------------------------------------- randomness tests

#: Alphabets in the order they are tried: the first that holds every character is inferred.
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "BASE36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SYMBOLS = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}

#: A candidate: a long run of encoding characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What a run is cut at that is of no alphabet as a whole.
_PARTS = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9]{16,}")


def infer(token: str) -> str | None:
    chars = set(token.rstrip("="))
    return next((name for name, own in _SETS.items() if chars <= own), None)


def _upper_normal(z: float) -> float:
    from math import erfc, sqrt

    return 0.5 * erfc(z / sqrt(2))


def _upper_chi2(x: float, k: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    return 1.0 if x <= 0 else _upper_normal(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / (2 / (9 * k)) ** 0.5)


def battery(token: str) -> tuple[str, float] | None:
    """The inferred encoding and the joint p-value of three tests that the token is random in it.

    Uniformity: chi-squared over the alphabet in up to 8 equal ranges, so that short tokens have
    filled cells. Runs: the number of runs above and below the middle of the alphabet. Serial
    correlation: of neighbouring symbols. The p-values join by Fisher's method. Small: not random.
    """
    name = infer(token)
    if name is None:
        return None
    x = np.array([_SYMBOLS[name][c] for c in token.rstrip("=")], float)
    n, size = len(x), len(ENCODINGS[name])
    cells = min(8, size, max(2, n // 4))
    counts = np.bincount((x * cells / size).astype(int), minlength=cells)
    # ranges of an alphabet whose size the cells do not divide hold unequal shares
    share = np.bincount((np.arange(size) * cells / size).astype(int), minlength=cells) / size
    p = [_upper_chi2(float(((counts - n * share) ** 2 / (n * share)).sum()), cells - 1)]
    high = x >= size / 2
    ones = int(high.sum())
    mean = 1 + 2 * ones * (n - ones) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p.append(2 * _upper_normal(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / var**0.5) if var > 0 else 0.0)
    d = x - x.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total if total else 1.0
    p.append(2 * _upper_normal(abs(r + 1 / n) * n**0.5))
    fisher = -2 * sum(np.log(max(v, 1e-300)) for v in p)
    half = fisher / 2  # chi-squared with 6 degrees of freedom, in closed form
    return name, float(min(1.0, np.exp(-half) * (1 + half + half * half / 2)))


#: Bounds of the length strata. Power differs with length, so each is controlled by itself.
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96)
BINS = 50


def stratum(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right"))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """Start, end, encoding and p-value of each candidate that no base span touches.

    A run that mixes the signs of two alphabets is cut at ``-`` and ``_``, and its parts are
    tested. ``taken`` is by start; the least end before each place and the next start decide.
    """
    out = []
    starts = [s for s, _, _ in taken]
    ends = list(accumulate((e for _, e, _ in taken), max))

    def test(start: int, token: str) -> None:
        end = start + len(token)
        k = bisect_left(starts, end)  # spans that begin before the token's end
        if k and ends[k - 1] > start:
            return
        # one kind of character in runs (a word, then a number) is a name, not a key
        changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token, token[1:]))
        if changes * 8 < len(token) and not token.isdigit():
            return
        if tested := battery(token):
            out.append((start, end, *tested))
        elif len(token) >= 16 and infer(token) is None:
            for m in _PARTS.finditer(token):
                if m.end() - m.start() < len(token):
                    test(start + m.start(), m.group())

    for m in CANDIDATE.finditer(text):
        test(m.start(), m.group())
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"
CANDIDATES = "array<struct<start:int,end:int,encoding:string,p:double>>"
_ARROW = {
    "base": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
    "tested": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("p", pa.float64())])),
}


def _scan(batches):
    for batch in batches:
        base, tested = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            tested.append([{"start": s, "end": e, "encoding": n, "p": p} for s, e, n, p in candidates(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _ARROW["base"]), pa.array(tested, _ARROW["tested"])], ["doc_id", "base", "tested"])


def thresholds(counts: list[tuple[str, int, int, int]], share: float) -> dict[tuple[str, int], int]:
    """The lowest bin to accept in each stratum of encoding and length.

    Among random tokens p-values are uniform: their number follows from the upper half of the
    bins. What is in excess below comes from other tokens. Tokens from a bin on are accepted if
    the excess among them is at most ``share`` of them.
    """
    table: dict[tuple[str, int], np.ndarray] = {}
    for encoding, length, cell, n in counts:
        table.setdefault((encoding, length), np.zeros(BINS))[cell] += n
    out = {}
    for key, cells in table.items():
        random = cells[BINS // 2 :].sum() / (BINS - BINS // 2)
        kept = np.cumsum(cells[::-1])[::-1]
        excess = np.cumsum(np.maximum(0, cells - random)[::-1])[::-1]
        fine = np.flatnonzero((excess <= share * kept) & (kept > 0))
        out[key] = int(fine[0]) if len(fine) else BINS
    return out


def _cell(length: Column, p: Column) -> tuple[Column, Column]:
    return sum((length >= n).cast("int") for n in LENGTHS), F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int")


def _accepted(tested: DataFrame, share: float) -> dict[tuple[str, int], int]:
    """The lowest accepted bin of each stratum, from rows ``t`` of all documents' candidates.

    Encodings x lengths x bins numbers reach the driver, whatever the corpus.
    """
    length, cell = _cell(F.col("t.end") - F.col("t.start"), F.col("t.p"))
    rows = tested.groupBy(F.col("t.encoding").alias("encoding"), length.alias("length"), cell.alias("cell")).count().collect()
    return thresholds([(r.encoding, r.length, r.cell, r["count"]) for r in rows], share)


def find(docs: DataFrame, *, share: float = 0.1, floor: float = 0.001) -> DataFrame:
    """``doc_id, base, spans``: the fixed patterns' matches, and those with the method's added.

    Candidates pass the battery if their p-value is over ``floor`` and in an accepted bin of
    their stratum; the bins are counted over all documents, so false discoveries are controlled
    where they arise, among tokens of like length. Offsets are code points, ends exclusive.
    Kinds: assign, access, hex, random.

    Null or empty text: no spans. Repeated and null ids keep a row each; further columns are
    ignored; an empty table gives no rows. Spans of two kinds at one place are both kept. A very
    long text takes time in proportion to its length.
    """
    scanned = materialise(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_scan, f"doc_id long, base {SPANS}, tested {CANDIDATES}"), "secret-scan")
    accepted = _accepted(scanned.select(F.explode("tested").alias("t")), share)

    def passes(t):
        size, cell = _cell(t["end"] - t["start"], t["p"])
        least = F.lit(BINS)
        for (encoding, stratum_), low in accepted.items():
            least = F.when((t["encoding"] == encoding) & (size == stratum_), F.lit(low)).otherwise(least)
        return (t["p"] > floor) & (cell >= least)

    if not accepted:
        return scanned.select("doc_id", "base", F.col("base").alias("spans"))
    added = F.transform(F.filter("tested", passes), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", F.concat("base", added).alias("spans"))


def ordered(spans: Column) -> Column:
    """``kind:start:end``, by start, then kind as listed (random last), comma-joined."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(ordered(F.col("base")).cast("binary"), 256).alias("base_sha256"), ordered(F.col("spans")).alias("spans"))


def _masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """Every span as ``mark``; overlapping ones as one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", *, share: float = 0.1, floor: float = 0.001) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; ``n_chars``, if there, follows.

    Two passes over the documents, without a shuffle of texts: the first counts the candidates'
    strata, the second finds the spans again and masks them in place.

    Null texts stay null. Every row stays, with its own columns, also where rows or ids repeat.
    Spans that overlap become one mark. Columns may have any names.
    """
    tested = docs.select(F.lit(None).cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_scan, f"doc_id long, base {SPANS}, tested {CANDIDATES}")
    accepted = _accepted(tested.select(F.explode("tested").alias("t")), share)
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def spans_in(text: str) -> list[tuple[int, int]]:
        base = base_spans(text)
        added = [(s, e) for s, e, encoding, p in candidates(text, base) if p > floor and min(BINS - 1, int(p * BINS)) >= accepted.get((encoding, stratum(e - s)), BINS)]
        return [(s, e) for s, e, _ in base] + added

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = {k: _masked(t, spans, mark) for k, t in enumerate(texts) if t and (spans := spans_in(t))}
            columns = list(batch.columns)
            if new:
                columns[at] = pa.array([new.get(k, t) for k, t in enumerate(texts)], columns[at].type)
            if new and counted is not None:
                columns[counted] = pa.array([len(new[k]) if k in new else n for k, n in enumerate(columns[counted].to_pylist())], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
