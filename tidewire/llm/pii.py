"""Personal data: fixed patterns, and identifiers found by bootstrapping their contexts. SQL functions only."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .line_rules import bind

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Runs are possessive and begin where a run begins (or where the last match
# ended), which changes no match and keeps long runs linear. A card's run of digits is maximal,
# so its length is part of the pattern.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "phone": "+", "ip": ".", "card": None}

#: Something like an identifier: up to four letters, then digits and letters, single separators.
CANDIDATE = r"(?<![A-Za-z0-9@._-])(?:[A-Za-z]{1,4}[-./]?)?[0-9](?:[-./]?[A-Za-z0-9]){4,}+(?![A-Za-z0-9@])"

#: A span with its text and up to ``REACH`` characters on either side, in lower case.
_ITEM = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"
_SPAN = f"array<{_ITEM}>"
REACH, RUN = 48, 256


def walk(items: Column, zero: Column, emit, after, kind: str) -> Column:
    """``emit(state, item)`` of each item, where the state goes from item to item by ``after``.

    Appending to an array copies it, so results are gathered in runs of ``RUN`` and the runs are
    joined at the end: time stays close to linear in the number of items.
    """

    def run(part: Column, state: Column) -> Column:
        step = lambda s, x: F.struct(F.concat(s["out"], F.array(emit(s["at"], x))).alias("out"), after(s["at"], x).alias("at"))
        return F.aggregate(part, F.struct(F.array().cast(f"array<{kind}>").alias("out"), state.alias("at")), step)

    def join(state: Column, first: Column) -> Column:
        return bind(run(F.slice(items, first, RUN), state["at"]), lambda v: F.struct(F.concat(state["out"], F.array(v["out"])).alias("out"), v["at"].alias("at")))

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("out"), zero.alias("at"))
    return F.when(F.size(items) == 0, F.array().cast(f"array<{kind}>")).otherwise(F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(RUN)), start, join, lambda s: s["out"])))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places, in code points, and their surroundings.

    What lies between the matches gives both; a text is never looked into by position, which would
    cost its length each time. Surroundings end at the second match before or after.
    """
    none = F.lit("")
    side = lambda values, i: F.coalesce(F.get(values, i), none)

    def place(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            def emit(at: Column, i: Column) -> Column:
                value, start = F.get(found, i), at + F.length(F.get(gaps, i))
                left = F.right(F.concat(F.right(side(gaps, i - 1), F.lit(REACH)), side(found, i - 1), F.get(gaps, i)), F.lit(REACH))
                right = F.left(F.concat(side(gaps, i + 1), side(found, i + 1), F.left(side(gaps, i + 2), F.lit(REACH))), F.lit(REACH))
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lower(left).alias("left"), F.lower(right).alias("right"))

            return walk(F.sequence(F.lit(0), F.size(found) - 1), F.lit(0), emit, lambda at, i: at + F.length(F.get(gaps, i)) + F.length(F.get(found, i)), _ITEM)

        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(bind(F.split(text, pattern, -1), spans))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def apart(spans: Column, taken: Column) -> Column:
    """The ``spans`` (disjoint) that touch none of ``taken``: one pass over both, in order of their starts."""
    tag = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span"))
    both = F.array_sort(F.concat(F.transform(taken, tag(False)), F.transform(spans, tag(True))), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["own"] == b["own"], 0).when(a["own"], 1).otherwise(-1))

    def free(sorted_: Column) -> Column:
        # what begins next among the taken lies right behind: other spans end before
        ahead = lambda i: F.coalesce(~F.get(sorted_, i + 1)["own"] & (F.get(sorted_, i + 1)["start"] < F.get(sorted_, i)["end"]), F.lit(False))
        emit = lambda at, i: bind(F.get(sorted_, i), lambda x: F.when(x["own"] & (at <= x["start"]) & ~ahead(i), x["span"]))
        after = lambda at, i: bind(F.get(sorted_, i), lambda x: F.when(x["own"], at).otherwise(F.greatest(at, x["end"])))
        return F.array_compact(walk(F.sequence(F.lit(0), F.size(sorted_) - 1), F.lit(0), emit, after, _ITEM))

    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(bind(both, free))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: bind(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda s: valid(kind, s["value"])


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for kind, pattern in PATTERNS.items():
        found = F.filter(matches(text, pattern, kind), _valid(kind))
        hint = _HINT[kind]
        out[kind] = F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast(_SPAN)) if hint else found
    return out


def _contexts(spans: Column) -> Column:
    """Spans with their lexical patterns: the two words before and the one after, and a cue.

    A cue is a word before that ends with a sign such as ``:``, which may stand by itself.
    """

    def one(s: Column) -> Column:
        left, right = s["left"], s["right"]
        two = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 0)
        after = F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
        cue = F.regexp_extract(left, r"([^\x20\x09-\x0D]*[^\x20\x09-\x0D0-9][:=#])[\x20\x09-\x0D]*$", 1)
        around = F.when((two != "") & (after != ""), F.concat(F.regexp_replace(F.trim(two), r"[\x20\x09-\x0D]+", " "), F.lit(" _ "), after))
        patterns = F.array_compact(F.array(around, F.when(cue != "", F.concat(cue, F.lit(" _")))))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("instance"), F.transform(patterns, lambda p: F.xxhash64(p)).alias("patterns"))

    return F.transform(spans, one)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans by kind, and candidates that touch none of them."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = text.select("row", "doc_id", "text", F.concat(*base_spans(F.col("text")).values()).alias("base"), F.when(F.col("text").rlike("[0-9]"), matches(F.col("text"), CANDIDATE, "context")).otherwise(F.array().cast(_SPAN)).alias("others"))
    found = found.withColumn("others", apart(F.filter("others", lambda c: F.length(digits(c["value"])) >= 5), F.col("base")))
    return found.select("row", "doc_id", _contexts(F.col("base")).alias("base"), _contexts(F.col("others")).alias("others"))


def trusted(scanned: DataFrame, *, rounds: int = 3, least: float = 0.75, seeds: int = 3) -> DataFrame:
    """Patterns (hashes) in which nearly all instances are identifiers.

    Patterns and instances (distinct values) form a graph. Seeds, the base matches, have score 1.
    Each round a pattern scores the mean of its instances, shrunk by one doubtful one, and an
    unseen instance the best of its patterns, if that one has ``seeds`` distinct seeds; instances
    that score ``least`` or more are seeds of later rounds. After ``rounds``, further ones follow
    until the patterns and their trusts, to a thousandth, stay as they are; trusts only grow.
    Instances and patterns are distinct before they meet, so copies of a document count once.
    """
    spans = scanned.select(F.explode(F.concat(F.transform("base", lambda s: s.withField("seed", F.lit(1.0))), F.transform("others", lambda s: s.withField("seed", F.lit(0.0))))).alias("s"))
    edges = materialise(spans.select(F.col("s.instance").alias("instance"), F.col("s.seed").alias("seed"), F.explode("s.patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "pii-graph")
    scores = before = None
    for done in itertools.count(1):
        known = edges if scores is None else edges.join(scores, "instance", "left")
        value = F.col("seed") if scores is None else F.greatest("seed", F.coalesce("score", F.lit(0.0)))
        patterns = known.groupBy("pattern").agg((F.sum(value) / (F.count("*") + 1)).alias("trust"), F.sum((value >= least).cast("int")).alias("n_seeds"))
        patterns = materialise(patterns.where(F.col("n_seeds") >= seeds), "pii-patterns")
        after = tuple(patterns.agg(F.count("*"), F.count_if(F.col("trust") >= least), F.bit_xor(F.xxhash64("pattern", F.round("trust", 3)))).first())
        if done >= rounds and after == before:
            break
        before = after
        scores = materialise(edges.where("seed = 0").join(patterns, "pattern").groupBy("instance").agg(F.max("trust").alias("score")), "pii-instances")
    return patterns.where(F.col("trust") >= least).select("pattern")


def find(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, base, spans``: valid matches of the fixed patterns, and all with the method's.

    Candidates (kind ``context``) join if one of their patterns is trusted; they never touch a
    base span. Offsets are code points, ends exclusive.

    Null or empty text: no spans. Repeated and null ids keep a row each; further columns are
    ignored; an empty table gives no rows. Spans of two kinds at one place are both kept. A long
    text takes time in proportion to its length and the number of its matches.
    """
    scanned = materialise(scan(docs), "pii-scan")
    fields = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    rows = scanned.select("row", F.explode("others").alias("s")).select("row", fields(F.col("s")).alias("span"), F.explode("s.patterns").alias("pattern"))
    added = rows.join(trusted(scanned, **options), "pattern").groupBy("row").agg(F.collect_set("span").alias("added"))
    base = F.transform("base", fields)
    return scanned.join(added, "row", "left").select("doc_id", base.alias("base"), F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def ordered(spans: Column) -> Column:
    """``kind:start:end``, by kind as listed (context last), then start, comma-joined."""
    rank = lambda s: reduce(lambda c, k: c.when(s["kind"] == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1)).otherwise(len(KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(ordered(F.col("base")).cast("binary"), 256).alias("base_sha256"), ordered(F.col("spans")).alias("spans"))
