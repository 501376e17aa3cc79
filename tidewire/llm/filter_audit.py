"""Filter interaction audit: five filters as a removal game, solved by its Hart-Mas-Colell potential. SQL functions only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
ALL = 2 ** len(FILTERS) - 1
#: Potentials are kept times this, so that all 32 of them are whole numbers.
SCALE = len(ORDERS)


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A (1), B (2), C (4) and D (8)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = F.size(words) < 50
    repeated = 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    loud = 100 * capitals.cast("long") > 5 * F.length(text).cast("long")
    marked = F.length(F.translate(text, "#$%&*|", "")) < F.length(text)
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate((few, repeated, loud, marked))), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """``part, failed, good, toxic, n``: documents by their set of failed filters (bits A to E) and labels.

    A document fails E if a smaller id has the same text, wherever that row is. Texts are told
    apart by SHA-256, and no text is shuffled: the smallest id of a text is a partial minimum, and
    the rows that do not fail E are those that meet it on (text, id). That pair is no hot key,
    however many copies a text has, as equal rows are counted before.
    """
    text = text_of()
    part = F.coalesce(F.col(part).cast("string"), F.lit("")) if part in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text_failures(text).alias("failed"), F.unhex(F.sha2(text, 256)).alias("content")).groupBy("doc_id", "part", "failed", "content").agg(F.count("*").alias("n"))
    first = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = rows.join(first, ["content", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    sets = F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return joined.groupBy("part", sets.alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def coalition_values(failed: DataFrame) -> DataFrame:
    """One row per part: ``n`` documents, and per game an array of 32: documents that a set of filters removes.

    The games ``removed``, ``good`` and ``toxic`` count all documents, good ones and toxic ones.
    """

    def game(among: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(among & (F.col("failed").bitwiseAND(s) != 0), F.col("n"))), F.lit(0)) for s in range(ALL + 1)])

    return failed.groupBy("part").agg(F.sum("n").alias("n"), game(F.lit(True)).alias("removed"), game(F.col("good")).alias("good"), game(F.col("toxic")).alias("toxic"))


def potentials(values: Column) -> Column:
    """The 32 potentials of a game, times ``SCALE``: P(S) = (v(S) + sum of P(S without one)) / |S|, and P of the empty set is 0.

    Sets are numbers by their bits, so that those a set contains come before it.
    """

    def of(known: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(1 << k) != 0, F.get(known, s.bitwiseAND(ALL - (1 << k)))).otherwise(F.lit(0).cast("long")) for k in range(len(FILTERS))]
        total = SCALE * F.get(values, s) + sum(without[1:], without[0])
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), of)


def audit(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """What each of five filters does at each step of all 120 orders, for each part of ``docs``.

    The filters fail a text with A: under 50 words; B: under 65 % distinct words; C: over 5 %
    capital letters A-Z; D: one of ``#$%&*|``; E: the text of a smaller id. For each part, v(S) is
    how many documents the filters S remove. A step's ``removed`` is v with its filter less v
    without, after the filters before it; the same differences of the games of good and of toxic
    documents give ``good_lost`` and ``toxic_lost``. ``shapley`` is 120 times the grand potential
    less the potential without the filter: its removals summed over all orders.

    Returns ``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``: 600 rows a part, zeros included. A null text is empty, which fails A
    alone; a null part is that of the empty string. Repeated rows count each; the same id fails E
    by no row of its own id, and a row without an id never fails E but counts. A document is good
    or toxic if any label row of its id says so; null labels say nothing. Very long texts go whole
    through the functions. Further columns are ignored; an empty table gives no rows.
    """
    games = coalition_values(failures(docs, labels, part=part)).withColumn("potential", potentials(F.col("removed")))
    steps = games.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("place")), F.lit(0), lambda s, x: s + bit(x))
    steps = steps.withColumn("own", bit(F.col("filter"))).withColumn("before", before)
    after, others = F.col("before") + F.col("own"), ALL - F.col("own")
    gain = lambda game, s: F.get(game, s + F.col("own")) - F.get(game, s)
    removed = gain("removed", F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        (F.col("place") + 1).alias("step"),
        "filter",
        (F.col("n") - F.get("removed", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("removed", F.col("own")) - removed).alias("redundant"),
        gain("removed", others).alias("unique_fails"),
        gain("good", F.col("before")).alias("good_lost"),
        gain("toxic", F.col("before")).alias("toxic_lost"),
        (F.get("potential", F.lit(ALL)) - F.get("potential", others)).alias("shapley"),
    )


#: Each order is applied step by step to the documents, by sets of failed filters.
SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
fails AS (
  SELECT t.part,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS failed,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE list_unique([a.x, b.x, c.x, d.x, e.x]) = 5),
steps AS (
  SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS filter, substr(filter_order, 1, s.step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
applied AS (
  SELECT part, filter_order, step, filter, n, good, toxic, failed,
         contains(failed, filter) AS fails_this,
         earlier <> '' AND regexp_matches(failed, '[' || CASE WHEN earlier = '' THEN '0' ELSE earlier END || ']') AS gone
  FROM sets, steps),
counted AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT gone AND NOT fails_this THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fails_this THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails_this THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails_this THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fails_this THEN toxic ELSE 0 END) AS toxic_lost
  FROM applied GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
