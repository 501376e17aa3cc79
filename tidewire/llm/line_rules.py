"""Quality rules: text counts, and lines that too many documents of a host share. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def bare(text: Column) -> Column:
    return F.translate(text, _WHITE, "")


def windows(words: Column) -> Column:
    """Hashes of each three neighbouring words."""

    def of(h: Column) -> Column:
        return F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), of)


def covered(places: Column) -> Column:
    """How many words the three-word windows at these ascending places cover."""
    step = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), x - 3))), F.lit(0), lambda a, b: a + b.cast("int"))
    return bind(places, step)


def repeated_words(grams: Column, few: int = 64) -> Column:
    """Words in windows that occur twice or more in the text.

    Texts without a repeated window end here. Where few distinct windows repeat, each place is
    looked up among them; else windows are sorted with their places, and equal neighbours kept.
    """

    def by_sorting(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(bind(ranked, twins), lambda x: x["i"]))

    def by_lookup(g: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(twice, F.get(g, i)))

    def twice_in(g: Column) -> Column:
        return F.array_distinct(bind(F.sort_array(g), lambda s: F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))))

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bind(twice_in(g), lambda t: F.when(F.size(t) <= few, covered(by_lookup(g, t))).otherwise(covered(by_sorting(g)))))

    return bind(grams, count).cast("long")


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def counts(docs: DataFrame, host: str = "source", row: Column | None = None) -> DataFrame:
    """One row per document: its counts, and its distinct normalised lines with their words."""
    text = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long"), (F.coalesce(F.col(host).cast("string"), F.lit("")) if host in docs.columns else F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    lines = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: bare(x) != ""))
    kept = lines.select(
        "row",
        "doc_id",
        "host",
        F.xxhash64("text").alias("content"),
        F.size("words").cast("long").alias("n_words"),
        F.length(bare(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(windows(F.col("words"))).alias("n_repeat_words"),
        F.transform("lines", lambda x: bind(normal(x), lambda n: F.struct(F.xxhash64(n).alias("line"), (F.length(n) - F.length(F.translate(n, " ", "")) + 1).alias("words")))).alias("lines"),
    )
    return kept


def judge(docs: DataFrame, *, host: str = "source", most_docs: int = 20, depleted: float = 0.5, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``n_removed_words`` and ``kept`` of every document.

    Lines are normalised (ASCII white space, case) and hashed. For each host, the distinct
    documents that hold a line are counted; documents with the same text are one, as exact copies
    are no sign of boilerplate. A line in more than ``most_docs`` documents of the host is
    removed. A document is rejected if over ``depleted`` of its words go, or if it fails the base
    rules: fewer than ``least_words`` words, or over ``most_repeated`` of them in repeated windows.

    Counts of a line are partial before they are shuffled, so a line of every document is no hot
    spot; removal joins on host and line, which Spark's skew join may split. The lines of one text
    are distinct by their exact text, and a very long text has one list of them. Null or empty text
    has no words and fails. A null host is a host of its own. Repeated and null ids keep a row
    each; further columns are ignored; an empty table gives no rows.
    """
    judged, _ = _judged(counts(docs, host), most_docs, depleted, least_words, most_repeated)
    return judged.drop("row")


def _judged(counted: DataFrame, most_docs: int, depleted: float, least_words: int, most_repeated: float) -> tuple[DataFrame, DataFrame]:
    """The verdicts, by row, and the lines ``row, line`` (hashes) that are removed."""
    marks = materialise(counted, "line-counts")
    held = marks.select("row", "host", "content", F.explode("lines").alias("l")).select("row", "host", "content", "l.line", "l.words")
    shared = held.select("host", "line", "content").distinct().groupBy("host", "line").count().where(F.col("count") > most_docs).select("host", "line")
    gone = held.select("row", "host", "line", "words").join(shared, ["host", "line"])
    removed = gone.groupBy("row").agg(F.sum("words").cast("long").alias("n_removed_words"))
    base_failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = marks.drop("lines").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0))).withColumn("base_failed", base_failed)
    kept = (~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words"))).alias("kept")
    return judged.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "n_removed_words"), gone.select("row", "line")


def clean(docs: DataFrame, *, host: str = "source", most_docs: int = 20, depleted: float = 0.5, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with its removed lines gone from their texts; ``n_chars``, if there, follows.

    Only texts that lose lines are taken apart: their lines are rows, those removed are joined
    away, the others joined up again in order. Lines without a word stay. Every kept row keeps
    its own columns, also where ids or rows repeat; an empty table gives no rows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))), "line-rows")
    as_docs = rows.select("row", *(F.col(n).alias(c) for c, n in zip(docs.columns, names) if c in ("doc_id", "text", host)))
    judged, removed = _judged(counts(as_docs, host, F.col("row")), most_docs, depleted, least_words, most_repeated)
    kept, text = judged.where("kept").select("row"), names[docs.columns.index("text")]
    losing = removed.select("row").distinct()
    lines = rows.select("row", F.col(text).alias("text")).join(losing, "row", "left_semi").select("row", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    lines = lines.withColumn("line", F.when(bare(F.col("text")) != "", F.xxhash64(normal(F.col("text"))))).join(removed.distinct(), ["row", "line"], "left_anti")
    rebuilt = lines.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("s")).select("row", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("rebuilt"))
    changed = losing.withColumn("changed", F.lit(True))
    out = rows.join(kept, "row", "left_semi").join(changed, "row", "left").join(rebuilt, "row", "left").withColumn(text, F.when(F.col("changed"), F.coalesce("rebuilt", F.lit(""))).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.col("changed"), F.length(text)).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w || chr(10) || lead(w) OVER p || chr(10) || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, g FROM g WHERE g IS NOT NULL GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice ON g.r = twice.r AND g.g = twice.g) GROUP BY r),
nw AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r),
l AS (SELECT r, host, md5(t) AS content, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, host, content, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
shared AS (SELECT host, norm FROM lw GROUP BY host, norm HAVING count(DISTINCT content) > 20),
gone AS (SELECT r, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS n FROM lw JOIN shared USING (host, norm) GROUP BY r),
x AS (SELECT d.doc_id, coalesce(nw.n, 0)::BIGINT AS n_words, coalesce(nw.chars, 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
 coalesce(gone.n, 0)::BIGINT AS n_removed_words
 FROM d LEFT JOIN nw USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words) AS kept, n_removed_words
FROM x
"""
