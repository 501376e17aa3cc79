"""Source divergence audit: how far each source's terms lie from other sources of its language and from the language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Spans, buffer_of, lowered, materialise, runs_of, slices, text_of

#: Bytes of terms: ASCII letters, and all bytes of code points above ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

ONE = 1_000_000_000
#: Bytes of texts that are counted at a time; a slice's arrays take some 20 times as much.
MOST_BYTES = 4 << 20


# ---------------------------------------------------------------- counts


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _term_counts(most_bytes: int):
    """``lang, source, term, n, docs`` of each slice of a batch: occurrences, and rows that hold the term."""

    def of(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
        data, offsets = buffer_of(text)
        low = lowered(data)
        starts, ends, bounds = runs_of(_TERM[low], offsets)
        spans = Spans(low)
        _, first, term = np.unique(spans.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(odd := np.flatnonzero(~spans.equal(starts, ends, starts[first][term], ends[first][term]))):
            # equal hashes of other bytes; such spans stand alone until Spark adds up equal terms
            term[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        by_row = np.sort(row * len(first) + term)
        new = np.ones(len(by_row), bool)
        new[1:] = by_row[1:] != by_row[:-1]
        at = np.flatnonzero(new)
        n, held, which = np.diff(np.append(at, len(by_row))), by_row[at] % max(len(first), 1), by_row[at] // max(len(first), 1)
        pairs, place = np.unique(group[which] * len(first) + held, return_inverse=True)
        held, group = pairs % max(len(first), 1), pairs // max(len(first), 1)
        raw = low.tobytes()
        names = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string(), safe=False)
        counts = [np.bincount(place, n, len(pairs)).astype(np.int64), np.bincount(place, minlength=len(pairs))]
        return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(group // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(group % max(len(source.dictionary), 1))), names.take(pa.array(held)), *(pa.array(c, pa.int64()) for c in counts)], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        for batch in batches:
            lang, source, text = (batch.column(i) for i in range(3))
            _, offsets = buffer_of(text)
            for i, j in slices(offsets, most_bytes):
                yield of(lang[i:j], source[i:j], text[i:j])

    return run


def kept_terms(docs: DataFrame, *, least_docs: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``lang, source, term, n, lang_n, head`` for terms that at least ``least_docs`` documents of a language hold.

    ``n`` and ``lang_n`` are occurrences in the source and in the language; ``head`` is 1 on one row
    of each language and term. Counts are added up in each slice of texts before they are shuffled,
    so a term of every document is one row a slice and source. A term's rows are at most its
    language's sources.
    """
    rows = docs.select(_name("lang").alias("lang"), _name("source").alias("source"), text_of().alias("text"))
    counts = rows.mapInArrow(_term_counts(most_bytes), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = counts.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term)).withColumn("head", (F.min("source").over(term) == F.col("source")).cast("int"))
    return found.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "head")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, total, terms, lang_total``: every group of ``docs``, with its sums over kept terms (N), its language's terms (V) and its language's sums."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    found = docs.select(_name("lang").alias("lang"), _name("source").alias("source")).distinct().join(sums, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select("lang", "source", none(F.col("total")).alias("total"), none(F.sum("heads").over(lang)).alias("terms"), none(F.sum("total").over(lang)).alias("lang_total"))


# ---------------------------------------------------------------- exact shares


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 2) / (total + 2 * terms))``, by long division in base 1000, as the plain product may pass 64 bits."""
    whole, out, left = total + 2 * terms, F.lit(1).cast("long"), count + 2
    for step in (1_000_000, 1_000, 1):
        out, left = out + step * F.call_function("div", left * 1000, whole), (left * 1000) % whole
    return out


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    out, left = np.ones(np.broadcast(count, whole).shape, np.int64), count + 2
    for step in (1_000_000, 1_000, 1):
        digit, left = np.divmod(left * 1000, whole)
        out += step * digit
    return out


# ---------------------------------------------------------------- between sources


def _pair_sums(most: int):
    """Sums of gaps over the terms of one shard, for each two sources of a language."""

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        lang = groups.column("lang")[0].as_py()
        groups = groups.sort_by("source")
        sources, s = groups.column("source").combine_chunks(), groups.num_rows
        whole = groups.column("total").to_numpy() + 2 * groups.column("terms").to_numpy()
        sums = np.zeros((s, s), np.int64)
        if terms.num_rows:
            held = terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.argsort(held, kind="stable")
            held, n = held[order], terms.column("n").to_numpy()[order]
            place = pc.index_in(terms.column("source").combine_chunks(), sources).to_numpy()[order]
            last = int(held[-1]) + 1
            step = max(1, most // s)
            for a in range(0, last, step):
                b = min(a + step, last)
                i, j = np.searchsorted(held, (a, b))
                count = np.zeros((s, b - a), np.int64)
                count[place[i:j], held[i:j] - a] = n[i:j]
                p = _shares(count, whole[:, None])
                for k in range(s - 1):
                    d = p[k + 1 :] - p[k]
                    sums[k, k + 1 :] += (d * d // (p[k + 1 :] + p[k])).sum(axis=1)
        one, other = np.triu_indices(s, 1)
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": sources.take(pa.array(one)), "item": sources.take(pa.array(other)), "value": sums[one, other]})

    return run


def pair_gaps(kept: DataFrame, groups: DataFrame, *, shard_rows: int = 200_000, most: int = 1 << 21) -> DataFrame:
    """``lang, source, item, value``: for each group and other source of its language, the sum of gaps over all kept terms.

    Terms are dealt to shards by hash; each shard meets its language's groups (not its documents)
    and sums the gaps of its terms, absent ones included, in blocks of ``most`` counts. So no term
    gives a row for each two sources: the rows made are those of the result, once a shard.
    """
    shards = max(1, -(-kept.count() // shard_rows))
    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"))
    spread = groups.select("lang", "source", "total", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    sums = dealt.groupBy("lang", "shard").cogroup(spread.groupBy("lang", "shard")).applyInArrow(_pair_sums(most), "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("both"), "value").select("lang", "both.source", "both.item", "value")


# ---------------------------------------------------------------- skybands


def skyband(n: np.ndarray, lang_n: np.ndarray, name: np.ndarray, k: int, block: int = 2048) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate: group count as high or higher, language count as low or lower, name as early or earlier.

    In this order every dominator comes before what it dominates, and a term with k dominators has
    k of them in the skyband; so each block is held against the skyband so far and itself only.
    """
    order = np.lexsort((name, lang_n, -n))
    band = order[:0]
    for i in range(0, len(order), block):
        part = order[i : i + block]
        above = ((lang_n[band] <= lang_n[part][:, None]) & (name[band] <= name[part][:, None])).sum(axis=1)
        part, above = part[above < k], above[above < k]
        within = (lang_n[part] <= lang_n[part][:, None]) & (name[part] <= name[part][:, None])
        above = above + np.tril(within, -1).sum(axis=1)
        band = np.concatenate([band, part[above < k]])
    return band


def _bands(table: pa.Table, k: int) -> pa.Table:
    """The skyband of each group in a table of ``lang, source, term, n, lang_n``."""
    if not table.num_rows:
        return table
    table = table.combine_chunks()
    by_name = pc.sort_indices(table.column("term")).to_numpy()
    name = np.empty(len(by_name), np.int64)
    name[by_name] = np.arange(len(by_name))
    codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
    group = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
    n, lang_n = (table.column(c).to_numpy() for c in ("n", "lang_n"))
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    bands = [part[skyband(n[part], lang_n[part], name[part], k)] for part in np.split(order, cuts)]
    return table.take(pa.array(np.concatenate(bands)))


def _partition_bands(k: int, most_rows: int = 1 << 17):
    def run(batches):
        held, rows, schema = [], 0, None
        for batch in batches:
            schema = batch.schema
            held.append(batch)
            rows += batch.num_rows
            if rows >= most_rows:
                held = _bands(pa.Table.from_batches(held), k).to_batches()
                rows = 0
        if held:
            yield from _bands(pa.Table.from_batches(held, schema), k).to_batches()

    return run


def term_gaps(kept: DataFrame, groups: DataFrame, *, k: int = 10, lots: int = 64) -> DataFrame:
    """``lang, source, item, value, rank``: the ``k`` terms of each group with the largest gap above their language.

    The gap grows with the group's count and falls with the language's; so a term that ``k`` others
    dominate, earlier names among ties, is never among the first ``k``. Partitions keep their
    skybands, these meet in ``lots`` parts a group, and what is left is ranked by exact values.
    """
    columns = "lang string, source string, term string, n long, lang_n long"
    bands = kept.select("lang", "source", "term", "n", "lang_n").mapInArrow(_partition_bands(k), columns)
    merged = bands.groupBy("lang", "source", F.pmod(F.xxhash64("term"), F.lit(lots))).applyInArrow(lambda t: _bands(t, k), columns)
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    valued = merged.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= k)


def audit(docs: DataFrame, *, least_docs: int = 10, k: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of a language and a source in ``docs``.

    Terms are runs of letters and of code points above ASCII, only A-Z lower-cased; a language
    keeps those in at least ``least_docs`` of its documents. A term's share in a group or language
    is ``share`` of its count, and two shares p and q lie ``(p-q)^2/(p+q)`` apart, rounded down.
    Part ``pair`` has the sum over all kept terms for each other source of the language, part
    ``term`` the ``k`` terms that stand out most above the language. All numbers are exact.

    Null texts, languages and sources are the empty string; a group without a kept term has pairs
    (0 if its language keeps none) and no terms. Repeated rows and ids are documents each. Very
    long texts are a slice of their own. Ties are in UTF-8 order of the item. Further columns are
    ignored; an empty table gives no rows.
    """
    kept = materialise(kept_terms(docs, least_docs=least_docs), "kept-terms")
    groups = materialise(groups_of(docs, kept), "term-groups")
    pairs = pair_gaps(kept, groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked, "pair").unionByName(columns(term_gaps(kept, groups, k=k), "term"))


SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
held AS (
  SELECT k, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts),
in_docs AS (SELECT k, lang, source, term, count(*) AS n FROM held GROUP BY k, lang, source, term),
lang_terms AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM in_docs GROUP BY lang, term HAVING count(*) >= 10),
counts AS (
  SELECT d.lang, d.source, d.term, CAST(sum(d.n) AS HUGEINT) AS n
  FROM in_docs d JOIN lang_terms t ON d.lang = t.lang AND d.term = t.term GROUP BY d.lang, d.source, d.term),
vocabulary AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM lang_terms GROUP BY lang),
sums AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT g.lang, g.source, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) AS p,
         1 + (1000000000 * (t.n + 2)) // (v.total + 2 * v.v) AS q
  FROM groups g JOIN vocabulary v ON g.lang = v.lang JOIN lang_terms t ON g.lang = t.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
