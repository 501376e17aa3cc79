"""The filter audit, the source audit and nearest neighbours against brute force, on small tables with every awkward case."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidewire.llm import filter_audit, neighbours, source_audit

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(120)] + ["漢字", "CAPS", "İx", "x#y", "a&b"]


def some_texts(n: int = 260) -> list[tuple]:
    rows = []
    for k in range(n):
        words = [rng.choice(WORDS if rng.random() < 0.7 else WORDS[:9]) for _ in range(rng.choice([0, 3, 49, 50, 51, 90]))]
        text = rng.choice([" ", "\n", "\t "]).join(words)
        rows.append((k, text.upper() if rng.random() < 0.1 else text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "ü", None, ""])))
    rows += [(n + k, rows[7][1], "en", "hot") for k in range(80)] + [(3, rows[7][1], "en", "a"), (3, rows[7][1], "en", "a"), (None, rows[7][1], "de", "b"), (None, None, None, None)]
    rows += [(500, None, "en", "a"), (501, "", "en", "b"), (502, "one two " * 20_000, "en", "long"), (503, "A" * 6 + "b" * 94, "xx", "lone"), (504, "#", "xx", "lone"), (505, "z", "xx", "other")]
    rng.shuffle(rows)
    return rows


ROWS = some_texts()
LABELS = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
DOCS = "doc_id long, text string, lang string, source string, failed int, n long, part string, content string, good int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in ROWS], DOCS).repartition(5).cache()


# ---------------------------------------------------------------- filters


def plain_filter_audit() -> dict:
    least = {}
    for i, t, _, _ in ROWS:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, _, s in ROWS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[s or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, held in parts.items():
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                alive = [d for d in held if not d[0] & set(order[:step])]
                gone = [d for d in alive if f in d[0]]
                removed_by[f] += len(gone)
                out[part, order, step + 1] = [f, len(alive) - len(gone), len(gone), sum(f in d[0] for d in held) - len(gone), sum(d[0] == {f} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(removed_by[row[0]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == plain_filter_audit()
    assert len(got) == 600 * len({r[3] or "" for r in ROWS})


def test_filter_audit_of_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit(docs.where("doc_id = 504"), labels).where("filter_order = 'EDCBA'").orderBy("step").collect()
    assert [(r["filter"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in rows] == [("E", 0, 0, 0, 0, 0), ("D", 1, 0, 0, 0, 60), ("C", 0, 0, 0, 0, 0), ("B", 0, 0, 0, 0, 0), ("A", 0, 1, 0, 0, 60)]


def test_potentials_are_whole_and_efficient(spark):
    values = [0] + [rng.randint(0, 10**9) for _ in range(31)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(filter_audit.potentials(df["v"]).alias("p")).first()["p"]
    plain = [0] * 32
    for s in range(1, 32):
        total = 120 * values[s] + sum(plain[s & ~(1 << k)] for k in range(5) if s >> k & 1)
        assert total % bin(s).count("1") == 0
        plain[s] = total // bin(s).count("1")
    assert got == plain
    assert sum(got[31] - got[31 & ~(1 << k)] for k in range(5)) == 120 * values[31]


# ---------------------------------------------------------------- sources


def plain_source_audit(least_docs: int) -> set:
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in ROWS:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in term.findall(t or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, n in in_docs[lang].items() if n >= least_docs]
        v = len(kept)
        totals = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda n, total: 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)
        gap = lambda p, q: (p - q) * (p - q) // (p + q)
        ps = {s: {w: share(counts[lang, s][w], totals[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(totals.values())) for w in kept}
        for s in sources:
            pairs = sorted(((-sum(gap(ps[s][w], ps[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-gap(ps[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and ps[s][w] > q[w])[:10]
            out |= {(lang, s, part, o, -x, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (x, _, o) in enumerate(found)}
    return out


@pytest.mark.parametrize("least_docs", [10, 2])
def test_source_audit_against_brute_force(docs, least_docs):
    got = [tuple(r) for r in source_audit.audit(docs, least_docs=least_docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_source_audit(least_docs)
    assert any(r[2] == "pair" and r[4] == 0 for r in got) or least_docs == 2


def test_terms_are_counted_in_little_memory():
    """Texts of a full Arrow batch, of many terms: what a task holds beside them does not grow with the batch."""
    draw = np.random.default_rng(5)
    words = np.array([f"w{''.join(chr(97 + int(c)) for c in str(k))}" for k in range(50_000)])
    texts = pa.array([" ".join(words[draw.integers(0, len(words), 600)]) for _ in range(4_000)])
    same = pa.array(["x"] * len(texts))
    batch = pa.RecordBatch.from_arrays([same, same, texts], ["lang", "source", "text"])
    assert texts.nbytes > 14 << 20
    tracemalloc.start()
    try:
        found = sum(pc.sum(b.column("n")).as_py() for b in source_audit._term_counts(source_audit.MOST_BYTES)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 600 * len(texts) and most < 160 << 20



def test_source_audit_of_empty_table(docs):
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_pairs_in_many_small_shards(docs):
    kept = source_audit.kept_terms(docs, least_docs=2, most_bytes=500).cache()
    groups = source_audit.groups_of(docs, kept).cache()
    want = {tuple(r) for r in source_audit.pair_gaps(kept, groups).collect()}
    assert want == {tuple(r) for r in source_audit.pair_gaps(kept, groups, shard_rows=40, most=16).collect()}


def test_shares_are_exact_beyond_64_bits(spark):
    count, total, terms = 10**13 + 7, 3 * 10**14 + 1, 12_345_678
    df = spark.createDataFrame([(count, total, terms)], "n long, total long, terms long")
    want = 1 + 10**9 * (count + 2) // (total + 2 * terms)
    assert df.select(source_audit.share(df["n"], df["total"], df["terms"])).first()[0] == want
    assert source_audit._shares(np.array([count]), np.array([total + 2 * terms]))[0] == want


def test_skybands_of_parts_hold_the_first_terms():
    r = np.random.default_rng(3)
    n, lang_n, name = r.integers(1, 30, 5000), r.integers(1, 60, 5000), r.permutation(5000)
    plain = [i for i in range(5000) if ((n >= n[i]) & (lang_n <= lang_n[i]) & (name <= name[i])).sum() - 1 < 10]
    assert sorted(source_audit.skyband(n, lang_n, name, 10, block=64)) == plain
    parts = [np.arange(k, 5000, 7) for k in range(7)]
    merged = np.concatenate([p[source_audit.skyband(n[p], lang_n[p], name[p], 10)] for p in parts])
    assert sorted(merged[source_audit.skyband(n[merged], lang_n[merged], name[merged], 10)]) == plain


# ---------------------------------------------------------------- neighbours


def plain_nearest(rows: list[tuple], k: int) -> dict:
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    found = {}
    for q, u in fine:
        if q % 20 == 0:
            best = found.setdefault(q, {})
            for i, v in fine:
                if i != q and len(v) == len(u):
                    score = 0.0
                    for a, b in zip(u, v):
                        score += a * b
                    best[i] = max(score, best.get(i, -np.inf))
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in found.items()}


def vectors_with_every_case() -> list[tuple]:
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 16)) * np.exp(r.standard_normal((400, 1)))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[40][1]) for i in range(300)]  # one vector many times, queries among them
    rows += [(40, rows[40][1]), (41, rows[3][1]), (60, rows[5][1])]  # repeated rows and ids
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [None] + [1.0] * 15), (2060, [float("nan")] * 16), (2080, [float("inf")] + [0.0] * 15), (None, rows[1][1]), (2100, [])]
    rows += [(3000 + i, r.standard_normal(3).astype(np.float32).tolist()) for i in range(0, 40, 4)]  # fewer than k of this length
    return rows


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "lot_rows": 5, "leaf": 8, "sample": 200}])
def test_neighbours_against_brute_force(spark, sizes):
    rows = vectors_with_every_case()
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cell int, ids string").repartition(3)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), chance=0.999, **sizes).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = plain_nearest(rows, 20)
    assert got.keys() == {q for q, v in want.items() if v}
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(want[q]) for q in want)
    assert all(pair in set(plain_nearest(rows, 10**6)[q]) for q in (0, 40, 1000, 3000) for pair in got[q])  # scores are exact


def test_neighbours_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, df.limit(0)).count() == 0
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_the_stopping_test_ends_searches():
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 32)) * 4
    x = np.repeat(centres, 100, axis=0) + 0.3 * r.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = neighbours.Shard(np.arange(4000), np.arange(4000), x, 10)
    limit = neighbours.chi_square_quantile(0.97, 8)
    q, own = x[::200], np.arange(0, 4000, 200)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                seen.append(len(at))
            return super().__getitem__(at)

    shard.x = shard.x.view(Counted)
    query, ids, _ = shard.search(own, q, np.full(len(q), np.inf), 1.0, 8, limit, 64, block=1)
    shard.x = np.asarray(shard.x)
    scores = q @ x.T
    scores[np.arange(len(q)), own] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(set(ids[query == k]) & set(want[k])) / 10 for k in range(len(q))]) >= 0.95
    assert sum(seen) < 0.5 * len(q) * len(x)


@pytest.mark.parametrize("dims, chance, value", [(8, 0.95, 15.507), (1, 0.5, 0.4549), (7, 0.99, 18.475), (16, 0.9, 23.542)])
def test_chi_square_quantiles(dims, chance, value):
    assert neighbours.chi_square_quantile(chance, dims) == pytest.approx(value, rel=1e-3)


# ---------------------------------------------------------------- near copies


def test_occupancy_maps_lose_no_similar_pair():
    from tidewire.llm.near_copies import MAP_BITS, may_be_similar, occupancy

    r = np.random.default_rng(9)
    sets = []
    for n in (0, 1, 5, 40, 150, 600, 5000):
        base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for change in (0, 0.05, 0.1, 0.12, 0.3, 0.6):
            keep = base[r.random(len(base)) >= change]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, int(change * n * r.random())).astype(np.uint64)])))
    maps = np.stack([np.frombuffer(occupancy(s), "<u8") for s in sets])
    assert maps.shape[1] == MAP_BITS // 64
    size = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    jaccard = np.array([len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j]))) for i, j in zip(a, b)])
    may = may_be_similar(a, b, maps, size, 0.8, step=50)
    assert may[jaccard >= 0.8].all() and (jaccard >= 0.8).sum() > 20
    small = np.maximum(size[a], size[b]) < 700
    assert may[small & (jaccard < 0.6) & (jaccard > 0)].mean() < 0.05


# ---------------------------------------------------------------- queries

KINDS = {
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.mark.parametrize("name", KINDS)
def test_queries_over_whole_tables(spark, name):
    """Columns of the contracts; rows as the SQL gives them, or all queries with all ranks."""
    import duckdb

    from tidewire.llm import queries

    sf = "/root/testdata/sf0.001"
    df = queries.queries()[name](spark, sf)
    assert {c: k for c, k in (x.split(" ") for x in KINDS[name].split(", "))}.items() <= dict(df.dtypes).items()
    rows = [tuple(r) for r in df.collect()]
    if name in queries.oracle_sql():
        db = duckdb.connect()
        for table in ("documents", "labels"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        columns = ", ".join(df.columns)
        want = db.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert len(rows) == len(want) and set(rows) == set(want)
    else:
        ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 20 == 0}
        assert sorted((r[0], r[1]) for r in rows) == [(i, k) for i in sorted(ids) for k in range(1, 21)]
