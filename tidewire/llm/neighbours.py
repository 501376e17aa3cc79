"""Approximate nearest neighbours by inner product: stable projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialise

_SEED = 20_130
#: Cells of the whole projected space; larger ones are dealt to shards by hash.
MOST_CELLS = 1024


# ---------------------------------------------------------------- projections


def chi_square_quantile(chance: float, dims: int) -> float:
    """Where the chi-square distribution with ``dims`` degrees of freedom reaches ``chance``."""

    def reached(x: float) -> float:
        term = total = math.exp(dims / 2 * math.log(x / 2) - x / 2 - math.lgamma(dims / 2 + 1))
        for n in range(1, 1000):
            term *= x / 2 / (dims / 2 + n)
            total += term
        return total

    low, high = 1e-9, 50.0 + 10 * dims
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < chance else (low, middle)
    return high


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _projected(x: np.ndarray, further: np.ndarray, dims: int) -> np.ndarray:
    """Projections of rows with one further component by normal, hence 2-stable, coefficients of a fixed seed."""
    normal = np.random.default_rng([_SEED, x.shape[1], dims]).standard_normal((x.shape[1] + 1, dims))
    return x @ normal[:-1] + further[:, None] * normal[-1]


def candidates_at(x: np.ndarray, largest: float, dims: int) -> np.ndarray:
    """Rows get a component that makes all norms equal, so that the largest inner product is the least distance."""
    with np.errstate(all="ignore"):
        return _projected(x, np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", x, x), 0)), dims)


def queries_at(q: np.ndarray, largest: float, dims: int) -> np.ndarray:
    """Queries are stretched to the candidates' norm; the order of their inner products stays."""
    with np.errstate(all="ignore"):
        return _projected(q * _stretch(q, largest)[:, None], np.zeros(len(q)), dims)


def _stretch(q: np.ndarray, largest: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(largest / np.einsum("ij,ij->i", q, q))


def _distance(score: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Squared distance of a stretched query to a candidate of this inner product; infinite where it can't be told."""
    with np.errstate(all="ignore"):
        d = 2 * largest - 2 * _stretch(q, largest) * score
    return np.where(np.isfinite(d), np.maximum(d, 0), np.inf)


# ---------------------------------------------------------------- cells and trees


class Cells:
    """A kd-tree over a sample whose leaves divide the whole projected space."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, dims = depth, sample.shape[1]
        self.axis, self.cut = np.zeros(2**depth, np.int64), np.full(2**depth, np.inf)
        self.low, self.high = np.full((2**depth, dims), -np.inf), np.full((2**depth, dims), np.inf)
        parts, boxes = [sample], [(np.full(dims, -np.inf), np.full(dims, np.inf))]
        node = 1
        for _ in range(depth):
            halves, bounds = [], []
            for part, (low, high) in zip(parts, boxes):
                axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
                cut = float(np.median(part[:, axis])) if len(part) else 0.0
                self.axis[node], self.cut[node] = axis, cut
                left = part[:, axis] <= cut
                halves += [part[left], part[~left]]
                lower, upper = high.copy(), low.copy()
                lower[axis], upper[axis] = min(high[axis], cut), max(low[axis], cut)
                bounds += [(low, lower), (upper, high)]
                node += 1
            parts, boxes = halves, bounds
        for k, (low, high) in enumerate(boxes):
            self.low[k], self.high[k] = low, high

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - 2**self.depth

    def distances(self, points: np.ndarray) -> np.ndarray:
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box; 0 where it can't be told."""
    out = np.zeros((len(points), len(low)))
    with np.errstate(all="ignore"):
        for d in range(points.shape[1]):
            p = points[:, d][:, None]
            out += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0) ** 2
    return np.nan_to_num(out, nan=0.0, posinf=np.inf)


def leaves_of(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points in each leaf of a kd-tree, split at the median of its widest axis."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            leaves.append(part)
            continue
        axis = int(np.argmax(np.ptp(points[part], axis=0)))
        order = part[np.argpartition(points[part, axis], len(part) // 2)]
        todo += [order[: len(part) // 2], order[len(part) // 2 :]]
    return leaves


# ---------------------------------------------------------------- search in one shard


def plain_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, component by component from the first, so that equal vectors have equal scores everywhere."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    with np.errstate(all="ignore"):
        for d in range(x.shape[-1]):
            out += q[..., d] * x[..., d]
    return out


class Shard:
    """The distinct vectors of a shard with the ids of each, ascending; ``k + 1`` ids at most, as no query has more of them among its ``k``."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, x: np.ndarray, k: int):
        self.k = k
        _, first, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        self.x, vector = x[first], same[owner]
        order = np.lexsort((ids, vector))
        ids, vector = ids[order], vector[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (vector[1:] != vector[:-1])
        ids, vector = ids[new], vector[new]
        place = np.arange(len(vector)) - np.searchsorted(vector, vector)
        self.ids, vector = ids[place <= k], vector[place <= k]
        self.at = np.searchsorted(vector, np.arange(len(first) + 1))

    def expanded(self, own: np.ndarray, vectors: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of the ``k`` best ids for each query but its own; ``vectors`` below 0 are none."""
        query = np.repeat(np.arange(len(own)), vectors.shape[1])[(vectors >= 0).ravel()]
        scores, vectors = scores[vectors >= 0], vectors[vectors >= 0]
        size = self.at[vectors + 1] - self.at[vectors]
        place = np.repeat(self.at[vectors], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        query, score, ids = np.repeat(query, size), np.repeat(scores, size), self.ids[place]
        other = ids != own[query]
        query, score, ids = query[other], score[other], ids[other]
        # the best score of each id, then the best ids
        order = np.lexsort((-score, ids, query))
        query, score, ids = query[order], score[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (query[1:] != query[:-1])
        query, score, ids = query[new], score[new], ids[new]
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[best], ids[best], score[best]

    def search(self, own: np.ndarray, q: np.ndarray, bound: np.ndarray, largest: float, dims: int, limit: float, leaf: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score: the ``k`` nearest found. ``bound``: a squared distance within which a query has ``k`` already.

        Leaves are met in the order of their boxes' distances, which bound the projected distances
        of all that is not yet verified. A query ends when the next one is beyond ``limit`` times
        its k-th squared distance: by the chi-square distribution of the ratio, a nearer vector
        lies there with the chance that ``limit`` stands for.
        """
        points = candidates_at(self.x, largest, dims)
        leaves = leaves_of(points, leaf)
        low, high = (np.stack([f(points[p], axis=0) for p in leaves]) for f in (np.min, np.max))
        need = self.k + 1
        keep = need + 11
        found = []
        for i in range(0, len(q), block):
            part, there = q[i : i + block], queries_at(q[i : i + block], largest, dims)
            away = box_distances(there, low, high)
            order = np.argsort(away, axis=1, kind="stable")
            best, vector, within = np.full((len(part), keep), -np.inf), np.full((len(part), keep), -1), bound[i : i + block].copy()
            active = np.arange(len(part))
            for r in range(len(leaves)):
                following = order[active, r]
                with np.errstate(all="ignore"):
                    beyond = away[active, following] > limit * within[active]
                active, following = active[~beyond], following[~beyond]
                if not len(active):
                    break
                by_leaf = np.argsort(following, kind="stable")
                cuts = np.flatnonzero(np.diff(following[by_leaf])) + 1
                for at in np.split(by_leaf, cuts):
                    rows, held = active[at], leaves[following[at[0]]]
                    with np.errstate(all="ignore"):
                        scores = np.nan_to_num(part[rows] @ self.x[held].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    scores, vectors = np.concatenate([best[rows], scores], axis=1), np.concatenate([vector[rows], np.broadcast_to(held, (len(rows), len(held)))], axis=1)
                    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    best[rows], vector[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(vectors, top, 1)
                if len(self.x) >= need:
                    kth = -np.partition(-best[active], need - 1, axis=1)[:, need - 1]
                    within[active] = np.minimum(within[active], _distance(kth, part[active], largest))
            exact = plain_scores(part[:, None, :], self.x[vector])
            query, ids, score = self.expanded(own[i : i + block], vector, exact)
            few = np.flatnonzero((np.bincount(query, minlength=len(part)) < self.k) & (vector >= 0).all(axis=1))
            if len(few):  # ids with many vectors each: those queries meet all vectors
                query, ids, score = (a[~np.isin(query, few)] for a in (query, ids, score))
                for f in few.tolist():
                    more = self.expanded(own[i + f : i + f + 1], np.arange(len(self.x))[None], plain_scores(part[f], self.x)[None])
                    query, ids, score = np.append(query, np.full(len(more[0]), f)), np.append(ids, more[1]), np.append(score, more[2])
                order = np.argsort(query, kind="stable")
                query, ids, score = query[order], ids[order], score[order]
            found.append((query + i, ids, score))
        return tuple(np.concatenate(a) for a in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


# ---------------------------------------------------------------- jobs


def _by_dim(batch: pa.RecordBatch, column: str):
    """Rows of a batch by the length of their vectors."""
    size = np.diff(np.asarray(batch.column(column).offsets))
    for dim in np.unique(size).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(size == dim)))


def _dealt(cells: Cells, largest: float, dims: int, k: int):
    """``dim, cell, ids, embedding``: equal vectors of a batch are one row with their ``k + 1`` smallest ids."""

    def run(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch, "embedding"):
                ids, x = rows.column("vec_id").to_numpy(), matrix_of(rows.column("embedding"), dim)
                one = Shard(ids, np.arange(len(ids)), x, k)
                cell = cells.of(candidates_at(one.x, largest, dims))
                lists = pa.ListArray.from_arrays(pa.array(one.at, pa.int32()), pa.array(one.ids, pa.int64()))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(one.x) + 1) * dim, pa.int32()), pa.array(one.x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell, pa.int32()), lists, vectors], ["dim", "cell", "ids", "embedding"])

    return run


def _at_home(cells: Cells, largest: float, dims: int):
    def run(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch, "embedding"):
                q = matrix_of(rows.column("embedding"), dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), dim, np.int32)), pa.array(cells.of(queries_at(q, largest, dims)), pa.int32()), rows.column("query_id"), rows.column("embedding")], ["dim", "cell", "query_id", "embedding"])

    return run


def _beyond_home(cells: Cells, largest: float, dims: int, limit: float, shards: dict[int, int], block: int = 256):
    """A row for each query and shard that the chi-square test can't rule out, but for the shard already searched."""

    def run(batches):
        count = np.array([shards.get(c, 0) for c in range(2**cells.depth)])
        for batch in batches:
            for dim, rows in _by_dim(batch, "embedding"):
                for i in range(0, rows.num_rows, block):
                    part = rows.slice(i, block)
                    q = matrix_of(part.column("embedding"), dim)
                    within = _distance(part.column("kth").to_numpy(zero_copy_only=False), q, largest)
                    with np.errstate(all="ignore"):
                        near = ~(cells.distances(queries_at(q, largest, dims)) > limit * within[:, None])
                    query, cell = np.nonzero(near & (count > 0))
                    size = count[cell]
                    query, salt, cell = np.repeat(query, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(cell, size)
                    new = (cell != part.column("cell").to_numpy()[query]) | (salt > 0)
                    query, cell, salt = query[new], cell[new], salt[new]
                    sent = part.take(pa.array(query))
                    yield pa.RecordBatch.from_arrays([sent.column("dim"), pa.array(cell, pa.int32()), pa.array(salt, pa.int32()), sent.column("lot"), sent.column("query_id"), sent.column("embedding"), sent.column("kth")], ["dim", "cell", "salt", "lot", "query_id", "embedding", "kth"])

    return run


def _search(largest: float, dims: int, limit: float, leaf: int, k: int):
    """One row a query with the nearest ids of one shard; ``kth`` is the score of the k-th, or minus infinity."""

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        queries, held = queries.combine_chunks(), held.combine_chunks()
        n = queries.num_rows
        query, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if n and held.num_rows:
            dim = queries.column("dim")[0].as_py()
            q, x = (matrix_of(t.column("embedding").combine_chunks(), dim) for t in (queries, held))
            lists = held.column("ids").combine_chunks()
            shard = Shard(lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), x, k)
            bound = _distance(queries.column("kth").to_numpy(), q, largest)
            query, ids, score = shard.search(queries.column("query_id").to_numpy(), q, bound, largest, dims, limit, leaf)
        at = np.searchsorted(query, np.arange(n + 1))
        kth = np.full(n, -np.inf)
        full = np.flatnonzero(np.diff(at) >= k)
        kth[full] = score[at[full] + k - 1]
        offsets = pa.array(at, pa.int32())
        columns = {c: queries.column(c) for c in ("dim", "cell", "lot", "query_id", "embedding")}
        return pa.table(columns | {"kth": pa.array(kth), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), "scores": pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64()))})

    return run


def usable(vectors: DataFrame, name: str = "vec_id") -> DataFrame:
    """Rows with an id and a vector that is not null, not zero, and of finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias(name), v.alias("embedding")).where(F.col(name).isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, dims: int = 8, chance: float = 0.97, cell_rows: int = 8192, lot_rows: int = 16384, leaf: int = 128, sample: int = 20_000) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` vectors of largest inner product, as far as found.

    Vectors get a component that makes all norms equal, queries are stretched to that norm, and
    both are projected to ``dims`` numbers by normal coefficients. A kd-tree over at most
    ``sample`` of them (those of smallest hashed id) divides the space into cells; every vector
    is indexed. A query first searches the shard it falls into, then, with the distance of its
    k-th vector so far, every shard of every cell that the chi-square test can't rule out: a
    nearer vector is beyond such a cell or leaf with a chance of 1 - ``chance`` at most. Shards
    hold some ``cell_rows`` rows, and meet queries in lots of some ``lot_rows``: the stated
    queries in blocks, never all in one task. Scores are worked out on the original components in
    double precision, in their order.

    A query's own id is no candidate of it. Vectors that are null, zero, or have null or
    non-finite components take no part, nor do null ids; an inner product is sought among vectors
    of the query's length only. Equal vectors are one entry with their ``k + 1`` smallest ids,
    which loses nothing: ties go to the smaller id. An id that repeats counts with its best score.
    Fewer candidates than ``k`` give fewer rows. Further columns are ignored; without queries or
    vectors there are no rows.
    """
    held, asked = usable(vectors), usable(queries, "query_id").distinct()
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    n, largest = held.agg(F.count("*"), F.max(norm)).first()
    n_asked = asked.count()
    largest = float(largest or 1.0)
    limit = chi_square_quantile(chance, dims)
    chosen = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample if n > cell_rows else 0).toArrow()
    depth = max(0, math.ceil(math.log2(min(max(n, 1) / cell_rows, MOST_CELLS)))) if n > cell_rows else 0
    points = [candidates_at(matrix_of(rows.column("embedding"), dim), largest, dims) for batch in chosen.to_batches() for dim, rows in _by_dim(batch, "embedding")]
    cells = Cells(np.unique(np.concatenate([np.zeros((0, dims)), *points]), axis=0), depth)

    table = materialise(held.mapInArrow(_dealt(cells, largest, dims, k), "dim int, cell int, ids array<long>, embedding array<double>"), "ann-cells")
    shards = {r["cell"]: -(-r["count"] // cell_rows) for r in table.groupBy("cell").count().collect()}
    lots = max(1, -(-n_asked // lot_rows))
    salts = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("cell")) if shards else F.lit(1)
    spread = table.withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0], "embedding"), salts).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    keys, columns = ["dim", "cell", "salt", "lot"], "dim int, cell int, lot int, query_id long, embedding array<double>, kth double, ids array<long>, scores array<double>"
    search = _search(largest, dims, limit, leaf, k)

    lot = F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int").alias("lot")
    home = asked.mapInArrow(_at_home(cells, largest, dims), "dim int, cell int, query_id long, embedding array<double>").select("dim", "cell", F.lit(0).alias("salt"), lot, "query_id", "embedding", F.lit(float("-inf")).alias("kth"))
    first = materialise(home.groupBy(*keys).cogroup(spread.where("salt = 0").groupBy(*keys)).applyInArrow(search, columns), "ann-first")
    further = first.mapInArrow(_beyond_home(cells, largest, dims, limit, shards), "dim int, cell int, salt int, lot int, query_id long, embedding array<double>, kth double")
    second = further.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(search, columns)
    results = first.select("query_id", "ids", "scores").unionByName(second.select("query_id", "ids", "scores"))
    pairs = results.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).groupBy("query_id", F.col("p.ids").alias("vec_id")).agg(F.max("p.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
