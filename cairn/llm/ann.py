"""Approximate nearest neighbours by collision-counting hashing.

A shard's index is one sorted array for each of ``PROJECTIONS`` directions, taken from
random orthonormal bases.  Around a query's own projection a window opens in every
array; virtual rehashing widens all windows by a factor per level and counts only what
is new.  A vector that lies in more than a set share of its windows is verified: its
exact cosine is computed.  A query is done in a shard at the level whose radius holds
as many verified vectors as are asked for, or reaches the bound that the query brings,
or when ``BUDGET`` of the shard is verified, most collisions first.

Rows are dealt into cells by the side of the median on which they lie along the first
axes, cells of very many rows into shards, and a cell's queries into blocks.  A query
is searched in its own shard first; its k-th distance there bounds the search, and sets
the windows on the axes that say which other cells it is sent to at all.

Every row is indexed and nothing is sampled.  Distances are those of unit vectors,
so nearest is the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.bounded import broadcast_if_small
from cairn.functions.lineage import settle, stash

SHARD, BLOCK = 4096, 1024
PROJECTIONS, SEED = 96, 17
#: First radius and its growth; half window in radii; share of windows that verifies.
RADIUS, GROWTH, HALF, SHARE = 0.2, 1.05, 1.0, 0.63
#: Verified share of a shard, and verified vectors in any shard, at which a query is done there.
BUDGET, LEAST_VERIFIED = 0.18, 64
#: Axes that cells are split by, at most, and half a query's window on them in
#: standard deviations of a neighbour at its bound.
AXES, REACH = 24, 2.5
#: Keeps the projections apart in one flat sorted array (they are sums of few terms).
_APART = 1e4


def directions(size: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` columns of random orthonormal bases, scaled so that a projection of a
    difference of length d has variance d squared."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-count // size))]
    return np.sqrt(size) * np.concatenate(bases, axis=1)[:, :count]


class Index:
    """Sorted projections of a shard's different vectors; copies are known by their ids."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, seed: int = SEED):
        order = np.lexsort((rows, ids))
        rows, ids, vectors = rows[order], ids[order], np.ascontiguousarray(vectors[order])
        _, first, copy = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        by_copy = np.argsort(copy, kind="stable")
        self.rows, self.ids = rows[by_copy], ids[by_copy]  # by vector, then by id and row
        self.ends = np.r_[0, np.cumsum(np.bincount(copy))]
        self.vectors = vectors[first]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = self.vectors / self.norms[:, None]
        self.axes = directions(vectors.shape[1], PROJECTIONS, seed)
        at = (self.unit @ self.axes).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.shift = _APART * np.arange(PROJECTIONS)
        self.flat = (np.take_along_axis(at, self.order, axis=1) + self.shift[:, None]).ravel()

    def _places(self, centres: np.ndarray, side: str) -> np.ndarray:
        base = len(self.unit) * np.arange(PROJECTIONS)
        return np.searchsorted(self.flat, (centres + self.shift).ravel(), side).reshape(centres.shape) - base

    def cosine(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (self.vectors[at] * query).sum(1) / (self.norms[at] * np.sqrt((query * query).sum()))

    def search(self, own_rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query: ids and cosines of the k nearest rows found but its own, nearest
        first, ties to smaller ids, and how many vectors were verified."""
        unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        centres = unit @ self.axes
        radii = RADIUS * GROWTH ** np.arange(int(np.ceil(np.log(2 / RADIUS) / np.log(GROWTH))) + 1)
        lows, highs = {}, {}
        out, ended = [], np.zeros(len(radii) + 1, np.int64)
        for first in range(0, len(queries), 256):  # some queries' windows at a time, at the levels they come to
            lows.clear()
            highs.clear()
            part = slice(first, first + 256)

            def windows(level: int, part: slice = part) -> tuple[np.ndarray, np.ndarray]:
                if level not in lows:
                    lows[level] = self._places(centres[part] - HALF * radii[level], "left")
                    highs[level] = self._places(centres[part] + HALF * radii[level], "right")
                return lows[level], highs[level]

            for q in range(first, min(first + 256, len(queries))):
                # begin a level below where half of the queries so far have ended: a wide first
                # window verifies more, never less
                begin = max(0, int(np.searchsorted(np.cumsum(ended), ended.sum() / 2)) - 1) if q else 0
                found, level, verified = self._one(q - first, unit[q], windows, radii, begin, bounds[q], k)
                ended[level] += 1
                out.append((*self._nearest(found, own_rows[q], queries[q], k), verified))
        return out

    def _one(self, q: int, unit: np.ndarray, windows, radii: np.ndarray, begin: int, bound: float, k: int):
        """(vectors, their cosines) verified, the level at which the search ended, and how many were verified."""
        n = len(self.unit)
        free, count = np.ones(n, bool), np.zeros(n, np.int64)
        most = max(int(BUDGET * n), LEAST_VERIFIED, k + 1)
        at, scores = np.empty(0, np.int64), np.empty(0)
        level, before = begin, None
        while True:
            low, high = (x[q] for x in windows(level))
            if before is None:
                fresh = [o[a:b] for o, a, b in zip(self.order, low, high)]
            else:
                fresh = [o[a:b] for o, a, b in zip(self.order, low, before[0])] + [o[a:b] for o, a, b in zip(self.order, before[1], high)]
            before = low, high
            count += np.bincount(np.concatenate(fresh), minlength=n)
            last = level + 1 == len(radii)
            new = np.flatnonzero(free if last else (count > SHARE * PROJECTIONS) & free)
            if len(new) > most - len(at):  # the most collisions first
                new = new[np.argsort(-count[new], kind="stable")[: most - len(at)]]
            free[new] = False
            at, scores = np.r_[at, new], np.r_[scores, self.unit[new] @ unit]
            held = at[scores >= 1 - radii[level] ** 2 / 2]
            enough = (self.ends[held + 1] - self.ends[held]).sum() > k  # one of them may be the query's own
            if enough or len(at) >= most or last or radii[level] >= bound:
                return (at, scores), level, len(at)
            level += 1

    def _nearest(self, found: tuple[np.ndarray, np.ndarray], own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, scores = found
        if len(at) > k + 1:
            # products of matrices round by position: the last word is the exact cosine
            at = at[scores >= np.partition(scores, -k - 1)[-k - 1] - 1e-9]
        exact = self.cosine(at, query)
        rows = [np.arange(self.ends[v], min(self.ends[v + 1], self.ends[v] + k + 1)) for v in at]  # of copies the first k but the query's own
        place = np.concatenate(rows) if rows else np.empty(0, np.int64)
        score = np.repeat(exact, [len(r) for r in rows])
        other = self.rows[place] != own
        place, score = place[other], score[other]
        best = np.lexsort((self.ids[place], -score))[:k]
        return self.ids[place[best]], score[best]


_FOUND = "query_row long, query_id long, vec_id long, score double, verified long"


def _tile(k: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(data) and len(queries):
            table = lambda x: np.stack(x.vector.to_numpy()).astype(np.float64)
            index = Index(data.row.to_numpy(np.int64), data.id.to_numpy(np.int64), table(data))
            found = index.search(queries.row.to_numpy(np.int64), table(queries), queries.bound.to_numpy(np.float64), k)
            for row, asked, (ids, scores, verified) in zip(queries.row, queries.id, found):
                rows += [(row, asked, i, s, 0) for i, s in zip(ids.tolist(), scores.tolist())]
                rows.append((row, asked, None, None, verified))
        out = pd.DataFrame(rows, columns=["query_row", "query_id", "vec_id", "score", "verified"])
        return out.astype({"query_row": "int64", "query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})

    return run


def _axes(count: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(vectors: pd.Series) -> pd.Series:
        """A unit vector's place along the first axes of its length's basis (fewer, if it is shorter)."""
        known: dict[int, np.ndarray] = {}

        def one(v: np.ndarray) -> np.ndarray:
            v = np.asarray(v, np.float64)
            if len(v) not in known:
                known[len(v)] = directions(len(v), min(count, len(v)), SEED + 1) / np.sqrt(len(v))
            return (v / np.sqrt((v * v).sum())) @ known[len(v)]

        return vectors.map(one)

    return project


def _cells(split: int, low, high) -> Column:
    """Numbers of the cells on the sides that hold: bit j is the side along axis j."""
    cells = F.array(F.lit(0).cast("long"))
    for j in range(split):
        none = F.array().cast("array<long>")
        bit = F.lit(1 << j)
        upper = F.transform(cells, lambda c: c + bit)  # noqa: B023
        used = F.col("split") > j
        cells = F.when(~used, cells).otherwise(F.concat(F.when(low(j), cells).otherwise(none), F.when(high(j), upper).otherwise(none)))
    return cells


def _anew(df: DataFrame) -> DataFrame:
    """``df`` with new attributes: a cogroup confuses sides that share some."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def nearest(rows: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score, n_verified``: each query's k nearest found among all other rows.

    ``is_query`` is SQL over ``id``.  Rows without id and vectors that are null, empty,
    zero, or hold null or non-finite components take no part, as query or as candidate.
    Rows are told apart even if they share an id: each is a candidate for all but itself,
    and each that is a query has ranks of its own.  Vectors of another length are never a
    query's candidates.  ``score`` is the cosine in double precision; ties go to the
    smaller id.  ``n_verified`` counts the cosines that a query took.  An empty table, or
    one without queries, gives no rows; other columns are not read.
    """
    return settle(rows.sparkSession, lambda: _nearest(rows, is_query, id_col, vector_col, k))


def _nearest(rows: DataFrame, is_query: str, id_col: str, vector_col: str, k: int) -> DataFrame:
    v = F.col("vector")
    kind = rows.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    clean = (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
        .where(F.col("id").isNotNull() & v.isNotNull()).where(ok)
    )
    clean = clean.withColumn("size", F.size("vector")).withColumn("query", F.expr(is_query)).withColumn("row", F.monotonically_increasing_id())
    largest = stash(clean)  # written, so that a row's number stays
    counted = largest.groupBy("size").agg(F.count("*").alias("n"))
    most = counted.agg(F.max("n")).first()[0] or 0
    split = min(AXES, max(0, int(np.ceil(np.log2(max(1, most) / SHARD)))))
    spread = lambda m: F.pmod(F.xxhash64("row"), m.cast("long")).cast("int")

    if not split:
        placed = largest.withColumns({"cell": F.lit(0).cast("long"), "shards": F.lit(1)})
        asked = placed.where("query").withColumn("bound", F.lit(float("inf")))
    else:
        seen = stash(largest.withColumn("at", _axes(split)("vector")))
        middle = F.array(*[F.percentile_approx(F.get("at", F.lit(j)), 0.5) for j in range(split)])
        wanted = F.greatest(F.ceil(F.log2(F.count("*") / F.lit(SHARD))), F.lit(0))
        sizes = stash(seen.groupBy("size").agg(F.least(wanted, F.lit(split), F.col("size")).cast("int").alias("split"), middle.alias("middle")))
        right = lambda j: F.get("at", F.lit(j)) > F.get("middle", F.lit(j))
        marked = seen.join(broadcast_if_small(sizes), "size").withColumn("cell", _cells(split, lambda j: ~right(j), right)[0])
        per_cell = stash(marked.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(SHARD)).cast("int").alias("shards")))
        placed = stash(marked.join(broadcast_if_small(per_cell), ["size", "cell"]))

        # a query's own shard first, for a bound on its distance to the k-th nearest
        home = ["size", "cell", "shard"]
        at_home = placed.withColumn("shard", spread(F.col("shards"))).withColumn("bound", F.lit(float("inf")))
        asking = _anew(at_home.where("query").select(*home, "row", "id", "vector", "bound"))
        first = at_home.select(*home, "row", "id", "vector").groupBy(*home).cogroup(asking.groupBy(*home)).applyInPandas(_tile(k), _FOUND)
        bounds = first.where("vec_id is not null").groupBy("query_row").agg(
            F.when(F.count("*") >= k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).alias("bound"))
        near = placed.where("query").join(bounds.withColumnRenamed("query_row", "row"), "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        reach = F.least(F.col("bound"), F.lit(REACH) * F.col("bound") / F.sqrt("size")) + F.lit(1e-9)
        place = lambda j: F.get("at", F.lit(j)) - F.get("middle", F.lit(j))
        cells = _cells(split, lambda j: place(j) <= reach, lambda j: place(j) > -reach)
        sent = near.select("size", "row", "id", "vector", "bound", F.explode(cells).alias("cell"))
        asked = stash(sent.join(broadcast_if_small(per_cell), ["size", "cell"]))

    tile = ["size", "cell", "shard", "block"]
    blocks = stash(asked.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")))
    small = broadcast_if_small(blocks)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    data = placed.join(small, ["size", "cell"]).select("size", "cell", spread(F.col("shards")).alias("shard"), every("blocks").alias("block"), "row", "id", "vector")
    queries = _anew(asked.join(small, ["size", "cell"]).select(
        "size", "cell", every("shards").alias("shard"), F.pmod(F.xxhash64("row", F.lit(2)), F.col("blocks").cast("long")).cast("int").alias("block"),
        "row", "id", "vector", "bound"))
    found = stash(data.groupBy(*tile).cogroup(queries.groupBy(*tile)).applyInPandas(_tile(k), _FOUND))
    verified = found.groupBy("query_row").agg(F.sum("verified").alias("n_verified"))
    best = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.where("vec_id is not null").withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.join(verified, "query_row").select("query_id", "rank", "vec_id", "score", "n_verified")
