"""Exact search for the k largest inner products, by ball trees.

Candidates are dealt into shards by a hash of their id. Each shard is split into
balls, halving along the widest direction, down to leaves of a few hundred
vectors; a ball has a centre and a radius, and no inner product with a query is
larger than that with the centre plus the radius times the query's length. A
query goes through a shard's leaves by falling bound, and stops when the bound is
below its current k-th score. Queries come in blocks, and each block first
searches its own shard: the k-th score found there is passed on to all other
shards, where it prunes from the start.

Scores are inner products of whole numbers, exact: in double precision while the
sums stay below 2**53, beyond that in Python's integers. A bound is rounded up.

Edge cases: vectors that are NULL or hold a NULL or a value that is not finite, also
when scaled, and rows without id, take no part; vectors of different lengths are filled with
zeros; equal scores go to the smaller id; rows of one id are never candidates of
queries with that id; repeated rows count once, and if an id has several vectors,
each is a candidate and each a query, and the best k of all its pairs count; fewer candidates than k give all
of them; a score beyond the range of long counts as its end; an empty table gives
an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thingroups.llm.common import on_workers, stored

LEAF = 256
#: Vectors of a shard and queries of a block that are searched together.
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096
EXACT = 2.0**53


def whole_numbers(vector: Column, scale: int = 1_024) -> Column:
    """floor(scale * x) for each component as a double; NULL where one cannot take part."""
    usable = vector.isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * float(scale)) == float("inf"))
    )
    # the difference to a whole double is exact, so that large values stay whole too
    return F.when(usable, F.transform(vector, lambda x: _floor(x.cast("double") * float(scale))))


def _floor(x: Column) -> Column:
    inside = F.abs(x) < EXACT
    return F.when(inside, F.floor(x).cast("double")).otherwise(x)


class BallTree:
    """Leaves of a set of vectors: rows, centre and radius of each."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        self.leaves: list[np.ndarray] = []
        pending = [np.arange(len(vectors))]
        while pending:
            rows = pending.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            widest = np.ptp(vectors[rows], axis=0).argmax()
            order = rows[np.argsort(vectors[rows, widest], kind="stable")]
            pending += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.centres = np.array([vectors[r].mean(axis=0) for r in self.leaves])
        self.radii = np.array(
            [np.sqrt(((vectors[r] - c) ** 2).sum(axis=1)).max() for r, c in zip(self.leaves, self.centres, strict=True)]
        )

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        bound = queries @ self.centres.T + length * self.radii
        return bound + 1e-9 * (np.abs(bound) + length * (np.abs(self.radii) + 1)) + 1e-6


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], dtype=object) @ np.array(
        [[int(x) for x in row] for row in vectors], dtype=object
    ).T
    return np.array([[max(-(2**63) + 1, min(2**63 - 1, x)) for x in row] for row in exact.tolist()], np.int64).reshape(exact.shape)


def search_shard(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one shard for each query that can beat its floor: query row, id, score."""
    tree = BallTree(vectors)
    bounds = tree.bounds(queries)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    kth = floors.astype(np.float64)
    open_ = np.arange(len(query_ids))
    for turn in range(len(tree.leaves)):
        leaf = order[open_, turn]
        going = bounds[open_, leaf] >= kth[open_]
        open_, leaf = open_[going], leaf[going]
        for this in np.unique(leaf):
            mine, rows = open_[leaf == this], tree.leaves[this]
            scores = _products(queries[mine], vectors[rows])
            for q, line in zip(mine.tolist(), scores, strict=True):
                good = np.flatnonzero((line >= kth[q]) & (ids[rows] != query_ids[q]))
                if len(good):
                    found = best[q] + list(zip((-line[good]).tolist(), ids[rows][good].tolist(), strict=True))
                    best[q] = sorted(found)[:k]
                    if len(best[q]) == k:
                        kth[q] = max(kth[q], -best[q][-1][0])
    found = [(q, vec, -score) for q, pairs in enumerate(best) for score, vec in pairs]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _search(pairs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Search query blocks in shards. Both sides are cogrouped by shard and block, so
    a task holds one shard and one block."""
    schema = "query_id long, vec_id long, score long"

    def work(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, queries["query"])), max(map(len, rows["vector"])))
        ids, query_ids = rows["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        q, vec, score = search_shard(
            ids, _matrix(rows["vector"], width), query_ids, _matrix(queries["query"], width), queries["floor"].to_numpy(), k
        )
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": vec, "score": score})

    keys = ["shard", "block"]
    return on_workers(pairs).groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(work, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = stored(rows.dropDuplicates(["vec_id", "vector"]), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asking")).first()
    shards = max(1, -(-size["all"] // SHARD_ROWS))
    blocks = max(1, -(-size["asking"] // BLOCK_ROWS))
    # the vector is part of the hash, so that many rows of one id are spread as well
    dealt = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    candidates = rows.select("vec_id", "vector", dealt.alias("shard"))
    queries = rows.where("asks").select(
        F.col("vec_id").alias("query_id"),
        F.col("vector").alias("query"),
        F.pmod(F.xxhash64("vector", "vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
    )
    home = F.pmod(F.col("block"), F.lit(shards))
    none = F.lit(float("-inf"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = candidates.withColumn("block", every_block)
    own = _search(
        queries.select("query_id", "query", "block", home.alias("shard"), none.alias("floor")),
        candidates.where(F.col("shard") == home),
        k,
    )
    if shards == 1:
        return _ranked(own, k)
    own = stored(own, "home-scores")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = own.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    asking = (
        queries.join(floors, "query_id", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .where(F.col("shard") != home)
        .select("query_id", "query", "block", "shard", F.coalesce("floor", none).alias("floor"))
    )
    return _ranked(own.unionByName(_search(asking, candidates.where(F.col("shard") != home), k)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
