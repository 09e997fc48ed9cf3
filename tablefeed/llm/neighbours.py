"""Nearest neighbours by largest inner product, with vantage-point trees.

A vector gets one more component, so that all have the length of the longest;
then a larger inner product with a query is a smaller Euclidean distance to it,
and the triangle inequality holds. The vectors are dealt into shards and each
shard has a tree: a node's vantage point and a radius part its vectors into the
near and the far half. A half is left out for a query if the distance it keeps
by the triangle inequality, times a factor, is that of the k-th found already.
Factor one leaves out nothing that could be nearer; a larger one leaves out more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefeed.llm.common import keep, table

NEIGHBOURS = 20
EVERY = 20
#: Exact. A larger factor leaves out more halves and can miss neighbours.
FACTOR = 1.0
LEAF = 256
SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
#: Bound of the error of a product, as a share of the lengths of its vectors.
ROUNDING = 1e-12
#: Pairs whose products are worked out at a time.
PAIRS = 100_000


class Node:
    """A leaf with the places of its rows, or a vantage point and two halves."""

    __slots__ = ("rows", "point", "near", "far", "near_to", "far_from", "far_to")

    def __init__(self, points: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> None:
        self.rows: np.ndarray | None = None
        if len(rows) <= LEAF:
            self.rows = rows
            return
        self.point = points[rows[rng.integers(len(rows))]]
        away = np.sqrt(((points[rows] - self.point) ** 2).sum(axis=1))
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        self.near_to = away[near[-1]]
        self.far_from, self.far_to = away[far[0]], away[far[-1]]
        self.near = Node(points, rows[near], rng)
        self.far = Node(points, rows[far], rng)


class Search:
    """The k largest inner products so far of each query with the rows of a tree."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, longest: float, k: int, factor: float) -> None:
        self.vectors, self.ids, self.k, self.factor = vectors, ids, k, factor
        self.longest = longest
        squares = (vectors**2).sum(axis=1)
        lift = np.sqrt(np.maximum(longest**2 - squares, 0))
        self.tree = Node(np.column_stack([vectors, lift]), np.arange(len(vectors)), np.random.default_rng(len(ids)))

    def run(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.queries, self.own = queries, own
        self.squares = (queries**2).sum(axis=1)
        self.scores = np.full((len(queries), self.k), -np.inf)
        self.found = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        self.visit(self.tree, np.arange(len(queries)))
        return self.scores, self.found

    def reach(self, at: np.ndarray) -> np.ndarray:
        """How far away a row may be and still be among the k nearest."""
        worst = self.scores[at, -1]
        squares = self.squares[at] + self.longest**2 - 2 * worst
        return np.sqrt(np.maximum(squares, 0))

    def visit(self, node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            self.scan(node.rows, at)
            return
        point = node.point
        lengths = self.squares[at] + (point**2).sum() - 2 * self.queries[at] @ point[:-1]
        away = np.sqrt(np.maximum(lengths, 0))
        to_near = np.maximum(away - node.near_to, 0)
        to_far = np.maximum(np.maximum(node.far_from - away, away - node.far_to), 0)
        near_first = away < (node.near_to + node.far_from) / 2
        halves = ((node.near, to_near), (node.far, to_far))
        for one, (first, second) in ((near_first, halves), (~near_first, halves[::-1])):
            for half, least in (first, second):
                # rounding must not cut off a tie
                open_ = one & (least * self.factor <= self.reach(at) * (1 + 1e-9) + 1e-12)
                self.visit(half, at[open_])

    def scan(self, rows: np.ndarray, at: np.ndarray) -> None:
        """Merge the rows of a leaf into the results of the queries ``at``.

        A product in a matrix product depends in its last bit on its place there. So
        that serves to leave out rows; what is near the k-th is worked out pair by pair.
        """
        ids = self.ids[rows]
        about = self.queries[at] @ self.vectors[rows].T
        about[self.own[at][:, None] == ids[None]] = -np.inf
        slack = ROUNDING * np.sqrt(self.squares[at]) * self.longest
        better = (about >= (self.scores[at, -1] - slack)[:, None]).any(axis=1)
        at, about, slack = at[better], about[better], slack[better]
        if not len(at):
            return
        both = np.concatenate([self.scores[at], about], axis=1)
        least = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k] - slack
        scores = np.full(about.shape, -np.inf)
        query, row = np.nonzero((about >= least[:, None]) & (about > -np.inf))
        for part in range(0, len(query), PAIRS):
            q, r = query[part : part + PAIRS], row[part : part + PAIRS]
            scores[q, r] = (self.queries[at[q]] * self.vectors[rows[r]]).sum(axis=1)
        all_scores = np.concatenate([self.scores[at], scores], axis=1)
        all_ids = np.concatenate([self.found[at], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores))[:, : self.k]
        self.scores[at] = np.take_along_axis(all_scores, order, 1)
        self.found[at] = np.take_along_axis(all_ids, order, 1)


def usable(vectors: pd.Series) -> pd.DataFrame:
    """Doubles and length of vectors that take part; null for the others."""
    out = []
    for vector in vectors:
        found = None
        if vector is not None:
            found = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
            if not len(found) or not np.isfinite(found).all() or not found.any():
                found = None
        out.append((None, None) if found is None else (found.tobytes(), float(np.sqrt(found @ found))))
    return pd.DataFrame(out, columns=["vector", "size"])


def searched(k: int, factor: float, longest: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def one(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(shard):
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        vectors = np.array([np.frombuffer(v) for v in shard["vector"]])
        asked = np.array([np.frombuffer(v) for v in queries["vector"]])
        search = Search(vectors, shard["vec_id"].to_numpy(np.int64), longest, k, factor)
        own = queries["vec_id"].to_numpy(np.int64)
        scores, found = search.run(asked, own)
        row, place = np.nonzero(np.isfinite(scores))
        return pd.DataFrame({"query_id": own[row], "vec_id": found[row, place], "score": scores[row, place]})

    return one


def nearest(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates nearest to each query but for its own row.

    Both have (vec_id, embedding). Rows without an id or a usable vector take no
    part, and only vectors of the query's dimension are compared. Of rows that
    repeat a vec_id, the one that is last in the order of arrays counts. Equal
    vectors have equal scores, and of equal scores the smaller vec_ids come first,
    however many there are. Empty tables give no rows. Every
    shard meets every block of queries once, so a query's result holds k rows of
    each shard before the last step.
    """
    usable_of = F.pandas_udf(usable, "vector binary, size double")

    def ready(rows: DataFrame) -> DataFrame:
        one = rows.where("vec_id is not null and embedding is not null").groupBy(
            F.col("vec_id").cast("long").alias("vec_id")
        ).agg(F.max("embedding").alias("embedding"))
        return (
            one.select("vec_id", usable_of("embedding").alias("v"))
            .select("vec_id", "v.*")
            .where("vector is not null")
            .withColumn("dimension", F.octet_length("vector"))
        )

    points = keep(ready(candidates), "points")
    asked = keep(ready(queries), "queries")
    told = points.agg(F.count("*"), F.max("size")).first()
    shards = max(1, -(-told[0] // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = points.select("dimension", shard.alias("shard"), every(blocks).alias("block"), "vec_id", "vector")
    sent = asked.select("dimension", every(shards).alias("shard"), block.alias("block"), "vec_id", "vector")
    group = ["dimension", "shard", "block"]
    found = (
        sent.groupBy(*group)
        .cogroup(dealt.groupBy(*group))
        .applyInPandas(searched(k, factor, told[1] or 0.0), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of all vectors to every 20th."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
