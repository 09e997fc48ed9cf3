"""Link vectors of equal label and cosine of a threshold or more, by p-stable hashing.

Vectors are set to length 1, projected on random directions and quantised; the
vectors that share all quantised projections of a table meet in a bucket (Datar
and others, "Locality-Sensitive Hashing Scheme Based on p-Stable Distributions").
In a bucket every two are compared exactly, in double precision. A pair that
meets in several tables counts in the first of them. What leaves a bucket are
numbers of links and a forest that connects the linked, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import components, keep, table

COSINE = 0.93
TABLES = 24
PROJECTIONS = 8
#: Width of a quantised projection; vectors at cosine 0.93 are 0.374 apart.
WIDTH = 2.0
#: Distinct vectors of a bucket that one task compares with as many others.
BLOCK = 2048


def projections(dimension: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dimension])
    return (
        rng.standard_normal((dimension, TABLES * PROJECTIONS)),
        rng.random(TABLES * PROJECTIONS) * WIDTH,
    )


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """A 64-bit key for each vector and table."""
    directions, shifts = projections(unit.shape[1])
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64)
    cells = cells.reshape(len(unit), TABLES, PROJECTIONS).astype(np.uint64)
    keys = np.zeros((len(unit), TABLES), dtype=np.uint64)
    for p in range(PROJECTIONS):
        keys = (keys ^ cells[:, :, p]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def usable(vector: np.ndarray | None) -> np.ndarray | None:
    """The vector in double precision, or None if it takes no part."""
    if vector is None:
        return None
    found = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
    return found if len(found) and np.isfinite(found).all() and found.any() else None


def unit(vector: np.ndarray) -> np.ndarray:
    """Of length 1; scaled first, so that the square of no component over- or underflows."""
    scaled = vector / np.abs(vector).max()
    return scaled / np.sqrt(scaled @ scaled)


def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every row; vector and bucket keys are null where it takes no part."""
    for batch in batches:
        vectors = [
            None if pd.isna(label) else usable(embedding)
            for embedding, label in zip(batch["embedding"], batch["label"])
        ]
        content = [None if v is None else shipped(v) for v in vectors]
        keys: list[bytes | None] = [None] * len(vectors)
        for size in {len(v) for v in vectors if v is not None}:
            own = [n for n, v in enumerate(vectors) if v is not None and len(v) == size]
            for n, k in zip(own, bucket_keys(np.array([unit(vectors[n]) for n in own]))):
                keys[n] = k.tobytes()
        yield pd.DataFrame(
            {"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "vector": content, "keys": keys}
        )


def shipped(vector: np.ndarray) -> bytes:
    """The components, in single precision with a mark in front if that loses nothing."""
    single = vector.astype(np.float32)
    return b"f" + single.tobytes() if (single == vector).all() else b"d" + vector.tobytes()


def received(content: bytes) -> np.ndarray:
    kind = np.float32 if content[:1] == b"f" else np.float64
    return np.frombuffer(content, kind, offset=1).astype(np.float64)


def forest(n: int, links: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever the given pairs of 0..n-1 connect."""
    parent = list(range(n))
    kept = []
    for a, b in links.tolist():
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def compared(
    this: int, across: bool, group: pd.DataFrame, threshold: float = COSINE
) -> pd.DataFrame:
    """Numbers of links and a forest, for the pairs of two blocks of a bucket.

    ``this`` is the table; pairs that meet in an earlier one are left to it.
    ``across`` says that the blocks are two: then only pairs across them count.
    256 rows are compared with all others at a time. ``weight`` is the number of
    vectors that are exactly the row's own.
    """
    ids = group["rep"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, weight = ids[order], group["weight"].to_numpy(np.int64)[order]
    block = group["block"].to_numpy(np.int64)[order]
    vectors = np.array([unit(received(v)) for v in group["vector"].to_numpy()[order]])
    keys = np.array([np.frombuffer(k, np.int64) for k in group["keys"].to_numpy()[order]])
    counts = np.zeros(len(ids), dtype=np.int64)
    parent = np.arange(len(ids))
    kept: list[tuple[int, int]] = []
    for at in range(0, len(ids), 256):
        rows = slice(at, at + 256)
        linked = vectors[rows] @ vectors[at:].T >= threshold
        linked &= np.arange(at, min(at + 256, len(ids)))[:, None] < np.arange(at, len(ids))[None]
        if across:
            linked &= block[rows][:, None] != block[at:][None]
        a, b = np.nonzero(linked)
        a, b = a + at, b + at
        if this:
            earlier = (keys[a, :this] == keys[b, :this]).any(axis=1)
            a, b = a[~earlier], b[~earlier]
        np.add.at(counts, a, weight[b])
        np.add.at(counts, b, weight[a])
        # what earlier rows have joined needs no further link
        open_ = parent[a] != parent[b]
        for x, y in forest(len(ids), np.stack([parent[a[open_]], parent[b[open_]]], 1)):
            if (low := min(parent[x], parent[y])) != (high := max(parent[x], parent[y])):
                parent[parent == high] = low
                kept.append((x, y))
    ends = np.array(kept, dtype=np.int64).reshape(-1, 2)
    has = np.nonzero(counts)[0]
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[has], ids[ends[:, 0]]]),
            "b": np.concatenate([np.full(len(has), -1), ids[ends[:, 1]]]),
            "links": np.concatenate([counts[has], np.zeros(len(ends), np.int64)]),
            "edge": np.concatenate([np.zeros(len(has), bool), np.ones(len(ends), bool)]),
        }
    )


def linked(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows without a label or a usable vector link with nothing and are their own
    component; vectors of different dimension don't link. Rows that repeat a
    vec_id, and rows without one, are vectors of their own, which link like any
    other; ids that are null are passed over in the smallest id of a component,
    and a component without any id has none. No rows give none.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string").alias("label")
    ).mapInPandas(prepared, "vec_id long, label string, vector binary, keys binary")
    # Fixed once it is written: a task that runs again gives its rows the same numbers.
    given = keep(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    valid = given.where("vector is not null")
    # equal vectors of one label are one, with a weight
    classes = keep(
        valid.groupBy("label", "vector", "keys").agg(
            F.min("row").alias("rep"), F.count("*").alias("weight"), F.min("vec_id").alias("low")
        ),
        "classes",
    )

    @F.pandas_udf("array<long>")
    def unpacked(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: np.frombuffer(k, np.int64))

    met = classes.select("label", "rep", F.posexplode(unpacked("keys")).alias("table", "key"))
    sizes = met.groupBy("table", "label", "key").agg(F.count("*").alias("n")).where("n > 1")
    # a bucket of more than a block is cut in blocks, and every two blocks meet
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("first"), F.greatest("block", o).alias("second")),
    )
    placed = (
        met.join(sizes, ["table", "label", "key"])
        .withColumn("blocks", blocks)
        .withColumn("block", mine)
        .select("table", "label", "key", "rep", "block", F.explode(others).alias("pair"))
        .join(classes.select("rep", "vector", "keys", "weight"), "rep")
    )
    found = keep(
        placed.select(
            "table", "label", "key", "pair.first", "pair.second", "rep", "block", "vector", "keys", "weight"
        )
        .groupBy("table", "label", "key", "first", "second")
        .applyInPandas(
            lambda key, group: compared(key[0], key[3] != key[4], group),
            "a long, b long, links long, edge boolean",
        ),
        "found",
    )
    counts = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("edge").select("a", "b"))
    own = F.coalesce("component", "rep").alias("component")
    rooted = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "label", "vector", "rep", "weight", "low", own
    )
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    told = (
        rooted.join(lowest, "component")
        .join(counts, "rep", "left")
        .select(
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            "component_id",
        )
    )
    members = valid.join(told, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    apart = given.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    return members.unionByName(apart).withColumn("kept", kept)


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return linked(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


OP1_SQL = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS row, * FROM embeddings),
v AS (
    SELECT row, label, embedding::DOUBLE[] AS e FROM r
    WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), n AS (
    SELECT row, label, e, sqrt(list_inner_product(e, e)) AS size FROM v
    WHERE list_bool_or(list_transform(e, lambda x: x <> 0))
), p AS (
    SELECT a.row AS a, b.row AS b FROM n a JOIN n b
    ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e)
    AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93
), reach AS (
    SELECT row AS node, row AS got FROM r
    UNION SELECT reach.node, p.b FROM reach JOIN p ON reach.got = p.a
), lowest AS (
    SELECT node, min(vec_id) AS component_id FROM reach JOIN r ON got = row GROUP BY node)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id,
       vec_id IS NOT DISTINCT FROM component_id AS kept
FROM r JOIN lowest ON row = node
LEFT JOIN (SELECT a, count(*) AS n_links FROM p GROUP BY a) ON a = row
"""
