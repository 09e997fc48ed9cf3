"""A uniform shuffle into shards of exact size.

The rows are dealt into parts by a hash. How many rows each part sends to each
shard is drawn beforehand, as a matrix of multivariate hypergeometric counts;
then each part is permuted and cut by its row of the matrix, the pieces are
exchanged, and each shard is permuted again. That is a uniform shuffle, and the
shards' sizes differ by one row at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablefeed.llm.common import SLICE_ROWS, gapless, keep, table, told_apart

SHARDS = 8


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric draw, by inversion outward from the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    reach = int(40 * spread) + 50
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1))
    fall = np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1))
    logs = np.concatenate([np.cumsum(fall)[::-1], [0.0], np.cumsum(rise)])
    chances = np.cumsum(np.exp(logs))
    at = int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))
    return mode - len(down) + min(at, len(chances) - 1)


def communication_matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each part sends to each shard: rows sum to ``parts``, columns to equal sizes."""
    rng = np.random.default_rng(seed)
    total = sum(parts)
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    matrix = np.zeros((len(parts), shards), dtype=np.int64)
    for part, draws in enumerate(parts):
        others = sum(room)
        for shard in range(shards):
            others -= room[shard]
            got = hypergeometric(rng, room[shard], others, draws)
            matrix[part, shard] = got
            room[shard] -= got
            draws -= got
    return matrix


def shuffled_into_shards(
    rows: DataFrame, shards: int = SHARDS, seed: int = 17, part_rows: int = SLICE_ROWS
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Any column may be null and any row may be repeated: rows that are equal in
    all columns are numbered, and the number is hashed with the row, so they are
    dealt as far apart as any others. Columns named shard or slot are replaced, a
    text of any length is one value. No rows give no rows. Only counts per part, of
    about ``part_rows`` rows each, reach the driver.
    """
    spark = rows.sparkSession
    apart = told_apart(rows, part_rows)
    parts = max(1, -(-apart.count() // part_rows))

    def drawn(purpose: str) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(purpose), "row", "nth")

    dealt = apart.withColumn("part", F.pmod(drawn("part"), F.lit(parts)).cast("int"))
    counts = dict(dealt.groupBy("part").count().collect())
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    cuts = spark.createDataFrame(
        [(p, np.cumsum(matrix[p]).tolist()) for p in range(parts)], "part int, cuts array<long>"
    )
    first = Window.partitionBy("part").orderBy(drawn("first"))
    sent = (
        dealt.withColumn("rank", F.row_number().over(first) - 1)
        .join(cuts, "part")
        .select(
            "row",
            "nth",
            sum((F.col("rank") >= F.col("cuts")[s]).cast("int") for s in range(shards - 1)).alias("shard")
            if shards > 1
            else F.lit(0).alias("shard"),
        )
    )
    placed = gapless(keep(sent, "sent"), ["shard"], [drawn("second")], "slot", part_rows)
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.col("shard").cast("int"), F.col("slot").cast("long"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> None:
    """The shuffled rows as Parquet, one folder for each shard, each file in order of slots."""
    dealt = shuffled_into_shards(rows, shards, seed)
    (
        dealt.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 8 shards by the law of rows. Null texts count as empty ones."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffled_into_shards(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
