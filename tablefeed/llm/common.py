"""What several operators share: kept tables, gapless ranks, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefeed.sources.tables import read_table, written

#: Rows that one task ranks at a time.
SLICE_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table."""
    return read_table(spark, folder, name).select(*(F.col(f"`{c}`") for c in columns))


def keep(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder: computed once, and no lineage is left."""
    return written(df.sparkSession, df, label)


def byte_letters() -> dict[str, int]:
    """Letter to byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def gapless(
    df: DataFrame, groups: list[str], order: list[Column], name: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Number the rows of every group from 0 without gaps.

    A group is cut into slices by a hash of ``order``, so that the rows of a hot
    group are ranked by many tasks; slices follow each other. ``df`` is read
    twice and should be a kept table. Rows equal in ``order`` may change places.
    """
    slices = max(1, -(-df.count() // slice_rows))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(F.lit("slice"), *order), F.lit(slices)))
    counts = cut.groupBy(*groups, "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(*groups, "_slice").orderBy(*order)
    return (
        cut.withColumn("_at", F.row_number().over(within) - 1)
        .join(starts, [*groups, "_slice"])
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_slice", "_at", "_start")
    )


def told_apart(rows: DataFrame, block: int = SLICE_ROWS) -> DataFrame:
    """(row, nth): every row as a struct, equal ones numbered from 0.

    Equal rows are counted into a kept table, by partial counts before the shuffle, and written out
    again from their count; those of more than ``block`` by a task for each block.
    So no task gathers a row that is repeated often, and the numbers don't depend
    on how the rows lie.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    counts = keep(rows.select(row).groupBy("row").agg(F.count("*").alias("n")), "counted")
    few = counts.where(F.col("n") <= block).select(
        "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")
    )
    firsts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))
    many = (
        counts.where(F.col("n") > block)
        .select("row", "n", F.explode(firsts).alias("first"))
        .repartition("row", "first")
        .select("row", F.explode(F.sequence("first", F.least(F.col("first") + block, "n") - 1)).alias("nth"))
    )
    return few.unionByName(many)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is its smallest node.

    Large-star and small-star steps in turn until the links no longer change
    (Kiveris and others, "Connected Components in MapReduce and Beyond"). The
    number of links never grows, and a hub costs one row for each link.
    """
    now = keep(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = keep(small, "links")
        told = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if told == seen:
            break
        seen = told
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
