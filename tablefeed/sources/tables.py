"""Tables read from Parquet files, with the keys they are upserted by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablefeed.session import scratch_path
from tablefeed.sources.generate import Sizes
from tablefeed.specs import TableSpec

KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "supplier": ("s_suppkey",),
    "customer": ("c_custkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "documents": ("doc_id",),
    "events": ("event_id",),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spec_of(df: DataFrame, name: str, comment: str | None = None) -> TableSpec:
    return TableSpec.of(df, name, KEYS[name], comment)


def sizes_of(spark: SparkSession, folder: str) -> Sizes:
    """Table sizes for the generator, equal to those of the tables in a folder."""
    names = ("supplier", "customer", "part", "orders")
    return Sizes(**{name: read_table(spark, folder, name).count() for name in names})


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The same rows, kept in the shared folder, so that using them twice costs one run."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)
