import pytest
from pyspark.sql import functions as F

from tablefeed import files
from tablefeed.operators import batches
from tablefeed.operators.batches import (
    BATCH,
    TICK,
    GeneratedChanges,
    TableChanges,
    batch_number,
    batch_total,
    numbered,
    replayed,
)
from tablefeed.sources.generate import ORDINAL, Sizes


def test_ordinals_are_dense_and_in_order(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as k", "id % 3 as j")
    got = numbered(spark, df, ["j", "k"]).orderBy(ORDINAL).collect()
    assert [r[ORDINAL] for r in got] == list(range(5000))
    assert [(r.j, r.k) for r in got] == sorted((r.j, r.k) for r in got)


def test_one_first_key_with_most_rows(spark):
    df = spark.range(4000).selectExpr("if(id < 3000, 5, id) as a", "id as b")
    got = numbered(spark, df, ["a", "b"]).orderBy(ORDINAL).collect()
    assert [r[ORDINAL] for r in got] == list(range(4000))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_numbering_nothing(spark):
    assert numbered(spark, spark.range(0), ["id"]).count() == 0


def test_batch_sizes(spark):
    ordered = numbered(spark, spark.range(250), ["id"])
    sizes = ordered.groupBy(batch_number(100).alias(BATCH)).count().orderBy(BATCH).collect()
    assert [tuple(r) for r in sizes] == [(0, 100), (1, 100), (2, 50)]
    assert [batch_total(n, 100) for n in (0, 1, 100, 101)] == [0, 1, 1, 2]
    with pytest.raises(ValueError):
        batch_number(0)


def brute_force(total, size, first, end):
    per_pass = -(-total // size)
    return sorted(
        (t, o)
        for t in range(first, end)
        for o in range(t % per_pass * size, min((t % per_pass + 1) * size, total))
    )


@pytest.mark.parametrize("ticks", [1, 2, 3, 4, 7])
def test_replay(spark, ticks):
    df = spark.range(250).withColumn(BATCH, F.floor(F.col("id") / 100))
    got = replayed(df, 3, ticks).select(TICK, "id").collect()
    assert sorted(tuple(r) for r in got) == brute_force(250, 100, 0, ticks)


@pytest.mark.parametrize(("first", "end"), [(0, 1), (2, 4), (0, 9), (5, 6), (3, 3 + 3)])
def test_rows_at_ticks(spark, first, end):
    source = TableChanges(spark, spark.range(250).withColumn("o", F.col("id")), ["id"])
    assert source.total == 250 and source.batches(100) == 3
    got = source.at_ticks(first, end, 100).select(TICK, "o").collect()
    assert sorted(tuple(r) for r in got) == brute_force(250, 100, first, end)


def test_generated_rows_at_ticks(spark):
    source = GeneratedChanges(spark, "lineitem", Sizes(10, 15, 20, 60))
    per_pass = source.batches(100)
    got = source.at_ticks(0, 2 * per_pass, 100)
    assert got.count() == 2 * source.total
    counts = {r[0]: r[1] for r in got.groupBy(TICK).count().collect()}
    assert counts[0] == 100 and sum(counts.values()) == 2 * source.total


def test_an_empty_source_is_an_error(spark):
    with pytest.raises(ValueError):
        TableChanges(spark, spark.range(0), ["id"]).at_ticks(0, 1, 100)
    with pytest.raises(ValueError):
        replayed(spark.range(0).withColumn(BATCH, F.col("id")), 0, 1)


def test_a_range_of_ordinals_opens_its_chunks_only(spark, monkeypatch):
    monkeypatch.setattr(batches, "CHUNK_BYTES", 4000)
    source = TableChanges(spark, spark.range(1000), ["id"])
    assert len(source.kept.starts) == 4
    third = source.kept.starts[2][1]
    some = source.between(third + 10, third + 20)
    assert sorted(r.id for r in some.collect()) == list(range(third + 10, third + 20))
    held = spark.read.parquet(source.kept.path).where("_chunk = 2").inputFiles()
    read = {r[0] for r in some.select(F.input_file_name()).collect()}
    assert len(read) == 1 and {f.split("/")[-2] for f in read} == {"_chunk=2"} and held
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_chunk" in plan and ">= 2)" in plan
    source.close()
    assert not files.exists(spark, source.kept.path)


def test_any_number_of_ticks_has_one_plan(spark):
    source = TableChanges(spark, spark.range(5), ["id"])

    def plan(ticks):
        return source.at_ticks(0, ticks, 2)._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(10_000).splitlines()) == len(plan(10).splitlines())
    assert source.at_ticks(0, 10_000, 2).count() == 10_000 // 3 * 5 + 2
