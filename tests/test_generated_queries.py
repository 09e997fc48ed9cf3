import pytest

from tablefeed import queries
from tablefeed.operators.upsert import BROADCAST, SHUFFLE
from tablefeed.sources.generate import BUILDERS, Sizes


@pytest.fixture
def folder(spark, tmp_path):
    """Orders of which one comes twice and one has no key."""
    for name, key, rows in (("customer", "c_custkey", 30), ("supplier", "s_suppkey", 10), ("part", "p_partkey", 20)):
        spark.range(rows).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{name}.parquet")
    keys = [(k,) for k in (*range(0, 60, 3), 6, None)]
    spark.createDataFrame(keys, "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_lines_of_slices_are_not_sorted(spark, folder, monkeypatch, plan):
    monkeypatch.setattr(queries, "plan_for", lambda size: plan)
    monkeypatch.setattr(queries, "KEYS_PER_TASK", 2, raising=False)
    monkeypatch.setattr(queries, "encode", lambda rows: rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = queries.gen_slices_lineitem(spark, folder)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in text
        assert (", 11)" in text) == (plan == SHUFFLE)  # 22 orders, two to a task
        # slices go up to as many orders as there are rows
        ids = [k + 1 for k in range(0, 60, 3) if k < 22]
        want = BUILDERS["lineitem"](spark.createDataFrame([(i,) for i in ids], "id long"), Sizes(10, 30, 20, 22))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
