import pytest

from tablefeed.operators.batches import TICK
from tablefeed.operators.fold import CHANGED_BEFORE, last_changes, tick_counts
from tablefeed.operators.keys import KeyViolation
from tablefeed.operators.upsert import BROADCAST, SHUFFLE
from tablefeed.sinks import parquet
from tablefeed.sinks.parquet import ParquetSink
from tablefeed.specs import TableSpec

NOW = "2024-01-01 00:00:00.000"
MARK = f" CDC:{NOW}"


def changes(spark, *rows):
    return spark.createDataFrame(rows, f"k long, t string, {TICK} long").repartition(3)


@pytest.fixture
def loaded(spark, tmp_path):
    df = spark.range(100).selectExpr("id k", "cast(id as string) t")
    spec = TableSpec.of(df, "small", ("k",), "t")
    sink = ParquetSink(spark, str(tmp_path))
    sink.create_table(spec)
    sink.append(df, spec)
    return sink, spec


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_changes_whose_keys_come_once_are_not_looked_for(spark, loaded, monkeypatch, plan):
    monkeypatch.setattr(parquet, "plan_for", lambda size: plan)
    monkeypatch.setattr(parquet, "last_changes", None)
    sink, spec = loaded
    effect = sink.apply(changes(spark, (7, "a", 0), (8, "b", 3), (200, "c", 5)), spec, 0, NOW)
    assert (effect.rows, effect.inserted, effect.updated) == (3, 1, 2)
    rows = dict(sink.read(spec).collect())
    assert len(rows) == 101 and (rows[7], rows[8], rows[200], rows[9]) == (f"a{MARK}", f"b{MARK}", "c", "9")


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_the_last_change_wins_also_where_rows_are_dealt_to_more_tasks(spark, loaded, monkeypatch, plan):
    monkeypatch.setattr(parquet, "plan_for", lambda size: plan)
    monkeypatch.setattr(parquet, "JOIN_BYTES", 40, raising=False)
    sink, spec = loaded
    rows = [(7, "a", 0), (7, "b", 2), (200, "c", 1), (200, "d", 2), (201, "e", 2)]
    effect = sink.apply(changes(spark, *rows), spec, 0, NOW)
    assert (effect.rows, effect.inserted, effect.updated) == (5, 2, 1)
    found = dict(sink.read(spec).collect())
    assert (found[7], found[200], found[201]) == (f"b{MARK}", f"d{MARK}", "e") and len(found) == 102
    with pytest.raises(KeyViolation):
        sink.apply(changes(spark, (7, "a", 0), (7, "b", 0)), spec, 1, NOW)


def test_rows_are_dealt_by_key_once(spark, loaded):
    _, spec = loaded
    rows = changes(spark, (1, "a", 0), (1, "b", 2), (2, "c", 1))
    keys = tick_counts(rows, spec)
    assert keys._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    last = last_changes(rows, keys, spec)
    assert sorted((r.k, r.t, r[CHANGED_BEFORE]) for r in last.collect()) == [(1, "b", True), (2, "c", False)]
    dealt = last.join(spark.range(9).withColumnRenamed("id", "k").hint("merge"), "k", "full")
    # the counts, the changes and the other side of the join
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 3
