import pytest

from tablefeed.operators.batches import TICK
from tablefeed.operators.fold import CHANGED_BEFORE, fold_batches
from tablefeed.operators.upsert import (
    BROADCAST,
    INSERTED,
    KEPT,
    SHUFFLE,
    UPDATED,
    ChangeSize,
    measure_changes,
    plan_for,
    upsert,
    upsert_counts,
)
from tablefeed.specs import TableSpec

NOW = "2024-01-01 00:00:00.000"
COLUMNS = "a long, b int, v double, c string"


@pytest.fixture
def target(spark):
    return spark.createDataFrame(
        [(1, 1, 1.0, "one"), (1, 2, 2.0, "x" * 50), (2, 1, None, None), (3, 1, 3.0, "three")],
        COLUMNS,
    )


@pytest.fixture
def changes(spark):
    return spark.createDataFrame(
        [
            (1, 2, 20.0, "y" * 50),
            (2, 1, 30.0, None),
            (3, 1, None, "short CDC:2020-01-01 00:00:00.000"),
            (4, 1, 40.0, "z" * 50),
        ],
        COLUMNS,
    )


WANT = [
    (1, 1, 1.0, "one"),
    (1, 2, 20.0, "y" * 40 + f" CDC:{NOW}"),
    (2, 1, 30.0, None),
    (3, 1, None, f"short CDC:2020-01-01 00:00:00.000 CDC:{NOW}"),
    (4, 1, 40.0, "z" * 50),
]


def spec(df, comment="c"):
    return TableSpec.of(df, "t", ("a", "b"), comment)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_upsert(target, changes, plan):
    got = upsert(target, changes, spec(target), NOW, plan)
    assert got.columns == target.columns
    assert rows(got) == WANT
    done = upsert(target, changes, spec(target), NOW, plan, effect="done")
    assert sorted(r.done for r in done.collect()) == [KEPT, INSERTED, UPDATED, UPDATED, UPDATED]


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_without_marker_it_is_idempotent(target, changes, plan):
    once = upsert(target, changes, spec(target, None), NOW, plan)
    assert rows(upsert(once, changes, spec(target, None), NOW, plan)) == rows(once)
    assert ("z" * 50) in {r[3] for r in rows(once)}


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_empty_sides(target, changes, plan):
    s = spec(target)
    assert rows(upsert(target, changes.limit(0), s, NOW, plan)) == rows(target)
    assert rows(upsert(target.limit(0), changes, s, NOW, plan)) == rows(changes)


def test_a_comment_is_cut_at_forty(target, changes):
    twice = upsert(target, changes, spec(target), NOW)
    again = upsert(twice, changes, spec(target), "later")
    marked = {r[:2]: r[3] for r in rows(again)}
    assert marked[(1, 2)] == "y" * 40 + " CDC:later"
    assert marked[(4, 1)] == "z" * 40 + " CDC:later"


def test_counts(target, changes):
    assert tuple(upsert_counts(target, changes, spec(target)).first()) == (1, 3, 1)


def test_target_is_not_shuffled_by_the_broadcast_plan(spark, target, changes):
    text = plan_text(upsert(target, changes, spec(target), NOW, BROADCAST))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
    shuffled = text[text.index("Exchange hashpartitioning") :].splitlines()[1]
    assert "HashAggregate(keys=[a#" in shuffled and "functions=[]" in shuffled


def test_plan_follows_the_measured_size(spark, changes):
    size = measure_changes(changes, spec(changes))
    assert size.rows == 4 and size.key_bytes == 4 * (32 + 16 + 16)
    assert plan_for(size) == BROADCAST
    assert plan_for(size, size.key_bytes - 1) == SHUFFLE
    assert plan_for(ChangeSize(10**9, 10**11)) == SHUFFLE
    text = spark.createDataFrame([("abc",), ("",)], "k string")
    assert measure_changes(text, TableSpec.of(text, "t", ("k",))).key_bytes == 2 * (32 + 16) + 3


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_folded_batches_equal_single_ones(spark, target, plan):
    s = spec(target)
    one = [(1, 1, 5.0, "first"), (7, 1, 5.0, "new"), (8, 1, 1.0, None)]
    two = [(7, 1, 6.0, "newer"), (9, 1, 6.0, "last"), (8, 1, None, "now")]
    step = target
    for batch in (one, two):
        step = upsert(step, spark.createDataFrame(batch, COLUMNS), s, NOW, plan)
    ticked = spark.createDataFrame(
        [(*r, 0) for r in one] + [(*r, 1) for r in two], f"{COLUMNS}, {TICK} long"
    )
    folded = fold_batches(ticked, s)
    at_once = upsert(target, folded, s, NOW, plan, hit_before=CHANGED_BEFORE)
    assert rows(at_once) == rows(step)


@pytest.mark.parametrize("plan", [BROADCAST, SHUFFLE])
def test_many_rows_against_brute_force(spark, plan):
    target = spark.range(0, 3000, 3).selectExpr("id a", "1 b", "id * 1.0D v", "string(id) c")
    changes = spark.range(0, 4000, 2).selectExpr("id a", "1 b", "id * 2.0D v", "string(id) c")
    got = {r[0]: r[2:] for r in rows(upsert(target, changes, spec(target), NOW, plan))}
    want = {k: (k * 1.0, str(k)) for k in range(0, 3000, 3)}
    for k in range(0, 4000, 2):
        want[k] = (k * 2.0, f"{k} CDC:{NOW}" if k in want else str(k))
    assert got == want


def test_repeated_target_keys_give_the_same_rows_by_both_plans(spark):
    target = spark.createDataFrame(
        [(1, 1, 1.0, "a"), (1, 1, 2.0, "b"), (2, 1, 3.0, "c"), (3, 1, 4.0, "d"), (3, 1, 4.0, "d")], COLUMNS
    )
    changes = spark.createDataFrame([(1, 1, 9.0, "n"), (4, 1, 8.0, "m")], COLUMNS)
    got = [
        rows(upsert(target, changes, spec(target), None, plan, repeats=True)) for plan in (BROADCAST, SHUFFLE)
    ]
    assert got[0] == got[1] and len(got[0]) == 5
    assert [r[2:] for r in got[0] if r[0] == 1] == [(9.0, "n")]
