
import pytest

from tablefeed.plans.rates import batch_plan, split_rate
from tablefeed.session import scratch_path
from tablefeed.specs import TABLES, comment_column, primary_key, select_tables


def names(choice):
    return [spec.name for spec in select_tables(choice)]


def test_selection_keeps_order_and_ignores_case():
    assert names("all") == [
        "region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem",
    ]
    assert names(" LineItem ,orders") == ["lineitem", "orders"]


@pytest.mark.parametrize("choice", ["", "ALL", "all,orders", "orders,", "users", "orders,Orders"])
def test_bad_selection_is_rejected(choice):
    with pytest.raises(ValueError):
        select_tables(choice)


def test_keys_and_comments():
    assert primary_key("lineitem") == ("l_orderkey", "l_linenumber")
    assert primary_key("partsupp") == ("ps_partkey", "ps_suppkey")
    assert {comment_column(t) for t in TABLES} <= {c for s in TABLES.values() for c in s.payload}


@pytest.mark.parametrize(
    ("rate", "tables", "rates", "batches", "intervals"),
    [
        (100, 2, [50, 50], [100, 100], [2.0, 2.0]),
        (101, 2, [51, 50], [100, 100], [100 / 51, 2.0]),
        (7, 3, [3, 2, 2], [100, 100, 100], [100 / 3, 50.0, 50.0]),
        (20_000, 1, [20_000], [1000], [0.05]),
        (5_000, 1, [5_000], [500], [0.1]),
    ],
)
def test_rate_split(rate, tables, rates, batches, intervals):
    paces = split_rate([f"t{i}" for i in range(tables)], rate)
    assert [p.rate for p in paces] == rates
    assert [p.batch_rows for p in paces] == batches
    assert [p.interval_seconds for p in paces] == pytest.approx(intervals)


@pytest.mark.parametrize(("rate", "due"), [(1, 0), (50, 5), (1000, 100), (100_000, 1000)])
def test_batches_due_in_a_time(rate, due):
    pace = split_rate(["t"], rate)[0]
    assert pace.ticks_by(10) == due
    assert sum(pace.ticks_by(s + 1) - pace.ticks_by(s) for s in range(10)) == due


@pytest.mark.parametrize(("rate", "tables"), [(1, 2), (0, 1), (5, 0)])
def test_rate_too_low(rate, tables):
    with pytest.raises(ValueError):
        split_rate([f"t{i}" for i in range(tables)], rate)


def test_batch_plan_of_an_empty_table(spark):
    row = batch_plan(spark, {"t": spark.range(0)}, 100).first()
    assert (row.source_rows, row.batches_per_pass, row.last_batch_rows) == (0, 0, 0)


def test_scratch_paths_differ_and_lie_in_the_shared_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    assert a.startswith(spark.conf.get("spark.checkpoint.dir"))
