import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablefeed.functions.text import decode, encode, marked, rejects, timestamp_text
from tablefeed.operators import keys
from tablefeed.operators.batches import TICK
from tablefeed.operators.fold import fold_batches
from tablefeed.operators.keys import (
    KeyViolation,
    duplicate_keys,
    latest_per_key,
    null_counts,
    require_absent,
    require_unique,
    require_values,
)
from tablefeed.sinks.parquet import text_schema
from tablefeed.specs import TableSpec

TYPED = "k long, d date, m decimal(15,2), n decimal(10,0), t string"


def typed(spark):
    return spark.createDataFrame(
        [
            (1, dt.date(1969, 12, 31), Decimal("-0.05"), Decimal("12"), "a"),
            (2, dt.date(2024, 2, 29), Decimal("0.00"), Decimal("-7"), ""),
            (3, None, None, None, None),
            (4, dt.date(1, 1, 1), Decimal("1234567890123.45"), Decimal("0"), "é"),
        ],
        TYPED,
    )


def test_encode(spark):
    rows = encode(typed(spark)).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [
        (1, "1969-12-31", "-0.05", "12", "a"),
        (2, "2024-02-29", "0.00", "-7", ""),
        (3, None, None, None, None),
        (4, "0001-01-01", "1234567890123.45", "0", "é"),
    ]


def test_decode_is_the_inverse(spark):
    df = typed(spark)
    back = decode(encode(df), df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_bad_text(spark):
    df = typed(spark)
    spec = TableSpec.of(df, "t", ("k",))
    staged = spark.createDataFrame(
        [(1, "2024-01-01", "1.5", "3", "x"), (2, "no date", "1.5", "3", "x"),
         (3, "2024-01-01", "many", "3", "x"), (4, None, None, None, None)],
        text_schema(spec),
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        decode(staged, df.schema).collect()
    assert decode(staged, df.schema, lenient=True).where("d is null").count() == 2
    assert sorted(r.k for r in rejects(staged, df.schema).collect()) == [2, 3]


@pytest.mark.parametrize("comment", [None, "", "x" * 39, "x" * 40, "x" * 41, "日本" * 30])
def test_marker(spark, comment):
    now = timestamp_text(dt.datetime(2024, 5, 6, 7, 8, 9, 12_345))
    df = spark.createDataFrame([(comment,)], "c string")
    got = df.select(marked(F.col("c"), now)).first()[0]
    want = None if comment is None else comment[:40] + " CDC:2024-05-06 07:08:09.012"
    assert got == want


def test_timestamp_text_has_a_fixed_width():
    assert timestamp_text(dt.datetime(2024, 1, 2), 6) == "2024-01-02 00:00:00.000000"


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2)], "a int, b int")
    assert [tuple(r) for r in duplicate_keys(df, ["a", "b"]).collect()] == [(1, 2, 2)]
    require_unique(df.where("a = 2"), ["a"], "t")
    with pytest.raises(KeyViolation, match="t: key"):
        require_unique(df, ["a", "b"], "t")
    with pytest.raises(KeyViolation):
        require_absent(df, df, ["a"], "t")
    require_absent(df, df.where("a = 9"), ["a"], "t")


def test_latest_per_key_compares_columns_in_order(spark):
    df = spark.createDataFrame(
        [(1, 5, "b", 1.0), (1, 5, "c", 2.0), (1, 4, "z", 3.0), (2, None, "q", 4.0)],
        "k int, v int, w string, x double",
    )
    got = latest_per_key(df, ["k"], ["v", "w"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 5, "c", 2.0), (2, None, "q", 4.0)]


def test_latest_per_key_sorts_nothing(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("t"))
    plan = latest_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort" not in plan and "Exchange hash" not in plan
    unique = latest_per_key(df, ["id"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert unique.count("partial_max(struct") == 1 and "Window" not in unique
    spec = TableSpec.of(df, "t", ("k",))
    changes = df.withColumn(TICK, F.col("id"))
    plan = fold_batches(changes, spec)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan and plan.count("partial_max") >= 1


@pytest.mark.parametrize("rows_per_key", [0, 4])
def test_latest_per_key_takes_ties_nulls_and_repeated_rows(spark, monkeypatch, rows_per_key):
    monkeypatch.setattr(keys, "ROWS_PER_KEY", rows_per_key)
    rows = [
        (1, None, 5.0, "a"), (1, None, 5.0, "b"), (1, None, None, "z"),
        (2, 7, float("nan"), "c"), (2, 7, 1e300, "d"), (2, 6, float("nan"), "e"),
        (None, 1, 0.0, "f"), (None, 1, -0.0, "g"), (None, 1, -0.0, "g"), (3, 1, 1.0, None), (3, 1, 1.0, None),
    ]
    df = spark.createDataFrame(rows, "k long, a long, b double, t string")
    got = {r.k: (r.a, r.t) for r in latest_per_key(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: (None, "b"), 2: (7, "c"), None: (1, "g"), 3: (1, None)}
    assert latest_per_key(df, ["k"], ["a", "b"]).count() == 4
    assert latest_per_key(df.limit(0), ["k"], ["a"]).collect() == []


def test_a_hot_key_is_spread_by_its_values(spark, monkeypatch):
    monkeypatch.setattr(keys, "ROWS_PER_KEY", 0)
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) k", "id v", "concat('t', id) t")
    got = {r.k: (r.v, r.t) for r in latest_per_key(df, ["k"], ["v"]).where("k < 5").collect()}
    assert got == {0: (29_997, "t29997"), **{k: (k, f"t{k}") for k in (1, 2, 4)}}


def test_required_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    spec = TableSpec.of(df, "t", ("k",))
    assert require_values(df, spec).count() == 2
    with pytest.raises(Exception, match="t.k must not be null"):
        require_values(spark.createDataFrame([(None, "a")], "k long, t string"), spec).collect()
    assert {r.column_name: r.null_rows for r in null_counts(df, ["k", "t"]).collect()} == {
        "k": 0, "t": 1,
    }


def test_a_key_with_a_third_of_all_rows(spark):
    hot = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as v")
    got = {r.k: r.v for r in latest_per_key(hot, ["k"], ["v"]).collect()}
    want = {}
    for i in range(30_000):
        want[7 if i % 3 == 0 else i] = i
    assert got == want
    assert [tuple(r) for r in duplicate_keys(hot, ["k"]).collect()] == [(7, 10_001)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_conversion_is_the_same_in_every_session(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.sql(
            "SELECT CAST('0.0000000001' AS decimal(20,10)) d, DATE'1969-12-31' t, CAST(-1234567.05 AS decimal(15,2)) m, CAST(-7 AS decimal(9,0)) z"
        )
        assert tuple(encode(df).first()) == ("0.0000000001", "1969-12-31", "-1234567.05", "-7")
        assert decode(encode(df), df.schema).first() == df.first()
        for bad in ("junk", "x1"):
            wrong = spark.createDataFrame([(bad, "1969-12-31", "1", "2")], "d string, t string, m string, z string")
            with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
                decode(wrong, df.schema).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
