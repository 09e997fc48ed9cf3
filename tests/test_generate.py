import math
import re

import pytest
from pyspark.sql import functions as F

from tablefeed.functions.draws import draw, state, with_line_state, with_state
from tablefeed.operators.keys import duplicate_keys
from tablefeed.sources import words
from tablefeed.sources.generate import (
    BUILDERS,
    ORDINAL,
    Sizes,
    generate,
    order_lines,
    row_count,
    rows_between,
)
from tablefeed.specs import TABLES

SIZES = Sizes(supplier=100, customer=1500, part=200, orders=1501)


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", BUILDERS)
def test_schema_rows_and_keys(spark, table):
    df = generate(spark, table, SIZES)
    spec = TABLES[table]
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in spec.schema]
    assert df.count() == row_count(spark, table, SIZES)
    assert duplicate_keys(df, spec.pk).isEmpty()
    assert df.where(" or ".join(f"{c} is null" for c in df.columns)).isEmpty()


@pytest.mark.parametrize("table", BUILDERS)
def test_nothing_is_shuffled(spark, table):
    text = plan(generate(spark, table, SIZES))
    assert "Exchange" not in text and "Join" not in text


@pytest.mark.parametrize("table", ["part", "partsupp", "orders", "lineitem"])
def test_slices_make_the_table(spark, table):
    whole = generate(spark, table, SIZES)
    slices = [generate(spark, table, SIZES, i, 3) for i in (1, 2, 3)]
    assert same(whole, slices[0].unionAll(slices[1]).unionAll(slices[2]))


@pytest.mark.parametrize("table", BUILDERS)
def test_rows_between_ordinals(spark, table):
    total = row_count(spark, table, SIZES)
    every = BUILDERS[table](spark.range(SIZES.ids(table).start, SIZES.ids(table).stop), SIZES)
    ordinals = every.agg(F.min(ORDINAL), F.max(ORDINAL), F.count_distinct(ORDINAL)).first()
    assert tuple(ordinals) == (0, total - 1, total)
    for low, high in ((0, 1), (total // 3, total // 2 + 1), (total - 1, total)):
        got = rows_between(spark, table, SIZES, low, high)
        assert same(got, every.where(F.col(ORDINAL).between(low, high - 1)))


def test_ordinals_follow_the_key(spark):
    lines = rows_between(spark, "lineitem", SIZES, 0, 500)
    ordered = lines.orderBy("l_orderkey", "l_linenumber").select(ORDINAL).collect()
    assert [r[0] for r in ordered] == list(range(500))


def test_seeds_differ(spark):
    left, right = (generate(spark, "supplier", SIZES, seed=s) for s in (1, 2))
    assert left.join(right, ["s_suppkey", "s_acctbal"]).count() < 5


def test_bad_slice_and_scale(spark):
    with pytest.raises(ValueError):
        generate(spark, "part", SIZES, 4, 3)
    with pytest.raises(ValueError):
        Sizes.at_scale(0)


def test_scale_one():
    sizes = Sizes.at_scale(1)
    assert (sizes.supplier, sizes.customer, sizes.part, sizes.orders) == (
        10_000, 150_000, 200_000, 1_500_000,
    )


def test_domains(spark):
    part = generate(spark, "part", SIZES)
    assert part.where("substr(p_mfgr, 14, 1) != substr(p_brand, 7, 1)").isEmpty()
    assert part.where("size(array_distinct(split(p_name, ' '))) != 5").isEmpty()
    k = F.col("p_partkey")
    price = (90_000 + F.floor(k / 10) % 20_001 + 100 * (k % 1000)) / 100
    assert part.where(price.cast("decimal(15,2)") != F.col("p_retailprice")).isEmpty()
    lines = generate(spark, "lineitem", SIZES)
    per_order = lines.groupBy("l_orderkey").count().groupBy("count").count().collect()
    assert {r[0] for r in per_order} == set(range(1, 8))
    nation = generate(spark, "nation", SIZES).orderBy("n_nationkey").collect()
    assert [(r.n_name, r.n_regionkey) for r in nation] == words.NATIONS
    for table, (low, high) in {
        "region": (31, 115), "nation": (31, 114), "supplier": (25, 100), "customer": (29, 116),
        "part": (5, 22), "partsupp": (49, 198), "orders": (19, 78), "lineitem": (10, 43),
    }.items():
        length = F.length(TABLES[table].comment)
        assert generate(spark, table, SIZES).where(~length.between(low, high)).isEmpty()


COMMENTS = {
    "region": (31, 115), "nation": (31, 114), "supplier": (25, 100), "customer": (29, 116),
    "part": (5, 22), "partsupp": (49, 198), "orders": (19, 78), "lineitem": (10, 43),
}


@pytest.mark.parametrize("table", COMMENTS)
def test_every_part_of_a_comment_is_a_draw_of_its_own(spark, table):
    low, high = COMMENTS[table]
    ids = SIZES.ids(table)[:150]
    keys = spark.range(ids.start, ids.stop)
    of, stream = state(table), "orders" if table == "lineitem" else table
    drawn = with_state(keys, "id", stream)
    if table in ("partsupp", "lineitem"):
        each = "explode(sequence(0L, 3L)) as n" if table == "partsupp" else "explode(sequence(1L, _lines)) as n"
        drawn = with_line_state(with_state(order_lines(keys), "id", stream).selectExpr("*", each), stream, "n")
        of = state("line")
    pieces = words.SENTENCES if high > 50 else words.PHRASES
    n = math.ceil((high + words.STARTS) / (min(map(len, pieces)) + 1))
    parts = [draw(of, f"phrase{i}", len(pieces)) for i in range(n)]
    parts += [draw(of, "comment start", words.STARTS), draw(of, "comment length", high - low + 1, low)]
    want = []
    for *phrases, start, length in drawn.selectExpr(*parts).collect():
        want.append(" ".join(pieces[p] for p in phrases)[start : start + length])
    got = [r[0] for r in BUILDERS[table](keys, SIZES).select(TABLES[table].comment).collect()]
    assert sorted(got) == sorted(want) and len(want) >= len(ids)


def test_texts_do_not_run_out(spark):
    for parts in (2_000, 40_000):
        rows = generate(spark, "part", Sizes(supplier=100, customer=10, part=parts, orders=10))
        names, comments = rows.agg(
            F.count_distinct("p_name"), F.count_distinct("p_comment")
        ).first()
        # Comments may be as short as five characters, which many parts share.
        assert names > 0.99 * parts and comments > 0.6 * parts
    colors = rows.select(F.explode(F.split("p_name", " ")).alias("c")).groupBy("c").count()
    counts = [r["count"] for r in colors.collect()]
    assert len(counts) == len(words.COLORS) and max(counts) < 1.2 * min(counts)


def test_large_scale_ids_do_not_overflow(spark):
    huge = Sizes.at_scale(100_000)
    assert row_count(spark, "lineitem", huge) > 5 * 10**11
    for table in ("orders", "lineitem", "part", "partsupp", "customer"):
        total = row_count(spark, table, huge)
        assert rows_between(spark, table, huge, total - 50, total).count() == 50


@pytest.mark.parametrize("scale", [1, 100_000])
@pytest.mark.parametrize("table", BUILDERS)
def test_a_rows_code_is_short_enough_to_be_compiled(spark, table, scale):
    """HotSpot interprets methods of more than 8000 bytes, at a tenth of the speed."""
    df = generate(spark, table, Sizes.at_scale(scale))
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    text = getattr(debug, "MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
