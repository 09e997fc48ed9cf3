"""The eight tables as partition-parallel projections of a range of ids.

Row content follows the public TPC-H rules for row counts, domains and
cross-table invariants; it is not byte-equal to the standard generator's.

Each table is built by a function from a DataFrame of ids to rows, with no
shuffle and no join, so a table, a slice of it, a change batch or the keys of
another table can all be the source. The ids are:

* region, nation: the key, from 0;
* supplier, customer, part, orders: the row number, from 1;
* partsupp: the part key, four rows each;
* lineitem: the order's row number, 1 to 7 rows each.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.functions.draws import (
    SEED,
    State,
    div,
    draw,
    fixed_line_state,
    key_draw,
    mod,
    pick,
    state,
    state_draw,
    with_columns,
    with_line_state,
    with_state,
)
from tablefeed.sources import words
from tablefeed.specs import TABLES

FIRST_DATE = dt.date(1992, 1, 1)
ORDER_DAYS = 2406
CURRENT_DATE = dt.date(1995, 6, 17)
CURRENT_DAY = (CURRENT_DATE - FIRST_DATE).days
MAX_LINES = 7
LINES_PER_BLOCK = 28
COLORS_PER_PART = 5

# Ordinal of a row in the order its table is generated, from 0.
ORDINAL = "_ordinal"

# Ids one task takes, so that it writes files of about 100-200 MB.
IDS_PER_TASK = {"orders": 1_000_000, "lineitem": 500_000, "partsupp": 250_000}
DEFAULT_IDS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Sizes:
    """Row counts that keys of one table draw their foreign keys from."""

    supplier: int
    customer: int
    part: int
    orders: int

    @classmethod
    def at_scale(cls, scale_factor: float) -> Sizes:
        if scale_factor <= 0:
            raise ValueError("the scale factor must be above 0")
        rows = {"supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000}
        return cls(**{name: max(1, round(n * scale_factor)) for name, n in rows.items()})

    @property
    def clerks(self) -> int:
        return max(1, self.orders // 1500)

    def ids(self, table: str) -> range:
        if table in ("region", "nation"):
            return range({"region": len(words.REGIONS), "nation": len(words.NATIONS)}[table])
        unit = {"partsupp": "part", "lineitem": "orders"}.get(table, table)
        return range(1, getattr(self, unit) + 1)


def _money(cents: str) -> str:
    return f"cast(cast({cents} as decimal(15,0)) * 0.01BD as decimal(15,2))"


def _comment(of: State, low: int, high: int) -> str:
    """low..high characters, from a drawn place on, of a text of drawn phrases."""
    pieces = words.SENTENCES if high > 50 else words.PHRASES
    n = math.ceil((high + words.STARTS) / (min(map(len, pieces)) + 1))
    phrases = [pick(pieces, draw(of, f"phrase{i}", len(pieces))) for i in range(n)]
    length = draw(of, "comment length", high - low + 1, low)
    start = draw(of, "comment start", words.STARTS, 1)
    text = f"concat_ws(' ', {', '.join(phrases)})"
    return f"substr({text}, cast({start} as int), cast({length} as int))"


def _digits(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


def _address(of: State) -> str:
    """10 to 40 characters from a fixed alphabet."""
    alphabets = ["aQmX3 kRt9", "Zb7,Lw Hd2", "pF5oGy8,Us", "eJ NcV1iT4"]
    pieces = [
        f"translate({_digits(key_draw(of, f'address{i}', 10**10), 10)}, '0123456789', '{alphabet}')"
        for i, alphabet in enumerate(alphabets)
    ]
    return f"left(concat({', '.join(pieces)}), cast({draw(of, 'address length', 31, 10)} as int))"


def _phone(of: State, nation: str) -> str:
    parts = [
        f"{nation} + 10",
        draw(of, "phone1", 900, 100),
        draw(of, "phone2", 900, 100),
        draw(of, "phone3", 9000, 1000),
    ]
    return f"concat_ws('-', {', '.join(f'cast({part} as string)' for part in parts)})"


def _balance(of: State) -> str:
    return _money(draw(of, "balance", 1_099_999, -99_999))


def _pick(of: State, name: str, values: list[str]) -> str:
    return pick(values, draw(of, name, len(values)))


def _shape(df: DataFrame, table: str, **values: str) -> DataFrame:
    """The table's columns in order and type, and the ordinal."""
    columns = [
        f"cast({values[f.name]} as {f.dataType.simpleString()}) as {f.name}"
        for f in TABLES[table].schema
    ]
    return df.selectExpr(*columns, ORDINAL)


def region(ids: DataFrame, sizes: Sizes | None = None, seed: int = SEED) -> DataFrame:
    df = with_columns(with_state(ids, "id", "region", seed), **{ORDINAL: "id"})
    return _shape(
        df, "region",
        r_regionkey="id",
        r_name=pick(words.REGIONS, "id"),
        r_comment=_comment(state("region"), 31, 115),
    )


def nation(ids: DataFrame, sizes: Sizes | None = None, seed: int = SEED) -> DataFrame:
    df = with_columns(with_state(ids, "id", "nation", seed), **{ORDINAL: "id"})
    return _shape(
        df, "nation",
        n_nationkey="id",
        n_name=pick([name for name, _ in words.NATIONS], "id"),
        n_regionkey=pick([str(region) for _, region in words.NATIONS], "id"),
        n_comment=_comment(state("nation"), 31, 114),
    )


def supplier(ids: DataFrame, sizes: Sizes, seed: int = SEED) -> DataFrame:
    of = state("supplier")
    nation = draw(of, "nation", len(words.NATIONS))
    df = with_columns(with_state(ids, "id", "supplier", seed), **{ORDINAL: "id - 1"})
    return _shape(
        df, "supplier",
        s_suppkey="id",
        s_name=f"concat('Supplier#', {_digits('id', 9)})",
        s_address=_address(of),
        s_nationkey=nation,
        s_phone=_phone(of, nation),
        s_acctbal=_balance(of),
        s_comment=_comment(of, 25, 100),
    )


def customer(ids: DataFrame, sizes: Sizes, seed: int = SEED) -> DataFrame:
    of = state("customer")
    nation = draw(of, "nation", len(words.NATIONS))
    df = with_columns(with_state(ids, "id", "customer", seed), **{ORDINAL: "id - 1"})
    return _shape(
        df, "customer",
        c_custkey="id",
        c_name=f"concat('Customer#', {_digits('id', 9)})",
        c_address=_address(of),
        c_nationkey=nation,
        c_phone=_phone(of, nation),
        c_acctbal=_balance(of),
        c_mktsegment=_pick(of, "segment", words.SEGMENTS),
        c_comment=_comment(of, 29, 116),
    )


def _part_cents(partkey: str) -> str:
    return f"({mod(div(partkey, 10), 20_001)} + {mod(partkey, 1000)} * 100L + 90000L)"


def _supplier_of(partkey: str, slot: str, suppliers: int) -> str:
    """The slot-th (0..3) of the four suppliers of a part."""
    stride = f"({div(f'{partkey} - 1', suppliers)} + {suppliers // 4}L)"
    return f"({mod(f'{partkey} + {slot} * {stride}', suppliers)} + 1)"


def _with_colors(df: DataFrame, of: State) -> DataFrame:
    """Different colors, any set of them as likely as any other.

    Each is drawn from one more color than the one before; if it was drawn
    already, the color that has just been added is taken.
    """
    first = len(words.COLORS) - COLORS_PER_PART
    for i in range(COLORS_PER_PART):
        number, added = draw(of, f"color{i}", first + i + 1), first + i
        before = ", ".join(f"_color{j}" for j in range(i))
        df = with_columns(df, **{f"_drawn{i}": number})
        chosen = f"if(_drawn{i} in ({before}), {added}L, _drawn{i})" if i else "_drawn0"
        df = with_columns(df, **{f"_color{i}": chosen})
    return df


def part(ids: DataFrame, sizes: Sizes, seed: int = SEED) -> DataFrame:
    of = state("part")
    colors = [pick(words.COLORS, f"_color{i}") for i in range(COLORS_PER_PART)]
    maker = f"cast({draw(of, 'maker', 5, 1)} as string)"
    brand = f"cast({draw(of, 'brand', 5, 1)} as string)"
    kind = [
        _pick(of, "grade", words.TYPE_GRADES),
        _pick(of, "finish", words.TYPE_FINISHES),
        _pick(of, "metal", words.TYPE_METALS),
    ]
    box = [_pick(of, "box", words.CONTAINER_SIZES), _pick(of, "kind", words.CONTAINER_KINDS)]
    df = with_columns(with_state(ids, "id", "part", seed), **{ORDINAL: "id - 1"})
    df = _with_colors(df, of)
    return _shape(
        df, "part",
        p_partkey="id",
        p_name=f"concat_ws(' ', {', '.join(colors)})",
        p_mfgr=f"concat('Manufacturer#', {maker})",
        p_brand=f"concat('Brand#', {maker}, {brand})",
        p_type=f"concat_ws(' ', {', '.join(kind)})",
        p_size=draw(of, "size", 50, 1),
        p_container=f"concat_ws(' ', {', '.join(box)})",
        p_retailprice=_money(_part_cents("id")),
        p_comment=_comment(of, 5, 22),
    )


def partsupp(ids: DataFrame, sizes: Sizes, seed: int = SEED) -> DataFrame:
    line = state("line")
    df = with_state(ids, "id", "partsupp", seed)
    df = with_columns(df, _slot="explode(array(0L, 1L, 2L, 3L))")
    df = with_line_state(df, "partsupp", "_slot")
    df = with_columns(df, **{ORDINAL: "(id - 1) * 4 + _slot"})
    return _shape(
        df, "partsupp",
        ps_partkey="id",
        ps_suppkey=_supplier_of("id", "_slot", sizes.supplier),
        ps_availqty=draw(line, "quantity", 9999, 1),
        ps_supplycost=_money(draw(line, "cost", 99_901, 100)),
        ps_comment=_comment(line, 49, 198),
    )


def order_lines(ids: DataFrame, seed: int = SEED) -> DataFrame:
    """Per order, the number of its lines and the ordinal of the first one.

    Seven consecutive orders have a drawn permutation of 1..7 lines, 28 in
    all, so the lines before any order are known without counting them.
    """
    block = state("lines")
    df = with_columns(ids, _block=div("id - 1", MAX_LINES), _pos=mod("id - 1", MAX_LINES))
    df = with_state(df, "_block", "lines", seed)
    df = with_columns(
        df,
        _step=draw(block, "step", MAX_LINES - 1, 1),
        _shift=draw(block, "shift", MAX_LINES),
    )

    def lines_at(pos: int | str) -> str:
        return f"({mod(f'_step * {pos} + _shift', MAX_LINES)} + 1)"

    before = [f"if(_pos > {pos}, {lines_at(pos)}, 0L)" for pos in range(MAX_LINES - 1)]
    return with_columns(
        df,
        _lines=lines_at("_pos"),
        _first=f"_block * {LINES_PER_BLOCK}L + {' + '.join(before)}",
    )


def _order_base(ids: DataFrame, seed: int) -> DataFrame:
    df = with_state(order_lines(ids, seed), "id", "orders", seed)
    return with_columns(
        df,
        _orderkey="shiftleft(shiftright(id, 3), 5) | (id & 7L)",
        _day=draw(state("orders"), "date", ORDER_DAYS),
    )


def _date(day: str) -> str:
    return f"date_add(date'{FIRST_DATE}', cast({day} as int))"


def _line_part(line: State, sizes: Sizes) -> str:
    return state_draw(line, sizes.part, 1)


def _line_price(line: State, partkey: str) -> str:
    return f"{draw(line, 'quantity', 50, 1)} * {_part_cents(partkey)}"


def _line_ship_day(line: State) -> str:
    return f"(_day + {draw(line, 'ship', 121, 1)})"


def orders(ids: DataFrame, sizes: Sizes, seed: int = SEED) -> DataFrame:
    """Status and total come from the draws of the order's own lines.

    All seven lines an order may have are drawn side by side in its row and the
    first ``_lines`` of them count, so nothing is exploded or shuffled.
    """
    order = state("orders")
    lines = {n: state(f"line{n}_") for n in range(1, MAX_LINES + 1)}
    states: dict[str, str] = {}
    for n, line in lines.items():
        states.update(zip(line, fixed_line_state(order, n)))
    df = with_columns(_order_base(ids, seed), **{ORDINAL: "id - 1", **states})
    drawn = {f"_part{n}": _line_part(line, sizes) for n, line in lines.items()}
    drawn.update({f"_ship{n}": _line_ship_day(line) for n, line in lines.items()})
    df = with_columns(df, **drawn)

    charges = []
    for n, line in lines.items():
        discount, tax = draw(line, "discount", 11), draw(line, "tax", 9)
        charge = f"{_line_price(line, f'_part{n}')} * (100 - {discount}) * (100 + {tax})"
        charges.append(f"if(_lines >= {n}, {charge}, 0L)")
    ship_days = ", ".join(f"_ship{n}" for n in lines)
    shipped = f"slice(array({ship_days}), 1, cast(_lines as int))"
    df = with_columns(
        df,
        _total=" + ".join(charges),
        _open=f"size(filter({shipped}, day -> day > {CURRENT_DAY}))",
    )
    # Customers whose key is divisible by 3 have no orders.
    buyer = key_draw(order, "customer", sizes.customer - sizes.customer // 3)
    return _shape(
        df, "orders",
        o_orderkey="_orderkey",
        o_custkey=f"{div(buyer, 2)} * 3 + {mod(buyer, 2)} + 1",
        o_orderstatus="case when _open = 0 then 'F' when _open = _lines then 'O' else 'P' end",
        o_totalprice=_money(div("_total + 5000L", 10_000)),
        o_orderdate=_date("_day"),
        o_orderpriority=_pick(order, "priority", words.PRIORITIES),
        o_clerk=f"concat('Clerk#', {_digits(key_draw(order, 'clerk', sizes.clerks, 1), 9)})",
        o_shippriority="0",
        o_comment=_comment(order, 19, 78),
    )


def lineitem(ids: DataFrame, sizes: Sizes, seed: int = SEED) -> DataFrame:
    line = state("line")
    df = with_columns(_order_base(ids, seed), _number="explode(sequence(1L, _lines))")
    df = with_line_state(df, "orders", "_number")
    df = with_columns(
        df,
        _part=_line_part(line, sizes),
        _ship=_line_ship_day(line),
        **{ORDINAL: "_first + _number - 1"},
    )
    df = with_columns(df, _receipt=f"_ship + {draw(line, 'receipt', 30, 1)}")
    flag = _pick(line, "flag", ["A", "R"])
    return _shape(
        df, "lineitem",
        l_orderkey="_orderkey",
        l_partkey="_part",
        l_suppkey=_supplier_of("_part", draw(line, "slot", 4), sizes.supplier),
        l_linenumber="_number",
        l_quantity=draw(line, "quantity", 50, 1),
        l_extendedprice=_money(_line_price(line, "_part")),
        l_discount=_money(draw(line, "discount", 11)),
        l_tax=_money(draw(line, "tax", 9)),
        l_returnflag=f"case when _receipt <= {CURRENT_DAY} then {flag} else 'N' end",
        l_linestatus=f"case when _ship > {CURRENT_DAY} then 'O' else 'F' end",
        l_shipdate=_date("_ship"),
        l_commitdate=_date(f"_day + {draw(line, 'commit', 61, 30)}"),
        l_receiptdate=_date("_receipt"),
        l_shipinstruct=_pick(line, "instruct", words.INSTRUCTIONS),
        l_shipmode=_pick(line, "mode", words.MODES),
        l_comment=_comment(line, 10, 43),
    )


BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "region": region,
    "nation": nation,
    "supplier": supplier,
    "customer": customer,
    "part": part,
    "partsupp": partsupp,
    "orders": orders,
    "lineitem": lineitem,
}


def id_range(spark: SparkSession, table: str, first: int, end: int) -> DataFrame:
    """Ids first..end-1, split so that a task's share does not grow with the table."""
    per_task = IDS_PER_TASK.get(table, DEFAULT_IDS_PER_TASK)
    tasks = math.ceil(max(end - first, 1) / per_task)
    small = math.ceil(max(end - first, 1) / 10_000)
    return spark.range(first, end, 1, max(tasks, min(spark.sparkContext.defaultParallelism, small)))


def slice_bounds(ids: range, part: int, parts: int) -> tuple[int, int]:
    """First and end id of slice ``part`` of ``parts``, counted from 1."""
    if not 1 <= part <= parts:
        raise ValueError(f"no slice {part} of {parts}")
    n = len(ids)
    return ids.start + n * (part - 1) // parts, ids.start + n * part // parts


def generate(
    spark: SparkSession,
    table: str,
    sizes: Sizes,
    part: int = 1,
    parts: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """One slice of a table; by default the whole of it."""
    first, end = slice_bounds(sizes.ids(table), part, parts)
    ids = id_range(spark, table, first, end)
    return BUILDERS[table](ids, sizes, seed).drop(ORDINAL)


def row_count(spark: SparkSession, table: str, sizes: Sizes, seed: int = SEED) -> int:
    """Rows of a table, without generating it."""
    n = len(sizes.ids(table))
    if table == "partsupp":
        return n * 4
    if table == "lineitem":
        last = order_lines(spark.range(n, n + 1, 1, 1), seed)
        return last.select(F.col("_first") + F.col("_lines")).first()[0]
    return n


def rows_between(
    spark: SparkSession, table: str, sizes: Sizes, low: int, high: int, seed: int = SEED
) -> DataFrame:
    """The rows with ordinals low..high-1, with the ordinal, from their ids alone."""
    ids = sizes.ids(table)
    if table == "partsupp":
        first, end = low // 4 + 1, (high - 1) // 4 + 2
    elif table == "lineitem":
        first = low // LINES_PER_BLOCK * MAX_LINES + 1
        end = ((high - 1) // LINES_PER_BLOCK + 1) * MAX_LINES + 1
    else:
        first, end = ids.start + low, ids.start + high
    rows = BUILDERS[table](id_range(spark, table, first, min(end, ids.stop)), sizes, seed)
    if table not in ("partsupp", "lineitem"):
        return rows
    return rows.where((F.col(ORDINAL) >= low) & (F.col(ORDINAL) < high))
