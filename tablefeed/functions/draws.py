"""Repeatable draws: every value is a pure function of (seed, stream, key).

A row's key is mixed once into two 31-bit state columns. A draw multiplies the
two by constants of its own, takes the middle bits of the sum and scales them
to the wanted range. Everything is integer arithmetic below 2**63: it cannot
overflow, never yields null, stays inside generated code, and gives the same
rows for any partitioning, retry or slice of a table.

Draws are SQL expressions as text, to be composed and given to ``selectExpr``.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 2**31 - 1
SEED = 42


def constant(name: str, bits: int) -> int:
    """A fixed odd number below 2**bits, told apart by its name."""
    return zlib.crc32(name.encode()) % (1 << bits) | 1


# Multipliers of the two state columns, and the shift before each
# mixing step.
HIGH_BITS = (536870909, 402653189)
LOW_BITS = (805306457, 1073741789)
MIX_STEPS = ((15, (1597334677, 1935289751)), (13, (1268118805, 1812433253)))
DRAW_SHIFT = 16

# Four multipliers for each line number from 0 to 7.
LINE_MULTIPLIERS = [[constant(f"line {j}/{n}", 30) for n in range(4)] for j in range(8)]


def known(value: str) -> str:
    """A value that is never null, said so that later code needs no null checks.

    Spark takes any division or array access for nullable; null checks on all
    that follows would make a row's code too long for the JVM to compile.
    """
    return f"coalesce({value}, 0L)"


def div(left: str, right: int) -> str:
    return known(f"(({left}) div {right}L)")


def mod(left: str, right: int) -> str:
    return known(f"(({left}) % {right}L)")


class State(NamedTuple):
    """The two state columns that draws are made from."""

    first: str
    second: str


def state(stream: str) -> State:
    return State(f"_{stream}1", f"_{stream}2")


def with_columns(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def with_state(df: DataFrame, key: str, stream: str, seed: int = SEED) -> DataFrame:
    """Add the state columns of a stream for the key, which must be 0 or more.

    Three projections rather than one: each step uses its input twice, and one
    nested expression would double in size at every step.
    """
    cols = state(stream)
    salts = [constant(f"{seed}/{stream}/{n}", 31) for n in (1, 2)]
    first = {
        c: f"(shiftright({key}, 31) * {high}L + ({key} & {MASK}L) * {low}L + {salt}L) & {MASK}L"
        for c, high, low, salt in zip(cols, HIGH_BITS, LOW_BITS, salts)
    }
    df = with_columns(df, **first)
    for shift, multipliers in MIX_STEPS:
        step = {
            c: f"(({c} ^ shiftright({c}, {shift})) * {m}L) & {MASK}L"
            for c, m in zip(cols, multipliers)
        }
        df = with_columns(df, **step)
    return df


def middle_bits(of: State, left: int | str, right: int | str) -> str:
    return f"(shiftright({of.first} * {left} + {of.second} * {right}, {DRAW_SHIFT}) & {MASK}L)"


def fixed_line_state(of: State, line: int) -> State:
    """The state of one line (numbered 0 to 7) of a row."""
    a, b, c, d = (f"{m}L" for m in LINE_MULTIPLIERS[line])
    return State(middle_bits(of, a, b), middle_bits(of, c, d))


def with_line_state(df: DataFrame, stream: str, line: str) -> DataFrame:
    """The same for a line number in a column, as ``_line1`` and ``_line2``."""

    def multiplier(n: int) -> str:
        values = ", ".join(f"{quad[n]}L" for quad in LINE_MULTIPLIERS)
        return f"array({values})[cast({line} as int)]"

    of = state(stream)
    return with_columns(
        df,
        _line1=known(middle_bits(of, multiplier(0), multiplier(1))),
        _line2=known(middle_bits(of, multiplier(2), multiplier(3))),
    )


def raw_draw(of: State, name: str) -> str:
    """A number in [0, 2**31)."""
    return middle_bits(of, f"{constant(f'{name}/a', 30)}L", f"{constant(f'{name}/b', 30)}L")


def draw(of: State, name: str, n: int, start: int = 0) -> str:
    """A number in [start, start + n), for n up to 2**31."""
    value = f"shiftright({raw_draw(of, name)} * {n}L, 31)"
    return f"({value} + {start}L)" if start else value


def key_draw(of: State, name: str, n: int, start: int = 0) -> str:
    """A number in [start, start + n) for n up to 2**62, for keys of tables of any size."""
    if n <= MASK:
        return draw(of, name, n, start)
    wide = f"{raw_draw(of, f'{name}/high')} * {MASK + 1}L + {raw_draw(of, f'{name}/low')}"
    return f"({mod(wide, n)} + {start}L)"


def state_draw(of: State, n: int, start: int = 0) -> str:
    """A number in [start, start + n) from the state as it is: one per state, n up to 2**62.

    Its code is as short for any n, for rows that need many such draws.
    """
    return f"({mod(f'{of.first} * {MASK + 1}L + {of.second}', n)} + {start}L)"


def pick(values: list[str], index: str) -> str:
    """The value at a zero-based index into a fixed list."""
    return f"split('{'|'.join(values)}', '[|]')[cast({index} as int)]"


def range_number(column: str, width: int) -> Column:
    """Which range of ``width`` consecutive numbers a value is in."""
    return F.expr(div(column, width))
