"""Table specifications: columns, primary keys, comment columns, selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG, INT, TEXT, DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()
MONEY = T.DecimalType(15, 2)


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    pk: tuple[str, ...]
    comment: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def payload(self) -> list[str]:
        return [c for c in self.columns if c not in self.pk]

    @classmethod
    def of(cls, df: DataFrame, name: str, pk: tuple[str, ...], comment: str | None = None):
        """Specification of a table that is not one of the eight."""
        return cls(name, df.schema, tuple(pk), comment)


def _table(name: str, pk: str, comment: str, **columns: T.DataType) -> TableSpec:
    schema = T.StructType([T.StructField(c, t, nullable=False) for c, t in columns.items()])
    return TableSpec(name, schema, tuple(pk.split()), comment)


# The eight tables in load order.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        _table("region", "r_regionkey", "r_comment", r_regionkey=LONG, r_name=TEXT, r_comment=TEXT),
        _table(
            "nation", "n_nationkey", "n_comment",
            n_nationkey=LONG, n_name=TEXT, n_regionkey=LONG, n_comment=TEXT,
        ),
        _table(
            "supplier", "s_suppkey", "s_comment",
            s_suppkey=LONG, s_name=TEXT, s_address=TEXT, s_nationkey=LONG, s_phone=TEXT,
            s_acctbal=MONEY, s_comment=TEXT,
        ),
        _table(
            "customer", "c_custkey", "c_comment",
            c_custkey=LONG, c_name=TEXT, c_address=TEXT, c_nationkey=LONG, c_phone=TEXT,
            c_acctbal=MONEY, c_mktsegment=TEXT, c_comment=TEXT,
        ),
        _table(
            "part", "p_partkey", "p_comment",
            p_partkey=LONG, p_name=TEXT, p_mfgr=TEXT, p_brand=TEXT, p_type=TEXT, p_size=INT,
            p_container=TEXT, p_retailprice=MONEY, p_comment=TEXT,
        ),
        _table(
            "partsupp", "ps_partkey ps_suppkey", "ps_comment",
            ps_partkey=LONG, ps_suppkey=LONG, ps_availqty=INT, ps_supplycost=MONEY, ps_comment=TEXT,
        ),
        _table(
            "orders", "o_orderkey", "o_comment",
            o_orderkey=LONG, o_custkey=LONG, o_orderstatus=TEXT, o_totalprice=MONEY,
            o_orderdate=DATE, o_orderpriority=TEXT, o_clerk=TEXT, o_shippriority=INT, o_comment=TEXT,
        ),
        _table(
            "lineitem", "l_orderkey l_linenumber", "l_comment",
            l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=MONEY,
            l_extendedprice=MONEY, l_discount=MONEY, l_tax=MONEY, l_returnflag=TEXT,
            l_linestatus=TEXT, l_shipdate=DATE, l_commitdate=DATE, l_receiptdate=DATE,
            l_shipinstruct=TEXT, l_shipmode=TEXT, l_comment=TEXT,
        ),
    )
}


def select_tables(choice: str) -> list[TableSpec]:
    """``"all"``, or a comma-separated list of table names in the order to use.

    Names are trimmed and case does not matter, but the word ``all`` must stand
    alone and in lower case.
    """
    if choice == "all":
        return list(TABLES.values())
    chosen: dict[str, TableSpec] = {}
    for name in (part.strip().lower() for part in choice.split(",")):
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}; the tables are {', '.join(TABLES)}")
        if name in chosen:
            raise ValueError(f"table {name!r} is named twice")
        chosen[name] = TABLES[name]
    return list(chosen.values())


def primary_key(table: str) -> tuple[str, ...]:
    return TABLES[table].pk


def comment_column(table: str) -> str | None:
    return TABLES[table].comment
