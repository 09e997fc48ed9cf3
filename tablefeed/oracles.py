"""The queries again, as SQL for another engine to compare results with.

Nothing here runs on Spark. The draws of generated rows are written out anew
in that engine's SQL; only the fixed values are shared.
"""

from __future__ import annotations

import math

from tablefeed.functions.draws import HIGH_BITS, LINE_MULTIPLIERS, LOW_BITS, MIX_STEPS, constant
from tablefeed.sources import words

M = 2147483647
NOW = "2024-01-01 00:00:00.000"

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
LINE_PAYLOAD = (
    "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_shipdate"
)
UNIQUE_LINES = f"""
    SELECT * EXCLUDE (place) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY {", ".join(c + " DESC" for c in LINE_PAYLOAD.split(", "))}) AS place
        FROM lineitem)
    WHERE place = 1"""

ORDER_CHANGES = """
    SELECT o_orderkey * 2 AS o_orderkey, o_custkey, o_orderstatus,
           o_totalprice + 100 AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders"""
DOCUMENT_CHANGES = """
    SELECT doc_id * 2 AS doc_id, 'new ' || text AS text, lang, source, n_chars FROM documents"""

UPSERT_ORDERS = f"""
WITH c AS ({ORDER_CHANGES})
SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)
UNION ALL SELECT {ORDER_COLUMNS} FROM c"""

UPSERT_MARKER_DOCUMENTS = f"""
WITH c AS ({DOCUMENT_CHANGES})
SELECT doc_id, text, lang, source, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM c)
UNION ALL
SELECT c.doc_id,
       CASE WHEN t.doc_id IS NULL THEN c.text ELSE left(c.text, 40) || ' CDC:{NOW}' END AS text,
       c.lang, c.source, c.n_chars
FROM c LEFT JOIN documents t ON t.doc_id = c.doc_id"""

UPSERT_LINEITEM = f"""
WITH t AS ({UNIQUE_LINES}),
c AS (SELECT * REPLACE (l_orderkey * 2 AS l_orderkey, l_quantity + 1 AS l_quantity) FROM t)
SELECT t.* FROM t ANTI JOIN c USING (l_orderkey, l_linenumber)
UNION ALL SELECT * FROM c"""

UPSERT_RAW_LINEITEM = f"""
WITH c AS (SELECT * REPLACE (l_quantity + 1 AS l_quantity) FROM ({UNIQUE_LINES}) WHERE l_linenumber <= 3)
SELECT t.* FROM lineitem t ANTI JOIN c USING (l_orderkey, l_linenumber)
UNION ALL SELECT * FROM c"""

UPSERT_COUNTS = f"""
WITH c AS ({ORDER_CHANGES})
SELECT count(*) FILTER (t.o_orderkey IS NULL) AS inserted_rows,
       count(*) FILTER (t.o_orderkey IS NOT NULL AND c.o_orderkey IS NOT NULL) AS updated_rows,
       count(*) FILTER (c.o_orderkey IS NULL) AS kept_rows
FROM orders t FULL JOIN c ON t.o_orderkey = c.o_orderkey"""

LATEST_EVENT = """
SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
    FROM events)
WHERE place = 1"""

DUPLICATE_KEYS = """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY ALL HAVING count(*) > 1"""

NULLED = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "nullif(o_orderstatus, 'P')",
    "o_totalprice": "CASE WHEN o_totalprice > 1000 THEN o_totalprice END",
    "o_orderdate": "o_orderdate",
    "o_orderpriority": "nullif(o_orderpriority, '5-LOW')",
}
NULL_VIOLATIONS = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS column_name, count(*) FILTER (({value}) IS NULL) AS null_rows FROM orders"
    for name, value in NULLED.items()
)

BATCHES_ORDERS = """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_no FROM orders"""

BATCHES_LINEITEM = f"""
SELECT l_orderkey, l_linenumber,
       (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 1000 AS batch_no
FROM ({UNIQUE_LINES})"""

REPLAY_ORDERS = f"""
WITH b AS ({BATCHES_ORDERS}),
t AS (SELECT unnest(range(2 * n + 1)) AS tick, n FROM (SELECT max(batch_no) + 1 AS n FROM b))
SELECT tick, batch_no, {ORDER_COLUMNS} FROM t JOIN b ON batch_no = tick % n
JOIN orders USING (o_orderkey)"""

BATCH_PLAN = """
WITH p(table_name, rate, batch_rows, source_rows) AS (
    SELECT 'lineitem', 5001::BIGINT, 500::BIGINT, count(*) FROM lineitem
    UNION ALL SELECT 'orders', 5000, 500, count(*) FROM orders)
SELECT table_name, rate, batch_rows, batch_rows::DOUBLE / rate AS interval_seconds, source_rows,
       (source_rows + batch_rows - 1) // batch_rows AS batches_per_pass,
       source_rows - ((source_rows - 1) // batch_rows) * batch_rows AS last_batch_rows
FROM p"""

ENCODE_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       o_totalprice::DECIMAL(15,2)::VARCHAR AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders"""

REJECTS_ORDERS = f"""
SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE o_totalprice END AS o_totalprice,
                  CASE WHEN o_orderkey % 11 = 0 THEN '1995-02-30' ELSE o_orderdate END AS o_orderdate)
FROM ({ENCODE_ORDERS}) WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0"""

GIVEN_ORDERS = f"SELECT {ORDER_COLUMNS} FROM orders"

SNAPSHOT_REPORT = "\nUNION ALL\n".join(
    [
        f"SELECT '{t}' AS table_name, count(*) AS loaded_rows, FALSE AS failed FROM {t}"
        for t in ("region", "nation", "supplier", "customer", "part", "orders")
    ]
    + [
        """SELECT 'lineitem', CASE WHEN dup = 0 THEN n END, dup > 0 FROM (
            SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dup
            FROM lineitem)"""
    ]
)


# -- change feeds ---------------------------------------------------------------


def feed_sql(table: str, key: str, changes: str, comment: str, rest: str, size: int) -> str:
    """One and a half passes in three sets: the last change of a key wins."""
    return f"""
WITH c AS ({changes}),
o AS (SELECT *, (row_number() OVER (ORDER BY {key}) - 1) // {size} AS b FROM c),
s AS (SELECT nb, nb * 3 // 2 AS ticks, (nb * 3 // 2 + 2) // 3 AS per_set
      FROM (SELECT max(b) + 1 AS nb FROM o)),
a AS (SELECT o.*, CASE WHEN b + nb < ticks THEN b + nb ELSE b END AS last_tick,
             b + nb < ticks AS twice, per_set FROM o, s WHERE b < ticks),
m AS (SELECT a.*, twice OR t.{key} IS NOT NULL AS hit,
             ' CDC:2024-01-01 00:00:0' || (last_tick // per_set)::VARCHAR || '.000' AS marker
      FROM a LEFT JOIN {table} t ON t.{key} = a.{key})
SELECT {key}, {comment}, {rest} FROM {table} t
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.{key} = t.{key})
UNION ALL
SELECT {key}, CASE WHEN hit THEN left({comment}, 40) || marker ELSE {comment} END, {rest} FROM m"""


# -- generated tables -----------------------------------------------------------


def states(source: str, key: str, stream: str, a: str, b: str) -> str:
    """Rows of ``source`` with the two state columns of a stream added."""
    salt = [constant(f"42/{stream}/{n}", 31) for n in (1, 2)]

    def start(i: int) -> str:
        return f"(({key} >> 31) * {HIGH_BITS[i]} + ({key} & {M}) * {LOW_BITS[i]} + {salt[i]}) & {M}"

    sql = f"SELECT *, {start(0)} AS {a}, {start(1)} AS {b} FROM ({source})"
    for shift, (ma, mb) in MIX_STEPS:
        sql = (
            f"SELECT * REPLACE ((xor({a}, {a} >> {shift}) * {ma}) & {M} AS {a}, "
            f"(xor({b}, {b} >> {shift}) * {mb}) & {M} AS {b}) FROM ({sql})"
        )
    return sql


def middle(a: str, b: str, left: object, right: object) -> str:
    return f"((({a} * {left} + {b} * {right}) >> 16) & {M})"


def line_states(source: str, a: str, b: str, line: str) -> str:
    lists = [f"([{', '.join(str(q[i]) for q in LINE_MULTIPLIERS)}])[{line} + 1]" for i in range(4)]
    return (
        f"SELECT *, {middle(a, b, lists[0], lists[1])} AS l1, "
        f"{middle(a, b, lists[2], lists[3])} AS l2 FROM ({source})"
    )


class Draws:
    """Draw expressions over two state columns."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = a, b

    def number(self, name: str, n: object) -> str:
        raw = middle(self.a, self.b, constant(f"{name}/a", 30), constant(f"{name}/b", 30))
        return f"(({raw} * {n}) >> 31)"

    def one_of(self, name: str, values: list[str]) -> str:
        return chosen(values, self.number(name, len(values)))

    def comment(self, low: int, high: int) -> str:
        pieces = words.SENTENCES if high > 50 else words.PHRASES
        n = math.ceil((high + words.STARTS) / (min(map(len, pieces)) + 1))
        parts = " || ' ' || ".join(self.one_of(f"phrase{i}", pieces) for i in range(n))
        start = f"{self.number('comment start', words.STARTS)} + 1"
        length = f"{self.number('comment length', high - low + 1)} + {low}"
        return f"substr({parts}, {start}, {length})"

    def address(self) -> str:
        alphabets = ["aQmX3 kRt9", "Zb7,Lw Hd2", "pF5oGy8,Us", "eJ NcV1iT4"]
        parts = []
        for i, alphabet in enumerate(alphabets):
            high, low = (
                middle(
                    self.a,
                    self.b,
                    constant(f"address{i}/{part}/a", 30),
                    constant(f"address{i}/{part}/b", 30),
                )
                for part in ("high", "low")
            )
            digits = f"lpad((({high} * {M + 1} + {low}) % 10000000000)::VARCHAR, 10, '0')"
            parts.append(f"translate({digits}, '0123456789', '{alphabet}')")
        return f"left({' || '.join(parts)}, {self.number('address length', 31)} + 10)"

    def phone(self, nation: str) -> str:
        return (
            f"({nation} + 10) || '-' || ({self.number('phone1', 900)} + 100) || '-' || "
            f"({self.number('phone2', 900)} + 100) || '-' || ({self.number('phone3', 9000)} + 1000)"
        )


def chosen(values: list[str], index: str) -> str:
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"([{quoted}])[({index}) + 1]"


def money(cents: str) -> str:
    return f"(({cents}) * 0.01::DECIMAL(3,2))::DECIMAL(15,2)::VARCHAR"


def day(number: str) -> str:
    return f"strftime(DATE '1992-01-01' + ({number})::INTEGER, '%Y-%m-%d')"


SUPPLIERS, CUSTOMERS, PARTS, ORDERS = (
    f"(SELECT count(*) FROM {t})" for t in ("supplier", "customer", "part", "orders")
)
PART_CENTS = "(90000 + (({0} // 10) % 20001) + 100 * ({0} % 1000))"
OFFERED_BY = (
    f"(({{0}} + {{1}} * ({SUPPLIERS} // 4 + ({{0}} - 1) // {SUPPLIERS})) % {SUPPLIERS} + 1)"
)


def gen_nation() -> str:
    d = Draws("s1", "s2")
    names = [name for name, _ in words.NATIONS]
    regions = ", ".join(str(r) for _, r in words.NATIONS)
    rows = states("SELECT unnest(range(25)) AS id", "id", "nation", "s1", "s2")
    return f"""
SELECT c_custkey, id AS n_nationkey, {chosen(names, "id")} AS n_name,
       ([{regions}])[id + 1]::BIGINT AS n_regionkey, {d.comment(31, 114)} AS n_comment
FROM customer JOIN ({rows}) ON c_nationkey = id"""


def gen_region() -> str:
    d = Draws("s1", "s2")
    regions = ", ".join(str(r) for _, r in words.NATIONS)
    rows = states("SELECT unnest(range(5)) AS id", "id", "region", "s1", "s2")
    return f"""
SELECT c_custkey, id AS r_regionkey, {chosen(words.REGIONS, "id")} AS r_name,
       {d.comment(31, 115)} AS r_comment
FROM customer JOIN ({rows}) ON ([{regions}])[c_nationkey + 1] = id"""


def gen_supplier() -> str:
    d = Draws("s1", "s2")
    rows = states("SELECT s_suppkey + 1 AS id FROM supplier", "id", "supplier", "s1", "s2")
    nation = d.number("nation", 25)
    return f"""
SELECT id AS s_suppkey, 'Supplier#' || lpad(id::VARCHAR, 9, '0') AS s_name,
       {d.address()} AS s_address, {nation} AS s_nationkey, {d.phone(nation)} AS s_phone,
       {money(d.number("balance", 1099999) + " - 99999")} AS s_acctbal,
       {d.comment(25, 100)} AS s_comment, id - 1 AS row_ordinal
FROM ({rows})"""


def gen_customer() -> str:
    d = Draws("s1", "s2")
    rows = states("SELECT c_custkey + 1 AS id FROM customer", "id", "customer", "s1", "s2")
    nation = d.number("nation", 25)
    return f"""
SELECT id AS c_custkey, 'Customer#' || lpad(id::VARCHAR, 9, '0') AS c_name,
       {d.address()} AS c_address, {nation} AS c_nationkey, {d.phone(nation)} AS c_phone,
       {money(d.number("balance", 1099999) + " - 99999")} AS c_acctbal,
       {d.one_of("segment", words.SEGMENTS)} AS c_mktsegment,
       {d.comment(29, 116)} AS c_comment, id - 1 AS row_ordinal
FROM ({rows})"""


def gen_part() -> str:
    d = Draws("s1", "s2")
    rows = states("SELECT p_partkey + 1 AS id FROM part", "id", "part", "s1", "s2")
    for i, n in enumerate((88, 89, 90, 91, 92)):
        drawn = d.number(f"color{i}", n)
        before = [f"{drawn} = c{j}" for j in range(i)] or ["false"]
        rows = f"SELECT *, CASE WHEN {' OR '.join(before)} THEN {n - 1} ELSE {drawn} END AS c{i} FROM ({rows})"
    colors = [chosen(words.COLORS, f"c{i}") for i in range(5)]
    maker = f"({d.number('maker', 5)} + 1)"
    return f"""
SELECT id AS p_partkey, {" || ' ' || ".join(colors)} AS p_name,
       'Manufacturer#' || {maker} AS p_mfgr,
       'Brand#' || {maker} || ({d.number("brand", 5)} + 1) AS p_brand,
       {d.one_of("grade", words.TYPE_GRADES)} || ' ' || {d.one_of("finish", words.TYPE_FINISHES)}
           || ' ' || {d.one_of("metal", words.TYPE_METALS)} AS p_type,
       ({d.number("size", 50)} + 1)::INTEGER AS p_size,
       {d.one_of("box", words.CONTAINER_SIZES)} || ' '
           || {d.one_of("kind", words.CONTAINER_KINDS)} AS p_container,
       {money(PART_CENTS.format("id"))} AS p_retailprice,
       {d.comment(5, 22)} AS p_comment, id - 1 AS row_ordinal
FROM ({rows})"""


def gen_partsupp() -> str:
    d = Draws("l1", "l2")
    rows = states("SELECT p_partkey + 1 AS id FROM part", "id", "partsupp", "s1", "s2")
    slots = f"SELECT *, unnest(range(4)) AS slot FROM ({rows})"
    return f"""
SELECT id AS ps_partkey, {OFFERED_BY.format("id", "slot")} AS ps_suppkey,
       ({d.number("quantity", 9999)} + 1)::INTEGER AS ps_availqty,
       {money(d.number("cost", 99901) + " + 100")} AS ps_supplycost,
       {d.comment(49, 198)} AS ps_comment, (id - 1) * 4 + slot AS row_ordinal
FROM ({line_states(slots, "s1", "s2", "slot")})"""


def order_lines() -> str:
    """Every line of every generated order, with the state of the order and of the line."""
    block = Draws("b1", "b2")
    ids = "SELECT o_orderkey + 1 AS id, o_orderkey // 7 AS block, o_orderkey % 7 AS pos FROM orders"
    blocks = states(ids, "block", "lines", "b1", "b2")
    sized = (
        f"SELECT *, {block.number('step', 6)} + 1 AS step, {block.number('shift', 7)} AS shift "
        f"FROM ({blocks})"
    )
    counted = f"""
        SELECT *, 1 + (step * pos + shift) % 7 AS n_lines,
               block * 28 + list_sum([1 + (step * q + shift) % 7 FOR q IN range(pos)] || [0])
                   AS first_line
        FROM ({sized})"""
    rows = states(counted, "id", "orders", "s1", "s2")
    based = f"""
        SELECT *, ((id >> 3) << 5) | (id & 7) AS orderkey,
               {Draws("s1", "s2").number("date", 2406)} AS odate,
               unnest(range(1, n_lines + 1)) AS line
        FROM ({rows})"""
    d = Draws("l1", "l2")
    drawn = f"""
        SELECT *, (l1 * {M + 1} + l2) % {PARTS} + 1 AS part, {d.number("quantity", 50)} + 1 AS quantity,
               {d.number("discount", 11)} AS discount, {d.number("tax", 9)} AS tax,
               odate + {d.number("ship", 121)} + 1 AS ship
        FROM ({line_states(based, "s1", "s2", "line")})"""
    return f"SELECT *, quantity * {PART_CENTS.format('part')} AS price FROM ({drawn})"


# 1995-06-17, in days after 1992-01-01.
TODAY = 1263


def gen_orders() -> str:
    d = Draws("s1", "s2")
    buyer = d.number("customer", f"({CUSTOMERS} - {CUSTOMERS} // 3)")
    clerk = d.number("clerk", f"greatest(1, {ORDERS} // 1500)")
    return f"""
WITH per_order AS (
    SELECT id, orderkey, odate, s1, s2,
           sum(price * (100 - discount) * (100 + tax))::BIGINT AS total,
           count(*) FILTER (ship > {TODAY}) AS open_lines, count(*) AS all_lines
    FROM ({order_lines()}) GROUP BY id, orderkey, odate, s1, s2),
bought AS (SELECT *, {buyer} AS buyer FROM per_order)
SELECT orderkey AS o_orderkey, (buyer // 2) * 3 + buyer % 2 + 1 AS o_custkey,
       CASE open_lines WHEN 0 THEN 'F' WHEN all_lines THEN 'O' ELSE 'P' END AS o_orderstatus,
       {money("(total + 5000) // 10000")} AS o_totalprice, {day("odate")} AS o_orderdate,
       {d.one_of("priority", words.PRIORITIES)} AS o_orderpriority,
       'Clerk#' || lpad(({clerk} + 1)::VARCHAR, 9, '0') AS o_clerk,
       0::INTEGER AS o_shippriority, {d.comment(19, 78)} AS o_comment, id - 1 AS row_ordinal
FROM bought"""


def gen_lineitem() -> str:
    d = Draws("l1", "l2")
    return f"""
WITH lines AS (SELECT *, ship + {d.number("receipt", 30)} + 1 AS receipt FROM ({order_lines()}))
SELECT orderkey AS l_orderkey, part AS l_partkey,
       {OFFERED_BY.format("part", d.number("slot", 4))} AS l_suppkey,
       line::INTEGER AS l_linenumber, {money("quantity * 100")} AS l_quantity,
       {money("price")} AS l_extendedprice, {money("discount")} AS l_discount,
       {money("tax")} AS l_tax,
       CASE WHEN receipt <= {TODAY} THEN {d.one_of("flag", ["A", "R"])} ELSE 'N' END
           AS l_returnflag,
       CASE WHEN ship > {TODAY} THEN 'O' ELSE 'F' END AS l_linestatus,
       {day("ship")} AS l_shipdate, {day("odate + 30 + " + d.number("commit", 61))} AS l_commitdate,
       {day("receipt")} AS l_receiptdate,
       {d.one_of("instruct", words.INSTRUCTIONS)} AS l_shipinstruct,
       {d.one_of("mode", words.MODES)} AS l_shipmode,
       {d.comment(10, 43)} AS l_comment, (first_line + line - 1)::BIGINT AS row_ordinal
FROM lines"""


SNAPSHOT_GENERATED = f"""
SELECT 'region' AS table_name, 5::BIGINT AS loaded_rows, FALSE AS failed
UNION ALL SELECT 'nation', 25, FALSE
UNION ALL SELECT 'supplier', {SUPPLIERS}, FALSE
UNION ALL SELECT 'customer', {CUSTOMERS}, FALSE
UNION ALL SELECT 'part', {PARTS}, FALSE
UNION ALL SELECT 'partsupp', 4 * {PARTS}, FALSE
UNION ALL SELECT 'orders', {ORDERS}, FALSE
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM ({order_lines()})), FALSE"""

CDC_FILES_ORDERS = f"""
WITH c AS (
    SELECT o_orderkey * 2 AS o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END + 100 AS o_totalprice,
           o_orderdate, o_orderpriority, o_orderkey % 3 = 0 AS twice
    FROM orders)
SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)
UNION ALL
SELECT c.o_orderkey, c.o_custkey, c.o_orderstatus, c.o_totalprice, c.o_orderdate,
       CASE WHEN twice OR t.o_orderkey IS NOT NULL
            THEN left(c.o_orderpriority, 40) || ' CDC:{NOW}' ELSE c.o_orderpriority END
FROM c LEFT JOIN orders t ON t.o_orderkey = c.o_orderkey"""

# The first run changes all orders in two sets, in order of their keys; the other comes between.
CDC_RESUMED_ORDERS = f"""
WITH n AS (SELECT (count(*) + 999) // 1000 AS ticks FROM orders),
a AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) > (ticks + 1) // 2 * 1000 AS late FROM orders, n),
b AS ({ORDER_CHANGES})
SELECT a.o_orderkey,
       CASE WHEN late OR b.o_orderkey IS NULL THEN a.o_custkey ELSE b.o_custkey END AS o_custkey,
       CASE WHEN late OR b.o_orderkey IS NULL THEN a.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       CASE WHEN late OR b.o_orderkey IS NULL THEN a.o_totalprice * 2 ELSE b.o_totalprice END AS o_totalprice,
       CASE WHEN late OR b.o_orderkey IS NULL THEN a.o_orderdate ELSE b.o_orderdate END AS o_orderdate,
       CASE WHEN late OR b.o_orderkey IS NULL THEN left(a.o_orderpriority, 40) || ' CDC:{NOW}'
            ELSE left(b.o_orderpriority, 40) || ' CDC:2024-01-01 00:00:01.000' END AS o_orderpriority
FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey
UNION ALL
SELECT {ORDER_COLUMNS} FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"""

RULES = [
    "order_without_lines", "order_total", "order_status", "ship_before_order", "customer_of_three",
    "customer_range", "receipt_before_ship", "part_range", "supplier_range", "line_not_offered",
]
GEN_INVARIANTS = "\nUNION ALL\n".join(
    f"SELECT '{rule}' AS rule, 0::BIGINT AS violations" for rule in RULES
)

ORACLES: dict[str, str] = {
    "upsert_orders": UPSERT_ORDERS,
    "upsert_shuffled_orders": UPSERT_ORDERS,
    "upsert_marker_documents": UPSERT_MARKER_DOCUMENTS,
    "upsert_lineitem": UPSERT_LINEITEM,
    "upsert_raw_lineitem": UPSERT_RAW_LINEITEM,
    "upsert_counts": UPSERT_COUNTS,
    "latest_per_key_lineitem": UNIQUE_LINES,
    "latest_event_per_user": LATEST_EVENT,
    "duplicate_keys_lineitem": DUPLICATE_KEYS,
    "null_violations_orders": NULL_VIOLATIONS,
    "batches_orders": BATCHES_ORDERS,
    "batches_lineitem": BATCHES_LINEITEM,
    "replay_orders": REPLAY_ORDERS,
    "batch_plan": BATCH_PLAN,
    "encode_orders": ENCODE_ORDERS,
    "decode_orders": GIVEN_ORDERS,
    "rejects_orders": REJECTS_ORDERS,
    "snapshot_report": SNAPSHOT_REPORT,
    "snapshot_generated": SNAPSHOT_GENERATED,
    "staged_copy_orders": GIVEN_ORDERS,
    "truncate_reload_customer": "SELECT * FROM customer",
    "cdc_after_k_batches": feed_sql(
        "documents", "doc_id", DOCUMENT_CHANGES, "text", "lang, source, n_chars", 100
    ),
    "cdc_two_feeds_documents": feed_sql(
        "documents", "doc_id", DOCUMENT_CHANGES, "text", "lang, source, n_chars", 100
    ),
    "cdc_stream_orders": feed_sql(
        "orders", "o_orderkey", ORDER_CHANGES, "o_orderpriority",
        "o_custkey, o_orderstatus, o_totalprice, o_orderdate", 1000,
    ),
    "cdc_files_orders": CDC_FILES_ORDERS,
    "cdc_resumed_orders": CDC_RESUMED_ORDERS,
    "cdc_progress": """
WITH t AS (SELECT 'orders' AS table_name, count(*) AS operations FROM orders
           UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT * FROM t UNION ALL SELECT 'all tables', sum(operations)::BIGINT FROM t""",
    "gen_region": gen_region(),
    "gen_nation": gen_nation(),
    "gen_supplier": gen_supplier(),
    "gen_customer": gen_customer(),
    "gen_part": gen_part(),
    "gen_partsupp": gen_partsupp(),
    "gen_orders": gen_orders(),
    "gen_lineitem": gen_lineitem(),
    "gen_slices_lineitem": f"SELECT * EXCLUDE (row_ordinal) FROM ({gen_lineitem()})",
    "gen_invariants": GEN_INVARIANTS,
}
