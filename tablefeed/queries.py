"""Every operator as a query over the tables of a folder.

Change sets are the whole of a table with its keys doubled: keys are distinct,
about half of them are in the table already, and half are new.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.functions.text import decode, encode, rejects
from tablefeed.operators.batches import (
    BATCH,
    TICK,
    GeneratedChanges,
    TableChanges,
    batch_number,
    batch_total,
    numbered,
    replayed,
)
from tablefeed.operators.keys import (
    ROW_OVERHEAD_BYTES,
    duplicate_keys,
    latest_per_key,
    null_counts,
)
from tablefeed.operators.upsert import (
    SHUFFLE,
    ChangeSize,
    measure_changes,
    plan_for,
    sent_whole,
    upsert,
    upsert_counts,
)
from tablefeed.plans.cdc import Feed, apply_batches, progress
from tablefeed.plans.rates import Pace, batch_plan
from tablefeed.plans.snapshot import Load, generated_loads, run_snapshot
from tablefeed.session import scratch_path
from tablefeed.sinks.parquet import ParquetSink, range_widths
from tablefeed.sources.generate import BUILDERS, ORDINAL, Sizes, generate
from tablefeed.sources.tables import read_table, sizes_of, spec_of, written
from tablefeed.specs import TABLES, TableSpec
from tablefeed.streaming.feed import RunningFeed
from tablefeed.streaming.file_feed import FileFeed

NOW = "2024-01-01 00:00:00.000"
BATCH_ROWS = 1000
# Keys that one task makes a hash table of.
KEYS_PER_TASK = 1_000_000
MONEY_COLUMNS = ("o_totalprice",)
DATE_COLUMNS = ("o_orderdate",)

Query = Callable[[SparkSession, str], DataFrame]


def clock(number: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=number)


# -- upserts --------------------------------------------------------------------


def order_changes(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {"o_orderkey": F.col("o_orderkey") * 2, "o_totalprice": F.col("o_totalprice") + 100}
    )


def document_changes(documents: DataFrame) -> DataFrame:
    return documents.withColumns(
        {"doc_id": F.col("doc_id") * 2, "text": F.concat(F.lit("new "), "text")}
    )


def checked_upsert(
    target: DataFrame, changes: DataFrame, spec: TableSpec, now: str | None = None
) -> DataFrame:
    """An upsert by the plan that the measured size of the changes allows."""
    return upsert(target, changes, spec, now, plan_for(measure_changes(changes, spec)))


def upsert_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return checked_upsert(orders, order_changes(orders), spec_of(orders, "orders"))


def upsert_shuffled_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return upsert(orders, order_changes(orders), spec_of(orders, "orders"), plan=SHUFFLE)


def upsert_marker_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    spec = spec_of(documents, "documents", comment="text")
    return checked_upsert(documents, document_changes(documents), spec, NOW)


def unique_lineitem(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSpec]:
    """Per key the line that is largest by its other columns, in column order."""
    lineitem = read_table(spark, folder, "lineitem")
    spec = spec_of(lineitem, "lineitem")
    return latest_per_key(lineitem, spec.pk, spec.payload), spec


def upsert_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    latest, spec = unique_lineitem(spark, folder)
    target = written(spark, latest, "lineitem")
    changes = target.withColumns(
        {"l_orderkey": F.col("l_orderkey") * 2, "l_quantity": F.col("l_quantity") + 1}
    )
    return checked_upsert(target, changes, spec)


def upsert_raw_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of unique keys over the lines as given, whose keys repeat."""
    latest, spec = unique_lineitem(spark, folder)
    changes = latest.withColumn("l_quantity", F.col("l_quantity") + 1).where("l_linenumber <= 3")
    lines = read_table(spark, folder, "lineitem")
    return upsert(lines, changes, spec, plan=SHUFFLE, repeats=True)


def upsert_counts_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return upsert_counts(orders, order_changes(orders), spec_of(orders, "orders"))


# -- keys and nulls -------------------------------------------------------------


def latest_per_key_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return unique_lineitem(spark, folder)[0]


def latest_event_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_key(read_table(spark, folder, "events"), ["user_id"], ["ts", "event_id"])


def duplicate_keys_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return duplicate_keys(lineitem, spec_of(lineitem, "lineitem").pk)


def null_violations_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    holed = orders.withColumns(
        {
            "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
            "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW")),
            "o_totalprice": F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")),
        }
    )
    return null_counts(holed, holed.columns)


# -- batches --------------------------------------------------------------------


def batches_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    ordered = numbered(spark, orders, ["o_orderkey"], stored=True)
    return ordered.select("o_orderkey", batch_number(BATCH_ROWS).alias(BATCH))


def batches_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    lines, spec = unique_lineitem(spark, folder)
    ordered = numbered(spark, lines, spec.pk)
    return ordered.select(*spec.pk, batch_number(BATCH_ROWS).alias(BATCH))


def replay_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Two passes over the orders in batches, and the first batch of a third."""
    orders = read_table(spark, folder, "orders")
    ordered = numbered(spark, orders, ["o_orderkey"], stored=True)
    batches = batch_total(orders.count(), BATCH_ROWS)
    due = replayed(ordered.withColumn(BATCH, batch_number(BATCH_ROWS)), batches, 2 * batches + 1)
    return due.select(TICK, BATCH, *orders.columns)


def batch_plan_default(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: read_table(spark, folder, name) for name in ("lineitem", "orders")}
    return batch_plan(spark, tables, 10_001)


# -- staging text ---------------------------------------------------------------


def typed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders with money as decimals and midnights as dates."""
    return read_table(spark, folder, "orders").withColumns(
        {
            **{c: F.col(c).cast("decimal(15,2)") for c in MONEY_COLUMNS},
            **{c: F.col(c).cast("date") for c in DATE_COLUMNS},
        }
    )


def plain_orders(orders: DataFrame) -> DataFrame:
    """The opposite of ``typed_orders``."""
    return orders.withColumns(
        {
            **{c: F.col(c).cast("double") for c in MONEY_COLUMNS},
            **{c: F.col(c).cast("timestamp_ntz") for c in DATE_COLUMNS},
        }
    )


def encode_orders(spark: SparkSession, folder: str) -> DataFrame:
    return encode(typed_orders(spark, folder))


def decode_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = typed_orders(spark, folder)
    return plain_orders(decode(encode(orders), orders.schema))


def rejects_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The staged orders that would not load, where every seventh total and eleventh date is spoilt."""
    orders = typed_orders(spark, folder)
    staged = encode(orders).withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice")),
            "o_orderdate": F.when(F.col("o_orderkey") % 11 == 0, "1995-02-30").otherwise(F.col("o_orderdate")),
        }
    )
    return rejects(staged, orders.schema)


# -- loads ----------------------------------------------------------------------


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("table_name", "loaded_rows", F.col("error").isNotNull().alias("failed"))


def snapshot_report(spark: SparkSession, folder: str) -> DataFrame:
    """Load the given tables; lineitem repeats keys, so it must fail and the others load."""
    names = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")
    loads = []
    for name in names:
        rows = read_table(spark, folder, name)
        loads.append(Load(spec_of(rows, name), rows, stored=True))
    return _report(run_snapshot(spark, ParquetSink(spark), loads, drop=True))


def snapshot_generated(spark: SparkSession, folder: str) -> DataFrame:
    """Load generated tables of the sizes of the given ones."""
    sizes = sizes_of(spark, folder)
    sink = ParquetSink(spark, widths=range_widths(sizes))
    return _report(run_snapshot(spark, sink, generated_loads(spark, "all", sizes)))


def staged_copy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders through a text-typed staging table."""
    orders = typed_orders(spark, folder)
    spec = spec_of(orders, "orders")
    sink = ParquetSink(spark, staged=True)
    run_snapshot(spark, sink, [Load(spec, orders)], strict=True)
    return plain_orders(sink.read(spec))


def truncate_reload_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Load, empty, drop, create and load again: the rows are there once."""
    customer = read_table(spark, folder, "customer")
    spec = spec_of(customer, "customer")
    sink, load = ParquetSink(spark), Load(spec, customer, stored=True)
    run_snapshot(spark, sink, [load], strict=True)
    sink.truncate_table(spec)
    run_snapshot(spark, sink, [load], strict=True)
    run_snapshot(spark, sink, [load], drop=True, strict=True)
    return sink.read(spec)


# -- change feeds ---------------------------------------------------------------


def _loaded_sink(spark: SparkSession, spec: TableSpec, rows: DataFrame) -> ParquetSink:
    sink = ParquetSink(spark)
    run_snapshot(spark, sink, [Load(spec, rows, stored=True)], strict=True)
    return sink


class BrokenOff(RuntimeError):
    """Stands for the end of a driver between the rows of a set and its record."""


class _BreaksOff(ParquetSink):
    """The same tables, until the first set but one has written its rows."""

    def __init__(self, sink: ParquetSink) -> None:
        super().__init__(sink.spark, sink.root)

    def _write(self, rows: DataFrame, spec: TableSpec, number: int) -> None:
        super()._write(rows, spec, number)
        if self._log(spec).current().feeds:
            raise BrokenOff


def _one_and_a_half_passes(feed: Feed) -> tuple[int, int]:
    """Ticks to run, and ticks in each of three sets."""
    ticks = feed.source.batches(feed.pace.batch_rows) * 3 // 2
    return ticks, -(-ticks // 3)


def cdc_after_k_batches(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    spec = spec_of(documents, "documents", comment="text")
    source = TableChanges(spark, document_changes(documents), spec.pk, stored=True)
    feed = Feed(spec, source, _loaded_sink(spark, spec, documents), Pace(spec.name, 1000), clock)
    ticks, per_set = _one_and_a_half_passes(feed)
    apply_batches(feed, 0, ticks, per_set)
    source.close()
    return feed.sink.read(spec)


def cdc_two_feeds_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As ``cdc_after_k_batches``, by two runs that each number their sets from 0."""
    documents = read_table(spark, folder, "documents")
    spec = spec_of(documents, "documents", comment="text")
    source = TableChanges(spark, document_changes(documents), spec.pk, stored=True)
    sink, pace = _loaded_sink(spark, spec, documents), Pace(spec.name, 1000)
    first = Feed(spec, source, sink, pace, clock)
    second = Feed(spec, source, sink, pace, lambda number: clock(number + 1))
    ticks, per_set = _one_and_a_half_passes(first)
    apply_batches(first, 0, per_set, per_set)
    apply_batches(second, per_set, ticks, per_set)
    source.close()
    return sink.read(spec)


def cdc_stream_orders(spark: SparkSession, folder: str) -> DataFrame:
    """As ``cdc_after_k_batches``, by a streaming query; the priority stands in for a comment."""
    orders = read_table(spark, folder, "orders")
    spec = spec_of(orders, "orders", comment="o_orderpriority")
    source = TableChanges(spark, order_changes(orders), spec.pk, stored=True)
    feed = Feed(spec, source, _loaded_sink(spark, spec, orders), Pace(spec.name, 10_000), clock)
    ticks, per_set = _one_and_a_half_passes(feed)
    running = RunningFeed(
        spark, feed, scratch_path(spark, "stream"), per_set, until=ticks, seconds=0
    )
    running.wait()
    source.close()
    return feed.sink.read(spec)


def cdc_files_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Change files of orders, some keys in two of them; the stream starts twice.

    The files that the first start finds hold every order with its key doubled; those
    that come before the second, every third of these again.
    """
    orders = read_table(spark, folder, "orders")
    spec = spec_of(orders, "orders", comment="o_orderpriority")
    sink, arriving = _loaded_sink(spark, spec, orders), scratch_path(spark, "arriving")
    feed = FileFeed(spec, arriving, sink, "version", 4, lambda number: clock(0))
    checkpoint = scratch_path(spark, "stream")
    again = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for version, rows in enumerate((orders, again)):
        changes = order_changes(rows).withColumn("version", F.lit(version).cast("long"))
        changes.repartition(6, "o_orderkey").write.mode("append").parquet(arriving)
        feed.start(spark, checkpoint).awaitTermination()
    return sink.read(spec)


def cdc_resumed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over one table; the first breaks off in its second set and goes on after the other.

    What it had half done must not come back over what the other has changed meanwhile.
    """
    orders = read_table(spark, folder, "orders")
    spec = spec_of(orders, "orders", comment="o_orderpriority")
    sink, pace = _loaded_sink(spark, spec, orders), Pace(spec.name, 10_000)
    dearer = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    first = TableChanges(spark, dearer, spec.pk, stored=True)
    other = TableChanges(spark, order_changes(orders), spec.pk, stored=True)
    feed = Feed(spec, first, sink, pace, lambda number: clock(0))
    ticks = first.batches(pace.batch_rows)
    half = -(-ticks // 2)
    try:
        apply_batches(replace(feed, sink=_BreaksOff(sink)), 0, ticks, half, "first")
    except BrokenOff:
        pass
    apply_batches(Feed(spec, other, sink, pace, lambda number: clock(1)), 0, ticks, ticks)
    apply_batches(feed, 0, ticks, half, "first")
    first.close()
    other.close()
    return sink.read(spec)


def cdc_progress(spark: SparkSession, folder: str) -> DataFrame:
    """One pass of generated rows, as many as there are given ones, over empty tables."""
    sizes = sizes_of(spark, folder)
    sink = ParquetSink(spark, widths=range_widths(sizes))
    feeds = []
    for name in ("orders", "customer"):
        sink.create_table(TABLES[name])
        source = GeneratedChanges(spark, name, sizes)
        feed = Feed(TABLES[name], source, sink, Pace(name, 10_000), clock)
        ticks = source.batches(feed.pace.batch_rows)
        apply_batches(feed, 0, ticks, -(-ticks // 2))
        feeds.append(feed)
    return progress(spark, feeds).select("table_name", "operations")


# -- generated tables -----------------------------------------------------------


def _generated(
    spark: SparkSession, folder: str, table: str, given: str, key: str
) -> tuple[DataFrame, Sizes]:
    """A generated table with an id for each row of a given one."""
    sizes = sizes_of(spark, folder)
    ids = read_table(spark, folder, given).select((F.col(key) + 1).alias("id"))
    return BUILDERS[table](ids, sizes), sizes


def gen_query(table: str, given: str, key: str) -> Query:
    """Generated rows in their staging form."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows, _ = _generated(spark, folder, table, given, key)
        return encode(rows.withColumnRenamed(ORDINAL, "row_ordinal"))

    return query


def gen_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer with the generated nation of its key."""
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = BUILDERS["nation"](spark.range(0, 25, 1, 1)).drop(ORDINAL)
    return customer.join(
        F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")
    ).drop("c_nationkey")


def gen_region(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer with the generated region of its generated nation."""
    regions = BUILDERS["region"](spark.range(0, 5, 1, 1)).drop(ORDINAL)
    customers = gen_nation(spark, folder).select("c_custkey", "n_regionkey")
    return customers.join(
        F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")
    ).drop("n_regionkey")


def gen_slices_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the given orders, from three slices of the table made apart."""
    orders, sizes = _generated(spark, folder, "orders", "orders", "o_orderkey")
    slices = [generate(spark, "lineitem", sizes, part, 3) for part in (1, 2, 3)]
    lines = slices[0].unionByName(slices[1]).unionByName(slices[2])
    given = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    # Hash tables of keys alone, of so many keys at any scale: no line is sorted or held.
    plan = plan_for(ChangeSize(sizes.orders, sizes.orders * (ROW_OVERHEAD_BYTES + 16)))
    if plan == SHUFFLE:
        default = int(spark.conf.get("spark.sql.shuffle.partitions"))
        given = given.repartition(max(default, -(-sizes.orders // KEYS_PER_TASK)), "l_orderkey")
    return encode(lines.join(sent_whole(given, plan), "l_orderkey", "left_semi"))


def gen_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of generated orders, lines and part suppliers that break a rule: none."""
    lines, sizes = _generated(spark, folder, "lineitem", "orders", "o_orderkey")
    orders, _ = _generated(spark, folder, "orders", "orders", "o_orderkey")
    offers, _ = _generated(spark, folder, "partsupp", "part", "p_partkey")

    charge = F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))
    by_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(charge).alias("charged"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        F.count(F.lit(1)).alias("line_count"),
        F.min("l_shipdate").alias("first_ship"),
    )
    status = (
        F.when(F.col("open_lines") == 0, "F")
        .when(F.col("open_lines") == F.col("line_count"), "O")
        .otherwise("P")
    )
    per_order = orders.join(by_order, "o_orderkey", "left").agg(
        F.count_if(F.col("line_count").isNull()).alias("order_without_lines"),
        F.count_if(F.round("charged", 2) != F.col("o_totalprice")).alias("order_total"),
        F.count_if(status != F.col("o_orderstatus")).alias("order_status"),
        F.count_if(F.col("first_ship") <= F.col("o_orderdate")).alias("ship_before_order"),
        F.count_if(F.col("o_custkey") % 3 == 0).alias("customer_of_three"),
        F.count_if(~F.col("o_custkey").between(1, sizes.customer)).alias("customer_range"),
    )
    per_line = lines.agg(
        F.count_if(F.col("l_receiptdate") <= F.col("l_shipdate")).alias("receipt_before_ship"),
        F.count_if(~F.col("l_partkey").between(1, sizes.part)).alias("part_range"),
        F.count_if(~F.col("l_suppkey").between(1, sizes.supplier)).alias("supplier_range"),
    )
    unoffered = (
        lines.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
        .join(offers.select("ps_partkey", "ps_suppkey"), ["ps_partkey", "ps_suppkey"], "left_anti")
        .agg(F.count(F.lit(1)).alias("line_not_offered"))
    )
    result = None
    for counts in (per_order, per_line, unoffered):
        rows = counts.unpivot([], counts.columns, "rule", "violations")
        result = rows if result is None else result.unionByName(rows)
    return result


QUERIES: dict[str, Query] = {
    "upsert_orders": upsert_orders,
    "upsert_shuffled_orders": upsert_shuffled_orders,
    "upsert_marker_documents": upsert_marker_documents,
    "upsert_lineitem": upsert_lineitem,
    "upsert_raw_lineitem": upsert_raw_lineitem,
    "upsert_counts": upsert_counts_orders,
    "latest_per_key_lineitem": latest_per_key_lineitem,
    "latest_event_per_user": latest_event_per_user,
    "duplicate_keys_lineitem": duplicate_keys_lineitem,
    "null_violations_orders": null_violations_orders,
    "batches_orders": batches_orders,
    "batches_lineitem": batches_lineitem,
    "replay_orders": replay_orders,
    "batch_plan": batch_plan_default,
    "encode_orders": encode_orders,
    "decode_orders": decode_orders,
    "rejects_orders": rejects_orders,
    "snapshot_report": snapshot_report,
    "snapshot_generated": snapshot_generated,
    "staged_copy_orders": staged_copy_orders,
    "truncate_reload_customer": truncate_reload_customer,
    "cdc_after_k_batches": cdc_after_k_batches,
    "cdc_two_feeds_documents": cdc_two_feeds_documents,
    "cdc_stream_orders": cdc_stream_orders,
    "cdc_files_orders": cdc_files_orders,
    "cdc_resumed_orders": cdc_resumed_orders,
    "cdc_progress": cdc_progress,
    "gen_region": gen_region,
    "gen_nation": gen_nation,
    "gen_supplier": gen_query("supplier", "supplier", "s_suppkey"),
    "gen_customer": gen_query("customer", "customer", "c_custkey"),
    "gen_part": gen_query("part", "part", "p_partkey"),
    "gen_partsupp": gen_query("partsupp", "part", "p_partkey"),
    "gen_orders": gen_query("orders", "orders", "o_orderkey"),
    "gen_lineitem": gen_query("lineitem", "orders", "o_orderkey"),
    "gen_slices_lineitem": gen_slices_lineitem,
    "gen_invariants": gen_invariants,
}
