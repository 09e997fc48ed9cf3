"""What five text filters remove in every order of applying them.

Each filter has a relation of the ids that fail it. Left-anti joins with these
relations leave the survivors of a set of filters, and a left-semi join of the
survivors with one more relation gives what that filter removes next. What
survives depends on the set of filters before, not on their order: the 120
orders share 32 sets.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefeed.llm.common import keep, table

LEAST_WORDS = 50
LEAST_DISTINCT = 65  # hundredths of the words
MOST_CAPITALS = 5  # hundredths of the code points
MARKS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
#: Of the 120 orders, those with a given set of so many filters before a given next one.
ORDERS_WITH = [math.factorial(n) * math.factorial(len(FILTERS) - 1 - n) for n in range(len(FILTERS))]
COUNTS = (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
)


def text_rules() -> dict[str, Column]:
    """What fails a filter that looks at one text, here the column ``text``, which has no null."""
    words = F.array_remove(F.split("text", SPACE), "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals > MOST_CAPITALS * F.length("text").cast("long"),
        "D": F.col("text").rlike(MARKS),
    }


def judged(documents: DataFrame) -> DataFrame:
    """(id, doc_id, part, digest, A, B, C, D) for every row; ``id`` tells any two rows apart."""
    docs = documents.select(
        F.col("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return docs.select(
        # Fixed once it is written: a task that runs again gives its rows the same ids.
        F.monotonically_increasing_id().alias("id"),
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        *(fails.alias(name) for name, fails in text_rules().items()),
    )


def repeats(rows: DataFrame) -> DataFrame:
    """Ids of rows whose text a smaller doc_id has too: those that are not the first of it.

    Joined on text and doc_id at once, so that the copies of a text are spread over tasks.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return rows.where("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left_anti").select("id")


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """A table of ids for each filter."""
    failing = {name: rows.where(name).select("id") for name in "ABCD"}
    return {name: keep(ids, f"fails-{name}") for name, ids in {**failing, "E": repeats(rows)}.items()}


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, part, good, toxic); a doc_id with several labels has what any of them says."""
    known = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    no = F.lit(False)
    return rows.join(known, "doc_id", "left").select(
        "id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def survivors(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """The rows with ``done``, once for every set of filters (as bits) that leaves them."""
    left = rows.withColumn("done", F.lit(0))
    for name in FILTERS:
        after = left.join(fails[name], "id", "left_anti")
        after = after.withColumn("done", F.col("done") + BIT[name])
        left = keep(left.unionByName(after), "survivors")
    return left


def removals(left: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """(part, done, next, removed, good_lost, toxic_lost), where anything is removed."""
    out = None
    for name in FILTERS:
        ready = left.where(F.col("done").bitwiseAND(F.lit(BIT[name])) == 0)
        lost = ready.join(fails[name], "id", "left_semi")
        counts = lost.groupBy("part", "done").agg(
            F.count("*").alias("removed"),
            F.count_if("good").alias("good_lost"),
            F.count_if("toxic").alias("toxic_lost"),
        )
        counts = counts.withColumn("next", F.lit(BIT[name]))
        out = counts if out is None else out.unionByName(counts)
    return out


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, done, next): the 600 steps of all orders."""
    rows = []
    for order in map("".join, itertools.permutations(FILTERS)):
        done = 0
        for step, name in enumerate(order, 1):
            rows.append((order, step, done, BIT[name]))
            done += BIT[name]
    return spark.createDataFrame(rows, "filter_order string, step int, done int, next int")


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; a part is a source, '' where it is null.

    ``documents`` needs doc_id, text and source, ``labels`` doc_id, quality and
    toxic; other columns are ignored, whatever their names. A null text is empty,
    and an empty one has no words, so it fails A alone unless it is a repeat. Rows
    are told apart even if equal, and rows of one doc_id do not repeat each other.
    A null doc_id is no smaller than any other and has no label; null labels are
    no labels. Texts are judged whole. No documents give no rows.
    """
    spark = documents.sparkSession
    rows = keep(judged(documents), "judged")
    fails = failing_ids(rows)
    # Rows that fail nothing are left by every set: only the others are followed.
    any_fail = None
    for ids in fails.values():
        any_fail = ids if any_fail is None else any_fail.unionByName(ids)
    failing = rows.join(any_fail, "id", "left_semi")
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    clean = rows.join(any_fail, "id", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    followed = keep(labelled(failing.select("id", "doc_id", "part"), labels), "failing")

    left = survivors(followed, fails)
    rest = left.groupBy("part", F.col("done").alias("after")).agg(F.count("*").alias("rest"))
    gone = removals(left, fails)

    # Every part, set and next filter, also where nothing is removed.
    steps = [(done, bit) for done in range(ALL + 1) for bit in BIT.values() if not done & bit]
    cells = F.array(*(F.struct(F.lit(d).alias("done"), F.lit(b).alias("next")) for d, b in steps))
    sets = (
        sizes.join(clean, "part", "left")
        .select("part", "clean", F.explode(cells).alias("c"))
        .select("part", "clean", "c.*", (F.col("c.done") + F.col("c.next")).alias("after"))
        .join(gone, ["part", "done", "next"], "left")
        .join(rest, ["part", "after"], "left")
        .na.fill(0)
    )
    same = Window.partitionBy("part", "next")
    weight = F.array(*(F.lit(n) for n in ORDERS_WITH))[F.bit_count("done")]

    def removed_after(done: Column) -> Column:
        return F.max(F.when(F.col("done") == done, F.col("removed"))).over(same)

    counted = sets.select(
        "part",
        "done",
        "next",
        (F.col("clean") + F.col("rest")).alias("kept"),
        "removed",
        (removed_after(F.lit(0)) - F.col("removed")).alias("redundant"),
        removed_after(ALL - F.col("next")).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum(F.col("removed") * weight).over(same).alias("shapley"),
    )
    # 600 rows, whatever the data.
    return counted.join(F.broadcast(orders(spark)), ["done", "next"]).select(
        "part", "filter_order", "step", *COUNTS
    )


def op12_filter_interaction(spark: SparkSession, folder: str) -> DataFrame:
    """The five filters over all documents, in all orders."""
    return interactions(
        table(spark, folder, "documents", "doc_id", "text", "source"),
        table(spark, folder, "labels", "doc_id", "quality", "toxic"),
    )


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good,
                 coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM docs LEFT JOIN known ON docs.doc_id = known.doc_id),
classes AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
            FROM judged GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, b)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
             [a.b, b.b, c.b, d.b, e.b] AS bits
      FROM f a, f b, f c, f d, f e
      WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, i AS step, bits[i] AS bit,
                 coalesce(list_sum(bits[1:i - 1]), 0)::INT AS done
          FROM o, range(1, 6) r(i)),
counted AS (
  SELECT part, filter_order, step::INT AS step, any_value(bit) AS bit,
         coalesce(sum(n) FILTER (fails & (done + bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails & bit > 0 AND fails & done = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & bit > 0 AND fails & done > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (fails & bit > 0 AND fails & done = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(x) FILTER (fails & bit > 0 AND fails & done = 0), 0)::BIGINT AS toxic_lost
  FROM classes, steps GROUP BY part, filter_order, step)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
