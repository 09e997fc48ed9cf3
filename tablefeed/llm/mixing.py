"""Mix sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source should be taken x = target / size of the source
times. The whole copies are taken; the fractions are rounded in pairs: mass
moves at random from one to the other, at a rate that keeps the words of the
two together and each one's expectation, until one of them is 0 or 1. The other
goes on to the next pair. Groups of bounded size are rounded side by side, what
each leaves over meets in the next level of a tree, and so a source ends up
off its target by a part of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefeed.llm.common import keep, table, told_apart

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one group rounds in turn, and so also residuals that meet in a node of the tree.
GROUP = 200
EPSILON = 1e-9

STATE = "struct<doc_id:bigint,copy_key:bigint,nth:bigint,size:bigint,whole:bigint,x:double>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight, none above 3 times its source.

    A target is min(3 * size, level * weight) with the level at which the targets
    sum to all words. Sources in order of how soon they are full: the level is
    the one at which the next source isn't full yet.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))) + 1)
    weighed = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size").cast("double") * MOST_COPIES
    )
    by_full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_full.rowsBetween(Window.unboundedPreceding, -1)
    later = by_full.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        / F.sum("weight").over(later),
    )
    # the first source in this order that the level leaves unfilled fixes the level for the rest
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    return levels.withColumn("level", F.max(fits).over(every)).select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _pair(a: Column, d: Column) -> Column:
    """The pair's outcome: (state that is decided, state that goes on)."""
    ratio = a["size"] / d["size"]  # words move: d gains ratio for each unit that a gives
    up = F.least(1 - a["x"], d["x"] / ratio)
    down = F.least(a["x"], (1 - d["x"]) / ratio)
    # a goes up by `up` with chance down / (up + down), else down by `down`
    draw = F.pmod(F.xxhash64(F.lit("pair"), a["copy_key"], a["nth"], d["copy_key"], d["nth"], a["x"]), F.lit(1 << 53)) / float(1 << 53)
    move = F.when(draw * (up + down) < down, up).otherwise(-down)

    def at(s: Column, x: Column) -> Column:
        x = F.when(x < EPSILON, 0.0).when(x > 1 - EPSILON, 1.0).otherwise(x)
        return F.struct(
            s["doc_id"].alias("doc_id"),
            s["copy_key"].alias("copy_key"),
            s["nth"].alias("nth"),
            s["size"].alias("size"),
            s["whole"].alias("whole"),
            x.alias("x"),
        )

    first, second = at(a, a["x"] + move), at(d, d["x"] - move * ratio)
    goes_on = (first["x"] > 0) & (first["x"] < 1)
    return F.struct(
        F.when(goes_on, second).otherwise(first).alias("decided"),
        F.when(goes_on, first).otherwise(second).alias("on"),
    )


def _round_group(states: Column) -> Column:
    """(decided states, last state) of a group that is rounded in order."""
    start = F.struct(
        F.array().cast(f"array<{STATE}>").alias("done"), F.element_at(states, 1).alias("on")
    )

    def step(acc: Column, d: Column) -> Column:
        # the pair is put into an array and taken out again so that it is worked out once
        pairs = F.transform(F.array(acc), lambda s: _pair(s["on"], d))
        return F.element_at(
            F.transform(
                pairs,
                lambda p: F.struct(
                    F.concat(acc["done"], F.array(p["decided"])).alias("done"), p["on"].alias("on")
                ),
            ),
            1,
        )

    return F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), start, step)


def mixed(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, source, size, copy_key, source_size, target, copies) for (doc_id, source, size, copy_key).

    ``copy_key`` orders rows. Rows that are equal in all columns are numbered and
    the number decides their group too, so that no group holds them all. A document
    without words is never taken. No rows give no rows. Reruns over the same rows give the same copies.
    """
    documents = told_apart(documents.select("doc_id", "source", "size", "copy_key")).select("row.*", "nth")
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select("source", "source_size")).join(
        sizes.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))
    )
    targets = keep(targets.drop("_s"), "targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("share") + EPSILON)
    part = F.greatest(F.col("share") - F.col("whole"), F.lit(0.0))
    told = (
        documents.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("share", share)
        .withColumn("whole", whole)
        .withColumn("x", F.when(part < EPSILON, 0.0).otherwise(part))
    )
    state = F.struct("doc_id", "copy_key", "nth", "size", "whole", "x")
    fixed = F.col("x").eqNullSafe(0.0) | (F.col("size") == 0)
    facts = ["source", "source_size", "target"]
    done = [told.where(fixed).select(*facts, "size", "doc_id", "copy_key", F.col("whole").alias("copies"))]
    nodes = max(1, -(-most // group))
    node = F.pmod(F.xxhash64(F.lit("leaf"), "copy_key", "nth"), F.greatest(F.ceil(F.col("n") / group), F.lit(1)))
    open_ = told.where(~fixed).select(*facts, state.alias("state"), node.alias("node"))
    while True:
        grouped = open_.groupBy(*facts, "node").agg(
            F.sort_array(F.collect_list(F.struct(F.col("state.copy_key"), F.col("state.nth"), F.col("state")))).alias("all")
        )
        rounded = grouped.select(
            *facts, "node", _round_group(F.transform("all", lambda s: s["state"])).alias("r")
        )
        rounded = keep(rounded.select(*facts, "node", "r.done", "r.on"), "rounded")
        none = F.array().cast(f"array<{STATE}>")
        whole_left = (F.col("on.x") == 0) | (F.col("on.x") == 1)
        settled = F.concat("done", F.when(whole_left, F.array("on")).otherwise(none))
        last = nodes == 1
        if last:
            # one fraction is left for each source: a last draw decides it
            draw = F.pmod(F.xxhash64(F.lit("last"), "on.copy_key", "on.nth"), F.lit(1 << 53)) / float(1 << 53)
            settled = F.concat("done", F.array(F.col("on").withField("x", F.when(draw < F.col("on.x"), 1.0).otherwise(0.0))))
        done.append(
            rounded.select(*facts, F.explode(settled).alias("s")).select(
                *facts,
                F.col("s.size").alias("size"),
                F.col("s.doc_id").alias("doc_id"),
                F.col("s.copy_key").alias("copy_key"),
                (F.col("s.whole") + F.col("s.x")).cast("long").alias("copies"),
            )
        )
        if last:
            break
        nodes = max(1, -(-nodes // group))
        open_ = rounded.where("on.x > 0 and on.x < 1").select(
            *facts, F.col("on").alias("state"), F.floor(F.col("node") / group).alias("node")
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, copy_key), without the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "source", text).alias("copy_key"),
    )


def take_copies(documents: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in its own columns.

    Repeated rows take the mean of their copies, and the first of them the rest: the
    first by their other columns, so that every run takes the same ones.
    """
    sizes = sized(documents)
    taken = mixed(sizes).groupBy("copy_key").agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")
    )
    names = documents.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"),
        F.xxhash64("doc_id", "source", text).alias("copy_key"),
    )
    single = rows.join(taken.where("_rows = 1"), "copy_key")
    many = rows.join(taken.where("_rows > 1"), "copy_key")
    nth = F.row_number().over(Window.partitionBy("copy_key").orderBy(F.sha2(F.to_json("_row"), 256)))
    spread = many.withColumn(
        "_copies", F.floor(F.col("_copies") / F.col("_rows")) + (nth <= F.col("_copies") % F.col("_rows")).cast("int")
    )
    both = single.unionByName(spread).where("_copies > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        *(F.col("_row")[c].alias(c) for c in names)
    )


def op2_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    return mixed(sized(docs)).select(
        "doc_id",
        "size",
        F.col("source_size").cast("long"),
        F.col("target").cast("double"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
