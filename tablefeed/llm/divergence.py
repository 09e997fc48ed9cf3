"""How much the sources of a language differ in their words.

Texts that are alike are collapsed first: per language and text, the number of
copies in each source. Every distinct text is tokenized once, and its words are
added up with the copies as weights, as documents that hold a word and as uses of
it. What follows works on counts alone, and only on those above zero: a word that
neither of two sources has adds the same to every such pair, so it is counted,
not listed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefeed.llm.common import keep, table

#: Documents of a language that must hold a word for it to count.
LEAST_DOCUMENTS = 10
#: Words of a source that are listed.
TOP = 10
SCALE = 1_000_000_000
#: Bytes of source names up to which all sources are sent to every task.
SENT_BYTES = 16 * 1024 * 1024
#: Words that a task adds up before it hands them on.
HELD_WORDS = 200_000

TERM = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
COUNTS = pa.schema(
    [
        ("lang", pa.string()),
        ("source", pa.string()),
        ("term", pa.string()),
        ("docs", pa.int64()),
        ("uses", pa.int64()),
    ]
)


def bag(text: bytes) -> Counter[bytes]:
    """The terms of a text in UTF-8. Letters from A to Z alone are lower-cased."""
    return Counter(TERM.findall(text.translate(LOWER)))


def weighted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (lang, digest, text, source, copies); rows of one text must follow each other."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size, last, terms = 0, None, Counter()

    def flushed() -> pa.RecordBatch:
        rows = [(*group, t, *n) for group, sums in held.items() for t, n in sums.items()]
        lang, source, term, docs, uses = zip(*rows) if rows else ([],) * 5
        columns = [
            pa.array(lang, pa.string()),
            pa.array(source, pa.string()),
            pa.array(term, pa.binary()).cast(pa.string()),
            pa.array(docs, pa.int64()),
            pa.array(uses, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=COUNTS)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        names = [batch.column(c).to_pylist() for c in ("lang", "digest", "source", "copies")]
        for at, (lang, digest, source, copies) in enumerate(zip(*names)):
            if (lang, digest) != last:
                last, terms = (lang, digest), bag(texts[at].as_py())
            sums = held.setdefault((lang, source), {})
            size -= len(sums)
            for term, uses in terms.items():
                if term in sums:
                    found = sums[term]
                    found[0] += copies
                    found[1] += copies * uses
                else:
                    sums[term] = [copies, copies * uses]
            size += len(sums)
            if size >= HELD_WORDS:
                yield flushed()
                held, size = {}, 0
    yield flushed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, uses) over all of (lang, source, text), which hold no null."""
    told = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = told.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    texts = told.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    # A merge join keeps the sources of one text together.
    each = texts.join(copies.hint("merge"), ["lang", "digest"])
    sums = each.select("lang", "digest", "text", "source", "copies").mapInArrow(
        weighted_terms, "lang string, source string, term string, docs long, uses long"
    )
    return sums.groupBy("lang", "source", "term").agg(
        F.sum("docs").alias("docs"), F.sum("uses").alias("uses")
    )


def share(count: str, total: str, terms: str) -> Column:
    """A word's smoothed share in billionths, exact for counts of any size."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10)) * (cast({count} as decimal(19)) + 2))"
        f" div (cast({total} as decimal(19)) + 2 * cast({terms} as decimal(19)))"
    )


def distance(p: str, q: str) -> Column:
    """Of two shares; squares of billionths fit in 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergences(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for all sources of each language.

    ``documents`` needs text, lang and source, and may have any other columns.
    Nulls in them are read as empty, and the empty language and the empty source
    are like any other. Repeated rows are documents of their own. A language
    whose words are all rare has pairs of value 0 and no terms, a source alone in
    its language no pairs. Ties go to the smaller item by bytes. No rows give no
    rows. Texts are read whole, whatever their length.

    The pairs of sources are what is asked for, so their number is the square of
    the sources of a language; words are never paired.
    """
    spark = documents.sparkSession
    docs = documents.select(
        *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    )
    counts = keep(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("uses").alias("lang_uses")
    )
    kept = kept.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    held = keep(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")

    by_source = held.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    by_lang = held.groupBy("lang", "term").agg(F.sum("uses").alias("n")).groupBy("lang")
    by_lang = by_lang.agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = (
        docs.select("lang", "source")
        .distinct()
        .join(by_source, ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .na.fill(0)
        .withColumn("none", F.when(F.col("terms") > 0, share("0", "total", "terms")))
    )
    groups = keep(groups, "sources")
    names = F.sum(F.octet_length("lang") + F.octet_length("source") + 64)
    few = (groups.agg(names).first()[0] or 0) <= SENT_BYTES
    sent = F.broadcast(groups) if few else groups

    rated = held.join(sent, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        share("uses", "total", "terms").alias("p"),
        share("lang_uses", "lang_total", "terms").alias("q"),
        "none",
    )
    over = rated.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    tops = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    pairs = pair_values(rated, groups, sent).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair"))
        .select(columns)
        .unionByName(tops.withColumn("part", F.lit("term")).select(columns))
    )


def pair_values(rated: DataFrame, groups: DataFrame, sent: DataFrame) -> DataFrame:
    """(lang, source, item, value) for both orders of every two sources of a language.

    All words at first count as if neither source had them; then each word that
    one has is set right against the other's share of none, and each word that
    both have for what was set right twice.
    """
    other = sent.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), "terms")
    ahead = F.col("source") < F.col("item")
    base = groups.drop("terms").join(other, "lang").where(ahead).select(
        "lang",
        "source",
        "item",
        F.coalesce(F.col("terms") * distance("none", "item_none"), F.lit(0)).alias("value"),
    )
    # Words of equal share count together.
    alike = rated.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("n"))
    single = alike.join(other, "lang").where("source <> item").select(
        "lang",
        F.least("source", "item").alias("source"),
        F.greatest("source", "item").alias("item"),
        (F.col("n") * (distance("p", "item_none") - distance("none", "item_none"))).alias("value"),
    )
    right = rated.select(
        "lang",
        "term",
        F.col("source").alias("item"),
        F.col("p").alias("item_p"),
        F.col("none").alias("item_none"),
    )
    both = rated.join(right, ["lang", "term"]).where(ahead).select(
        "lang",
        "source",
        "item",
        (
            distance("p", "item_p")
            - distance("p", "item_none")
            - distance("none", "item_p")
            + distance("none", "item_none")
        ).alias("value"),
    )
    parts = base.unionByName(single).unionByName(both)
    once = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return once.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.*", "value")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of each language against each other, and their words against the language's."""
    return divergences(table(spark, folder, "documents", "text", "lang", "source"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
uses AS (SELECT lang, source, id, term, count(*) AS n
         FROM (SELECT lang, source, id, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM uses GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0)::HUGEINT AS c, k.n AS lang_c
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM uses GROUP BY ALL) u
    ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
rated AS (
  SELECT d.lang, d.source, d.term, d.c,
         1 + (1000000000 * (d.c + 2)) // (sum(d.c) OVER (PARTITION BY d.lang, d.source) + 2 * l.v) AS p,
         1 + (1000000000 * (d.lang_c + 2)) // (l.total + 2 * l.v) AS q
  FROM dense d JOIN langs l ON d.lang = l.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT
  FROM rated WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
