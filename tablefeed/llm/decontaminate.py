"""Passages of a benchmark inside documents, found by winnowing.

Of every window of ten words the least hash among its runs of six words is the
window's fingerprint, so equal windows have equal fingerprints, and neighbouring
windows mostly share one. Documents' fingerprints are joined with the
benchmark's; where they meet, the windows that a fingerprint stands for are
compared word by word, and windows that agree extend each other to whole
passages. A shared passage of ten words or more is never missed, and hashes
decide nothing by themselves.

The benchmark is the query set: it is taken in blocks of a bounded size, each
sent to all tasks, and the documents stay where they are read. One block holds
any usual benchmark; more make further passes over the documents.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import keep, table

WINDOW = 10
RUN = 6
#: Bytes of benchmark text that are sent to the tasks at a time.
BLOCK_BYTES = 16 * 1024 * 1024
#: Words whose hashes a task remembers.
KNOWN_WORDS = 500_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8. Letters from A to Z alone are lower-cased."""
    return WORD.findall(text.translate(LOWER)) if text else []


class Hashes(dict):
    """Words to 64 bits, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = found
        return found


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by the place of its first."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, size, np.uint64)
    for j in range(size):
        out = (out ^ hashes[j : j + count]) * MIX
        out ^= out >> np.uint64(29)
    return out * ODD


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of words the least hash of its runs.

    A window shorter than ``WINDOW`` is all of an item, and a run by itself.
    """
    size = RUN if window == WINDOW else window
    each = runs(hashes, size)
    count = len(hashes) - window + 1
    if count <= 0:
        return each[:0]
    least = each[:count]
    for j in range(1, window - size + 1):
        least = np.minimum(least, each[j : j + count])
    return least


@dataclass
class Index:
    """The windows of some items. Equal hashes are equal windows, which is made sure of."""

    #: Words of all items one after another, each followed by a space, and where they start.
    words: bytes
    starts: np.ndarray
    #: Names of the items.
    items: list[str]
    #: By length of window: fingerprints; hashes of whole windows in order; the first
    #: word of each of these, and the number of its item.
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[str, bytes | None]]) -> Index:
        known = Hashes()
        texts, hashes, names = [], [], []
        for item, text in items:
            if words := words_of(text):
                texts.append(words)
                hashes.append(np.array([known[w] for w in words], np.uint64))
                names.append(item)
        sizes = np.fromiter((len(w) + 1 for words in texts for w in words), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        index = cls(b"".join(w + b" " for words in texts for w in words), starts, names, {})
        found: dict[int, list] = {}
        first = 0
        for number, own in enumerate(hashes):
            window = min(WINDOW, len(own))
            whole = runs(own, window)
            at = np.arange(first, first + len(whole))
            owner = np.full(len(whole), number)
            found.setdefault(window, []).append((fingerprints(own, window), whole, at, owner))
            first += len(own)
        for window, parts in found.items():
            marks, whole, at, owner = map(np.concatenate, zip(*parts))
            order = np.lexsort((owner, whole))
            index.windows[window] = np.unique(marks), whole[order], at[order], owner[order]
            index.check(window)
        return index

    def window(self, first: int, size: int) -> bytes:
        return self.words[self.starts[first] : self.starts[first + size]]

    def check(self, size: int) -> None:
        _, whole, at, _ = self.windows[size]
        for k in np.flatnonzero(whole[1:] == whole[:-1]):
            if self.window(at[k], size) != self.window(at[k + 1], size):
                raise ValueError("two windows of the benchmark have one hash; change MIX")

    def found(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Passages (start and end in words) that items have, and the numbers of these items."""
        spans, items = [], set()
        for size, (marks, whole, at, owner) in self.windows.items():
            prints = fingerprints(hashes, size)
            if not len(prints):
                continue
            # Neighbouring windows of one fingerprint are looked up once.
            starts = np.flatnonzero(np.diff(prints, prepend=~prints[:1]))
            near = np.minimum(np.searchsorted(marks, prints[starts]), len(marks) - 1)
            ends = np.append(starts[1:], len(prints))
            hits = np.flatnonzero(marks[near] == prints[starts])
            if not len(hits):
                continue
            here = np.concatenate([np.arange(starts[h], ends[h]) for h in hits])
            own = runs(hashes, size)[here]
            low, high = np.searchsorted(whole, own, "left"), np.searchsorted(whole, own, "right")
            for k in np.flatnonzero(low < high):
                first = int(here[k])
                text = b"".join(w + b" " for w in words[first : first + size])
                if text == self.window(at[low[k]], size):
                    spans.append((first, first + size))
                    items.update(owner[low[k] : high[k]].tolist())
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


FOUND = "n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>"


def finder(index: Broadcast[Index]):
    """A function of the text and of what earlier blocks have found in it."""
    known = Hashes()

    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        inside, rows = index.value, []
        for text, old in zip(texts.cast(pa.binary()), before.to_pylist()):
            words = words_of(text.as_py())
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            spans, items = inside.found(words, hashes)
            names = {inside.items[k] for k in items}
            if old and old["spans"]:
                spans = merged(spans + [(s["start"], s["end"]) for s in old["spans"]])
                names.update(old["items"])
            spans = [{"start": start, "end": end} for start, end in spans]
            rows.append({"n_words": len(words), "spans": spans, "items": sorted(names)})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kind = [("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]
        return pa.array(rows, pa.struct(kind))

    return F.arrow_udf(find, f"struct<{FOUND}>")


def blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Distinct (item, text) in as many parts as it takes for none to be larger, single items apart."""
    kept = keep(items.distinct(), "benchmark")
    count = 1
    while True:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item")).alias("size")
        sizes = kept.groupBy(part.alias("part")).agg(size, F.count("*").alias("items"))
        if sizes.where((F.col("size") > block_bytes) & (F.col("items") > 1)).isEmpty():
            return [kept.where(part == number) for number in range(count)]
        count *= 2


def contamination(
    documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents, and in each the passages that the benchmark has too.

    Added columns, which take the place of any so called: n_words, spans (start
    and end in words, in order, apart), items (ids as text, sorted). ``documents``
    needs text, ``benchmark`` item_id and text; all else is kept or ignored. An
    item of ten words or more is found by any ten of them in a row, a shorter one
    as a whole, one without words never. Null texts have no words, and a null id
    reads as ''. Rows of one item_id are one item with several texts. Repeated
    documents are judged each for itself, and texts of any length as a whole. An
    empty benchmark finds nothing; no documents give no rows.
    """
    spark = documents.sparkSession
    ids = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(ids.alias("item"), "text")
    rest = documents.drop("n_words", "spans", "items")
    names = rest.columns
    out = rest.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    out = out.withColumn("found", F.lit(None).cast(f"struct<{FOUND}>"))
    for number, block in enumerate(blocks(items, block_bytes)):
        held = [(row.item, row.text.encode() if row.text else None) for row in block.collect()]
        if number:
            out = keep(out, "searched")
        find = finder(spark.sparkContext.broadcast(Index.of(held)))
        out = out.withColumn("found", find(F.col("row.text"), F.col("found")))
    return out.select("row.*", "found.*")


def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark", "item_id", "text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size,
         array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS w
  FROM b, range(1, len(words) - least(len(words), 10) + 2) r(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT id, i, size, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM d, sizes, range(1, len(words) - size + 2) r(i)),
hits AS (SELECT p.id, p.i, p.size, x.item FROM places p JOIN windows x ON p.size = x.size AND p.w = x.w),
words_hit AS (
  SELECT id, count(DISTINCT place) AS n
  FROM (SELECT DISTINCT id, i, size FROM hits), range(i, i + size) r(place) GROUP BY id),
found AS (
  SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
       coalesce(f.n, 0)::BIGINT AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
       h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit h ON d.id = h.id LEFT JOIN found f ON d.id = f.id
"""
