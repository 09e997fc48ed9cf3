"""Judge documents by weak labels: rules vote, their accuracies are estimated, a scorer learns.

Several rules, each of which looks at one side of a text, vote that it is poor or
fine, or abstain. The votes of all documents are counted by pattern; from those
counts alone expectation-maximisation estimates how often each rule is right
about either class, and what a pattern of votes says about a document (Dawid and
Skene). The posteriors of a bounded sample train a linear scorer over hashed
shapes of words, and it judges every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import table

POOR, FINE, ABSTAIN = 0, 1, 2
#: Documents that the scorer learns from, about; a uniform sample by hash. All
#: documents vote and count for the rules' accuracies, and all are scored.
SAMPLE = 6_000
DIMENSIONS = 1 << 13
ROUNDS = 200
WORDS_KEPT = 200_000
#: A fine document that is lost costs far more than a poor one that stays.
THRESHOLD = 0.06

# Frequent words of some languages.
FREQUENT = frozenset(
    """the of and to in is that it for was on with as be by at this are or from
    de la le les et des un une du en que qui dans est pour au par sur
    der die und das den von mit ist ein eine nicht zu im auf sich dem
    el los las del una con por para se no su al""".split()
)

SYMBOLS = re.compile(r"([^\w\s.,;:!?'\"()|-])\1")
SHAPES = (
    (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "AA"),
    (re.compile(r"[a-zß-öø-ÿ]+"), "a"),
    (re.compile(r"[0-9]+"), "0"),
    (re.compile(r"([^\w\s])\1+"), r"\1\1"),
)


def vote(share: float, poor_above: float, fine_below: float) -> int:
    return POOR if share > poor_above else FINE if share < fine_below else ABSTAIN


def votes(text: str | None) -> tuple[int, ...]:
    """What each rule says; all abstain on texts of fewer than three words."""
    words = text.split() if text else []
    n = len(words)
    if n < 3:
        return (ABSTAIN,) * len(RULES)
    return tuple(rule(text, words, n) for rule in RULES)


def symbols(text: str, words: list[str], n: int) -> int:
    return vote(sum(1 for _ in SYMBOLS.finditer(text)) / n, 0.25, 0.05)


def separators(text: str, words: list[str], n: int) -> int:
    return vote(sum(words.count(mark) for mark in ("|", "·", "»", "•")) / n, 0.2, 0.03)


def capitals(text: str, words: list[str], n: int) -> int:
    return vote(sum(map(str.isupper, words)) / n, 0.5, 0.15)


def shouting(text: str, words: list[str], n: int) -> int:
    return vote(text.count("!!") / n, 0.25, 0.03)


def stutter(text: str, words: list[str], n: int) -> int:
    return vote(sum(map(str.__eq__, words, words[1:])) / n, 0.25, 0.05)


def variety(text: str, words: list[str], n: int) -> int:
    if n < 20:
        return ABSTAIN
    richness = len(set(words)) / n**0.5
    return POOR if richness < 2 else FINE if richness > 4 else ABSTAIN


def frequent(text: str, words: list[str], n: int) -> int:
    if n < 20:
        return ABSTAIN
    share = sum(map(FREQUENT.__contains__, words)) / n
    return POOR if share < 0.02 else FINE if share > 0.08 else ABSTAIN


def sentences(text: str, words: list[str], n: int) -> int:
    share = (text.count(". ") + text.count(".\n") + text.endswith(".")) / n
    return FINE if 0.02 < share < 0.4 else POOR if n > 60 and share < 0.003 else ABSTAIN


RULES = (symbols, separators, capitals, shouting, stutter, variety, frequent, sentences)


def pattern(text: str | None) -> int:
    code = 0
    for v in votes(text):
        code = 3 * code + v
    return code


def unpacked(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Chance that a document with a pattern of votes is fine, by expectation-maximisation.

    At the start, a document is poor if a rule says so. An abstention says nothing.
    """
    if not counts:
        return {}
    codes = sorted(counts)
    said = np.array([unpacked(c) for c in codes])
    weight = np.array([counts[c] for c in codes], dtype=np.float64)
    fine = np.where((said == POOR).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = (weight @ fine + 1) / (weight.sum() + 2)
        odds = np.full(len(codes), np.log(prior) - np.log1p(-prior))
        for j in range(said.shape[1]):
            voted, is_fine = said[:, j] != ABSTAIN, said[:, j] == FINE
            right = [
                ((weight * share * voted * is_fine).sum() + 1) / ((weight * share * voted).sum() + 2)
                for share in (fine, 1 - fine)
            ]  # how often it says fine, of fine and of poor documents
            odds += np.where(is_fine, np.log(right[0]) - np.log(right[1]), 0)
            odds += np.where(voted & ~is_fine, np.log1p(-right[0]) - np.log1p(-right[1]), 0)
        fine = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes, fine.tolist()))


class Shapes(dict):
    """(bucket of a word's shape, bucket of the word if it is short) by word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        shape = word
        for find, put in SHAPES:
            shape = find.sub(put, shape)
        short = word.lower() if len(word) <= 4 else "long"
        self[word] = found = (hashed("s " + shape), hashed("w " + short))
        return found


def hashed(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % DIMENSIONS


_shapes = Shapes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, of length 1: shapes, pairs of shapes, short words, repeats."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.array(list(map(_shapes.__getitem__, words)), dtype=np.int64)
    pairs = (ids[:-1, 0] * 31 + ids[1:, 0] * 17 + 7) % DIMENSIONS
    same = sum(map(str.__eq__, words, words[1:]))
    buckets = np.concatenate([ids.ravel(), pairs, np.full(same, hashed("same"))])
    seen, counts = np.unique(buckets, return_counts=True)
    values = np.sqrt(counts / len(buckets))
    return seen, values / np.linalg.norm(values)


def trained(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights, the last one the bias, of a logistic scorer on labels between 0 and 1."""
    weights = np.zeros(DIMENSIONS + 1)
    if not len(rows):
        return weights
    at = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    column, value = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    # either class counts as much as the other
    fine = max(labels.sum(), 1e-9)
    poor = max((1 - labels).sum(), 1e-9)
    share = labels / fine / 2 + (1 - labels) / poor / 2
    target = labels / fine / 2 / share
    speed = np.zeros_like(weights)
    for step in range(ROUNDS):
        ahead = weights + step / (step + 3) * speed
        score = np.bincount(at, value * ahead[column], len(rows)) + ahead[-1]
        error = share * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target)
        slope = np.append(np.bincount(column, value * error[at], DIMENSIONS), error.sum())
        new = ahead - 2.0 * (slope + 1e-5 * ahead)
        speed, weights = new - weights, new
    return weights


def score(text: str | None, weights: np.ndarray) -> float:
    """Chance that a text is fine. A text without words, or none, is poor: 0."""
    buckets, values = features(text)
    if not len(buckets):
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(values @ weights[buckets] + weights[-1], -30, 30))))


def learned(documents: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """Posteriors by pattern, from all rows of (doc_id, text), and the scorer's weights."""
    pattern_of = F.pandas_udf(lambda texts: texts.map(pattern, na_action=None), "long")
    counts = {c: n for c, n in documents.groupBy(pattern_of("text")).count().collect()}
    fine = posteriors(counts)
    total = sum(counts.values())
    share = min(1.0, sample / total) if total else 1.0
    least = min(2**63 - 1, int(-(2**63) + share * 2**64))

    def vectors(texts: pd.Series) -> pd.DataFrame:
        found = [features(t) for t in texts]
        return pd.DataFrame(
            {
                "code": [pattern(t) for t in texts],
                "buckets": [b.astype(np.int32).tobytes() for b, _ in found],
                "values": [v.astype(np.float32).tobytes() for _, v in found],
            }
        )

    vectors_of = F.pandas_udf(vectors, "code long, buckets binary, values binary")
    # Where ids repeat, more rows may be drawn: then the least hashes stay. Rows alike in
    # both are alike in id and text.
    by_id, by_text = F.xxhash64(F.lit("sample"), "doc_id"), F.xxhash64("text")
    drawn = (
        documents.where(by_id <= least)
        .select(vectors_of("text").alias("v"), by_id.alias("by_id"), by_text.alias("by_text"))
        .orderBy("by_id", "by_text")
        .limit(2 * sample)
        .select("v.*")
        .collect()
    )
    drawn = sorted((r for r in drawn if r.buckets), key=lambda r: (r.code, bytes(r.buckets), bytes(r["values"])))
    rows = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r["values"], np.float32)) for r in drawn]
    return fine, trained(rows, np.array([fine[r.code] for r in drawn]))


def judged(documents: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents`` with a struct ``_judged``: posterior, score, keep.

    Repeated rows are judged alike. A null text, an empty one and one without words
    have score 0 and are not kept; a text of any length is judged whole. Whatever
    the order and partitioning of the rows, the scorer is the same. No rows, no
    judgement.
    """
    fine, weights = learned(documents.select("doc_id", F.col(text).alias("text")), sample)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((fine, weights))

    def judge(texts: pd.Series) -> pd.DataFrame:
        fine, weights = sent.value
        scores = [score(t, weights) for t in texts]
        said = [fine[pattern(t)] for t in texts]
        return pd.DataFrame({"posterior": said, "score": scores, "keep": [s >= THRESHOLD for s in scores]})

    judge_of = F.pandas_udf(judge, "posterior double, score double, keep boolean")
    return documents.withColumn("_judged", judge_of(F.col(text)))


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that the scorer finds fine, in their own columns."""
    names = documents.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    rows = documents.select(row, F.col("doc_id"), F.col("text").alias("_text"))
    return judged(rows, "_text").where("_judged.keep").select(
        *(F.col("_row")[c].alias(c) for c in names)
    )


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every document."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return judged(docs).select(F.col("doc_id").cast("long"), "_judged.*")
