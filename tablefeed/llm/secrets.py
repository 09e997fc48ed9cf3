"""Find secrets in texts: keywords first, patterns at their hits, checksums last.

An Aho-Corasick automaton passes over the text once and reports where a keyword
starts; a pattern is tried there only, anchored. Kinds that embed a checksum
count only if it holds. Hex runs have no keyword: any run of 32 covers one of
every 32nd places, so the run is tried only around places that hold a hex digit.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import table

REDACTED = "[SECRET]"

BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def base62_crc32(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]


# Kinds, in the order in which spans that start together are listed.
KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        lambda m: len(m[2]) >= 8,
    ),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    Kind("hex", (), re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    Kind(
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
        lambda m: base62_crc32(m[1], m[2]),
    ),
    Kind(
        "npm",
        ("npm_",),
        re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
        lambda m: base62_crc32(m[1], m[2]),
    ),
)
BASE = ("assign", "access", "hex")
HEX_LEAST = 32
HEX_RUN = re.compile(r"[0-9a-f]*")
HEX_DIGITS = frozenset("0123456789abcdef")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def ascii_lower(text: str) -> str:
    """Lower case at the same places: other letters can change their number."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            found.add_word(word, (k, len(word)))
    found.make_automaton()
    return found


_automaton: list[ahocorasick.Automaton] = []


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for at in range(HEX_LEAST - 1, len(text), HEX_LEAST):
        if at >= done and text[at] in HEX_DIGITS:
            start = at
            while start > done and text[start - 1] in HEX_DIGITS:
                start -= 1
            done = HEX_RUN.match(text, at).end()
            if done - start >= HEX_LEAST:
                yield start, done


def spans_of(text: str | None) -> list[Span]:
    """All spans in order of start, then kind. A null text has none."""
    if not text:
        return []
    if not _automaton:
        _automaton.append(automaton())
    found = [(start, BASE.index("hex"), end) for start, end in hex_runs(text)]
    hits = [(end - size + 1, k) for end, (k, size) in _automaton[0].iter(ascii_lower(text))]
    ends = [0] * len(KINDS)
    for start, k in sorted(set(hits)):
        # a match that fails its test uses up its characters all the same
        if start >= ends[k] and (m := KINDS[k].pattern.match(text, start)):
            ends[k] = m.end()
            if KINDS[k].holds(m):
                found.append((start, k, m.end()))
    return sorted(found)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k].name}:{start}:{end}" for start, k, end in spans)


def redacted(text: str | None) -> str | None:
    """The text with a mark in place of every secret; spans that overlap get one mark."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at, reach = [], 0, 0
    for start, _, end in spans:
        if start >= reach:
            out += [text[at:start], REDACTED]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]])


FINDINGS = (
    "n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"
)


def findings(texts: pd.Series) -> pd.DataFrame:
    """What is in each text. No base spans hash as the empty string; no spans are one."""
    rows = []
    for text in texts:
        spans = spans_of(text)
        base = [s for s in spans if s[1] < len(BASE)]
        counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
        digest = hashlib.sha256(told(base).encode()).hexdigest()
        rows.append((*counts, len(spans) - len(base), digest, told(spans)))
    return pd.DataFrame(rows, columns=[part.split()[0] for part in FINDINGS.split(", ")])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and the findings of every row of (doc_id, text), repeated rows included.

    A null or empty text holds nothing; a text of any length is scanned whole, in one
    pass for keywords. No rows give no rows.
    """
    scanned = F.pandas_udf(findings, FINDINGS)
    return documents.select("doc_id", scanned("text").alias("_s")).select("doc_id", "_s.*")


def without_secrets(text: Column) -> Column:
    """The text with every secret masked; null stays null."""
    return F.pandas_udf(lambda texts: texts.map(redacted), "string")(text)


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets in every document; equal rows are scanned each for itself."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return scan(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
