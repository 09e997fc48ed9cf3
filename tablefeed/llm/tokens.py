"""Count word pieces in linear time, without building the pieces.

The vocabulary is a trie of bytes. Where no child fits, the longest pieces of
what was read are popped: a node's failure link leads to what is left of it, and
the number of pieces popped on the way is kept with the node (the automaton of
"Fast WordPiece Tokenization", Song and others). So each byte costs a step.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import byte_letters, table

VOCABULARY = "byte_bpe_50k.json"
#: Words whose counts a Python worker remembers.
WORDS_KEPT = 500_000


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer's file; a space in front marks a word's start."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    return [bytes(letters[c] for c in name) for name in names if all(c in letters for c in name)]


class Automaton:
    """Trie with failure links and counts of popped pieces; node 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.next: dict[int, int] = {}  # node << 8 | byte: node
        last = [False]
        parent = [0]
        letter = [0]
        # bytes that no piece starts with would never be popped: each is a piece of its own
        for piece in (*(bytes([b]) for b in range(256)), *pieces):
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in self.next:
                    self.next[key] = len(last)
                    last.append(False)
                    parent.append(node)
                    letter.append(b)
                node = self.next[key]
            last[node] = node != 0
        self.link = [0] * len(last)
        self.pops = [0] * len(last)
        depth = [0] * len(last)
        for node in range(1, len(last)):
            depth[node] = depth[parent[node]] + 1
        for node in sorted(range(1, len(last)), key=depth.__getitem__):
            if last[node]:
                self.link[node], self.pops[node] = 0, 1
                continue
            # a node that is no piece has a parent other than the root
            at, pops = self.link[parent[node]], self.pops[parent[node]]
            while (to := self.next.get(at << 8 | letter[node])) is None:
                pops += self.pops[at]
                at = self.link[at]
            self.link[node], self.pops[node] = to, pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy split that takes the longest piece at each place."""
        node = pieces = 0
        for b in word:
            while (to := self.next.get(node << 8 | b)) is None:
                pieces += self.pops[node]
                node = self.link[node]
            node = to
        while node:
            pieces += self.pops[node]
            node = self.link[node]
        return pieces


class Counts(dict):
    """Pieces of words, worked out when first asked for."""

    def __init__(self, machine: Automaton) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = self.machine.count(b" " + word.encode("utf-8", "replace"))
        return found


_counts: dict[int, Counts] = {}


def counts_of(pieces: list[bytes]) -> Counts:
    key = hash(tuple(pieces))
    if key not in _counts:
        _counts.clear()
        _counts[key] = Counts(Automaton(pieces))
    return _counts[key]


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of (doc_id, text).

    Words are parted by white space and each starts with a space for the
    vocabulary. A null or empty text has no words. Rows may be repeated, and a text
    of any length is read whole. No rows give no rows. The vocabulary is read by
    the driver and sent along.
    """
    import public_tokenizers

    pieces = vocabulary(path or public_tokenizers.path(VOCABULARY))
    sent = documents.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = counts_of(sent.value)
        for texts in batches:
            rows = []
            for text in texts:
                words = text.split() if isinstance(text, str) else ()
                rows.append((len(words), sum(map(counts.__getitem__, words))))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), counted("text").alias("_c")).select(
        "doc_id", "_c.*"
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and word pieces of every document."""
    return token_counts(table(spark, folder, "documents", "doc_id", "text"))
