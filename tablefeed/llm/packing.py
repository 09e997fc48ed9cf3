"""Pack token sequences into as few bins as possible by large-item matching.

Only lengths matter for where a piece goes, and there are no more lengths than
tokens in a bin. So the corpus is counted by length; the driver lays out the
few thousand counts, and every piece then finds its place from its length and
its rank among the pieces of that length. Pieces above a third of a bin are at
most two to a bin and are paired greedily, the longest with the longest that
fits. Smaller ones go, longest first, where they leave the smallest gap.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import byte_letters, gapless, keep, table

BIN_TOKENS = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a Python worker remembers.
WORDS_KEPT = 200_000

# Texts of these characters alone are split by the pattern below as the
# tokenizer's own steps split them; all others go through the tokenizer whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xff]*\Z")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Ids(dict):
    """Little-endian ids of words, worked out when first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        names = {b: letter for letter, b in byte_letters().items()}
        self.letters = "".join(names[b] for b in range(256))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        # a word that is split off needs the merges only, over the letters of its bytes
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(letters)]
        self[word] = found = np.asarray(ids, dtype="<u4").tobytes()
        return found

    def of(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.match(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))


_loaded: dict[int, Ids] = {}


def ids_from(spec: str) -> Ids:
    """The ids of a tokenizer's file content; one is kept in each worker."""
    key = zlib.crc32(spec.encode())
    if key not in _loaded:
        from tokenizers import Tokenizer

        _loaded.clear()
        _loaded[key] = Ids(Tokenizer.from_str(spec))
    return _loaded[key]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    documents: DataFrame, path: str, limit: int = BIN_TOKENS, with_ids: bool = False
) -> DataFrame:
    """The tokens of (doc_id, text), with an end id, cut into pieces of ``limit`` at most.

    A null text counts as empty and is one piece of one id. Ids may be null or
    repeated; every row is a document of its own. The tokenizer's file is read
    by the driver and sent along.
    """
    with open(path, encoding="utf-8") as file:
        spec = documents.sparkSession.sparkContext.broadcast(file.read())
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ids_from(spec.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = ids.of(text if isinstance(text, str) else "") + end
                for piece, at in enumerate(range(0, len(found), 4 * limit)):
                    part = found[at : at + 4 * limit]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = PIECES + (", ids binary" if with_ids else "")
    columns = [part.split()[0] for part in schema.split(", ")]
    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


class Placement(NamedTuple):
    """Ranks from ``first`` of a length: ``each`` in every bin from ``bin``, from ``offset`` on."""

    length: int
    first: int
    each: int
    bin: int
    offset: int


class Layout:
    """Bins for counts of lengths. Bins of equal content are runs of numbers."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.bins = 0
        self.placements: list[Placement] = []
        self.ranks: dict[int, int] = {}
        self.gaps: list[int] = []  # sizes of gaps that some bins have, in order
        self.runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)

    def leave(self, first: int, n: int, gap: int) -> None:
        if n and gap:
            if gap not in self.runs:
                insort(self.gaps, gap)
                self.runs[gap] = []
            heapq.heappush(self.runs[gap], (first, n))

    def put(self, length: int, each: int, first: int, n: int, gap: int) -> None:
        rank = self.ranks.get(length, 0)
        self.placements.append(Placement(length, rank, each, first, self.limit - gap))
        self.ranks[length] = rank + each * n

    def fill(self, length: int, n: int, first: int, room: int, gap: int) -> int:
        """Put up to n pieces into a run of ``room`` bins; how many were put."""
        most = gap // length
        full = min(room, n // most)
        if full:
            self.put(length, most, first, full, gap)
            self.leave(first, full, gap - most * length)
        rest = min(n - full * most, most) if full < room else 0
        if rest:
            self.put(length, rest, first + full, 1, gap)
            self.leave(first + full, 1, gap - rest * length)
        used = full + bool(rest)
        self.leave(first + used, room - used, gap)
        return full * most + rest

    def pair_large(self, counts: dict[int, int]) -> None:
        """Two of the pieces above a third of a bin in each bin, the longest first."""
        left = {n: c for n, c in counts.items() if 3 * n > self.limit and c}
        order = sorted(left)
        while order:
            length = order[-1]
            at = bisect_right(order, self.limit - length) - 1
            if at >= 0 and order[at] == length and left[length] == 1:
                at -= 1  # only itself is left
            other = order[at] if at >= 0 else None
            if other is None:
                n = left[length]
                self.put(length, 1, self.bins, n, self.limit)
                self.leave(self.bins, n, self.limit - length)
                left[length] = 0
            elif other == length:
                n = left[length] // 2
                self.put(length, 2, self.bins, n, self.limit)
                self.leave(self.bins, n, self.limit - 2 * length)
                left[length] -= 2 * n
            else:
                n = min(left[length], left[other])
                self.put(length, 1, self.bins, n, self.limit)
                self.put(other, 1, self.bins, n, self.limit - length)
                self.leave(self.bins, n, self.limit - length - other)
                left[length] -= n
                left[other] -= n
                if not left[other]:
                    del order[at]
            self.bins += n
            if not left[length]:
                order.pop()

    def fit_small(self, counts: dict[int, int]) -> None:
        for length in sorted((n for n in counts if 3 * n <= self.limit), reverse=True):
            n = counts[length]
            while n:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    bins = -(-n // (self.limit // length))
                    n -= self.fill(length, n, self.bins, bins, self.limit)
                    self.bins += bins
                    continue
                gap = self.gaps[at]
                first, room = heapq.heappop(self.runs[gap])
                if not self.runs[gap]:
                    del self.runs[gap], self.gaps[at]
                n -= self.fill(length, n, first, room, gap)


def laid_out(counts: dict[int, int], limit: int = BIN_TOKENS) -> Layout:
    layout = Layout(limit)
    layout.pair_large(counts)
    layout.fit_small(counts)
    return layout


def packed(cut: DataFrame, limit: int = BIN_TOKENS) -> DataFrame:
    """``cut`` pieces, each of 1 to ``limit`` tokens, with ``sequence_id`` and ``offset``.

    ``cut`` is read several times and should be a kept table. Equal pieces may
    change places. What the driver sees and sends to tasks is bounded by
    ``limit``, not by the corpus: a count for each length, and a few placements.
    """
    counts = {n: c for n, c in cut.groupBy("length").count().collect()}
    plan = sorted(laid_out(counts, limit).placements)
    told = np.array(plan, dtype=np.int64).reshape(-1, 5)
    shift = 1 << 48  # ranks stay below
    starts = told[:, 0] * shift + told[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = told[np.searchsorted(starts, length * shift + rank, side="right") - 1]
        bins, nth = np.divmod(rank - row[:, 1], row[:, 2])
        return pd.DataFrame({"sequence_id": row[:, 3] + bins, "offset": row[:, 4] + nth * length})

    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = gapless(cut, ["length"], order, "rank")
    return ranked.withColumn("place", place("length", "rank")).select(
        *cut.columns, "place.sequence_id", "place.offset"
    )


def sequences(cut_with_ids: DataFrame, limit: int = BIN_TOKENS) -> DataFrame:
    """(sequence_id, ids): the packed token sequences, each of ``limit`` tokens at most."""
    parts = packed(cut_with_ids, limit).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )

    @F.pandas_udf("array<long>")
    def joined(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ps: np.frombuffer(b"".join(p["ids"] for p in ps), dtype="<u4").astype(np.int64))

    return parts.select("sequence_id", joined("parts").alias("ids"))


def pack_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of (doc_id, text) with their places. No documents give no pieces."""
    return packed(keep(pieces(documents, path or tokenizer_path()), "pieces"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, folder, "documents", "doc_id", "text"))
