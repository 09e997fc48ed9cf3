"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles.

A text's features are its runs of five words, weighted by (1 + ln tf) * idf. The
samples agree between two texts with the chance of their weighted Jaccard
similarity (Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1
Sketching"). Texts that agree on all samples of a band meet; what meets, directly
or through others, is a family. Inside a family the similarity is worked out
exactly, until everything that is linked is connected.

The idf is ln(1 + N / df) with the number of documents that hold a run, counted
for every run: documents are dealt to parts, a part asks for each of its runs once,
runs are counted by ranges of their hashes, and each part is told those that more
than one document holds.

``classes`` can also take the floored idf ln(1 + 1 / max(df / N, 0.1)): runs of words
that under a tenth of all documents hold weigh the same. A text and its copies don't
drift apart by being copied a lot then, and only the runs above a tenth have to be
known everywhere; there can be no more of them than ten times the runs of a mean
document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import components, keep, table

WORDS = 5
SIMILAR = 0.8
#: Texts of similarity s don't meet with a chance of (1 - s**ROWS)**BANDS: 0.00022 at 0.8.
BANDS = 16
ROWS = 4
SAMPLES = BANDS * ROWS
#: Agreeing samples below which two texts aren't compared; similar ones agree on
#: fewer with a chance of 1 in 50 million.
AGREE = SAMPLES // 2
COMMON = 0.1
#: Documents, and words, of a family that one task compares with as many others.
BLOCK_DOCS = 1_000
BLOCK_WORDS = 1_000_000
#: Characters of the texts that are cut into words at a time, runs that are sampled at a time
#: and by how many samples, and runs that are counted at a time.
READ_CHARS = 1 << 16
RACE_RUNS = 1 << 14
RACE_SAMPLES = 8
CHUNK = 2_000_000
BUCKETS = 1 << 20
#: A sample's least value is sought below this many times its mean. It lies above with a
#: chance of exp(-LIMIT), 0.25%, and is then sought among all runs of the text.
LIMIT = 6.0
#: Characters of a part, in the mean, whose runs are asked for and weighed at a time. A range
#: of hashes has the runs of as many parts as the second number.
PART_CHARS = 1 << 22
RANGE_PARTS = 2
BASE = 0xC2B2AE3D27D4EB4F

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x ^= x >> np.uint64(29)
    return x * ODD


_is_word: list[np.ndarray] = []


def is_word() -> np.ndarray:
    """Whether a code point belongs to words: letters, digits and the underscore."""
    if not _is_word:
        points = map(chr, range(0x110000))
        _is_word.append(np.fromiter((c.isalnum() or c == "_" for c in points), bool, 0x110000))
    return _is_word[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def firsts(values: np.ndarray) -> np.ndarray:
    """Where each value begins, in an array that has equal values side by side."""
    return np.flatnonzero(np.append(len(values) > 0, values[1:] != values[:-1]))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, in lower case, and the number of each text's words.

    The hashes are polynomials of the code points, wherever a word stands.
    """
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(is_word()[points], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * up[: len(points)], out=sums[1:])
    last = np.cumsum([len(t) + 1 for t in lower])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.diff(np.searchsorted(starts, last), prepend=0)


def runs_of(h: np.ndarray) -> np.ndarray:
    """Runs of five words, as they come. Fewer words are one run; no words have none."""
    size = min(WORDS, len(h))
    if not size:
        return h
    runs = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        runs = mixed(runs + h[j : len(h) - size + 1 + j])
    return runs


def read(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of every text and its runs, as they come; many short texts are read at a time."""

    def told(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, sizes = words_of(some)
        # those across two texts are made too, and left out
        runs = runs_of(words)
        ends = np.cumsum(sizes)
        for start, end in zip((ends - sizes).tolist(), ends.tolist()):
            own = words[start:end]
            yield own, runs[start : end - WORDS + 1] if end - start >= WORDS else runs_of(own)

    some: list[str] = []
    held = 0
    for text in texts:
        some.append(text or "")
        held += len(some[-1])
        if held >= READ_CHARS:
            yield from told(some)
            some, held = [], 0
    if some:
        yield from told(some)


def shingles(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs in order, and how often each occurs."""
    ordered = np.sort(runs)
    starts = firsts(ordered)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def idf(share: np.ndarray | float, floor: float = COMMON) -> np.ndarray:
    return np.log(1 + 1 / np.maximum(share, floor))


def weights(
    runs: np.ndarray, counts: np.ndarray, common: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """TF-IDF; ``common`` has the runs of more than a tenth of the documents, and their idf."""
    found = np.full(len(runs), idf(0.0))
    names, values = common
    if len(names) and len(runs):
        at = np.minimum(np.searchsorted(names, runs), len(names) - 1)
        found = np.where(names[at] == runs, values[at], found)
    return (1 + np.log(counts)) * found


_SEEDS = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * ODD)


def _uniform(bits: np.ndarray, shift: int) -> np.ndarray:
    """21 of the bits as a number between 0 and 1, exclusive."""
    part = (bits >> np.uint64(shift)).astype(np.uint32) & np.uint32(0x1FFFFF)
    return (part.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)


def _raced(bits: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs in their samples, the least of which is picked, and their levels."""
    more = (bits ^ (bits >> np.uint64(31))) * MIX
    r = -np.log(_uniform(bits, 0) * _uniform(bits, 21))
    c = -np.log(_uniform(bits, 42) * _uniform(more, 0))
    beta = _uniform(more, 21)
    level = np.floor(log / r + beta)
    return np.log(c) - r * (level - beta + 1), level


def _named(runs: np.ndarray, level: np.ndarray) -> np.ndarray:
    return mixed(runs + level.astype(np.int64).astype(np.uint64) * ODD)


def sampled_together(runs: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text and sample a hash of the run and level that it picks.

    The texts' runs follow each other, ``sizes`` of them, none without any. A run's value is
    log(c) - r * (level - beta + 1), and that is never below log(c * exp(-r) / weight) with
    exp(-r) = u * v and c = -log(x * y) >= 1 - x for the uniform u, v, x and y. The least
    value of a text is about -log(its weight), so that what can't come near it is
    known by a product of integers, or by c, and only the rest is worked out.
    """
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    limit = LIMIT / np.add.reduceat(weight, starts)
    most = np.log(limit).astype(np.float32)
    logs = np.log(weight).astype(np.float32)
    # a thousandth more than the limit, as values are rounded
    bound = weight * limit[text] * 1.001
    least = (np.minimum(bound, 1) * 2.0**63).astype(np.uint64)
    bound = bound.astype(np.float32)
    picked = np.zeros((len(sizes), SAMPLES), np.uint64)
    settled = np.zeros((len(sizes), SAMPLES), bool)
    last21 = np.uint64(0x1FFFFF)
    for first in range(0, SAMPLES, RACE_SAMPLES):
        places, drawn = [], []
        for seed in _SEEDS[first : first + RACE_SAMPLES]:
            bits = mixed(runs ^ seed)
            low = (bits & last21) * (bits >> np.uint64(21) & last21)
            low *= ~bits >> np.uint64(42) & last21
            near = np.flatnonzero(low <= least)
            places.append(near)
            drawn.append(bits[near])
        sample = np.repeat(np.arange(first, first + len(places)), list(map(len, places)))
        place, bits = np.concatenate(places), np.concatenate(drawn)
        c = -np.log(_uniform(bits, 42) * _uniform((bits ^ (bits >> np.uint64(31))) * MIX, 0))
        near = np.flatnonzero(_uniform(bits, 0) * _uniform(bits, 21) * c <= bound[place])
        place, sample = place[near], sample[near]
        value, level = _raced(bits[near], logs[place])
        group = sample * len(sizes) + text[place]
        begins = firsts(group)
        if len(begins):
            lowest = np.minimum.reduceat(value, begins)
            at = np.flatnonzero(value == np.repeat(lowest, np.diff(np.append(begins, len(group)))))
            at = at[firsts(group[at])]
            at = at[value[at] <= most[text[place[at]]]]
            own = text[place[at]], sample[at]
            picked[own] = _named(runs[place[at]], level[at])
            settled[own] = True
    for i, k in np.argwhere(~settled):
        own = runs[starts[i] : starts[i] + sizes[i]]
        value, level = _raced(mixed(own ^ _SEEDS[k]), logs[starts[i] : starts[i] + sizes[i]])
        at = [value.argmin()]
        picked[i, k] = _named(own[at], level[at])[0]
    return picked


def sampled(runs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return sampled_together(runs, weight, np.array([len(runs)]))[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (runs in order, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


# -- common runs ------------------------------------------------------------------


def _local_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs that over 5% of a chunk's documents hold, with their number there, and the documents."""
    parts: list[np.ndarray] = []
    held = 0

    def told() -> pd.DataFrame:
        runs = np.concatenate(parts)
        # few buckets hold enough for a run that is often; only those are sorted
        bucket = runs & np.uint64(BUCKETS - 1)
        least = COMMON / 2 * len(parts)
        left = (np.bincount(bucket.view(np.int64), minlength=BUCKETS) > least)[bucket]
        doc = np.repeat(np.arange(len(parts)), list(map(len, parts)))[left]
        pairs = np.unique(np.stack([runs[left], doc.astype(np.uint64)], 1), axis=0)
        names, n = np.unique(pairs[:, 0], return_counts=True)
        often = n > least
        return pd.DataFrame(
            {"run": np.append(names[often].view(np.int64), 0), "n": np.append(n[often], 0),
             "docs": np.append(np.zeros(often.sum(), np.int64), len(parts))}
        )

    for batch in batches:
        for _, runs in read(batch["text"]):
            if len(runs):
                parts.append(runs)
                held += len(runs)
            if held > CHUNK:
                yield told()
                parts.clear()
                held = 0
    if parts:
        yield told()


def common_runs(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs in more than a tenth of all texts that have any, in order, with their idf.

    A run above a tenth of the whole is counted, but for a twentieth of the texts
    at most, in chunks where it is above a twentieth. Those that can be above a
    tenth by this, at most twenty times the runs of a mean text, are then counted
    exactly.
    """
    local = keep(texts.mapInPandas(_local_counts, "run long, n long, docs long"), "runs")
    total = local.agg(F.sum("docs")).first()[0] or 0
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    near = (
        local.where("n > 0").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON / 2 * total)
    )
    asked = np.sort(np.array([r.run for r in near.collect()], dtype=np.int64).view(np.uint64))
    if not len(asked):
        return nothing

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(asked), np.int64)
        for batch in batches:
            for _, runs in read(batch["text"]):
                at = np.minimum(np.searchsorted(asked, runs), len(asked) - 1)
                n[np.unique(at[asked[at] == runs])] += 1
        yield pd.DataFrame({"run": asked.view(np.int64), "n": n})

    counted = texts.mapInPandas(exact, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    share = {r.run: r.n / total for r in counted if r.n > COMMON * total}
    names = np.sort(np.array(list(share), dtype=np.int64).view(np.uint64))
    return names, idf(np.array([share[int(v)] for v in names.view(np.int64)]))


# -- the documents of every run ---------------------------------------------------


def _planes(numbers: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on: those of numbers in order compress well."""
    size = numbers.dtype.itemsize
    return numbers.astype(f">u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    given = np.frombuffer(planes, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(given.T).reshape(-1).view(f">u{size}").astype(f"u{size}")


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are equal in (key, doc_id, text) become one with their number."""
    for batch in batches:
        _, first, n = np.unique(batch.column("key").to_numpy(), return_index=True, return_counts=True)
        order = np.argsort(first)
        once = batch.take(pa.array(first[order]))
        yield once.append_column("copies", pa.array(n[order].astype(np.int64)))


def dealt(documents: DataFrame) -> tuple[DataFrame, int]:
    """(key, doc_id, text, copies, part) and the number of parts."""
    given = row_key(documents.select(F.col("doc_id").cast("long"), "text")).select("key", "doc_id", "text")
    parts = 1 + (documents.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS
    once = given.mapInArrow(_collapsed, "key long, doc_id long, text string, copies long")
    return once.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(parts)).cast("int")), parts


def asked(part: int, texts: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """The distinct runs of a part by ranges of hashes, and how many of its documents hold each."""
    runs = [shingles(r)[0] for _, r in read(texts["text"])]
    times = texts["copies"].to_numpy(np.int64)
    of = np.repeat(times, list(map(len, runs)))
    runs_in, at = np.concatenate(runs), np.array([len(r) > 0 for r in runs])
    order = np.argsort(runs_in, kind="stable")
    names = runs_in[order]
    starts = firsts(names)
    names = names[starts]
    held = np.add.reduceat(of[order], starts) if len(names) else of
    ends = np.array([(k << 64) // ranges - 1 for k in range(1, ranges + 1)], dtype=np.uint64)
    cuts = np.append(0, np.searchsorted(names, ends, "right"))
    return pd.DataFrame(
        [
            (part, k, _planes(names[a:b]), _planes(held[a:b].astype(np.uint64)), int(times[at].sum()))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        ],
        columns=["part", "range", "runs", "held", "docs"],
    )


def told(requests: pd.DataFrame) -> pd.DataFrame:
    """For every part those of its runs in a range that more than one document holds, and in how many."""
    runs = [_numbers(r, 8) for r in requests["runs"]]
    held = np.concatenate([_numbers(h, 8) for h in requests["held"]]).astype(np.int64)
    every = np.concatenate(runs)
    order = np.argsort(every, kind="stable")
    starts = firsts(every[order])
    if len(starts):
        sums = np.add.reduceat(held[order], starts)
        held[order] = np.repeat(sums, np.diff(np.append(starts, len(every))))
    rows, at = [], 0
    for part, piece in zip(requests["part"], runs):
        own = held[at : at + len(piece)]
        at += len(piece)
        more = own > 1
        rows.append((part, requests["range"].iloc[0], _planes(piece[more]), _planes(own[more].astype(np.uint64))))
    return pd.DataFrame(rows, columns=["part", "range", "runs", "held"]).assign(docs=requests["docs"].sum())


# -- links ------------------------------------------------------------------------


def signatures(
    texts: Iterable[str | None], weigh: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, bytes | None]]
) -> pd.DataFrame:
    """A row for each text; ``weigh`` gives weights and what is to be held of distinct runs and their counts."""
    rows: list[tuple] = []
    some: list[tuple] = []

    def told() -> None:
        sizes = np.array([len(runs) for _, _, runs, _, _ in some])
        runs, weight = (np.concatenate([t[k] for t in some]) for k in (2, 3))
        picked = sampled_together(runs, weight, sizes)
        bands = np.zeros((len(some), BANDS), np.uint64)
        for row in range(ROWS):
            bands = mixed(bands + picked[:, row::ROWS])
        short = picked.astype(np.uint32)
        for (at, words, _, _, held), own, names in zip(some, short, bands.view(np.int64).tolist()):
            digest = hashlib.md5(words.tobytes(), usedforsecurity=False).digest()
            rows[at] = digest, len(words), names, own.tobytes(), held

    waiting = 0
    for words, runs in read(texts):
        rows.append((None, 0, None, None, None))
        if len(words):
            names, counts = shingles(runs)
            some.append((len(rows) - 1, words, names, *weigh(names, counts)))
            waiting += len(names)
        if waiting >= RACE_RUNS:
            told()
            some, waiting = [], 0
    if some:
        told()
    return pd.DataFrame(rows, columns=["digest", "words", "bands", "samples", "held"])


def signer(common: tuple[np.ndarray, np.ndarray]) -> Callable[[pd.Series], pd.DataFrame]:
    def sign(texts: pd.Series) -> pd.DataFrame:
        return signatures(texts, lambda runs, counts: (weights(runs, counts, common), None)).drop(columns="held")

    return sign


def signed_part(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """The signatures of a part's texts, and for each the documents that hold its runs, in order."""
    replies = replies.sort_values("range")
    names = np.concatenate([_numbers(r, 8) for r in replies["runs"]])
    more = np.concatenate([_numbers(h, 8) for h in replies["held"]])
    docs = int(replies["docs"].iloc[0])

    def weigh(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, bytes]:
        held = np.ones(len(runs), np.uint64)
        if len(names):
            at = np.minimum(np.searchsorted(names, runs), len(names) - 1)
            found = names[at] == runs
            held[found] = more[at[found]]
        return (1 + np.log(counts)) * idf(held / docs, 0.0), zlib.compress(held.tobytes(), 1)

    got = signatures(texts["text"], weigh)
    return pd.concat([texts[["key", "doc_id", "copies"]].reset_index(drop=True), got], axis=1).assign(docs=docs)


SIGNED = "key long, doc_id long, copies long, digest binary, words long, bands array<long>, samples binary, held binary, docs long"
REQUEST = "part int, range int, runs binary, held binary, docs long"


def signed_by_every_run(documents: DataFrame) -> DataFrame:
    """Signatures by the idf of every run, with the number of documents that have runs."""
    texts, parts = dealt(documents)
    ranges = -(-parts // RANGE_PARTS)
    requests = texts.groupBy("part").applyInPandas(
        lambda key, group: asked(int(key[0]), group, ranges), REQUEST
    )
    replies = requests.groupBy("range").applyInPandas(told, REQUEST)
    return texts.groupBy("part").cogroup(replies.groupBy("part")).applyInPandas(signed_part, SIGNED)


def signed_by_common_runs(documents: DataFrame, sent: Broadcast) -> DataFrame:
    """Signatures by the floored idf."""
    sign = F.pandas_udf(
        lambda t: signer(sent.value)(t), "digest binary, words long, bands array<long>, samples binary"
    )
    return (
        row_key(documents.select(F.col("doc_id").cast("long"), "text"))
        .select("key", "doc_id", F.lit(1).cast("long").alias("copies"), sign("text").alias("s"))
        .select("key", "doc_id", "copies", "s.*", F.lit(None).cast("binary").alias("held"))
    )


def verified(
    group: pd.DataFrame, weigh: Callable[[np.ndarray, np.ndarray, bytes | None], np.ndarray]
) -> pd.DataFrame:
    """A forest of links with a similarity of 0.8 or more that connects all such links.

    Rows are (key, block, text, samples, held). If the blocks are two, only pairs
    across them are compared. The row that agrees most with the others comes
    first, as a text from which many others were made will connect them.
    """
    group = group.sort_values("key", kind="stable")
    keys, block = group["key"].to_numpy(np.int64), group["block"].to_numpy()
    samples = np.array([np.frombuffer(s, np.uint32) for s in group["samples"]])
    features = []
    for (_, own), held in zip(read(group["text"]), group["held"]):
        runs, counts = shingles(own)
        features.append((runs, weigh(runs, counts, held)))
    total = np.array([w.sum() for _, w in features])
    across = len(set(block.tolist())) > 1

    def agreeing(i: int) -> np.ndarray:
        found = (samples == samples[i]).sum(axis=1)
        if across:
            found[block == block[i]] = 0
        found[i] = 0
        return found

    drawn = np.array([(a * (a >= AGREE)).sum() for a in map(agreeing, range(len(keys)))])
    group_of = np.arange(len(keys))
    ends: list[tuple[int, int]] = []
    for i in np.argsort(-drawn, kind="stable"):
        if not drawn[i]:
            break
        agree = agreeing(i)
        for j in np.argsort(-agree, kind="stable"):
            if agree[j] < AGREE:
                break
            if group_of[i] == group_of[j] or min(total[i], total[j]) < SIMILAR * max(total[i], total[j]):
                continue
            if similarity(features[i], features[j]) >= SIMILAR:
                ends.append((int(keys[i]), int(keys[j])))
                group_of[group_of == group_of[j]] = group_of[i]
    return pd.DataFrame(ends, columns=["a", "b"], dtype=np.int64)


def row_key(documents: DataFrame) -> DataFrame:
    return documents.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def classes(documents: DataFrame, exact: bool = False) -> DataFrame:
    """(key, doc_id, copies, class_key, class_id) for the distinct rows of (doc_id, text).

    ``key`` is the row's own and ``copies`` the number of rows that have it. A
    class is what links connect; ``class_key`` is the key of the member with the
    smallest (doc_id, key), rows without an id last, and ``class_id`` its doc_id.
    Texts of equal words are one text. Those without words, null ones among them,
    link with nothing. Texts are sampled and compared whole, whatever their length,
    and no rows give no rows. The idf of runs is floored at a tenth of the documents;
    with ``exact`` it is not, and the documents of every run are counted.
    """
    if exact:
        signed = keep(signed_by_every_run(documents), "signatures")
        docs = signed.agg(F.max("docs")).first()[0]

        def weigh(runs: np.ndarray, counts: np.ndarray, held: bytes | None) -> np.ndarray:
            return (1 + np.log(counts)) * idf(np.frombuffer(zlib.decompress(held), np.uint64) / docs, 0.0)

    else:
        sent = documents.sparkSession.sparkContext.broadcast(common_runs(documents.select("text")))
        signed = keep(signed_by_common_runs(documents, sent), "signatures")

        def weigh(runs: np.ndarray, counts: np.ndarray, held: bytes | None) -> np.ndarray:
            return weights(runs, counts, sent.value)

    rows = signed.groupBy("key", "doc_id", "digest").agg(F.sum("copies").alias("copies"))
    # one of the rows with the same words stands for all
    stands = keep(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("key").alias("node"))
        .join(
            signed.select("digest", F.col("key").alias("node"), "words", "bands", "samples", "held"),
            ["digest", "node"],
        )
        .dropDuplicates(["node"]),
        "texts",
    )
    met = stands.select("node", F.posexplode("bands").alias("band", "bucket"))
    lowest = met.groupBy("band", "bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    family = components(
        met.join(lowest, ["band", "bucket"]).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    ).withColumnRenamed("component", "family")
    members = keep(family.join(stands.select("node", "words", "samples", "held"), "node"), "families")
    sizes = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))
    # a family of more than a block is cut in blocks, and every two blocks meet
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("first"), F.greatest("block", o).alias("second")),
    )
    placed = (
        members.drop("words")
        .join(sizes.select("family", blocks.alias("blocks")), "family")
        .withColumn("block", mine)
        .select("node", "family", "samples", "held", "block", F.explode(others).alias("pair"))
    )
    texts = row_key(documents.select(F.col("doc_id").cast("long"), "text")).select(F.col("key").alias("node"), "text")
    compared = (
        placed.join(texts, "node")
        .dropDuplicates(["node", "family", "pair"])
        .select(F.col("node").alias("key"), "family", "samples", "held", "block", "text", "pair.first", "pair.second")
        .groupBy("family", "first", "second")
        .applyInPandas(lambda group: verified(group, weigh), "a long, b long")
    )
    linked = components(keep(compared, "links")).withColumnRenamed("component", "root")
    rooted = (
        rows.join(stands.select("digest", "node"), "digest", "left")
        .join(linked, "node", "left")
        .select("key", "doc_id", "copies", F.coalesce("root", "node", "key").alias("root"))
    )
    rooted = keep(rooted, "classes")
    first = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    )
    return rooted.join(first, "root").select(
        "key", "doc_id", "copies", F.col("first.key").alias("class_key"), F.col("first.doc_id").alias("class_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The first document of every class, in its own columns.

    Of several rows with the same doc_id and text it is the one whose columns are
    first as JSON text, so that every run keeps the same one. The documents of every
    run of words are counted, as in op3.
    """
    names = documents.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    stays = classes(documents.select("doc_id", "text"), exact=True).where("key = class_key").select("key", "copies")
    rows = row_key(documents.select(row, F.col("doc_id").cast("long"), "text")).select("_row", "key").join(stays, "key")
    once = rows.where("copies = 1").select("_row")
    more = rows.where("copies > 1").groupBy("key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    more = more.select("_row")
    return once.unionByName(more).select(*(F.col("_row")[c].alias(c) for c in names))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every document, and whether it stays; a row for each row of the table."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = classes(docs, exact=True)
    return found.select(
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"),
        "doc_id",
        "class_id",
        (F.col("key") == F.col("class_key")).alias("stays"),
    ).select("doc_id", "class_id", (F.col("stays") & (F.col("nth") == 1)).alias("kept"))
