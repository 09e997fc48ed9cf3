"""op3 weighs every run of words by the number of documents that hold it."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablefeed.llm import minhash
from tablefeed.llm.minhash import classes, op3_minhash_near_dedup


def runs_in(text):
    words = re.findall(r"\w+", (text or "").lower())
    size = min(5, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def brute_classes(rows):
    """The smallest id of each class by (1 + ln tf) * ln(1 + N / df), for rows (id, text) of distinct ids."""
    runs = {i: runs_in(text) for i, text in rows}
    df = Counter(run for c in runs.values() for run in c)
    n = sum(map(bool, runs.values()))
    weight = {i: {r: (1 + math.log(k)) * math.log(1 + n / df[r]) for r, k in c.items()} for i, c in runs.items()}
    holders = defaultdict(list)
    for i, w in weight.items():
        for r in w:
            holders[r].append(i)
    low = {i: i for i in runs}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, w in weight.items():
        shared = Counter()
        for r in w:
            for j in holders[r]:
                if j > i:
                    shared[j] += min(w[r], weight[j][r])
        for j, s in shared.items():
            if s / (sum(w.values()) + sum(weight[j].values()) - s) >= 0.8:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in runs}


def edited(rng, words, edits):
    own = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        own[at] = f"x{rng.integers(10**9)}"
    return " ".join(own)


@pytest.mark.parametrize("chars", [1 << 24, 5_000])
def test_classes_by_the_idf_of_every_run(spark, folder_of, monkeypatch, chars):
    """Groups of 2, 12 and 40 near copies among 700 texts: one part, and many parts and ranges."""
    monkeypatch.setattr(minhash, "PART_CHARS", chars)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, rng.integers(3, 90))) for _ in range(500)]
    for size, groups in ((2, 40), (12, 5), (40, 1)):
        for _ in range(groups):
            words = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
            texts += [edited(rng, words, rng.choice([0, 1, 2, 3])) for _ in range(size)]
    rows = list(enumerate([*texts, None, "", "?!", texts[-1], texts[0].upper()]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in op3_minhash_near_dedup(spark, folder_of(documents=docs)).collect()}
    want = brute_classes(rows)
    floored = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert got == want
    assert floored != want  # the floor takes more of the large groups for near copies


def test_every_run_is_weighed_by_its_documents(spark):
    """36 of 46 runs are shared by either pair; what else holds the rest tells the two pairs apart."""
    rng = np.random.default_rng(9)
    word = (f"w{x}" for x in rng.permutation(10**6))
    rows = []
    for _ in range(2):
        words = [next(word) for _ in range(50)]
        rows += [(len(rows), " ".join(words[:45])), (len(rows) + 1, " ".join([*words[:40], *words[45:]]))]
    # the runs of the first pair that aren't shared are in 40 other texts each, and weigh less
    for first in (0, 1):
        tail = " ".join(rows[first][1].split()[-9:])
        rows += [(len(rows) + k, f"{tail} " + " ".join(next(word) for _ in range(60))) for k in range(40)]
    rows += [(len(rows) + k, " ".join(next(word) for _ in range(20))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in classes(docs, exact=True).collect()}
    assert [got[i] for i in range(4)] == [brute_classes(rows)[i] for i in range(4)] == [0, 0, 2, 3]


def test_equal_rows_count_as_documents_each(spark, folder_of, monkeypatch):
    """An (id, text) that stands in the table 300 times adds 300 to the documents of its runs."""
    words = [f"w{k}" for k in range(120)]
    twin = " ".join([*words[:110], *(f"y{k}" for k in range(10))])
    rows = [(1, " ".join(words))] * 300 + [(2, twin)] + [(10 + k, f"one other text {k} " * 9) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op3_minhash_near_dedup(spark, folder_of(documents=docs)).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got if r.doc_id == 1) == 1
    # 106 of 126 runs are shared, 0.84 by number; those are in 301 documents, the others of 2 in one
    assert [(r.class_id, r.kept) for r in got if r.doc_id == 2] == [(2, True)]
    once = spark.createDataFrame(sorted(set(rows)), "doc_id long, text string")
    assert [r.class_id for r in classes(once, exact=True).where("doc_id = 2").collect()] == [1]
