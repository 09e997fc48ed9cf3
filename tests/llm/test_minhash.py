import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefeed.llm import minhash
from tablefeed.llm.minhash import classes, common_runs, one_of_each, op3_minhash_near_dedup, sampled, similarity

FOLDER = "/root/testdata/sf0.01"


def brute_classes(texts):
    """Class ids by comparing all texts that share a run of five words, by (id, text)."""
    runs = {}
    for i, text in texts.items():
        words = re.findall(r"\w+", (text or "").lower())
        size = min(5, len(words))
        runs[i] = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()
    some = [c for c in runs.values() if c]
    df = Counter(run for c in some for run in c)
    weight = {
        i: {r: (1 + math.log(n)) * math.log(1 + 1 / max(df[r] / len(some), 0.1)) for r, n in c.items()}
        for i, c in runs.items()
    }
    holders = defaultdict(list)
    for i, w in weight.items():
        for r in w:
            holders[r].append(i)
    low = {i: i for i in texts}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    near = Counter()
    for i, w in weight.items():
        shared = Counter()
        for r in w:
            for j in holders[r]:
                if j > i:
                    shared[j] += min(w[r], weight[j][r])
        for j, s in shared.items():
            value = s / (sum(w.values()) + sum(weight[j].values()) - s)
            near[round(value, 1)] += 1
            if value >= 0.8:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("block", [1000, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    want = brute_classes(dict(docs.collect()))
    assert len(set(want.values())) < len(want) - 50
    assert got == want


def test_edits_at_both_sides_of_the_threshold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 300)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 3, 5, 9, 15):
            own = list(words)
            for at in rng.choice(300, edits, replace=False):
                own[at] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    want = brute_classes(dict(rows))
    assert len(set(want.values())) < 160
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 2


def test_pairs_just_above_the_threshold_are_linked(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(2_000):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 45)]
        # 33 of 41 runs are shared, a similarity of 0.805, and no third text connects the two
        rows += [(2 * g, " ".join(words[:41])), (2 * g + 1, " ".join(words[:37] + words[41:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    lost = sum(got[2 * g + 1] != 2 * g for g in range(2_000))
    assert lost <= 2  # 10 bands of 4 lose 8.6 of 2,000 in the mean, 16 of 4 lose 0.3


def test_common_runs_weigh_less(spark):
    shared = "this very line stands in all of the documents here"
    rows = [(i, f"{shared} " + " ".join(f"u{i}x{k}" for k in range(5 if i % 2 else 40))) for i in range(60)]
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    names, values = common_runs(docs)
    assert len(names) == 6 and np.allclose(values, math.log(1 + 460 / 60))
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert got == brute_classes(dict(rows))


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    agree, similar = [], []
    for _ in range(60):
        base = np.sort(rng.choice(2**62, 500, replace=False).astype(np.uint64))
        weight = np.exp(rng.normal(size=500))
        a, b = rng.random(500) < 0.8, rng.random(500) < 0.8
        other = weight * np.where(rng.random(500) < 0.5, 1, 1.4)
        first, second = (base[a], weight[a]), (base[b], other[b])
        agree.append((sampled(*first) == sampled(*second)).mean())
        similar.append(similarity(first, second))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.02


def test_awkward_rows_get_classes(spark, awkward, folder_of):
    clash = awkward.withColumns({"key": F.lit(1), "_row": F.lit(2), "copies": F.lit("c"), "digest": F.lit(0)})
    got = op3_minhash_near_dedup(spark, folder_of(documents=clash)).collect()
    assert len(got) == awkward.count()
    assert sorted((r.class_id, r.kept) for r in got if r.doc_id in (1, 7)) == [(1, False), (1, False), (1, True)]
    assert all(r.kept and r.class_id == r.doc_id for r in got if r.doc_id in (2, 3, 4, 5, 6, 8))
    rows = one_of_each(clash)
    assert rows.columns == clash.columns and rows.count() == 8
    assert classes(awkward.limit(0)).count() == 0
