"""The pipeline's near_dedup weighs every run of words by the number of documents that hold it, as op3 does."""

import corpus_pipeline
import numpy as np
from test_minhash_idf import brute_classes, edited

from tablefeed.llm.minhash import classes


def test_the_pipeline_weighs_every_run(spark):
    """Its near_dedup keeps what brute force by the idf of every run keeps, of groups of 2, 12 and 40 near copies."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, rng.integers(3, 90))) for _ in range(300)]
    for size, groups in ((2, 30), (12, 5), (40, 1)):
        for _ in range(groups):
            words = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
            texts += [edited(rng, words, rng.choice([0, 1, 2, 3])) for _ in range(size)]
    rows = list(enumerate([*texts, None, "", texts[-1]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    near_dedup = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = sorted(r.doc_id for r in near_dedup(spark, docs, None).collect())
    want = sorted(set(brute_classes(rows).values()))
    floored = {r.class_id for r in classes(docs).collect()}
    assert got == want
    assert len(floored) < len(want) < len(rows) - 50
