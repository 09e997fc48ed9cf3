from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_minhash import brute_classes
from test_secrets_tokens import base_spans
from test_sharding_mixing_packing import check_packing

from tablefeed.llm.quality import judged
from tablefeed.llm.secrets import spans_of

FOLDER = "/root/testdata/sf0.01"


def staged(spark, docs, folder, path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], folder).write.parquet(f"{path}/{name}")
        out.append(spark.read.parquet(f"{path}/{name}"))
    return out


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given, fine, unique, masked, mixed, packed = staged(spark, docs, FOLDER, tmp_path)
    for stage in (fine, unique, masked, mixed):
        assert stage.columns == given.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in fine.collect()}
    assert all(i in kept for i, good in labels.items() if good)
    assert sum(i in kept for i, good in labels.items() if not good) <= 0.05 * sum(not g for g in labels.values())
    want = brute_classes({r.doc_id: r.text for r in fine.collect()})
    assert {r.doc_id for r in unique.collect()} == set(want.values())
    before = {r.doc_id: r.text for r in unique.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert after[i].n_chars == len(after[i].text)
        assert (after[i].text == text) == (not spans_of(text))
        assert not base_spans(after[i].text)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3
    rows = packed.collect()
    check_packing(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == copies


def test_awkward_rows_pass_through(spark, awkward, tmp_path):
    clash = awkward.withColumns({"key": F.lit(1), "keep": F.lit("k"), "sequence_id": F.lit(2)})
    *_, mixed, packed = staged(spark, clash, str(tmp_path), f"{tmp_path}/a")
    assert mixed.columns == clash.columns
    check_packing(packed.collect())
    assert staged(spark, awkward.limit(0), str(tmp_path), f"{tmp_path}/b")[-1].count() == 0


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_packing(rows)
    assert len(rows) > 50


def test_rows_that_differ_in_other_columns_are_chosen_alike(spark):
    """One document repeated under other languages and sizes, in two orders and partitionings."""
    text = " ".join(f"word{i} and" for i in range(80))
    rows = [(7, text, lang, "s", n) for n, lang in enumerate(["de", "en", "fr", "es"] * 5)]
    rows += [(i, f"{text} number {i} " * 3, "en", "t", i) for i in range(30, 40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given = [
        spark.createDataFrame(rows, schema).repartition(3),
        spark.createDataFrame(rows[::-1], schema).coalesce(1),
    ]
    stages = dict(corpus_pipeline.STAGES)
    for stage in ("near_dedup", "mixing"):
        got = [sorted(map(tuple, stages[stage](spark, docs, None).collect())) for docs in given]
        assert got[0] == got[1] and got[0]


def test_the_scorer_is_the_same_on_every_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    many = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50))
    scores = []
    for rows in (many.repartition(7), many.orderBy(F.desc("text")).coalesce(2)):
        found = judged(rows, sample=100).select("text", "_judged.score").collect()
        scores.append(sorted(map(tuple, found), key=repr))
    assert scores[0] == scores[1]
