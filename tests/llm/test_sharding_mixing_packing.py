import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefeed.llm.mixing import mixed, op2_mixing_sources, sized, take_copies
from tablefeed.llm.packing import (
    BIN_TOKENS,
    ids_from,
    laid_out,
    op10_best_fit_packing,
    packed,
    pieces,
    sequences,
    tokenizer_path,
)
from tablefeed.llm.sharding import (
    communication_matrix,
    hypergeometric,
    op6_sharding,
    shuffled_into_shards,
    write_shards,
)

FOLDER = "/root/testdata/sf0.01"


# -- sharding ---------------------------------------------------------------------


def test_hypergeometric_follows_its_law():
    rng = np.random.default_rng(3)
    draws = np.array([hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15
    assert abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    assert draws.min() >= 0 and draws.max() <= 20
    assert hypergeometric(rng, 0, 10, 5) == 0 and hypergeometric(rng, 10, 0, 5) == 5
    large = hypergeometric(rng, 10**12, 10**12, 10**9)
    assert abs(large - 5 * 10**8) < 10**6


def test_matrix_has_exact_sums():
    parts = [0, 5, 1000, 37, 1]
    matrix = communication_matrix(parts, 8, 5)
    assert matrix.sum(axis=1).tolist() == parts
    assert set(matrix.sum(axis=0).tolist()) <= {1043 // 8, 1043 // 8 + 1}


def check_shards(rows, shards):
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_all_documents(spark):
    got = op6_sharding(spark, FOLDER).collect()
    check_shards(got, 8)
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    for row in got:
        assert row.text_crc32 == zlib.crc32(texts[row.doc_id].encode())
        assert row.size == len(texts[row.doc_id].encode()) + 1
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {
        r.doc_id: (r.shard, r.slot) for r in op6_sharding(spark, FOLDER).collect()
    }


def test_many_small_parts_shuffle_evenly(spark):
    got = shuffled_into_shards(spark.range(4000), 5, part_rows=100).collect()
    check_shards(got, 5)
    means = [np.mean([r.slot for r in got if r.id // 1000 == q]) for q in range(4)]
    assert max(abs(m - 399.5) for m in means) < 40


def test_repeated_rows_are_spread(spark):
    rows = spark.range(8000).selectExpr("if(id < 3200, -1, id) a", "if(id < 3200, null, 'x') b")
    got = shuffled_into_shards(rows, 8, part_rows=1000).collect()
    check_shards(got, 8)
    for own in ([r for r in got if r.a == -1], [r for r in got if r.a != -1]):
        shards, places = Counter(r.shard for r in own), Counter(r.slot // 125 for r in own)
        for found in (shards, places):
            mean = len(own) / 8
            assert sum((found[i] - mean) ** 2 / mean for i in range(8)) < 24.3  # chi-square, 7 degrees, 0.001
    again = shuffled_into_shards(rows.repartition(5), 8, part_rows=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_awkward_rows_are_sharded(spark, awkward, folder_of):
    clash = awkward.withColumns({"shard": F.lit("mine"), "slot": F.lit(1), "part": F.lit(0)})
    got = op6_sharding(spark, folder_of(documents=clash)).collect()
    assert len(got) == awkward.count()
    check_shards(got, 8)
    check_shards(shuffled_into_shards(clash, 3).collect(), 3)
    assert shuffled_into_shards(awkward.limit(0)).count() == 0


def test_shards_are_written_whole(spark, awkward, tmp_path):
    write_shards(awkward, f"{tmp_path}/out", 2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(*awkward.columns).collect())) == sorted(map(str, awkward.collect()))


# -- mixing -----------------------------------------------------------------------


def water_level(sizes):
    """Targets by passing the excess on until no source is above three times its size."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weights[s] for s in sizes if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("group", [2, 7, 200])
def test_mix_of_all_documents(spark, group):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = mixed(sized(docs), group).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    texts = dict(docs.select("doc_id", "text").collect())
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]))
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    assert sorted(r.doc_id for r in got) == sorted(texts)
    target = water_level(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        share = r.target / r.source_size
        assert int(share + 1e-9) <= r.copies <= int(share + 1e-9) + 1
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())


def test_chances_are_kept(spark):
    docs = spark.range(3000).selectExpr(
        "id doc_id", "if(id % 3 = 0, 'a', 'b') source", "1 + id % 7 size", "xxhash64(id) copy_key"
    )
    got = mixed(docs, 20).collect()
    for length in range(1, 8):
        own = [r for r in got if r.size == length and r.source == "b"]
        assert abs(np.mean([r.copies for r in own]) - own[0].target / own[0].source_size) < 0.12


def test_repeated_rows_are_mixed(spark):
    docs = spark.range(60_000).selectExpr(
        "if(id < 30000, null, id) doc_id", "if(id % 3 = 0, 'a', 'b') source", "5L size", "if(id < 30000, 7, xxhash64(id)) copy_key"
    )
    got = mixed(docs)
    assert got.count() == 60_000
    told = got.groupBy("source", F.col("doc_id").isNull().alias("same")).agg(
        F.avg("copies").alias("copies"), F.max(F.col("target") / F.col("source_size")).alias("share"), F.count("*").alias("n")
    )
    for r in told.collect():
        assert r.n in (10_000, 20_000) and abs(r.copies - r.share) < 0.02
    taken = got.groupBy("source").agg((F.sum(F.col("copies") * 5) - F.max("target")).alias("off")).collect()
    assert all(abs(r.off) <= 5 for r in taken)
    assert got.exceptAll(mixed(docs.repartition(7))).count() == 0


def test_sources_that_fill_up(spark):
    rows = [(1, "a", 10), (2, "b", 1000), (3, "c", 5), (4, None, 0), (5, "d", 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("copy_key", F.col("doc_id"))
    got = {r.source: r.target for r in mixed(docs).collect()}
    want = water_level({s: n for _, s, n in rows})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_awkward_rows_are_mixed(spark, awkward, folder_of):
    clash = awkward.withColumns({"size": F.lit(1), "copies": F.lit(2), "target": F.lit("t")})
    got = op2_mixing_sources(spark, folder_of(documents=clash)).collect()
    assert len(got) == awkward.count()
    assert all(r.taken <= 3 * r.size for r in got)
    rows = take_copies(clash)
    assert rows.columns == clash.columns
    assert rows.selectExpr("sum(size(split(trim(text), ' ')))").first()[0] > 0
    assert sum(r.taken > 0 for r in got if r.doc_id == 5) == rows.where("doc_id = 5").limit(1).count()
    assert mixed(sized(awkward.limit(0))).count() == 0


# -- packing ----------------------------------------------------------------------


def check_packing(rows, limit=BIN_TOKENS):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(places)


def test_packing_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = op10_best_fit_packing(spark, FOLDER).collect()
    bins = check_packing(got)
    assert bins <= 1 + -(-sum(r.length for r in got) // BIN_TOKENS)
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    of = defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    for doc_id, text in docs.collect():
        ids = exact.encode(text, add_special_tokens=False).ids + [1]
        parts = sorted(of[doc_id], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), BIN_TOKENS))
        for r in parts:
            own = np.asarray(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(own)
        assert sum(r.length for r in parts) == len(ids)


def test_ids_of_awkward_texts():
    from tokenizers import Tokenizer

    with open(tokenizer_path()) as file:
        spec = file.read()
    ids, exact = ids_from(spec), Tokenizer.from_str(spec)
    texts = [
        "It's we'LL I'd've", "a1b2 33", "ÀÉß ÷×¿ ª µ º ¼", "x\x1cy\x85z\xa0w", "İI ŉ ﬁ", "é Å",
        "<|endoftext|>a", "'''s '' 's", "___ a_b", "tab\t\n\r\x0b\x0c end ", "日本語 🙂", "", "ÿŸ", "don''t",
    ]
    for text in texts:
        want = np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert ids.of(text) == want, text


@pytest.mark.parametrize("seed", range(20))
def test_layout_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(1, 60))
    lengths = rng.integers(1, limit + 1, int(rng.integers(1, 300))).tolist()
    layout = laid_out(Counter(lengths), limit)
    bins, ranks = defaultdict(list), defaultdict(set)
    for p in layout.placements:
        n = max([q.first for q in layout.placements if q.length == p.length and q.first > p.first] or [0])
        nexts = [q.first for q in layout.placements if q.length == p.length and q.first > p.first]
        end = min(nexts) if nexts else Counter(lengths)[p.length]
        for rank in range(p.first, end):
            ranks[p.length].add(rank)
            nth = rank - p.first
            bins[p.bin + nth // p.each].append((p.offset + nth % p.each * p.length, p.length))
    assert {k: len(v) for k, v in ranks.items()} == Counter(lengths)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        assert sum(3 * length > limit for _, length in parts) <= 2
    assert len(bins) == layout.bins <= 1.3 * -(-sum(lengths) // limit) + 1 or sum(3 * n > limit for n in lengths) > 0


def test_awkward_rows_are_packed(spark, awkward, folder_of):
    clash = awkward.withColumns({"piece": F.lit(1), "length": F.lit("l"), "rank": F.lit(2)})
    got = op10_best_fit_packing(spark, folder_of(documents=clash)).collect()
    check_packing(got)
    assert len({r.doc_id for r in got}) == 9
    assert [r.length for r in got if r.doc_id == 3] == [1]
    assert packed(pieces(awkward.limit(0).select("doc_id", "text"), tokenizer_path())).count() == 0


def test_sequences_hold_the_documents(spark, awkward):
    cut = pieces(awkward.select("doc_id", "text"), tokenizer_path(), 50, with_ids=True)
    made = sequences(cut, 50).collect()
    total = cut.agg(F.sum("length")).first()[0]
    assert sum(len(r.ids) for r in made) == total and max(len(r.ids) for r in made) <= 50
