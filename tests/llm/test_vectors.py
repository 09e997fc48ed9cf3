import duckdb
import numpy as np
import pytest
from compare import differences, oracle_connection
from pyspark.sql import functions as F

from tablefeed.llm.common import components
from tablefeed.llm.embed_dedup import OP1_SQL, linked, op1_embedding_near_dedup
from tablefeed.llm.neighbours import OP8_SQL, nearest, op8_nearest_neighbours

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed, groups, size, dimension=16, spread=0.08):
    """Vectors about some centres, at cosines on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dimension))
    rows = []
    for g, centre in enumerate(centres):
        for _ in range(size):
            vector = centre + rng.standard_normal(dimension) * spread * rng.choice([0, 1, 2, 3])
            rows.append((len(rows), (vector * rng.choice([1, 5])).astype(np.float32).tolist(), int(g % 3)))
    return rows


def brute_links(rows):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    label = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    component = ids.copy()
    for _ in ids:
        new = np.array([min(component[i], component[near[i]].min(initial=component[i])) for i in range(len(ids))])
        if (new == component).all():
            break
        component = new
    return {i: (int(n), int(c)) for i, n, c in zip(ids.tolist(), near.sum(1), component)}


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, block):
    rows = clustered(4, 12, 25)
    got = {r.vec_id: r for r in linked(spark.createDataFrame(rows, SCHEMA), block).collect()}
    want = brute_links(rows)
    assert sum(n for n, _ in want.values()) > 1000
    missed = sum(got[i].n_links != n for i, (n, _) in want.items())
    # the hashing may miss a few pairs right at the threshold, and none is made up
    assert all(got[i].n_links <= n for i, (n, _) in want.items()) and missed <= 6
    assert sum(got[i].component_id != c for i, (_, c) in want.items()) == 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_query_equals_sql(spark):
    assert differences(op1_embedding_near_dedup(spark, FOLDER), oracle_connection(FOLDER), OP1_SQL) == []


AWKWARD = [
    (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
    (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (None, [1.0, 0.0], 1),
    (10, [1.0, 0.0, 0.0], 1), (11, [float("inf"), 1.0], 1), (2, [2.0, 0.0], 1), (12, [1e-30, 0.0], 1), (20, [3.0, 0.1], 1),
]


def test_awkward_vectors(spark, folder_of):
    rows = spark.createDataFrame(AWKWARD, SCHEMA).withColumns({"rep": F.lit(1), "key": F.lit("k"), "score": F.lit(0)})
    folder = folder_of(embeddings=rows)
    found = op1_embedding_near_dedup(spark, folder)
    assert differences(found, vectors_connection(folder), OP1_SQL) == []
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found.collect()))
    # One row per vector: 2 is there twice, and the one without an id links too.
    linked_ids = [(0, 5, 1, False), (1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False)]
    linked_ids += [(12, 5, 1, False), (20, 5, 1, False)]
    assert got == sorted(linked_ids + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)])
    near = [(r.query_id, r["rank"], r.vec_id) for r in op8_nearest_neighbours(spark, folder).orderBy("rank").collect()]
    assert near == [(20, 1, 2), (20, 2, 3), (20, 3, 1), (20, 4, 4), (20, 5, 12)]
    empty = rows.limit(0)
    assert linked(empty).count() == 0 and nearest(empty, empty).count() == 0
    assert nearest(rows.where("vec_id = 1"), rows.where("vec_id = 1")).count() == 0


def vectors_connection(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return con


def test_different_vectors_that_share_an_id_stay_apart(spark, folder_of):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (None, [5.0, 1.0], 2), (7, [5.0, 5.0], 1)]
    folder = folder_of(embeddings=spark.createDataFrame(rows * 3, SCHEMA))
    found = op1_embedding_near_dedup(spark, folder)
    assert differences(found, vectors_connection(folder), OP1_SQL) == []
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in found.collect())
    assert got == sorted([(1, 2, 1), (1, 5, 1), (0, 5, 1), (0, 2, 0), (7, 2, 7)] * 3)


def test_thousands_of_equal_vectors_tie_exactly(spark):
    rng = np.random.default_rng(9)
    kinds = rng.standard_normal((5, 64)).astype(np.float32)
    of = rng.integers(0, 5, 4000)
    rows = spark.createDataFrame([(i, kinds[k].tolist()) for i, k in enumerate(of.tolist())], "vec_id long, embedding array<float>")
    found = nearest(rows, rows.where("vec_id % 20 = 0"), 20, shard_rows=700, query_rows=64).collect()
    x = kinds.astype(np.float64)
    scores = {}
    for q in range(0, 4000, 20):
        best = np.argsort(-(x @ x[of[q]]), kind="stable")
        want = [i for k in best for i in np.flatnonzero(of == k).tolist() if i != q][:20]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == want
        for r in own:
            assert scores.setdefault((of[q], of[r.vec_id]), r.score) == r.score


@pytest.mark.parametrize("factor", [1.0, 1.1])
def test_neighbours_against_brute_force(spark, factor):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((3000, 8)) * rng.choice([0.5, 1, 3], (3000, 1))).round(1).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(rows, rows.where("vec_id % 20 = 0"), 20, factor, shard_rows=1000, query_rows=64).collect()
    x, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -score.round(9))) if i != q][:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & set(order))
    assert hits / (150 * 20) >= (1.0 if factor == 1 else 0.9)


def test_neighbours_of_all_vectors(spark):
    con = oracle_connection(FOLDER)
    want = {(r[0], r[1]): r[2:] for r in con.execute(OP8_SQL).fetchall()}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in op8_nearest_neighbours(spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    low = {n: n for e in edges for n in e}
    for _ in range(500):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: c for n, c in low.items() if n in got}
    assert {n for a, b in edges if a != b for n in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
