"""Nearest neighbours against all products."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neighbours as nb

KIND = "id long, vector array<float>"


def searched(spark, rows, queries=None, **options):
    vectors = spark.createDataFrame(rows, KIND)
    found = nb.nearest(vectors, vectors.filter("id % 20 = 0") if queries is None else queries, **options).orderBy("query_id", "rank").collect()
    out = {}
    for r in found:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(rows, got, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = nb.exact(np.broadcast_to(x[i], x.shape), x)
        scores[ids == ids[i]] = -np.inf
        want = np.lexsort((ids, -scores))[:k]
        own = got[int(ids[i])]
        assert [p for p, _, _ in own] == list(range(1, k + 1)) and own == sorted(own, key=lambda z: (-z[2], z[1]))
        assert all(s == scores[np.flatnonzero(ids == v)[0]] for _, v, s in own)
        hits, total = hits + len(set(ids[want].tolist()) & {v for _, v, _ in own}), total + k
    return hits / total


def rows_of(x):
    return [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(x)]


def test_random_directions(spark):
    x = np.random.default_rng(1).standard_normal((3000, 24))
    rows = rows_of(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall(rows, searched(spark, rows), 20) >= 0.93


def test_clusters_and_unlike_norms(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 30))
    x = base[rng.integers(0, 40, 2500)] + 0.3 * rng.standard_normal((2500, 30))
    rows = rows_of(x * rng.choice([0.1, 1.0, 2.0, 30.0], (2500, 1)))
    assert recall(rows, searched(spark, rows, k=10), 10) >= 0.93


def test_the_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in nb.op12_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert recall(rows, got, 20) >= 0.95


def test_what_takes_no_part_copies_and_ties(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (9, [2.0, 5.0]), (None, [9.0, 9.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (40, [float("inf"), 1.0]), (60, [1.0, 1.0, 1.0]), (61, [4.0, 4.0, 4.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, []), (0, None)]
    got = searched(spark, rows, k=4)
    assert got == {20: [(1, 2, 2.0), (2, 3, 2.0), (3, 9, 2.0), (4, 11, 1.0)], 60: [(1, 61, 12.0)]}


def test_many_copies(spark):
    """A third of all rows is one vector: its copies fill the ranks of each of them, and the rest is found all the same."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x[::3] = x[0]
    rows = rows_of(x)
    got = searched(spark, rows, k=5)
    assert recall(rows, got, 5) >= 0.93
    assert [v for _, v, _ in got[60]] == [0, 3, 6, 9, 12] and [v for _, v, _ in got[0]] == [3, 6, 9, 12, 15]


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 50)
    x = np.random.default_rng(4).standard_normal((800, 8))
    assert recall(rows_of(x), searched(spark, rows_of(x), k=7), 7) >= 0.93


def test_empty_and_clashing_columns(spark):
    vectors = spark.createDataFrame([(20, [1.0, 2.0], 1, 2, 3), (21, [2.0, 2.0], 1, 2, 3)], f"{KIND}, score int, query int, bucket int")
    assert [tuple(r) for r in nb.nearest(vectors, vectors).orderBy("query_id").collect()] == [(20, 1, 21, 6.0), (21, 1, 20, 6.0)]
    assert nb.nearest(vectors, vectors.limit(0)).count() == 0 and nb.nearest(vectors.limit(0), vectors).count() == 0
    assert nb.nearest(vectors.limit(1), vectors.limit(1)).count() == 0


def test_the_rotation_and_its_codes():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 64))
    y = nb.hadamard(x)
    assert np.allclose((y * y).sum(axis=1), (x * x).sum(axis=1)) and np.allclose(nb.hadamard(y), x)
    for rows in (100, 600, 9000, 200_000):
        tables = nb.Tables(20, rows, 9.0, tables=3)
        assert np.prod([2 * a for a in tables.axes]) <= max(1, rows / nb.BUCKET)
        unit = tables.unit(rng.standard_normal((40, 20)), True)
        # A vector's own bucket is the first that it looks into, and no bucket comes twice.
        probes = tables.probes(unit, 6)
        assert (probes[:, :, 0] == tables.codes(unit)).all() and (tables.ranks(unit, unit) == 0).all()
        assert all(len(set(p[p >= 0])) == (p >= 0).sum() for row in probes for p in row)


def test_ranks_count_the_buckets_before():
    rng = np.random.default_rng(6)
    tables = nb.Tables(12, 40_000, 9.0, tables=2)
    q, v = (tables.unit(rng.standard_normal((30, 12)), True) for _ in range(2))
    count = int(np.prod([2 * a for a in tables.axes]))
    probes, codes = tables.probes(q, count), tables.codes(v)
    want = [min(int(np.flatnonzero(probes[i, t] == codes[i, t])[0]) for t in range(2)) for i in range(30)]
    assert tables.ranks(q, v).tolist() == want


def test_more_queries_than_rows_of_the_table(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 6)], KIND)
    queries = spark.createDataFrame([(100 + k, [1.0, float(k)]) for k in range(200)], KIND)
    got = nb.nearest(vectors, queries, k=3).groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("vec_id", "score").alias("top")).collect()
    assert len(got) == 200 and all(r.n == 3 and r.top == 5 for r in got)
