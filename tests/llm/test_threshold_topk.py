"""Top-k search against scoring of all pairs, and how much of the lists it walks."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry_module
from tidewatch.llm import threshold_topk
from tidewatch.llm.threshold_topk import Best, Block, Queries, top_k, walk
from pyspark.sql import functions as F


def every_pair(rows, asks, k):
    """rows: (id, vector) in any order; the answers as sorted lists."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(good):
        if q is None or not asks(q):
            continue
        scores = [(-sum(a * b for a, b in zip(w, v)), i is None, i or 0) for j, (i, v) in enumerate(good) if j != at]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def answers(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(params=[3, 4096])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(threshold_topk, "BLOCK_ROWS", request.param)
    return request.param


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = answers(entry_module.queries()["op13_exact_topk"](spark, sf_dir))
    assert got == every_pair(rows, lambda i: i % 50 == 0, 5) and len(got) == 5 * len([i for i, _ in rows if i % 50 == 0])


ODD = [
    (0, [0.5, -0.25, 1.0]), (0, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (None, [0.5, -0.25, 1.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (50, [float("inf"), 0.0, 0.0]),
    (100, []), (150, [0.0, 0.0, 0.0]), (200, [-1.0]), (250, [3.0, 4.0, 5.0, 6.0]), (7, [0.001, -0.001, 0.0]), (8, [-3.0, 0.0, 0.5]), (-50, [1.0, 1.0, 1.0]), (9, [1e9, -1e9, 1e3]),
]


def test_odd_rows(spark, block_rows, monkeypatch):
    docs = spark.createDataFrame([(i, v, "own", 1) for i, v in ODD * 2], "vec_id long, embedding array<double>, _block string, score int").coalesce(1)
    monkeypatch.setattr(threshold_topk, "BATCH_QUERIES", 2)
    for k in (1, 4, 100):
        assert answers(top_k(docs, F.col("vec_id") % 50 == 0, k)) == every_pair(ODD * 2, lambda i: i % 50 == 0, k)
    assert top_k(docs.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0
    assert top_k(docs, F.lit(None).cast("boolean"), 3).count() == 0


def test_random_vectors_with_many_ties(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 256]) for i in rng.permutation(150)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(top_k(docs, F.col("vec_id") % 7 == 0, 5)) == every_pair(rows, lambda i: i % 7 == 0, 5)


def block_of(vectors, number=0):
    lists = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
    n = len(vectors)
    return Block(number, vectors, lists, np.arange(n), np.zeros(n, bool), np.empty(0, np.int32))


def test_the_walk_stops_at_the_threshold():
    """Where a few dimensions carry the weight, few rows are scored, and later blocks fewer still."""
    rng = np.random.default_rng(1)
    shape = 256 / 2 ** np.arange(10)
    vectors = np.floor(rng.standard_normal((20_000, 10)) * shape).astype(np.int64)
    asked = Queries(np.full(40, 9), np.arange(40), np.arange(40), np.floor(rng.standard_normal((40, 10)) * shape).astype(np.int64))
    best, scored = Best(40, 5), []
    for b in range(5):
        scored.append(walk(block_of(vectors[4000 * b : 4000 * (b + 1)], b), asked, best))
    assert sum(scored) < 0.25 * 40 * 20_000 and scored[-1] < scored[0]
    want = -np.sort(-(asked.vectors @ vectors.T), axis=1)[:, :5]
    assert (np.array([r[0] for r in best.rows]) == want).all()


@pytest.mark.parametrize("size", [3, 2_000, 2**20, 2**26, 2**28])
def test_scores_are_exact_at_any_size(size):
    rng = np.random.default_rng(size)
    vectors, asked = (rng.integers(-size, size, (n, 8)) for n in (300, 9))
    best = Best(9, 4)
    walk(block_of(vectors), Queries(np.full(9, 5), np.arange(9), np.arange(9), asked), best)
    want = [sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), i) for i, v in enumerate(vectors))[:4] for q in asked]
    assert [[(-s, i) for s, i, _ in zip(*map(np.ndarray.tolist, r))] for r in best.rows] == want


def test_scores_beyond_64_bits_raise():
    vectors = np.full((2, 4), 2**40)
    with pytest.raises(ValueError):
        walk(block_of(vectors), Queries(np.array([5]), np.array([0]), np.array([0]), vectors[:1]), Best(1, 1))
