import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tidewatch.llm import attention_lm, byte_bpe, lm_scoring

TEXTS = ["", "one", " ".join(f"A{i}" for i in range(48)), " ".join(f"b{i}\n" for i in range(49)), "x " * 200, " \t\n", "Straße İ  kangaroo" * 40]


@pytest.mark.parametrize("share", [1, 3])
@pytest.mark.parametrize("kind", [">u2", ">u4"])
def test_packed_stretches_are_those_of_each_text(share, kind):
    ids = lambda w: [len(w), *w.encode()[:3], 300]
    found = lm_scoring.packed_spans(pa.array(TEXTS), lambda words: list(map(ids, words)), 999, share, kind)
    want = [[999] * a + [i for w in words for i in ids(w.decode())] + [999] * b for t in TEXTS for words, a, b in lm_scoring.spans_of(t, share)]
    assert [np.frombuffer(s, kind).tolist() for s in found.to_pylist()] == want
    assert len(lm_scoring.packed_spans(pa.array([], pa.string()), lambda words: list(map(ids, words)), 999, share, kind)) == 0


def test_stretches_are_stored_in_two_bytes_an_id(spark):
    vocabulary = byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(t, True) for t in TEXTS + TEXTS], "t string, own boolean")
    rows = lm_scoring._spans(docs, spark.sparkContext.broadcast(vocabulary), "t", "own", 1).collect()
    assert rows and all(len(r.packed) == 2 * len(r.ids) and np.frombuffer(r.packed, ">u2").tolist() == r.ids for r in rows)
    assert len({bytes(r.packed) for r in rows}) == len(rows)


def test_sums_by_index():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        index, rows = rng.zipf(1.5, n) % 90, rng.normal(size=(n, 5)).astype(np.float32)
        own, sums = attention_lm._sums(index, rows)
        want = np.zeros((90, 5))
        np.add.at(want, index, rows)
        assert own.tolist() == np.unique(index).tolist()
        np.testing.assert_allclose(sums, want[own], atol=1e-4)


def test_rows_that_no_step_touches_coast_as_in_dense_adam():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(6, 3)).astype(np.float32)
    dense, first, second, rate = table.astype(np.float64), np.zeros((6, 3)), np.zeros((6, 3)), 0.01
    sparse = attention_lm._Adam(table.copy())
    for step in range(1, 60):
        own = np.array(sorted(random.Random(step).sample(range(6), 2 + step % 4)))
        g = np.zeros((6, 3))
        g[own] = rng.normal(size=(len(own), 3)) + 0.5
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        dense -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        sparse.read(own, step, rate)
        sparse.write(g[own].astype(np.float32), step, rate)
    np.testing.assert_allclose(sparse.read(np.arange(6), 60, rate), dense, atol=0.03)


def test_fits_are_joined_in_a_task_as_their_sums_are():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 30, rng.integers(2, 90)) for _ in range(40)]
    counts = np.bincount(np.concatenate(seqs), minlength=30).astype(float)
    start = attention_lm.learn(seqs[:20], 30, counts)
    fits = [attention_lm.learn(part, 30, counts, epochs=1, start=start) for part in (seqs[:30], seqs[30:])]
    sums = attention_lm.Sums(30)
    for f in fits:
        sums.add(f)
    found = sums.joined()
    for t, weight, row in zip(found.tokens, found.weight, found.rows):
        own = [(f.weight[f.tokens == t][0], f.rows[f.tokens == t][0]) for f in fits if (f.tokens == t).any()]
        assert weight == sum(w for w, _ in own)
        np.testing.assert_allclose(row, sum(w * r for w, r in own) / weight, rtol=1e-3, atol=1e-5)
