"""Periodic runs against a search of every period, on random, nested and planted texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_module
from tidewatch.llm import periodic_runs


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def every_run(words, least):
    """Stretches in which words a period apart are equal, for each period; the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def without_repetitions(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    rng = random.Random(5)
    yield from (fibonacci(200), "ab" * 10 + "a" + "ab" * 10 + "a", "a" * 97, "aab" * 40 + "ab" * 30, "abaab" * 9 + "b" + "abaab" * 9)
    for size in (1, 2, 3, 4):
        for n in (1, 5, 12, 13, 60, 150):
            for _ in range(12):
                yield "".join(rng.choices("abcd"[:size], k=n))
    for _ in range(150):
        # Periodic parts with errors, cut and glued, so that progressions of unlike phases meet.
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = "".join(rng.choices("ab", k=rng.randrange(1, 8)))
            part = list((unit * 30)[rng.randrange(5) : rng.randrange(6, 70)])
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = "c"
            parts.append("".join(part))
        yield "".join(parts) * rng.randrange(1, 3)


@pytest.mark.parametrize("least", [1, 12])
def test_runs_equal_a_search_of_every_period(least):
    texts = list(cases())
    words = np.concatenate([np.frombuffer(t.encode(), np.uint8) for t in texts]).astype(np.int64)
    document = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    runs = periodic_runs.runs_of(words, document, least)
    got = [[] for _ in texts]
    for s, m, q in zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist()):
        d = int(np.searchsorted(first, s, "right")) - 1
        got[d].append((s - int(first[d]), m, q))
    for t, g in zip(texts, got):
        assert g == every_run(t, least), t


def test_no_words_and_one_word():
    none = np.empty(0, np.int64)
    assert len(periodic_runs.runs_of(none, none).start) == 0
    assert len(periodic_runs.runs_of(np.array([3]), np.array([0])).start) == 0


def test_rows_and_clashing_columns_stay(spark, edge_docs, no_docs):
    docs = edge_docs.withColumnsRenamed({"n_words": "runs", "kept": "collapsed", "_key": "_body"})
    rows = periodic_runs.find_runs(docs, least=6).collect()
    assert len(rows) == docs.count() and {r["_body"] for r in rows} == {"own _key"}
    for r in rows:
        if r.text and len(r.text) < 5000:
            words = words_of(r.text)
            want = every_run(words, 6)
            assert [tuple(x) for x in r.runs] == want and r.collapsed == without_repetitions(words, want)
        elif not r.text:
            assert r.runs == [] and r.collapsed == ""
    assert periodic_runs.find_runs(no_docs).count() == 0
    long = next(r for r in rows if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 80_000, 2 * 977 * 13)] and len(words_of(long.collapsed)) == 2 * 977 * 13


def test_chunks_do_not_change_the_answer(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(fibonacci(40 + i))) for i in range(30)], "doc_id long, text string")
    whole = sorted(periodic_runs.find_runs(docs).collect())
    words = periodic_runs._words
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 20)
    small = [periodic_runs._answer(words(__import__("pyarrow").array([r.text])), 12) for r in whole]
    assert [[tuple(x) for x in r.runs] for r in whole] == [[tuple(x.values()) for x in a.to_pylist()[0]] for a, _ in small]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in entry_module.queries()["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    checked = 0
    for d in docs:
        words, r = planted(d.doc_id, words_of(d.text)), rows[d.doc_id]
        if len(words) > 1500:
            continue
        checked += 1
        runs = every_run(words, 12)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(without_repetitions(words, runs).encode()).hexdigest()
    assert checked > 100 and any(r.n_runs for r in rows.values())
