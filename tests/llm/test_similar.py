"""Near-duplicates by exact Jaccard similarity, against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from tidewatch.llm import similar


def edited(rng, words, share):
    """``words`` with isolated words replaced so that about ``share`` of the five-word runs stay common."""
    out, edits = list(words), round((1 - share) / (1 + share) * len(words) / 5)
    for i in rng.sample(range(0, len(words), 6), edits):
        out[i] = f"new{rng.random()}"
    return out


def texts(seed):
    rng = random.Random(seed)
    out = []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        out += [" ".join(x) for x in (base, edited(rng, base, 0.83), edited(rng, base, 0.72), edited(rng, base, 0.5))]
    # One group of short copies, each unlike the others but near to the text that all come from.
    base = [f"h{i}" for i in range(60)]
    out += [" ".join(base)] + [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(5, 55)]
    return out + ["", " \n", "Four words are here", "four WORDS  are here", "Some other four words"]


def plain_kept(rows):
    own = [similar.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if similar.similarity(own[i], own[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


@pytest.mark.parametrize("unit, leaf, four_blocks", [(2048, 1024, 1 << 20), (16, 4, 1 << 20), (2048, 1, 0)])
def test_kept_rows_are_those_of_all_pairs(spark, monkeypatch, unit, leaf, four_blocks):
    for name, value in (("UNIT", unit), ("LEAF", leaf), ("FOUR_BLOCKS", four_blocks)):
        monkeypatch.setattr(similar, name, value)
    rows = list(enumerate(texts(3)))
    got = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_kept(rows)
    assert 60 < len(got) < len(rows) - 100


@pytest.mark.parametrize("leaf", [1, 50, 10**6])
def test_trie_pairs_are_all_pairs_within_the_budget(monkeypatch, leaf):
    monkeypatch.setattr(similar, "LEAF", leaf)
    monkeypatch.setattr(similar, "PAIRS", 300)
    rng = np.random.default_rng(1)
    value = np.concatenate([np.sort(rng.integers(0, 1 << 12, n)) for n in (1, 40, 0, 90)])
    starts, ends = np.array([0, 1, 41]), np.array([1, 41, 131])
    got = [p for i, j in similar.trie_pairs(starts, ends, value, 12) for p in zip(i.tolist(), j.tolist())]
    want = [(i, j) for a, b in zip(starts, ends) for i, j in combinations(range(a, b), 2) if bin(value[i] ^ value[j]).count("1") <= 3]
    assert sorted(got) == want and len(want) > 100


def test_wide_fingerprints_are_majorities_of_bits():
    hashes = np.random.default_rng(2).integers(0, 2**63, 77, dtype=np.uint64)
    for n in (1, 2, 3, 64, 77):
        x = hashes[:n, None] * similar._ODD[0]
        x = (x ^ (x >> np.uint64(29))) * similar._ODD[1]
        x ^= x >> np.uint64(32)
        want = [sum(int(r[w]) >> b & 1 for r in x) * 2 > n for w in range(similar.WORDS) for b in range(64)]
        got = np.unpackbits(np.frombuffer(similar.wide_fingerprint(hashes[:n]), np.uint8), bitorder="little")
        assert (got == want).all()


def test_edge_rows(edge_docs, no_docs):
    kept = similar.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    assert sum(not (r.text or "").strip() for r in rows) == 1 and sum(r.doc_id == 2 for r in rows) == 2
    assert similar.one_of_each(no_docs).count() == 0


def pairs_of(sets):
    groups = {}
    for r in sets.collect():
        groups.setdefault(r.set, set()).add(r.same)
    return groups, {p for g in groups.values() for p in combinations(sorted(g), 2)}


def test_texts_of_equal_prints_all_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "UNIT", 16)
    monkeypatch.setattr(similar, "PRINTS", 1)
    nodes = spark.createDataFrame([(i, b"\1\2\3\4\5") for i in range(40)], "same long, wide binary")
    groups, met = pairs_of(similar.candidate_sets(nodes))
    assert met == set(combinations(range(40), 2))
    assert max(map(len, groups.values())) <= 2 * 16


def test_a_group_of_near_copies_is_one_set(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, similar.PRINTS * similar.BITS, dtype=np.uint8)
    rows = [(i, np.packbits(base ^ (rng.random(len(base)) < 0.04), bitorder="little").tobytes()) for i in range(300)]
    groups, met = pairs_of(similar.candidate_sets(spark.createDataFrame(rows, "same long, wide binary")))
    assert len(groups) == 1 and len(met) == 300 * 299 // 2
