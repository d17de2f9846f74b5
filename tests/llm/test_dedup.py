"""Duplicates and contamination: SimHash, substring dedup, winnowing."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm_cases import PASSAGE
from pyspark.sql import functions as F

from tidewatch.llm import common, components, decontaminate, simhash, substring_dedup

LOW = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(values):
    """Smallest reachable value by comparing all pairs."""
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(values)), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.BUDGET:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def near_values(seed, n=120):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for v in out[:40]:
        for _ in range(5):
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
            out.append(v)
    return [v - 2**64 if v >= 2**63 else v for v in out]


def test_fingerprints_equal_plain_python(spark, sf_dir, edge_docs):
    docs = edge_docs.select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 3000"))
    for r in simhash.with_fingerprint(docs).collect():
        assert r.fingerprint & (2**64 - 1) == plain_fingerprint(r.text)


def test_walk_finds_exactly_the_close_pairs():
    v = np.sort(np.array(sorted({x & (2**64 - 1) for x in near_values(1)}), dtype=np.uint64))
    i, j = simhash.walk_pairs(np.zeros(len(v), int), np.zeros(len(v), int), v)
    want = {(a, b) for a, b in combinations(range(len(v)), 2) if (int(v[a]) ^ int(v[b])).bit_count() <= 3}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


@pytest.mark.parametrize("unit", [2048, 4])
def test_trie_links_connect_what_all_pairs_connect(spark, monkeypatch, unit):
    monkeypatch.setattr(simhash, "UNIT", unit)
    values = near_values(2)
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in set(values)], "fingerprint long"))
    got = {r.node: r.root for r in components.components(links, "x", "y").collect()}
    assert {v: got.get(v, v) for v in values} == plain_components(values)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates_of_edge_rows(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    wordless = [r for r in rows if r.fingerprint == 0]
    assert {r.doc_id for r in wordless} == {3, 4, 5, None} and {r.component_id for r in wordless} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_component_stays(edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    near = simhash.near_duplicates(edge_docs).select("component_id").distinct().count()
    rows = kept.collect()
    # Two unlike texts have the id 2, so two components have it as their smallest.
    assert len(rows) == near + 1 and sum(r.doc_id == 2 and PASSAGE in r.text for r in rows) == 1
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert simhash.one_of_each(no_docs).count() == 0


def plain_pieces(text):
    """Sentences end behind . ! or ? and white space, or at a line's end; long ones are cut behind the least words of all windows."""
    out, at = [], 0
    ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n\s*", text)] + [len(text)]
    for end in ends:
        sentence = text[at:end]
        words = list(re.finditer(r"\S+", sentence))
        cuts = set()
        if len(words) > 12:
            marks = [zlib.crc32(w.group().lower().encode()) for w in words]
            for s in range(len(words) - 11):
                least = min(marks[s : s + 12])
                cuts.add(max(i for i in range(s, s + 12) if marks[i] == least))
        piece = []
        for i, w in enumerate(words):
            stop = words[i + 1].start() if i + 1 < len(words) else len(sentence)
            piece.append((w.group().lower(), sentence[w.start() if piece or i else 0 : stop]))
            if i in cuts or i == len(words) - 1:
                out.append((tuple(x for x, _ in piece), "".join(x for _, x in piece)))
                piece = []
        if not words and sentence:
            out.append(((), sentence))
        at = end
    return out


def plain_cuts(rows):
    """All runs of pieces as the words themselves, without hashes: what is first stays, all else goes."""
    first, gone = {}, defaultdict(set)
    keys = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    cut = {(i, tie): plain_pieces(text or "") for i, text, tie in keys}
    for i, text, tie in keys:
        own = [k for k, (words, _) in enumerate(cut[i, tie]) if words]
        for s in range(len(own)):
            for e in range(s + 3, len(own) + 1):
                run = tuple(cut[i, tie][k][0] for k in own[s:e])
                if sum(map(len, run)) >= 15:
                    if first.setdefault(run, (i, tie, s)) != (i, tie, s):
                        gone[i, tie] |= set(range(own[s], own[e - 1] + 1))
                    break
    out = {}
    for i, text, tie in keys:
        pieces, drop = cut[i, tie], gone[i, tie]
        out[i, tie] = ("".join(p for k, (_, p) in enumerate(pieces) if k not in drop), sum(len(w) for k, (w, _) in enumerate(pieces) if k in drop)) if drop else (text, 0)
    return out


def test_pieces_cover_the_text(edge_docs):
    for (text,) in edge_docs.select("text").collect():
        assert "".join((text or "")[a:b] for a, b, _, _ in substring_dedup.pieces_of(text or "")) == (text or "")


def test_repeats_are_cut_as_in_plain_python(spark, sf_dir, edge_docs):
    docs = edge_docs.select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100", "text"))
    rows = docs.withColumn("h", F.hash("text")).collect()
    want = plain_cuts([(r.doc_id, r.text, r.h) for r in rows])
    got = substring_dedup.without_repeats(docs.withColumn("h", F.hash("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_removed_words) == want[r.doc_id, r.h], r.doc_id
        assert r.n_removed_words or not r.first_ids
    assert sum(r.n_removed_words > 0 for r in got) > 20


@pytest.mark.parametrize("most", [1 << 15, 1 << 29])
def test_bitmaps_never_deny_a_value(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAP_BITS", (1 << 15, most))
    held = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    found = common.bitmap(held, "k").value
    own, others = (np.array([r.k for r in spark.range(a, a + 20_000).select(F.xxhash64("id").alias("k")).collect()]) for a in (0, 10**6))
    assert found.holds(own).all() and len(found.bits) * 8 <= most
    assert found.holds(others).mean() < (0.1 if most > 1 << 15 else 0.6)
    assert not common.bitmap(held.limit(0), "k").value.holds(own).any()


def test_a_passage_stays_once_wherever_it_stands(spark, edge_docs, no_docs):
    out = substring_dedup.without_repeats(edge_docs)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and len(set(out.columns)) == len(out.columns)
    inner = "Athinti atsh inwhtion thoninti of and erst thentien"
    assert [r.doc_id for r in rows if inner in (r.text or "")] == [None]
    assert {r.text for r in rows if r.doc_id == 3} == {None} and {r.text for r in rows if r.doc_id == 7} == {r.text for r in edge_docs.collect() if r.doc_id == 7}
    assert substring_dedup.without_repeats(no_docs).count() == 0


def plain_contamination(docs, items):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if x]
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(item)
    lengths = {len(x) for x in windows}
    out = []
    for _, text in docs:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        found.discard(None)
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


ITEMS = [
    (1, PASSAGE), (1, "and one more line follows"), (2, "idiot"), (3, "A a"), (10, "don't I'LL 12345 !"), (4, None), (5, "..."), (None, "some other words stand here before it number"),
    (6, "over and over " * 8), (7, PASSAGE), (8, "wort1 the1"), (9, "zwei drei vier fünf sechs sieben acht neun zehn"),
]


def test_winnowing_finds_every_window(spark, edge_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = [(50, "x " + "over and over " * 30), (51, "eins zwei drei vier fünf sechs sieben acht neun zehn elf"), (52, PASSAGE.upper().replace(" ", ", "))]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = decontaminate.contamination(docs, bench).collect()
    rows = docs.collect()
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, r["items"])
    want = plain_contamination([(r.doc_id, r.text) for r in rows], ITEMS)
    assert sorted(map(key, got)) == sorted((str(r.doc_id), *w) for r, w in zip(rows, want))
    clean = decontaminate.without_contaminated(edge_docs, bench)
    assert clean.columns == edge_docs.columns and clean.count() == sum(w[1] == 0 for w in want[: edge_docs.count()])
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("length", range(1, 11))
def test_guarantee_for_each_window_length(spark, length):
    rng = random.Random(length)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(20)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(length))) for i in range(6)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_contamination(docs, items)
    assert [(r.n_words, r.n_hit, r["items"]) for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
