"""Row-local operators and URL rules: quality rules, URL filters, sharding."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_rules, sharding, url_filters

SPACE = "[\x20\x09-\x0d]+"


def plain_measures(text):
    t = text or ""
    w = [x for x in re.split(SPACE, t) if x]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_measures_equal_plain_python(spark, edge_docs, sf_dir):
    docs = edge_docs.select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_measures(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and (r.base_failed or r.failed))


def test_quality_rules_replace_clashing_columns(edge_docs, no_docs):
    out = quality_rules.judge(edge_docs)
    assert len(out.columns) == len(set(out.columns)) and set(dict(out.dtypes)[c] for c in ("n_words", "kept")) == {"bigint", "boolean"}
    assert out.count() == edge_docs.count() and quality_rules.judge(no_docs).count() == 0


def test_rules_come_from_the_table(spark):
    text = " ".join(["the word and"] * 3 + [f"w{i} ###" for i in range(40)])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.judge(docs).first().failed == ["symbols_per_word"]
    assert quality_rules.judge(docs, rules=()).first().kept


URLS = [
    "http://a.example.org/es/1", "https://example.org/en/1", "https://EXAMPLE.org/en/2?x=://y/", "https://notexample.org/en/1", "http://x.com/fr/a", "http://x.com/de/a",
    "http://com/de/", "http://x.com:80/de/", "http://com", "ftp://b.net?q#f", "no scheme", "", None, "://", "http://www.cheap-pills.net/en/1", "http://news.casino.net/a",
    "http://casino.net/a", "http://cheap.pills.net/", "http://x.net/a/login", "http://x.net/a#/login", "http://.org/x", "http://a\nb.org/x", "http://spam-farm.example.com/fr/1",
]


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in url_filters.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    low = (url or "").translate({i: i + 32 for i in range(65, 91)})
    found = sorted((r.verdict, r.name) for r in url_filters.PATTERN_RULES if "://" in low and re.search(r.pattern, low))
    return host, path, None, found[0][0] if found else "allow"


def test_urls_equal_all_rules_on_all_urls(spark):
    pages = spark.createDataFrame([(i % 7, u, "own") for i, u in enumerate(URLS * 2)], "page_id long, url string, _url string")
    rows = url_filters.judge_urls(pages).collect()
    assert len(rows) == len(URLS) * 2 and {r["_url"] for r in rows} == {"own"}
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url), r.url


def test_url_rules_need_tokens_and_empty_tables_work(spark):
    with pytest.raises(ValueError):
        url_filters.PatternRule("x", "a.*b", ())
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_a_host_of_very_many_labels(spark):
    """Linear in the labels: 20,000 of them take no longer than the rest of the job."""
    import time

    hosts = [".".join(["a"] * n + ["example", "org"]) for n in (1, 20_000)]
    few, many = (spark.createDataFrame([(1, f"http://{h}/en/1?{'q' * len(h)}")], "page_id long, url string") for h in hosts)
    took = []
    for pages in (few, few, many):
        start = time.time()
        assert [r.rule for r in url_filters.judge_urls(pages).collect()] == ["example.org/en/1"]
        took.append(time.time() - start)
    assert took[2] < took[1] + 1


def test_large_rule_tables(spark):
    sites = spark.range(100_000).select(F.concat(F.lit("h"), "id", F.lit(".example.net")).alias("host"), F.lit("/").alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    patterns = spark.range(50_000).select(
        F.concat(F.lit("r"), "id").alias("name"), F.concat(F.lit("/t"), "id", F.lit(r"\b")).alias("pattern"), F.array(F.concat(F.lit("t"), "id"), F.lit("common")).alias("tokens"), F.lit("block").alias("verdict")
    )
    urls = ["http://x.h4.example.net/", "http://h5.example.net/common/t9", "http://other.org/common/t17", "http://other.org/common/t17b", "http://other.org/t99999"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.pattern, r.verdict) for r in url_filters.judge_urls(pages, site_rules=sites, pattern_rules=patterns).collect()}
    assert got == {0: ("h4.example.net/", None, "block"), 1: ("h5.example.net/", None, "allow"), 2: (None, "r17", "block"), 3: (None, None, "allow"), 4: (None, None, "allow")}
    with pytest.raises(ValueError):
        url_filters.judge_urls(pages, pattern_rules=patterns.withColumn("tokens", F.array(F.lit("Not one"))))
    with pytest.raises(ValueError):
        url_filters.judge_urls(pages, site_rules=(), pattern_rules=())


@pytest.mark.parametrize("n", [1, 2, 3, 16, 1000, 65537])
def test_permutation_and_its_inverse(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 7, backwards=True) == np.arange(n)).all()


def test_shards_differ_by_a_row_and_places_can_be_computed(spark, edge_docs):
    docs = spark.range(103).selectExpr("id % 5 AS doc_id", "CAST(id % 9 AS string) AS text", "'own' AS _part", "1 AS shard")
    rows = sharding.shard_rows(docs, ["doc_id", "text"], 7, seed=3).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 103 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        assert sharding.place(r.row_number, 103, 7, 3) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, 103, 7, 3) == r.row_number
    ordered = [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: r.row_number)]
    assert ordered == sorted(ordered)
    assert sharding.shard_rows(edge_docs, ["doc_id", "text"], 4).count() == edge_docs.count()
    assert sharding.shard_rows(docs.limit(0), ["doc_id"], 4).count() == 0


def test_shuffle_spreads():
    p = sharding.permute(np.arange(100_000), 100_000, 0)
    steps = np.bincount((p[1:] % 16 - p[:-1] % 16) % 16)
    assert abs(np.corrcoef(p, np.arange(100_000))[0, 1]) < 0.02 and steps.max() < 1.1 * len(p) / 16 and math.isfinite(steps.min())
