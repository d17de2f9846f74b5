"""Every shared span of fifty words holds a common run, wherever it stands and however few words it has."""

import random

import pytest
from llm_cases import PASSAGE
from pyspark.sql import functions as F

from tidewatch.llm import substring_dedup

LONG = 50


def planted(rng, words, ends):
    """A passage inside two other texts, at random places of their sentences."""
    word = lambda: rng.choice(words)
    sentence = lambda: " ".join(word() for _ in range(rng.choice([2, 5, 11, 12, 13, 25]))) + rng.choice([".", "!", "\n"] if ends else [""])
    stream = []
    while len(stream) < LONG:
        stream += sentence().replace("\n", ".").split()
    passage = " ".join(stream[:LONG])
    around = lambda: " ".join(f"{rng.choice('abc')}{rng.randrange(10**9)}" for _ in range(rng.randrange(20)))
    return [f"{around()} {passage} {around()}" for _ in range(2)]


@pytest.mark.parametrize("ends", [True, False])
@pytest.mark.parametrize("variety", [1, 2, 3, 10, 5000])
def test_shared_spans_hold_a_common_run(variety, ends):
    for seed in range(200):
        rng = random.Random(seed)
        a, b = planted(rng, [f"w{rng.randrange(10**6)}" for _ in range(variety)], ends)
        assert set(substring_dedup.runs_of(a)[0]) & set(substring_dedup.runs_of(b)[0]), (seed, a, b)


def test_pieces_are_bounded():
    rng = random.Random(1)
    for variety in (1, 2, 3, 50, 5000):
        text = " ".join(f"w{rng.randrange(variety)}" for _ in range(3000))
        assert max(p[3] for p in substring_dedup.pieces_of(text)) <= substring_dedup.LONG_SENTENCE
        assert "".join(text[p[0] : p[1]] for p in substring_dedup.pieces_of(text)) == text


def test_low_variety_passage_is_cut_in_spark(spark):
    body = "same word " * 40
    docs = spark.createDataFrame([(1, f"First text begins so {body}and ends."), (2, f"Another one {body}goes on otherwise.")], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed_words for r in substring_dedup.without_repeats(docs).collect()}
    assert removed[2] >= 50


def test_texts_of_one_id_with_equal_32_bit_hashes_are_told_apart(spark):
    own = F.when(F.col("id") % 2 == 0, F.concat(F.lit(PASSAGE + " "), "id")).otherwise(F.concat(F.lit("Clean words of number "), "id"))
    texts = spark.range(400_000).select("id", own.alias("text")).withColumn("h", F.hash("text"))
    even, odd = texts.where("id % 2 = 0").select("h", F.col("text").alias("x")), texts.where("id % 2 = 1").select("h", F.col("text").alias("y"))
    pair = even.join(odd, "h").orderBy("x").first()
    docs = spark.createDataFrame([(1, PASSAGE), (2, pair.x), (2, pair.y)], "doc_id long, text string")
    got = {r.text: r.n_removed_words for r in substring_dedup.without_repeats(docs).collect()}
    assert got[pair.y] == 0 and sum(n > 0 for n in got.values()) == 1
