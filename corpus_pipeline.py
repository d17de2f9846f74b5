"""A corpus pipeline of five of the training-data operators, each stage written and read again.

toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, byte-level BPE. The first
four return the columns of ``documents``; the last returns a row per document that is left, with its ids.

All stages take rows with nulls in any column and whole texts of any length, give an empty table for an empty one, and
leave columns that they do not use as they are, whatever their names. What each does with null and empty texts, ties and
repeated rows stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import byte_bpe, decontaminate, similar, substring_dedup, toxicity
from tidewatch.llm.common import free_name
from tidewatch.session import scratch_path, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, finds toxic go.

    Null and empty texts are scored as texts without features, so they stay unless such texts are toxic by the labels;
    repeated rows go or stay together. Without labels of both kinds all stay.
    """
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share at least 0.8 of their runs of five words, directly or by a chain, the one with the smallest id stays.

    Ids that are null come last and ties go to the smallest text hash; of rows that repeat id and text one stays. Null and empty
    texts and those without words are one group, of which one row stays.
    """
    small_batches(spark)
    return similar.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut out; n_chars follows the text where it is cut.

    Earlier is the smaller id (null first), then the text hash, then the place. All rows stay, null and empty texts as they are;
    rows that repeat id and text keep what they share with each other.
    """
    small_batches(spark)
    removed, firsts = free_name(docs, "_removed"), free_name(docs, "_firsts")
    cut = substring_dedup.without_repeats(docs, removed=removed, first_ids=firsts)
    length = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay, as does all without a benchmark; repeated rows go or stay together.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token_ids, and text as the ids decode to it.

    Null and empty texts have no ids and an empty text; repeated rows stay rows of their own.
    """
    small_batches(spark)
    vocabulary = byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, ["doc_id", "source", "lang"]), vocabulary)
    return both.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

# The model, the fingerprints, the cuts and the ids of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
